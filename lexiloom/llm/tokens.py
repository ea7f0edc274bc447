"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

The pre-tokenizers of the two public vocabularies used here never join what stands on the two sides of a single space:
the byte-level one gives the space to the word after it, the word-level one drops it. So a text's ids are those of its
space-separated units in order, and each distinct unit of a batch is encoded once. A unit made of Latin words, one run
of marks after each and one line break at most is put together from its pre-tokens, which the library's BPE model encodes
once and the cache keeps; any other goes through the whole tokenizer. Texts where a space has white space on both sides, with
control characters used as marks here, or with strings of special tokens, are encoded whole.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiloom.llm.shared import give_back, worker_cache
from lexiloom.llm.texts import batches



@dataclass(frozen=True)
class Room:
    """What a worker may hold; more of it saves time, the ids are the same.

    cache_words: pre-tokens met again that a generation of the cache holds, and half as many met once; two of each are
    remembered, so that frequent ones outlive a change. batch_chars: the characters of text encoded at a time.
    arrow_bytes: of the batches that Spark hands to Python.
    """

    cache_words: int
    batch_chars: int
    arrow_bytes: int


#: For a job of its own, and for one whose executors are full from what came before.
WIDE, NARROW = Room(120_000, 4_000_000, 8 << 20), Room(20_000, 250_000, 1 << 20)
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIGHT, _MARKED = f"{_SPACE} {_SPACE}", r"  |<\||[\x00-\x02]"
#: Letters of the Latin-1 block: any of them is a letter to the pre-tokenizers, and stays one in lower case.
_WORD = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+"
#: Marks of ASCII, a run of which is one pre-token; not the apostrophe, with which contractions begin, nor < | > of special tokens.
_MARKS = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+"
_PLAIN = rf"^\x00?{_WORD}({_MARKS})?(\n{_WORD}({_MARKS})?)?$"


def _byte_alphabet() -> list[str]:
    """The letter that the byte-level alphabet gives each byte: printable ones themselves, the rest from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: The letters by byte as UTF-16; \x01 stays, as it stands between pre-tokens.
_LETTERS = np.array([1 if b == 1 else ord(x) for b, x in enumerate(_byte_alphabet())], "<u2")


class WordCache:
    """encode() gives the same ids as Tokenizer.encode(text, add_special_tokens=False).

    keeps_space: whether a unit takes the space before it along (byte level) or drops it (word level, lower case).
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = WIDE.cache_words):
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps, self.limit = Tokenizer.from_file(path), keeps_space, limit
        self.model = self.tokenizer.model
        # ids as 32-bit numbers: a fifth of a tuple's room
        self.words: dict[str, bytes] = {}  # met in one batch: most never come again
        self.older: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}  # met in several, which single ones don't push out
        self.kept_older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, units: pa.Array) -> pa.ListArray:
        """The pre-tokens of each unit; a unit that isn't plain is one piece, marked by \\x02."""
        lead = " " if self.keeps else ""
        bare = pc.match_substring_regex(units, f"^{_WORD}$")  # most of them
        rest = units.filter(pc.invert(bare))
        plain = pc.match_substring_regex(rest, _PLAIN)
        fine = pc.replace_substring_regex(rest, f"({_MARKS})", "\x01\\1")
        fine = pc.replace_substring(fine, "\n", "\x01\n\x01" if self.keeps else "\x01")
        first = pc.starts_with(rest, "\0")
        with_lead = lambda x: pc.if_else(first, pc.replace_substring(x, "\0", ""), pc.binary_join_element_wise(lead, x, ""))
        rest = pc.if_else(plain, with_lead(fine), pc.binary_join_element_wise("\x02", with_lead(rest), ""))
        return pc.split_pattern(pc.replace_with_mask(pc.binary_join_element_wise(lead, units, ""), pc.invert(bare), rest), "\x01")

    def _learn(self, new: list[str]) -> None:
        tokenize, words = self.model.tokenize, self.words
        odd, plain = [w for w in new if w[:1] == "\x02"], [w for w in new if w[:1] != "\x02"]
        for w, ids in zip(odd, self._ids([w[1:] for w in odd]), strict=True):
            words[w] = array("I", ids).tobytes()
        if plain:
            together = "\x01".join(plain)
            together = (together if self.keeps else together.lower()).encode()
            letters = _LETTERS[np.frombuffer(together, np.uint8)].tobytes().decode("utf-16-le").split("\x01")
            for w, x in zip(plain, letters, strict=True):
                words[w] = array("I", [t.id for t in tokenize(x)]).tobytes()

    def _known(self, names: list[str]) -> list[bytes]:
        """The ids of each pre-token, learnt where they are new."""
        if len(self.words) > self.limit // 2:
            self.older, self.words = self.words, {}
        if len(self.kept) > self.limit:
            self.kept_older, self.kept = self.kept, {}
        kept = self.kept
        out = list(map(kept.get, names))
        left = [i for i, x in enumerate(out) if x is None]
        for before in (self.kept_older, self.words, self.older):
            rest = []
            for i, ids in zip(left, map(before.get, [names[i] for i in left]), strict=True):
                if ids is None:
                    rest.append(i)
                else:
                    kept[names[i]] = out[i] = ids
                    del before[names[i]]
            left = rest
        self._learn([names[i] for i in left])
        for i in left:
            out[i] = self.words[names[i]]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        array = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(array, f"{_TIGHT}|{_MARKED}" if self.keeps else r"<\||[\x00-\x02]")
        # the first unit of a text has no space before it; it is marked by a zero character
        marked = pc.binary_join_element_wise("\0", pc.if_else(odd, "", array), "")
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary)
        words = pieces.flatten().dictionary_encode()
        # one string that Python splits: faster than a scalar for each
        together = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        ids = self._known(pc.binary_join(together, "\x01")[0].as_py().split("\x01"))
        # from words to the pieces of a unit, and from units to texts
        flat, lens = _flat(np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, words.indices.to_numpy())
        flat, lens = _flat(flat, np.add.reduceat(lens, pieces.offsets.to_numpy()[:-1]), coded.indices.to_numpy())
        per = np.add.reduceat(lens, split.offsets.to_numpy()[:-1])
        if whole := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            cut = np.split(flat, np.cumsum(per)[:-1])
            for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                cut[i] = np.array(x, np.uint32)
            flat, per = np.concatenate(cut), np.array([len(x) for x in cut], np.int64)
        return flat, per


def shared_cache(path: str, keeps_space: bool, room: Room = WIDE) -> WordCache:
    """The worker's cache for a vocabulary: its next task goes on with it."""

    def load() -> WordCache:
        give_back()
        cache = WordCache(path, keeps_space, room.cache_words)
        give_back()  # reading the vocabulary takes more than it is in the end
        return cache

    return worker_cache((path, keeps_space, room), load)


def _flat(values: np.ndarray, lens: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chosen runs, where run i is lens[i] long; and the lengths of the chosen."""
    offs, own = (np.cumsum(lens) - lens)[chosen], lens[chosen]
    ends = np.cumsum(own)
    return values[np.repeat(offs - (ends - own), own) + np.arange(ends[-1])], own


def with_end(flat: np.ndarray, per: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each text's ids."""
    return np.insert(flat, np.cumsum(per), end_id).astype(np.uint32), per + 1


def text_batches(texts: list[str], room: Room = WIDE):
    """Ranges of texts with about room.batch_chars characters each; a longer text is a range of its own."""
    return batches(map(len, texts), room.batch_chars)
