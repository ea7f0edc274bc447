"""Operator 10, toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labels of documents outside the held-out fold only, EXAMPLES of each class on average, chosen by a hash of
doc_id. Terms are runs of letters and digits in lower case, all that any example has. A document's vector has two parts
of equal weight: all its terms, and the marked ones, terms and beginnings of terms whose share of toxic examples is surely
above one half. Both are TF-IDF vectors whose idf counts all documents; a document without a marked term has the first
part alone. So wording that no marked term covers has neighbours too, and a copy of an example has a cosine of 1.

The index holds the postings of the examples. Frequent terms lie in blocks of examples with the greatest weight of each
term there; the postings of all other terms are added up. Both give a bound of each block. The blocks with the highest
bounds are scored first, their k-th best cosine is a floor, and every other block is scored whose bound reaches it: the
neighbours are exact. Their labels, weighted by cosine, and a prior give the score; neighbours and marked terms are its
evidence. Documents without any term get the share of toxic examples among examples without one.

Everything that the driver or a task holds is bounded by the texts of the examples and one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import clear_worker, materialise, small_batches, spent, unit
from lexiloom.llm.texts import RangeHashes, as_bytes, batches, mixed, runs

#: Labelled examples of each class, on average: the bound of what is fitted.
EXAMPLES = 5_000
#: Bytes of the beginnings of terms that may be marked.
PREFIXES = (4, 5, 6, 7)
#: A term is marked if so many toxic examples and such a share of them have it, and its share of toxic examples is surely above LEAST.
MIN_TOXIC, MIN_SHARE, LEAST = 5, 0.01, 0.5
NEIGHBOURS, PRIOR, INDEX_BLOCK, QUERIES = 16, 0.5, 128, 64
#: A term that more of the examples have is frequent; blocks scored before the rest.
FREQUENT, EARLY = 0.1, 6
BATCH_BYTES = 1_000_000
#: What a scoring task holds besides the index: an Arrow batch, the hashes of some texts, some postings with their products.
ARROW_BYTES, SCORED_BYTES, POSTINGS = 2 << 20, 500_000, 250_000
#: Rows that Spark's Parquet reader decodes at once: the 4,096 of its default are tens of megabytes of texts in one array.
READ_ROWS = 512

_MEMBER = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)
_BEGINS = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    """Whether a document lies in the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    return batches(pc.binary_length(texts).to_numpy().tolist(), most)


class Found:
    """The terms of some texts in order: text number, place, key of the whole term."""

    def __init__(self, texts: pa.Array):
        self.data, bounds = as_bytes(pc.utf8_lower(texts))
        start, stop, row = runs(_MEMBER[self.data], bounds)
        long = stop - start > 1
        self.start, self.stop, self.row = start[long], stop[long], row[long]
        self.hashes = RangeHashes(self.data)
        self.key = self.hashes.of(self.start, self.stop).view(np.int64)

    def beginnings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(which terms have so many bytes, the keys of their beginnings)."""
        which = np.flatnonzero(self.stop - self.start >= length)
        return which, mixed(self.hashes.of(self.start[which], self.start[which] + length) ^ _BEGINS).view(np.int64)


def term_counts(examples: DataFrame) -> DataFrame:
    """(key, term, toxic, clean): in how many texts (text, label) of each class a term occurs; ^ marks beginnings."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for chunk in chunks:
            labels = chunk.column("label").to_numpy()
            for a, b in text_batches(chunk.column("text")):
                found = Found(chunk.column("text").slice(a, b - a))
                for length in (None, *PREFIXES):
                    which, key = (np.arange(len(found.key)), found.key) if length is None else found.beginnings(length)
                    if not len(which):
                        continue
                    row, start = found.row[which], found.start[which]
                    by = np.lexsort((row, key))
                    key, row, start, which = key[by], row[by], start[by], which[by]
                    new = np.ones(len(key), bool)
                    new[1:] = key[1:] != key[:-1]
                    once = new.copy()
                    once[1:] |= row[1:] != row[:-1]
                    toxic = labels[a + row] == 1
                    at = np.flatnonzero(new)
                    ends = start[at] + length if length else found.stop[which[at]]
                    raw = found.data.tobytes()
                    mark = "^" if length else ""
                    names = [mark + raw[s:e].decode("utf-8", "replace") for s, e in zip(start[at].tolist(), ends.tolist(), strict=True)]
                    columns = [key[at], names, np.add.reduceat((once & toxic).astype(np.int64), at), np.add.reduceat((once & ~toxic).astype(np.int64), at)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "term", "toxic", "clean"])

    counted = examples.mapInArrow(task, "key long, term string, toxic long, clean long")
    return counted.groupBy("key").agg(F.min("term").alias("term"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def marked_terms(counts: DataFrame, toxic_rate: float, clean_rate: float, toxic: float) -> DataFrame:
    """(key, term) of the terms whose share of toxic documents is surely above LEAST (Wilson's lower bound).

    The rates undo the sampling of the classes; toxic is the sampled size. As each has MIN_SHARE of the toxic examples,
    there are at most as many as 1 / MIN_SHARE examples have terms and beginnings.
    """
    n = F.col("toxic") + F.col("clean") * (toxic_rate / clean_rate)
    p, z = F.col("toxic") / n, 1.96
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return counts.filter(F.col("toxic") >= max(MIN_TOXIC, MIN_SHARE * toxic)).filter(lower > LEAST).select("key", "term")


class Terms:
    """Numbers of the known terms: first all terms of the examples, then the marked ones, both by sorted keys."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked, self.size = words, marked, len(words) + len(marked)

    @staticmethod
    def _numbers(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are known, their numbers)."""
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        which = np.flatnonzero(known[at] == keys) if len(known) else np.zeros(0, np.int64)
        return which, at[which]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf), sorted by text and term."""
        found = Found(texts)
        distinct, back = np.unique(found.key, return_inverse=True)
        number = np.full(len(distinct), -1)
        which, at = self._numbers(self.words, distinct)
        number[which] = at
        number = number[back]
        cells = [found.row[number >= 0] * self.size + number[number >= 0]]
        for length in (None, *PREFIXES) if len(self.marked) else ():
            of, keys = (np.arange(len(found.key)), found.key) if length is None else found.beginnings(length)
            which, at = self._numbers(self.marked, keys)
            cells.append(found.row[of[which]] * self.size + len(self.words) + at)
        cell, tf = np.unique(np.concatenate(cells), return_counts=True)
        return cell // max(1, self.size), cell % max(1, self.size), tf

    def vectors(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight): the unit vectors of n texts, their two parts of equal weight."""
        row, term, tf = found
        v = (1 + np.log(tf, dtype=np.float32)) * idf[term]
        part = 2 * row + (term >= len(self.words))
        square = np.bincount(part, v * v, 2 * n)
        parts = (square.reshape(n, 2) > 0).sum(axis=1)
        v /= np.sqrt(square[part] * parts[row])
        return row, term, v


def document_counts(docs: DataFrame, known) -> DataFrame:
    """(term, n): in how many documents (text) each term occurs, by number."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        terms = known.value
        n = np.zeros(terms.size, np.int64)
        for chunk in chunks:
            for a, b in text_batches(chunk.column("text")):
                n += np.bincount(terms.find(chunk.column("text").slice(a, b - a))[1], minlength=terms.size)
        del terms
        some = np.flatnonzero(n)
        for a in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 100_000]), pa.array(n[some[a : a + 100_000]])], names=["term", "n"])
        spent(known)

    return docs.select("text").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def example_terms(own: DataFrame, known) -> DataFrame:
    """(doc_id, label, h, terms, tf) of each example, the last two as bytes of int32; h tells repeated ids apart."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for chunk in chunks:
            for a, b in text_batches(chunk.column("text")):
                row, term, tf = known.value.find(chunk.column("text").slice(a, b - a))
                cuts = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                columns = [chunk.column(c).slice(a, b - a) for c in ("doc_id", "label", "h")]
                columns += [pa.array([x[s:e].astype(np.int32).tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "h", "terms", "tf"])

    return own.select("doc_id", "label", F.xxhash64("text").alias("h"), "text").mapInArrow(task, "doc_id long, label int, h long, terms binary, tf binary")


class BlockMaxIndex:
    """Postings of unit vectors by term; frequent terms by blocks of examples, with their greatest weight in each.

    ids: of the examples; vectors: (example, term, weight), sorted by example.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], n_terms: int, frequent: float = FREQUENT):
        row, term, value = vectors
        n = len(ids)
        # examples that share their heaviest term lie together, so that few blocks have high bounds for a query
        top = np.full(n, -1)
        by = np.lexsort((value, row))
        last = np.append(row[by][1:] != row[by][:-1], True) if len(row) else np.zeros(0, bool)
        top[row[by][last]] = term[by][last]
        order = np.lexsort((ids, top))
        self.ids, self.labels, self.weights = ids[order], labels[order], weights[order]
        spot = np.empty(n, np.int64)
        spot[order] = np.arange(n)
        row, value = spot[row], value.astype(np.float32)
        self.blocks = max(1, -(-n // INDEX_BLOCK))
        self.places = self.blocks * INDEX_BLOCK
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) > frequent * n)
        self.place = np.full(n_terms, -1, np.int32)  # of a frequent term
        self.place[often] = np.arange(len(often))
        dense = self.place[term] >= 0
        self.heavy = np.zeros((self.blocks, len(often), INDEX_BLOCK), np.float32)
        self.heavy[row[dense] // INDEX_BLOCK, self.place[term[dense]], row[dense] % INDEX_BLOCK] = value[dense]
        self.most = self.heavy.max(axis=2, initial=0).T.copy()
        row, term, value = row[~dense], term[~dense], value[~dense]
        by = np.argsort(term, kind="stable")
        self.row, self.value = row[by].astype(np.int32), value[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))]).astype(np.int32)

    def nearest(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int, skips: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries (query, term, weight): (rows, cosines) of the k nearest examples with a cosine above 0.

        Ties go by row; never the example whose id is the query's of skips.
        """
        query, term, value = queries
        place = self.place[term]
        common = np.zeros((n, self.heavy.shape[1]), np.float32)
        common[query[place >= 0], place[place >= 0]] = value[place >= 0]
        score = self._rare(query[place < 0], term[place < 0], value[place < 0].astype(np.float32), n).reshape(n, self.blocks, INDEX_BLOCK)
        flat = score.reshape(n, -1)
        for i, skip in enumerate(skips):
            if skip is not None:
                flat[i, : len(self.ids)][self.ids == skip] = -np.inf
        flat[:, len(self.ids) :] = -np.inf
        bound = score.max(axis=2) + common @ self.most
        some = min(EARLY, self.blocks)
        high = np.argpartition(bound, -some, axis=1)[:, -some:]
        early = np.zeros(bound.shape, bool)
        np.put_along_axis(early, high, True, axis=1)
        self._add(score, common, early & (bound > 0))
        best = np.take_along_axis(score, high[:, :, None], axis=1).reshape(n, -1)
        least = min(k, best.shape[1])
        floor = np.maximum(0, np.partition(best, -least, axis=1)[:, -least] - 1e-5) if least == k else np.zeros(n)  # weights have 32 bits
        reached = (bound > 0) & (bound >= floor[:, None])
        self._add(score, common, reached & ~early)
        out = []
        for i in range(n):
            blocks = np.flatnonzero(reached[i] | early[i])
            inside = score[i, blocks]
            b, x = np.nonzero((inside > 0) & (inside >= floor[i]))
            cosine = inside[b, x].astype(float)
            rows = blocks[b] * INDEX_BLOCK + x
            by = np.lexsort((rows, -np.round(cosine, 6)))[:k]
            out.append((rows[by], np.minimum(cosine[by], 1.0)))
        return out

    def _rare(self, query: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Sums over the postings of terms that aren't frequent, for each query and place; POSTINGS at once, or those of one term."""
        length = self.start[term + 1] - self.start[term]
        score = np.empty((n, self.places), np.float32)
        for a, b in batches(np.bincount(query, length, n).tolist(), POSTINGS):
            first, last = np.searchsorted(query, (a, b)).tolist()
            some = np.zeros((b - a) * self.places)
            for c, d in batches(length[first:last].tolist(), POSTINGS):  # one range, except of a query that is too long alone
                of, size = slice(first + c, first + d), length[first + c : first + d]
                at = np.repeat(self.start[term[of]] - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)
                cell = np.repeat(((query[of] - a) * self.places).astype(np.int32), size) + self.row[at]
                some += np.bincount(cell, np.repeat(value[of], size) * self.value[at], len(some))
            score[a:b] = some.reshape(b - a, -1)
        return score

    def _add(self, score: np.ndarray, common: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the frequent terms to the blocks that are chosen for a query."""
        for b in np.flatnonzero(chosen.any(axis=0)).tolist():
            some = np.flatnonzero(chosen[:, b])
            score[some, b] += common[some] @ self.heavy[b]


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, h, held_out, score, predicted, neighbours, cosines, terms) of each row of docs; h: a hash of the text.

    labels: (doc_id, toxic 0/1); null labels and ids are ignored, of several labels for a document the highest counts, of
    several texts that with the smallest hash. terms: the marked ones. Null and empty texts have no terms. Without toxic
    examples every score is 0. A document is never its own neighbour; equal documents with other ids are. Rows with the
    same id and text have the same score. Each input row gives one row, an empty table none; extra columns are ignored.
    """
    small_batches(docs.sparkSession, ARROW_BYTES)
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    learnt = usable.groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id")))
    sizes = {r["label"]: r["n"] for r in learnt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {y: min(1.0, examples / max(1, sizes.get(y, 0))) for y in (0, 1)}
    sample = learnt.filter(unit(F.xxhash64(F.lit(10), "doc_id")) < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))
    sample = materialise(sample, "toxic-examples")  # 2 * examples rows on average: small enough to broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    own = materialise(texts.join(F.broadcast(sample), "doc_id"), "toxic-texts")
    once = own.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))  # copies show nothing more
    counts = materialise(term_counts(once.select("text", "label")), "toxic-terms")
    marks = marked_terms(counts, rate[1], rate[0], sizes.get(1, 0) * rate[1]).toArrow().sort_by("key")
    words = counts.filter(~F.col("term").startswith("^")).select("key").toArrow().column("key").to_numpy()  # those of the examples
    context = docs.sparkSession.sparkContext
    terms = Terms(np.sort(words), marks.column("key").to_numpy())
    known = context.broadcast(terms)

    df = np.zeros(max(1, terms.size))
    counted = document_counts(texts, known).toArrow()  # a row for each term of the examples at most
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = (np.log((1 + texts.count()) / (1 + df)) + 1).astype(np.float32)
    del counted, words
    found = example_terms(own, known).toArrow()  # 2 * examples rows on average
    ids, labelled = found.column("doc_id").to_numpy(), found.column("label").to_numpy().astype(np.int64)
    by = np.lexsort((found.column("h").to_numpy(), ids))
    by = by[np.append(True, ids[by][1:] != ids[by][:-1])] if len(by) else by
    found, ids, labelled = found.take(pa.array(by)), ids[by], labelled[by]
    raw = [np.frombuffer(b"".join(found.column(c).to_pylist()), np.int32) for c in ("terms", "tf")]
    row = np.repeat(np.arange(len(ids)), pc.binary_length(found.column("terms")).to_numpy() // 4)
    del found
    full = np.zeros(len(ids), bool)
    full[row] = True
    bare = {y: int(((labelled == y) & ~full).sum()) for y in (0, 1)}
    weight = {y: 1 / rate[y] for y in (0, 1)}
    vectors = terms.vectors((row, *raw), len(ids), idf)
    del raw
    index = BlockMaxIndex(ids, labelled, np.where(labelled == 1, weight[1], weight[0]), vectors, len(df))
    fitted = context.broadcast((index, idf, marks.column("term").to_pylist()))
    del index, vectors, row, idf, df, terms
    spent(known, fitted)  # the driver's copies
    share = lambda y, n: weight[y] * n.get(y, 0)
    base = (share(1, sizes) * rate[1]) / max(1e-9, share(1, sizes) * rate[1] + share(0, sizes) * rate[0])
    none = (share(1, bare) + PRIOR * base) / (share(1, bare) + share(0, bare) + PRIOR)

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        (index, idf, names), terms = fitted.value, known.value
        kinds = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()))
        for chunk in chunks:
            for a, b in text_batches(chunk.column("text"), SCORED_BYTES):
                ids = chunk.column("doc_id").slice(a, b - a).to_pylist()
                row, term, value = terms.vectors(terms.find(chunk.column("text").slice(a, b - a)), b - a, idf)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                marked = [[names[t] for t in term[s:e][term[s:e] >= len(terms.words)] - len(terms.words)] for s, e in zip(cuts.tolist(), cuts[1:].tolist())]
                out = [[none] * (b - a), [[]] * (b - a), [[]] * (b - a)]
                asked = np.flatnonzero(np.diff(cuts)) if len(index.ids) else []
                for at in range(0, len(asked), QUERIES):
                    group = asked[at : at + QUERIES]
                    pick = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in group])
                    queries = (np.repeat(np.arange(len(group)), np.diff(cuts)[group]), term[pick], value[pick])
                    for i, (rows, cosine) in zip(group.tolist(), index.nearest(queries, len(group), neighbours, [ids[i] for i in group]), strict=True):
                        vote = cosine * index.weights[rows]
                        out[0][i] = float(((vote * index.labels[rows]).sum() + PRIOR * base) / (vote.sum() + PRIOR))
                        out[1][i], out[2][i] = index.ids[rows].tolist(), cosine.tolist()
                some = [chunk.column(c).slice(a, b - a) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*some, *(pa.array(c, k) for c, k in zip([*out, marked], kinds, strict=True))], names=["doc_id", "h", "score", "neighbours", "cosines", "terms"])
        del index, idf, terms
        spent(known, fitted)

    hashed = texts.select("doc_id", F.xxhash64("text").alias("h"), "text")
    scored = hashed.mapInArrow(task, "doc_id long, h long, score double, neighbours array<long>, cosines array<double>, terms array<string>")
    return scored.select("doc_id", "h", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines", "terms")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; each row by its own id and text."""
    from lexiloom.llm.minhash import BROADCAST_IDS

    scored = toxicity(docs, labels).filter("predicted = 1")
    gone = materialise(scored.select(F.col("doc_id").alias("_lx_id"), F.col("h").alias("_lx_h")).distinct(), "toxic-gone")
    few = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_lx_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_lx_h"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
