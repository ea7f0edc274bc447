"""The pipeline and its operators against plain Python on small tables: nulls, ties, repeats, clashing columns."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import embedding_dedup, minhash, mixing, secrets, sharding, suffix_dedup, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "été", "lorem", "ipsum", "dolor", "sit"]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(50)}" for _ in range(n))


def corpus():
    rows = [(i, prose(i, 12 + i % 40)) for i in range(120)]
    rows += [(200 + i, prose(300 + i, 20) + " zorbful grumth" + " zorbfully" * (i % 3)) for i in range(60)]
    rows += [(300 + i, prose(i, 12 + i % 40).replace(" ", "  \n", 2)) for i in range(5)]  # equal after white space
    rows += [(400 + i, prose(60 + i, 12 + (60 + i) % 40) + " tail") for i in range(20)]  # near copies, the longer ones
    rows += [(500, None), (501, ""), (502, " "), (None, prose(3, 15)), (None, None), (7, prose(7, 19)), (7, prose(7, 19)), (600, "x" * 30_000)]
    return [(i, t, "en", [f"src{k % 3}", None, "odd"][k % 5 % 3], 0, k) for k, (i, t) in enumerate(rows)]


def labels_of(rows):
    return [(i, k % 2, int(200 <= i < 300)) for k, (i, *_) in enumerate(rows) if i is not None and i % 3] + [(None, 1, 1), (1, 0, None)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels_of(corpus()), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def terms_in(text):
    return [w for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text.lower()) if len(w.encode()) > 1]


def beginnings(w):
    return [b"^" + w.encode()[:k] for k in (4, 5, 6, 7) if len(w.encode()) >= k]


def brute_toxicity(rows, labels, k=16):
    """(id, text): (score, neighbours as (cosine, id), best first), over all pairs."""
    known = defaultdict(int)
    for i, _, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(known[i], y)
    texts = [(i, t or "") for i, t, *_ in rows]
    examples = {i: t for i, t in texts if i in known}
    counts = defaultdict(lambda: [0, 0])
    for t, y in {(t, known[i]) for i, t in examples.items()}:
        for x in {x for w in terms_in(t) for x in [w.encode(), *beginnings(w)]}:
            counts[x][y] += 1
    toxic = sum(known.values())

    def sure(n0, n1):
        n, p, z = n0 + n1, n1 / (n0 + n1), 1.96
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > 0.5

    marked = {x for x, (n0, n1) in counts.items() if n1 >= max(5, 0.01 * toxic) and sure(n0, n1)}
    words = {x for x in counts if x[:1] != b"^"}

    def tf(t):
        plain = Counter(w.encode() for w in terms_in(t) if w.encode() in words)
        extra = Counter(x for w in terms_in(t) for x in [w.encode(), *beginnings(w)] if x in marked)
        return {("w", x): n for x, n in plain.items()} | {("m", x): n for x, n in extra.items()}

    df = Counter(x for _, t in texts for x in tf(t))
    idf = lambda x: math.log((1 + len(texts)) / (1 + df[x])) + 1

    def vector(t):
        v = {x: (1 + math.log(n)) * idf(x) for x, n in tf(t).items()}
        square = Counter()
        for (part, _), w in ((x, v[x]) for x in v):
            square[part] += w * w
        return {x: w / math.sqrt(square[x[0]] * len(square)) for x, w in v.items()}

    vectors = {i: vector(t) for i, t in examples.items()}
    share = lambda ids: (sum(known[i] for i in ids), len(ids))
    n1, n = share(list(known))
    base = n1 / n
    b1, b = share([i for i, v in vectors.items() if not v])
    out = {}
    for i, t in texts:
        v = vector(t)
        near = sorted(((sum(w * u.get(x, 0) for x, w in v.items()), j) for j, u in vectors.items() if j != i), reverse=True)
        near = [(c, j) for c, j in near if c > 0][:k]
        votes = sum(c for c, _ in near)
        out[i, t] = ((sum(c * known[j] for c, j in near) + 0.5 * base) / (votes + 0.5) if v else (b1 + 0.5 * base) / (b + 0.5), near)
    return out


def test_toxicity_scores(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    want = brute_toxicity(corpus(), labels_of(corpus()))
    by_hash = {r["h"]: r["text"] for r in docs.selectExpr("xxhash64(coalesce(text, '')) h", "coalesce(text, '') text").collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert Counter((r["doc_id"], by_hash[r["h"]]) for r in rows) == Counter((i, t or "") for i, t, *_ in corpus())
    for r in rows:
        score, near = want[r["doc_id"], by_hash[r["h"]]]
        assert np.allclose(r["cosines"], [c for c, _ in near], atol=1e-5)
        edge = near[-1][0] if near else 0
        assert {j for j, c in zip(r["neighbours"], r["cosines"]) if c > edge + 1e-5} == {j for c, j in near if c > edge + 1e-5}
        if len(near) < 16 or sum(abs(c - edge) < 1e-5 for c, _ in near) < 2:
            assert abs(r["score"] - score) < 1e-4
    toxic = {r["doc_id"] for r in rows if r["predicted"] and r["doc_id"] is not None}
    assert toxic >= set(range(200, 260)) and len(toxic) < 66


def test_stages_against_plain_python(spark, folder):
    read = lambda df: [tuple(r) for r in df.collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = read(docs)

    kept = corpus_pipeline.toxicity_stage(spark, docs, folder)
    scores = brute_toxicity(corpus(), labels_of(corpus()))
    want = [r for r in rows if scores[r[0], r[1] or ""][0] < 0.5]
    assert kept.columns == docs.columns and Counter(read(kept)) == Counter(want)

    first = corpus_pipeline.exact_dedup_stage(spark, kept, folder)
    groups = defaultdict(list)
    for r in want:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r)
    ids = {k: min((r[0] for r in g if r[0] is not None), default=None) for k, g in groups.items()}
    got = read(first)
    assert Counter((re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or ""), r[0]) for r in got) == Counter(ids.items()) and set(got) <= set(want)

    near = read(corpus_pipeline.near_dedup_stage(spark, first, folder))
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
    sets = {r: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x := words(r[1])) >= 5 else {tuple(x)} - {()} for r in got}
    label = {r: r for r in got}
    named = [r for r in got if r[0] is not None]
    for _ in named:
        for a, b in itertools.combinations(named, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert Counter(near) == Counter(r for r in got if label[r] == r)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = defaultdict(set)
    for i, t, *_ in corpus():
        texts[i].add(t or "")
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for p in places.values():
        assert sum(n for _, n in p) <= 4096 and sorted(o for o, _ in p) == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1]
    for i, own in pieces.items():
        if i is not None:
            ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts[i]]
            assert any(sum(r["length"] for r in own) == len(x) and all(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own) for x in ids)
    assert not any(i is not None and 200 <= i < 260 for i in pieces) and 600 in pieces


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_after_sources_run_out(spark):
    rows = [(i, f"t{i}", s) for i, s in enumerate(["src0"] * 23 + ["src1"] * 90 + [None] * 11 + ["x"] * 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"src0": 3, "src1": 2}, 4, block_rows=4).collect()
    left = {"=src0": 6, "=src1": 23, "null": 3, "=x": 10}
    weight = {"=src0": 6, "=src1": 4, "null": 4, "=x": 4}
    want = []
    while live := [s for s, n in left.items() if n]:
        total, had, t = sum(weight[s] for s in live), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [(-(-(had[s] + 1) * total // weight[s]), s) for s in live if had[s] * total // weight[s] <= t]
            s = min(ready)[1]
            want.append(s)
            had[s] += 1
            left[s] -= 1
            t += 1
    placed = {r["slot"]: "null" if r["source"] is None else "=" + r["source"] for r in got}
    assert [placed[t] for t in range(len(placed))] == want
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    order = [r for r in sorted(got, key=lambda r: r["position"])]
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in order)


def test_shard_digest(spark):
    texts = [None, "", "é" * 5, *(f"text {i}" for i in range(97))]
    rows = sharding.shard_digest(spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, shard int"), shards=7).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(100))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_embeddings_that_share_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((30, 12))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(base)] + [(3, base[4].tolist(), "d"), (50, base[3].tolist(), None), (51, (base[4] + 0.01).tolist(), None)]
    got = defaultdict(list)
    for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert len(got[3]) == 2 and {c for i in (3, 4, 50, 51) for _, c, _ in got[i]} == {3}
    assert got[50][0][0] == 1 and got[51][0][0] == 2 and all(got[i] == [(0, i, True)] for i in range(5, 30))


def test_all_secret_spans(spark):
    rng = np.random.default_rng(4)
    parts = ["AKIA" + "A1B2C3D4E5F6G7", "AKIASHORT", "ASIA0123456789AB", "user=bob", "Login: ann@x.y", "password = hunter2hunter2", 'api_key: "abcDEF123456"', "deadbeefdeadbeef", "abc123", "k9" * 12, "https://h.example/p?q=1", "S3://b/c", "1x.y+z://host/abc", "the", "é", "\n", "token=short", "a" * 40]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(80)] + ["deadbeefdeadbeef," * 700, None]
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, "secret"), ("access", r"AKIA[A-Z0-9]+", 0, 18, "id"), ("hex", r"[0-9a-f]+", 0, 16, "secret")]
    weak = [("weak_id", r"(?:ASIA|AROA|AIDA)[A-Z0-9]+", 0, 16, "id"), ("weak_user", r"(?i:user(?:name)?|login|client_?id|account)\x20*[:=]\x20*[A-Za-z0-9@._-]+", 0, 6, "id")]
    weak += [("weak_secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}", 0, 20, "secret"), ("weak_endpoint", r"(?<![A-Za-z])(?i:[a-z][a-z0-9+.-]{0,30})://[A-Za-z0-9._~:@/?#%=&+-]+", 0, 10, "endpoint")]
    want = {}
    for i, t in enumerate(texts):
        found = [(m.start(), k, m.end(), name, role) for k, (name, p, g, least, role) in enumerate([*kinds, *weak]) for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
        beside = lambda x, found=found: any(y[4] != x[4] and y[0] <= x[2] + 200 and y[2] >= x[0] - 200 and (y[0] >= x[2] or y[2] <= x[0]) for y in found)
        want[i] = ",".join(f"{n}:{s}:{e}" for s, k, e, n, _ in sorted(x for x in found if x[1] < 3 or beside(x)))
    rows = secrets.secret_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["spans"] for r in rows} == want
    assert all(r[f"n_{k}"] == sum(x.startswith(k + ":") for x in r["spans"].split(",")) for r in rows for k in ("assign", "access", "hex"))


def test_secrets_in_one_long_run(spark):
    rows = secrets.secret_digest(spark.createDataFrame([(1, "x" * 1_000_000), (2, "a." * 500_000)], "doc_id long, text string")).collect()
    assert all(r["spans"] == "" for r in rows)


def test_near_duplicates_without_ids(spark):
    text = prose(1, 60)
    rows = [(1, text), (2, text + " end"), (None, text), (3, prose(2, 60)), (4, "W" * 40 + " " + "v" * 20), (5, "w" * 40 + " " + "V" * 20)]
    for more in ([], [(3, prose(5, 60))]):
        df = spark.createDataFrame([*rows, *more], "doc_id long, text string")
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3, 85, 100).collect()}
        assert got == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (5, 4, False)}


@pytest.mark.parametrize("most_kinds,sort_bytes", [(2048, 400_000), (2048, 2000), (4, 2000)])
def test_repeats_at_small_limits(spark, monkeypatch, most_kinds, sort_bytes):
    rng = np.random.default_rng(3)
    filler = lambda n: " ".join(f"{x:x}é" for x in rng.integers(0, 1 << 30, n))
    passage = filler(120)
    texts = [filler(rng.integers(0, 60)) + passage[: rng.integers(300, len(passage))] + filler(20) for _ in range(30)] + [filler(80) for _ in range(10)] + ["ab" * 600] * 2
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = {}
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        want[k] = bytes(x for x, g in zip(b, gone) if not g)
    plain = suffix_dedup.repeated_parts
    monkeypatch.setattr(suffix_dedup, "repeated_parts", lambda df, length, gram: plain(df, length, gram, sort_bytes))
    all_bytes = suffix_dedup.repeated_bytes
    monkeypatch.setattr(suffix_dedup, "repeated_bytes", lambda df, length, gram: all_bytes(df, length, gram, most_kinds))
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == want


@pytest.mark.parametrize("most_kinds", [2048, 4])
def test_short_passages_are_told(spark, monkeypatch, most_kinds):
    rng = np.random.default_rng(12)
    filler = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 8)))) for _ in range(n))
    passage, short = filler(62), filler(45)
    texts = [f"{filler(80)} {passage} {filler(80)}" for _ in range(12)] + [f"{filler(60)} {short} {filler(90)}" for _ in range(12)] + [filler(200) for _ in range(20)]
    assert len(passage) < 400
    all_bytes = suffix_dedup.repeated_bytes
    monkeypatch.setattr(suffix_dedup, "repeated_bytes", lambda df, length, gram: all_bytes(df, length, gram, most_kinds))
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(rows[k]["passage"] for k in range(12)) >= 10 and not any(rows[k]["passage"] for k in range(12, 44))
    assert not any(r["n_removed"] for r in rows.values())


def test_one_long_text_is_cut(spark, monkeypatch):
    rng = np.random.default_rng(8)
    body = "".join(map(chr, rng.integers(97, 123, 5000)))
    texts = [body, body[1200:2500], "".join(map(chr, rng.integers(97, 123, 900)))]
    whole = suffix_dedup.segment_table
    monkeypatch.setattr(suffix_dedup, "segment_table", lambda rows, length, gram: whole(rows, length, gram, 1000))
    rows = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: 1300, 1: 1300, 2: 0}
