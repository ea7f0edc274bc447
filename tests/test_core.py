"""Core operators against plain Python, and every catalogue query with SQL against DuckDB."""

import os

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom import catalog, run
from lexiloom.functions import compare_bytes, extended_hash, golomb_bits, golomb_values, lcp_bytes, leading_uint, leading_zeros, lower_byte, multiplied_hash, not_above, prefix_hash, same_byte, trailing_zeros, varint_bytes, varint_size, varint_value
from lexiloom.operators import duplicates, order, prefixes
from lexiloom.plans import scratch
from lexiloom.sources import generators, metrics, text

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [[], [b""], [b"aa"] * 5, [b"a", b"ab", b"abc", b"b", b"", b"ab"], ["Éa".encode(), "É".encode(), b"\xff\x00", b"E"], [b"x" * 8, b"x" * 24, b"x" * 25, b"x" * 8 + b"y" * 16, b"x" * 100]]


def frame(spark, strings):
    return spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(strings)], "id long, b binary")


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("strings", CASES)
def test_order_and_prefixes(spark, strings):
    df = frame(spark, strings)
    want = sorted((s, i) for i, s in enumerate(strings))
    for rows in (50_000, 2):
        got = sorted((r["rank"], r["id"]) for r in order.ranked(df, rows).collect())
        assert got == [(k + 1, i) for k, (_, i) in enumerate(want)]
    falling = sorted(sorted(want, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)
    assert [r["id"] for r in order.ranked(df, 2, descending=True).orderBy("rank").collect()] == [i for _, i in falling]
    lcps = [0] + [common(a, b) for (a, _), (b, _) in zip(want, want[1:])]
    assert [r["lcp"] for r in prefixes.lcp_array(df).orderBy("rank").collect()] == (lcps if want else [])
    for rows in (50_000, 2):
        near = order.with_common(df, rows).orderBy("rank").collect()
        assert [(r["lcp"], r["next_lcp"]) for r in near] == list(zip(lcps, [*lcps[1:], 0])) if want else not near
    dps = {r["id"]: r["dp"] for r in prefixes.distinguishing_prefix(df).collect()}
    assert dps == {i: max(lcps[k], (lcps + [0])[k + 1]) + 1 for k, (_, i) in enumerate(want)}
    depths = prefixes.depths(max(map(len, strings), default=0))
    first = {i: next(d if len(s) >= d else len(s) for d in depths if len(s) < d or sum(x[:d] == s[:d] and len(x) >= d for x in strings) == 1) for i, s in enumerate(strings)}
    assert {r["id"]: r["dp"] for r in prefixes.prefix_doubling(df).collect()} == first
    assert [r["id"] for r in prefixes.sort_by_prefixes(df).orderBy("rank").collect()] == [i for _, i in want]
    back = prefixes.front_decoded(prefixes.runs_for_decoding(df)).orderBy("rank").collect()
    assert [bytes(r["b"]) for r in back] == [s for s, _ in want]
    assert duplicates.complete_and_sorted(df, order.ranked(df).select("rank", "b")).first().asDict() == {"complete": True, "sorted": True}


def test_disorder_is_seen(spark):
    assert not order.is_sorted(frame(spark, [b"a", b"c", b"b"]), "id").first()["sorted"]
    assert duplicates.same_multiset(frame(spark, [b"a", b"a"]).select("b"), frame(spark, [b"a"]).select("b")).first().asDict() == {"lost": 1, "added": 0}


def test_buckets_of_equal_strings_are_even(spark):
    for descending in (False, True):
        sizes = order.bucketed(frame(spark, [b"same"] * 4000), 500, descending).groupBy("bucket").count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1200


def test_functions(spark):
    rows = spark.createDataFrame([(bytearray(b"abcd"), bytearray(b"abx")), (bytearray(b""), bytearray(b"a")), (None, bytearray(b"a"))], "a binary, b binary")
    assert [r[0] for r in rows.select(lcp_bytes(F.col("a"), F.col("b"))).collect()] == [2, 0, None]
    values = [1 << k for k in (0, 8, 16, 24, 32, 40, 48, 56)]
    assert spark.createDataFrame([(v,) for v in values], "v long").agg(F.sum(varint_size(F.col("v")))).first()[0] == 37


def test_comparisons(spark):
    texts = [b"", b"a", b"ab", b"ab\x00", b"abc", b"b", b"\xff", b"\x80\xff", b"abd" * 50, b"abd" * 50 + b"x"]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a in texts for b in texts], "a binary, b binary")
    a, b, two = F.col("a"), F.col("b"), F.lit(2)
    known = F.least(lcp_bytes(a, b), F.lit(1))
    for r in df.select("a", "b", compare_bytes(a, b).alias("d"), compare_bytes(a, b, known).alias("k"), not_above(a, b).alias("q"), same_byte(a, b, two).alias("s"), lower_byte(a, b, two).alias("l")).collect():
        x, y = bytes(r["a"]), bytes(r["b"])
        n = common(x, y)
        at = lambda t, i: t[i] if i < len(t) else 0
        assert r["d"] == r["k"] == at(x, n) - at(y, n)
        assert tuple(r["q"]) == (x <= y, n)
        assert r["s"] == (at(x, 2) == at(y, 2) != 0) and r["l"] == (at(x, 2) < at(y, 2))


def test_numbers_and_hashes(spark):
    raw = bytes(range(200, 217))
    b = F.lit(bytearray(raw))
    r = spark.range(1).select(*[leading_uint(b, n).alias(f"u{n}") for n in (1, 2, 7, 8)], leading_uint(b, 16).alias("u16"), multiplied_hash(F.lit(bytearray(b"ab\x00cd")), 9, 10**9 + 7).alias("m"), multiplied_hash(F.lit(bytearray(b"")), 9, 77).alias("e")).first()
    assert [int(r[f"u{n}"]) for n in (1, 2, 7, 8)] == [int.from_bytes(raw[:n], "big") for n in (1, 2, 7, 8)]
    assert (int(r["u16"]["high"]) << 64) + int(r["u16"]["low"]) == int.from_bytes(raw[:16], "big")
    h = 5381
    for c in b"ab":
        h = (h * 33 + c * 33) % 2**64
    assert r["m"] == h % (10**9 + 7) and r["e"] == 5381 % 77
    bits = spark.createDataFrame([(v,) for v in (0, 1, 2, 12, 2**62)], "v long").select("v", leading_zeros(F.col("v")).alias("l"), trailing_zeros(F.col("v")).alias("t")).collect()
    assert [(x["l"], x["t"]) for x in bits] == [(64, 64), (63, 0), (62, 1), (60, 2), (1, 62)]
    x, y = F.lit(bytearray(b"12345678abcd")), F.lit(bytearray(b"12345678abce"))
    long = lambda t: extended_hash(prefix_hash(t, 8), t, 8, 12)
    assert spark.range(1).select((long(x) == long(x)) & (long(x) != long(y))).first()[0]


def test_codes(spark):
    rng = random.Random(5)
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**62, *(rng.getrandbits(rng.randint(1, 62)) for _ in range(200))]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", varint_bytes(F.col("v")).alias("b"))
    for r in rows.select("v", "b", varint_value(F.col("b")).alias("back")).collect():
        out, v = bytearray(), r["v"]
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        assert bytes(r["b"]) == bytes([*out, v]) and r["back"] == r["v"]
    lists = [[], [5], [0, 0, 0], [7, 7, 9], *(sorted(rng.randrange(10 ** rng.randint(1, 9)) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    coded = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").select("x", golomb_bits(F.col("x")).alias("c"))
    assert all(r["x"] == r["back"] for r in coded.select("x", golomb_values(F.col("c")).alias("back")).collect())


def test_codes_of_wide_gaps_take_one_pass(spark):
    """While the bits were made anew for every byte, two lists of 128 took 5 s and two of 256 did not end in 20 s."""
    rng = random.Random(8)
    lists = [sorted(rng.randrange(2**55) for _ in range(n)) for n in (256, 257, 2)] + [[0, 2**62], list(range(256))]
    coded = spark.createDataFrame([(x,) for x in lists], "x array<bigint>").repartition(1).select("x", golomb_bits(F.col("x")).alias("c"))
    begin = time.monotonic()
    assert all(r["x"] == r["back"] for r in coded.select("x", golomb_values(F.col("c")).alias("back")).collect())
    assert time.monotonic() - begin < 15


def test_golomb_lists_of_many_orders(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"copy (select p::BIGINT AS l_partkey, (i * 7919 % 1000003 + i // 3)::BIGINT AS l_orderkey FROM range(3) t(p), range(1100) u(i)) to '{tmp_path}/lineitem.parquet'")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    begin = time.monotonic()
    got = catalog.queries()["golomb_round_trip"](spark, str(tmp_path)).select("p", "v", "size").collect()
    assert time.monotonic() - begin < 30
    assert sorted(r[:2] for r in got) == sorted(db.execute("SELECT DISTINCT l_partkey, l_orderkey FROM lineitem").fetchall())


def test_golomb_sizes_of_cut_lists(spark, tmp_path):
    """Pieces of a list had widths and bytes of their own: sizes differed from SQL beyond 1024 values."""
    db = duckdb.connect()
    db.execute(f"copy (select p::BIGINT AS l_partkey, (i * i // 7 * (p + 1))::BIGINT AS l_orderkey FROM range(4) t(p), range(3000) u(i) WHERE i < [1, 1024, 1025, 3000][p + 1]) to '{tmp_path}/lineitem.parquet'")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = catalog.queries()["golomb_round_trip"](spark, str(tmp_path)).select("p", "v", "size").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalog.oracle_sql()["golomb_round_trip"]).fetchall())


def test_golomb_codes_of_long_lists(spark):
    """While each value copied those before it, one of 25,000 took 4 s, one of 100,000 did not end in 50 s."""
    rng = random.Random(9)
    lists = [sorted(rng.randrange(2**40) for _ in range(n)) for n in (100_000, 3, 0, 1)] + [None, [-5, -5, 2**62]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>").repartition(1)
    begin = time.monotonic()
    for width in (None, F.lit(30)):
        coded = rows.filter("i > 0 AND i < 5" if width is not None else "true").select("x", golomb_bits(F.col("x"), width).alias("c")).select("x", "c", golomb_values(F.col("c")).alias("back"))
        for r in coded.collect():
            assert r["x"] == r["back"]
            assert r["x"] is None or len(r["c"]["bits"]) == -(-r["c"]["length"] // 8)
    assert time.monotonic() - begin < 60


def test_rows_that_share_ids(spark):
    df = spark.createDataFrame([(1, bytearray(b"same")), (1, bytearray(b"other")), (1, bytearray(b"same")), (2, bytearray(b"same"))], "id long, b binary")
    got = prefixes.fetched(prefixes.sort_by_prefixes(df), df).orderBy("rank").collect()
    assert [(r["rank"], bytes(r["b"])) for r in got] == [(1, b"other"), (2, b"same"), (3, b"same"), (4, b"same")]
    assert prefixes.statistics(df).first()["strings"] == 4


def test_cut_splitters_stay_in_order(spark):
    strings = [b"p" * 50 + bytes([97 + i % 5]) * (i % 7) for i in range(400)]
    df = frame(spark, strings)
    for descending in (False, True):
        cuts = order.splitters(df, 6, longest=51, oversampling=None, descending=descending)
        assert cuts == sorted(sorted(cuts, key=lambda c: c[1]), key=lambda c: c[0], reverse=descending) and all(len(b) <= 51 for b, _ in cuts)
        rows = sorted(((bytes(r["b"]), r["id"], r["bucket"]) for r in df.withColumn("bucket", order.bucket_of(cuts, descending)).collect()), key=lambda r: r[1])
        along = [r[2] for r in sorted(rows, key=lambda r: r[0], reverse=descending)]
        assert along == sorted(along) and max(along) == len(cuts)


def test_positions_of_splits(spark):
    df = frame(spark, [b"a"] * 3 + [b"b"] * 6 + [b"c"] * 2)
    assert {r["k"]: r["position"] for r in order.split_positions(df, [b"", b"a", b"b", b"c", b"d"]).collect()} == {0: 0, 1: 3, 2: 5, 3: 9, 4: 11}
    assert [order.sample_size(*x) for x in ((2, 0), (2, 10, 1), (16, 100_000, 1), (16, 100_000, 1, True), (1, 10, 8))] == [0, 17, 125, 189, 9]
    assert order.sample_length(7) == 2400 and order.sample_length(7, twice=False) == 1200


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch.scratch_path(Session(), "x")


def test_runs(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"beta\nalpha\n\nalpha\n")
    for generator, strings in (("lines", 4), ("suffixes", 14), ("random", 40), ("skewed", 40)):
        rows = {(r["phase"], r["type"]): r["value"] for r in run.run(spark, generator, 40, 12, 0.5, str(tmp_path), by_prefixes=generator == "lines", policy="chars", coding="payload", iterations=1, check=True, exhaustive=True).collect()}
        assert rows["statistics", "strings"] == strings and rows["check", "complete_and_sorted"] == rows["check", "exhaustive"] == 1


@pytest.mark.parametrize("n,length,ratio", [(1000, 100, 0.0), (1000, 100, 0.25), (1000, 250, 0.76), (1000, 100, 1.0)])
def test_ratio_strings(spark, n, length, ratio):
    df = generators.ratio_strings(spark, n, length, ratio)
    total = prefixes.distinguishing_prefix(df).agg(F.sum(F.least("dp", F.octet_length("b")))).first()[0]
    assert df.filter(F.octet_length("b") == length).count() == n
    assert abs(total / (n * length) - ratio) < (0.075 if ratio == 0 else 0.01)


def test_lines_and_suffixes(spark, tmp_path):
    (tmp_path / "lines.txt").write_bytes(b"one\n\nthree\r\nfour")
    rows = text.lines(spark, str(tmp_path / "lines.txt"))
    assert sorted(r["value"] for r in rows.collect()) == ["", "four", "one", "three\r"]
    got = text.suffixes(spark.createDataFrame([(1, "a\nb"), (2, "")], "id long, value string")).orderBy("pos").collect()
    assert [bytes(r["b"]) for r in got] == [b"ab", b"b"]
    numbered = spark.createDataFrame([(i, "x" * i) for i in range(6)], "n long, value string")
    assert sorted(r["n"] for r in text.first_bytes(numbered, 6, "n").collect()) == [0, 1, 2]
    assert [r["count"] for r in text.equal_parts(numbered, "n", 4).groupBy("part").count().orderBy("part").collect()] == [1, 1, 1, 3]


def test_suffixes_are_dealt_to_tasks(spark, monkeypatch):
    """One task wrote out the suffixes of all texts that came in one partition."""
    monkeypatch.setattr(text, "SUFFIX_BYTES", 100_000, raising=False)
    texts = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("ab"), 10).alias("value"))
    rows = text.suffixes(texts)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 400 * 20 and len(sizes) > 3 and max(sizes) < 4000
    assert rows.agg(F.countDistinct("id", "pos")).first()[0] == 400 * 20


def test_metric_text(spark, tmp_path):
    (tmp_path / "log").write_text("RESULT a=1 b=x\nnoise\nRESULT a=2\n")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows = metrics.columns_of(metrics.result_lines(spark, str(tmp_path / "log")), StructType([StructField("a", LongType()), StructField("b", StringType())]))
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, None)]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalogue_against_sql(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, got.select(*want.columns).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)
