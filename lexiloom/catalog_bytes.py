"""Queries of byte functions, hashes, codes, partitions and exchanged strings, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import byte_strings, codecs, hashes
from lexiloom.operators import duplicates, order, prefixes
from lexiloom.plans.scratch import materialise
from lexiloom.registry import DOCS, PARTS, SEGMENT, URLS, base, ladder_sql, lcp_sql, lcp_table, load, query, read_strings


def byte_sql(h: str, i: str) -> str:
    """SQL of the byte at a place of a hex string, 0 past its end."""
    return f"coalesce(('0x' || nullif(substr({h}, 2 * ({i}) + 1, 2), ''))::BIGINT, 0)"


PAIRS = "SELECT p_partkey::BIGINT AS id, hex(encode(p_name)) AS x, hex(encode(p_type)) AS y FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL"


@query(
    f"WITH p AS ({PAIRS}), l AS (SELECT *, {lcp_sql('x', 'y')}::BIGINT AS lcp FROM p) SELECT id, lcp, ({byte_sql('x', 'lcp')} - {byte_sql('y', 'lcp')})::INT AS differ, x <= y AS leq, "
    f"{byte_sql('x', '2')} = {byte_sql('y', '2')} AND {byte_sql('x', '2')} <> 0 AS same, {byte_sql('x', '2')} < {byte_sql('y', '2')} AS lower, {byte_sql('x', '2')} <= {byte_sql('y', '2')} AS not_higher FROM l"
)
def byte_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """FN2, FN3, FN5: names against types; bytes at depth 2"""
    a, b, at = F.col("p_name").cast("binary"), F.col("p_type").cast("binary"), F.lit(2)
    rows = load(spark, d, "part").filter("p_name is not null and p_type is not null")
    both = rows.select(F.col("p_partkey").cast("long").alias("id"), byte_strings.not_above(a, b).alias("c"), byte_strings.compare_bytes(a, b).alias("differ"), byte_strings.same_byte(a, b, at).alias("same"), byte_strings.lower_byte(a, b, at).alias("lower"), byte_strings.lower_byte(a, b, at, True).alias("not_higher"))
    return both.select("id", "c.lcp", "differ", "c.leq", "same", "lower", "not_higher")


def uint_sql(first: int, n: int, kind: str) -> str:
    return f"('0x' || rpad(substr(h, {2 * first + 1}, {2 * n}), {2 * n}, '0'))::{kind}"


@query(f"SELECT id, {uint_sql(0, 1, 'BIGINT')} AS u8, {uint_sql(0, 2, 'BIGINT')} AS u16, {uint_sql(0, 4, 'BIGINT')} AS u32, {uint_sql(0, 8, 'UBIGINT')}::VARCHAR AS u64, {uint_sql(8, 8, 'UBIGINT')}::VARCHAR AS u64_next FROM ({base(PARTS)})")
def leading_numbers(spark: SparkSession, d: str) -> DataFrame:
    """FN7: the first 1, 2, 4, 8 and 16 bytes, the last as two numbers"""
    b = F.col("b")
    rows = read_strings(spark, d, *PARTS).withColumn("u128", byte_strings.leading_uint(b, 16))
    few = [byte_strings.leading_uint(b, n).alias(f"u{8 * n}") for n in (1, 2, 4)]
    return rows.select("id", *few, F.col("u128.high").cast("string").alias("u64"), F.col("u128.low").cast("string").alias("u64_next"))


@query("SELECT o_orderkey::BIGINT AS k, (64 - CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END)::INT AS leading, (CASE WHEN o_orderkey = 0 THEN 64 ELSE length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '0')) END)::INT AS trailing FROM orders")
def zero_bits(spark: SparkSession, d: str) -> DataFrame:
    """FN8"""
    k = F.col("o_orderkey").cast("long")
    return load(spark, d, "orders").select(k.alias("k"), byte_strings.leading_zeros(k).cast("int").alias("leading"), byte_strings.trailing_zeros(k).cast("int").alias("trailing"))


@query(f"SELECT id, min(id) OVER (PARTITION BY substr(h, 1, 48)) AS by_prefix, min(id) OVER (PARTITION BY substr(h, 1, 48)) AS by_steps, min(id) OVER (PARTITION BY h) AS by_text FROM ({base(URLS)})")
def hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """FN9 to FN11: the first string with the same hash; values differ between engines, classes don't"""
    b, m = F.col("b"), 2**61 - 1
    steps = hashes.extended_hash(hashes.prefix_hash(b, 8), b, 8, 24, m)
    rows = read_strings(spark, d, *URLS).select("id", hashes.prefix_hash(b, 24, m).alias("p"), steps.alias("s"), hashes.keyed_hash(b, m, 11).alias("t"))
    for key, name in (("p", "by_prefix"), ("s", "by_steps"), ("t", "by_text")):
        rows = rows.join(rows.groupBy(key).agg(F.min("id").alias(name)), key)
    return rows.select("id", "by_prefix", "by_steps", "by_text")


@query(f"SELECT id, (list_reduce(list_prepend(5381::HUGEINT, list_transform(range(0, least(length(h) // 2, 16)), lambda i: {byte_sql('h', 'i')}::HUGEINT)), lambda a, c: (a * 33 + c * 33) % 18446744073709551616::HUGEINT) % 1000003)::BIGINT AS hash FROM ({base(PARTS)})")
def multiplied_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FN12: of 16 bytes, by 1,000,003"""
    return read_strings(spark, d, *PARTS).select("id", hashes.multiplied_hash(F.col("b"), 16, 1_000_003).alias("hash"))


GROUPS = "greatest(1, ceil(length(bin(v)) / 7.0))::BIGINT"


@query(f"WITH o AS (SELECT o_orderkey::BIGINT AS k, (o_orderkey * o_orderkey * o_custkey)::BIGINT AS v FROM orders) SELECT k, v, array_to_string(list_transform(range(0, {GROUPS}), lambda i: printf('%02X', (((v >> (7 * i)::BIGINT) & 127) + CASE WHEN i < {GROUPS} - 1 THEN 128 ELSE 0 END)::BIGINT)), '') AS code FROM o")
def varint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """FN16: numbers written as varints and read back"""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    rows = load(spark, d, "orders").select(k.alias("k"), codecs.varint_bytes(k * k * c).alias("code"))
    return rows.select("k", codecs.varint_value(F.col("code")).alias("v"), F.hex("code").alias("code"))


#: Values of a list that are coded together.
LIST = 1024


@query(
    "WITH v AS (SELECT DISTINCT l_partkey::BIGINT AS p, l_orderkey::BIGINT AS v FROM lineitem), g AS (SELECT p, v, v - lag(v) OVER (PARTITION BY p ORDER BY v) AS gap FROM v), "
    "w AS (SELECT p, CASE WHEN count(*) = 1 THEN 0 ELSE floor(log2(greatest((max(v) - min(v)) // (count(*) - 1), 1))) END::BIGINT AS width FROM v GROUP BY p), "
    "s AS (SELECT p, any_value(width) AS width, ceil(coalesce(sum(gap // (2 ** width)::BIGINT + 1 + width), 0) / 8)::BIGINT AS size FROM g JOIN w USING (p) GROUP BY p) SELECT p, v, size FROM v JOIN s USING (p)"
)
def golomb_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """FN15: the orders of each part as delta and Golomb codes, read back, and the bytes of the codes"""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("p"), F.col("l_orderkey").cast("long").alias("v"))
    part, ordered = Window.partitionBy("p"), Window.partitionBy("p").orderBy("v")
    before = F.lag("v").over(ordered)  # repeated rows go by the sort that the lists need anyway
    rows = rows.filter("v IS NOT NULL").withColumn("before", before).filter("before IS NULL OR before < v")
    # a long list is cut; a piece begins with the last value of the one before, and all have the width of the whole list
    cut = rows.select("p", "v", F.floor((F.row_number().over(ordered) - 1) / LIST).alias("block"), "before", F.count("v").over(part).alias("n"), F.min("v").over(part).alias("low"), F.max("v").over(part).alias("high"))
    width = F.length(F.bin(F.greatest(F.expr("(high - low) div greatest(n - 1, 1)"), F.lit(1)))) - 1
    lists = cut.withColumn("width", width).groupBy("p", "block", "width").agg(F.collect_list("v").alias("vs"), F.min("before").alias("before"))
    joined = F.sort_array(F.when(F.col("block") > 0, F.concat("vs", F.array("before"))).otherwise(F.col("vs")))
    coded = lists.select("p", "block", codecs.golomb_bits(joined, F.col("width")).alias("coded"))
    sized = coded.withColumn("size", F.ceil(F.sum("coded.length").over(part) / 8))
    read = sized.select("p", "size", "block", codecs.golomb_values(F.col("coded")).alias("vs"))
    return read.select("p", "size", F.explode(F.when(F.col("block") > 0, F.slice("vs", 2, LIST)).otherwise(F.col("vs"))).alias("v"))


@query(f"SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY substr(h, 1, 48)) AS c FROM ({base(DOCS)}) WHERE length(h) >= 48) WHERE c > 1")
def hash_exchange_golomb(spark: SparkSession, d: str) -> DataFrame:
    """EXC11, EXC12: the hashes that occur again are sent as Golomb codes, by ranges of hashes, and looked up"""
    top = 2**55
    rows = duplicates.prefix_hashes(read_strings(spark, d, *DOCS), 24, top)
    again = materialise(rows.groupBy("p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("p"), "golomb-hashes")
    ranges = max(1, again.count() // 256)  # of even hashes: a list has about 256
    lists = again.groupBy(F.floor(F.col("p") / (top // ranges)).alias("part")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    sent = lists.select("part", codecs.golomb_bits(F.col("ps")).alias("coded"))
    return rows.join(sent.select(F.explode(codecs.golomb_values(F.col("coded"))).alias("p")), "p", "left_semi").select("id")


@query(f"WITH l AS ({ladder_sql(URLS, 2000)}) SELECT id, substr(h, 1, 2 * dp) AS prefix FROM l JOIN ({base(URLS)}) USING (id)")
def dist_prefix_exchange(spark: SparkSession, d: str) -> DataFrame:
    """EXC8: what is moved of each string, with its id"""
    return prefixes.short_strings(read_strings(spark, d, *URLS)).select("id", F.hex("b").alias("prefix"))


@query(f"WITH {lcp_table(URLS)} SELECT rank, lcp, substr(h, 2 * lcp + 1, 2 * (greatest(lcp, nxt) + 1 - lcp)) AS part FROM t")
def prefix_doubling_payload(spark: SparkSession, d: str) -> DataFrame:
    """PRJ4: the bytes from lcp to distinguishing prefix"""
    return prefixes.payload(read_strings(spark, d, *URLS)).select("rank", "lcp", F.hex("part").alias("part"))


@query(f"WITH {lcp_table(PARTS)} SELECT rank, substr(h, 1, 2 * lcp) AS known, h FROM t")
def lcp_exchange(spark: SparkSession, d: str) -> DataFrame:
    """EXC3, EXC4, EXC9: whole strings with their lcps as varints, read back: the known part and the string"""
    rows = prefixes.lcp_array(read_strings(spark, d, *PARTS)).withColumn("code", codecs.varint_bytes(F.col("lcp")))
    sent = rows.select("bucket", "rank", "b", "code").repartition("bucket")
    return sent.select("rank", F.hex(byte_strings.prefix_bytes(F.col("b"), codecs.varint_value(F.col("code")).cast("int"))).alias("known"), F.hex("b").alias("h"))


@query(f"WITH s AS (SELECT id, decode(b) AS s, row_number() OVER (ORDER BY h, id) AS rank, count(*) OVER () AS n FROM ({base(PARTS)})) SELECT id, s, rank FROM s WHERE rank > (n - 9) // 2 AND rank <= (n - 9) // 2 + 9")
def middle_strings(spark: SparkSession, d: str) -> DataFrame:
    """PRJ7: the nine in the middle"""
    return order.middle(read_strings(spark, d, *PARTS), 9).select("id", F.decode("b", "UTF-8").alias("s"), "rank")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER"]


@query(
    f"WITH s AS ({base(SEGMENT)}), k AS (SELECT unnest(range(0, {len(SEGMENTS)}))::INT AS k, unnest({SEGMENTS}) AS v), c AS (SELECT k, (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s WHERE h < hex(encode(v))) AS below, (SELECT count(*) FROM s WHERE h <= hex(encode(v))) AS upto FROM k) "
    "SELECT k, n AS rows, below, upto, (CASE WHEN below < n // 2 THEN least(n // 2, upto) ELSE below END)::BIGINT AS position FROM c"
)
def split_positions(spark: SparkSession, d: str) -> DataFrame:
    """SEL2: where each segment's name would split the customers"""
    return order.split_positions(read_strings(spark, d, *SEGMENT), [s.encode() for s in SEGMENTS])


@query("WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT unnest([2, 4, 16, 160, 1280])::BIGINT AS parts), c AS (SELECT parts, n, floor(16 * log2(parts))::BIGINT AS a, (n // parts // 50)::BIGINT AS b FROM n, p), m AS (SELECT parts, greatest(a, b, 8) AS one, greatest(a + b, 8) AS added FROM c) SELECT parts, one + 1 - one % 2 AS rows, added + 1 - added % 2 AS rows_together FROM m")
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """SEL3: how many of the orders each of so many tasks samples"""
    n = load(spark, d, "orders").count()
    return spark.createDataFrame([(p, order.sample_size(p, n, 8), order.sample_size(p, n, 8, True)) for p in (2, 4, 16, 160, 1280)], "parts long, rows long, rows_together long")


PARTITIONS = [("strings", True), ("strings", False), ("chars", True), ("chars", False), ("prefixes", True), ("prefixes", False)]
WEIGHTS = {"strings": "1", "chars": "length(h) // 2", "prefixes": "dp"}


def partition_sql(policy: str, indexed: bool, parts: int, longest: str) -> str:
    """SQL of the sizes of parts between exact splitters, which are cut to `longest` bytes."""
    above = "c.h < d.h OR (c.h = d.h AND c.id <= d.id)" if indexed else "c.h <= d.h"
    return f"""SELECT policy, indexed, bucket, count(*) AS strings, sum(length(h) // 2)::BIGINT AS bytes FROM (
 SELECT '{policy}' AS policy, {str(indexed).lower()} AS indexed, d.h, (SELECT count(*) FROM (
  SELECT substr(h, 1, 2 * ({longest})) AS h, id FROM (
   SELECT h, id, part, lag(part) OVER (ORDER BY h, id) AS before FROM (
    SELECT h, id, (sum({WEIGHTS[policy]}) OVER (ORDER BY h, id ROWS UNBOUNDED PRECEDING) - {WEIGHTS[policy]}) * {parts} // sum({WEIGHTS[policy]}) OVER () AS part FROM d)) WHERE before < part) c WHERE {above}) AS bucket FROM d) GROUP BY ALL"""


@query(f"WITH {lcp_table(SEGMENT)}, d AS (SELECT id, h, greatest(lcp, nxt) + 1 AS dp, lcp FROM t) " + " UNION ALL ".join(f"({partition_sql(p, i, 8, '(2 * 100 * ((SELECT sum(lcp) // count(*) FROM d) + 5))::BIGINT')})" for p, i in PARTITIONS))
def partition_policies(spark: SparkSession, d: str) -> DataFrame:
    """PAR1 to PAR9, JN3 to JN5: parts by strings, bytes and distinguishing prefixes, ties dealt by id or kept together"""
    rows = prefixes.distinguishing_prefix(read_strings(spark, d, *SEGMENT))
    longest = order.sample_length(rows.agg(F.floor(F.sum("lcp") / F.count(F.lit(1))).cast("long")).first()[0])
    out = None
    for policy, indexed in PARTITIONS:
        parts = order.partitioned(rows, 8, policy, indexed, longest, oversampling=None).groupBy(F.col("bucket").cast("long").alias("bucket"))
        sizes = parts.agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("b").cast("long")).alias("bytes")).withColumns({"policy": F.lit(policy), "indexed": F.lit(indexed)})
        out = sizes if out is None else out.unionByName(sizes)
    return out


@query(f"WITH {lcp_table(PARTS)}, d AS (SELECT id, h, greatest(lcp, nxt) + 1 AS dp FROM t) {partition_sql('strings', True, 8, '3')}")
def partition_by_short_splitters(spark: SparkSession, d: str) -> DataFrame:
    """PAR2, PAR9: splitters cut to three bytes"""
    parts = order.partitioned(read_strings(spark, d, *PARTS), 8, longest=3, oversampling=None).groupBy(F.col("bucket").cast("long").alias("bucket"))
    return parts.agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("b").cast("long")).alias("bytes")).withColumns({"policy": F.lit("strings"), "indexed": F.lit(True)})


@query(f"SELECT (SELECT count(*) FROM (SELECT 1 FROM ({base(DOCS)}) GROUP BY b HAVING count(*) > 1)) > 0 AS repeated")
def any_repeated(spark: SparkSession, d: str) -> DataFrame:
    """AGG10"""
    return duplicates.any_repeated(read_strings(spark, d, *DOCS))


@query("SELECT o_orderkey::BIGINT AS k, least(o_totalprice, 1000) AS low, greatest(o_totalprice, 1000) AS high, abs(round(o_totalprice - 150000, 2)) AS away, round(log2(o_orderkey + 1), 9) AS bits, round(pow(o_custkey, 2), 3) AS squared, printf('%d-%s', o_orderkey, o_orderstatus) AS label FROM orders")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN19"""
    price, k = F.col("o_totalprice"), F.col("o_orderkey").cast("long")
    return load(spark, d, "orders").select(k.alias("k"), F.least(price, F.lit(1000.0)).alias("low"), F.greatest(price, F.lit(1000.0)).alias("high"), F.abs(F.round(price - 150000, 2)).alias("away"), F.round(F.log2(k + 1), 9).alias("bits"), F.round(F.pow("o_custkey", F.lit(2.0)), 3).alias("squared"), F.format_string("%d-%s", k, "o_orderstatus").alias("label"))


@query("SELECT p_partkey::BIGINT AS k, substr(p_name, 1, length(p_name) - 1) AS cut, p_brand || ' ' || p_type AS pasted, starts_with(p_brand, 'Brand#1') AS begins, substr(p_brand, 7)::BIGINT AS number, dense_rank() OVER (ORDER BY p_type)::BIGINT AS level FROM part")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN20, FN21: all but the last character, pasted strings, a prefix test, text as a number, text as a level"""
    rows = load(spark, d, "part")
    levels = F.array_sort(F.collect_set("p_type"))  # few types
    both = rows.join(F.broadcast(rows.agg(levels.alias("levels"))))
    return both.select(F.col("p_partkey").cast("long").alias("k"), F.expr("substr(p_name, 1, length(p_name) - 1)").alias("cut"), F.concat_ws(" ", "p_brand", "p_type").alias("pasted"), F.col("p_brand").startswith("Brand#1").alias("begins"), F.expr("substr(p_brand, 7)").cast("long").alias("number"), F.array_position("levels", F.col("p_type")).cast("long").alias("level"))
