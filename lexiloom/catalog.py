"""All registered queries with the SQL that they equal. IDs of the blueprint's inventory stand beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import catalog_bytes, catalog_files, registry
from lexiloom.catalog_files import MEANS, METRICS, means, metric_rows
from lexiloom.functions import byte_length, leading_uint, suffix_bytes, varint_size
from lexiloom.functions.byte_strings import golomb_parameter, next_power_of_two
from lexiloom.operators import duplicates, order, prefixes
from lexiloom.registry import DOCS, PARTS, PRIORITY, SEGMENT, URLS, Query, base, ladder_sql, lcp_table, load, query, rank_sql, read_strings
from lexiloom.sources import generators, metrics, text

MORE = (catalog_bytes, catalog_files)  # they register theirs as they are loaded

@query(rank_sql(DOCS))
def sort_rank_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRT1, WIN5"""
    return order.ranked(read_strings(spark, d, *DOCS)).select("id", "rank")


@query(rank_sql(URLS, "DESC"))
def sort_rank_desc_urls(spark: SparkSession, d: str) -> DataFrame:
    """SRT13, SRT14"""
    return order.ranked(read_strings(spark, d, *URLS), descending=True).select("id", "rank")


@query(rank_sql(PRIORITY))
def sort_indexed_ties(spark: SparkSession, d: str) -> DataFrame:
    """SRT7, SRT8, SRT15"""
    return order.ranked(read_strings(spark, d, *PRIORITY)).select("id", "rank")


@query(f"SELECT id, decode(b) AS s FROM ({base(PARTS)}) ORDER BY h, id LIMIT 25")
def topk_strings(spark: SparkSession, d: str) -> DataFrame:
    """SRT1 with a limit: the 25 first names"""
    return read_strings(spark, d, *PARTS).orderBy("b", "id").limit(25).select("id", F.decode("b", "UTF-8").alias("s"))


@query(f"SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS rank FROM ({base(PARTS)})) WHERE rank BETWEEN 101 AND 200")
def rank_range(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1: a stretch of the sorted order"""
    return order.ranked(read_strings(spark, d, *PARTS)).filter(F.col("rank").between(101, 200)).select("id", "rank")


@query(f"WITH s AS (SELECT id, decode(b) AS s, row_number() OVER (ORDER BY h, id) AS rank, count(*) OVER () AS n FROM ({base(PARTS)})) SELECT id, s, rank FROM s WHERE rank = (n + 1) // 2")
def median_string(spark: SparkSession, d: str) -> DataFrame:
    """SEL1"""
    return order.median(read_strings(spark, d, *PARTS)).select("id", F.decode("b", "UTF-8").alias("s"), "rank")


@query(f"WITH {lcp_table(URLS)} SELECT id, rank, lcp FROM t")
def lcp_array_urls(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, WIN3, WIN4, FN4"""
    return prefixes.lcp_array(read_strings(spark, d, *URLS)).select("id", "rank", "lcp")


@query(f"WITH {lcp_table(PARTS)} SELECT id, rank, lcp FROM t")
def lcp_array_part_names(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, FN4"""
    return prefixes.lcp_array(read_strings(spark, d, *PARTS)).select("id", "rank", "lcp")


@query(f"WITH {lcp_table(PARTS)} SELECT (sum(lcp) // count(*))::BIGINT AS avg_lcp FROM t")
def avg_lcp(spark: SparkSession, d: str) -> DataFrame:
    """AGG3"""
    return prefixes.lcp_array(read_strings(spark, d, *PARTS)).agg(F.floor(F.sum("lcp") / F.count(F.lit(1))).cast("long").alias("avg_lcp"))


@query(f"WITH {lcp_table(URLS)} SELECT id, rank, greatest(lcp, nxt) + 1 AS dp FROM t")
def dist_prefix_exact_urls(spark: SparkSession, d: str) -> DataFrame:
    """WIN2"""
    return prefixes.distinguishing_prefix(read_strings(spark, d, *URLS)).select("id", "rank", "dp")


@query(f"WITH {lcp_table(PARTS)} SELECT id, rank, greatest(lcp, nxt) + 1 AS dp FROM t")
def dist_prefix_exact_part_names(spark: SparkSession, d: str) -> DataFrame:
    """WIN2"""
    return prefixes.distinguishing_prefix(read_strings(spark, d, *PARTS)).select("id", "rank", "dp")


@query(ladder_sql(URLS, 2000))
def dist_prefix_approx_urls(spark: SparkSession, d: str) -> DataFrame:
    """FLT1 to FLT3"""
    return prefixes.prefix_doubling(read_strings(spark, d, *URLS))


@query(ladder_sql(DOCS, 1_000_000))
def dist_prefix_approx_documents(spark: SparkSession, d: str) -> DataFrame:
    """FLT1 over long texts"""
    return prefixes.prefix_doubling(read_strings(spark, d, *DOCS))


@query(f"WITH {lcp_table(PARTS)} SELECT count(*) AS strings, sum(length(h) // 2)::BIGINT AS bytes, sum(lcp)::BIGINT AS sum_lcp, sum(greatest(lcp, nxt) + 1)::BIGINT AS sum_dp, (sum(lcp) // count(*))::BIGINT AS avg_lcp, round(sum(greatest(lcp, nxt) + 1) / sum(length(h) // 2), 6) AS dp_ratio FROM t")
def dn_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, AGG4 to AGG6"""
    return prefixes.statistics(read_strings(spark, d, *PARTS))


@query(f"SELECT row_number() OVER (ORDER BY h, id) AS rank, id FROM ({base(PARTS)})")
def permutation_sort(spark: SparkSession, d: str) -> DataFrame:
    """SRT2"""
    return prefixes.sort_by_prefixes(read_strings(spark, d, *PARTS)).select("rank", "id")


@query(f"SELECT row_number() OVER (ORDER BY h, id) AS rank, id, decode(b) AS s FROM ({base(PARTS)})")
def permutation_fetch(spark: SparkSession, d: str) -> DataFrame:
    """JN1, JN2: the strings in the order of the permutation"""
    rows = read_strings(spark, d, *PARTS)
    return prefixes.fetched(prefixes.sort_by_prefixes(rows), rows).select("rank", "id", F.decode("b", "UTF-8").alias("s"))


@query(f"WITH {lcp_table(URLS)} SELECT rank, lcp, substr(h, 2 * lcp + 1) AS rest FROM t")
def front_coded_suffix(spark: SparkSession, d: str) -> DataFrame:
    """PRJ3, EXC5, EXC6"""
    return prefixes.front_coded(read_strings(spark, d, *URLS)).select("rank", "lcp", F.hex("rest").alias("rest"))


@query(f"WITH {lcp_table(URLS)} SELECT sum(length(h) // 2 + 1)::BIGINT AS plain, sum(length(h) // 2 + 1 - lcp)::BIGINT AS coded FROM t")
def front_coding_bytes(spark: SparkSession, d: str) -> DataFrame:
    """EXC3 to EXC5: bytes to move with their ends, plain and front coded"""
    rows = prefixes.lcp_array(read_strings(spark, d, *URLS))
    n = byte_length(F.col("b")) + 1
    return rows.agg(F.sum(n).alias("plain"), F.sum(n - F.col("lcp")).alias("coded"))


@query(f"SELECT row_number() OVER (ORDER BY h, id) AS rank, h FROM ({base(URLS)})")
def front_coding_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5: strings rebuilt from front-coded runs"""
    return prefixes.front_decoded(prefixes.runs_for_decoding(read_strings(spark, d, *URLS))).select("rank", F.hex("b").alias("h"))


@query(f"WITH {lcp_table(URLS)} SELECT count(*) + sum(greatest(lcp, nxt) + 1 - lcp)::BIGINT AS bytes FROM t")
def prefix_doubling_bytes(spark: SparkSession, d: str) -> DataFrame:
    """AGG5: n + D - L"""
    return prefixes.distinguishing_prefix(read_strings(spark, d, *URLS)).agg((F.count(F.lit(1)) + F.sum(F.col("dp") - F.col("lcp"))).cast("long").alias("bytes"))


@query(f"WITH {lcp_table(PARTS)} SELECT id, lcp, (CASE WHEN lcp < 128 THEN 1 WHEN lcp < 16384 THEN 2 ELSE 3 END)::BIGINT AS size FROM t")
def varint_lcp_size(spark: SparkSession, d: str) -> DataFrame:
    """EXC9: sizes of the lcps as varints"""
    return prefixes.lcp_array(read_strings(spark, d, *PARTS)).select("id", "lcp", varint_size(F.col("lcp")).alias("size"))


@query("WITH k AS (SELECT l_partkey::BIGINT AS p, count(*) AS n, max(l_orderkey) AS m FROM lineitem GROUP BY 1) SELECT p, (2 ** floor(log2(greatest(m // n, 1))))::BIGINT AS b, (2 ** ceil(log2(n)))::BIGINT AS up FROM k")
def golomb_b(spark: SparkSession, d: str) -> DataFrame:
    """FN13, FN14"""
    k = load(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("m"))
    return k.select("p", golomb_parameter(F.col("m"), F.col("n")).alias("b"), next_power_of_two(F.col("n")).alias("up"))


@query("SELECT l_partkey::BIGINT AS p, l_orderkey::BIGINT AS v, (l_orderkey - coalesce(lag(l_orderkey) OVER w, 0))::BIGINT AS gap FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey)")
def delta_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The gaps that FN15 codes: of sorted lists, the first value as it is"""
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("p"), F.col("l_orderkey").cast("long").alias("v")).distinct()
    return rows.withColumn("gap", F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("p").orderBy("v")), F.lit(0)))


@query(f"SELECT md5(b) AS digest, count(*) AS copies, min(id) AS first_id FROM ({base(DOCS)}) GROUP BY b HAVING count(*) > 1")
def duplicates_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG7, AGG8"""
    return duplicates.groups(read_strings(spark, d, *DOCS)).select(F.md5("b").alias("digest"), "copies", "first_id")


@query(f'WITH r AS (SELECT decode(b) AS s, row_number() OVER (ORDER BY h, id) AS rank FROM ({base(SEGMENT)})) SELECT s, min(rank) AS "begin", max(rank) AS "end" FROM r GROUP BY s HAVING count(*) > 1')
def duplicate_ranges(spark: SparkSession, d: str) -> DataFrame:
    """AGG9"""
    return duplicates.ranges(read_strings(spark, d, *SEGMENT)).select(F.decode("b", "UTF-8").alias("s"), "begin", "end")


@query(f"SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY substr(h, 1, 48)) AS c FROM ({base(DOCS)}) WHERE length(h) >= 48) WHERE c > 1")
def duplicate_prefix_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FLT1 at depth 24"""
    return duplicates.prefix_candidates(read_strings(spark, d, *DOCS), 24)


@query(f"WITH w AS (SELECT id, min(id) OVER g AS one, max(id) OVER g AS other FROM ({base(DOCS)}) WHERE length(h) >= 48 WINDOW g AS (PARTITION BY substr(h, 1, 48))) SELECT id, CASE WHEN id = one THEN other ELSE one END AS witness FROM w WHERE one <> other")
def duplicate_witness(spark: SparkSession, d: str) -> DataFrame:
    """CHK5"""
    return duplicates.witnesses(read_strings(spark, d, *DOCS), 24)


RANKED = f"WITH r AS (SELECT id, h, row_number() OVER (ORDER BY h, id) AS rank FROM ({base(PARTS)}))"


def rising(order_by: str, of: str = "r") -> str:
    """SQL of whether h never falls along an order."""
    return f"(SELECT coalesce(bool_and(ok), true) FROM (SELECT coalesce(lag(h) OVER (ORDER BY {order_by}) <= h, true) AS ok FROM {of}))"


def named(name: str, df: DataFrame) -> DataFrame:
    return df.withColumn("input", F.lit(name))


@query(f"{RANKED} SELECT 'ranked' AS input, {rising('rank')} AS sorted UNION ALL SELECT 'backwards', {rising('-rank')} UNION ALL SELECT 'equal', {rising('rank', '(SELECT 1 AS h, rank FROM r)')} UNION ALL SELECT 'one moved', {rising('rank', '(SELECT h, CASE WHEN rank = 7 THEN 99 ELSE rank END AS rank FROM r WHERE rank <> 99)')}")
def check_sorted(spark: SparkSession, d: str) -> DataFrame:
    """WIN10, CHK1, AGG2: of the ranked names, and of three other orders"""
    r = order.ranked(read_strings(spark, d, *PARTS)).select("rank", "b")
    moved = r.filter("rank != 99").withColumn("rank", F.when(F.col("rank") == 7, 99).otherwise(F.col("rank")))
    cases = {"ranked": r, "backwards": r.withColumn("rank", -F.col("rank")), "equal": r.withColumn("b", F.lit(b"x")), "one moved": moved}
    out = [named(k, order.is_sorted(x)) for k, x in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"SELECT coalesce(bool_and(ok), true) AS sorted FROM (SELECT coalesce(lag(h) OVER (ORDER BY id) <= h, true) AS ok FROM ({base(PARTS)}))")
def check_input_order(spark: SparkSession, d: str) -> DataFrame:
    """CHK1 on a table that isn't sorted"""
    return order.is_sorted(read_strings(spark, d, *PARTS), "id")


CHANGED = "(SELECT rank, CASE WHEN rank = 5 THEN h || '7A' ELSE h END AS h FROM r)"


def counted(of: str) -> str:
    """SQL of whether a table has as many strings and bytes as r."""
    return f"((SELECT count(*) FROM {of}) = (SELECT count(*) FROM r) AND (SELECT sum(length(h)) FROM {of}) = (SELECT sum(length(h)) FROM r))"


def damaged(rows: DataFrame) -> dict[str, DataFrame]:
    """(rank, b) as it should be, without a row, with a string changed, and backwards."""
    longer = F.when(F.col("rank") == 5, F.concat(F.col("b"), F.lit(b"z"))).otherwise(F.col("b"))
    return {"ranked": rows, "one lost": rows.filter("rank != 3"), "one changed": rows.withColumn("b", longer), "backwards": rows.withColumn("rank", -F.col("rank"))}


LOST = "(SELECT * FROM r WHERE rank <> 3)"


@query(f"{RANKED} SELECT 'ranked' AS input, {counted('r')} AS complete, {rising('rank')} AS sorted UNION ALL SELECT 'one lost', {counted(LOST)}, {rising('rank', LOST)} UNION ALL SELECT 'one changed', {counted(CHANGED)}, {rising('rank', CHANGED)} UNION ALL SELECT 'backwards', {counted('r')}, {rising('-rank')}")
def complete_and_sorted(spark: SparkSession, d: str) -> DataFrame:
    """CHK2, S14: of the ranked names, and of three damaged results"""
    rows = read_strings(spark, d, *PARTS)
    out = [named(k, duplicates.complete_and_sorted(rows, x)) for k, x in damaged(order.ranked(rows).select("rank", "b")).items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def differing(of: str) -> str:
    return f"(SELECT count(*) FROM (SELECT h FROM r EXCEPT ALL SELECT h FROM {of})) AS lost, (SELECT count(*) FROM (SELECT h FROM {of} EXCEPT ALL SELECT h FROM r)) AS added"


@query(f"{RANKED} SELECT 'ranked' AS input, {differing('r')} UNION ALL SELECT 'one lost', {differing(LOST)} UNION ALL SELECT 'one changed', {differing(CHANGED)} UNION ALL SELECT 'backwards', {differing('r')}")
def check_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """CHK3, CHK4: whether the strings are the input's, as multisets, of the same four results"""
    rows = read_strings(spark, d, *PARTS)
    out = [named(k, duplicates.same_multiset(rows.select("b"), x.select("b"))) for k, x in damaged(order.ranked(rows).select("rank", "b")).items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"WITH r AS (SELECT length(h) // 2 AS w, row_number() OVER (ORDER BY h, id) AS rank, count(*) OVER () AS n FROM ({base(DOCS)})) SELECT ((rank - 1) * 8 // n)::BIGINT AS bucket, count(*) AS strings, sum(w)::BIGINT AS bytes FROM r GROUP BY 1")
def range_buckets_by_strings(spark: SparkSession, d: str) -> DataFrame:
    """Exact parts by rank, SRT13"""
    rows = order.balanced_buckets(read_strings(spark, d, *DOCS), 8)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("strings"), F.sum(byte_length(F.col("b"))).alias("bytes"))


@query(f"WITH r AS (SELECT length(h) // 2 AS w, sum(length(h) // 2) OVER (ORDER BY h, id ROWS UNBOUNDED PRECEDING) - length(h) // 2 AS run, sum(length(h) // 2) OVER () AS total FROM ({base(DOCS)})) SELECT (run * 8 // total)::BIGINT AS bucket, count(*) AS strings, sum(w)::BIGINT AS bytes FROM r GROUP BY 1")
def range_buckets_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """Exact parts by running bytes"""
    rows = order.weighted_buckets(read_strings(spark, d, *DOCS), 8)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("strings"), F.sum("w").alias("bytes"))


@query(f"SELECT id, length(h) // 2 AS n, ('0x' || rpad(substr(h, 1, 8), 8, '0'))::BIGINT AS head, substr(h, 9) AS rest FROM ({base(PARTS)})")
def byte_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN1, FN6"""
    b = F.col("b")
    return read_strings(spark, d, *PARTS).select("id", byte_length(b).alias("n"), leading_uint(b, 4).alias("head"), F.hex(suffix_bytes(b, F.lit(4))).alias("rest"))


DIGITS = "chr(65 + (i // 676 % 26)::INT) || chr(65 + (i // 26 % 26)::INT) || chr(65 + (i % 26)::INT)"


@query(f"SELECT i AS id, rpad('AAAAAAA' || {DIGITS}, 40, 'Q') AS s FROM range(10000) t(i)")
def dn_generator(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: 10000 strings of 40 letters, a quarter of them distinguishing"""
    return generators.ratio_strings(spark, 10_000, 40, 0.25, "Q").select("id", F.decode("b", "UTF-8").alias("s"))


@query(f"SELECT i AS id, rpad('AAAAAAA' || {DIGITS}, CASE WHEN i < 2000 THEN 160 ELSE 40 END, 'Q') AS s FROM range(10000) t(i)")
def skewed_dn_generator(spark: SparkSession, d: str) -> DataFrame:
    """SRC11"""
    return generators.ratio_strings(spark, 10_000, 40, 0.25, "Q", skewed=True).select("id", F.decode("b", "UTF-8").alias("s"))


@query("SELECT i AS id, 'a' || reverse(i::VARCHAR) AS s FROM range(1, 10001) t(i)")
def prefix_number(spark: SparkSession, d: str) -> DataFrame:
    """SRC14"""
    return generators.prefixed_numbers(spark, 10_000).select("id", F.decode("b", "UTF-8").alias("s"))


def drawn_sql(seed: int, what: str, start: str = "1", digits: int = 13) -> str:
    return f"('0x' || substr(md5('{seed}:' || i || ':' || {what}), {start}, {digits}))::BIGINT"


def random_sql(n: int, shortest: int, longest: int, letters: int, seed: int, first: int = 0) -> str:
    """SQL of random strings: id and s."""
    size = f"{shortest} + {drawn_sql(seed, repr('n'))} % {longest - shortest + 1}"
    letter = f"chr((65 + {drawn_sql(seed, 'k // 8', '(4 * (k % 8) + 1)::BIGINT', 4)} % {letters})::INT)"
    return f"SELECT i + {first} AS id, array_to_string(list_transform(range(0, {size}), lambda k: {letter}), '') AS s FROM range({n}) t(i)"


@query(random_sql(2000, 10, 20, 26, 0))
def random_strings(spark: SparkSession, d: str) -> DataFrame:
    """SRC13"""
    return generators.random_strings(spark, 2000).select("id", F.decode("b", "UTF-8").alias("s"))


@query(f"{random_sql(500, 200, 300, 6, 0)} UNION ALL {random_sql(1500, 100, 200, 26, 7, 500)}")
def skewed_random_strings(spark: SparkSession, d: str) -> DataFrame:
    """SRC12"""
    return generators.skewed_random_strings(spark, 2000).select("id", F.decode("b", "UTF-8").alias("s"))


@query(f"WITH u AS (SELECT i, {drawn_sql(0, repr('u'))} / 4503599627370496.0::DOUBLE AS u FROM range(10000) t(i)) SELECT i AS id, ((u >= 1 / 8.0::DOUBLE)::INT + (u >= 3 / 8.0::DOUBLE)::INT)::BIGINT AS drawn FROM u")
def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: positions 0, 1 and 2 with weights 1, 2 and 5"""
    return generators.weighted_draws(spark, 10_000, [1.0, 2.0, 5.0])


@query("WITH s AS (SELECT p_partkey::BIGINT AS k, pos::BIGINT AS pos, substr(p_name, pos::BIGINT) AS s FROM part, range(1, 100) t(pos) WHERE pos <= length(p_name)) SELECT k, pos, s, row_number() OVER (ORDER BY hex(encode(s)), k, pos) AS rank FROM s")
def suffix_sort(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: all suffixes of the part names in order"""
    names = load(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name")
    rows = text.suffixes(names, "p_name", "k").withColumn("id", F.col("k") * 1000 + F.col("pos"))
    return order.ranked(rows).select("k", "pos", F.decode("b", "UTF-8").alias("s"), "rank")


@query("SELECT o_orderkey::BIGINT AS k, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def union_all_keys(spark: SparkSession, d: str) -> DataFrame:
    """SET1, SET2, SET4"""
    keys = load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderpriority")
    return keys.select("k").unionByName(keys.filter("o_orderpriority = '1-URGENT'").select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey::BIGINT AS k FROM lineitem EXCEPT ALL SELECT o_orderkey::BIGINT FROM orders")
def except_all_indices(spark: SparkSession, d: str) -> DataFrame:
    """SET3"""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("k")).exceptAll(load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k")))


@query(f"{MEANS} SELECT pes, operation, round(value, 6) AS value FROM a")
def metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    """AGG14, FLT4, PRJ9"""
    return means(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {METRICS} SELECT pes, operation, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM m GROUP BY 1, 2")
def metrics_timer_reduce(spark: SparkSession, d: str) -> DataFrame:
    """AGG1"""
    return metric_rows(spark, d).groupBy("pes", "operation").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {METRICS}, l AS (SELECT phase, sum(value) AS v FROM m GROUP BY phase, iteration) SELECT phase, sum(v)::BIGINT AS value FROM l GROUP BY phase")
def metrics_comm_volume(spark: SparkSession, d: str) -> DataFrame:
    """AGG12"""
    return metrics.two_level(metric_rows(spark, d), ["phase"], ["iteration"], "sum", "sum")


@query(f"WITH {METRICS}, t AS (SELECT operation, count(*) AS n, sum(value)::BIGINT AS total, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY 1) SELECT t.operation, n, total, round(mean, 6) AS mean, round(sd, 4) AS sd, round(sum(abs(m.value - mean)), 4) AS away FROM t JOIN m USING (operation) GROUP BY ALL")
def metrics_spread(spark: SparkSession, d: str) -> DataFrame:
    """AGG15, AGG19"""
    s = metrics.spread(metric_rows(spark, d), ["operation"])
    return s.select("operation", "n", "total", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), F.round("away", 4).alias("away"))


@query(f"WITH {METRICS}, p AS (SELECT pes, phase, avg(value) AS v FROM m GROUP BY 1, 2) SELECT pes, round(sum(v), 6) AS value FROM p GROUP BY pes")
def metrics_mean_then_sum(spark: SparkSession, d: str) -> DataFrame:
    """AGG16 without its division"""
    return metrics.two_level(metric_rows(spark, d), ["pes"], ["phase"], "mean", "sum").withColumn("value", F.round("value", 6))


@query(f"WITH {METRICS}, p AS (SELECT pes, iteration, sum(value) AS v FROM m WHERE operation NOT IN ('view') GROUP BY 1, 2) SELECT pes, round(avg(v), 6) AS value FROM p GROUP BY pes")
def metrics_sum_then_mean(spark: SparkSession, d: str) -> DataFrame:
    """AGG17, FLT7"""
    rows = metric_rows(spark, d).filter(~F.col("operation").isin("view"))
    return metrics.two_level(rows, ["pes"], ["iteration"], "sum", "mean").withColumn("value", F.round("value", 6))


@query(f"WITH {METRICS} SELECT pes, iteration, 'unified' AS operation, sum(value)::BIGINT AS value FROM m WHERE starts_with(operation, 'c') GROUP BY 1, 2")
def metrics_unified(spark: SparkSession, d: str) -> DataFrame:
    """AGG18, FLT5, FLT8"""
    rows = metric_rows(spark, d).filter(F.col("operation").startswith("c"))
    return rows.groupBy("pes", "iteration").agg(F.sum("value").alias("value")).withColumn("operation", F.lit("unified"))


@query(f"{MEANS}, b AS (SELECT *, max(CASE WHEN pes = 160 THEN value END) OVER (PARTITION BY operation) AS base FROM a) SELECT pes, operation, round(base / value, 6) AS speed_up, round(base / value / pes, 9) AS efficiency FROM b")
def metrics_speed_up(spark: SparkSession, d: str) -> DataFrame:
    """WIN9, JN7"""
    s = metrics.speed_up(means(spark, d), ["operation"], "pes", 160)
    return s.select("pes", "operation", F.round("speed_up", 6).alias("speed_up"), F.round("efficiency", 9).alias("efficiency"))


@query(f"{MEANS}, b AS (SELECT *, min(value) OVER (PARTITION BY pes) AS best FROM a) SELECT pes, operation, round(value / best, 6) AS ratio, value = best AS is_best FROM b")
def metrics_best_of(spark: SparkSession, d: str) -> DataFrame:
    """AGG20, JN8"""
    return metrics.best_of(means(spark, d), ["pes"], "operation").select("pes", "operation", F.round("ratio", 6).alias("ratio"), "is_best")


@query(f"{MEANS} SELECT operation, " + ", ".join(f'round(max(CASE WHEN pes = {p} THEN value END), 2) AS "{p}"' for p in (1, 160, 320, 640)) + " FROM a GROUP BY operation")
def metrics_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AGG24"""
    return metrics.pivoted(means(spark, d), "operation", "pes", [1, 160, 320, 640])


@query(f"WITH {METRICS}, q AS (SELECT operation, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY 1) SELECT operation, min(value) AS low, max(value) AS high FROM m JOIN q USING (operation) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1")
def metrics_whiskers(spark: SparkSession, d: str) -> DataFrame:
    """AGG22"""
    return metrics.whiskers(metric_rows(spark, d), ["operation"])


CUTS = [0, *(2**k for k in range(1, 19))]


@query(f"WITH {METRICS}, c AS (SELECT unnest({CUTS})::BIGINT AS cut) SELECT cut, coalesce((SELECT sum(value) FROM m WHERE value >= cut), 0)::BIGINT AS value FROM c")
def metrics_tail_sums(spark: SparkSession, d: str) -> DataFrame:
    """AGG23"""
    return metrics.tail_sums(metric_rows(spark, d), "value", F.col("value"), CUTS)


@query(f"WITH {METRICS}, h AS (SELECT round, sum(value)::BIGINT AS v FROM m GROUP BY 1) SELECT round, v, (sum(v) OVER (ORDER BY round ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS suffix_sum FROM h")
def metrics_suffix_sum(spark: SparkSession, d: str) -> DataFrame:
    """WIN6, WIN8: over a histogram of seven rounds"""
    return metrics.suffix_sums(metric_rows(spark, d).groupBy("round").agg(F.sum("value").alias("v")), "round", "v")


@query(f"WITH {METRICS} SELECT event_id::BIGINT AS event_id, phase, operation, (row_number() OVER (PARTITION BY phase, operation, iteration ORDER BY event_id) - 1)::BIGINT AS counter FROM m")
def metrics_counter(spark: SparkSession, d: str) -> DataFrame:
    """WIN7"""
    w = Window.partitionBy("phase", "operation", "iteration").orderBy("event_id")
    return metric_rows(spark, d).select(F.col("event_id").cast("long").alias("event_id"), "phase", "operation", (F.row_number().over(w) - 1).cast("long").alias("counter"))


@query(f"WITH {METRICS} SELECT count(DISTINCT pes) AS pes, count(DISTINCT operation) > 1 AS several FROM m")
def metrics_distinct(spark: SparkSession, d: str) -> DataFrame:
    """AGG21"""
    return metric_rows(spark, d).agg(F.countDistinct("pes").alias("pes"), (F.countDistinct("operation") > 1).alias("several"))


@query(f"WITH {METRICS} SELECT concat_ws(' ', 'RESULT', 'pes=' || pes, 'operation=' || operation, 'value=' || value) AS value FROM m WHERE iteration = 1 AND phase = 'phase1'")
def metrics_result_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK3, FLT6"""
    return metrics.result_text(metrics.selected(metric_rows(spark, d), {"iteration": 1, "phase": "phase1"}).select("pes", "operation", "value"))


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
