"""Queries of sources, sinks and reports, with the SQL that they equal. Files are written to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import run
from lexiloom.plans.scratch import scratch_path
from lexiloom.registry import lcp_sql, load, query
from lexiloom.sources import generators, metrics, text

LINES = "SELECT o_orderkey::BIGINT AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority || ' ' || o_orderkey END AS value FROM orders"


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    value = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat_ws(" ", "o_orderpriority", k.cast("string")))
    return load(spark, d, "orders").select(k.alias("k"), value.alias("value"))


def written(spark: SparkSession, rows: DataFrame, parts: int = 3) -> str:
    path = scratch_path(spark, "lines")
    text.write_lines(rows.repartition(parts), path)
    return path


@query(f"SELECT value, count(*) AS copies FROM ({LINES}) GROUP BY 1")
def lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SRC3, SNK1: lines written to a file for each partition, read back whole"""
    return text.lines(spark, written(spark, order_lines(spark, d))).groupBy("value").agg(F.count(F.lit(1)).alias("copies"))


@query(f"SELECT value FROM ({LINES}) WHERE value <> ''")
def lines_without_empty(spark: SparkSession, d: str) -> DataFrame:
    """SNK7: files copied without their empty lines"""
    path = scratch_path(spark, "full-lines")
    text.drop_empty_lines(spark, written(spark, order_lines(spark, d)), path)
    return text.lines(spark, path)


@query(f"SELECT count(*) AS lines, sum(strlen(value) + 1)::BIGINT AS bytes FROM ({LINES})")
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, SRC7: lines and bytes of all files"""
    path = written(spark, order_lines(spark, d))
    sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))
    return text.counted_lines(spark, path).agg(F.sum("lines").alias("lines")).join(sizes)


@query("SELECT n_regionkey::INT AS region, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS value, sum(strlen(n_name) + 1)::BIGINT AS size FROM nation GROUP BY 1")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: a file of each region, read as one string"""
    path = scratch_path(spark, "files")
    rows = load(spark, d, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    rows.select(F.col("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = text.whole_files(spark, path)
    return files.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region"), "value", "size")


@query(f"WITH l AS (SELECT row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM ({LINES})) SELECT least(idx // (n // 7), 6)::BIGINT AS part, count(*) AS lines FROM l GROUP BY 1")
def equal_line_parts(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: as many lines in each of seven parts, the rest in the last"""
    return text.equal_parts(order_lines(spark, d), "k", 7).groupBy("part").agg(F.count(F.lit(1)).alias("lines"))


@query(f"SELECT k FROM (SELECT k, sum(strlen(value) + 1) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM ({LINES})) WHERE upto <= 10000")
def first_line_bytes(spark: SparkSession, d: str) -> DataFrame:
    """SRC1: the lines within the first 10,000 bytes"""
    return text.first_bytes(order_lines(spark, d), 10_000, "k").select("k")


@query("SELECT substr(n_name, pos::BIGINT) AS value, count(*) AS copies FROM nation, range(1, 100) t(pos) WHERE pos <= length(n_name) GROUP BY 1")
def suffix_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK2: all suffixes of the nations' names, a line each, read back"""
    names = load(spark, d, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "suffixes")
    text.write_lines(text.suffixes(names, "n_name", "n_nationkey"), path, "b")
    return text.lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT i AS id, rpad(repeat('Z', 6) || chr(65 + (i // 676 // 26 % 26)::INT) || chr(65 + (i // 676 % 26)::INT) || chr(65 + (i // 26 % 26)::INT) || chr(65 + (i % 26)::INT), 40, 'Z') AS s FROM range(5000) t(i)")
def counter_generator(spark: SparkSession, d: str) -> DataFrame:
    """SRC10: 5000 strings of 40 letters, a quarter of them before the padding"""
    return generators.counter_strings(spark, 5000, 40, 0.25).select("id", F.decode("b", "UTF-8").alias("s"))


# Run metrics: events stand for the rows of a run's log.
METRICS = """m AS (SELECT CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 160 WHEN 2 THEN 320 ELSE 640 END::BIGINT AS pes, event_type AS operation,
 'phase' || (event_id % 3)::VARCHAR AS phase, (event_id % 5)::BIGINT AS iteration, (event_id % 7)::BIGINT AS round, (abs(value) * 100)::BIGINT + 1 AS value, event_id FROM events WHERE value IS NOT NULL)"""


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").filter("value is not null")
    k = F.col("user_id") % 4
    pes = F.when(k == 0, 1).when(k == 1, 160).when(k == 2, 320).otherwise(640).cast("long")
    value = F.rint(F.abs("value") * 100).cast("long") + 1
    return e.select(pes.alias("pes"), F.col("event_type").alias("operation"), F.concat(F.lit("phase"), (F.col("event_id") % 3).cast("string")).alias("phase"), (F.col("event_id") % 5).cast("long").alias("iteration"), (F.col("event_id") % 7).cast("long").alias("round"), value.alias("value"), "event_id")


MEANS = f"WITH {METRICS}, a AS (SELECT pes, operation, avg(value) AS value FROM m WHERE iteration <> 0 GROUP BY 1, 2)"


def means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.selected(metric_rows(spark, d), {}).groupBy("pes", "operation").agg(F.avg("value").alias("value"))


TOTALS = f"{METRICS}, l AS (SELECT *, value + event_id % 11 AS total FROM m)"
TIMES = {"avgTime": "sum(value) // count(*)", "maxTime": "max(value)", "minTime": "min(value)", "avgLoss": "sum(total - value) // count(*)", "maxLoss": "max(total - value)", "minLoss": "min(total - value)"}


@query(f"WITH {TOTALS} " + " UNION ALL ".join(f"SELECT phase, round, operation, '{k}' AS type, ({v})::BIGINT AS value FROM l GROUP BY ALL" for k, v in TIMES.items()))
def metrics_timer_losses(spark: SparkSession, d: str) -> DataFrame:
    """AGG11: times and losses of each phase, round and operation, a row for each figure"""
    rows = metric_rows(spark, d).withColumn("total", F.col("value") + F.col("event_id") % 11)
    keys = ["phase", "round", "operation"]
    return metrics.long_form(metrics.timer_reduce(rows, keys), keys, list(TIMES))


@query(f"WITH {METRICS} SELECT phase, CASE WHEN phase <> 'phase0' THEN pes END AS pes, sum(value)::BIGINT AS value FROM m GROUP BY 1, 2")
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: summed over processes in one phase, a row for each process in the others"""
    return metrics.counter_reduce(metric_rows(spark, d), ["phase"], "pes", F.col("phase") == "phase0")


@query(f"WITH {METRICS}, p AS (SELECT pes, phase, avg(value) AS v FROM m GROUP BY 1, 2) SELECT pes, round(sum(v) / 5000, 9) AS value FROM p GROUP BY pes")
def metrics_bytes_per_string(spark: SparkSession, d: str) -> DataFrame:
    """AGG16: for 5,000 strings"""
    return metrics.bytes_per_string(metric_rows(spark, d), ["pes"], 5000).withColumn("value", F.round("value", 9))


PES = (1, 160, 320, 640)
CELLS = ", ".join(f"""coalesce(CASE WHEN "{p}" = least({', '.join(f'"{q}"' for q in PES)}) THEN '\\textbf{{' || printf('%.2f', round("{p}", 2)) || '}}' ELSE printf('%.2f', round("{p}", 2)) END, '') AS "{p}\"""" for p in PES)
MARKED = f"{MEANS}, w AS (SELECT operation, {', '.join(f'max(CASE WHEN pes = {p} THEN value END) AS "{p}"' for p in PES)} FROM a GROUP BY 1), t AS (SELECT operation, {CELLS} FROM w)"


@query(f"{MARKED} SELECT * FROM t")
def metrics_marked_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AGG24: the best value of each row in bold"""
    return metrics.marked_pivot(means(spark, d), "operation", "pes", list(PES))


@query(f"{MARKED} SELECT ' ' || concat_ws('  & ', operation, {', '.join(f'"{p}"' for p in PES)}) || ' \\\\' AS value FROM t")
def metrics_latex(spark: SparkSession, d: str) -> DataFrame:
    """SNK5: the same as lines of a table, written and read back"""
    path = scratch_path(spark, "latex")
    text.write_lines(metrics.latex_lines(metrics.marked_pivot(means(spark, d), "operation", "pes", list(PES)), "operation"), path)
    return text.lines(spark, path)


@query(f"WITH {METRICS} SELECT pes, operation, phase, value FROM m WHERE iteration = 1")
def metrics_log_import(spark: SparkSession, d: str) -> DataFrame:
    """SRC17: RESULT lines among others, read as typed columns"""
    rows = metrics.selected(metric_rows(spark, d), {"iteration": 1}).select("pes", "operation", "phase", "value")
    path = scratch_path(spark, "log")
    text.write_lines(metrics.result_text(rows).unionByName(spark.createDataFrame([("noise",), ("RESULTS none",)], "value string")), path)
    return metrics.columns_of(metrics.result_lines(spark, path), rows.schema)


@query(f"WITH {METRICS} SELECT pes, operation, phase, value FROM m")
def metrics_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC18, SNK4: a table separated by |, with a header"""
    rows = metric_rows(spark, d).select("pes", "operation", "phase", "value")
    path = scratch_path(spark, "table")
    metrics.write_table(rows, path)
    return metrics.read_table(spark, path, rows.schema)


@query(f"WITH {METRICS} SELECT pes, avg(value)::DOUBLE AS value FROM m WHERE operation = 'click' AND iteration = 2 GROUP BY 1")
def metrics_configured(spark: SparkSession, d: str) -> DataFrame:
    """SRC19: a report's filters from a JSON file"""
    path = scratch_path(spark, "config")
    config = json.dumps({"title": "clicks", "filters": [{"column": "operation", "value": "click"}, {"column": "iteration", "value": "2"}]}, indent=1)
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(path)
    rows = metrics.configured(metric_rows(spark, d), metrics.report_config(spark, path))
    return rows.groupBy("pes").agg(F.avg("value").alias("value"))


@query(f"WITH {METRICS} SELECT event_id::BIGINT AS event_id, value FROM m WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND phase <> 'phase1'")
def metrics_communication(spark: SparkSession, d: str) -> DataFrame:
    """FLT9"""
    e = F.col("event_id")
    rows = metric_rows(spark, d).withColumns({"type": F.when(e % 2 == 0, "number").otherwise("time"), "rawCommunication": F.when(e % 3 != 0, 1).otherwise(0), "phase": F.when(F.col("phase") == "phase1", "none").otherwise(F.col("phase"))})
    return metrics.communication(rows).select(e.cast("long").alias("event_id"), "value")


RUN = f"""s AS (SELECT i AS id, hex(encode(rpad('AAAA' || chr(65 + (i // 676 % 26)::INT) || chr(65 + (i // 26 % 26)::INT) || chr(65 + (i % 26)::INT), 30, 'A'))) AS h FROM range(2000) t(i)),
o AS (SELECT h, lag(h) OVER (ORDER BY h, id) AS p, lead(h) OVER (ORDER BY h, id) AS q FROM s), l AS (SELECT length(h) // 2 AS n, {lcp_sql("p", "h")} AS lcp, greatest({lcp_sql("p", "h")}, {lcp_sql("q", "h")}) + 1 AS dp FROM o)"""


@query(f"WITH {RUN}, v AS (SELECT 'strings' AS type, count(*)::BIGINT AS value FROM l UNION ALL SELECT 'chars', sum(n)::BIGINT FROM l UNION ALL SELECT 'lcps', sum(lcp)::BIGINT FROM l UNION ALL SELECT 'prefixes', sum(dp)::BIGINT FROM l UNION ALL SELECT 'bytes', sum(n + 1 - lcp + 1)::BIGINT FROM l UNION ALL SELECT 'complete_and_sorted', 1 UNION ALL SELECT 'exhaustive', 1) SELECT i AS iteration, type, value FROM v, range(2) t(i)")
def sort_run(spark: SparkSession, d: str) -> DataFrame:
    """The runs of the command line with checks: what they report besides times"""
    rows = run.run(spark, "ratio", 2000, 30, 0.25, coding="front", compress=True, iterations=2, check=True, exhaustive=True)
    return rows.filter("type not in ('time', 'largest')").select("iteration", "type", "value")
