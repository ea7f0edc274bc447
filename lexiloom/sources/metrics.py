"""Run metrics as rows: reading, filtering, aggregates, speed-ups, pivots (SRC17 to SRC19, SNK3, SNK4, AGG11 to AGG24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pairs map) of the lines that begin with RESULT: key=value pairs, one space between (SRC17)."""
    rows = spark.read.text(path).filter(F.col("value").startswith("RESULT "))
    return rows.select(F.col("value").alias("line"), F.str_to_map(F.substring(F.col("value"), F.lit(8), F.length("value")), F.lit(" "), F.lit("=")).alias("pairs"))


def columns_of(pairs: DataFrame, schema: StructType) -> DataFrame:
    """The pairs as typed columns; a missing key is null."""
    return pairs.select(*[F.col("pairs").getItem(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table separated by |, with a header, lines that begin with - left out (SRC18)."""
    return spark.read.csv(path, sep="|", header=True, comment="-", schema=schema)


def write_table(df: DataFrame, path: str) -> None:
    """The same form as a sink (SNK4)."""
    df.write.csv(path, sep="|", header=True)


def report_config(spark: SparkSession, path: str) -> DataFrame:
    """A report's description in one JSON document (SRC19)."""
    return spark.read.json(path, multiLine=True)


def communication(rows: DataFrame) -> DataFrame:
    """Numbers of raw communication that belong to a phase (FLT9)."""
    return rows.filter((F.col("type") == "number") & (F.col("rawCommunication") == 1) & (F.col("phase") != "none"))


def result_text(df: DataFrame, prefix: str = "RESULT") -> DataFrame:
    """(value): each row as prefix and key=value pairs (SNK3)."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    return df.select(F.concat_ws(" ", F.lit(prefix), *pairs).alias("value"))


def selected(df: DataFrame, equal: dict[str, object], warm_up: bool = False) -> DataFrame:
    """Rows with all these values; those of iteration 0 only if warm_up (FLT4 to FLT6)."""
    out = df if warm_up else df.filter("iteration != 0")
    for k, v in equal.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out


def two_level(df: DataFrame, groups: list[str], inner: list[str], first: str, then: str, value: str = "value") -> DataFrame:
    """first(value) within groups + inner, then then(...) over groups (AGG16, AGG17)."""
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*groups, *inner).agg(f[first](value).alias("v")).groupBy(*groups).agg(f[then]("v").alias("value"))


def timer_reduce(df: DataFrame, groups: list[str], active: str = "value", total: str = "total") -> DataFrame:
    """avg, max and min over processes of the active time, and of the loss: total less active time (AGG11).

    Averages are whole numbers, as times are.
    """
    loss = F.col(total) - F.col(active)
    n = F.count(F.lit(1))
    return df.groupBy(*groups).agg(
        F.floor(F.sum(active) / n).cast("long").alias("avgTime"), F.max(active).alias("maxTime"), F.min(active).alias("minTime"),
        F.floor(F.sum(loss) / n).cast("long").alias("avgLoss"), F.max(loss).alias("maxLoss"), F.min(loss).alias("minLoss"),
    )


def long_form(df: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """(groups, type, value): a row for each of the named columns."""
    return df.unpivot(groups, names, "type", "value")


def counter_reduce(df: DataFrame, groups: list[str], process: str, sum_up: Column, value: str = "value") -> DataFrame:
    """(groups, process, value): counters summed over processes, process being null, where sum_up, else a row for each (AGG13)."""
    own = df.withColumn(process, F.when(~sum_up, F.col(process)))
    return own.groupBy(*groups, process).agg(F.sum(value).alias("value"))


def bytes_per_string(df: DataFrame, groups: list[str], strings: int, value: str = "value") -> DataFrame:
    """Means of each phase, summed over the phases, divided by the number of strings (AGG16)."""
    return two_level(df, groups, ["phase"], "mean", "sum", value).withColumn("value", F.col("value") / F.lit(strings))


def spread(df: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """count, sum, mean, sd, and the sum of distances from the mean (AGG15, AGG19): two aggregations, no window."""
    stats = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    away = df.join(stats.select(*groups, "mean"), groups).groupBy(*groups).agg(F.sum(F.abs(F.col(value) - F.col("mean"))).alias("away"))
    return stats.join(away, groups)


def speed_up(means: DataFrame, groups: list[str], processes: str, base: int, value: str = "value") -> DataFrame:
    """speed_up = value at `base` processes / value, and efficiency = speed_up / processes (WIN9, JN7)."""
    own = Window.partitionBy(*groups)
    at_base = F.max(F.when(F.col(processes) == base, F.col(value))).over(own)
    out = means.withColumn("speed_up", at_base / F.col(value))
    return out.withColumn("efficiency", F.col("speed_up") / F.col(processes))


def best_of(means: DataFrame, groups: list[str], name: str, value: str = "value") -> DataFrame:
    """The least value of each group and whether a row has it, and its ratio to it (AGG20, JN8)."""
    least = means.groupBy(*groups).agg(F.min(value).alias("best"))
    return means.join(least, groups).withColumns({"ratio": F.col(value) / F.col("best"), "is_best": F.col(value) == F.col("best")})


def pivoted(means: DataFrame, rows: str, columns: str, wanted: list, places: int = 2, value: str = "value") -> DataFrame:
    """A table of rows by columns, rounded (AGG24)."""
    return means.groupBy(rows).pivot(columns, wanted).agg(F.round(F.first(value), places))


def marked_pivot(means: DataFrame, rows: str, columns: str, wanted: list, places: int = 2, value: str = "value") -> DataFrame:
    """pivoted() as text, a row's least value in bold (AGG24, SNK5)."""
    text = lambda v: F.format_string(f"%.{places}f", F.round(v, places))
    least = F.least(*[F.col(str(c)) for c in wanted]) if len(wanted) > 1 else F.col(str(wanted[0]))
    own = means.groupBy(rows).pivot(columns, wanted).agg(F.first(value)).withColumn("_least", least)
    cell = lambda c: F.when(F.col(c) == F.col("_least"), F.concat(F.lit("\\textbf{"), text(F.col(c)), F.lit("}"))).otherwise(F.coalesce(text(F.col(c)), F.lit("")))
    return own.select(rows, *[cell(str(c)).alias(str(c)) for c in wanted])


def latex_lines(table: DataFrame, rows: str) -> DataFrame:
    """(value): each row of a table of text as a line of LaTeX (SNK5)."""
    cells = [F.col(c) for c in table.columns if c != rows]
    return table.select(F.concat(F.lit(" "), F.concat_ws("  & ", F.col(rows), *cells), F.lit(" \\\\")).alias("value"))


def configured(df: DataFrame, config: DataFrame) -> DataFrame:
    """Rows that agree with a report's filters (SRC19): config has an array of (column, value) to equal, all as text."""
    for f in config.select(F.explode("filters").alias("f")).select("f.column", "f.value").collect():  # a report's few filters
        df = df.filter(F.col(f["column"]).cast("string") == F.lit(f["value"]))
    return df


def whiskers(df: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """The least and greatest value within 1.5 times the box of the hinges (AGG22)."""
    box = df.groupBy(*groups).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(box, groups).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*groups).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def tail_sums(histogram: DataFrame, at: str, value: Column, cuts: list[int]) -> DataFrame:
    """(cut, value): the sums of value over rows with `at` from each cut on (AGG23): sums by class, then few classes."""
    ordered = sorted(cuts)
    classes = F.array(*[F.lit(c).cast("long") for c in ordered])
    own = histogram.select(F.size(F.filter(classes, lambda c: c <= F.col(at))).alias("k"), value.alias("v")).groupBy("k").agg(F.sum("v").alias("v"))
    table = histogram.sparkSession.range(len(ordered)).select((F.col("id") + 1).alias("j"), F.element_at(classes, (F.col("id") + 1).cast("int")).alias("cut"))
    return table.join(F.broadcast(own), F.col("k") >= F.col("j"), "left").groupBy("cut").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))


def suffix_sums(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running totals from the end (WIN8), for tables of bounded size such as histograms."""
    w = Window.orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("suffix_sum", F.sum(value).over(w))
