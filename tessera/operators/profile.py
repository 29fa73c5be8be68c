"""Profiling a table of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.papers import is_present


def running() -> Window:
    return Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def field_presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, present, total, rate, note) of text columns, counted in one pass."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(is_present(F.col(c).cast("string"))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns]))
    rate = F.when(F.col("total") > 0, 100 * F.col("present") / F.col("total")).otherwise(0.0)
    out = counts.select("total", pairs.alias("f")).select("f.field", "f.present", "total", rate.alias("rate"))
    return out.withColumn("note", F.when(F.col("rate") < 30, "sparse").when(F.col("rate") < 70, "moderate").otherwise(""))


def order_statistics(df: DataFrame, value: Column, at: dict[str, tuple[int, int]]) -> DataFrame:
    """One row with the value of rank n * a // b (from 0) for each name: exact, over the counts of distinct values.

    The window runs over distinct values only, however many rows there are.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").count()
    total = counts.agg(F.sum("count").alias("n"))
    upto = counts.withColumn("upto", F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    rows = upto.crossJoin(F.broadcast(total))  # one row
    return rows.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") * a / b), F.col("v"))).alias(name) for name, (a, b) in at.items()])


def summary(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, min, max, mean, median, stdev (of a sample)."""
    v = df.select(value.alias("v"))
    return v.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.stddev_samp("v").alias("stdev"))


def histogram(df: DataFrame, value: Column, bins: list[tuple[float, float, str]], closed: bool = False) -> DataFrame:
    """(bin, label, count, pct, cumulative_pct) over [low, high), or [low, high] if ``closed``; empty bins too."""
    v, total = df.select(value.alias("v")), F.col("n")
    inside = [F.count_if((F.col("v") >= lo) & ((F.col("v") <= hi) if closed else (F.col("v") < hi))).alias(f"b{i}") for i, (lo, hi, _) in enumerate(bins)]
    row = v.agg(F.count("v").alias("n"), *inside)
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(label).alias("label"), F.col(f"b{i}").alias("count"), sum((F.col(f"b{j}") for j in range(i + 1)), F.lit(0)).alias("upto")) for i, (_, _, label) in enumerate(bins)])
    out = row.select("n", F.explode(cells).alias("c")).select("n", "c.*")
    return out.select("bin", "label", "count", (100 * F.col("count") / total).alias("pct"), (100 * F.col("upto") / total).alias("cumulative_pct"))


def retention(df: DataFrame, value: Column, thresholds: list[int]) -> DataFrame:
    """(threshold, kept, dropped, retention_pct): rows at or above each threshold, counted in one pass."""
    row = df.select(value.alias("v")).agg(F.count("v").alias("n"), *[F.count_if(F.col("v") >= t).alias(f"t{t}") for t in thresholds])
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("kept")) for t in thresholds]))
    out = row.select("n", cells.alias("c")).select("n", "c.*")
    return out.select("threshold", "kept", (F.col("n") - F.col("kept")).alias("dropped"), (100 * F.col("kept") / F.col("n")).alias("retention_pct"))


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(value, count, share) of non-null values; the window runs over distinct values."""
    counts = df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def cumulative_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(value, count, pct, cumulative_pct) in the order of the values."""
    counts = value_counts(df, value, name)
    line = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(name, "count", (100 * F.col("count") / total).alias("pct"), (100 * F.sum("count").over(line) / total).alias("cumulative_pct"))
