"""Statistics over tables of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, column: str) -> DataFrame:
    """One row (means, deviations): of each component, deviations of the population, 1 where a component is constant.

    A row for each component at most goes through the exchange of every partition.
    """
    parts = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    listed = parts.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d")))).alias("p"))
    return listed.select(F.col("p.m").alias("means"), F.col("p.d").alias("deviations"))


def standardised(df: DataFrame, column: str) -> DataFrame:
    """``df`` with every component of the vectors at mean 0 and deviation 1."""
    wide = df.crossJoin(F.broadcast(moments(df, column)))  # one row
    shifted = F.zip_with(F.col(column), "means", lambda x, m: x - m)
    return wide.withColumn(column, F.zip_with(shifted, "deviations", lambda x, d: x / d)).drop("means", "deviations")
