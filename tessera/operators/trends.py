"""Publications over time: shares, growth, anomalies, regular grids.

A dated table has year, category, month (a date at the month's start, or null) and is_partial_year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def annual_volume(dated: DataFrame) -> DataFrame:
    """(year, is_partial_year, count)."""
    return dated.groupBy("year", "is_partial_year").agg(F.count("*").alias("count"))


def annual_share(dated: DataFrame) -> DataFrame:
    """(year, category, is_partial_year, count, share): share of the year's papers, from counts by category."""
    counts = dated.groupBy("year", "category", "is_partial_year").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("year")))


def monthly_share(dated: DataFrame, least: int = 30, by: list[str] | None = None) -> DataFrame:
    """(month, *by, is_partial_year, count, norm_share) of months with at least ``least`` papers.

    A paper weighs 1 / papers of its year, those without a month included.  Both
    come from one count by (year, month), so no row is joined to its year.
    """
    keys = [*(by or []), "year", "month", "is_partial_year"]
    counts = dated.groupBy(*keys).agg(F.count("*").alias("c"))
    counts = counts.withColumn("w", F.col("c") / F.sum("c").over(Window.partitionBy("year")))
    out = counts.where("month is not null").groupBy("month", *(by or []), "is_partial_year").agg(F.sum("c").alias("count"), F.sum("w").alias("norm_share"))
    return out.where(F.col("count") >= least)


def yoy_growth(shares: DataFrame) -> DataFrame:
    """(year, category, share, yoy_pct): growth over the category's year before; its first year is left out."""
    line = Window.partitionBy("category").orderBy("year")
    before = F.lag("share").over(line)
    out = shares.withColumn("_before", before).withColumn("yoy_pct", F.when(F.col("_before") > 0, (F.col("share") - F.col("_before")) / F.col("_before") * 100))
    return out.where("_before is not null").drop("_before")


def cagr(shares: DataFrame) -> DataFrame:
    """(category, cagr): yearly growth in percent between the first and the last complete year."""
    done = shares.where("not is_partial_year").groupBy("category").agg(F.min_by("share", "year").alias("a"), F.max_by("share", "year").alias("b"), F.min("year").alias("y"), F.max("year").alias("z"))
    growth = F.pow(F.col("b") / F.greatest(F.col("a"), F.lit(1e-9)), 1 / F.nullif(F.col("z") - F.col("y"), F.lit(0))) - 1
    return done.where("z > y").select("category", (growth * 100).alias("cagr"))


def dominant_category(shares: DataFrame) -> DataFrame:
    """(year, category, share) of the largest share, ties by name."""
    best = F.min_by(F.struct("category", "share"), F.struct((-F.col("share")).alias("s"), F.col("category").alias("c")))
    return shares.groupBy("year").agg(best.alias("b")).select("year", "b.category", "b.share")


def iqr_anomalies(monthly: DataFrame, value: str = "norm_share", factor: float = 1.5) -> DataFrame:
    """``monthly`` with anomaly and anomaly_type (spike, dip, normal): bounds from complete months, incomplete ones are never flagged."""
    done = F.when(~F.col("is_partial_year"), F.col(value))
    q = monthly.agg(F.percentile(done, F.lit(0.25)).alias("q1"), F.percentile(done, F.lit(0.75)).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    kind = F.when(F.col("is_partial_year"), "normal").when(F.col(value) > F.col("q3") + factor * spread, "spike").when(F.col(value) < F.col("q1") - factor * spread, "dip").otherwise("normal")
    out = monthly.crossJoin(F.broadcast(q)).withColumn("anomaly_type", kind)  # one row
    return out.withColumn("anomaly", F.col("anomaly_type") != "normal").drop("q1", "q3")


def month_grid(monthly: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, month, value, filled): every month from first to last; ``filled`` is interpolated by days between its neighbours."""
    grid = monthly.groupBy(*by).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    rows = grid.join(monthly.select(*by, "month", value), [*by, "month"], "left")
    line = Window.partitionBy(*by).orderBy("month")
    back, on = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("month", F.col(value).alias("v")))
    rows = rows.withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.first(known, ignorenulls=True).over(on)})
    step = F.datediff("month", F.col("_a.month")) / F.nullif(F.datediff(F.col("_b.month"), F.col("_a.month")), F.lit(0))
    return rows.select(*by, "month", value, F.coalesce(F.col(value), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * step).alias("filled"))


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row for each ``row``, a column for each of ``columns`` (named beforehand: no extra job), 0 where nothing is."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def mape(df: DataFrame, actual: str, fitted: str, by: list[str]) -> DataFrame:
    """(*by, mape): mean of |actual - fitted| / actual in percent, where actual is not 0, to 2 places."""
    share = F.when(F.col(actual) != 0, F.abs(F.col(actual) - F.col(fitted)) / F.abs(actual))
    return df.groupBy(*by).agg(F.round(F.avg(share) * 100, 2).alias("mape"))
