"""From raw records to corpora: filters, caps, cleaning, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.papers import group_name, primary_group, split_authors, year_of
from tessera.functions.text import clean_text

# The least abstract before and after cleaning, years, and the cap of a group.
LEAST_ABSTRACT, LEAST_CLEAN, FIRST_YEAR, LAST_YEAR, PARTIAL_YEARS, CAP = 400, 100, 2015, 2026, (2026,), 5000


def with_group(raw: DataFrame) -> DataFrame:
    """``raw`` with category_group, year and n_abstract."""
    return raw.withColumns({"category_group": primary_group(F.col("categories")), "year": year_of(F.col("update_date")), "n_abstract": F.length(F.trim(F.coalesce("abstract", F.lit(""))))})


def eligible(raw: DataFrame) -> DataFrame:
    """Records of a group, with a long enough abstract, not too old."""
    return with_group(raw).where(F.col("category_group").isNotNull() & (F.col("n_abstract") >= LEAST_ABSTRACT) & (F.col("year") >= FIRST_YEAR))


def capped(records: DataFrame, order: Column, cap: int = CAP) -> DataFrame:
    """The first ``cap`` records of each group; the limit is applied in every partition before the exchange."""
    line = Window.partitionBy("category_group").orderBy(order)
    return records.withColumn("_k", F.row_number().over(line)).where(F.col("_k") <= cap).drop("_k")


def counters(raw: DataFrame) -> DataFrame:
    """One row: how many records each filter takes, in order."""
    g = F.col("category_group").isNotNull()
    long, young = F.col("n_abstract") >= LEAST_ABSTRACT, F.coalesce(F.col("year") >= FIRST_YEAR, F.lit(False))
    return with_group(raw).agg(F.count("*").alias("total"), F.count_if(~g).alias("no_group"), F.count_if(g & ~long).alias("short_abstract"), F.count_if(g & long & ~young).alias("too_old"), F.count_if(g & long & young).alias("kept"))


def long_enough(records: DataFrame) -> DataFrame:
    """Records with abstract_clean, of more than LEAST_CLEAN characters; ids may repeat, so each record is judged by its own.

    The text comes out of a generator, below which no filter is pushed: it is cleaned once, not for the filter and again for the result.
    """
    return records.withColumn("abstract_clean", F.explode(F.array(clean_text(F.col("abstract"))))).where(F.length("abstract_clean") > LEAST_CLEAN)


def clean_corpus(records: DataFrame) -> DataFrame:
    """Cleaned papers with more than LEAST_CLEAN characters of abstract."""
    out = long_enough(records).select(
        F.col("id").alias("paper_id"), "title", clean_text(F.col("title")).alias("title_clean"), "abstract_clean", split_authors(F.col("authors")).alias("authors_list"), "year", "journal_ref"
    )
    text = F.concat("title_clean", F.lit(" . "), "title_clean", F.lit(" . "), "abstract_clean")
    return out.withColumn("text_for_embedding", text)


def labels(records: DataFrame) -> DataFrame:
    """The ground truth, kept apart from the papers."""
    return records.select(F.col("id").alias("paper_id"), "categories", "category_group", group_name(F.col("category_group")).alias("category_group_name"))


def timeseries_corpus(raw: DataFrame) -> DataFrame:
    """Uncapped cleaned papers of the years in scope."""
    rows = with_group(raw).where(F.col("category_group").isNotNull() & F.col("year").between(FIRST_YEAR, LAST_YEAR) & (F.col("n_abstract") >= LEAST_ABSTRACT))
    return long_enough(rows).withColumns({"category_group_name": group_name(F.col("category_group")), "is_partial_year": F.col("year").isin(*PARTIAL_YEARS)})
