"""Readers.  Every table has a fixed schema: nothing is inferred, and columns are pruned in the scan."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "submitter", "authors", "title", "comments", "journal-ref", "doi", "report-no", "categories", "license", "abstract")]
    + [
        T.StructField("versions", T.ArrayType(T.StructType([T.StructField("version", T.StringType()), T.StructField("created", T.StringType())]))),
        T.StructField("update_date", T.StringType()),
        T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
PAPER_DEFAULTS = {"title": "''", "abstract": "''", "authors_list": "cast(array() as array<string>)", "year": "cast(null as int)", "cluster_id": "-1", "paper_keywords": "cast(array() as array<string>)"}


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A record for each valid line, all null if it names no known field; blank and broken lines are skipped."""
    broken = "_broken"
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(broken, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)
    return rows.where(F.col(broken).isNull()).drop(broken)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document over several lines; an empty table if there is none."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType())


def parquet(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table that has the required columns."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of some Parquet tables that is there."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def numpy_vectors(spark: SparkSession, vectors_path: str, ids_path: str) -> DataFrame:
    """(paper_id, embedding) from two arrays on the driver, of equally many rows; the way into Parquet for exported vectors."""
    x, ids = np.load(vectors_path), np.load(ids_path, allow_pickle=False)
    if len(x) != len(ids):
        raise ValueError(f"{len(x)} vectors but {len(ids)} ids")
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"paper_id": ids.astype(str), "embedding": x.astype("float32").tolist()}), "paper_id string, embedding array<float>")


def with_defaults(df: DataFrame, defaults: dict[str, str] = PAPER_DEFAULTS) -> DataFrame:
    """``df`` with the columns it lacks, by SQL expressions."""
    return df.withColumns({c: F.expr(e) for c, e in defaults.items() if c not in df.columns})


def report_sections(spark: SparkSession, path: str, headings: dict[str, str]) -> DataFrame:
    """(section, line, text) of a text report: each line after a heading, by the heading's pattern, until the next one.

    A report is a small file, read as one document.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    section = F.coalesce(*[F.when(F.col("text").rlike(pattern), F.lit(name)) for name, pattern in headings.items()])
    from pyspark.sql import Window

    marked = text.withColumn("heading", section)
    line = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("section", F.last("heading", ignorenulls=True).over(line)).where("section is not null and heading is null and trim(text) <> ''").select("section", "line", "text")
