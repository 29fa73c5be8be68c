"""The tables that queries run over, as both engines see them.

The test tables hold no paper metadata, so raw records are derived from
``documents`` by rules on the id, in SQL that Spark and DuckDB both read.  The
derived columns cover what real records do: old and new ids, several categories,
missing and malformed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.papers import split_authors
from tessera.functions.vectors import cleaned

RAW_SQL = """
SELECT doc_id,
       CASE WHEN doc_id % 7 = 0 THEN 'hep-th/' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || lpad(CAST(doc_id % 14 AS STRING), 2, '0') || lpad(CAST(doc_id % 1000 AS STRING), 3, '0')
            WHEN doc_id % 61 = 0 THEN 'draft' || CAST(doc_id AS STRING)
            ELSE CAST(15 + doc_id % 12 AS STRING) || lpad(CAST(doc_id % 13 AS STRING), 2, '0') || '.' || lpad(CAST(doc_id % 99991 AS STRING), 5, '0') END AS id,
       CASE WHEN doc_id % 83 = 0 THEN NULL ELSE substring(text, 1, 80) END AS title,
       text AS abstract,
       CASE doc_id % 11 WHEN 0 THEN 'cs.LG stat.ML' WHEN 1 THEN 'math-ph math.MP' WHEN 2 THEN 'hep-th' WHEN 3 THEN 'q-bio.NC' WHEN 4 THEN 'cond-mat.str-el quant-ph'
            WHEN 5 THEN 'astro-ph.GA' WHEN 6 THEN 'physics.optics' WHEN 7 THEN 'stat.ME cs.LG math.ST' WHEN 8 THEN 'quant-ph' WHEN 9 THEN 'cs.CV' ELSE '' END AS categories,
       CASE WHEN doc_id % 53 = 0 THEN 'n/a' WHEN doc_id % 59 = 0 THEN NULL
            ELSE CAST(2013 + (doc_id * 5) % 14 AS STRING) || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || '-01' END AS update_date,
       CASE doc_id % 8 WHEN 0 THEN 'Ada Byron' WHEN 1 THEN 'Bo Chen; Cy Dahl' WHEN 2 THEN '[''Eva Fox'', ''Gil Hart'', ''Bo Chen'']' WHEN 3 THEN 'none' WHEN 4 THEN ''
            WHEN 5 THEN 'Ida Jun, Kim Lund, Mo Nash, Ola Park, Quin Rush, Sam Tate' WHEN 6 THEN 'Uma Vance;Bo Chen' ELSE NULL END AS authors,
       CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' ELSE 'J. Phys. ' || CAST(doc_id % 40 AS STRING) END AS journal_ref,
       CAST(1 + doc_id % 10 AS INT) AS n_versions,
       CAST(doc_id % 5 AS INT) AS cluster_id, lang
FROM documents
"""
RAW_COLUMNS = ["id", "title", "abstract", "categories", "update_date", "authors", "journal_ref"]

DATED_SQL = """
SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS category,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month,
       year(o_orderdate) = 2001 AS is_partial_year
FROM orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records."""
    return spark.sql(RAW_SQL.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated publications."""
    return spark.sql(DATED_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with authors, year, cluster, keywords and a vector where there is one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), cleaned(F.col("embedding")).alias("embedding"))
    rows = raw(spark, sf_dir).select(
        "doc_id", F.col("doc_id").cast("string").alias("paper_id"), "title", split_authors(F.col("authors")).alias("authors_list"),
        F.expr("CAST(2015 + (doc_id * 7) % 12 AS INT)").alias("year"), "cluster_id",
        F.expr("array('topic' || CAST(doc_id % 17 AS STRING), 'topic' || CAST(doc_id % 23 AS STRING))").alias("paper_keywords"), "abstract",
    )
    return rows.join(vectors, "doc_id", "left").drop("doc_id")


#: The same papers for DuckDB; authors by the rules of the raw records.
PAPERS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 83 = 0 THEN NULL ELSE substring(text, 1, 80) END AS title,
       CASE doc_id % 8 WHEN 0 THEN ['Ada Byron'] WHEN 1 THEN ['Bo Chen', 'Cy Dahl'] WHEN 2 THEN ['Eva Fox', 'Gil Hart', 'Bo Chen']
            WHEN 5 THEN ['Ida Jun', 'Kim Lund', 'Mo Nash', 'Ola Park', 'Quin Rush', 'Sam Tate'] WHEN 6 THEN ['Uma Vance', 'Bo Chen'] ELSE [] END AS authors_list,
       CAST(2015 + (doc_id * 7) % 12 AS INT) AS year, CAST(doc_id % 5 AS INT) AS cluster_id,
       ['topic' || (doc_id % 17), 'topic' || (doc_id % 23)] AS paper_keywords, text AS abstract, embedding::DOUBLE[] AS embedding
FROM documents LEFT JOIN embeddings ON vec_id = doc_id
"""
