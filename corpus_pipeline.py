"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the rows that the
stage before it kept; all but the last return the columns of ``documents``.

Defined results, of every stage
* An empty table gives an empty table with the same columns; extra columns, whatever their names, stay and do not clash.
* A null or empty text is a document: it is scored by the rate among labelled texts without terms, it is the
  near copy of other texts without words, no benchmark hits it, and it is mixed and sharded with the size 0 and 1.
* A null id is a document of its own, which goes before one with an id; a null source is a source, the last in order.
* Rows that repeat an id and a text are near copies of each other; rows that repeat an id on different texts all stay.
* Very long texts are read whole; ties are broken by the least id, then the least text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import decontaminated
from tessera.llm.mixing import mixed_rows
from tessera.llm.sharding import assign_shards
from tessera.llm.names import fresh
from tessera.llm.nearcopies import keep_one_similar
from tessera.llm.toxicity import without_toxic
from tessera.plans.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 for toxicity; without any usable label all stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id.

    Candidates come from SimHash by softly decoded Golay keys, and are verified: five words, a Jaccard similarity of 0.8 or more.
    """
    return keep_one_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated document, and no benchmark passage in the others; ``n_chars`` follows the text."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix draws, grouped by the splitting tree's shards and in hash order within them."""
    mixed = mixed_rows(docs, shard_col=fresh(docs, "mix_shard"), order_col=fresh(docs, "mix_order"))
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Toxicity, SimHash (XXH64) and checksums are not expressible in DuckDB SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
