"""Sharding by jump consistent hashing.

Every row's key is hashed to one of ``n`` shards by the jump hash of Lamping and
Veach (2014): no ring table, O(log n) steps, and growing from ``n`` to ``n + 1``
shards moves only the rows that the new shard takes (1 / (n + 1) of them).

Defined results
* A null key is hashed as the key -1.
* A null text has the size and checksum of the empty text.
* Rows that repeat a key share its shard; each still gets a slot of its own.
* An empty table gives an empty result with the same schema.
* Only the named columns are read, so other columns, whatever their names, neither matter nor clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import join_small, small, staged

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key, by the jump consistent hash over ``shards`` shards."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(going):
            state[going] = state[going] * _STEP + np.uint64(1)
            jump = (bucket[going] + 1) * (float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0))
            jump = np.minimum(jump, float(shards)).astype(np.int64)
            on = jump < shards
            going, jump = going[on], jump[on]
            bucket[going] = jump
    return bucket


def assign_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bin_rows: int = 20_000) -> DataFrame:
    """One row per row of ``df``: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps, in the order of
    (bin, key, checksum, size).  A shard is never sorted as a whole: rows fall into
    bins of about ``bin_rows`` by a hash of key, checksum and size, so that one key on many texts
    (or no key) is spread; each (shard, bin) is numbered by itself, and the bins' counts, a small table, give the offsets.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(
        F.col(f"`{key}`").cast("long").alias("k"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )

    def place(batches):
        for b in batches:
            keys = np.asarray(b.column("k").fill_null(-1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(jump_hash(keys, shards), pa.int32()), pa.array(jump_hash(keys, shards + 1), pa.int32())],
                names=["k", "size", "crc", "shard", "grown"],
            )

    placed = staged(narrow.mapInArrow(place, "k long, size long, crc long, shard int, grown int"))
    bins = max(1, -(-placed.count() // bin_rows))
    binned = placed.withColumn("bin", F.pmod(F.xxhash64("k", "crc", "size"), F.lit(bins)))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets, fits = small(counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), 200_000)
    own = Window.partitionBy("shard", "bin").orderBy(F.col("k").asc_nulls_last(), "crc", "size")
    numbered = binned.withColumn("n", F.row_number().over(own))
    return join_small(numbered, offsets, fits, ["shard", "bin"]).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to shards 0 to 15 by their key."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
