"""Raw records as a stream: the filters and cleaning of the batch loaders are stateless and run unchanged.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ingest import clean_corpus, eligible


def raw_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON-lines files as they arrive."""
    return spark.readStream.schema(schema).json(path)


def clean_stream(raw: DataFrame) -> DataFrame:
    """Cleaned papers of a stream of raw records."""
    return clean_corpus(eligible(raw))


def counts_by_window(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, key, n): counts by window, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def start_clean(raw: DataFrame, out: str, checkpoint: str):
    """Writes cleaned papers as Parquet, exactly once, until all that is there is read."""
    return clean_stream(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
