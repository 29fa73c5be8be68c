"""Scores that compare methods, and labels against vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import pairs as P
from tessera.plans.staging import staged

# Weights of the blends, and the relative gap within which the preferred reduction wins.
SILHOUETTE, NOISE, RUNTIME = 0.60, 0.25, 0.15
VARIANCE, ERROR, REDUCE_RUNTIME, MARGIN = 0.45, 0.40, 0.15, 0.01


def minmax(value: Column, by: list[str] | None = None, inverted: bool = False) -> Column:
    """On a scale from 0 to 1 over the group: 0 if all are null, 0.5 if all are equal; a null is 0 whichever way the scale runs."""
    group = Window.partitionBy(*(by or []))
    low, high = F.min(value).over(group), F.max(value).over(group)
    scale = F.when(high == low, F.lit(0.5)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))
    if inverted:
        scale = F.when(high == low, F.lit(0.5)).otherwise(1 - scale)
    return F.when(value.isNull(), F.lit(0.0)).otherwise(scale)


def clustering_scores(metrics: DataFrame) -> DataFrame:
    """``metrics`` with score and rank: 0.60 silhouette + 0.25 noise + 0.15 runtime; a row that is not valid scores -1."""
    valid = F.col("status") == "valid"
    blend = SILHOUETTE * F.col("silhouette_norm") + NOISE * F.col("noise_norm") + RUNTIME * F.col("runtime_norm")
    out = metrics.withColumns({"silhouette_norm": minmax(F.col("silhouette_score")), "noise_norm": minmax(F.col("noise_ratio"), inverted=True), "runtime_norm": minmax(F.col("runtime_seconds"), inverted=True)})
    out = out.withColumn("score", F.when(valid, blend).otherwise(-1.0))
    return out.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("score"))))  # a row for each fit


def best_per_method(scored: DataFrame) -> DataFrame:
    """The best fit of each method, with flags for the best silhouette, noise and runtime, and their share of 4 with the score's."""
    line = Window.partitionBy("method").orderBy(F.desc("score"), "parameters")
    best = scored.withColumn("_k", F.row_number().over(line)).where("_k = 1").drop("_k")
    everything = Window.partitionBy()
    flags = {"best_silhouette": F.col("silhouette_score") == F.max("silhouette_score").over(everything), "best_noise": F.col("noise_ratio") == F.min("noise_ratio").over(everything), "best_runtime": F.col("runtime_seconds") == F.min("runtime_seconds").over(everything), "best_score": F.col("score") == F.max("score").over(everything)}
    best = best.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return best.withColumn("win_rate", sum((F.col(k).cast("int") for k in flags), F.lit(0)) / 4)


def compression_scores(metrics: DataFrame) -> DataFrame:
    """``metrics`` with score: 0.45 variance + 0.40 error + 0.15 runtime among equal component counts; null where excluded."""
    by = ["n_components"]
    blend = VARIANCE * minmax(F.col("explained_variance"), by) + ERROR * minmax(F.col("reconstruction_mse"), by, True) + REDUCE_RUNTIME * minmax(F.col("runtime_seconds"), by, True)
    return metrics.withColumn("score", F.when(~F.col("excluded"), blend))


def choose_reduction(scored: DataFrame, preferred: str = "PCA_SVD") -> DataFrame:
    """The best row by score, or the preferred method's best if it is within the margin of it."""
    first = F.row_number().over(Window.partitionBy(F.col("method") == preferred).orderBy(F.desc("score"), "method", "n_components"))
    rows = scored.where("score is not null").withColumn("_k", first).where("_k = 1")
    top = F.max("score").over(Window.partitionBy())
    near = (F.col("method") == preferred) & ((top - F.col("score")) / top <= MARGIN)
    return rows.withColumn("_near", near).orderBy(F.desc("_near"), F.desc("score")).limit(1).drop("_k", "_near")


def label_evaluation(labels: DataFrame, column: str = "label") -> DataFrame:
    """One row: clusters found, rows, share of noise (label -1), and whether that is a clustering."""
    out = labels.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col(column) >= 0, F.col(column))).alias("n_clusters"), F.avg((F.col(column) == -1).cast("double")).alias("noise_ratio"))
    return out.withColumn("status", F.when(F.col("n_clusters") < 2, "too_few_clusters").when(F.col("n_clusters") >= F.col("n") * (1 - F.col("noise_ratio")), "too_many_clusters").otherwise("valid"))


def silhouette(sample: DataFrame, id_col: str, vector_col: str, label_col: str, most: int | None = 5_000) -> DataFrame:
    """(id, silhouette) of all rows, or of at most ``most``, by Euclidean distance; noise (label -1) takes no part.

    Pairs are made block by block, by the parts of :mod:`tessera.operators.pairs`: no join.
    """
    rows = sample.where(F.col(label_col) >= 0).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("int").alias("l"))
    rows = staged(rows if most is None else rows.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(most))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    n, kinds = sum(counts.values()), np.array(sorted(counts))
    sizes = np.array([counts[k] for k in kinds])

    def by_label(table):
        label = table.column("l").to_numpy()
        order = label.argsort(kind="stable")
        return P.matrix(table.column("v"))[order], np.searchsorted(kinds, label[order])

    parts = P.Parts(rows, "id", by_label, n)

    def score(batches):
        b = P.whole(batches)
        if b is None:
            return
        q, own = P.matrix(b.column("v")), np.searchsorted(kinds, np.asarray(b.column("l")))
        sums = np.zeros((len(q), len(kinds)))
        for x, label in parts:
            if len(x):
                for at in range(0, len(q), P.BLOCK):
                    sums[at : at + P.BLOCK] += label_sums(np.sqrt(P.squared(q[at : at + P.BLOCK], x)), label, len(kinds))
        yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), pa.array(silhouettes(sums, own, sizes))], names=["id", "silhouette"])

    return P.dealt(rows, n).mapInArrow(score, "id string, silhouette double")


def label_sums(gap: np.ndarray, label: np.ndarray, kinds: int) -> np.ndarray:
    """Sums of the columns of ``gap`` by their labels, which are sorted."""
    first = np.nonzero(np.diff(label, prepend=-1))[0]
    out = np.zeros((len(gap), kinds))
    out[:, label[first]] = np.add.reduceat(gap, first, axis=1)
    return out


def silhouettes(sums: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes of rows of the clusters ``own``, from their sums of distances to each cluster."""
    row = np.arange(len(sums))
    inside = sums[row, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes[None, :]
    means[row, own] = np.inf
    outside = means.min(axis=1)
    with np.errstate(invalid="ignore"):
        return np.where((sizes[own] > 1) & np.isfinite(outside), (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
