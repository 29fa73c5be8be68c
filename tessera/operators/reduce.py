"""Reducing vectors: PCA and truncated SVD from a Gram matrix, a UMAP layout, and a hashing encoder."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, literal
from tessera.operators import pairs as P
from tessera.operators.cluster import numbered
from tessera.operators.pairs import BLOCK, squared


def gram(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of outer products, sum of vectors, rows): one matrix from each partition, added up by rows of the matrix."""

    def partial(batches):
        total = sums = None
        n = 0
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), dtype=float)
                total = x.T @ x if total is None else total + x.T @ x
                sums = x.sum(0) if sums is None else sums + x.sum(0)
                n += len(x)
        if n:
            rows = [*total.tolist(), sums.tolist(), [float(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "r"])

    rows = df.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(partial, "i int, r array<double>")
    added = rows.select("i", F.posexplode("r").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # (d + 2) * d numbers
    d = max((r.j for r in added), default=-1) + 1
    out = np.zeros((d + 2, max(d, 1)))
    for r in added:
        out[r.i, r.j] = r.x
    return out[:d], out[d], int(out[d + 1, 0])


def components(df: DataFrame, column: str, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k directions, explained shares): PCA if ``centred``, else truncated SVD; each direction's largest entry is positive."""
    outer, sums, n = gram(df, column)
    mean = sums / max(n, 1) if centred else np.zeros_like(sums)
    values, vectors = np.linalg.eigh(outer / max(n, 1) - np.outer(mean, mean))
    order = values.argsort()[::-1][:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def projected(df: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``df`` with the vectors' coordinates, by expressions."""
    return df.withColumn(column, F.array(*[dot(F.col(column), literal(a)) - F.lit(float(mean @ a)) for a in axes]))


def reconstruction_mse(df: DataFrame, column: str, k: int, centred: bool = True) -> float:
    """Mean squared error of a component after reduction to k, from the Gram matrix alone."""
    outer, sums, n = gram(df, column)
    mean = sums / max(n, 1) if centred else np.zeros_like(sums)
    values = np.sort(np.linalg.eigvalsh(outer / max(n, 1) - np.outer(mean, mean)))[::-1]
    return float(values[k:].sum() / len(values))


def layout(x: np.ndarray, neighbours: int = 15, rounds: int = 120, seed: int = 42) -> np.ndarray:
    """Two coordinates for each row: a fuzzy neighbour graph laid out from the first two principal axes (McInnes et al., 2018), min_dist 0."""
    n = len(x)
    k = min(neighbours, n - 1)
    start = x - x.mean(0)
    start = start @ np.linalg.svd(start, full_matrices=False)[2][:2].T if n > 2 else np.zeros((n, 2))
    y = 10 * start / max(np.abs(start).max(), 1e-9)
    if k < 1:
        return y
    near, d = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    for at in range(0, n, BLOCK):
        gap = np.sqrt(squared(x[at : at + BLOCK], x))
        gap[np.arange(len(gap)), at + np.arange(len(gap))] = np.inf
        part = np.argpartition(gap, k - 1, axis=1)[:, :k]
        part = np.take_along_axis(part, np.take_along_axis(gap, part, axis=1).argsort(axis=1), axis=1)
        near[at : at + BLOCK], d[at : at + BLOCK] = part, np.take_along_axis(gap, part, axis=1)
    return arranged(y, near, d, rounds, seed)


def arranged(y: np.ndarray, near: np.ndarray, d: np.ndarray, rounds: int = 120, seed: int = 42) -> np.ndarray:
    """``y``, moved along the graph of each row's neighbours, nearest first, at the distances ``d``."""
    n, k = near.shape
    if k < 1:
        return y
    rho, goal = d[:, :1], math.log2(max(k, 2))
    low, high = np.full((n, 1), 1e-4), np.full((n, 1), 1e3)
    for _ in range(40):
        mid = np.sqrt(low * high)
        much = np.exp(-np.maximum(d - rho, 0) / mid).sum(axis=1, keepdims=True) > goal
        high, low = np.where(much, mid, high), np.where(much, low, mid)
    w = np.exp(-np.maximum(d - rho, 0) / np.sqrt(low * high)).ravel()
    one, two = np.repeat(np.arange(n), k), near.ravel()
    pairs, at = np.unique(np.minimum(one, two) * n + np.maximum(one, two), return_inverse=True)
    total, square = np.bincount(at, w), np.bincount(at, w * w)  # a + b and a² + b² of the two directions
    i, j = pairs // n, pairs % n
    p, pick = total - (total * total - square) / 2, np.random.default_rng(seed)
    a, b = 1.93, 0.79
    for step in range(rounds):
        rate = 1 - step / rounds
        on = pick.random(len(i)) < p
        s, t = i[on], j[on]
        gap = y[s] - y[t]
        sq = (gap * gap).sum(1, keepdims=True) + 1e-9
        pull = np.clip(-2 * a * b * sq ** (b - 1) / (1 + a * sq**b) * gap, -4, 4) * rate
        np.add.at(y, s, pull)
        np.add.at(y, t, -pull)
        for _ in range(5):
            far = pick.integers(n, size=len(s))
            gap = y[s] - y[far]
            sq = (gap * gap).sum(1, keepdims=True)
            push = np.clip(2 * b / ((0.001 + sq) * (1 + a * sq**b)) * gap, -4, 4) * rate
            np.add.at(y, s, push)
    return y


def neighbours_of(df: DataFrame, id_col: str, column: str, k: int) -> DataFrame:
    """(id, m, y, near, gap) of every row: its number, its first two principal coordinates, the numbers of its k nearest rows and their distances, by parts of all rows."""
    rows = numbered(df, id_col, column)
    n = rows.count()
    k = min(k, max(n - 1, 0))
    mean, axes, _ = components(rows, "v", 2)
    parts = P.Parts(rows, "m", lambda t: (t.column("m").to_numpy(), P.matrix(t.column("v"))), n)

    def scan(batches):
        b = P.whole(batches)
        if b is None:
            return
        m, q = np.asarray(b.column("m")), P.matrix(b.column("v"))
        near, best = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        for number, x in parts:
            for at in range(0, len(q) if k and len(x) else 0, BLOCK):
                gap = squared(q[at : at + BLOCK], x)
                gap[m[at : at + BLOCK, None] == number[None, :]] = np.inf
                few = np.argpartition(gap, k - 1, axis=1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(len(x)), gap.shape)
                both = np.concatenate([best[at : at + BLOCK], np.take_along_axis(gap, few, axis=1)], 1)
                names = np.concatenate([near[at : at + BLOCK], number[few]], 1)
                order = both.argsort(axis=1, kind="stable")[:, :k]
                best[at : at + BLOCK], near[at : at + BLOCK] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        lists = lambda a: pa.array(list(a), pa.list_(pa.from_numpy_dtype(a.dtype)))
        y = np.zeros((len(q), 2))
        y[:, : len(axes)] = (q - mean) @ axes.T
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m), lists(y), lists(near), lists(np.sqrt(best))], names=["id", "m", "y", "near", "gap"])

    return P.dealt(rows, n).mapInArrow(scan, f"id {dict(df.dtypes)[id_col]}, m long, y array<double>, near array<long>, gap array<double>")


def umap_layout(df: DataFrame, id_col: str, column: str, neighbours: int = 15) -> DataFrame:
    """(id, umap_x, umap_y) of every row: neighbours are found in many tasks, and one then moves all points together, in time proportional to the rows."""
    rows = neighbours_of(df, id_col, column, neighbours)

    def fit(pdf):
        pdf = pdf.sort_values("id").reset_index(drop=True)
        start, number = np.stack(pdf.y), pdf.m.to_numpy()
        order = number.argsort()
        near = order[np.searchsorted(number, np.stack(pdf.near), sorter=order)]
        y = arranged(10 * start / max(np.abs(start).max(), 1e-9), near, np.stack(pdf.gap))
        return pdf[["id"]].rename(columns={"id": id_col}).assign(umap_x=y[:, 0], umap_y=y[:, 1])

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(fit, f"{id_col} {dict(df.dtypes)[id_col]}, umap_x double, umap_y double")


def hash_encode(text: str | None, width: int) -> np.ndarray:
    """A unit vector from the signed hashes of a text's words; zero for a text without words."""
    v = np.zeros(width)
    for word in (text or "").lower().split():
        h = xxhash.xxh64_intdigest(word)
        v[(h >> 1) % width] += 1 if h & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(df: DataFrame, id_col: str, text_col: str, encode=hash_encode, width: int = 64) -> DataFrame:
    """(id, embedding) by any encoder text, width -> vector; batches go to Python as Arrow."""

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t.as_py(), width).astype("float32") for t in b.column(1)], pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(scan, f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>")
