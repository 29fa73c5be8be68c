"""Clustering of vectors."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import pairs as P
from tessera.plans.staging import staged

#: Rows that agglomerative clustering works on, which holds all pairs; chosen by a hash of the id.
TREE_ROWS = 12_000
#: Starts of k-means that run at the same time.
AT_ONCE = 5
#: Rows whose distances to all others are held at once.
BLOCK = P.BLOCK
#: How far a centre may move in the last round.
TOLERANCE = 1e-4
#: Tasks of a pass of DBSCAN at most; each may return a link for every row.
TASKS = 48


def kmeans(df: DataFrame, column: str, k: int = 5, starts: int = 10, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """The centres of the least cost out of ``starts`` seeds: begun by k-means||, ``AT_ONCE`` at a time, then moved all in one pass a round."""
    rows = df.select(F.col(column).cast("array<double>").alias("v"))

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, P.OWN):
                x = P.matrix(b.column(0).slice(at, P.OWN))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([len(x)], pa.int32())], names=["x", "n"])

    blocks = rows.mapInArrow(pack, "x binary, n int").persist()
    try:
        fits = seeds(rows, [k], starts, seed)[k]
        cost, still = np.full(starts, np.inf), list(range(starts))
        for _ in range(rounds):
            at = [fits[i] for i in still]

            def partial(batches, at=at):
                total = [None] * len(at)
                for b in batches:
                    for raw, n in zip(b.column(0), b.column(1), strict=True):
                        x = np.frombuffer(raw.as_buffer()).reshape(n.as_py(), -1)
                        for i, c in enumerate(at):
                            got = assigned(x, c)
                            total[i] = got if total[i] is None else tuple(p + q for p, q in zip(total[i], got, strict=True))
                for i, got in enumerate(total):
                    if got is not None:
                        flat = np.concatenate([np.ravel(p) for p in got])
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([flat.tobytes()])], names=["i", "s"])

            sums = {}
            for r in blocks.mapInArrow(partial, "i int, s binary").collect():  # sums of k vectors a task and start
                sums[r.i] = sums.get(r.i, 0) + np.frombuffer(r.s)
            going = []
            for i, f in enumerate(still):
                c = fits[f]
                new, cost[f] = moved(c, sums[i][: len(c)], sums[i][len(c) : -1].reshape(c.shape)), sums[i][-1]
                going += [] if settled(c, new) else [f]
                fits[f] = new
            still = going
            if not still:
                break
    finally:
        blocks.unpersist()
    return fits[int(cost.argmin())]


def seeds(rows: DataFrame, ks: list[int], starts: int, seed: int = 42) -> dict[int, list[np.ndarray]]:
    """For each k the centres that k-means|| begins with, one set a seed."""
    features = rows.select(array_to_vector(rows.columns[0]).alias("features")).persist()
    try:
        features.count()
        with ThreadPoolExecutor(AT_ONCE) as pool:
            begun = pool.map(lambda p: np.array(KMeans(k=p[0], maxIter=0, seed=seed + p[1], initMode="k-means||").fit(features).clusterCenters()), [(k, i) for k in ks for i in range(starts)])
            begun = iter(list(begun))
    finally:
        features.unpersist()
    return {k: [next(begun) for _ in range(starts)] for k in ks}


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = P.squared(x, centres)
    label = gap.argmin(axis=1)
    return label, gap[np.arange(len(x)), label]


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sum of rows) of each centre and the cost."""
    label, gap = nearest_centre(x, centres)
    member = (label[None, :] == np.arange(len(centres))[:, None]).astype(float)
    return member.sum(1), member @ x, np.array(gap.sum())


def moved(centres: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means; a centre without rows stays."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)


def settled(old: np.ndarray, new: np.ndarray) -> bool:
    return bool((((old - new) ** 2).sum(1) <= TOLERANCE**2).all())


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """(cost, centres) of rows that one task holds."""
    cost = math.inf
    for _ in range(rounds):
        n, sums, cost = assigned(x, centres)
        old, centres = centres, moved(centres, n, sums)
        if settled(old, centres):
            break
    return float(cost), centres


def kmeans_labels(df: DataFrame, id_col: str, column: str, **how) -> DataFrame:
    """(id, cluster_id)."""
    centres = df.sparkSession.sparkContext.broadcast(kmeans(df, column, **how))

    def label(batches):
        for b in batches:
            if b.num_rows:
                found = nearest_centre(P.matrix(b.column(1)), centres.value)[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=[id_col, "cluster_id"])

    return df.select(id_col, F.col(column).cast("array<double>").alias("v")).mapInArrow(label, f"{id_col} {dict(df.dtypes)[id_col]}, cluster_id int")


def hash_order(df: DataFrame, id_col: str, most: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(42), id_col), id_col).limit(most)


def dbscan_labels(df: DataFrame, id_col: str, column: str, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster_id, is_core) of every row: -1 is noise.

    Clusters are numbered by their first core row in the order of a hash of the id, and a border row is of the first it touches.
    """
    kind, spark = dict(df.dtypes)[id_col], df.sparkSession
    rows = numbered(df, id_col, column)
    key, labels = dbscan(rows, [(eps, min_samples)])
    shared = spark.sparkContext.broadcast((key, *labels[0]))

    def named(batches):
        key, label, core = shared.value
        for b in batches:
            at = np.searchsorted(key, np.asarray(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label[at], pa.int32()), pa.array(core[at])], names=[id_col, "cluster_id", "is_core"])

    return rows.select("id", "m").mapInArrow(named, f"{id_col} {kind}, cluster_id int, is_core boolean")


def numbered(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, m, v), staged: m is a number of the row, the same whenever it is read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"))
    return staged(rows.select("id", F.monotonically_increasing_id().alias("m"), "v"))


def dbscan(rows: DataFrame, choices: list[tuple[float, int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(numbers, labels and cores for each choice of eps and min_samples) of the rows by their numbers, which ascend.

    Three passes of all pairs serve all choices, by the parts of :mod:`tessera.operators.pairs`: rows around each row, a
    forest of the links between core rows, the clusters that border rows touch. The driver holds some numbers
    a row, no vectors, and joins the forests as they come.
    """
    spark = rows.sparkSession
    names = rows.select("m", F.xxhash64(F.lit(42), "id").alias("h"), F.col("id")).orderBy("h", "id", "m").select("m").toArrow().column(0).to_numpy()
    n = len(names)
    if not n:
        return names, [(np.zeros(0, int), np.zeros(0, bool)) for _ in choices]
    by_number = names.argsort()
    key = names[by_number]  # rows are named by their place in the order of the hash below
    place = spark.sparkContext.broadcast((key, by_number))
    at = lambda column: place.value[1][np.searchsorted(place.value[0], np.asarray(column))]
    key_, place_ = key, by_number
    parts = P.Parts(rows, "m", lambda t: (place_[np.searchsorted(key_, t.column("m").to_numpy())], P.matrix(t.column("v"))), n)
    width = sorted({e for e, _ in choices})
    dealt = rows.repartition(min(-(-n // P.OWN), TASKS))

    def scan(batches, takes=None, others=None):
        """(places, places of the part, squared distances) block by block, of the rows and the part's rows that are taken."""
        b = P.whole(batches)
        if b is None:
            return
        own, q = at(b.column("m")), P.matrix(b.column("v"))
        if takes is not None:
            own, q = own[takes[own]], q[takes[own]]
        for i, x in parts:
            if others is not None:
                i, x = i[others[i]], x[others[i]]
            for k in range(0, len(own) if len(i) else 0, P.BLOCK):
                yield own[k : k + P.BLOCK], i, P.squared(q[k : k + P.BLOCK], x)

    def passed(work, columns):
        """Arrow tables of what each task found, one after the other."""
        found = dealt.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in out], names=columns) for out in work(batches)), ", ".join(f"{c} long" for c in columns))
        return [c.to_numpy() for c in found.toArrow().columns]

    def around(batches):
        count = {}
        for own, _, gap in scan(batches):
            got = np.stack([(gap <= e * e).sum(axis=1) for e in width], 1)
            count[own[0]] = (own, got + (count[own[0]][1] if own[0] in count else 0))
        for own, got in count.values():
            yield own, *got.T

    found = passed(around, ["at", *[f"n{i}" for i in range(len(width))]])
    sums = np.zeros((n, len(width)), dtype=np.int64)
    sums[found[0]] = np.stack(found[1:], 1)
    cores = [sums[:, width.index(e)] >= least for e, least in choices]
    shared = spark.sparkContext.broadcast(cores)

    def forest(batches):
        some = np.any(shared.value, axis=0)
        root = [np.arange(n) for _ in choices]
        for own, i, gap in scan(batches, some, some):
            a, b = np.nonzero(gap <= width[-1] ** 2)
            a, b, d = own[a], i[b], gap[a, b]
            for c, (e, _) in enumerate(choices):
                core = shared.value[c]
                on = (d <= e * e) & core[a] & core[b] & (root[c][a] != root[c][b])
                if on.any():
                    root[c] = link(root[c], a[on], b[on])
        for c, r in enumerate(root):
            moved = np.nonzero(r != np.arange(n))[0]
            yield np.full(len(moved), c), moved, r[moved]

    roots = [np.arange(n) for _ in choices]
    if any(c.any() for c in cores):
        which, a, b = passed(forest, ["c", "a", "b"])
        roots = [link(r, a[which == c], b[which == c]) for c, r in enumerate(roots)]
    labels = []
    for core, root in zip(cores, roots, strict=True):
        label = np.full(n, -1)
        label[core] = np.unique(root[core], return_inverse=True)[1]
        labels.append(label)
    known = spark.sparkContext.broadcast(labels)

    def border(batches):
        some, rest = np.any(shared.value, axis=0), ~np.all(shared.value, axis=0)
        first = {}
        for own, i, gap in scan(batches, rest, some):
            label = [np.where(x[i] >= 0, x[i], n) for x in known.value]
            got = np.stack([np.where(gap <= e * e, x[None, :], n).min(axis=1) for (e, _), x in zip(choices, label, strict=True)], 1)
            first[own[0]] = (own, np.minimum(got, first[own[0]][1]) if own[0] in first else got)
        for own, got in first.values():
            yield own, *got.T

    touched = np.full((n, len(choices)), n)
    if any(c.any() for c in cores):
        found = passed(border, ["at", *[f"n{i}" for i in range(len(choices))]])
        touched[found[0]] = np.stack(found[1:], 1)
    done = [np.where(core, label, np.where(first < n, first, -1)) for core, label, first in zip(cores, labels, touched.T, strict=True)]
    return key, [(label[by_number], core[by_number]) for label, core in zip(done, cores, strict=True)]


def link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, which has the least member of each row's class, once the classes of each a and b are one."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low != high
        if not on.any():
            break
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def merge_tree(x: np.ndarray, k: int, linkage: str, metric: str = "euclidean") -> np.ndarray:
    """Labels of k clusters by merging the closest."""
    return cut(merges_of(x, linkage, metric), len(x), k)


def merges_of(x: np.ndarray, linkage: str, metric: str = "euclidean") -> list[tuple[float, int, int]]:
    """(height, i, j) of all merges of the closest, by Lance and Williams' update; ``linkage`` is ward, average or complete.

    Chains of nearest neighbours find the merges in time quadratic in the rows; the
    lowest come first.
    """
    n = len(x)
    if metric == "cosine":
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    gap = np.empty((n, n))
    for at in range(0, n, BLOCK):
        part = P.squared(x[at : at + BLOCK], x)
        gap[at : at + BLOCK] = part / 2 if metric == "cosine" else part if linkage == "ward" else np.sqrt(part)
    np.fill_diagonal(gap, np.inf)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        row = gap[chain[-1]]
        near = int(row.argmin())
        if len(chain) < 2 or row[near] < row[chain[-2]]:
            chain.append(near)
            continue
        i, j = sorted((chain.pop(), chain.pop()))
        height = gap[i, j]
        if linkage == "ward":
            new = ((size[i] + size) * gap[i] + (size[j] + size) * gap[j] - size * height) / (size[i] + size[j] + size)
        elif linkage == "average":
            new = (size[i] * gap[i] + size[j] * gap[j]) / (size[i] + size[j])
        else:
            new = np.maximum(gap[i], gap[j])
        new[[i, j]] = np.inf
        gap[i], gap[:, i], gap[j], gap[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        merges.append((height, i, j))
    return merges


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters of n rows: the lowest merges come first."""
    label = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(n - max(k, 1), 0)]:
        a, b = sorted((label[i], label[j]))
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def agglomerative_labels(df: DataFrame, id_col: str, column: str, k: int = 5, linkage: str = "ward", metric: str = "euclidean", most: int = TREE_ROWS) -> DataFrame:
    """(id, cluster_id) of at most ``most`` rows, as one group: the method needs all pairs."""
    rows = hash_order(df.select(id_col, F.col(column).cast("array<double>").alias("v")), id_col, most)

    def fit(pdf):
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        return pdf[[id_col]].assign(cluster_id=merge_tree(np.array(pdf.v.tolist()), k, linkage, metric).astype("int32"))

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(fit, f"{id_col} {dict(df.dtypes)[id_col]}, cluster_id int")
