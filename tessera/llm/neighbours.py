"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Coarse centroids and a product quantiser of the residuals are trained on at most
``SAMPLE`` vectors, chosen by hash; every vector is indexed.  A query probes the
lists nearest to it and estimates the distance to their vectors (asymmetric: the query is
not quantised), where c is a list's centroid and r a vector's quantised residual:

    |q - c - r|^2 = |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r

The middle term is stored with the vector, and the last is a sum over one table of the
query's products with the codewords, so a query needs one table for all lists.  The
nearest by estimate are ranked again by their exact distance, in double precision.
How many lists are probed is read off the sample: the fewest that hold at least
``TARGET`` of the sample's own true neighbours.

Equal vectors are indexed once, with their smallest ids, as many as a result can
show.  Lists are packed into buckets of about ``BUCKET`` vectors, and a list with
more is dealt over several, so that no list, however common, lands in one task; the
queries of a bucket are dealt too, at most ``ASKED`` or so to a task.

Defined results
* Vectors that are null, empty, zero, or hold null or non-finite components take no part,
  nor do vectors of another length than the most common (of equally common ones the smaller).
* Rows with a null id take no part; of rows that repeat an id the least vector counts.
* A query finds all candidates if there are fewer than k; ties go to the smaller id.
* An empty table gives an empty result.  Only the named columns are read, so others do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import staged

#: Most vectors that centroids and quantiser are trained on, and the most lists.
SAMPLE, LISTS = 20_000, 2_048
#: Share of the sample's true neighbours that the probed lists must hold, and the sample's queries for that.
TARGET, TRIES = 0.985, 256
#: Components of a subvector, and codewords for it.
SUB, WORDS = 4, 256
BUCKET = 4_096
#: Queries that meet a bucket in one task; with more, the bucket is read by several.
ASKED = 4_096
#: Vectors ranked exactly in each bucket, for each neighbour asked for.
RERANK = 25
SEED = 11


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``a`` and ``b``."""
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` the nearest row of ``b``, in slices."""
    return np.concatenate([squares(a[i : i + 4096], b).argmin(axis=1) for i in range(0, len(a), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids, the residuals' codebooks by slices of the components, and the lists to probe."""

    centres: np.ndarray
    cuts: list[slice]
    books: list[np.ndarray]
    probes: int

    @classmethod
    def train(cls, x: np.ndarray, n: int, k: int) -> Quantiser:
        """From the sample ``x`` of ``n`` vectors."""
        lists = max(1, min(LISTS, len(x) // 8, int(2 * n**0.5)))
        centres = k_means(x, lists)
        own = nearest(x, centres)
        rest = x - centres[own]
        cuts = [slice(i, i + SUB) for i in range(0, x.shape[1], SUB)]
        books = [k_means(rest[:, c], min(WORDS, len(x))) for c in cuts]
        tries = x[:TRIES]
        gaps = squares(tries, x)
        gaps[np.arange(len(tries)), np.arange(len(tries))] = np.inf
        near = np.argsort(gaps, axis=1)[:, : min(k, len(x) - 1)]
        place = np.argsort(np.argsort(squares(tries, centres), axis=1), axis=1)
        ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        probes = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else lists
        return cls(centres, cuts, books, probes)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([nearest(rest[:, c], book) for c, book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def offsets(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """|r|^2 + 2 c.r of each encoded vector."""
        rest = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return ((rest + 2 * self.centres[cell]) * rest).sum(axis=1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """-2 q.r by (subvector, codeword), flat."""
        out = np.zeros((len(self.cuts), WORDS))
        for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[j, : len(book)] = -2 * book @ q[c]
        return out.ravel()


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a column of lists of equal length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row with ``is_query`` (over ``id``) its k nearest other rows."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = staged(rows.where(F.size("v") == (lengths.n if lengths else 0)).groupBy("id").agg(F.min("v").alias("v")))
    same = Window.partitionBy("v").orderBy("id")  # the rank filter is applied before the exchange too
    classes = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = staged(classes)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    sample = np.array([r.v for r in classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()])  # at most SAMPLE rows
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(Quantiser.train(sample, n, k)))  # bounded by LISTS and WORDS

    def index(batches):
        quantiser = cloudpickle.loads(shared.value)
        for b in batches:
            if b.num_rows:
                cell, codes = quantiser.encode(matrix(b.column("v")))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), packed, pa.array(quantiser.offsets(cell, codes)), b.column("ids"), b.column("v")], names=["cell", "codes", "shift", "ids", "v"])

    indexed = staged(classes.mapInArrow(index, "cell int, codes binary, shift double, ids array<long>, v array<double>"))
    sizes = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # at most LISTS rows
    first, parts, bucket, filled = {}, {}, 0, 0
    for cell, size in sorted(sizes.items()):
        parts[cell] = -(-size // BUCKET)
        if filled and (filled + size > BUCKET or parts[cell] > 1):
            bucket, filled = bucket + 1, 0
        first[cell] = bucket
        filled += size
        if parts[cell] > 1:
            bucket, filled = bucket + parts[cell], 0
    place = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])])
    spread = F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])])
    stored = indexed.withColumn("bucket", place[F.col("cell")] + F.pmod(F.xxhash64("v"), spread[F.col("cell")].cast("long")).cast("int"))

    def probe(batches):
        quantiser = cloudpickle.loads(shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(squares(matrix(b.column("v")), quantiser.centres), axis=1, kind="stable")
            at, buckets, cells = [], [], []
            for i, row in enumerate(order.tolist()):
                lists, held = [], 0
                for c in row:  # more than the probes only where these hold too little
                    if len(lists) >= quantiser.probes and held > 4 * k:
                        break
                    if c in sizes:
                        lists.append(c)
                        held += sizes[c]
                wanted: dict[int, list[int]] = {}
                for c in lists:
                    for p in range(parts[c]):
                        wanted.setdefault(first[c] + p, []).append(c)
                for key, value in wanted.items():
                    at.append(i)
                    buckets.append(key)
                    cells.append(value)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(buckets, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["id", "v", "bucket", "cells"])

    asked = staged(rows.where(is_query).mapInArrow(probe, "id long, v array<double>, bucket int, cells array<int>"))
    tasks = staged(asked.groupBy("bucket").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("tasks")))
    asked = asked.join(tasks, "bucket").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks").cast("long")).cast("int")).drop("tasks")
    stored = stored.join(tasks, "bucket").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def rank(queries: pa.Table, held: pa.Table) -> pa.Table:
        quantiser = cloudpickle.loads(shared.value)
        out = {"query_id": [], "id": [], "score": []}
        if queries.num_rows and held.num_rows:
            held = held.combine_chunks()
            x = matrix(held.column("v").chunk(0))
            cell = np.asarray(held.column("cell"))
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), -1)
            places = codes + WORDS * np.arange(codes.shape[1])
            shift = np.asarray(held.column("shift"))
            ids = held.column("ids").to_pylist()
            members = {int(c): np.nonzero(cell == c)[0] for c in np.unique(cell)}
            for q_id, q, cells in zip(queries.column("id").to_pylist(), queries.column("v").to_pylist(), queries.column("cells").to_pylist(), strict=True):
                q = np.array(q)
                cells = [c for c in cells if c in members]
                rows_in = [members[c] for c in cells]
                if not rows_in:
                    continue
                found = np.concatenate(rows_in)
                guess = np.repeat(((quantiser.centres[cells] - q) ** 2).sum(axis=1), list(map(len, rows_in))) + shift[found] + quantiser.table(q)[places[found]].sum(axis=1)
                if len(found) > RERANK * k:
                    found = found[np.argpartition(guess, RERANK * k)[: RERANK * k]]
                exact = np.sqrt(((x[found] - q) ** 2).sum(axis=1))
                pairs = sorted((float(d), i) for d, f in zip(exact, found, strict=True) for i in ids[f] if i != q_id)[:k]
                out["query_id"] += [q_id] * len(pairs)
                out["id"] += [i for _, i in pairs]
                out["score"] += [d for d, _ in pairs]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = asked.groupBy("bucket", "task").cogroup(stored.groupBy("bucket", "task")).applyInArrow(rank, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
