"""Near-duplicates by SimHash, with Golay-code fuzzy hashing as candidate search.

A text's fingerprint has 64 bits: the strict majority, bit by bit, of the XXH64
values (seed 42) of its 3-word shingles.  Two fingerprints link if they differ in
at most 3 bits; a class is what links reach.

Candidates.  The 64 bits are cut into segments of 22, 21 and 21 bits, each read as a
word of the perfect binary Golay code (23, 12, 7).  A segment is decoded, and so are
all its one-bit neighbours; the codeword indices found (one or six, as a rule) are
its keys, and two segments that differ in at most one bit share a key.  Up to 3
errors in 3 segments leave two cases, so no link is lost:

* some segment has no error, and of the other two one has at most one error:
  keys are (segment i as it is, Golay key of segment j), for the 6 ordered pairs;
* every segment has exactly one error, so a half of each is free of errors: keys are
  (Golay key of the first, a half of the second, a half of the third), 4 choices.

Distinct fingerprints that share a key are compared, within their bucket, by XOR and
bit count.  A bucket emits the edges of a spanning forest of its true links, so its
output is linear in its size.  A bucket too large to compare in one task is cut again
by eighths of the remaining bits.  Classes are found over distinct fingerprints by
alternating large-star and small-star steps.

Defined results
* A null text has no words; a text without words has the fingerprint zero and links like any other.
* Equal texts have equal fingerprints and one class; rows that repeat an id each get their row.
* A null id never names a class; a class of null ids only has the class id null.
* An empty table gives an empty result with the same schema.
* Only the named columns are read, so others, whatever their names, do not clash.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.plans.staging import staged

#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
LINK_BITS = 3
SEED = 42
#: Fingerprints of a bucket that are compared in one task; larger buckets are cut again.
BUCKET = 4_096
#: Generator polynomial of the Golay code (23, 12): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split() if text else []  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


@cache
def golay_index() -> np.ndarray:
    """For each 23-bit word the 12-bit index of the codeword within 3 bits of it."""
    errors = np.zeros(2048, dtype=np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    patterns = np.array(patterns, dtype=np.int64)
    errors[syndrome(patterns)] = patterns
    words = np.arange(1 << 23, dtype=np.int64)
    return ((words ^ errors[syndrome(words)]) >> 11).astype(np.uint16)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def golay_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codeword indices of each segment and its one-bit neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int64)
    found = np.sort(golay_index()[segment[:, None] ^ flips[None, :]].astype(np.int64), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of each fingerprint; a key has 38 bits, of which the top 4 name its kind."""
    word = prints.view(np.uint64)
    parts = [((word >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    fuzzy = [golay_keys(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    rows, keys, kind = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, key = fuzzy[j]
                rows.append(row)
                keys.append(kind << 34 | parts[i][row] << 12 | key)
                kind += 1
    halves = [(p & 0x7FF, p >> 11) for p in parts[1:]]
    row, key = fuzzy[0]
    for b in halves[0]:
        for c in halves[1]:
            rows.append(row)
            keys.append(kind << 34 | b[row] << 23 | c[row] << 12 | key)
            kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links of at most 3 bits connect; each fingerprint is on at most two."""
    prints = np.unique(prints)
    n = len(prints)
    word = prints.view(np.uint64)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n - 1):
        for j in np.nonzero(np.bitwise_count(word[i + 1 :] ^ word[i]) <= LINK_BITS)[0]:
            a, b = find(i), find(i + 1 + int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    by_root: dict[int, list[int]] = {}
    for i in range(n):
        by_root.setdefault(find(i), []).append(int(prints[i]))
    return [pair for members in by_root.values() for pair in zip(members, members[1:], strict=False)]


def bucket_edges(batches):
    """From rows sorted by key, the forest edges of every key's fingerprints."""
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)

    def close(keys: np.ndarray, prints: np.ndarray):
        if len(keys) < 2:
            return None
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        sizes = np.diff(starts)
        left, right = [], []
        two = starts[:-1][sizes == 2]
        near = np.bitwise_count(prints[two].view(np.uint64) ^ prints[two + 1].view(np.uint64)) <= LINK_BITS
        a, b = prints[two][near], prints[two + 1][near]
        for at, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for x, y in forest(prints[at : at + size]):
                left.append(x)
                right.append(y)
        a, b = np.concatenate([a, np.array(left, np.int64)]), np.concatenate([b, np.array(right, np.int64)])
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, np.asarray(batch.column(0))])
        prints = np.concatenate([held, np.asarray(batch.column(1))])
        if not len(keys):
            continue
        done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        held_keys, held = keys[done:], prints[done:]
        if (out := close(keys[:done], prints[:done])) is not None:
            yield out
    if (out := close(held_keys, held)) is not None:
        yield out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; ``fp`` is the fingerprint as a signed long."""

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                prints = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return narrow.mapInArrow(scan, "id long, fp long")


def link_edges(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: edges between distinct fingerprints ``fp`` that connect exactly what links connect."""

    def emit(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                fp = np.asarray(b.column(0).slice(at, 2048))
                row, key = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = prints.select("fp").mapInArrow(emit, "key long, fp long")
    sizes = staged(keyed.groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
    cuts = [keyed.withColumn("part", F.lit(-1))]
    if not sizes.isEmpty():  # rare: the buckets are cut by each eighth of the word, of which at most 3 have errors
        large = keyed.join(sizes, "key", "left_semi")
        eighths = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("v")) for i in range(8)])
        again = large.select("key", "fp", F.explode(eighths).alias("e")).select("key", "fp", (F.col("e.i") * 256 + F.col("e.v")).cast("int").alias("part"))
        cuts = [keyed.join(sizes, "key", "left_anti").withColumn("part", F.lit(-1)), again]
    rows = cuts[0] if len(cuts) == 1 else cuts[0].unionByName(cuts[1])
    mixed = rows.select(F.when(F.col("part") < 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "fp")
    found = mixed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_edges, "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the least node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each over a table
    staged in the shared folder, until a round changes nothing.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums[0] == 0 or sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = sums
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.select("a", "b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.where("a > b").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: ``component_id`` is the least id that links reach from it."""
    prints = staged(fingerprints(df, id_col, text_col))
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = staged(components(staged(link_edges(classes))).join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "root").join(named, "root").select("fp", "component")
    classes = staged(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the least id stays.

    Rows that repeat that id are one row too: the one with the least text stays.
    Rows with a null id are near-duplicates of their class, and go if it has an id;
    of a class of null ids one row stays.
    """
    marked = near_duplicates(df, id_col, text_col)
    own, key = F.col(f"`{id_col}`"), fresh(df, "keep_id")
    first = marked.where("id is not null and id = component_id").select(F.col("id").alias(key)).distinct()
    stay = df.join(first, own == F.col(key), "left_semi")
    repeated = staged(stay.groupBy(own.alias(key)).count().where(F.col("count") > 1).select(key))
    if not repeated.isEmpty():
        twice = stay.join(repeated, own == F.col(key), "left_semi")
        stay = stay.join(repeated, own == F.col(key), "left_anti").unionByName(one_each(twice, own, text_col))
    unnamed = df.where(own.isNull())
    if not unnamed.isEmpty():
        print_col, node, root = fresh(df, "keep_fp"), fresh(df, "keep_node"), fresh(df, "keep_root")
        alone = staged(marked.where("component_id is null").select("fp").distinct())
        roots = components(staged(link_edges(alone))).select(F.col("node").alias(node), F.col("root").alias(root))
        rows = with_prints(unnamed, text_col, print_col).join(alone.withColumnRenamed("fp", key), F.col(print_col) == F.col(key), "left_semi")
        rows = rows.join(roots, F.col(print_col) == F.col(node), "left")
        stay = stay.unionByName(one_each(rows, F.coalesce(F.col(root), F.col(print_col)), text_col).select(*[F.col(f"`{c}`") for c in df.columns]))
    return stay


def one_each(df: DataFrame, key, text_col: str) -> DataFrame:
    """Of the rows that share a key, the one with the least text."""
    n = fresh(df, "keep_n")
    order = Window.partitionBy(key).orderBy(F.col(f"`{text_col}`").asc_nulls_last())
    return df.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)


def with_prints(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with its fingerprints."""
    place = df.columns.index(text_col)

    def scan(batches):
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py().encode() if t.is_valid else None) for t in b.column(place)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], names=[*b.schema.names, name])

    return df.mapInArrow(scan, df.select("*", F.lit(0).cast("long").alias(name)).schema)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
