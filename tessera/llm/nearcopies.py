"""Near copies by SimHash: texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

The operator of :mod:`tessera.llm.simhash` links fingerprints at 3 of 64 bits, which
finds texts that are nearly equal; at a similarity of 0.8 some 10 of 64 bits differ.
So this form takes a wider SimHash and decodes it softly.

Fingerprint.  Every distinct shingle's hash votes for or against each of 23 bits of every
segment; the votes' sums are kept as numbers.  A segment is decoded to the codewords of the binary Golay code
(23, 12, 7) that agree best with the sums, so a bit that is nearly tied costs little:
similar texts share a codeword far more often than with sums cut to bits.

Keys.  Segments stand in triples, and a group's keys are the ``PER_GROUP`` best
combinations of one codeword of each of its segments.  By pigeonhole, two texts meet if the
errors leave one group of all without a miss.  A key has 36 bits besides its group, so buckets of unrelated texts stay
small in large tables too, and one layout serves every size: whether two texts meet depends on them alone.
Measured on pairs among 25,000 distinct texts of the 0.1 GB tables (2,191 of similarity 0.8 or more):
24 keys of each of eight triples find 0.998 of those from 0.80 to 0.82 and 0.9995 of all.

Links.  Rows (key, text) are dealt once, by key, and streamed; only the keys that several texts have are dealt again.
Pairs whose 128-bit sketches differ in more than ``SKETCH`` bits are no candidates, so texts that share a key by chance
are not compared.  Candidates are verified on the whole shingle sets.  First come ``ROUNDS`` in which each text
meets one other, of the first texts of its buckets the one nearest by sketch; every round takes another order and
knows the classes of those before, so a group of n copies costs a few times n pairs, not those of all its keys.
Where a bucket is not one class then, its texts are compared in full.  Those of at most ``FEW`` texts give all their pairs
across classes.  Larger ones that share texts form a family, a family is cut into
blocks, and each pair of blocks is compared in one task that emits links only.  No candidate
is dropped, no pairs of a whole group are made as rows, and joins have rows of texts or candidate pairs, not of keys.

Whole texts move only if they are compared or may go: a bitmap of ``MARKS`` bits, whatever the
table's size, tells the others apart where they lie, and the exact join decides on what it lets through.

A class is what links reach, and one row of it stays.

Defined results
* Texts are compared in lower case with single spaces, without those at the ends.
* Texts of fewer than five words have one shingle; texts without words (or null) are equal.
* Of a class the row with the least id stays, null ids last; of rows with that id the least text.
* An empty table gives an empty result with the same schema; other columns, whatever their names, do not clash.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.llm.simhash import GENERATOR, components, one_each
from tessera.plans.staging import discard, staged

WIDTH, LEAST, SEED = 5, 0.8, 42
#: Bits of a segment, and codewords of it that keys are made of.
BITS, CODEWORDS = 23, 6
#: Groups of segments and keys of each, the same for any number of texts.
GROUPS, PER_GROUP = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(8)], 24
#: Once the number of texts from which on keys had three segments, as they now always have. Nothing reads it but a test that sets it.
WIDE = 1 << 26
#: Differing bits of 128 up to which a candidate is verified: unrelated texts differ in 64, standard deviation 6.
SKETCH = 50
#: Bits of the bitmap of texts, at most 4 MB to each executor.
MARKS = 1 << 25
#: Texts of a bucket of which all pairs are candidates, and texts of a block of a family.
FEW, BLOCK = 8, 256
#: Times that each text meets one other before buckets are compared in full.
ROUNDS = 2
#: Texts whose fingerprints are decoded together, and texts that a task remembers so as not to repeat them.
BATCH, SEEN = 16, 200_000


def layout(n: int) -> tuple[list[tuple[int, ...]], int]:
    """(groups of segments, keys of each group) for so many distinct texts: the same for all, so that a pair is found in any table or in none."""
    return GROUPS, PER_GROUP


def plain(text_col: str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"\s+", " ")), F.lit(""))


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the shingles of a text with single spaces."""
    words = text.encode().split(b" ")
    parts = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)) if len(words) > WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), dtype=np.uint64))


@cache
def codewords() -> np.ndarray:
    """The 4,096 codewords of the Golay code as rows of +1 and -1."""
    words = []
    for index in range(1 << 12):
        word = 0
        for bit in range(12):
            if index >> bit & 1:
                word ^= GENERATOR << bit
        words.append(word)
    return ((np.array(words)[:, None] >> np.arange(BITS)) & 1).astype(np.float32) * 2 - 1


def votes(hashes: np.ndarray, segments: int) -> np.ndarray:
    """(segment, bit): how many more hashes have the bit than not; two segments for each mixed 64-bit word."""
    out = np.empty((segments, BITS), dtype=np.float32)
    for i in range(segments // 2):
        with np.errstate(over="ignore"):
            z = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(z), 65_536):
            ones += np.unpackbits(z[at : at + 65_536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[2 * i : 2 * i + 2] = (2 * ones[: 2 * BITS] - len(z)).reshape(2, BITS)
    return out


def fuzzy_keys(sums: np.ndarray, groups: list[tuple[int, ...]], per_group: int) -> np.ndarray:
    """(text, key) of votes (text, segment, bit): for each group its best combinations of codewords."""
    n, segments, _ = sums.shape
    scores = sums.reshape(-1, BITS) @ codewords().T
    best = np.argpartition(-scores, CODEWORDS, axis=1)[:, :CODEWORDS]
    value = np.take_along_axis(scores, best, axis=1)
    order = np.lexsort((best, -value), axis=1)
    best, value = (np.take_along_axis(x, order, axis=1).reshape(n, segments, CODEWORDS) for x in (best.astype(np.int64), value))
    # a combination that leaves out many better ones cannot be among the best
    combos = np.array([c for c in product(range(CODEWORDS), repeat=len(groups[0])) if np.prod(np.array(c) + 1) <= 3 * per_group])
    keys = []
    for number, group in enumerate(groups):
        cost, key = np.zeros((n, len(combos)), dtype=np.float32), np.full((n, len(combos)), number, dtype=np.int64)
        for i, segment in enumerate(group):
            cost += (value[:, segment, :1] - value[:, segment, :])[:, combos[:, i]]
            key = key << 12 | best[:, segment, :][:, combos[:, i]]
        keys.append(np.take_along_axis(key, np.argpartition(cost, per_group - 1, axis=1)[:, :per_group], axis=1))
    return np.concatenate(keys, axis=1)


def fingerprints(texts: DataFrame, groups: list[tuple[int, ...]], per_group: int) -> DataFrame:
    """(node, s0, s1, keys) of ``texts`` (node, t): sketch and keys of each text; repeated texts may repeat their rows."""
    segments = 1 + max(map(max, groups))

    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, rows = [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    rows.append(votes(shingles(t.as_py()), segments))
                if len(rows) == BATCH:
                    yield made(nodes, rows)
                    nodes, rows = [], []
            if rows:
                yield made(nodes, rows)

    def made(nodes: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        sums = np.stack(rows)
        keys = fuzzy_keys(sums, groups, per_group)
        sketch = np.packbits(sums.reshape(len(rows), -1)[:, :128] > 0, axis=1, bitorder="little").view("<i8")
        keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), keys], names=["node", "s0", "s1", "keys"])

    return texts.mapInArrow(emit, "node long, s0 long, s1 long, keys array<long>")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def bucket_rows(batches, few: int | None = None):
    """From rows (key, node, s0, s1) sorted by key and node: candidate pairs (kind 0: a, b) and the rows of large buckets (kind 1: a is the node, b the bucket's first).

    A bucket of at most ``few`` texts (FEW) gives all its pairs whose sketches are near, a larger one
    those with its first text; rows without sketches are all near.  Rows may also have a root and a family: texts that share one are no candidates.
    With ``few`` 1 only the rows of buckets of several texts come.  What is held between batches is at most ``few`` rows, or the first one of a large bucket.
    """
    few = few or FEW
    held, large = None, False

    def pairs(rows: np.ndarray, going_on: bool, open_end: bool) -> pa.RecordBatch:
        """``rows`` (6, n) of whole buckets; the first may go on from before, and the last, if large, may go on."""
        key, node, root, family = rows[0], rows[1], rows[4], rows[5]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        first = np.nonzero(start)[0]
        big = size > few
        big[0] |= going_on
        big[-1] |= open_end
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, few):
            i = np.nonzero((key[:-step] == key[step:]) & ~big[run[:-step]])[0] if len(key) > step else np.zeros(0, np.int64)
            left.append(i)
            right.append(i + step)
        of_big = np.nonzero(big[run])[0]
        if few > 1:
            left.append(first[run[of_big]])
            right.append(of_big)
        left, right = np.concatenate(left), np.concatenate(right)
        d = differing(rows[2][left], rows[2][right]) + differing(rows[3][left], rows[3][right])
        near = (d <= SKETCH) & (node[left] != node[right]) & (root[left] != root[right]) & (family[left] != family[right])
        left, right = node[left[near]], node[right[near]]
        kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(left), len(of_big)])
        none = np.zeros(len(left), dtype=np.int64)
        columns = [np.concatenate([np.minimum(left, right), node[of_big]]), np.concatenate([np.maximum(left, right), node[first[run[of_big]]]])]
        columns += [np.concatenate([none, x[of_big]]) for x in (key, rows[2], rows[3])]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "a", "b", "key", "s0", "s1"])

    for batch in batches:
        missing = {c: np.zeros(batch.num_rows, np.int64) for c in ("s0", "s1")} | dict.fromkeys(("root", "family"), batch.column("node"))
        rows = np.stack([np.asarray(batch.column(c) if c in batch.schema.names else missing[c]) for c in ("key", "node", "s0", "s1", "root", "family")])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        fresh_row = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])  # repeated texts may repeat rows
        rows = rows[:, fresh_row]
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        open_end = rows.shape[1] - last > few or (large and last == 0)
        done = rows if open_end else rows[:, :last]
        if done.shape[1]:
            yield pairs(done, large, open_end)
        held, large = rows[:, last : last + 1] if open_end else rows[:, last:], open_end
    if held is not None and not large and held.shape[1] > 1:
        yield pairs(held, False, False)


def marks(nodes: DataFrame) -> DataFrame:
    """Staged (mark_bucket, mark_bits): a bitmap of the distinct ``nodes`` (node), at most MARKS bits in rows of 4 KB."""
    bit = F.col("node").bitwiseAND(F.lit(MARKS - 1))
    rows = nodes.select(F.bitmap_bucket_number(bit).alias("mark_bucket"), F.bitmap_bit_position(bit).alias("at")).repartition("mark_bucket")
    return staged(rows.groupBy("mark_bucket").agg(F.bitmap_construct_agg("at").alias("mark_bits")))


def by_marks(rows: DataFrame, node: str, marked: DataFrame, how: str) -> DataFrame:
    """The rows whose node has a mark (``left_semi``; other nodes may share it) or none (``left_anti``)."""
    marked = marked.withColumnsRenamed(keys := {c: fresh(rows, c) for c in ("mark_bucket", "mark_bits")})
    bit = F.col(f"`{node}`").bitwiseAND(F.lit(MARKS - 1))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(keys["mark_bits"]), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return rows.join(F.broadcast(marked), (F.bitmap_bucket_number(bit) == F.col(keys["mark_bucket"])) & there, how)


def shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged (node, s): the shingle hashes of the texts of ``nodes``, distinct ones."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["node", "s"])

    # copies of a text end where they lie, before anything is dealt by node
    wanted = by_marks(texts, "node", marks(nodes), "left_semi").groupBy("node").agg(F.first("t").alias("t")).join(nodes, "node", "left_semi")
    return staged(wanted.mapInArrow(sets, "node long, s array<long>"))


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    overlap = F.size(F.array_intersect("x", "y"))
    return both.where(overlap >= LEAST * (F.size("x") + F.size("y") - overlap)).select("a", "b")


def bucketed(rows: DataFrame, few: int) -> DataFrame:
    """:func:`bucket_rows` of ``rows``, which are dealt by key."""

    def emit(batches):
        return bucket_rows(batches, few)

    return rows.sortWithinPartitions("key", "node").mapInArrow(emit, "kind int, a long, b long, key long, s0 long, s1 long").select("kind", "a", "b", "key")


def candidates(rows: DataFrame) -> DataFrame:
    """(node) of the distinct texts of ``rows``, which are dealt by key, that are in a near pair or a large bucket."""
    few = FEW

    def emit(batches):
        for found in bucket_rows(batches, few):
            kind, a, b = (np.asarray(found.column(c)) for c in ("kind", "a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b[kind == 0]])))], names=["node"])

    return rows.sortWithinPartitions("key", "node").mapInArrow(emit, "node long").distinct()


def dealt(meeting: DataFrame) -> DataFrame:
    """A row for each of the ``keys`` of a text, all of a key in one place."""
    return meeting.withColumn("key", F.explode("keys")).drop("keys").repartition("key")


def rooted(meeting: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``meeting`` (node, keys, s0, s1) with the root of each text's class, itself if it has none yet."""
    if classes is None:
        return meeting.withColumn("root", F.col("node"))
    return meeting.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def leads(meeting: DataFrame, classes: DataFrame | None, salt: int) -> DataFrame:
    """(a, b): each text with that of its buckets' first texts, in the order of ``salt``, that is nearest by sketch, not of its class and a candidate."""
    order = F.struct(F.xxhash64("node", F.lit(salt)).alias("at"), "node", "root", "s0", "s1")
    met = dealt(rooted(meeting, classes)).withColumn("lead", F.min(order).over(Window.partitionBy("key"))).where("root <> lead.root")
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("lead.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("lead.s1")))
    found = met.select("node", F.struct(differ.alias("d"), F.col("lead.node").alias("lead")).alias("met")).where(F.col("met.d") <= SKETCH)
    found = found.groupBy("node").agg(F.min("met").alias("met")).select("node", F.col("met.lead").alias("lead"))
    return found.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def open_rows(rows: DataFrame) -> DataFrame:
    """The rows of buckets that are not one class, with the number of texts (n) and the least (lo)."""
    bucket = Window.partitionBy("key")
    rows = dealt(rows).withColumns({"r0": F.min("root").over(bucket), "r1": F.max("root").over(bucket), "n": F.count("*").over(bucket), "lo": F.min("node").over(bucket)})
    return rows.where("r0 <> r1").drop("r0", "r1")


def families(rows: DataFrame) -> DataFrame | None:
    """Staged (node, family) of the texts that large open buckets connect; None if there are none.

    A text names the least text of each of its buckets, and the least of these stands for them, so no row of a bucket is joined.
    """
    large = staged(open_rows(rows).where(F.col("n") > FEW).groupBy("node").agg(F.min("lo").alias("b"), F.collect_set("lo").alias("lows")))
    if large.isEmpty():
        return None
    edges = large.select(F.col("node").alias("a"), "b").unionByName(large.select(F.explode("lows").alias("a"), "b")).where("a <> b").distinct()
    return staged(components(staged(edges)).withColumnRenamed("root", "family"))


def family_links(members: DataFrame, held: DataFrame) -> DataFrame:
    """Links between the texts of a family (node, family, root, s0, s1) that are not of one class yet."""
    members = members.join(members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")), "family")
    own = F.pmod(F.xxhash64("node"), F.col("m").cast("long")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = members.join(held, "node").select("family", "i", "j", "own", "node", "root", "s0", "s1", "s")

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        node, root, side, s0, s1 = (np.asarray(block.column(c)) for c in ("node", "root", "own", "s0", "s1"))
        first, second = int(block.column("i")[0].as_py()), int(block.column("j")[0].as_py())
        sets = [np.asarray(s.values) for s in block.column("s")]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        left, right = [], []
        for x in range(len(node) - 1):
            d = differing(s0[x + 1 :], s0[x]) + differing(s1[x + 1 :], s1[x])
            ok = (d <= SKETCH) & (root[x + 1 :] != root[x])
            if first != second:  # pairs within a block belong to its own task
                ok &= side[x + 1 :] != side[x]
            for y in (np.nonzero(ok)[0] + x + 1).tolist():
                a, b = find(int(root[x])), find(int(root[y]))
                if a != b:
                    overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if overlap >= LEAST * (len(sets[x]) + len(sets[y]) - overlap):
                        up[max(a, b)] = min(a, b)
                        left.append(int(node[x]))
                        right.append(int(node[y]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def similar_classes(texts: DataFrame, n: int) -> DataFrame:
    """(node, root) for the nodes of ``texts`` (node, t), ``n`` distinct ones, that have near copies: ``root`` is the least node of the class."""
    groups, per_group = layout(n)
    prints = staged(fingerprints(texts, groups, per_group))
    several = bucketed(prints.select(F.explode("keys").alias("key"), "node").repartition("key"), 1)
    several = several.groupBy(F.col("a").alias("node")).agg(F.collect_set("key").alias("keys"))
    sharing = staged(several.join(prints.groupBy("node").agg(F.first("s0").alias("s0"), F.first("s1").alias("s1")), "node"))
    discard(prints)
    nodes = staged(candidates(dealt(sharing)))
    meeting = staged(sharing.join(nodes, "node", "left_semi"))  # without those that only meet by chance
    held = shingle_sets(texts, nodes)
    links, classes = [], None
    for salt in range(ROUNDS):
        links.append(staged(verified(leads(meeting, classes, salt), held)))
        classes = staged(components(reduce(DataFrame.unionByName, links)))
    rows = rooted(meeting, classes)
    if (family := families(rows)) is not None:
        links.append(staged(family_links(rows.drop("keys").join(family, "node"), held)))
        rows = rows.join(family, "node", "left")
    else:
        rows = rows.withColumn("family", F.lit(None).cast("long"))
    rows = rows.withColumn("family", F.coalesce("family", "node"))
    pairs = bucketed(open_rows(rows).where(F.col("n") <= FEW).drop("n", "lo"), FEW).select("a", "b").distinct()
    links.append(staged(verified(pairs, held)))
    classes = components(reduce(DataFrame.unionByName, links))
    discard(sharing, nodes, meeting, held, *links)
    return classes


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each class one row stays."""
    node, id_ = fresh(df, "near_node"), F.col(f"`{id_col}`")
    rows = df.withColumn(node, F.xxhash64(plain(text_col)))
    narrow = staged(rows.select(id_.alias("id"), F.col(node).alias("node")))
    classes = similar_classes(df.select(F.xxhash64(plain(text_col)).alias("node"), plain(text_col).alias("t")), narrow.select("node").distinct().count())
    least = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    named = narrow.groupBy("node").agg(F.min(least).alias("w")).join(classes, "node", "left")
    winners = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("w").alias("w")).select(F.col("w.id").alias("w_id"), F.col("w.node").alias("w_node"))
    keys = {c: fresh(df, c) for c in ("w_id", "w_node")}
    winners = staged(winners.withColumnsRenamed(keys))
    # a text with one row and no near copy stays where it is; the others meet the winners
    doubtful = classes.select("node").unionByName(narrow.groupBy("node").count().where("count > 1").select("node")).distinct()
    doubtful = marks(doubtful)
    alone, rest = (by_marks(rows, node, doubtful, how) for how in ("left_anti", "left_semi"))
    stay = rest.join(winners, (F.col(node) == F.col(keys["w_node"])) & id_.eqNullSafe(F.col(keys["w_id"])), "left_semi")
    repeated = staged(stay.groupBy(F.col(node).alias(keys["w_node"])).count().where(F.col("count") > 1).select(keys["w_node"]))
    if not repeated.isEmpty():  # rows that repeat an id and a text
        on = F.col(node) == F.col(keys["w_node"])
        stay = stay.join(repeated, on, "left_anti").unionByName(one_each(stay.join(repeated, on, "left_semi"), F.col(node), text_col))
    return alone.unionByName(stay).drop(node)
