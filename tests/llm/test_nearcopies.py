import random

from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import drop_near_duplicates
from tessera.llm import nearcopies
from tessera.plans import staging


def test_copies_of_similarity_08_go(spark):
    pick = random.Random(7)
    words = [[f"w{pick.randrange(10**6)}" for _ in range(120)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    for i, w in enumerate(words[:4]):  # 10 of 116 shingles differ, so the similarity is 106 / 126
        rows.append((10 + i, " ".join([*w[:30], "new", *w[31:80], "other", *w[81:]])))
    rows += [(20, rows[5][1].upper()), (21, None), (22, ""), (22, " "), (None, "a b c"), (None, "A  b c")]
    rows += [(30, "x"), (30, "y")]  # one id on two texts: both stay
    kept = drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (0, 1, 2, 3, 4, 5, 21, 30, 30)] + [(True, 0)]


def edited(pick, words, n):
    words = list(words)
    for at in pick.sample(range(len(words)), n):
        words[at] = f"e{pick.randrange(10**6)}"
    return words


def families(seed=5):
    """Texts with edits of one to a few words each: some pairs above, some below a similarity of 0.8."""
    pick = random.Random(seed)
    texts = []
    for size in (1, 2, 5, 12, 60, 150):
        for _ in range(6 if size < 60 else 2):
            base = [f"w{pick.randrange(3000)}" for _ in range(pick.choice([7, 40, 90, 200, 400]))]
            texts += [" ".join(edited(pick, base, pick.choice([0, 1, 1, 2, max(1, len(base) // 60)]))) for _ in range(size)]
    return sorted(set(texts))


def brute_classes(texts):
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("wide", [1 << 26, 1])
def test_classes_equal_brute_force(spark, monkeypatch, wide):
    """Buckets of over FEW texts, families cut into blocks, either layout of the keys."""
    monkeypatch.setattr(nearcopies, "WIDE", wide)
    monkeypatch.setattr(nearcopies, "FEW", 3)
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    texts = families()
    df = spark.createDataFrame([(t,) for t in texts] + [(t,) for t in texts[:50]], "t string").select(F.xxhash64("t").alias("node"), "t")
    found = {r.node: r.root for r in nearcopies.similar_classes(df, len(texts)).collect()}
    node = {r.t: r.node for r in df.collect()}
    got, want = {}, {}
    for t, c in zip(texts, brute_classes(texts), strict=True):
        got.setdefault(found.get(node[t], node[t]), set()).add(t)
        want.setdefault(c, set()).add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_codewords_are_seven_apart():
    words = nearcopies.codewords()
    distances = (23 - words @ words.T) / 2
    assert words.shape == (4096, 23) and np.min(distances[distances > 0]) == 7


@pytest.mark.parametrize("size", [7, 100, 10**6])
def test_bucket_rows_equal_brute_force(size):
    """Buckets that end with a batch, go on over several, or repeat rows."""
    pick = np.random.default_rng(2)
    rows = [(int(k), int(n), *[int(x) for x in pick.choice([0, 1, -1, 255, 2**40, -(2**62)], 2)]) for k in range(60) for n in pick.integers(-(2**60), 2**60, size=pick.choice([1, 2, 5, 8, 9, 40, 250]))]
    sketch = {r[1]: r[2:] for r in rows}
    rows = sorted(rows + rows[::3])

    def near(a, b):
        return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sketch[a], sketch[b], strict=True)) <= nearcopies.SKETCH

    pairs, members = set(), set()
    for key, group in groupby(rows, key=lambda r: r[0]):
        nodes = sorted({r[1] for r in group})
        large = len(nodes) > nearcopies.FEW
        members |= {(key, n) for n in nodes} if large else set()
        pairs |= {(a, b) for i, a in enumerate(nodes[:1] if large else nodes) for b in nodes[i + 1 :] if near(a, b)}
    got_pairs, got_members = set(), set()
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + size], strict=True)], names=["key", "node", "s0", "s1"]) for at in range(0, len(rows), size)]
    for batch in nearcopies.bucket_rows(batches):
        for r in batch.to_pylist():
            (got_members.add((r["key"], r["a"])) if r["kind"] else got_pairs.add((r["a"], r["b"])))
    assert got_pairs == pairs and got_members == members


def test_keys_do_not_depend_on_the_size_of_the_table():
    assert nearcopies.layout(10) == nearcopies.layout(nearcopies.WIDE) == nearcopies.layout(1 << 40)


def test_unrelated_texts_share_no_keys():
    """Chance meetings grow with the square of the table."""
    pick = random.Random(11)
    groups, per_group = nearcopies.layout(2000)
    segments = 1 + max(map(max, groups))
    sums = np.stack([nearcopies.votes(nearcopies.shingles(" ".join(f"w{pick.randrange(10**6)}" for _ in range(40))), segments) for _ in range(2000)])
    keys = np.concatenate([np.unique(k) for at in range(0, 2000, 100) for k in nearcopies.fuzzy_keys(sums[at : at + 100], groups, per_group)])
    assert len(keys) - len(np.unique(keys)) <= 5  # two segments a key: some 50


def test_marks_part_rows_by_node(spark):
    pick = random.Random(3)
    nodes = [0, 1, -1, 2**63 - 1, -(2**63), nearcopies.MARKS, nearcopies.MARKS - 1, 32768, 32769] + [pick.randrange(-(2**63), 2**63) for _ in range(300)]
    marked = nodes[:150]
    rows = spark.createDataFrame([(n, str(n)) for n in nodes], "node long, mark_bits string")
    bitmap = nearcopies.marks(spark.createDataFrame([(n,) for n in marked], "node long"))
    bits = {n % nearcopies.MARKS for n in marked}
    for how, inside in (("left_semi", True), ("left_anti", False)):
        found = [r.node for r in nearcopies.by_marks(rows, "node", bitmap, how).collect()]
        assert sorted(found) == sorted(n for n in nodes if (n % nearcopies.MARKS in bits) == inside)


def test_keys_do_not_stay_on_disk(spark):
    began = len(staging._STAGED.get(spark.sparkContext.applicationId, (spark, []))[1])
    rows = [(i, " ".join(f"w{i}x{j % 7}" for j in range(30))) for i in range(20)] + [(20, " ".join(f"w3x{j % 7}" for j in range(30)))]
    kept = drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    left = staging._STAGED[spark.sparkContext.applicationId][1][began:]
    assert not any({"keys", "s", "s0"} & set(spark.read.parquet(path).columns) for path in left)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_staged_tables_start_few_processes(spark):
    """Each checksum file costs a process, which has the executor's memory until it runs its own program."""
    table = staging.staged(spark.range(8).repartition(4))
    files = list(Path(staging._PATHS[table].removeprefix("file:")).iterdir())
    assert any(f.suffix == ".parquet" for f in files) and not [f for f in files if f.suffix == ".crc"]
    assert sorted(r.id for r in table.collect()) == list(range(8))


@pytest.mark.parametrize("size", [5, 64])
def test_rows_of_large_buckets_name_the_first(size):
    """So the rows need not meet a table of the first ones."""
    rows = [(k, n, 0, 0) for k in range(4) for n in range(10 * k, 10 * k + (30 if k % 2 else 3))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + size], strict=True)], names=["key", "node", "s0", "s1"]) for at in range(0, len(rows), size)]
    found = {(r["key"], r["a"], r["b"]) for b in nearcopies.bucket_rows(batches) for r in b.to_pylist() if r["kind"]}
    assert found == {(k, n, 10 * k) for k, n, _, _ in rows if k % 2}


def most_joined(spark, run):
    """The most rows that one join makes while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    began = max((x.executionId() for x in (lambda e: map(e.apply, range(e.size())))(store.executionsList())), default=-1)
    run()
    bus.waitUntilEmpty()
    most = 0
    runs = store.executionsList()
    for number in (runs.apply(i).executionId() for i in range(runs.size())):
        if number > began:
            values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if "Join" in node.name():
                    metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                    rows = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                    most = max([most, *(int(v.get().replace(",", "")) for v in rows if v.isDefined())])
    return most


def test_joins_of_a_large_group_have_few_rows_a_text(spark):
    """A text has 192 keys, and a group of copies meets on nearly all of them; unlike pairs of the group stay to be told apart."""
    pick = random.Random(9)
    base = [f"w{pick.randrange(3000)}" for _ in range(150)]
    texts = sorted({" ".join(edited(pick, base, pick.choice([1, 2, 3, 5, 8]))) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("node"), "t")
    found = {}
    most = most_joined(spark, lambda: found.update({r.node: r.root for r in nearcopies.similar_classes(df, len(texts)).collect()}))
    assert 0 < most <= 12 * len(texts)
    node = {r.t: r.node for r in df.collect()}
    got = [found.get(node[t], node[t]) for t in texts]
    want = brute_classes(texts)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_texts_of_one_class_or_family_are_no_candidates():
    rows = {"key": [1] * 4, "node": [1, 2, 3, 4], "s0": [0] * 4, "s1": [0] * 4, "root": [1, 1, 3, 4], "family": [1, 2, 7, 7]}
    batch = pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in rows.items()})
    found = {(r["a"], r["b"]) for b in nearcopies.bucket_rows([batch]) for r in b.to_pylist()}
    assert found == {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert [r["kind"] for b in nearcopies.bucket_rows([batch], 1) for r in b.to_pylist()] == [1] * 4
