"""Association rules between keywords, authors and clusters, with sides of one item."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.papers import rule_kind
from tessera.plans.staging import staged

#: Pairs that a task counts before it hands them on.
HELD = 500_000


def transaction(cluster: Column, words: Column, authors: Column, most_authors: int = 5) -> Column:
    """The items of a paper: its cluster, its keywords, its first authors; each once."""
    mark = lambda prefix, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    own = F.when(cluster.isNotNull(), F.array(F.concat(F.lit("cluster:"), cluster.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, mark("keyword:", words), mark("author:", F.slice(authors, 1, most_authors))))


def frequent_pairs(baskets: DataFrame, support: float) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n), a < b: pairs in at least ``support`` of the baskets (txn, items), whose items are distinct.

    Baskets are made once and staged. Items that are not frequent cannot be in a frequent pair and go before pairs are
    made. The frequent ones, of which there are at most a basket's mean size / ``support``, are known to every
    executor by their numbers; pairs are numbers too, counted in each task before the shuffle.
    """
    baskets = staged(baskets.where(F.size("items") >= 2).select("items"))
    n = baskets.count()
    counts = staged(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c")).withColumn("n", F.lit(n)).where(F.col("c") >= F.col("n") * support))
    names = sorted(r.item for r in counts.select("item").collect())
    shared = baskets.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))

    def scan(batches):
        held = Counter()
        for b in batches:
            keys, n_ab = np.unique(pair_keys(b.column(0), shared.value), return_counts=True)
            held.update(dict(zip(keys.tolist(), n_ab.tolist(), strict=True)))
            if len(held) > HELD:
                yield pairs_of(held, shared.value)
                held = Counter()
        yield pairs_of(held, shared.value)

    pairs = baskets.mapInArrow(scan, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    left = counts.select(F.col("item").alias("a"), F.col("c").alias("n_a"), "n")
    right = counts.select(F.col("item").alias("b"), F.col("c").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").where(F.col("n_ab") >= F.col("n") * support).select("a", "b", "n_ab", "n_a", "n_b", "n")


def pair_keys(items: pa.Array, names: pa.Array) -> np.ndarray:
    """first * len(names) + second for each pair of named items in each list, by their places in ``names``, which is sorted."""
    owner = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy(zero_copy_only=False))
    place = pc.fill_null(pc.index_in(items.flatten(), names.cast(items.type.value_type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    keys, lag = [], 1
    while len(at := np.nonzero(owner[lag:] == owner[: len(owner) - lag])[0]):
        keys.append(place[at] * len(names) + place[at + lag])
        lag += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def pairs_of(held: Counter, names: pa.Array) -> pa.RecordBatch:
    keys = np.fromiter(held.keys(), np.int64, len(held))
    sides = [names.take(pa.array(side)) for side in (keys // max(len(names), 1), keys % max(len(names), 1))]
    return pa.RecordBatch.from_arrays([*sides, pa.array(list(held.values()), pa.int64())], names=["a", "b", "n"])


def association_rules(pairs: DataFrame, confidence: float) -> DataFrame:
    """(antecedents, consequents, support, confidence, lift, rule_type), both directions of each pair."""
    side = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b"))
    sides = pairs.select("n_ab", "n", F.inline(F.array(side("a", "b"), side("b", "a"))))  # of one pass: a union would count the pairs twice
    sides = sides.withColumn("confidence", F.col("n_ab") / F.col("n_a")).where(F.col("confidence") >= confidence)
    left, right = F.array("a"), F.array("b")
    return sides.select(
        left.alias("antecedents"), right.alias("consequents"), (F.col("n_ab") / F.col("n")).alias("support"), "confidence",
        (F.col("confidence") / (F.col("n_b") / F.col("n"))).alias("lift"), rule_kind(left, right).alias("rule_type"),
    )


def match_rules(rules: DataFrame, items: list[str], k: int = 10) -> DataFrame:
    """The k rules that fit a context best: overlap * lift * confidence * (1 + support)."""
    shared = F.size(F.array_intersect("antecedents", F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")))
    score = F.col("overlap") * F.col("lift") * F.col("confidence") * (1 + F.col("support"))
    out = rules.withColumn("overlap", shared).where("overlap > 0").withColumn("context_score", score)
    return out.orderBy(F.desc("context_score"), F.desc("lift"), F.desc("confidence"), "antecedents", "consequents").limit(k)


def targets(matched: DataFrame) -> dict[str, list[str]]:
    """Authors, clusters and keywords that matched rules lead to, best rule first; ``matched`` has at most k rows."""
    rows = matched.orderBy(F.desc("context_score"), F.desc("lift"), F.desc("confidence"), "antecedents", "consequents").select("consequents").collect()
    items = dict.fromkeys(x for r in rows for x in r.consequents)
    return {kind: [x.removeprefix(kind + ":") for x in items if x.startswith(kind + ":")] for kind in ("author", "cluster", "keyword")}


def suggest(rules: DataFrame, query: str = "", author: str = "", k: int = 8) -> DataFrame:
    """The k rules of the highest confidence whose left side holds a word of the query, or all words of the author's name; words of over two letters."""
    text = F.lower(F.array_join("antecedents", ", "))
    holds = lambda words: F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    words, names = ([w for w in x.lower().split() if len(w) > 2] for x in (query, author))
    hit = F.exists(holds(words), lambda x: x) if words else F.lit(False)
    if author.strip():
        hit |= F.forall(holds(names), lambda x: x) if names else F.lit(True)
    return rules.where(hit).orderBy(F.desc("confidence"), F.desc("lift"), "antecedents", "consequents").limit(k)


def suggested_papers(pool: DataFrame, suggested: DataFrame, k: int = 10) -> DataFrame:
    """The first k papers whose title or abstract holds a word, of over three letters, that suggested rules lead to; ``suggested`` has at most some rows."""
    items = suggested.select(F.array_join("consequents", ", ").alias("t")).collect()
    words = sorted({w for r in items for w in r.t.lower().split() if len(w) > 3})
    if not words:
        return pool.limit(0)
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "abstract")]
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(fields[0], w) | F.contains(fields[1], w))
    return pool.where(hit).orderBy("paper_id").limit(k)


def browse(rules: DataFrame, confidence: float = 0.0, lift: float = 0.0, kinds: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """Rules at or above both values, of the kinds, that hold any of the words on either side; by lift."""
    text = F.lower(F.concat_ws(" ", F.array_join("antecedents", ", "), F.array_join("consequents", ", ")))
    out = rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    if kinds:
        out = out.where(F.col("rule_type").isin(kinds))
    if words:
        out = out.where(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w)))
    return out.orderBy(F.desc("lift"), "antecedents", "consequents")
