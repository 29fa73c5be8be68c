"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by a hash of their id into blocks, and its
quota of blocks is fixed exactly: whole passes over all its blocks, then blocks
in permuted order until the target is met, the last one in part.  A binary tree
splits the drawn blocks among the output shards: each node hands a uniformly
random subset of fixed size to its left child, so the counts by source that a
shard gets are a multivariate-hypergeometric draw, exact in total and without a
block in two shards.  Documents follow their blocks and are ordered within a
shard by a hash.  All of it is DataFrame expressions.

Defined results
* A null source is a source of its own, the last in order; a null or blank text has the size 0.
* A source of size 0 has the target 0; a document of size 0 is taken like any other, for 0 words.
* Rows that repeat an id are separate documents that are drawn alike; a null id is hashed as the text "null".
* An empty table gives an empty result with the same schema.
* Other columns, whatever their names, do not clash; in :func:`mixed_rows`, columns named as the two that it adds give way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.plans.staging import join_small, small, staged

#: Rows of a table about sources or blocks up to which it is broadcast (some tens of bytes each).
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSpec:
    """What a mix is to be: share of all words, weights that repeat over the sources in order, and the cap on a source."""

    share: float = 1.5
    weights: tuple[int, ...] = (5, 2, 1)
    most: float = 2.0
    shards: int = 16
    block_words: int = 65_536
    max_blocks: int = 4_096
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """A non-negative 60-bit number from MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """From (skey, total), one row a source: (skey, total, target).

    Targets are ``min(most * total, level * weight)``; the water level makes them
    sum to ``share`` of all words, which is where resharing the excess by weight
    ends.  The table has a row for each source.
    """
    order = Window.orderBy(F.when(F.col("skey") == "n", 1).otherwise(0), "skey")
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    ranked = sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(spec.weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("total") * F.lit(spec.most)).withColumn("need", F.col("cap") / F.col("w"))
    rising = Window.orderBy("need", "skey")
    everything = Window.partitionBy()
    ranked = ranked.withColumn("goal", F.sum("total").over(everything) * F.lit(spec.share))
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("goal") - F.col("spent")) / F.col("left")
    ranked = ranked.withColumn("level", F.min(F.when(level <= F.col("need"), F.struct(F.col("need").alias("at"), F.col("skey").alias("by"), level.alias("level")))).over(everything)["level"])
    return ranked.select("skey", "total", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def block_plan(narrow: DataFrame, spec: MixSpec) -> tuple[tuple[DataFrame, bool], tuple[DataFrame, bool]]:
    """From staged rows (skey, size, h), two staged tables, each with whether it may be broadcast.

    The first has a row for each source, with its target and its number of blocks; the
    second one for each block that is drawn, with its passes and their shards, and where the partial pass ends.
    """
    totals, sources_fit = small(source_targets(narrow.groupBy("skey").agg(F.sum("size").alias("total")), spec), BROADCAST_ROWS)
    totals = totals.select(
        "*",
        F.greatest(F.lit(1), F.least(F.lit(spec.max_blocks), F.ceil(F.col("total") / spec.block_words))).cast("long").alias("blocks"),
        F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("int").alias("full"),
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("total"))
    placed = join_small(narrow, totals, sources_fit, ["skey"]).withColumn("block", F.col("h") % F.col("blocks"))

    # the partial pass: blocks in permuted order up to the one that the target falls in
    blocks = placed.groupBy("skey", "block").agg(F.sum("size").alias("words"), F.max("full").alias("full"), F.max("rest").alias("rest"))
    order = Window.partitionBy("skey").orderBy(hash60(F.lit(spec.seed), F.lit("block"), "skey", F.col("block").cast("string")), "block")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("due", F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.col("rest") - F.col("before"))))
    blocks = blocks.withColumn("part", (F.col("due") > 0) & (F.col("due") < F.col("words")))
    blocks, fits = small(blocks.select("skey", "block", "words", "full", "due", "part"), BROADCAST_ROWS)

    # within that block, long documents take their share of what is due and short ones the rest, each in hash order
    edge = F.broadcast(blocks.where("part")) if fits else blocks.where("part")
    rows = placed.select("skey", "block", "size", "h").join(edge, ["skey", "block"])
    rows = rows.withColumn("long", F.col("size") * 16 > F.col("words"))
    line = Window.partitionBy("skey", "block", "long").orderBy("h", "size")
    rows = rows.withColumn("upto", F.sum("size").over(line) - F.col("size") / 2)
    by_block = Window.partitionBy("skey", "block")
    rows = rows.withColumn("long_due", F.sum(F.when(F.col("long"), F.col("size"))).over(by_block) * F.col("due") / F.col("words"))
    rows = rows.withColumn("long_in", F.coalesce(F.col("long") & (F.col("upto") <= F.col("long_due")), F.lit(False)))
    rows = rows.withColumn("short_due", F.col("due") - F.coalesce(F.sum(F.when(F.col("long_in"), F.col("size"))).over(by_block), F.lit(0)))
    rows = rows.withColumn("short_in", ~F.col("long") & (F.col("upto") <= F.col("short_due")))
    cuts = rows.groupBy("skey", "block").agg(
        F.coalesce(F.max(F.when(F.col("long_in"), F.col("h"))), F.lit(-1)).alias("long_cut"),
        F.coalesce(F.max(F.when(F.col("short_in"), F.col("h"))), F.lit(-1)).alias("short_cut"),
    )

    # the drawn blocks, one row for each pass, split among the shards
    passes = F.filter(F.sequence(F.lit(0), F.col("full")), lambda p: (p < F.col("full")) | (F.col("due") > 0))
    drawn = blocks.select("skey", "block", "full", F.explode(passes).alias("pass"))
    drawn = drawn.select("skey", "block", "pass", (F.col("pass") == F.col("full")).alias("partial"))
    shard_of = split_tree(drawn, spec).groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "partial"))).alias("drawn"))
    plan = blocks.select("skey", "block", "words", "part").join(cuts, ["skey", "block"], "left").join(shard_of, ["skey", "block"], "left")
    return (totals, sources_fit), small(plan, BROADCAST_ROWS)


def with_draws(rows: DataFrame, tables, skey: str, size: str, h: str, totals: str, draws: str) -> DataFrame:
    """``rows`` with its source's (total, target) as the struct ``totals``, and ``draws``: (pass, shard) of each copy in the mix.

    What is drawn follows from a row's source, block, hash and size, so whole rows meet two small tables and are not dealt anew.
    """
    (sources, sources_fit), (plan, plan_fits) = tables
    one, block, two = fresh(rows, "mix_source"), fresh(rows, "mix_block"), fresh(rows, "mix_plan")
    own, key, place = fresh(rows, "mix_own"), fresh(rows, "mix_key"), fresh(rows, "mix_place")
    sources = sources.select(F.col("skey").alias(own), F.struct("total", "target", "blocks").alias(one))
    plan = plan.select(F.col("skey").alias(key), F.col("block").alias(place), F.struct("words", "part", "long_cut", "short_cut", "drawn").alias(two))
    out = rows.withColumnRenamed(skey, own).join(F.broadcast(sources) if sources_fit else sources, own).withColumn(block, F.col(h) % F.col(f"{one}.blocks"))
    out = out.withColumnsRenamed({own: key, block: place}).join(F.broadcast(plan) if plan_fits else plan, [key, place])
    inside = F.col(h) <= F.when(F.col(size) * 16 > F.col(f"{two}.words"), F.col(f"{two}.long_cut")).otherwise(F.col(f"{two}.short_cut"))
    keep = F.filter(F.coalesce(F.col(f"{two}.drawn"), F.expr("array()").cast("array<struct<pass:int,shard:int,partial:boolean>>")), lambda d: ~d["partial"] | ~F.col(f"{two}.part") | F.coalesce(inside, F.lit(False)))
    kept = F.transform(keep, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    return out.withColumns({totals: F.struct(f"{one}.total", f"{one}.target"), draws: kept}).withColumnRenamed(key, skey).drop(one, two, place)


def split_tree(drawn: DataFrame, spec: MixSpec) -> DataFrame:
    """Adds ``shard`` to the drawn blocks.

    A node over shards [low, high) with b blocks hands a random subset of
    round(b * left / all) of them to the shards of its left half.  The table has a
    row for each drawn block, at most ``max_blocks`` a source and pass.
    """
    levels = (spec.shards - 1).bit_length()
    tree = drawn.withColumn("low", F.lit(0)).withColumn("high", F.lit(spec.shards))
    for level in range(levels):
        node = Window.partitionBy("low", "high")
        key = hash60(F.lit(spec.seed), F.lit(f"tree{level}"), "skey", F.col("block").cast("string"), F.col("pass").cast("string"))
        half = ((F.col("low") + F.col("high")) / 2).cast("int")
        tree = tree.withColumn("rank", F.row_number().over(node.orderBy(key, "skey", "block", "pass"))).withColumn("all", F.count("*").over(node))
        left = F.round(F.col("all") * (half - F.col("low")) / (F.col("high") - F.col("low")))
        goes_left = (F.col("rank") <= left) | (F.col("high") - F.col("low") == 1)
        tree = tree.withColumns({"low": F.when(goes_left, F.col("low")).otherwise(half), "high": F.when(goes_left, F.when(F.col("high") - F.col("low") == 1, F.col("high")).otherwise(half)).otherwise(F.col("high"))})
    return tree.select("skey", "block", "pass", "partial", F.col("low").alias("shard"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", spec: MixSpec = MixSpec()) -> DataFrame:
    """One row per row of ``df``: id, source_key, size, source_size, target, draws (its copies: pass and shard)."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    narrow = staged(
        df.select(
            F.col(f"`{id_col}`").alias("id"), source_key(F.col(f"`{source_col}`").cast("string")).alias("skey"),
            word_count(F.col(f"`{text_col}`")).alias("size"), hash60(F.lit(spec.seed), key).alias("h"),
        )
    )
    out = with_draws(narrow, block_plan(narrow.select("skey", "size", "h"), spec), "skey", "size", "h", "totals", "draws")
    return out.select("id", F.col("skey").alias("source_key"), "size", F.col("totals.total").cast("long").alias("source_size"), F.col("totals.target").cast("double").alias("target"), "draws")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", spec: MixSpec = MixSpec(), shard_col: str = "mix_shard", order_col: str = "mix_order") -> DataFrame:
    """The mix itself: a row of ``df`` for each copy drawn, with its shard and its place in the shard's order.

    Rows are grouped by shard and in hash order within it: write the result
    partitioned by ``shard_col``, or drop the two columns to read it as it lies.
    """
    rows = df.drop(shard_col, order_col)
    skey, size, h, draws, one, totals = (fresh(rows, x) for x in ("mix_skey", "mix_size", "mix_h", "mix_draws", "mix_draw", "mix_totals"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    sized = rows.withColumns({skey: source_key(F.col(f"`{source_col}`").cast("string")), size: word_count(F.col(f"`{text_col}`")), h: hash60(F.lit(spec.seed), key)})
    tables = block_plan(staged(sized.select(F.col(skey).alias("skey"), F.col(size).alias("size"), F.col(h).alias("h"))), spec)
    out = with_draws(sized, tables, skey, size, h, totals, draws).withColumn(one, F.explode(draws)).drop(totals)
    out = out.withColumn(shard_col, F.col(f"{one}.shard")).withColumn(order_col, hash60(F.lit(spec.seed), F.lit("order"), F.col(f"{one}.pass").cast("string"), F.col(h).cast("string")))
    out = out.drop(skey, size, h, draws, one)
    return out.repartition(shard_col, F.col(order_col) % 64).sortWithinPartitions(shard_col, order_col)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, by source weights 5, 2, 1; ``shards`` are those of a document's copies, by pass."""
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), shards.alias("shards"))


def tree_sql(levels: int = 4) -> str:
    """The splitting tree over 16 shards, a table for each level."""
    parts = []
    for level in range(levels):
        key = f"('0x' || substr(md5('mix:tree{level}:' || skey || ':' || block::VARCHAR || ':' || pass::VARCHAR), 1, 15))::BIGINT"
        parts.append(f"""t{level + 1} AS (SELECT skey, block, pass, low + CASE WHEN k <= round(a / 2.0) THEN 0 ELSE {1 << levels - 1 - level} END AS low
        FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY {key}, skey, block, pass) AS k, count(*) OVER (PARTITION BY low) AS a FROM t{level}))""")
    return ",\n".join(parts)


#: The quotas, the permuted blocks and the splitting tree, by windows.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS total FROM d GROUP BY skey),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY (skey = 'n')::INT, skey) - 1) % 3 + 1)::INT]::DOUBLE AS w, total * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS need, (SELECT sum(total) FROM s0) * 1.5::DOUBLE AS goal FROM s1),
s3 AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY need, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY need, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT skey, total, least(cap, coalesce((SELECT arg_min(level, struct_pack(a := need, b := skey)) FROM s3 WHERE level <= need) * w, cap)) AS target FROM s3),
s AS (SELECT *, greatest(1, least(4096, ceil(total / 65536)))::BIGINT AS blocks, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::INT AS fulls FROM s4),
p AS (SELECT d.*, s.total, s.target, s.fulls, s.target - s.fulls * s.total AS rest, d.h % s.blocks AS block FROM d JOIN s USING (skey)),
b0 AS (SELECT skey, block, sum(size)::BIGINT AS words, max(rest) AS rest FROM p GROUP BY ALL),
b1 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY skey ORDER BY ('0x' || substr(md5('mix:block:' || skey || ':' || block::VARCHAR), 1, 15))::BIGINT, block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM b0),
b AS (SELECT skey, block, words, greatest(0, least(words, rest - upto)) AS due FROM b1),
r0 AS (SELECT p.*, b.words, b.due, p.size * 16 > b.words AS big FROM p JOIN b USING (skey, block)),
r1 AS (SELECT *, sum(size) OVER (PARTITION BY skey, block, big ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS mid,
              coalesce(sum(CASE WHEN big THEN size END) OVER (PARTITION BY skey, block), 0) * due / nullif(words, 0) AS big_due FROM r0),
r2 AS (SELECT *, sum(CASE WHEN big AND mid <= big_due THEN size ELSE 0 END) OVER (PARTITION BY skey, block) AS big_in FROM r1),
c AS (SELECT skey, block, max(h) FILTER (big AND mid <= big_due) AS big_cut, max(h) FILTER (NOT big AND mid <= due - big_in) AS cut FROM r2 GROUP BY ALL),
t0 AS (SELECT skey, block, unnest(range(0, fulls + (due > 0)::INT)) AS pass, 0 AS low FROM b JOIN s USING (skey)),
TREE,
g AS (SELECT skey, block, list(low ORDER BY pass) AS dealt FROM t4 GROUP BY ALL),
f AS (SELECT r2.*, fulls + CASE WHEN due <= 0 THEN 0 WHEN due >= words THEN 1 WHEN h <= coalesce(CASE WHEN big THEN big_cut ELSE cut END, -1) THEN 1 ELSE 0 END AS copies
      FROM r2 JOIN c USING (skey, block))
SELECT doc_id, size, total AS source_size, target, (size * copies)::BIGINT AS taken, coalesce(array_to_string(dealt[1:copies], ','), '') AS shards
FROM f LEFT JOIN g USING (skey, block)
""".replace("TREE", tree_sql())
