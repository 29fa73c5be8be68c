"""TF-IDF with smoothed idf and unit length, as long tables (doc, term, tf, weight).

Texts are read and cut once: :func:`term_rows` counts the terms of each document inside its row, batch by batch,
and stages them.  Document frequencies are summed in each
partition before they are shuffled, the vocabulary is bounded and broadcast after a count, and lengths
are taken where a document's terms lie together, so no table of all postings is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_keyword, stop_words, tokens
from tessera.plans.staging import join_small, small, staged


@dataclass(frozen=True)
class TfidfSpec:
    """n-grams up to ``most`` words, document frequency from ``min_df`` to the share ``max_df``, and the vocabulary's size by total frequency."""

    most: int = 1
    min_df: int = 1
    max_df: float = 1.0
    features: int = 80_000
    stop: list[str] = field(default_factory=stop_words)


#: Rows of a vocabulary up to which it is broadcast (some tens of bytes each).
BROADCAST_ROWS = 200_000


#: Documents whose terms are counted at once.
AT_ONCE = 256


def term_rows(docs: DataFrame, spec: TfidfSpec, by: list[str]) -> DataFrame:
    """(*by, doc, terms) from (*by, doc, text): ``terms`` has a struct (term, tf) for each term of the document, and is staged."""
    words = docs.select(*by, "doc", tokens(F.col("text"), spec.stop).alias("_words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema if f.name != "_words")
    most = spec.most

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counted(part.columns[-1], most)], names=[*part.schema.names[:-1], "terms"])

    return staged(words.mapInArrow(scan, f"{kinds}, terms array<struct<term string, tf bigint>>"))


def counted(words: pa.Array, most: int) -> pa.Array:
    """For each list of words a list of structs (term, tf): its words and their sequences of up to ``most``, each once, counted by sorting codes."""
    rows, flat = len(words), words.flatten()
    owner = np.repeat(np.arange(rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    terms, owners = [flat], [owner]
    for n in range(2, most + 1):
        at = np.nonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])[0]
        terms.append(pc.binary_join_element_wise(*[flat.take(pa.array(at + i)) for i in range(n)], " "))
        owners.append(owner[at])
    coded = pa.concat_arrays(terms).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(np.concatenate(owners) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    found = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % size)), pa.array(tf, pa.int64())], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // size, np.arange(rows + 1)), pa.int32()), found)


def vocabulary(rows: DataFrame, docs: DataFrame, spec: TfidfSpec, by: list[str]) -> DataFrame:
    """(*by, term, df, n): terms by frequency, ties by name, fitted in each group of ``by`` by itself."""
    sizes = docs.groupBy(*by).agg(F.count("*").alias("n"))
    terms = rows.select(*by, F.inline("terms")).groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    terms = terms.join(sizes, by) if by else terms.crossJoin(F.broadcast(sizes))  # one row without groups
    kept = terms.where((F.col("df") >= spec.min_df) & (F.col("df") <= F.col("n") * F.lit(spec.max_df)))
    if not by:
        return kept.orderBy(F.desc("total"), "term").limit(spec.features).select("term", "df", "n")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "term"))
    return kept.withColumn("_k", best).where(F.col("_k") <= spec.features).select(*by, "term", "df", "n")


def raw_weights(rows: DataFrame, vocab: DataFrame, by: list[str]) -> DataFrame:
    """(*by, doc, term, tf, raw): tf * (ln((1 + n) / (1 + df)) + 1), in the partitions of ``rows``."""
    table, fits = small(vocab, BROADCAST_ROWS)
    raw = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return join_small(rows.select(*by, "doc", F.inline("terms")), table, fits, [*by, "term"]).select(*by, "doc", "term", "tf", raw.alias("raw"))


def weights(rows: DataFrame, vocab: DataFrame, by: list[str]) -> DataFrame:
    """(*by, doc, term, tf, weight): raw weights, of length 1 in each document; only the rows of documents are dealt, not their terms."""
    joined = raw_weights(rows.repartition("doc"), vocab, by)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*by, "doc")))
    return joined.select(*by, "doc", "term", "tf", (F.col("raw") / length).alias("weight"))


def tfidf(docs: DataFrame, spec: TfidfSpec, by: list[str] | None = None) -> DataFrame:
    """Weights of all terms of (*by, doc, text)."""
    by = by or []
    rows = term_rows(docs, spec, by)
    return weights(rows, vocabulary(rows, docs, spec, by), by)


def query_weights(query: str, vocab: DataFrame, spec: TfidfSpec) -> DataFrame:
    """(term, weight) of a query text in a fitted vocabulary; at most as many rows as the query has terms."""
    one = vocab.sparkSession.range(1).select(F.lit("q").alias("doc"), F.lit(query).alias("text"))
    return weights(term_rows(one, spec, []), vocab, []).select("term", "weight")


def text_scores(index: DataFrame, query: DataFrame) -> DataFrame:
    """(doc, score): cosine of every document that shares a term with the query, from raw weights.

    Products and squares are summed in each partition, so a row for each document is shuffled.
    """
    q = F.broadcast(query.select("term", F.col("weight").alias("q")))  # the terms of one query
    sums = index.join(q, "term", "left").groupBy("doc").agg(F.sum(F.col("raw") * F.col("q")).alias("dot"), F.sum(F.col("raw") * F.col("raw")).alias("square"))
    return sums.where("dot is not null").select("doc", (F.col("dot") / F.sqrt("square")).alias("score"))


def top_terms(index: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(*by, term, weight, rank): the k terms of the largest weight in each group, ties by name."""
    by = by or ["doc"]
    line = Window.partitionBy(*by).orderBy(F.desc("weight"), "term")
    return index.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select(*by, "term", "weight", "rank")


def keywords(index: DataFrame, k: int, stop: list[str]) -> DataFrame:
    """(doc, keywords): the cleaned k best terms of each document, without repeats, best first."""
    best = top_terms(index, k).select("doc", "rank", clean_keyword(F.col("term"), stop).alias("word")).where("word is not null")
    listed = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))  # at most k a document
    return listed.select("doc", F.array_distinct(F.col("w.word")).alias("keywords"))


def mean_weights(index: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, term, weight): mean over all documents of the group, with zeros."""
    sizes = docs.groupBy(*by).agg(F.count("*").alias("_n"))
    return index.groupBy(*by, "term").agg(F.sum("weight").alias("_w")).join(sizes, by).select(*by, "term", (F.col("_w") / F.col("_n")).alias("weight"))


def keyword_rate(docs: DataFrame, words: list[str], by: list[str], text: Column) -> DataFrame:
    """(*by, keyword, count, rate): occurrences of each keyword in the texts, and per document of the group.

    Each keyword is one aggregate, so all of them take one pass and no join.  A
    match that spans two documents is not one.
    """
    from tessera.functions.text import occurrences

    row = docs.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(occurrences(text, F.lit(w))).alias(f"_c{i}") for i, w in enumerate(words)])
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"_c{i}").alias("count")) for i, w in enumerate(words)]))
    return row.select(*by, "_n", cells.alias("c")).select(*by, "c.keyword", "c.count", (F.col("c.count") / F.col("_n")).alias("rate"))


def word_rate(docs: DataFrame, words: list[str], by: list[str], text: Column) -> DataFrame:
    """(*by, keyword, count, rate) as :func:`keyword_rate`, of whole words."""
    row = docs.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(F.regexp_count(text, F.lit(rf"\b\Q{w}\E\b"))).alias(f"_c{i}") for i, w in enumerate(words)])
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"_c{i}").alias("count")) for i, w in enumerate(words)]))
    return row.select(*by, "_n", cells.alias("c")).select(*by, "c.keyword", "c.count", (F.col("c.count") / F.col("_n")).alias("rate"))
