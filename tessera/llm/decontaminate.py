"""Benchmark decontamination by a hash set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters.  Every benchmark item gives its windows of 13 consecutive
words, or itself if it has fewer.  The windows form a hash set that executors hold: one
64-bit polynomial hash of word numbers for each window, sorted, beside the word numbers
themselves.  A document's windows of known words are hashed at once and looked up, and a hit
is verified word by word.  Words inside any hit are counted, and the spans can be cut
out or the document dropped.

A set holds at most ``SET_PAIRS`` pairs of a window and an item, some 150 bytes each.  A
benchmark with more is dealt into several sets by a hash of the pair, so one long item or a
window of many items is dealt too; each set is collected, broadcast, scanned and given back in turn, and the
documents carry their merged spans and items from one scan to the next in a staged
table.  So the bound on what the driver and the executors hold is kept at any size.

Defined results
* A null text has no words: no hits, not contaminated; an item without words has no windows.
* An item with a null id takes part like any other and is listed as the text "null".
* Items that repeat an id are one item; rows that repeat a document each get their row.
* Empty tables give an empty result, or no hits, with the same schema.
* Very long texts are read whole; other columns, whatever their names, do not clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.plans.staging import staged

WINDOW = 13
#: Pairs of a window and an item in one broadcast set.
SET_PAIRS = 400_000
#: Texts whose words are held at once.
BATCH = 256
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.encode().lower().decode()) if text else []  # bytes: only A-Z


class WindowSet:
    """Windows of some benchmark items, each with the items it comes from."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        by_gram: dict[str, set[str]] = {}
        for gram, item in pairs:
            by_gram.setdefault(gram, set()).add(item)
        self.numbers: dict[str, int] = {}
        sizes: dict[int, list[tuple[list[int], tuple[str, ...]]]] = {}
        for gram, items in by_gram.items():
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in gram.split(" ")]
            sizes.setdefault(len(ids), []).append((ids, tuple(sorted(items))))
        #: by length: (sorted hashes, word numbers, items)
        self.tables = {}
        for n, rows in sorted(sizes.items()):
            words = np.array([ids for ids, _ in rows], dtype=np.int64)
            hashes = polynomial(words.ravel(), np.arange(0, words.size, n), n)
            order = np.argsort(hashes, kind="stable")
            self.tables[n] = hashes[order], words[order].astype(np.int32), [rows[i][1] for i in order.tolist()]

    def hits(self, words: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of every occurrence of a window among ``words``."""
        ids = np.fromiter((self.numbers.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        found = []
        if not self.tables or not (ids >= 0).any():
            return found
        out = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, (hashes, rows, items) in self.tables.items():
            if n > len(ids):
                break
            starts = np.nonzero(out[n:] == out[:-n])[0]  # windows of known words only
            if not len(starts):
                continue
            own = polynomial(ids, starts, n)
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for i in np.nonzero(low < high)[0].tolist():
                at = int(starts[i])
                for j in range(int(low[i]), int(high[i])):
                    if (rows[j] == ids[at : at + n]).all():
                        found.append((at, at + n, items[j]))
        return found


def polynomial(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash, modulo 2^64, of the ``n`` numbers from each start on."""
    total = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + (ids[starts + k] + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return total


def window_pairs(bench: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, int]:
    """(staged distinct rows (gram, item, part), number of parts of at most about ``SET_PAIRS`` rows)."""

    def cut(batches):
        for b in batches:
            for item, text in zip(b.column("i").to_pylist(), b.column("t"), strict=True):
                words = words_of(text.as_py())
                n = min(width, len(words))
                for at in range(0, len(words) - n + 1 if n else 0, 4096):
                    grams = [" ".join(words[i : i + n]) for i in range(at, min(at + 4096, len(words) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([item] * len(grams), pa.string())], names=["gram", "item"])

    rows = bench.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text_col}`").alias("t"))
    pairs = staged(rows.mapInArrow(cut, "gram string, item string").distinct())
    parts = max(1, -(-pairs.count() // SET_PAIRS))
    return pairs.withColumn("part", F.pmod(F.xxhash64("gram", "item"), F.lit(parts))), parts


def with_hits(df: DataFrame, place: int, bench: DataFrame, id_col: str, text_col: str, width: int, finish, schema) -> DataFrame:
    """``finish(batch, words, spans, items)`` over the rows of ``df``, whose texts stand in column ``place``; ``schema`` is that of its batches."""
    pairs, parts = window_pairs(bench, id_col, text_col, width)
    context, n_columns = df.sparkSession.sparkContext, len(df.columns)
    names = [fresh(df, "hit_spans"), fresh(df, "hit_items")]
    for part in range(parts):
        rows = pairs.where(F.col("part") == part).select("gram", "item").toArrow()  # at most about SET_PAIRS rows
        shared = context.broadcast(WindowSet(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))))

        def look(batches, shared=shared, first=part == 0, last=part == parts - 1):
            for b in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
                words = [words_of(t.as_py()) for t in b.column(place)]
                merged, items = [], []
                for i, w in enumerate(words):
                    hits = shared.value.hits(w) if w else []
                    before = [] if first else [(x["start"], x["end"], ()) for x in b.column(n_columns)[i].as_py()]
                    merged.append(spans(hits + before))
                    items.append(sorted({x for h in hits for x in h[2]} | set([] if first else b.column(n_columns + 1)[i].as_py())))
                if last:
                    yield finish(b, words, merged, items)
                else:
                    cuts = pa.array([[{"start": a, "end": z} for a, z in m] for m in merged], SPANS)
                    yield pa.RecordBatch.from_arrays([*b.columns[:n_columns], cuts, pa.array(items, pa.list_(pa.string()))], names=[*b.schema.names[:n_columns], *names])

        if part == parts - 1:
            return df.mapInArrow(look, schema)
        wide = df.select("*", F.lit(None).cast("array<struct<start:long,end:long>>").alias(names[0]), F.lit(None).cast("array<string>").alias(names[1])).schema if part == 0 else df.schema
        df = staged(df.mapInArrow(look, wide))
        shared.destroy()
    return df


def spans(hits: list[tuple[int, int, tuple[str, ...]]]) -> list[tuple[int, int]]:
    """Hits merged into disjoint spans of words, in order."""
    merged: list[list[int]] = []
    for start, end, _ in sorted(hits):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def scan(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (distinct, sorted as strings), spans (first and last word + 1)."""

    def finish(b, words, merged, items):
        n_hit = [sum(end - start for start, end in m) for m in merged]
        cuts = [[{"start": a, "end": z} for a, z in m] for m in merged]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(cuts, SPANS)], names=["id", "n_words", "n_hit", "items", "spans"])

    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return with_hits(narrow, 1, bench, item_col, item_text, width, finish, "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def cut_text(text: str, drop: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    places = [m.span() for m in WORDS.finditer(text.encode().lower().decode())]
    kept, at = [], 0
    for start, end in drop:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


def decontaminated(df: DataFrame, bench: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", width: int = WINDOW) -> DataFrame:
    """``df`` without its contaminated documents; from the others, the spans that hit are cut out.

    A document goes if at least 5 % of its words are hit.  ``length_col``, where
    ``df`` has it, follows the text that is left.
    """
    place, n_columns = df.columns.index(text_col), len(df.columns)

    def finish(b, words, merged, items):
        keep, texts = [], []
        for value, own, cuts in zip(b.column(place), words, merged, strict=True):
            n_hit = sum(end - start for start, end in cuts)
            keep.append(not (n_hit > 0 and 20 * n_hit >= len(own)))
            texts.append(cut_text(value.as_py(), cuts) if n_hit and keep[-1] else value.as_py())
        columns = list(b.columns[:n_columns])
        columns[place] = pa.array(texts, b.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names[:n_columns]).filter(pa.array(keep, pa.bool_()))

    schema = df.schema
    out = with_hits(df, place, bench, "item_id", "text", width, finish, schema)
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{length_col}`")).otherwise(F.char_length(F.col(f"`{text_col}`")).cast(schema[length_col].dataType)))
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """The digest of a list of item ids, as the query gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP9_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS gram
       FROM (SELECT item, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
       FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths WHERE len(words) >= n)),
hits AS (SELECT row, n, i, item FROM dw JOIN bw USING (n, gram)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(words), 0) AS contaminated
FROM w LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""
