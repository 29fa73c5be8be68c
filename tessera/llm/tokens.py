"""Token counts by prefix dynamic programming.

A byte-pair encoding of a byte string is the only sequence of tokens in which every
token encodes to itself and every two neighbours encode to themselves.  So a
prefix's last token is the one suffix token that fits the last token of what is
before it, and

    count[i] = count[i - len(token)] + 1

gives the exact number of tokens of every prefix in one pass.  A text is first cut
into pieces as the tokenizer's pattern does; the table of a piece is computed once
and remembered.  The count of a text's prefix is the count of the whole pieces
before it and of what is left, cut again as a text of its own.  So one pass over a text makes its
table, and its total, its cuts and its counts are all read off that; :func:`prefix_counts` stores
the counts, from which :func:`cut_of` answers any budget without the text.

Defined results
* A null text is an empty text: no bytes, no tokens.
* An added token's string inside a text is that one token, as by the library's default.
* Prefixes are counted by code points; a prefix that ends inside an added token's string counts as plain text.
* An empty table gives an empty result.  Only the named columns are read, so others do not clash.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The byte-level pattern that cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern over characters whose classes are plain, for the faster standard engine.
PLAIN_LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
PLAIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{PLAIN_LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{PLAIN_LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
ODD = rf"[^\t-\r -~{PLAIN_LETTERS}]"
#: Pieces whose counts a worker remembers, twice: those used since the last full memory, and those before.
MEMO, TABLES = 400_000, 20_000
#: Bytes of memory are bounded too: longer pieces are rare and are counted each time.
MEMO_PIECE = 64
#: Characters by which a prefix may be cut into pieces otherwise than the text: a contraction or white space before its end.
BACK = 4


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Totals(dict):
    """Tokens of whole pieces, counted when first asked for; in two generations, so that what is used stays."""

    def __init__(self, count) -> None:
        self.count, self.before = count, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.before = self.copy()
            self.clear()
        known = self.before.get(piece)
        if known is None:
            known = self.count(piece.encode())[-1]
        if len(piece) <= MEMO_PIECE:
            self[piece] = known
        return known


class PrefixCounter:
    """Exact token counts of all prefixes, for a byte-level BPE vocabulary in the tokenizers library's format."""

    def __init__(self, vocabulary: dict) -> None:
        model, letters = vocabulary["model"], byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:  # a token's number is the order in which its merge is made
            left, right = map(as_bytes, merge if isinstance(merge, list) else merge.split(" "))
            pair = self.number[left], self.number[right]
            self.merged[pair] = self.number.setdefault(left + right, len(self.parts))
            self.parts.append(pair)
        self.longest = max(map(len, self.number))
        added = sorted((t["content"] for t in vocabulary.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.any_pieces, self.plain_pieces, self.odd = regex.compile(PIECES), re.compile(PLAIN_PIECES), re.compile(ODD)
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole = {t: n for t, n in self.number.items() if len(t) == 1 or self.fit(*self.parts[n], below=n)}
        self.tables: dict[str, tuple[int, ...]] = {}
        self.totals = Totals(self.byte_table)

    def pieces(self, text: str) -> list[str]:
        """The text as the tokenizer cuts it before it encodes."""
        return (self.any_pieces if self.odd.search(text) else self.plain_pieces).findall(text)

    def fit(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge made before ``below`` crosses the border between two tokens.

        The tokens are undone from the latest merge backwards.  At every stage the
        two parts at the border stand side by side; a merge of these that is made
        before the next one that was made instead would have crossed it.
        """
        while True:
            if self.merged.get((left, right), below) < below:
                return False
            if left > right and left > 255:  # undo the later of the two; a byte can't be undone
                below, left = left, self.parts[left][1]
            elif right > 255:
                below, right = right + 1, self.parts[right][0]
            elif left > 255:
                below, left = left, self.parts[left][1]
            else:
                return True

    def byte_table(self, data: bytes) -> list[int]:
        """Tokens of each prefix of a piece's bytes, the empty one first.

        Only one token fits at each end, so the order of trial is free: first the
        last token made longer, then the single byte, then all others.
        """
        counts, last, begin = [0], [-1], 0
        whole, fits = self.whole, self.fits

        def suits(start: int, end: int) -> bool:
            number = whole.get(data[start:end])
            if number is None:
                return False
            if start:
                pair = last[start], number
                fine = fits.get(pair)
                if fine is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    fine = fits[pair] = self.fit(*pair)
                if not fine:
                    return False
            counts.append(counts[start] + 1)
            last.append(number)
            return True

        for end in range(1, len(data) + 1):
            if suits(begin, end):
                continue
            if begin != end - 1 and suits(end - 1, end):
                begin = end - 1
                continue
            for start in range(max(0, end - self.longest), end - 1):
                if start != begin and suits(start, end):
                    begin = start
                    break
        return counts

    def table(self, piece: str) -> tuple[int, ...]:
        """Tokens of each prefix of a piece, by code points."""
        known = self.tables.get(piece)
        if known is None:
            if len(self.tables) > TABLES:
                self.tables.clear()
            counts, at, out = self.byte_table(piece.encode()), 0, [0]
            for c in piece:
                at += len(c.encode())
                out.append(counts[at])
            known = tuple(out)
            if len(piece) <= MEMO_PIECE:
                self.tables[piece] = known
        return known

    def segments(self, text: str):
        """(plain text, whether an added token follows it)."""
        if self.added is None or not (found := list(self.added.finditer(text))):
            yield text, False
            return
        at = 0
        for m in found:
            yield text[at : m.start()], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        return self.prefix_table(text).total

    def prefix_table(self, text: str | None) -> PrefixTable:
        """Counts at every prefix, held by pieces."""
        text = text or ""
        total = self.totals.__getitem__
        runs = []
        for part, added in self.segments(text):
            pieces = self.pieces(part)
            runs.append((pieces, list(map(total, pieces)), added))
        return PrefixTable(self, text, runs)


class PrefixTable:
    """The number of tokens of every prefix of a text, by code points.

    ``runs`` holds the pieces between added tokens, their counts, and whether an added token follows.
    """

    def __init__(self, counter: PrefixCounter, text: str, runs: list[tuple[list[str], list[int], bool]]) -> None:
        self.counter, self.text, self.runs = counter, text, runs
        self.total = sum(sum(counts) + added for _, counts, added in runs)

    @cached_property
    def columns(self) -> tuple[list[int], list[int], list[bool]]:
        """(start, tokens before it, whether it is an added token) of every piece."""
        starts, before, special, at, so_far = [], [], [], 0, 0
        for pieces, counts, added in self.runs:
            starts += accumulate(map(len, pieces), initial=at)
            before += accumulate(counts, initial=so_far)
            special += [False] * len(pieces)
            at, so_far = starts[-1], before[-1]
            if added:
                special.append(True)
                at, so_far = self.counter.added.match(self.text, at).end(), so_far + 1
            else:
                starts.pop()
                before.pop()
        return starts, before, special

    starts = property(lambda self: self.columns[0])
    before = property(lambda self: self.columns[1])
    special = property(lambda self: self.columns[2])

    def at(self, end: int) -> int:
        """Tokens of ``text[:end]``."""
        if end >= len(self.text):
            return self.total
        if end <= 0:
            return 0
        i = bisect_right(self.starts, end - 1) - 1
        if self.special[i]:
            if i + 1 < len(self.starts) and end == self.starts[i + 1]:
                return self.before[i] + 1
            if i > 0 and not self.special[i - 1]:
                i -= 1  # the start of an added token's string goes on from the piece before it
        # the pieces of a prefix are those of the text but for its end: white space and contractions are cut anew
        while i > 0 and not self.special[i - 1] and end - self.starts[i] < BACK + 16 and not self.stable(i):
            i -= 1
        rest = self.text[self.starts[i] : end]
        return self.before[i] + sum(self.counter.totals[p] if len(p) < len(rest) else self.counter.table(p)[len(p)] for p in self.counter.pieces(rest))

    def stable(self, i: int) -> bool:
        """Whether a cut just inside piece ``i`` leaves the pieces before it as they are."""
        return not self.text[self.starts[i]].isspace() and not self.text[self.starts[i] - 1].isspace()

    def cut(self, budget: int) -> int:
        """The most code points from the start that make at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        i = bisect_right(self.before, budget)  # the piece in which the budget runs out, or the one after
        end = self.starts[i] if i < len(self.starts) else len(self.text)
        end = min(len(self.text), end + BACK)
        while end > 0 and self.at(end) > budget:
            end -= 1
        return end


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(vocabulary: str) -> PrefixCounter:
    """The counter for a vocabulary's JSON, one in each worker."""
    key = f"{len(vocabulary)}:{hash(vocabulary)}"
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PrefixCounter(json.loads(vocabulary))
    return _COUNTERS[key]


def token_counts(df: DataFrame, vocabulary_path: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, cut (code points that fit ``budget``).

    The vocabulary is read on the driver and sent to the executors: it is of fixed size.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches):
        counter = counter_of(shared.value)
        for b in batches:
            totals = np.zeros(b.num_rows, dtype=np.int64)
            cuts = np.zeros(b.num_rows, dtype=np.int64)
            for i, t in enumerate(b.column("t")):
                table = counter.prefix_table(t.as_py())
                totals[i], cuts[i] = table.total, table.cut(budget)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(totals), pa.array(cuts)], names=["id", "n_bytes", "n_tokens", "cut"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return narrow.mapInArrow(scan, "id long, n_bytes long, n_tokens long, cut long").withColumn("over_limit", F.col("n_tokens") > budget)


def prefix_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): the number of tokens of every prefix by code points, the empty one first."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches):
        counter = counter_of(shared.value)
        for b in batches:
            for at in range(b.num_rows):
                table = counter.prefix_table(b.column("t")[at].as_py())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, 1), pa.array([[table.at(i) for i in range(len(table.text) + 1)]], pa.list_(pa.int32()))], names=["id", "counts"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(scan, "id long, counts array<int>")


def cut_of(counts: Column, budget: int) -> Column:
    """The most code points from the start that make at most ``budget`` tokens, from stored :func:`prefix_counts`."""
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it fits 512."""
    import public_tokenizers

    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit", "cut")
