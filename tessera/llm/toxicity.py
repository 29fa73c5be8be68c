"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted indexes.

Terms are the words of the lower-cased text (runs of letters and digits) and, marked
by ^, the first four and five characters of longer words.  The vocabulary is every
term of the labelled examples that at least two documents hold and at most one in
``MAX_DF`` (or ``MAX_DF`` of them, in a small corpus); no label chooses among them.
Terms are found in texts by hashes of 64 bits.  A text's vector has
tf * ln((n + 2) / (df + 1)) for each of its terms that is in the vocabulary, with
document frequencies counted over all n documents, and unit length.

The examples lie in blocks of ``BLOCK``.  Their postings form an inverted index in which
the terms with long lists (``COMMON``) carry the largest weight of every block.  A search
adds up the rare terms' postings exactly and bounds what the common terms can add to a
block; blocks whose bound cannot reach the k best are skipped and the others are
completed, all in double precision.  So its result is exact.

The ``NEIGHBOURS`` nearest vote with their cosines; the share of the votes for label 1 is
turned into a probability by a logistic curve that is fitted to the examples' own
shares, each found without the example itself.  The neighbours are the evidence.  A
text that shares no term with any example gets the rate among examples without terms.

Labels are learned from at most ``EXAMPLES`` rows, chosen by a hash of their id, with
at most ``CHARS`` characters of text in all; the statistics over documents and the scores cover all rows.

Defined results
* A null or empty text has no terms.  A null label, or a label without a document, teaches nothing.
* Of labels that repeat an id the largest counts; rows that repeat a document each get their row.
* Without any usable label every score is 0.  If all labels are equal, every score is (ones + 0.5) / (n + 1).
  An empty table gives an empty result with the same schema.
* Cosines are compared after rounding to 12 places; equal ones prefer the example with the smaller id.
* Very long texts are read whole, and other columns, whatever their names, do not clash.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import staged

#: Most labelled rows that are learned from, and most characters of their texts.
EXAMPLES, CHARS = 3_000, 32_000_000
#: A term in more than this part of the documents says too little.
MAX_DF = 16
NEIGHBOURS = 30
#: Examples in a block, the share of the examples from which on a term is common, and the most common terms held by blocks.
BLOCK, COMMON, MOST_COMMON = 64, 1 / 64, 128
#: Keeps the logarithm of a vote's odds finite.
SOFT = 0.02
#: Texts that are scored together, characters that are hashed together, and buckets of the vocabulary's hashes (a power of 2).
BATCH, PART, BUCKETS = 128, 1 << 16, 1 << 20
#: The base of the hashes' polynomials and its inverse modulo 2^64; what marks the hash of a prefix.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
PREFIX = np.uint64(0xA0761D6478BD642F)
WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> tuple[str, ...]:
    """The word and, marked by ^, its first four and five characters as far as it is longer."""
    return (word, *["^" + word[:n] for n in (4, 5) if n < len(word)])


@cache
def word_chars() -> np.ndarray:
    """Whether each code point belongs to words, as WORD has it."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@cache
def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(numbers: np.ndarray) -> np.ndarray:
    """64 bits of each number, well mixed."""
    z = numbers.astype(np.uint64)
    z += np.uint64(0x9E3779B97F4A7C15)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(32)
    return z


def pieces_of(chars: np.ndarray, inside: np.ndarray):
    """(code points, whether they are inside words) by pieces of some PART characters, which cut no word."""
    at = 0
    while at < len(chars):
        end = at + PART
        if end < len(chars) and inside[end - 1] and inside[end]:
            gaps = np.nonzero(~inside[at:end])[0]
            after = inside[end:]
            # back to the last gap, or, where one word fills the piece, on to its end
            end = at + int(gaps[-1]) + 1 if len(gaps) else end + (int(after.argmin()) if not after.all() else len(after))
        yield chars[at:end], inside[at:end]
        at = end


def hashes_of(text: str, prefixes: tuple[int, ...] = (4, 5)) -> np.ndarray:
    """Hashes of the words of a lower-cased text and of their first characters, repeats included: polynomials over the mixed characters, modulo 2^64."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    forth, back = powers(BASE, 2 * PART), powers(INVERSE, 2 * PART)
    found = [np.zeros(0, dtype=np.uint64)]
    for part, inside in pieces_of(chars, word_chars()[chars]):
        n = len(part)
        if n > 2 * PART:  # one word
            whole = np.zeros(1, dtype=np.uint64)
            for at in range(n - n % PART, -1, -PART):
                block = part[at : at + PART]
                whole = whole * forth[PART] + (mixed(block) * forth[: len(block)]).sum(dtype=np.uint64)
            head = mixed(part[:5]) * forth[:5]
            found += [whole, np.array([head[:length].sum(dtype=np.uint64) ^ PREFIX for length in prefixes], dtype=np.uint64)]
            continue
        edges = np.nonzero(np.diff(inside, prepend=False, append=False))[0]
        first, last = edges[::2], edges[1::2]
        upto = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(part) * forth[:n], out=upto[1:])
        size, base, shift = last - first, upto[first], back[first]
        found.append((upto[last] - base) * shift)
        for length in prefixes:
            longer = size > length
            found.append((upto[first[longer] + length] - base[longer]) * shift[longer] ^ PREFIX)
    return np.concatenate(found)


class Counting:
    """Counts the vocabulary's terms in texts.

    Terms are told apart by hashes of 64 bits, which lie in the order of ``BUCKETS`` buckets, followed by a blank.
    All words of a text are looked up together, and none of them is held.
    """

    def __init__(self, terms: list[str]) -> None:
        self.names = terms
        marked = np.fromiter((t[0] == "^" for t in terms), dtype=bool, count=len(terms))
        hashes = np.empty(len(terms), dtype=np.uint64)
        hashes[~marked] = hashes_of("\n".join(t for t in terms if t[0] != "^"), ())
        hashes[marked] = hashes_of("\n".join(t[1:] for t in terms if t[0] == "^"), ()) ^ PREFIX
        bucket = self.bucket(hashes)
        self.order = np.argsort(bucket, kind="stable")
        self.hashes = np.append(hashes[self.order], np.uint64(0))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))]).astype(np.int32)

    @cached_property
    def number(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.names)}

    @property
    def used(self) -> int:
        """Hashes held, with the blank."""
        return len(self.hashes)

    @staticmethod
    def bucket(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)

    def present(self, text: str | None) -> np.ndarray:
        """Term numbers, which may repeat."""
        hashes = hashes_of(text.lower() if text else "")
        bucket = self.bucket(hashes)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = []
        while len(at):
            same = (self.hashes[at] == hashes) & (at < end)
            found.append(at[same])
            at = at + 1
            more = np.nonzero(~same & (at < end))[0]
            hashes, at, end = hashes[more], at[more], end[more]
        return self.order[np.concatenate(found)] if found else np.zeros(0, dtype=np.int64)

    def distinct(self, text: str | None) -> np.ndarray:
        """Term numbers in order."""
        return np.unique(self.present(text))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers in order, counts)."""
        terms = self.present(text)
        terms.sort()
        first = np.nonzero(np.diff(terms, prepend=-1))[0]
        return terms[first], np.diff(first, append=len(terms)).astype(np.float64)


@dataclass
class Index:
    """Unit vectors of the examples by rows, and what a search needs of them by terms and by blocks."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    size: int

    @cached_property
    def held(self) -> np.ndarray:
        """Examples that hold each term."""
        return np.bincount(self.terms, minlength=self.size)

    @cached_property
    def order(self) -> np.ndarray:
        """Examples by the common term they weigh most, so that blocks hold examples that are alike."""
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        heavy = np.where(self.held[self.terms] >= COMMON * self.n, self.weights, 0.0)
        line = np.lexsort((self.terms, -heavy, rows))
        first = np.full(self.n, -1)
        filled = np.diff(self.starts) > 0
        first[filled] = self.terms[line[self.starts[:-1][filled]]]
        return np.lexsort((np.arange(self.n), first))

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def postings(self) -> tuple:
        """(place of each common term or -1, blocks x common terms x BLOCK, largest weights, starts, places and weights of the rare terms)."""
        place = np.empty(self.n, dtype=np.int64)
        place[self.order] = np.arange(self.n)
        rows = place[np.repeat(np.arange(self.n), np.diff(self.starts))]
        by_size = np.argsort(-self.held, kind="stable")[:MOST_COMMON]
        shared = by_size[self.held[by_size] >= max(2, COMMON * self.n)]
        common = np.full(self.size, -1, dtype=np.int64)
        common[shared] = np.arange(len(shared))
        blocks = -(-self.n // BLOCK)
        dense = np.zeros((blocks, len(shared), BLOCK))
        is_common = common[self.terms] >= 0
        dense[rows[is_common] // BLOCK, common[self.terms[is_common]], rows[is_common] % BLOCK] = self.weights[is_common]
        rare = np.nonzero(~is_common)[0]
        rare = rare[np.lexsort((rows[rare], self.terms[rare]))]
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.terms[rare], minlength=self.size))])
        return common, dense, dense.max(axis=2), starts, rows[rare], self.weights[rare]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights of unit length) the k largest (cosine, example), exactly; only examples that share a term."""
        if not self.n:
            return [[] for _ in queries]
        common, dense, tops, starts, places, weights = self.postings
        blocks = len(dense)
        scores = np.zeros((len(queries), blocks * BLOCK))
        asked = np.zeros((len(queries), dense.shape[1]))
        for i, (terms, w) in enumerate(queries):
            at = common[terms]
            asked[i, at[at >= 0]] = w[at >= 0]
            terms, w = terms[at < 0], w[at < 0]
            first, n = starts[terms], starts[terms + 1] - starts[terms]
            upto = np.cumsum(n)
            if len(n) and upto[-1]:
                pick = np.repeat(first - upto + n, n) + np.arange(upto[-1])
                scores[i] = np.bincount(places[pick], weights=weights[pick] * np.repeat(w, n), minlength=blocks * BLOCK)
        # what a block's best example can reach at most, and what the k-th best reaches at least; float rounding is far below the slack
        bound = scores.reshape(len(queries), blocks, BLOCK).max(axis=2) + asked @ tops.T + 1e-9
        need = bound >= kth(scores, k)[:, None]
        for b in np.nonzero(need.any(axis=0))[0].tolist():
            rows = np.nonzero(need[:, b])[0]
            scores[rows, b * BLOCK : (b + 1) * BLOCK] += asked[rows] @ dense[b]
        scores *= np.repeat(need, BLOCK, axis=1)
        scores.round(12, out=scores)
        near = scores >= np.maximum(kth(scores, k), 1e-12)[:, None]
        out = []
        for row, mask in zip(scores, near, strict=True):
            at = np.nonzero(mask)[0]
            out.append(sorted(zip(row[at].tolist(), self.order[at].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k])
        return out


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, 0 if there are fewer."""
    width = scores.shape[1]
    return np.partition(scores, width - k, axis=1)[:, width - k] if width >= k else np.zeros(len(scores), dtype=scores.dtype)


@dataclass
class Model:
    """Weights and index of the labelled examples."""

    idf: np.ndarray
    index: Index
    labels: np.ndarray
    ids: np.ndarray
    bare: float
    flat: float | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit(terms, counts, self.idf)

    def votes(self, queries: list, own: list[int | None] | None = None) -> list[tuple[float | None, list[int]]]:
        """(share of the votes for label 1, examples, nearest first) of each query; ``own`` names examples that do not vote."""
        found = self.index.search(queries, NEIGHBOURS + (own is not None))
        out = []
        for i, near in enumerate(found):
            if own is not None:
                near = [x for x in near if x[1] != own[i]][:NEIGHBOURS]
            all_votes = sum(c for c, _ in near)
            out.append((sum(c * self.labels[e] for c, e in near) / all_votes if near else None, [e for _, e in near]))
        return out

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]], curve: tuple[float, float]) -> list[tuple[float, list[int]]]:
        """(score, ids of the evidence) of each text's counts, by the curve from votes to scores."""
        out = []
        for share, near in self.votes([self.vector(*c) for c in counted]):
            if self.flat is not None:
                score = self.flat
            elif share is None:
                score = self.bare
            else:
                score = 1 / (1 + math.exp(-(curve[0] + curve[1] * odds(share))))
            out.append((score, self.ids[near].tolist()))
        return out


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = counts * idf[terms]
    length = math.sqrt(math.fsum(weights * weights))
    return terms, weights / length if length else weights


def odds(share: float) -> float:
    return math.log((share + SOFT) / (1 - share + SOFT))


def fit_curve(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the label over the votes' log odds, by Newton steps with a slight penalty."""
    x = np.stack([np.ones(len(shares)), [odds(s) for s in shares]], axis=1)
    w = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * (w - [0.0, 1.0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def in_fold(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, learn: Column, most: int) -> DataFrame:
    """Staged (id, label, t): at most ``most`` labelled documents, those whose ids hash lowest."""
    rows = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(learn)
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    found = texts.join(F.broadcast(rows), "id")  # at most ``most`` rows of 12 bytes
    return staged(found.groupBy("id").agg(F.max("label").alias("label"), F.min("t").alias("t")))


def bounded(examples: DataFrame) -> DataFrame:
    """The examples whose ids hash lowest, with at most ``CHARS`` characters in all."""
    sizes = examples.select("id", F.coalesce(F.char_length("t"), F.lit(0)).alias("n"), F.xxhash64("id").alias("h")).orderBy("h", "id").collect()  # at most EXAMPLES rows of numbers
    total, kept = 0, []
    for r in sizes:
        if total + r.n <= CHARS:
            total += r.n
            kept.append(r.id)
    return examples if len(kept) == len(sizes) else examples.where(F.col("id").isin(kept))


def document_frequencies(docs: DataFrame, shared, size: int, text_col: str) -> tuple[int, np.ndarray]:
    """(documents, how many of them hold each term of the vocabulary), counted in each task before the shuffle."""

    def count(batches):
        counting, found, n = Counting(shared.value), np.zeros(size + 1, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for t in b.column("t"):
                found[counting.present(t.as_py())] += 1  # once, however often a term repeats
        found[size] = n
        seen = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], names=["term", "n"])

    parts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the vocabulary
    df = np.zeros(size + 1)
    df[np.asarray(parts.column("term"))] = np.asarray(parts.column("n"))
    return int(df[size]), df[:size]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", text_col: str = "text"):
    """(broadcast vocabulary, broadcast model, curve from votes to scores); all are bounded by EXAMPLES and CHARS."""
    context = docs.sparkSession.sparkContext
    examples = bounded(labelled(docs, labels, label_col, id_col, text_col, learn, EXAMPLES))
    rows = sorted(zip(*[c.to_pylist() for c in examples.select("id", "label", "t").toArrow().columns], strict=True))
    terms = sorted({t for w in {w for _, _, text in rows if text for w in WORD.findall(text.lower())} for t in terms_of(w)})
    vocabulary = context.broadcast(terms)
    n, df = document_frequencies(docs, vocabulary, len(terms), text_col)
    kept = np.nonzero((df >= 2) & (df <= max(n / MAX_DF, MAX_DF)))[0]
    terms, df = [terms[i] for i in kept.tolist()], df[kept]
    vocabulary.destroy()
    vocabulary = context.broadcast(terms)
    idf = np.log((n + 2) / (df + 1))
    counting = Counting(terms)
    vectors = [unit(*counting(text), idf) for _, _, text in rows]
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
    flat_terms = np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32)
    index = Index(starts, flat_terms, np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0), len(terms))
    own = np.array([label for _, label, _ in rows], dtype=np.float64)
    ones = float((own == 1).sum())
    alone = own[np.diff(starts) == 0] if len(own) else own
    model = Model(idf, index, (own == 1).astype(np.float64), np.array([i for i, _, _ in rows], dtype=np.int64), ((alone == 1).sum() + ones / max(1, len(own))) / (len(alone) + 1) if len(own) else 0.0)
    if not 0 < ones < len(own):
        model.flat = (ones + 0.5) / (len(own) + 1) if len(own) else 0.0
        return vocabulary, context.broadcast(model), (0.0, 1.0)
    shared = context.broadcast(model)

    def vote(batches):
        for counted, b in counts_of(batches, Counting(vocabulary.value), 1):
            own = np.searchsorted(shared.value.ids, np.asarray(b.column(0))).tolist()
            found = shared.value.votes([shared.value.vector(*c) for c in counted], own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64())], names=["id", "share"])

    shares = {r.id: r.share for r in examples.select("id", "t").repartition(16, "id").mapInArrow(vote, "id long, share double").collect()}  # at most EXAMPLES rows of numbers
    known = [(shares[i], label == 1) for i, label, _ in rows if shares[i] is not None]
    return vocabulary, shared, fit_curve(np.array([s for s, _ in known]), np.array([float(x) for _, x in known])) if known else (0.0, 1.0)


def counts_of(batches, counting: Counting, place: int):
    """(counts of each text, the batch) in slices of at most ``BATCH`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield [counting(t.as_py()) for t in part.column(place)], part


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) of every document; labels are learned from ids whose crc32 mod 4 is not 2."""
    vocabulary, model, curve = fit(docs, labels, label_col, ~in_fold(F.col("id"), 4, 2), id_col, text_col)

    def score(batches):
        for counted, b in counts_of(batches, Counting(vocabulary.value), 1):
            found = model.value.scores(counted, curve)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["id", "score", "evidence"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(score, "id long, score double, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``.

    Each row is scored in place, so a row is kept or dropped for its own text; a null text is kept unless
    examples without terms are toxic at that rate.
    """
    vocabulary, model, curve = fit(docs, labels, label_col, ~in_fold(F.col("id"), 4, 2), id_col, text_col)
    place = docs.columns.index(text_col)

    def keep(batches):
        for counted, b in counts_of(batches, Counting(vocabulary.value), place):
            yield b.filter(pa.array([s < threshold for s, _ in model.value.scores(counted, curve)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
