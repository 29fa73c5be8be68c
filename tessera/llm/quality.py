"""Quality by Bradley-Terry pairwise ranking.

Every text is described by numbers that need no vocabulary: shares of kinds of
characters, repeated words and lines, lengths.  From labelled documents come
preference pairs, a good one over a bad one, and the score is linear in the
features with weights learned by logistic loss on the features' differences.  The
threshold is the quantile of the examples' scores at the share of label 0, and the
score given is the logistic function of the distance to it.

Labels are learned from at most ``EXAMPLES`` rows, chosen by a hash of their id.

Defined results
* A null text is an empty text; it has all features 0 but the one that marks it.
* A null label, or a label without a document, teaches nothing; of labels that repeat an id the largest counts.
* If all usable labels are equal, every score is (n1 + 0.5) / (n + 1); without labels 0.5.
* An empty table gives an empty result.  Only the named columns are read, so others do not clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.toxicity import in_fold, labelled

#: Most labelled rows that are learned from.
EXAMPLES = 20_000
#: Preference pairs for each document of the rarer label, and the weight of the penalty on squares.
PAIRS, PENALTY, STEPS = 24, 1e-3, 60

KINDS = {
    "upper": range(ord("A"), ord("Z") + 1), "lower": range(ord("a"), ord("z") + 1), "digit": range(ord("0"), ord("9") + 1),
    "space": b" ", "line": b"\n", "other_space": b"\t\r\x0b\x0c", "stop": b".", "comma": b",", "shout": b"!?", "pipe": b"|",
    "symbol": b"#$%&*@^~+=<>_\\/", "quote": b"\"'`", "bracket": b"()[]{}", "colon": b":;-", "wide": range(128, 256),
}
KIND_OF = np.full(256, len(KINDS), dtype=np.int64)
for _i, _chars in enumerate(KINDS.values()):
    KIND_OF[list(_chars)] = _i
N_KINDS = len(KINDS) + 1


def features(text: str | None) -> np.ndarray:
    """The numbers that describe a text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return np.concatenate([np.zeros(2 * N_KINDS + 13), [1.0]])
    kinds = np.bincount(KIND_OF[np.frombuffer(data, dtype=np.uint8)], minlength=N_KINDS) / len(data)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = kinds[0] + kinds[1] + kinds[14]
    upper_words = sum(map(bytes.isupper, words)) / n
    marked = sum(w[-1:] in b"!#$%&*|" for w in words) / n
    shape = [
        np.log1p(n), len(data) / n / 10, len(counts) / n, np.log1p(len(counts)) / np.log1p(n), top / n, again, np.log1p(100 * again),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), kinds[0] / (letters + 1e-9), upper_words, np.log1p(100 * upper_words), np.log1p(100 * marked),
    ]
    return np.concatenate([kinds, np.log1p(200 * kinds), shape, [0.0]])


def feature_rows(rows: DataFrame) -> DataFrame:
    """(id, label, x) from (id, label, t)."""

    def describe(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "x"])

    return rows.select("id", "label", "t").mapInArrow(describe, "id long, label int, x array<double>")


@dataclass
class Ranking:
    """score = 1 / (1 + exp(threshold - weights . (x - centre) / scale)); ``flat`` where there was nothing to rank."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    flat: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(np.clip(self.threshold - self.strength(x), -30, 30)))


def rank(x: np.ndarray, label: np.ndarray) -> Ranking:
    """Bradley-Terry weights by Newton steps on pairs of differing labels, and the threshold at the quantile of label 0's share."""
    n, ones = len(label), int((label == 1).sum())
    if not 0 < ones < n:
        return Ranking(np.zeros(0), np.ones(0), np.zeros(0), 0.0, (ones + 0.5) / (n + 1) if n else 0.5)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    good, bad = z[label == 1], z[label != 1]
    pick = np.random.default_rng(7)
    m = PAIRS * max(min(len(good), len(bad)), 200)
    gap = good[pick.integers(len(good), size=m)] - bad[pick.integers(len(bad), size=m)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))  # chance that the pair comes out the wrong way
        step = np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / m + PENALTY * np.eye(len(w)), gap.T @ p / m - PENALTY * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(centre, scale, w, 0.0)
    model.threshold = float(np.quantile(model.strength(x), 1 - ones / n))
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    rows = feature_rows(labelled(docs, labels, label_col, id_col, text_col, learn, EXAMPLES)).orderBy("id").collect()  # at most EXAMPLES rows of numbers
    width = len(features(None))
    return rank(np.array([r.x for r in rows]).reshape(-1, width), np.array([r.label for r in rows]))


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document; labels are learned from ids whose crc32 mod 3 is not 1."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, ~in_fold(F.col("id"), 3, 1), id_col, text_col))

    def score(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.array([features(t.as_py()) for t in part.column("t")])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.score(x))], names=["id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(score, "id long, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
