"""Quality by ordinal cumulative-link regression on graded ratings.

A grade y in 0..K-1 has P(y <= k) = sigmoid(threshold_k - score). All thresholds
share one score: hashed weights of a text's words and of a few shares (signs,
capitals, repeats). The thresholds are kept in order. From the fit come the
expected grade and the tail probabilities that selection uses.

Grades come from the labels: toxic 0, of low quality 1, else 2.

Edge cases: a null or blank text has the score of no word; labels with a null in
any column, and labels of documents that aren't there, are not learnt from; a
document with several labels counts once for each; without any label every
document has the same middling score; repeated rows are scored each; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import read

#: Hashed weights; labelled rows to learn from at most.
BUCKETS, SAMPLE = 1 << 18, 6000
EPOCHS, STEPS, BATCH, RATE, DECAY = 20, 2500, 64, 0.1, 1e-4
#: Rows of the mean grade that a bucket's own rows are averaged with.
SHRINK = 10
#: Documents are selected whose probability of at least this grade is at least this.
SELECT_GRADE, SELECT_SHARE = 2, 0.5
#: Entries in a worker's table of words; it begins anew beyond.
KEPT = 600_000
SIGNS = b"#*$%&|<>!"
SHARES = ("signs", "bars", "capitals", "repeats", "blank")


def bucket(word: bytes) -> int:
    """The weight of a word: without case and without signs around it."""
    return zlib.crc32(word.lower().strip(b"#*$%&|<>!.,;:?\"'()[]-")) % (BUCKETS - len(SHARES)) + len(SHARES)


def shares(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """The values of the first buckets."""
    n = max(1, len(words))
    signs = sum(map(raw.count, (bytes([c]) for c in SIGNS)))
    return [
        min(1.0, signs / n),
        min(1.0, raw.count(b" | ") / n),
        sum(map(bytes.isupper, words)) / n,
        1 - distinct / n if words else 0.0,
        float(not words),
    ]


@dataclass
class Ordinal:
    """weights by bucket, thresholds in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def train(starts: np.ndarray, buckets: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, seed: int = 5) -> Ordinal:
    """Fit by AdaGrad on the negative log-likelihood; row i has the entries starts[i]:starts[i+1]."""
    rng = np.random.default_rng(seed)
    # a bucket's entries are scaled by how far the grades of its rows lie from the mean, shrunk
    # towards it, so that rare words don't learn the rows by heart; the scale ends in the weights
    row = np.repeat(np.arange(len(grades)), np.diff(starts))
    mean, seen = grades.mean(), np.bincount(buckets, minlength=BUCKETS)
    scale = np.abs(np.bincount(buckets, grades[row] - mean, BUCKETS)) / (seen + SHRINK)
    scale[: len(SHARES)] = 1
    values = values * scale[buckets]
    w, past = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    # the first threshold, then the logarithms of the steps to the next
    t, t_past = np.r_[-1.0, np.zeros(n_grades - 2)], np.full(n_grades - 1, 1e-6)
    for _ in range(max(EPOCHS, STEPS * BATCH // len(grades))):
        order = rng.permutation(len(grades))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            sizes = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            who, b, v = np.repeat(np.arange(len(rows)), sizes), buckets[at], values[at]
            score = np.bincount(who, w[b] * v, len(rows))
            cuts = np.r_[-np.inf, t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))], np.inf]
            sig = lambda x: 1 / (1 + np.exp(np.clip(-x, -60, 60)))
            y = grades[rows]
            hi, lo = sig(cuts[y + 1] - score), sig(cuts[y] - score)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g_score = (d_hi - d_lo) / len(rows)
            g_cut = np.zeros(n_grades + 1)
            np.add.at(g_cut, y + 1, -d_hi / len(rows))
            np.add.at(g_cut, y, d_lo / len(rows))
            inner = g_cut[1:-1]
            g_t = np.r_[inner.sum(), [inner[k:].sum() * np.exp(t[k]) for k in range(1, n_grades - 1)]]
            g = np.bincount(b, g_score[who] * v, BUCKETS)
            own = np.unique(b)
            grad = g[own] + DECAY * w[own]
            past[own] += grad * grad
            w[own] -= RATE * grad / np.sqrt(past[own])
            t_past += g_t * g_t
            t -= RATE * g_t / np.sqrt(t_past)
    return Ordinal((w * scale).astype(np.float32), t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))])


def entries_column():
    """A Pandas UDF from text to the entries (bucket, value) of its row."""

    @F.pandas_udf("buckets array<int>, vals array<double>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                seen = set(words)
                b = [*range(len(SHARES)), *map(bucket, seen)]
                rows.append((b, [*shares(raw, words, len(seen)), *[1.0] * len(seen)]))
            yield pd.DataFrame(rows, columns=["buckets", "vals"])

    return of


def fit(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, n_grades: int = 3) -> Ordinal:
    """Train on the first ``sample`` rows of ``graded`` (doc_id, grade) by the ids' hashes.

    The driver gets the hashed words of those rows' texts.
    """
    chosen = graded.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    got = rows.select("doc_id", "grade", entries_column()("text").alias("e")).select("doc_id", "grade", "e.*").toPandas()
    if got.empty:
        return Ordinal(np.zeros(BUCKETS, np.float32), np.arange(n_grades - 1) * 1.0)
    got = got.sort_values(["doc_id", "grade"], kind="stable")
    starts = np.r_[0, np.cumsum([len(b) for b in got["buckets"]])]
    flat = lambda name, kind: np.concatenate([np.asarray(x, kind) for x in got[name]])
    return train(starts, flat("buckets", np.int64), flat("vals", np.float64), got["grade"].to_numpy(np.int64), n_grades)


class Weights(dict):
    """Word to weight, filled as words come."""

    def __init__(self, weights: np.ndarray):
        self.of = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > KEPT:
            self.clear()
        self[word] = got = float(self.of[bucket(word)])
        return got


def score_column(model: Ordinal):
    """A Pandas UDF from text to expected_grade and the tail probabilities."""
    names = [f"p_ge_{k}" for k in range(1, len(model.thresholds) + 1)]

    @F.pandas_udf("expected_grade double, " + ", ".join(f"{n} double" for n in names))
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, first = Weights(model.weights), model.weights[: len(SHARES)].astype(float).tolist()
        for texts in parts:
            score = np.zeros(len(texts))
            for i, text in enumerate(texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                seen = set(words)
                held = shares(raw, words, len(seen))
                score[i] = sum(map(table.__getitem__, seen)) + sum(a * b for a, b in zip(first, held))
            tails = model.tails(score)
            yield pd.DataFrame(np.c_[tails.sum(axis=1), tails], columns=["expected_grade", *names])

    return of


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: toxic 0, of low quality 1, else 2; null where a label is null."""
    low = F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNotNull(), low).cast("int").alias("grade"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the selection for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades(read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", score_column(model)("text").alias("s")).select("doc_id", "s.*")
    return out.withColumn("kept", F.col(f"p_ge_{SELECT_GRADE}") >= SELECT_SHARE)
