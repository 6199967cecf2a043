"""Toxicity by non-negative positive-unlabelled learning.

A linear model of a text's distinct words learns from confirmed toxic texts
(positives) and from texts of unknown kind (unlabelled), never from texts marked
clean. With the share of toxic texts in the corpus as class prior p, its risk is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

with the logistic loss: the second part estimates the risk on clean texts, and
where it falls below zero the model has begun to learn the unlabelled texts by
heart, so steps then go the other way. The prior is the share of toxic among the
labels that may be learnt from, or a parameter.

Words enter without case and without signs around them, whole and by their first
BEGINNING characters, and only those whose share among positives stands out from
that among unlabelled texts by more than chance; each weighs in by how far.

Both samples are taken by the hash of the id and bounded (POSITIVES, UNLABELLED).
Their words are counted by Spark, and the driver gets those of each text that
stand out. All texts are scored whole.

Edge cases: a null or blank text, or one without a telling word, has the score of
no word; labels that are null, and labels of documents that aren't there, are not
learnt from; a document with several labels is toxic if one is; without a
positive every score is next to 0; repeated rows are scored each; a null doc_id is
scored and never learnt from; an empty table gives no row; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import Scratch, read

#: Confirmed and unlabelled texts to learn from at most.
POSITIVES, UNLABELLED = 4000, 12_000
#: Hashed words and beginnings, and the characters of a beginning.
BUCKETS, BEGINNING = 1 << 20, 4
#: Standard errors by which a word's shares must differ, and the number at which its weight counts in full.
STANDS_OUT, IN_FULL = 3.5, 9.0
STEPS, RATE, DECAY = 400, 0.05, 3e-5
#: Steps against the negative part are this long, and begin below this risk.
BACK, SLACK = 0.5, 0.0
#: Entries in a worker's table of words; it begins anew beyond.
KEPT = 600_000
AROUND = "#*$%&|<>!.,;:?\"'()[]{}-_=+~^@/\\`"


def hashed(word: str) -> tuple[int, int]:
    """The buckets of a word and of its beginning."""
    word = word.lower().strip(AROUND)
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in (word, f"^{word[:BEGINNING]}"))


def buckets_column():
    """A Pandas UDF from text to the distinct buckets of its words."""

    @F.pandas_udf("array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: sorted({b for w in set((t or "").split()) for b in hashed(w)}))

    return of


@dataclass
class Linear:
    """Weights of the telling buckets, by bucket; the score of a text is the sigmoid of their sum and the bias."""

    weights: dict[int, float]
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -60, 60)))


def telling(rows: DataFrame, n: int, m: int) -> DataFrame:
    """bucket and scale of those whose share among the ``n`` positives stands out from that among the ``m`` unlabelled; ``rows``: kind, own."""
    each = rows.select("kind", F.explode("own").alias("bucket")).groupBy("bucket").agg(F.sum("kind").alias("p"), F.count("*").alias("both"))
    share = (F.col("both") + 1) / (n + m + 2)
    z = F.abs(F.col("p") / n - (F.col("both") - F.col("p")) / m) / F.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return each.select("bucket", "both", z.alias("z")).where((F.col("z") > STANDS_OUT) & (F.col("both") > 2)).select("bucket", F.least(F.lit(1.0), F.col("z") / IN_FULL).alias("scale"))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of scores (before the sigmoid): of positives, and the corrected one of clean texts."""
    of = lambda x: np.logaddexp(0, x).mean()
    return prior * of(-positive), of(unlabelled) - prior * of(positive)


@dataclass
class Sample:
    """Texts of one kind: how many, and for each entry its text and its bucket (numbers from 0)."""

    n: int
    who: np.ndarray
    which: np.ndarray

    def scores(self, values: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.who, values[self.which], self.n) + bias

    def gradient(self, by_score: np.ndarray, n_values: int) -> np.ndarray:
        return np.bincount(self.which, by_score[self.who], n_values)


def train(positive: Sample, unlabelled: Sample, scale: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by Adam on the whole samples; ``prior`` is the share of positives among ``unlabelled``."""
    w = np.zeros(len(scale) + 1)
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 1.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        gp, gu = (kind.scores(w[:-1] * scale, w[-1]) for kind in (positive, unlabelled))
        # derivatives of each part by the scores
        dp, du = prior * _sigmoid(gp) / positive.n, _sigmoid(gu) / unlabelled.n
        if risk(gp, gu, prior)[1] >= -SLACK:
            dp = -prior * _sigmoid(-gp) / positive.n - dp
        else:
            dp, du = BACK * dp, -BACK * du
        grad = np.r_[(positive.gradient(dp, len(scale)) + unlabelled.gradient(du, len(scale))) * scale + DECAY * w[:-1], dp.sum() + du.sum()]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w[:-1] * scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Linear:
    """Train on texts of ``docs``; ``labels`` (doc_id, toxic) tell which are toxic and, by their share, the prior."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where("doc_id is not null").select("doc_id").distinct()
    marks = marks.join(known, "doc_id")
    if prior is None:
        prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    by_hash = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(marks.where("toxic = 1").select("doc_id"), positives).withColumn("kind", F.lit(1))
    chosen = chosen.unionByName(by_hash(known, unlabelled).withColumn("kind", F.lit(0)))
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the samples
        rows = scratch.table(rows.select("doc_id", "kind", F.monotonically_increasing_id().alias("row"), buckets_column()("text").alias("own")))
        sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2 or not prior:
            return Linear({}, -np.inf)
        told = scratch.table(telling(rows, sizes[1], sizes[0]))
        own = told.orderBy("bucket").toArrow()
        each = rows.select("doc_id", "kind", "row", F.explode("own").alias("bucket")).join(told.select("bucket"), "bucket")
        got = each.orderBy("kind", "doc_id", "row", "bucket").select("kind", "row", "bucket").toArrow()
    kinds, row, bucket = (got[c].to_numpy() for c in ("kind", "row", "bucket"))
    which = np.searchsorted(own["bucket"].to_numpy(), bucket)

    def sample(kind: int) -> Sample:
        of = kinds == kind
        return Sample(sizes[kind], np.cumsum(np.diff(row[of], prepend=row[of][:1]) != 0), which[of])

    weights, bias = train(sample(1), sample(0), own["scale"].to_numpy(), prior)
    return Linear(dict(zip(own["bucket"].to_pylist(), weights.tolist())), bias)


class Weights(dict):
    """Word to its buckets that have a weight, filled as words come."""

    def __init__(self, of: dict[int, float]):
        self.of = of

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.clear()
        self[word] = got = tuple(b for b in hashed(word) if b in self.of)
        return got


def score_column(model: Linear):
    """A Pandas UDF from text to the score."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Weights(model.weights)
        for texts in parts:
            told = ({b for w in set((t or "").split()) for b in known[w]} for t in texts)
            sums = np.fromiter((sum(model.weights[b] for b in sorted(own)) for own in told), np.float64, len(texts))
            yield pd.Series(_sigmoid(sums + model.bias))

    return of


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
