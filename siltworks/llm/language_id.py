"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's largest response goes through a rectifier into a softmax over the
languages. A text's prediction is the mean of the log-probabilities of all its
windows, so every byte of it counts. The network is fitted on windows of a
bounded sample of labelled rows, balanced over languages; it sees text only.

Edge cases: a null text and one without a letter are ``und`` with score 0, as is
every text if no row is labelled; texts of any length are read whole, window by
window in batches of a bounded size; rows with a null lang or doc_id aren't
learnt from; repeated rows get the same prediction; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import read

#: Bytes in a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: Labelled rows to learn from, over all languages; windows taken from each.
SAMPLE, EACH = 4000, 4
EPOCHS, BATCH, RATE = 8, 64, 0.02
#: Windows that go through the network at once.
BLOCK = 512
UNKNOWN = "und"

#: A-Z in lower case; digits and signs as spaces, as they tell nothing of a language.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


@dataclass
class Network:
    """tables[k][o]: responses of the filters of width k to the byte at offset o; then the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pool(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of every filter in each window, and where it is."""
        tops, places = [], []
        for table in self.tables:
            width = len(table)
            n = windows.shape[1] - width + 1
            response = table[0][windows[:, :n]]
            for o in range(1, width):
                response += table[o][windows[:, o : o + n]]
            place = response.argmax(axis=1) if self.training else None
            tops.append(response.max(axis=1))
            places.append(place)
        return np.concatenate(tops, axis=1) + self.bias, np.concatenate(places, axis=1) if self.training else tops[0]

    training = False

    def log_softmax(self, windows: np.ndarray) -> np.ndarray:
        scores = np.maximum(self.pool(windows)[0], 0) @ self.out + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its probability for whole texts."""
        total = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        n = 0

        def flush():
            nonlocal n
            rows, who = np.concatenate(held), np.concatenate(owner)
            for i in range(0, len(rows), BLOCK):
                np.add.at(total, who[i : i + BLOCK], self.log_softmax(rows[i : i + BLOCK]))
            held.clear()
            owner.clear()
            n = 0

        counts = np.ones(len(texts))
        for k, text in enumerate(texts):
            rows = cut_windows(text)
            counts[k] = len(rows)
            held.append(rows)
            owner.append(np.full(len(rows), k))
            n += len(rows)
            if n >= 4 * BLOCK:
                flush()
        if held:
            flush()
        mean = total / counts[:, None]
        mean -= mean.max(axis=1, keepdims=True)
        share = np.exp(mean) / np.exp(mean).sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [(self.languages[b], float(min(1.0, s[b]))) for b, s in zip(best, share)]


def cut_windows(text: str | None) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by Adam on the cross-entropy; of a filter only the pooled place gets a gradient."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Network(languages, tables, np.zeros(size, np.float32), rng.normal(0, 0.1, (size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.training = True
    params = [*net.tables, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            x, y = windows[rows], labels[rows]
            top, place = net.pool(x)
            hidden = np.maximum(top, 0)
            scores = hidden @ net.out + net.out_bias
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            back = (p @ net.out.T) * (top > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                g = np.zeros_like(net.tables[k])
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                at, filters = place[:, own], np.arange(FILTERS)
                for o in range(width):
                    byte = x[np.arange(len(rows))[:, None], at + o]
                    np.add.at(g[o], (byte, filters[None, :]), back[:, own])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for value, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    net.training = False
    return net


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on at most about ``sample`` rows (doc_id, text, lang), as many of each language as there are.

    Rows are chosen by their ids' hashes; the driver gets :data:`EACH` windows of a row.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, sample // len(languages))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))))
    luck = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    place = lambda i: F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(1), F.lit(EACH)), lambda i: F.substring("text", place(i), F.lit(WINDOW)))
    got = rows.where(luck < share[F.col("lang")]).orderBy("doc_id", "lang").limit(2 * sample).select("lang", parts.alias("parts")).toPandas()
    pairs = [(cut_windows(t)[0], languages.index(lang)) for lang, ts in zip(got["lang"], got["parts"]) for t in ts if len(t) > 3]
    if not pairs:
        return None
    return train(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), languages)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_column(net: Network | None):
    """A Pandas UDF from text to (lang, score)."""

    @F.pandas_udf("lang string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = net.predict(texts.tolist()) if net and len(texts) else [(UNKNOWN, 0.0)] * len(texts)
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return of


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score; columns that have these names already stay as given_lang_pred and given_score."""
    letter, told = (f"_{uuid.uuid4().hex}" for _ in range(2))
    out = docs.withColumnsRenamed({c: f"given_{c}" for c in ("lang_pred", "score") if c in docs.columns})
    out = out.withColumn(letter, has_letter(F.col("text"))).withColumn(told, predict_column(net)("text"))
    pred = F.when(F.col(letter), F.col(f"{told}.lang")).otherwise(F.lit(UNKNOWN))
    score = F.when(F.col(letter), F.col(f"{told}.score")).otherwise(F.lit(0.0))
    return out.withColumn("lang_pred", pred).withColumn("score", score).drop(letter, told)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a third of the documents is held out from training."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    net = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")
