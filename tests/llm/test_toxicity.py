"""Positive-unlabelled learning: its risk and gradient, a planted corpus, edge cases, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import toxicity
from tests.llm.helpers import documents, words


def test_the_risk_is_corrected_by_the_prior():
    positive, unlabelled = np.array([2.0, 0.0]), np.array([-1.0, 1.0, 3.0])
    first, second = toxicity.risk(positive, unlabelled, 0.3)
    loss = lambda x: np.log1p(np.exp(x))
    assert first == pytest.approx(0.3 * np.mean([loss(-2.0), loss(0.0)]))
    assert second == pytest.approx(np.mean([loss(-1.0), loss(1.0), loss(3.0)]) - 0.3 * np.mean([loss(2.0), loss(0.0)]))


def corpus(seed, n, share, marked):
    """Texts of words by lot; a share holds insults, of which a part is marked."""
    rng = random.Random(seed)
    toxic = [rng.random() < share for _ in range(n)]
    texts = [words(rng.random(), 40) + (f" you {rng.choice(('Grobnik!', 'zarfel', 'MUMPET.'))} " if t else " fine ") + words(rng.random(), 5) for t in toxic]
    return texts, toxic, [i for i in range(n) if toxic[i] and rng.random() < marked]


def test_unlabelled_toxic_texts_are_found_from_confirmed_ones(spark):
    """Only half of the toxic texts are confirmed, and no text is marked clean."""
    texts, toxic, marked = corpus(1, 1500, 0.15, 0.5)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in marked], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, prior=0.15)
    told = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score_column(model)("text").alias("s")).collect()}
    hidden = [told[i] for i, t in enumerate(toxic) if t and i not in marked]
    clean = [told[i] for i, t in enumerate(toxic) if not t]
    assert np.mean(np.array(hidden) >= 0.5) > 0.95 and np.mean(np.array(clean) >= 0.5) < 0.01


def entries(rng, n, width):
    who = np.repeat(np.arange(n), 12)
    return toxicity.Sample(n, who, rng.integers(0, width, len(who)))


def test_the_correction_keeps_the_risk_of_clean_texts_from_falling_below_zero():
    """With as many words as texts the plain estimate could be driven down without end."""
    rng = np.random.default_rng(0)
    positive, unlabelled = entries(rng, 30, 60), entries(rng, 60, 60)
    weights, bias = toxicity.train(positive, unlabelled, np.ones(60), 0.4)
    scores = [kind.scores(weights, bias) for kind in (positive, unlabelled)]
    assert toxicity.risk(*scores, 0.4)[1] > -0.05


def test_the_first_step_follows_the_gradient_of_the_risk(monkeypatch):
    """Adam's first step is the sign of the gradient, here by differences."""
    rng = np.random.default_rng(1)
    positive, unlabelled, prior = entries(rng, 20, 8), entries(rng, 50, 8), 0.2
    monkeypatch.setattr(toxicity, "STEPS", 1)
    weights, bias = toxicity.train(positive, unlabelled, np.ones(8), prior)
    start = np.r_[np.zeros(8), np.log(prior / (1 - prior))]
    whole = lambda w: sum(toxicity.risk(*(k.scores(w[:-1], w[-1]) for k in (positive, unlabelled)), prior))
    steps = np.eye(9) * 1e-5
    grad = np.array([(whole(start + s) - whole(start - s)) / 2e-5 for s in steps])
    moved = np.r_[weights, bias] - start
    assert np.allclose(moved, -toxicity.RATE * np.sign(grad), atol=1e-3)


def test_edge_cases(spark):
    texts, toxic, marked = corpus(2, 300, 0.3, 1.0)
    ids = list(range(300))
    odd = [None, "", "  \n", "zarfel " * 100_000, "zarfel", "zarfel", "\U0001f600"]
    docs = documents(spark, [*texts, *odd], [*ids, 900, 901, 902, 903, 904, 904, None])
    labels = spark.createDataFrame([*((i, int(toxic[i])) for i in ids), (1, None), (None, 1), (5555, 1), (904, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = docs.select("doc_id", "text", toxicity.score_column(model)("text").alias("own")).collect()
    assert len(got) == 307
    by = {r["doc_id"]: r["own"] for r in got}
    assert by[900] == by[901] == by[902] == by[None] < 0.5 < by[904] == by[903]


def test_without_positives_or_rows(spark):
    docs = documents(spark, ["a", "b"])
    none = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r[0] for r in docs.select(toxicity.score_column(model)("text")).collect()] == pytest.approx([0.0, 0.0])
    empty = docs.where("false")
    assert empty.select(toxicity.score_column(toxicity.fit(empty, none))("text")).count() == 0


def test_held_out_accuracy(spark):
    df = toxicity.op12_toxicity(spark, "/root/testdata/sf0.1")
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = df.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    got = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).orderBy("toxic").collect()
    assert got[0]["hit"] / got[0]["n"] < 0.015 and got[1]["hit"] / got[1]["n"] > 0.85


def test_held_out_labels_change_nothing(spark, tmp_path):
    """Labels of held-out documents may say anything."""
    texts, toxic, _ = corpus(4, 400, 0.3, 1.0)
    documents(spark, texts).write.parquet(f"{tmp_path}/a/documents.parquet")
    documents(spark, texts).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    turned = F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    labels.withColumn("toxic", turned).write.parquet(f"{tmp_path}/b/labels.parquet")
    a, b = (sorted(map(tuple, toxicity.op12_toxicity(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b
