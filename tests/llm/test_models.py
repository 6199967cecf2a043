import random

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm import language_id, quality_classifier
from tests.llm.helpers import documents

SYLLABLES = {"en": ["the", "ing", "and", "ed", "er", "wh"], "de": ["der", "sch", "ung", "ein", "ü", "keit"], "fr": ["eau", "tion", "é", "oi", "le", "eux"]}


def sentence(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_on_held_out_texts(spark):
    langs = [lang for lang in SYLLABLES for _ in range(60)]
    train = documents(spark, [sentence(x, i) for i, x in enumerate(langs)], langs=langs)
    net = language_id.fit(train)
    texts = [sentence(x, 1000 + i) for i, x in enumerate(langs)]
    edge = [None, "", "123 %%% 456", "x", sentence("de", 1, 30000)]
    out = language_id.identify(documents(spark, [*texts, *edge]).drop("score"), net)
    rows = {r.doc_id: r for r in out.collect()}
    right = sum(rows[i].lang_pred == x for i, x in enumerate(langs))
    assert right >= 0.97 * len(langs)
    n = len(texts)
    assert [rows[n + i].lang_pred for i in range(3)] == ["und"] * 3 and rows[n].score == 0
    assert rows[n + 3].lang_pred in SYLLABLES and rows[n + 4].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_without_labels_every_language_is_unknown(spark):
    docs = documents(spark, ["some text", None], langs=[None, None])
    assert language_id.fit(docs) is None
    assert {r.lang_pred for r in language_id.identify(docs.drop("score"), None).collect()} == {"und"}
    assert language_id.identify(docs.where("false").drop("score"), None).count() == 0


def test_columns_of_the_callers_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "text", 7, "x", "y")] * 2, "doc_id long, text string, score int, lang_pred string, _p string")
    rows = language_id.identify(docs, None).collect()
    assert [(r.doc_id, r.given_score, r.given_lang_pred, r["_p"], r.lang_pred, r.score) for r in rows] == [(1, 7, "x", "y", "und", 0.0)] * 2


def test_the_query_on_held_out_documents(spark):
    rows = language_id.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.96 * len(held)


def test_grades_on_held_out_texts(spark):
    rng = random.Random(2)

    def text(grade):
        w = [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvwxyz") for _ in range(80)]
        if grade == 0:
            w[5:5] = ["vile"]
        if grade == 1:
            w = [x + "%%%" for x in w]
        return " ".join(w)

    grade = [rng.randint(0, 2) for _ in range(1300)]
    docs = documents(spark, [text(g) for g in grade])
    graded = spark.createDataFrame([*list(enumerate(grade))[:1200], (None, 1), (1, None), (99999, 2)], "doc_id long, grade int")
    model = quality_classifier.fit(docs, graded)
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r.doc_id: r.s for r in docs.select("doc_id", quality_classifier.score_column(model)("text").alias("s")).collect()}
    right = sum((0 if rows[i].p_ge_1 < 0.5 else 1 if rows[i].p_ge_2 < 0.5 else 2) == grade[i] for i in range(1200, 1300))
    assert right >= 95
    assert all(abs(s.expected_grade - s.p_ge_1 - s.p_ge_2) < 1e-9 and s.p_ge_1 >= s.p_ge_2 for s in rows.values())


def test_grades_of_labelled_documents_held_out(spark):
    """Fitted without a third of the labels, asked for those."""
    sf = "/root/testdata/sf0.1"
    graded = quality_classifier.grades(spark.read.parquet(f"{sf}/labels.parquet")).where("grade is not null")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(docs, graded.where(~out))
    rows = docs.join(graded.where(out), "doc_id").select("grade", quality_classifier.score_column(model)("text").alias("s")).select("grade", "s.*").toPandas()
    told = (rows["p_ge_1"] >= 0.5).astype(int) + (rows["p_ge_2"] >= 0.5)
    p = np.select([rows["grade"] == 0, rows["grade"] == 1], [1 - rows["p_ge_1"], rows["p_ge_1"] - rows["p_ge_2"]], rows["p_ge_2"])
    assert (told == rows["grade"]).mean() > 0.9 and -np.log(np.clip(p, 1e-9, 1)).mean() < 0.35


def test_grading_without_labels_and_edge_texts(spark):
    docs = documents(spark, [None, "", " ", "word " * 50000])
    model = quality_classifier.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    rows = docs.select(quality_classifier.score_column(model)("text").alias("s")).collect()
    assert len({r.s.p_ge_1 for r in rows}) == 1
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality_classifier.grades(labels).collect()} == {1: 1, 2: 0, 3: 2, 4: None, 5: None}
