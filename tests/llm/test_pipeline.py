import os

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import line_dedup, packing
from siltworks.llm.common import shared_folder
from siltworks.llm.queries import QUERIES
from tests.llm.helpers import documents, words


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_the_stages_in_order(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "personal data", "packing"]
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    clean = [words(i, 80) for i in range(20)]
    shared = words(500, 60)
    texts = [*clean, "too short", None, clean[0], shared + "\n" + words(600, 60), shared + "\n" + words(601, 60), words(700, 60) + " me@mail.example.com"]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality rules":
            assert sorted(rows) == [*range(20), 22, 23, 24, 25]
        if name == "line dedup":
            assert 22 not in rows and rows[24].text == words(601, 60) and rows[23].text == texts[23]
        if name == "near-duplicates":
            assert sorted(rows) == [*range(20), 23, 24, 25]
        if name == "personal data":
            assert rows[25].text == words(700, 60) + " [EMAIL]" and all(rows[i].text == clean[i] for i in range(20))
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in run} == set(rows)
    assert len({r.sequence_id for r in run}) == packing.least_bins([r.length for r in run], packing.SIZE)


def test_an_empty_table_goes_through(spark, tmp_path):
    documents(spark, ["x"]).select("doc_id", "text", "lang", "source", "n_chars").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_name_of_a_column_clashes(spark):
    """A caller's columns may have the names of any helper's, and come out as they were."""
    helpers = "own spans _spans _of_doc of_doc _of_hash of_hash text_hash drop _drop _doc_id _text_hash _of of fp _fp n _n host h lines bad kept piece length start root component".split()
    texts = ["same line here\n" + words(i, 80) + f" u{i}@mail.example" for i in range(12)] + ["same line here\n" + words(0, 80) + " u0@mail.example"]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in helpers))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in helpers), name
    assert packing.pack_documents(docs, PATH).count() == 13


def test_null_ids_go_through_the_stages(spark):
    docs = documents(spark, [words(i, 80) for i in range(4)], ids=[None, 1, None, 2]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert sorted(r.doc_id is None for r in docs.collect()) == [False, False, True, True]


def test_scratch_tables_go(spark):
    """An operator leaves its result in the shared folder at most."""
    docs = documents(spark, [words(1, 60), words(1, 60), None])
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    line_dedup.drop_duplicate_lines(docs).collect()
    left = {x for x in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before if x.startswith("table-")}
    assert len(left) == 1
