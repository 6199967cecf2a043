from collections import Counter

from siltworks.llm import quality_rules as q
from tests.llm.helpers import documents, split, words


def plain(text):
    w = split(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\nx\n \nX\nx", "é😀 ## <b> | y", "one\x1ctwo\x85three", words(1, 30000), "a b c d " * 2000]


def test_base_counts(spark):
    rows = q.document_features(documents(spark, TEXTS)).collect()
    assert {r.doc_id: tuple(r)[3:8] for r in rows} == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_lines_above_the_limit_go_and_depleted_documents_too(spark):
    shared = "This Page uses 7 cookies of all kinds for you"
    good = [words(i, 60) + "\n" + shared.replace("7", str(i)).upper() for i in range(30)]
    thin = [shared + "\n" + words(900 + i, 5) for i in range(3)]
    depleted = [words(100 + i, 25) + "\n" + words(500, 50) for i in range(15)]
    copies = [words(700, 80) + "\n" + words(701, 80)] * 40
    docs = documents(spark, [*good, *thin, *depleted, *copies, None])
    rows = {r.doc_id: r for r in q.judge(q.document_features(docs)).collect()}
    n = 0
    assert all(rows[i].kept and rows[i].n_removed == 10 for i in range(30))
    assert all(not rows[30 + i].kept for i in range(3))
    assert all(not rows[33 + i].kept and not rows[33 + i].base_failed for i in range(15))
    assert all(rows[48 + i].kept and rows[48 + i].n_removed == 0 for i in range(40)), n
    out = q.apply_quality_rules(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert len(left) == 70 and left[0].text == good[0].split("\n")[0] and left[0].n_chars == len(left[0].text)
    assert left[60].text == copies[0]


def test_hosts_are_apart_and_null_is_one(spark):
    line = words(3, 20)
    texts = [line + "\n" + words(10 + i, 60) for i in range(24)]
    docs = documents(spark, texts, sources=["a"] * 8 + [None] * 16)
    rows = {r.doc_id: r.n_removed for r in q.judge(q.document_features(docs)).collect()}
    assert [rows[i] for i in range(24)] == [0] * 8 + [20] * 16


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [words(1, 60)] * 3, ids=[5, 5, None])
    assert q.judge(q.document_features(docs)).count() == 3
    assert q.apply_quality_rules(docs).count() == 3
    assert q.apply_quality_rules(docs.where("false")).count() == 0
