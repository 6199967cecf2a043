import random

from siltworks.llm import components as cc
from siltworks.llm import line_dedup as ld
from siltworks.llm.common import Scratch
from tests.llm.helpers import Groups, documents, words


def shingles(line):
    return {line[i : i + ld.SHINGLE] for i in range(len(line) - ld.SHINGLE + 1)} or {line}


def plain(docs):
    """What goes: {doc_id: [line numbers]}, by comparing all lines."""
    places = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        for i, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(" \t\r").lower():
                places.setdefault(line, []).append((doc, i))
    groups = Groups(places)
    sets = [(x, shingles(x)) for x in places]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if len(x & y) >= ld.THRESHOLD * len(x | y):
                groups.join(a, b)
    first, gone = {}, {}
    for line, at in places.items():
        root = groups.find(line)
        first[root] = min(first.get(root, at[0]), *at)
    for line, at in places.items():
        for doc, i in at:
            if (doc, i) != first[groups.find(line)]:
                gone.setdefault(doc, []).append(i)
    return {d: sorted(x) for d, x in gone.items()}


def removed(docs):
    own = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        return {r.doc_id: list(r.drop) for r in ld.removed_lines(own, ld.occurrences(own), scratch).collect()}


def edited(line, seed):
    rng, w = random.Random(seed), line.split(" ")
    w[rng.randrange(len(w))] = "edited"
    return " ".join(w)


LINE = words(77, 60)
TEXTS = [
    None, "", "\n\n", "short\nshort\nshort\r\n\tshort", LINE, "  " + LINE.upper() + " \n" + words(5, 30), edited(LINE, 1), edited(LINE, 2) + "\n" + words(6, 30),
    words(5, 30) + "\nexactly 16 bytes\nexactly 16 bytes", "é" * 60 + "\n" + "é" * 60, words(8, 20000), words(8, 20000) + " x", words(9, 40) + "\n" + edited(words(9, 40), 3),
]


def test_same_lines_go_as_by_brute_force(spark):
    docs = documents(spark, TEXTS)
    want = plain(enumerate(TEXTS))
    assert removed(docs) == want
    out = ld.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(TEXTS):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want.get(i, []))
        assert rows[i].text == kept and (kept is None or rows[i].n_chars == len(kept))


def test_emptied_documents_go_on_request(spark):
    docs = documents(spark, [LINE, LINE, None, "", LINE + "\nand one more line"])
    out = {r.doc_id: r.text for r in ld.drop_duplicate_lines(docs, emptied=False).collect()}
    assert out == {0: LINE, 2: None, 3: "", 4: "and one more line"}


def test_high_recall_in_groups_of_alike_lines(spark):
    texts = []
    for g in range(40):
        line = words(1000 + g, 40)
        texts += [line, *(edited(line, s) for s in range(3))]
    texts += [words(5000 + i, 30) for i in range(100)]
    want = plain(enumerate(texts))
    got = set(removed(documents(spark, texts)))
    assert not got - set(want)
    assert len(got) >= 0.97 * len(want) > 0


def test_a_large_group_without_its_middle(spark):
    # copies with many edits each: few are alike, and which are must not depend on the bucket's central line
    texts = [edited(edited(edited(words(4000, 30), s), s + 1), s + 2) for s in range(300)]
    want, got = plain(enumerate(texts)), removed(documents(spark, texts))
    assert not set(got) - set(want) and len(got) >= 0.97 * len(want) > 100


def bucket(spark, roots, lead_root):
    """members of a bucket (h, of a component each), and sketches that rule nothing out."""
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(1, h, root) for h, root in enumerate(roots)], "key long, h long, root long")
    members = members.withColumn("turn", ld.turn(F.col("h"), F.lit(len(roots)))).withColumn("lead_root", F.lit(lead_root).cast("long"))
    own = F.struct(F.lit(1).alias("size"), *(F.lit(0).cast("long").alias(f"w{k}") for k in range(ld.WORDS)))
    return members, members.select("h", own.alias("own"))


def test_a_group_apart_from_its_buckets_centre_is_not_expanded_to_pairs(spark):
    # two components of one bucket: any link joins them, so the 360,000 pairs must not all be made for it
    met = ld.meetings(*bucket(spark, [h % 2 for h in range(1200)], 0), 1)
    assert 600 < met.count() < 4 * ld.LEADS * 600 < 600 * 600 / 4


def test_every_candidate_of_other_components_meets_once(spark, monkeypatch):
    monkeypatch.setattr(ld, "LEADS", 8)
    roots = [2 if h < 20 else h % 3 + 7 for h in range(60)]
    members, sketches = bucket(spark, roots, 2)
    met = [(r.a, r.b, r.root_a, r.root_b) for now in (1, 2, 3) for r in ld.meetings(members, sketches, now).collect()]
    assert sorted(met) == sorted((a, b, roots[a], roots[b]) for a in range(60) for b in range(a + 1, 60) if roots[a] != roots[b])


def test_pairs_are_tested_by_the_sizes_of_their_sketches(spark):
    from pyspark.sql import functions as F

    same, repeated = words(1, 25), "one phrase after another, " * 9
    texts = [same, edited(same, 1), repeated, repeated + repeated, edited(edited(edited(same, 2), 3), 4), same + " é" * 9]
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    sketches = ld.sketched(lines).select("h", F.col("size"))
    pairs = sketches.select(F.col("h").alias("a"), F.col("size").alias("size_a")).join(sketches.select(F.col("h").alias("b"), F.col("size").alias("size_b")), F.col("a") < F.col("b"))
    told = ld.similar(pairs, lines)
    sets = [shingles(t) for t in texts]
    assert sorted((r.a, r.b) for r in told.collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    # one shared set for each pair; distinct sets of both lines are made for sketches only
    own = lines.select(F.col("h").alias("a"), (F.col("h") + 1).alias("b"), F.lit(1).alias("size_a"), F.lit(1).alias("size_b"))
    assert "array_distinct" not in ld.similar(own, lines)._jdf.queryExecution().optimizedPlan().toString()


def test_short_lines_and_ends_in_several_scripts(spark):
    letters = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "han": "".join(map(chr, range(0x4E00, 0x4E40)))}
    rng, texts = random.Random(4), []
    for alphabet in letters.values():
        for n in (13, 17, 29, 40, 90) * 8:
            line = "".join(rng.choice(alphabet) for _ in range(n))
            texts += [line, line + ".", rng.choice(alphabet) + line, line[1:]]
    want, got = plain(enumerate(texts)), removed(documents(spark, texts))
    assert not set(got) - set(want) and len(got) >= 0.95 * len(want) > 200


def test_long_lines_of_few_distinct_shingles(spark):
    phrases = ("buy now! ", "one long line of a repeated phrase, ", "aaaaaaaaaaaaaaab", "= ")
    texts = [p * (1000 + k) for p in phrases for k in range(2)]
    assert set(removed(documents(spark, texts))) == {1, 3, 5, 7}


def test_the_sketch_rules_out_no_similar_pair(spark):
    texts = [t for g in range(30) for t in (words(g, 25), edited(words(g, 25), 1), edited(edited(words(g, 25), 2), 5))]
    sketches = ld.sketched(spark.createDataFrame(list(enumerate(texts)), "h long, line string"))
    from pyspark.sql import functions as F

    own = sketches.select("h", F.struct(*[c for c in sketches.columns if c != "h"]).alias("own"))
    pairs = own.select(F.col("h").alias("a"), F.col("own").alias("x")).crossJoin(own.select(F.col("h").alias("b"), F.col("own").alias("y")))
    left = {(r.a, r.b) for r in pairs.where("a < b").where(ld.may_be_similar("x", "y")).select("a", "b").collect()}
    sets = [shingles(t) for t in texts]
    alike = {(a, b) for a in range(90) for b in range(a + 1, 90) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike <= left and len(left) < 60 <= len(alike) + 60


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = documents(spark, [LINE] * 4, ids=[3, 3, None, 1])
    rows = ld.drop_duplicate_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, LINE), (1, ""), (3, ""), (3, "")]
    assert ld.drop_duplicate_lines(docs.where("false")).count() == 0


def test_the_main_path_runs_no_python_and_leaves_no_table(spark):
    docs = documents(spark, TEXTS)
    assert "Python" not in ld.drop_duplicate_lines(docs)._jdf.queryExecution().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_components_take_no_round_that_changes_nothing(spark, monkeypatch):
    rounds, star = [], cc._small_star
    monkeypatch.setattr(cc, "_small_star", lambda edges: rounds.append(1) or star(edges))

    def told(links):
        rounds.clear()
        return {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}, len(rounds)

    assert told([(1, 5), (6, 1), (7, 1), (9, 8), (8, 9), (3, 3), (None, 4)]) == ({1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8}, 0)
    assert told([(3, 3), (None, 2)]) == ({}, 0)
    assert told([(k, k + 1) for k in range(40)])[0] == dict.fromkeys(range(41), 0)
    rng = random.Random(5)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    groups = Groups(range(90))
    for a, b in links:
        groups.join(a, b)
    assert told(links)[0] == {x: groups.find(x) for a, b in links if a != b for x in (a, b)}


def test_a_round_of_components_reads_its_links_four_times(spark):
    # every reading is another branch of the plan, which the driver holds
    edges = spark.range(9).selectExpr("id + 1 as u", "id as v")
    assert cc._small_star(cc._large_star(edges))._jdf.queryExecution().optimizedPlan().toString().count("Range") == 4
