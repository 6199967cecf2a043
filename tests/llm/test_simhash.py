import random

import numpy as np
import xxhash

from siltworks.llm import simhash
from siltworks.llm.components import components
from tests.llm.helpers import Groups, documents, split, words


def plain(text):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def changed(text, n, seed):
    w, rng = text.split(" "), random.Random(seed)
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


BASE = words(1, 400)
TEXTS = [None, "", "a", "A  b\tC", "a b c", "a b c d", "é À b c d", *(words(i, 30) for i in range(2, 40)), *(changed(BASE, i % 9, i) for i in range(40)), BASE, words(50, 30000)]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in TEXTS] == [plain(t) for t in TEXTS]


def test_components_are_those_of_all_pairs(spark):
    docs = documents(spark, [*TEXTS, *TEXTS[:9]], ids=[*range(len(TEXTS)), *range(1000, 1008), None])
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: f & (1 << 64) - 1 for i, (f, _) in got.items() if i is not None}
    groups = Groups(prints)
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                groups.join(i, j)
    assert {i: got[i][1] for i in prints} == {i: groups.find(i) for i in prints}
    assert got[None][1] == groups.find(8)
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i in prints if groups.find(i) == i)


def test_one_of_rows_that_share_an_id_stays(spark):
    docs = documents(spark, ["a b c d e"] * 3 + [words(4, 50), None], ids=[1, 1, 2, 1, 1])
    assert sorted(r.text or "" for r in simhash.drop_near_duplicates(docs).collect()) == sorted(["", "a b c d e", words(4, 50)])
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_trees_lose_no_link(spark, monkeypatch):
    """Shards and leaves so small that routing, overlaps, blocks and chunks all happen."""
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "VISITORS", 200)
    monkeypatch.setattr(simhash, "SAMPLE", 64)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    prints = set(map(int, centres))
    for c in map(int, centres[:60]):
        for _ in range(6):
            for bit in rng.choice(64, 3, replace=False):
                c ^= 1 << int(bit)
            prints.add(c)
    prints |= {0} | {(1 << k) for k in range(64)}
    prints = sorted(prints)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.links(table)).collect()}
    groups = Groups(prints)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                groups.join(a, b)
    want, got = {}, {}
    for p in prints:
        want.setdefault(groups.find(p), set()).add(p)
        got.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_chain_a_star_and_nulls(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (3, None), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
