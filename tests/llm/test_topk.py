import math

import numpy as np

from siltworks.llm import topk


def plain(vectors, every, k):
    held = [(i, np.floor(256 * np.array(v, float))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in held), default=0)
    held = [(i, np.pad(v, (0, width - len(v)))) for i, v in held]
    out = {}
    for q in {i for i, _ in held if i % every == 0}:
        own = min((tuple(v) for i, v in held if i == q))
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(own, v)), i) for i, v in held if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def search(spark, vectors, every=5, k=5):
    table = topk.quantised(spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string"))
    found = {}
    for r in topk.top_k(table.where(f"vec_id % {every} = 0"), table, k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(rows)] for q, rows in found.items()}


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 0.2, 33).tolist()) for i in range(400)]
    vectors += [(1000 + i, [0.5] * 33) for i in range(40)] + [(2000, None), (2001, [None] * 33), (2002, [float("nan")] * 33), (2003, [float("inf")] * 33), (None, [1.0])]
    assert search(spark, vectors) == plain(vectors, 5, 5)


def test_few_rows_ties_and_huge_components(spark):
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    assert search(spark, [(0, [1.0]), (3, [1.0]), (2, [1.0])]) == {0: [(2, 65536), (3, 65536)]}
    big = [(i, [float(2.0**20 + i), float(-i)]) for i in range(12)]
    assert search(spark, big) == plain([(i, np.float32(v).tolist()) for i, v in big], 5, 5)
    assert search(spark, []) == {}
    assert search(spark, [(0, []), (1, [2.0]), (2, [])]) == {0: [(1, 0), (2, 0)]}


def test_components_beyond_64_bits_rank_exactly(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, np.float32(rng.normal(0, 1, 40) * (1e30 if i % 3 else 1)).tolist()) for i in range(60)]
    vectors += [(100, vectors[1][1]), (101, np.negative(vectors[1][1]).tolist()), (102, [2.0**62] + [0.0] * 39)]
    want = plain(vectors, 5, 5)
    low, high = -(2**63), 2**63 - 1
    assert any(abs(s) > high for rows in want.values() for _, s in rows)
    assert search(spark, vectors) == {q: [(i, min(max(s, low), high)) for i, s in rows] for q, rows in want.items()}


def test_repeated_ids_are_rows_of_their_own(spark):
    vectors = [(0, [1.0, 0.5]), (0, [0.5, 0.5]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])]
    assert search(spark, vectors) == plain(vectors, 5, 5)
    assert len(search(spark, vectors)[0]) == 4


def test_meetings_hand_on_what_queries_have_reached():
    rng = np.random.default_rng(5)
    q, c = np.floor(rng.normal(0, 60, (20, 70))), np.floor(rng.normal(0, 60, (300, 70)))
    c[150:] /= 4
    c = np.floor(c)
    qi, ci, got, before = np.arange(20) + 1000, np.arange(300), [], None
    for i in range(0, 300, 50):
        a, b, s, before = topk.meet(qi, q, ci[i : i + 50], c[i : i + 50], 5, before)
        got += zip(a.tolist(), s.tolist(), b.tolist())
    for row, name in enumerate(qi):
        whole = sorted(((-int(s), int(j)) for j, s in enumerate(c @ q[row])))[:5]
        assert sorted((-s, j) for n, s, j in got if n == name)[:5] == whole
        assert sorted(before[row].tolist(), reverse=True) == [-s for s, _ in whole]


def test_tasks_follow_the_candidates(spark):
    """Many partitions make more groups, and the result is the same."""
    rows = [(i, [((i * 7 + k * 13) % 29) / 29 - 0.5 for k in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few, many = (topk.quantised(df.repartition(n)) for n in (2, 100))
    asked = lambda v: v.where("vec_id % 50 = 0")
    told = [sorted(map(tuple, topk.top_k(asked(v), v, 5).collect())) for v in (few, many)]
    assert told[0] == told[1] and len(told[0]) == 40 and -(-100 // topk.PARTITIONS) > topk.SPREAD
