"""The prefix trie against brute force, SQL and the edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from siltworks.llm import prefix_trie
from siltworks.llm.common import Scratch
from tests.llm.helpers import split

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a long, b long, n long, top long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(convs):
    """``convs``: conv_id to its list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for way, members in nodes.items():
        below = [w for w in nodes if w[: len(way)] == way]
        leaf = lambda w: not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in nodes)
        ends = sorted(c for c in members if len(convs[c]) == len(way))
        out.append((
            min(members), len(way), min(nodes[way[:-1]]) if way else None, len(members),
            sum(len(x) == len(way) + 1 and x[: len(way)] == way for x in nodes), sum(map(leaf, below)),
            sum((len(nodes[w]) - 1) * len(split(w[-1][1])) for w in below if w), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def told(nodes):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in nodes.collect()), key=repr)


def shared(seed, n):
    rng = random.Random(seed)
    pool = [("user", "a b"), ("user", "c"), ("assistant", "d e f"), ("system", ""), ("", "g")]
    return {i * 7: [rng.choice(pool[:2] if rng.random() < 0.7 else pool) for _ in range(rng.choice((1, 2, 3, 3, 6)))] for i in range(n)}


@pytest.mark.parametrize(("classes", "rows"), [(4096, 200_000), (4, 20), (1, 5)])
def test_nodes_against_brute_force(spark, classes, rows):
    convs = shared(classes, 60)
    turns = table(spark, [(c, t, *x) for c, own in convs.items() for t, x in enumerate(own)])
    with Scratch(spark) as scratch:
        nodes, tries = prefix_trie.prefix_trie(prefix_trie.keyed(turns), scratch, classes, rows)
        assert told(nodes) == brute(convs)
        assert tries.count() == 1 or classes < 4096


def test_a_shard_is_a_louds_trie(spark):
    """The bits alone give parents, numbers of children and depths back."""
    rows = [(1, 2, 1, 10, 0, 5, 3), (1, 2, 2, 20, 0, 6, 1), (3, 1, 1, 10, 0, 5, 3), (3, 1, 2, 21, 0, 4, 1), (9, 1, 1, 30, 0, 1, 2)]
    trie = prefix_trie.build(pd.DataFrame(rows, columns=["conv_id", "n", "depth", "a", "b", "label", "words"]))
    # super-root with two tops (labels 1, 5), then the tops and the two nodes below the second
    assert "".join(map(str, trie["bits"])) == "110" + "0" + "110" + "0" + "0"
    assert trie["label"].tolist() == [1, 5, 4, 6] and prefix_trie.parents(trie["bits"]).tolist() == [-1, -1, 1, 1]
    assert trie["n_convs"].tolist() == [1, 3, 1, 2] and trie["n_leaves"].tolist() == [1, 2, 1, 1]
    assert trie["saved_tokens"].tolist() == [0, 7, 0, 1] and trie["parent_conv_id"].tolist() == [-1, -1, 1, 1]
    rng = np.random.default_rng(0)
    parent = np.sort(np.r_[-1, [rng.integers(-1, i) for i in range(1, 200)]])
    assert prefix_trie.parents(prefix_trie.louds(parent, parent)).tolist() == parent.tolist()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def test_the_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("x y", "", None, "z", "long " * 50_000))) for c in [*range(45), 60, 61, 79, 100, 103] for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no one"), (0, None, "system", "first"), (7, None, None, None)]
    rows += [(200 + k, t, "user", f"copy {t}") for k in range(30) for t in range(3)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    nodes = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert told(nodes) == brute(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.execute(prefix_trie.SQL)
    assert [d[0] for d in got.description] == nodes.columns
    assert sorted(got.fetchall(), key=repr) == told(nodes)


def test_repeated_rows_are_turns_of_their_own(spark):
    turns = table(spark, [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x")])
    with Scratch(spark) as scratch:
        nodes, _ = prefix_trie.prefix_trie(prefix_trie.keyed(turns), scratch)
        assert told(nodes) == brute({1: [("user", "x")] * 2, 2: [("user", "x")]})


def test_only_conversations_without_turns(spark, tmp_path):
    """Each loses its only turns and gets none; the root is a leaf."""
    lone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    table(spark, [(c, 0, "user", "x") for c in lone]).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(prefix_trie.op13_prefix_trie(spark, str(tmp_path))) == brute(dict.fromkeys(lone, []))


def test_an_empty_table_gives_no_node(spark, tmp_path):
    table(spark, [(1, 0, "user", "x")]).where("false").write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_blocks_of_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    convs = {i: [("user", "same")] for i in [*range(17), 100, 101]}
    with Scratch(spark) as scratch:
        nodes, _ = prefix_trie.prefix_trie(prefix_trie.keyed(table(spark, [(c, 0, *v[0]) for c, v in convs.items()])), scratch)
        assert told(nodes) == brute(convs)
