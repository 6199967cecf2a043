"""Structure repair against brute force, SQL and the edge cases."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest

from siltworks.llm import structure
from tests.llm.helpers import split

SCHEMA = "conv_id long, turn long, role string, text string, signature string, audit string, digest string, is_row int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "d", 7) for r in rows], SCHEMA)


def brute(signature, most=2):
    """Every sequence of edits with up to ``most`` inserts before each place; (cost, audit)."""
    found = []

    def go(i, roles, cost, audit, inserted):
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserted < most:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserted + 1)
        if i == len(signature):
            return
        go(i + 1, roles, cost + 3, audit + "D", 0)
        c = signature[i]
        if c != "d":
            late = int(c.isupper())
            go(i + 1, roles + c.lower(), cost + late, audit + "K", 0)
            for r in "ua":
                go(i + 1, roles + r, cost + 2 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_audits_are_the_cheapest_of_all():
    for n in range(4):
        for s in itertools.product("suaxUd" if n == 3 else "suaxSUAXd", repeat=n):
            assert structure.solve("".join(s)) == brute("".join(s)), s
    rng = random.Random(3)
    for _ in range(12):
        s = "".join(rng.choice("suaxUAd") for _ in range(5))
        assert structure.solve(s) == brute(s, 1), s


def test_long_signatures_need_no_deep_recursion():
    cost, audit = structure.solve("su" + "au" * 20_000 + "d")
    assert cost == 5 and audit == "K" * 40_002 + "DI"


def plain(rows):
    """The contract, read anew: conv_id to its result. ``rows`` are after damage, nulls filled."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, faults, codes = set(), [], ""
        for _, _, role, text in own:
            last = split(text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1][-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        firsts = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = structure.solve(codes)
        parts, i, led = [], 0, False
        for letter in audit:
            if letter == "I":
                parts.append(("", None))
                continue
            if letter != "D":
                led |= letter == "K" and own[i][2][:1] == "s"
                parts.append((own[i][3], own[i][2] if letter == "K" else None))
            i += 1
        named = [f"{role if role is not None else ('user', 'assistant')[(k - led) % 2]}:{text}" for k, (text, role) in enumerate(parts)]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(named).encode()).hexdigest())
    return out


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Yes?"), (1, 4, "user", "so"),
        (2, None, None, None), (2, 3, "tool", "x "), (2, None, "system", "be good!"), (2, 9, "assistant", "b.\n"),
        (None, 0, "user", "q!"), (None, 1, "assistant", "a.  "),
        (3, 5, "", "\t \n"), (3, 5, "system", "only."),
        (4, 0, "user", "w " * 200_000 + "."), (4, 1, "assistant", "\U0001f600."),
        *((5, i, "user", f"{i}.") for i in range(300)),
    ]
    turns = table(spark, rows)
    audits = structure.audit_conversations(turns)
    told = {r["conv_id"]: r for r in audits.join(structure.digests(structure.repair_conversations(turns, audits)).withColumnRenamed("conv_id", "of"), audits.conv_id.eqNullSafe(structure.F.col("of")), "left").collect()}
    want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert set(told) == set(want)
    for conv, r in told.items():
        got = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
        assert (*got, r["repaired_sha256"] or structure.NO_ROWS) == want[conv], conv
    repaired = structure.repair_conversations(turns, audits).where("conv_id = 5").orderBy("position").collect()
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in repaired)) and {r["text"] for r in repaired if r["edit"] != "I"} <= {f"{i}." for i in range(300)}


def test_an_empty_table_gives_no_row(spark):
    turns = table(spark, [(1, 0, "user", "x")]).where("false")
    audits = structure.audit_conversations(turns)
    assert audits.count() == 0 and structure.digests(structure.repair_conversations(turns, audits)).count() == 0


def test_the_query_gives_what_its_sql_gives(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = structure.op11_structure_repair(spark, sf)
    got = con.execute(structure.SQL)
    assert [d[0] for d in got.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(got.fetchall())


def test_damage_keeps_every_conversation(spark, tmp_path):
    """A conversation of which all rows are dropped, and nulls in every column."""
    import zlib

    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "x."), (None, None, None, None), (50, None, "user", "x."), (50, 2, None, "Hm. Ok! so"), (50, 2, "assistant", "y")]
    path = f"{tmp_path}/sf"
    os.makedirs(path)
    table(spark, rows).write.parquet(f"{path}/conversations.parquet")
    df = structure.op11_structure_repair(spark, path)
    told = {r["conv_id"]: r for r in df.collect()}
    assert set(told) == {dropped, None, 50}
    assert tuple(told[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", structure.NO_ROWS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(structure.SQL).fetchall()))


@pytest.mark.parametrize("n", [0, 1])
def test_signatures_of_few_rows(spark, n):
    assert [r["signature"] for r in structure.signatures(table(spark, [(1, 0, "user", "x")] * n)).collect()] == ["U"] * n
