"""Conversation structure repair by signature deduplication.

A conversation's rows are encoded as a compact string with a character a row: the
class of its role (s, u, a, else x), in capitals where its text is cut off, or d
where it has to go (blank or a repeat). Conversations of one signature need the
same edits, so each distinct signature is solved once, by memoised recursion over
the places in it, and the edits (the audit) are joined back and replayed over the
rows.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert an
empty user or assistant turn (2); a cut-off row that stays costs 1 more. The
audit is the cheapest sequence whose kept roles are a possible system turn and
then one or more pairs of user and assistant, or nothing; of several it is the
least by the initials D, I, K, R.

Rows of a conversation are streamed in order through a task, so memory holds one
batch, a digest a row of one conversation, and its signature. Texts are exchanged
once, for the replay.

Edge cases: a null role or text is one space, so a null text is blank; rows are
ordered by turn (nulls first), role and digest of the text, so ties and repeated
rows have one order and an equal row is a duplicate; a null conv_id is a
conversation of its own; conversations and texts of any length are taken whole;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import CRC32, read, table

COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: Conversation so far: nothing, a system turn, then ended in a user's or an assistant's turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Places that one descent of the recursion may go down.
DESCENT = 150
#: Rows of a batch that is given back.
BATCH = 2000
NO_ROWS = hashlib.sha256(b"").hexdigest()
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def filled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with a space for null roles and texts."""
    space = F.lit(" ")
    return turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one partition, one after another and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest")


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each run of rows with one conv_id."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    own, out, first = None, [], True

    def close() -> None:
        span = own["last"] - own["least"] + 1 - own["turns"] if own["turns"] else 0
        out.append((own["id"], span, own["blank"], own["duplicate"], own["truncated"], own["illegal"], own["signature"].decode()))

    for rows in batches:
        for conv, turn, role, digest, fault in zip(rows["conv_id"], rows["turn"], rows["role"], rows["digest"], rows["fault"]):
            conv, turn = (None if pd.isna(x) else int(x) for x in (conv, turn))
            if first or conv != own["id"]:
                if not first:
                    close()
                first = False
                own = {"id": conv, "least": turn, "last": None, "turns": 0, "before": "", "seen": set(), "signature": bytearray()}
                own |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            if turn is not None and turn != own["last"]:
                own["least"] = turn if own["last"] is None else own["least"]
                own["last"], own["turns"] = turn, own["turns"] + 1
            if fault != "blank" and digest in own["seen"]:
                fault = "duplicate"
            own["seen"].add(digest)
            if fault:
                own[fault] += 1
            role = role if role in "sua" else "x"
            own["illegal"] += len(own["signature"]) > 0 and own["before"] + role not in ("su", "ua", "au")
            own["before"] = role
            own["signature"] += ("d" if fault in ("blank", "duplicate") else role.upper() if fault else role).encode()
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        out.clear()
    if not first:
        close()
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature of every conversation.

    A row's first fault counts: blank, duplicate (role and text stood before),
    truncated. illegal counts neighbours whose roles don't follow; gaps are the
    turn numbers missing between the least and the last.
    """
    last = F.regexp_extract("text", rf"(?s)({_WORD}){_SPACE}*\z", 1)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    rows = filled(turns).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", _digest().alias("digest"), fault.alias("fault"))
    rows = _ordered(rows).select("conv_id", "turn", F.coalesce(F.nullif("initial", F.lit("")), F.lit("x")).alias("role"), "digest", "fault")
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return rows.mapInPandas(_encode, f"conv_id long, {counts}, signature string")


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def solve(signature: str) -> tuple[int, str]:
    """The least cost of a signature and its audit.

    ``best(place, state, inserted)`` is remembered for each place, state and number
    of turns just inserted (more than two in a row are never cheapest). Where costs
    tie, the letters of the choices differ and the least letter wins, so a
    remembered choice is the least audit from there on. Places are asked for from
    the end in strides, which keeps the recursion shallow.
    """
    n = len(signature)
    cost, choice, never = array("q", [-1]) * ((n + 1) * 12), bytearray((n + 1) * 12), 1 << 40

    def best(i: int, state: int, inserted: int) -> int:
        at = (i * 4 + state) * 3 + inserted
        if cost[at] >= 0:
            return cost[at]
        options = []
        if inserted < 2:
            options.append((COST["I"] + best(i, _next(state), inserted + 1), "I"))
        if i == n:
            options.append((0 if state in (EMPTY, ASSISTANT) else never, ""))
        else:
            options.append((COST["D"] + best(i + 1, state, 0), "D"))
            role, late = signature[i].lower(), int(signature[i].isupper())
            if role != "d":
                to = {"s": SYSTEM if state == EMPTY else None, "u": USER, "a": ASSISTANT}.get(role)
                if to is not None and to in (SYSTEM, _next(state)):
                    options.append((COST["K"] + late + best(i + 1, to, 0), "K"))
                options.append((COST["R"] + late + best(i + 1, _next(state), 0), "R"))
        cost[at], letter = min(options)
        choice[at] = ord(letter or "\0")
        return cost[at]

    for i in range(n, 0, -DESCENT):
        for state in range(4):
            best(i, state, 0)
    least = best(0, EMPTY, 0)
    audit, i, state, inserted = [], 0, EMPTY, 0
    while letter := chr(choice[(i * 4 + state) * 3 + inserted]).strip("\0"):
        audit.append(letter)
        if letter == "I":
            state, inserted = _next(state), inserted + 1
            continue
        if letter == "R" or (letter == "K" and signature[i].lower() != "s"):
            state = _next(state)
        elif letter == "K":
            state = SYSTEM
        i, inserted = i + 1, 0
    return least, "".join(audit)


def _solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        solved = [(s, *solve(s)) for s in rows["signature"]]
        yield pd.DataFrame(solved, columns=["signature", "cost", "audit"])


def audit_conversations(turns: DataFrame) -> DataFrame:
    """:func:`signatures` of ``turns`` with cost and audit; each distinct signature is solved once."""
    told = table(signatures(turns))
    solved = told.select("signature").distinct().mapInPandas(_solve_all, "signature string, cost long, audit string")
    # a signature may be that of a third of all conversations: a plain join, whose large side Spark can split
    return told.join(solved, "signature")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a conversation come after the row that holds its audit."""
    names, out = ["conv_id", "position", "edit", "role", "text"], []
    conv, audit, at, state, place = None, "", 0, EMPTY, 0

    def put(edit: str, role: str, text: str) -> None:
        nonlocal state, place
        state = SYSTEM if edit == "K" and role[:1] == "s" else _next(state)
        out.append((conv, place, edit, role, text))
        place += 1

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", "assistant" if state == USER else "user", "")
            at += 1

    def batch() -> pd.DataFrame:
        got = pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        out.clear()
        return got

    for rows in batches:
        for own, turn_audit, role, text in zip(rows["conv_id"], rows["audit"], rows["role"], rows["text"]):
            if turn_audit is not None:
                inserts()
                conv, audit, at, state, place = (None if pd.isna(own) else int(own)), turn_audit, 0, EMPTY, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                put("K", role, text)
            elif edit == "R":
                put("R", "assistant" if state == USER else "user", text)
            if len(out) >= BATCH:
                yield batch()
        yield batch()
    inserts()
    yield batch()


def repair_conversations(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role and text of every turn of the repaired ``turns``.

    ``audits`` come of :func:`audit_conversations`. Turns of a conversation come in
    one partition, together and in order.
    """
    rows = filled(turns).select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", _digest().alias("digest"), F.lit(None).cast("string").alias("audit"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    heads = audits.select("conv_id", F.lit(0).alias("is_row"), *nothing, "audit")
    both = _ordered(heads.unionByName(rows), "is_row").select("conv_id", "audit", "role", "text")
    return both.mapInPandas(_replay, "conv_id long, position long, edit string, role string, text string")


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, out = ["conv_id", "repaired_sha256"], []
    conv, sha = None, None
    for rows in batches:
        for own, place, role, text in zip(rows["conv_id"], rows["position"], rows["role"], rows["text"]):
            if place == 0:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = (None if pd.isna(own) else int(own)), hashlib.sha256()
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        out.clear()
    if sha is not None:
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=names).astype({"conv_id": "Int64"})


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of :func:`repair_conversations`' turns, hashed as they come."""
    return repaired.mapInPandas(_hash, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults by crc32(conv_id:turn) % 20: dropped, emptied, cut off, repeated, given to the user."""
    space = F.lit(" ")
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = filled(turns).withColumn("damage", F.crc32(key) % 20).where("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, audit and digest of the repair of every damaged conversation."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    audits = table(audit_conversations(rows))
    told = audits.join(digests(repair_conversations(rows, audits)).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    told = told.withColumnRenamed("conv_id", "own").drop("of")
    out = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NO_ROWS)).alias("repaired_sha256"))


SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), t AS (
  SELECT *, {CRC32.format("key")} % 20 AS damage FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM t WHERE damage <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text), copy) AS place,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM d
), f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM o
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END, '' ORDER BY place) AS signature,
    list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts
  FROM f GROUP BY conv_id
), v AS (
  -- the cheapest way to each state (nothing, system, user, assistant) before row i; inserts come first
  SELECT DISTINCT signature, 1 AS i, {{'c': 0, 'a': ''}} AS e, {{'c': 999999, 'a': ''}} AS y, {{'c': 999999, 'a': ''}} AS u, {{'c': 999999, 'a': ''}} AS b FROM s
  UNION ALL
  SELECT signature, i + 1, e2, y2, u2, b2 FROM (
    SELECT signature, i,
      {{'c': e.c + 3, 'a': e.a || 'D'}} AS e2,
      list_min([{{'c': y.c + 3, 'a': y.a || 'D'}}, {{'c': CASE WHEN r = 's' THEN e.c + late ELSE 999999 END, 'a': e.a || 'K'}}]) AS y2,
      list_min(list_concat([{{'c': u1.c + 3, 'a': u1.a || 'D'}}], list_transform([e, y, b1],
        lambda x: {{'c': CASE WHEN r = 'u' THEN x.c + late WHEN r = 'd' THEN 999999 ELSE x.c + 2 + late END, 'a': x.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}}))) AS u2,
      list_min([{{'c': b1.c + 3, 'a': b1.a || 'D'}},
        {{'c': CASE WHEN r = 'a' THEN u1.c + late WHEN r = 'd' THEN 999999 ELSE u1.c + 2 + late END, 'a': u1.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}}]) AS b2
    FROM (SELECT *, lower(signature[i]) AS r, CASE WHEN signature[i] = lower(signature[i]) THEN 0 ELSE 1 END AS late,
        list_min([b, {{'c': u1.c + 2, 'a': u1.a || 'I'}}]) AS b1
      FROM (SELECT *, list_min([u, {{'c': e.c + 2, 'a': e.a || 'I'}}, {{'c': y.c + 2, 'a': y.a || 'I'}}, {{'c': b.c + 2, 'a': b.a || 'I'}}]) AS u1
        FROM v WHERE i <= length(signature))))
), z AS (
  SELECT signature, list_min([e, b, {{'c': u1.c + 2, 'a': u1.a || 'I'}}]) AS best
  FROM (SELECT *, list_min([u, {{'c': e.c + 2, 'a': e.a || 'I'}}, {{'c': y.c + 2, 'a': y.a || 'I'}}]) AS u1 FROM v WHERE i = length(signature) + 1)
), l AS (
  SELECT s.conv_id, s.roles, s.texts, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS j FROM s JOIN z USING (signature)
), m AS (
  SELECT *, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS pick FROM l
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS place,
    max(CASE WHEN edit = 'K' AND roles[pick][1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM m WHERE edit <> 'D'
), r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN roles[pick] WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[pick] END, chr(10) ORDER BY place)) AS repaired_sha256 FROM n GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cast(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
  LEFT JOIN z USING (signature) LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
