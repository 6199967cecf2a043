"""Conversation prefix trie: which conversations share which first turns.

Turns are told apart by two 64-bit hashes of role and text; a node (the first d
turns) by d and two hashes of its turns. Texts never travel.

1. Conversations with the same turns are one class, counted before anything is
   built, so copies cost one path.
2. A prefix that more than ``shard_classes`` classes share is heavy, and so is the
   root. Below them lie the shards: each holds whole subtrees whose tops' hashes
   agree, and of about ``shard_rows`` turns.
3. A shard is built by numpy as a level-order trie: a LOUDS bitvector (a one for
   each child, then a zero, for every node from the super-root on) and arrays of
   labels and counts. Parents are read from the bitvector, and sums over subtrees
   are made from the last level up by ``np.add.at``.
4. The heavy levels are merged by sums over what the tops of the shards and the
   heavy nodes hand to each of their ancestors.

A shard holds shard_rows turns and at most shard_classes paths more, each of a
conversation's length; no other step gathers rows by key, but for blocks of 4,096
ids at most, which are hashed in order as they are streamed.

Edge cases: a null role or text is empty; turns are ordered by turn (nulls first),
role and hash, so ties and repeated rows have one order; equal rows are turns of
their own; rows with a null conv_id take no part; a conversation without turns is
a member of the root; an empty table gives no node; conversations and texts of
any length are taken whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.common import CRC32, Scratch, read, table

SHARD_CLASSES, SHARD_ROWS = 4096, 200_000
#: Ids in a block of the digest.
BLOCK = 4096
#: Conversations that get the head of one of them, and the longest head.
HEADS, LONGEST = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "a", "b")


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), la and lb (hashes of role and text) and words of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("la"),
        F.xxhash64(F.lit(1), text, role).alias("lb"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "la", "lb")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "la", "lb", "words")


def with_shared_heads(rows: DataFrame) -> DataFrame:
    """The :func:`keyed` turns, where conversation c begins with the first h turns of c - c % HEADS in place of its own.

    h is crc32(c) % (LONGEST + 1). Conversations that end up without turns have a row with a null place.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (LONGEST + 1)
    convs = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HEADS).alias("base"))
    heads = rows.where((F.col("conv_id") % HEADS == 0) & (F.col("place") <= LONGEST)).withColumnRenamed("conv_id", "base")
    given = convs.join(heads, "base").where("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "la", "lb", "words")
    own = rows.where(F.col("place") > h).select("conv_id", F.lit(1).alias("part"), "place", "la", "lb", "words")
    empty = convs.select("conv_id", F.lit(2).alias("part"), *(F.lit(None).cast("long").alias(c) for c in ("place", "la", "lb", "words")))
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    both = given.unionByName(own).unionByName(empty).withColumn("k", F.row_number().over(order).cast("long"))
    return both.where("part < 2 or k = 1").select("conv_id", F.when(F.col("part") < 2, F.col("k")).alias("place"), "la", "lb", "words")


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, label and words: the nodes on the path of each conversation, the root first."""
    root = rows.select("conv_id").distinct().select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "label", "words")))
    before = Window.partitionBy("conv_id").orderBy("place")
    node = [F.bit_xor(F.xxhash64(F.lit(k), "place", "la", "lb")).over(before).alias(c) for k, c in enumerate("ab")]
    below = rows.where("place is not null").select("conv_id", F.col("place").alias("depth"), *node, F.col("la").alias("label"), "words")
    return root.unionByName(below)


def _hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a node come together and in order."""
    names, out, node, sha = [*NODE, "ends_sha256"], [], None, None
    for rows in batches:
        for *own, ids in zip(*(rows[c] for c in (*NODE, "ids"))):
            if own != node:
                if sha is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = own, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield pd.DataFrame(out, columns=names)
        out.clear()
    if sha is not None:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=names)


def ends_digests(blocks: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of blocks (NODE, block, ids)."""
    rows = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return rows.mapInPandas(_hash_ids, "depth long, a long, b long, ends_sha256 string")


def louds(depth: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The bitvector of a forest in level order; ``parent`` is -1 for tops, whose parent is the super-root."""
    children = np.bincount(parent + 1, minlength=len(depth) + 1)
    bits = np.ones(len(depth) + len(children), dtype=np.uint8)
    bits[np.cumsum(children) + np.arange(len(children))] = 0
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """For each node in level order its parent's place (-1: the super-root): the zeros before the node's one."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones)) - 1


def build(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The level-order trie of paths (conv_id, n, depth, a, b, label, words), each sorted by depth and without a gap."""
    rows = rows.sort_values(["conv_id", "depth"], kind="stable")
    conv, n, depth, a, b = (rows[c].to_numpy(np.int64) for c in ("conv_id", "n", *NODE))
    order = np.lexsort((b, a, depth))
    new = np.r_[True, (np.diff(depth[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
    node = np.empty(len(rows), np.int64)
    node[order] = np.cumsum(new) - 1
    first = order[new]
    top = np.r_[True, conv[1:] != conv[:-1]]
    above = np.where(top[first], -1, node[first - 1])
    counts, least = np.zeros(len(first), np.int64), np.full(len(first), np.iinfo(np.int64).max)
    np.add.at(counts, node, n)
    np.minimum.at(least, node, conv)
    # nodes are sorted by depth; a top may lie deeper than another shard's, so levels are counted from the tops
    level, by_depth = np.zeros(len(first), np.int64), depth[first]
    for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(by_depth)) + 1):
        level[own] = np.where(above[own] < 0, 0, level[above[own]] + 1)
    label, rank, placed, done = rows["label"].to_numpy(np.int64)[first], np.full(len(first) + 1, -1), [], 0
    by_level = np.argsort(level, kind="stable")
    for own in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        own = own[np.lexsort((b[first[own]], label[own], rank[above[own]]))]
        rank[own] = done + np.arange(len(own))
        done += len(own)
        placed.append(own)
    place = np.concatenate(placed)
    bits = louds(place, rank[above[place]])
    up, words = parents(bits), rows["words"].to_numpy(np.int64)[first][place]
    children = np.bincount(up + 1, minlength=len(place) + 1)[1:]
    leaves, saved = (children == 0).astype(np.int64), (counts[place] - 1) * words
    cuts = np.cumsum([0, *map(len, placed)])
    for lo, hi in list(zip(cuts[1:], cuts[2:]))[::-1]:
        np.add.at(leaves, up[lo:hi], leaves[lo:hi])
        np.add.at(saved, up[lo:hi], saved[lo:hi])
    least = least[place]
    of = lambda x: x[first][place]
    return {
        "bits": bits, "depth": of(depth), "a": of(a), "b": of(b), "label": label[place], "conv_id": least, "top": up < 0,
        "parent_conv_id": np.where(up < 0, -1, least[up]), "n_convs": counts[place], "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
    }


COLUMNS = ("depth", "a", "b", "label", "conv_id", "top", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    trie = build(rows)
    own = {c: [trie[c].tolist()] for c in COLUMNS}
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "n_bits": [len(trie["bits"])], "louds": [np.packbits(trie["bits"]).tobytes()], **own})


def shards(light: DataFrame) -> DataFrame:
    """A row per shard: louds (bits, packed), n_bits, and arrays by node in level order."""
    arrays = ", ".join(f"{c} array<{'boolean' if c == 'top' else 'long'}>" for c in COLUMNS)
    return light.groupBy("shard").applyInPandas(_shard, f"shard long, n_bits long, louds binary, {arrays}")


def prefix_trie(rows: DataFrame, scratch: Scratch, shard_classes: int = SHARD_CLASSES, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of :func:`keyed` turns, and the tables of its shards (:func:`shards`).

    A node has depth, a, b, conv_id (its smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (summed over its subtree) and ends_sha256 (of
    the ids that end in it). ``scratch`` holds the tables that both read.
    """
    every = scratch.table(paths(rows))
    ends = every.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("own"))
    blocks = scratch.table(blocks.select(*NODE, "block", F.get("own", F.lit(0)).alias("least"), F.size("own").alias("n"), F.array_join(F.col("own").cast("array<string>"), ",").alias("ids")))
    classes = blocks.groupBy(*NODE).agg(F.min("least").alias("conv_id"), F.sum("n").alias("n")).select("conv_id", "n")
    own = scratch.table(every.join(classes, "conv_id"))
    # heavy prefixes are left joined to: a plain join whose hot keys Spark can split
    heavy = own.where("depth > 0").groupBy(*NODE).agg(F.count("*").alias("paths")).where(F.col("paths") > shard_classes).select(*NODE, F.lit(True).alias("heavy"))
    told = own.where("depth > 0").join(heavy, [*NODE], "left").unionByName(own.where("depth = 0").withColumn("heavy", F.lit(True)))
    path = Window.partitionBy("conv_id")
    told = told.withColumn("upto", F.max(F.when(F.col("heavy"), F.col("depth"))).over(path))
    told = scratch.table(told.withColumn("top", F.max(F.when(F.col("depth") == F.col("upto") + 1, F.xxhash64("a", "b"))).over(path)))
    light, upper = told.where("depth > upto"), told.where("depth <= upto")
    n_shards = max(1, -(-light.count() // shard_rows))
    tries = scratch.table(shards(light.select("conv_id", "n", *NODE, "label", "words", F.pmod("top", F.lit(n_shards)).alias("shard"))))
    below = tries.select(F.inline(F.arrays_zip(*COLUMNS)))
    return _merged(below, upper).join(ends_digests(blocks), [*NODE], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))), tries


def _merged(below: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes of the shards and of the heavy levels, whose sums come of what each child hands up."""
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    zero = F.lit(0).cast("long")
    heavy = upper.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("words").alias("words"))
    tops = below.where("top").select("conv_id", F.col("depth").alias("from_depth"), "n_leaves", "saved_tokens", F.lit(0).alias("to"))
    # a heavy node hands its own saving to itself and up; as a child it is counted by its parent alone
    saving = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    held = heavy.select("conv_id", F.col("depth").alias("from_depth"), zero.alias("n_leaves"), saving, F.lit(1).alias("to"))
    way = upper.select(F.col("conv_id").alias("of"), *NODE)
    handed = tops.unionByName(held).join(way, F.col("conv_id") == F.col("of")).where(F.col("depth") < F.col("from_depth") + F.col("to"))
    sums = handed.groupBy(*NODE).agg(
        F.sum(F.when(F.col("depth") == F.col("from_depth") - 1, 1).otherwise(0)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    # only the root of conversations without turns has no child among heavy nodes
    upper_nodes = heavy.join(sums, [*NODE]).withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long")))
    open_ends = below.where("top").select(*NODE, "conv_id", *counts).unionByName(upper_nodes.select(*NODE, "conv_id", *counts))
    up = heavy.select(*(F.col(c).alias(f"up_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    way = upper.select(F.col("conv_id").alias("of"), *(F.col(c).alias(f"up_{c}") for c in NODE))
    linked = open_ends.join(way, (F.col("conv_id") == F.col("of")) & (F.col("depth") - 1 == F.col("up_depth")), "left").join(up, [f"up_{c}" for c in NODE], "left")
    names = [*NODE, "conv_id", "parent_conv_id", *counts]
    return below.where("not top").select(*names).unionByName(linked.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    with Scratch(spark) as scratch:
        rows = scratch.table(keyed(read(spark, sf_dir, "conversations")))
        nodes, _ = prefix_trie(scratch.table(with_shared_heads(rows)), scratch)
        return table(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h
), k AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth,
    sha256(length(role)::VARCHAR || ':' || role || text) AS turn, length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g')) AS words
  FROM r
), p AS (
  SELECT conv_id, depth, words, string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS way FROM k
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
  SELECT way, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own FROM p GROUP BY way
), e AS (
  SELECT way, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(way, depth) AS way FROM p GROUP BY conv_id) GROUP BY way
), u AS (
  SELECT n.*, up.conv_id AS parent_conv_id, CASE WHEN depth > 0 THEN up.way END AS parent
  FROM n LEFT JOIN (SELECT way, conv_id FROM n) up ON n.depth > 0 AND up.way = n.way[1:64 * (n.depth - 1)]
), l AS (
  SELECT * FROM u LEFT JOIN (SELECT parent AS of, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent) ON way = of
), m AS (
  SELECT p.way, sum(own) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM l JOIN p ON p.conv_id = l.conv_id AND p.depth <= l.depth GROUP BY p.way
)
SELECT conv_id, cast(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  cast(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM l JOIN m USING (way) LEFT JOIN e USING (way)
"""
