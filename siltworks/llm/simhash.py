"""SimHash near-duplicates, linked exactly through vantage-point trees.

A fingerprint is the bitwise majority of the hashes of a text's 4-word shingles.
Distinct fingerprints are partitioned by their Hamming distances to vantage
points: the top of the tree comes from a bounded sample, its leaves are the
shards. A fingerprint is at home in one shard and also asks every later shard
that its ball of radius 4 overlaps; within a shard a tree over the fingerprints
at home prunes branches by the triangle bounds. Shards send on a spanning forest
of the links that they found, never all pairs, and distributed union-find makes
components of them.

In the Hamming space of 64 bits most distances lie near 32, so a ball of radius
4 overlaps both sides of most splits: the bounds prune a part of the work only
(the README has figures).

Edge cases: a null or blank text has fingerprint zero and is linked like any
other; texts under four words are one shingle; copies and repeated rows share a
fingerprint and so a component; rows with a null doc_id take part, and a
component of such rows alone has a null id; an empty table gives no row; further
columns are ignored or, where documents are returned, left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import cut, read
from siltworks.llm.components import components

RADIUS = 4
#: Fingerprints that the top of the tree is built from, and about so many at home in a shard.
SAMPLE, SHARD = 4096, 8192
#: Shards split their visitors so that a group has about so many at most.
VISITORS = 1 << 20
#: Fingerprints in a leaf of a shard's own tree.
LEAF = 256


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's 4-word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, \x20 and \x09-\x0D only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= 4:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[i : j - 1], 42) for i, j in zip([0, *ends], ends[3:])])
    n = len(words) - 3
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprint_column():
    """A Pandas UDF from text to the fingerprint's bits as a long."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: each node but a root, and its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def distance(prints: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ vantage).astype(np.int16)


def grow(prints: np.ndarray, leaf: int, depth: int = 64):
    """A vantage-point tree: (vantage, radius, near, far), or the array of a leaf's fingerprints."""
    if len(prints) <= leaf or not depth:
        return prints
    # of a few candidates, the one whose distances vary most splits best
    few = prints[:: max(1, len(prints) // 8)][:8]
    apart = [distance(prints, v) for v in few]
    d = max(apart, key=lambda x: x.var())
    vantage = few[next(i for i, x in enumerate(apart) if x is d)]
    radius = int(np.median(d))
    near = d <= radius
    if near.all():
        radius -= 1
        near = d <= radius
    if not near.any():
        return prints
    return vantage, radius, grow(prints[near], leaf, depth - 1), grow(prints[~near], leaf, depth - 1)


def within(tree, asked: np.ndarray, found: list, radius: int) -> None:
    """Put into ``found`` arrays (a, b) of the links of ``asked`` with the tree's fingerprints."""
    if not len(asked):
        return
    if isinstance(tree, tuple):
        vantage, split, near, far = tree
        d = distance(asked, vantage)
        within(near, asked[d <= split + radius], found, radius)
        within(far, asked[d > split - radius], found, radius)
        return
    step = max(1, (1 << 20) // max(1, len(tree)))
    for i in range(0, len(asked), step):
        part = asked[i : i + step]
        q, h = np.nonzero(np.bitwise_count(part[:, None] ^ tree[None, :]) <= radius)
        if len(q):
            a, b = part[q], tree[h]
            other = a != b
            found.append(forest(a[other], b[other]))


def homes(tree, prints: np.ndarray) -> np.ndarray:
    """The number of each fingerprint's leaf, counted from the near end."""
    out, n = np.zeros(len(prints), np.int64), 0

    def down(node, rows):
        nonlocal n
        if isinstance(node, tuple):
            near = distance(prints[rows], node[0]) <= node[1]
            down(node[2], rows[near])
            down(node[3], rows[~near])
        else:
            out[rows] = n
            n += 1

    down(tree, np.arange(len(prints)))
    return out


def overlaps(tree, prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each leaf, which fingerprints' balls may hold one of its own."""
    out = []

    def down(node, rows):
        if isinstance(node, tuple):
            d = distance(prints[rows], node[0])
            down(node[2], rows[d <= node[1] + radius])
            down(node[3], rows[d > node[1] - radius])
        else:
            out.append(rows)

    down(tree, np.arange(len(prints)))
    return out


def packed(prints: np.ndarray, shard: np.ndarray, chunk: np.ndarray, home: bool) -> Iterator[tuple[int, int, bool, bytes]]:
    """A row for each group (shard, chunk), with its fingerprints as bytes."""
    order = np.lexsort((chunk, shard))
    prints, shard, chunk = prints[order], shard[order], chunk[order]
    cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(chunk) != 0)) + 1
    ends = [0, *cuts.tolist(), len(prints)]
    return ((int(shard[i]), int(chunk[i]), home, prints[i:j].tobytes()) for i, j in zip(ends, ends[1:]) if i < j)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b whose components are those of all pairs of ``prints`` (fp, distinct) within ``radius``.

    Shards hold about :data:`SHARD` fingerprints at home and :data:`VISITORS`
    visitors; where a leaf of the top tree has more, it is dealt to several.
    """
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    top = grow(sample, 8, depth)
    leaves = _leaves(top)
    blocks = -(-n // (2 * leaves * SHARD)) or 1
    # only how many groups a leaf's visitors are dealt to is taken from the sample; who visits is not
    asking = np.array([len(near) for near in overlaps(top, sample, radius)]) / max(1, len(sample))
    chunks = np.maximum(1, np.ceil(asking * n / VISITORS)).astype(np.int64)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = part["fp"].to_numpy(np.int64).view(np.uint64)
            deal = p * np.uint64(0x9E3779B97F4A7C15)
            block, luck = (deal >> np.uint64(40)) % np.uint64(blocks), ((deal >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64)
            leaf = homes(top, p)
            home = leaf * blocks + block.astype(np.int64)
            rows = np.repeat(np.arange(len(p)), chunks[leaf])
            copy = np.arange(len(rows)) - np.repeat(np.cumsum(chunks[leaf]) - chunks[leaf], chunks[leaf])
            out = list(packed(p[rows], home[rows], copy, True))
            for at, near in enumerate(overlaps(top, p, radius)):
                rows, shard = np.repeat(near, blocks), np.tile(np.arange(at * blocks, (at + 1) * blocks), len(near))
                later = home[rows] < shard
                rows, shard = rows[later], shard[later]
                out += packed(p[rows], shard, luck[rows] % chunks[at], False)
            yield pd.DataFrame(out, columns=["shard", "chunk", "home", "packed"])

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda x: np.frombuffer(b"".join(x), np.uint64)
        mine, guests = unpack(part.loc[part["home"], "packed"]), unpack(part.loc[~part["home"], "packed"])
        found: list = []
        if len(mine):
            tree = grow(mine, LEAF)
            within(tree, np.concatenate([mine, guests]) if key[1] == 0 else guests, found, radius)
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2
        a, b = forest(a, b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.mapInPandas(route, "shard long, chunk int, home boolean, packed binary")
    return dealt.groupBy("shard", "chunk").applyInPandas(search, "a long, b long")


def _leaves(tree) -> int:
    return _leaves(tree[2]) + _leaves(tree[3]) if isinstance(tree, tuple) else 1


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable) of every document."""
    prints = cut(docs.select("doc_id", fingerprint_column()("text").alias("fp")))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = components(links(first.select("fp"), radius))
    known = first.join(of, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(known, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id, all columns as they are."""
    found = near_duplicates(docs, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = cut(found.groupBy("doc_id", "fp").agg(F.count("*").alias("n")))
    # the caller's columns are one struct, so none of their names can clash
    out = docs.select(F.struct("*").alias("own")).join(stay, F.col("own.doc_id").eqNullSafe(F.col("doc_id")))
    if stay.where("n > 1 or doc_id is null").isEmpty():
        return out.select("own.*")
    # rows that share an id: the fingerprint tells them apart, and one row of each stays
    out = out.where(fingerprint_column()("own.text") == F.col("fp"))
    return out.groupBy("doc_id", "fp").agg(F.first("own").alias("own")).select("own.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
