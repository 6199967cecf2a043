"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into equal segments; the mean and the deviation of each segment
bound the distance of two vectors from below, and so their inner product from
above: over a segment of n components, x.y <= n * (mean_x * mean_y + dev_x * dev_y).
Blocks of queries meet blocks of candidates. In each meeting the bounds go from
few segments to many; a candidate that can't reach a query's current k-th score,
here or in an earlier meeting of the task, is dropped, and only survivors get finer
bounds and exact scores. The best k of each meeting are merged by a window with a limit.

Edge cases: vectors that are null, or hold a component that is null, not finite or
not finite once scaled, take no part; scores are exact integers of any size, of
which those beyond 64 bits are told as the end of that range and ranked as they are; vectors of different lengths are compared as if the shorter one ended in
zeros; an empty vector scores 0; ties go to the smaller id; rows that repeat a
vec_id are no candidates of a query with that id, and the query is the least of
their vectors; rows with a null vec_id take no part; an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.common import read

#: Vectors in a block of queries, and in one of candidates at most.
QUERIES, CANDIDATES = 1024, 4096
#: Components in a segment of each resolution, coarse to fine; then come exact scores.
LENGTHS = (32, 8, 2)
#: Products of a share of more than one in so many pairs are taken from the product of the whole blocks.
DENSE = 16
#: Tasks that the meetings of one block of queries are dealt to at least; more where candidates come in more than so many partitions for each.
SPREAD, PARTITIONS = 16, 4


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * component) as doubles, of the vectors that take part."""
    def floor(x: Column) -> Column:  # doubles of 53 bits and more are whole, and need not fit a long
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

    scaled = lambda x: F.lit(scale) * x.cast("double")
    whole = F.transform("embedding", lambda x: floor(scaled(x)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    part = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return part.select("vec_id", whole.alias("v"))


def pack(ids: list, vectors: list) -> dict:
    """A block as bytes: ids, the vectors padded to one length."""
    width = max((len(v) for v in vectors), default=0)
    grid = np.zeros((len(vectors), width))
    for row, v in zip(grid, vectors):
        row[: len(v)] = v
    return {"ids": np.asarray(ids, np.int64).tobytes(), "grid": grid.tobytes(), "width": width}


def unpack(ids: bytes, grid: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(grid, np.float64).reshape(len(ids), width)


def statistics(grid: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, each times the root of the segment's length: their product bounds the score."""
    n, width = grid.shape
    cuts = np.unique(np.linspace(0, width, segments + 1).astype(int))
    sizes = np.diff(cuts)
    total = np.add.reduceat(grid, cuts[:-1], axis=1)
    square = np.add.reduceat(grid * grid, cuts[:-1], axis=1)
    mean = total / sizes
    dev = np.sqrt(np.maximum(square / sizes - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([sizes, sizes]))


def products(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The inner products of the pairs (rows, cols): of the whole grid where they are many, else of each pair."""
    if len(rows) * DENSE > len(x) * len(y):
        return (x @ y.T)[rows, cols]
    out = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = np.einsum("ij,ij->i", x[rows[part]], y[cols[part]])
    return out


def exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The integer inner products of the pairs (rows, cols); Python's integers, where one may leave 53 bits."""
    top = [np.abs(x).max(axis=1, initial=0) for x in (q, c)]
    small = top[0][rows] * top[1][cols] * max(1, q.shape[1]) < 2**53
    if small.all():
        return products(q, c, rows, cols).astype(np.int64)
    out = np.empty(len(rows), object)
    out[small] = products(q, c, rows[small], cols[small]).astype(np.int64)
    for i in np.flatnonzero(~small):
        out[i] = sum(int(a) * int(b) for a, b in zip(q[rows[i]], c[cols[i]]))
    return out


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    raw = abs(score).to_bytes(abs(score).bit_length() // 8 + 1, "big")
    raw = len(raw).to_bytes(2, "big") + raw
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - x for x in raw)


def told(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as 64-bit integers, and what orders those that reach the ends of that range."""
    if scores.dtype != object:
        return scores, [None] * len(scores)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([min(max(s, low), high) for s in scores], np.int64), [None if low < s < high else sortable(int(s)) for s in scores]


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the k best of their row, ties to the smaller id."""
    if scores.dtype == object:
        scores = np.unique(scores, return_inverse=True)[1]
    order = np.lexsort((ids, -scores, rows))
    start = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


def meet(qi, q, ci, c, k: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of the k best candidates in ``c`` of each query in ``q``, and each query's k best scores so far.

    ``before`` are those of earlier meetings: what can't reach the least of them is dropped too.
    """
    width = max(q.shape[1], c.shape[1], 1)
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    before = np.full((len(q), k), -np.inf) if before is None else before
    rows, cols = np.nonzero(qi[:, None] != ci[None, :])
    with np.errstate(over="ignore", invalid="ignore"):
        norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, c)]
        for segments in sorted({-(-width // n) for n in LENGTHS if n < width}):
            bound = products(statistics(q, segments), statistics(c, segments), rows, cols)
            bound += 1e-9 * norms[0][rows] * norms[1][cols] + 1e-6
            # what overflows bounds nothing
            bound[np.isnan(bound)] = np.inf
            # the candidates of the highest bounds give each query a score that others must reach
            grid = np.full((len(q), len(c)), -np.inf)
            grid[rows, cols] = bound
            few = min(2 * k, len(c))
            r, a = np.repeat(np.arange(len(q)), few), np.argpartition(-grid, few - 1, axis=1)[:, :few].ravel()
            alive = grid[r, a] > -np.inf
            got = np.full(len(r), -np.inf)
            got[alive] = exact(q, c, r[alive], a[alive]).astype(float)
            least = np.sort(np.concatenate([before, got.reshape(len(q), few)], axis=1), axis=1)[:, -k]
            keep = bound >= least[rows]
            rows, cols = rows[keep], cols[keep]
    scores = exact(q, c, rows, cols)
    at = best(scores, ci[cols], rows, k)
    rows, cols, scores = rows[at], cols[at], scores[at]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    here = np.full((len(q), k), -np.inf)
    here[rows, place] = scores.astype(float)
    return qi[rows], ci[cols], scores, np.sort(np.concatenate([before, here], axis=1), axis=1)[:, -k:]


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query; both tables as of :func:`quantised`.

    Every block of queries meets every block of candidates, each meeting a row of
    its own; candidates travel as blocks of bytes, once for each block of queries.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    # partitions follow the size of the input, so tasks do too; a task gets the block of queries once
    spread = max(SPREAD, -(-candidates.rdd.getNumPartitions() // PARTITIONS))
    parts = "ids binary, grid binary, width int"

    def block_of_queries(part: pd.DataFrame) -> pd.DataFrame:
        one = pack(part["vec_id"].tolist(), part["v"].tolist())
        return pd.DataFrame([one | {"block": part["block"].iloc[0]}])[["block", "ids", "grid", "width"]]

    def block_of_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), CANDIDATES):
                some = part.iloc[i : i + CANDIDATES]
                yield pd.DataFrame([pack(some["vec_id"].tolist(), some["v"].tolist())])

    asked = asked.groupBy("block").applyInPandas(block_of_queries, f"block long, {parts}")
    asked = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"), F.struct("ids", "grid", "width").alias("q"))
    held = candidates.mapInPandas(block_of_candidates, parts).select(F.struct("ids", "grid", "width").alias("c"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    held = held.withColumn("salt", F.pmod(F.hash("c.ids", "block"), F.lit(spread)))
    pairs = held.join(asked, ["block", "salt"]).select("block", "q", "c")

    def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, before = None, None
        for part in batches:
            for block, q, c in zip(part["block"], part["q"], part["c"]):
                # the scores that a block's queries have reached hold in its next meetings
                of, before = block, before if of == block else None
                two = (unpack(*(x[y] for y in ("ids", "grid", "width"))) for x in (q, c))
                qi, ci, s, before = meet(*next(two), *next(two), k, before)
                s, beyond = told(s)
                yield pd.DataFrame({"query_id": qi, "vec_id": ci, "score": s, "beyond": beyond})

    found = pairs.mapInPandas(meetings, "query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_segments(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The 5 best candidates of every query: all rows whose vec_id is divisible by 50."""
    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
