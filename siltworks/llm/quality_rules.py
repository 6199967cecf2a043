"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, white space to one space) and
hashed. Of each line it is counted in how many distinct documents of a host
(``source``) it stands; lines above the host's limit are removed, and documents
of which too little remains are rejected. Exact copies of a text count as one
document, so a copied clean document isn't taken for boilerplate.

Edge cases: a null text has no word and fails the base rules; a null host is a
host of its own; a text of white space only has no line; repeated rows get the
same verdict each; an empty table gives no row; further columns are left as
they are and are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import blocks, cut, read, with_new_text

#: A line is removed if more distinct documents of its host hold it than both say.
MIN_DOCS = 10
HOST_SHARE = 0.01
#: A document is rejected if less than this share of its words remains.
KEEP_SHARE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = bytes.maketrans((UPPER + "123456789").encode(), (LOWER + "0" * 9).encode())
KEY = ["doc_id", "host", "text_hash"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Bytes of text that are read at once.
BLOCK = 1 << 20


def line_hash(line: bytes) -> int:
    """The hash of a line, given the words' bytes after :data:`TABLE`; as a signed long."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.split()))
    return h - (1 << 64) if h >> 63 else h


def repeated(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, upto, n = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def features(text: str | None) -> tuple:
    """What the base rules count, and the hash (null for blank lines) and the number of words of each line."""
    if text is None:
        return 0, 0, 0, 0, 0, [], []
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D only
    seen: set[bytes] = set()
    lines = [x for x in raw.split(b"\n") if x.split()]
    n = len(lines)
    seen.update(lines)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    hashes, sizes = [], []
    for line in raw.translate(TABLE).split(b"\n"):
        k = len(line.split())
        hashes.append(line_hash(line) if k else None)
        sizes.append(k)
    return len(words), chars, symbols, n - len(seen), repeated(words), hashes, sizes


def document_features(docs: DataFrame) -> DataFrame:
    """The narrow table of all that the rules need: keys, counts, and the lines' hashes and words in order, without texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(batch.column("text"), BLOCK):
                part = batch.slice(i, j - i)
                *counts, hashes, sizes = zip(*map(features, part.column("text").to_pylist()))
                offsets = np.cumsum([0, *map(len, sizes)], dtype=np.int32)
                lines = pa.StructArray.from_arrays(
                    [pa.array(chain.from_iterable(hashes), pa.int64()), pa.array(chain.from_iterable(sizes), pa.int32())], ["h", "n"]
                )
                columns = [*(part.column(k) for k in KEY), *(pa.array(c, pa.int64()) for c in counts), pa.ListArray.from_arrays(offsets, lines)]
                yield pa.RecordBatch.from_arrays(columns, [*KEY, *COUNTS, "lines"])

    rows = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in KEY), *(f"{c} bigint" for c in COUNTS), "lines array<struct<h:bigint,n:int>>"])
    return cut(rows.mapInArrow(of, schema))


def removed_lines(rows: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """host, h and n_docs of every line above its host's limit.

    Counts are partial sums before each exchange, so a hot host or line sends a row per task.
    """
    each = rows.select("host", "text_hash", F.explode("lines.h").alias("h")).where("h is not null")
    lines = each.groupBy("host", "h").agg(F.countDistinct("text_hash").alias("n_docs"))
    hosts = rows.groupBy(F.col("host").alias("host_of")).agg(F.countDistinct("text_hash").alias("n_host"))
    lines = lines.where(F.col("n_docs") > min_docs)
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("host_of"))).where(F.col("n_docs") > host_share * F.col("n_host")).select("host", "h", "n_docs")


def judge(rows: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """``rows`` of :func:`document_features` with bad (hashes of removed lines), n_removed, base_failed and kept."""
    bad = removed_lines(rows, min_docs, host_share).select(F.col("host").alias("bad_host"), F.col("h").alias("bad_h"))
    each = rows.select(*KEY, F.explode("lines.h").alias("h"))
    found = each.join(bad, (F.col("h") == F.col("bad_h")) & F.col("host").eqNullSafe(F.col("bad_host")))
    found = found.groupBy(*(F.col(k).alias(f"of_{k}") for k in KEY)).agg(F.collect_set("h").alias("bad"))
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    out = rows.join(found, on, "left").drop(*(f"of_{k}" for k in KEY))
    lost = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("bad", x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"]
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("n_removed", F.when(F.col("bad").isNull(), F.lit(0).cast("long")).otherwise(lost))
    enough = F.col("n_words") - F.col("n_removed") >= keep_share * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)


def apply_quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected documents; the lines above the limits are taken out of the texts.

    All columns stay; n_chars, if there is one, is counted anew where lines went.
    """
    verdict = judge(document_features(docs), **limits).where("kept")
    numbers = F.transform("lines", lambda x, i: F.when(F.array_contains("bad", x["h"]), i))
    drop = F.when(F.col("bad").isNotNull(), F.array_compact(numbers))
    verdict = verdict.select(*KEY, drop.alias("drop")).dropDuplicates(list(KEY))
    # the caller's columns are one struct, so none of their names can clash
    own = docs.select(F.struct("*").alias("own"))
    on = (
        F.col("own.doc_id").eqNullSafe(F.col("doc_id"))
        & F.col("own.source").eqNullSafe(F.col("host"))
        & (F.xxhash64("own.text") == F.col("text_hash"))
    )
    left = F.filter(F.split("own.text", "\n", -1), lambda _, i: ~F.array_contains("drop", i))
    out = own.join(verdict, on).withColumn("text", F.when(F.col("drop").isNull(), F.col("own.text")).otherwise(F.array_join(left, "\n")))
    return with_new_text(out, docs, F.col("drop").isNotNull())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"]
    return judge(document_features(read(spark, sf_dir, "documents"))).select("doc_id", *names)


_WS = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '{_WS}') AS w FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM w WHERE len(w) > 2),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY k),
l AS (SELECT k, host, text, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT *, array_to_string(regexp_extract_all(translate(l, '{UPPER}123456789', '{LOWER}000000000'), '{_WS}'), ' ') AS norm,
  len(regexp_extract_all(l, '{_WS}')) AS n FROM l WHERE regexp_matches(l, '{_WS}')),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n_dup_lines FROM lw GROUP BY k),
freq AS (SELECT host, norm, count(DISTINCT text) AS n_docs FROM lw GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT text) AS n_host FROM d GROUP BY host),
bad AS (SELECT host, norm FROM freq JOIN hosts USING (host) WHERE n_docs > {MIN_DOCS} AND n_docs > {HOST_SHARE} * n_host),
gone AS (SELECT k, sum(n) AS n_removed FROM lw JOIN bad USING (host, norm) GROUP BY k),
f AS (SELECT doc_id, len(w) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  cast(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed
  FROM d JOIN w USING (k) LEFT JOIN p USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= {KEEP_SHARE} * n_words AS kept
FROM f
"""
