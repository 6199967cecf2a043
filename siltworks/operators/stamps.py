"""Incremental state: when was a path, or a folder above it, last optimised?"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.paths import ancestors, base_name
from siltworks.operators.skip import MARKER, STAMP_MEMBER


def ancestor_stamp(items: DataFrame, stamps: DataFrame, key: str = "item_id") -> DataFrame:
    """key and stamp: the latest stamp of the path or of any folder above it; null without one.

    Items send a row per folder level; maxima are partial before the exchange.
    """
    each = items.select(key, F.explode(ancestors(F.col("path"))).alias("above"))
    held = each.join(stamps.select(F.col("path").alias("above"), "ts"), "above", "left")
    return held.groupBy(key).agg(F.max("ts").alias("stamp"))


def folder_status(items: DataFrame) -> DataFrame:
    """folder, n_items, poisoned: a failed item poisons every folder above it; ``items``: path, failed."""
    up = F.expr("array_compact(transform(sequence(1, size(a) - 1), i -> a[i - 1]))")
    each = items.select(ancestors(F.col("path")).alias("a"), "failed").where("size(a) > 1").select(F.explode(up).alias("folder"), "failed")
    return each.groupBy("folder").agg(F.count("*").alias("n_items"), F.bool_or("failed").alias("poisoned"))


def compact(stamps: DataFrame) -> DataFrame:
    """``stamps`` (path, ts, and root if there are several) without those that a folder above, of the same root, supersedes: its stamp is as late or later."""
    own = [c for c in ("root", "path", "ts") if c in stamps.columns]
    above = F.expr("slice(a, 1, size(a) - 1)")
    each = stamps.select(*own, ancestors(F.col("path")).alias("a")).select(*own, F.explode_outer(above).alias("above"))
    folders = stamps.select(*own[:-2], F.col("path").alias("above"), F.col("ts").alias("above_ts"))
    held = each.join(folders, [*own[:-2], "above"], "left")
    kept = held.groupBy(*own).agg(F.bool_or(F.coalesce(F.col("above_ts") >= F.col("ts"), F.lit(False))).alias("gone"))
    return kept.where("not gone").select(*own)


#: What stands for settings where no folder below a root has any.
NO_CONFIG = hashlib.sha256(b"").hexdigest()
#: Characters of a path's digest that tell its part; the digests of a part are gathered in order, then those of the parts.
PART = 3


def fingerprint(configs: DataFrame, by: list[str], roots: DataFrame | None = None) -> DataFrame:
    """``by`` and fingerprint: the digest of all configuration texts strictly below a root, in the order of their paths.

    ``configs`` has path (below the root) and text. A root's own file, whose path
    has no slash, is left out, as its options are recorded by value; a null text
    counts as empty. ``roots`` (``by``) that have no such file get NO_CONFIG.
    Texts are digested where they are; 16**PART parts keep what is gathered small.
    """
    path, text = F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))
    each = configs.where(F.contains(path, F.lit("/"))).select(
        *by, F.substring(F.sha2(path, 256), 1, PART).alias("part"), F.concat(path, F.lit(":"), F.sha2(text, 256)).alias("own")
    )
    gathered = lambda of: F.sha2(F.array_join(F.sort_array(F.collect_list(of)), "\n"), 256)
    parts = each.groupBy(*by, "part").agg(gathered("own").alias("digest"))
    out = parts.groupBy(*by).agg(gathered(F.concat("part", F.lit(":"), "digest")).alias("fingerprint"))
    if roots is None:
        return out
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    held = out.select(*(F.col(c).alias(f"_{c}") for c in by), "fingerprint")
    return roots.select(*by).distinct().join(held, same, "left").select(*by, F.coalesce("fingerprint", F.lit(NO_CONFIG)).alias("fingerprint"))


def marker_stamps(scan: DataFrame, name: str = MARKER) -> DataFrame:
    """path (of the folder) and ts: marker files called ``name`` in ``scan`` (path, mtime) stamp their folders with their times."""
    found = scan.where(base_name(F.col("path")) == name).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), "mtime")
    return found.groupBy("path").agg(F.max("mtime").alias("ts"))


def member_stamps(members: DataFrame, name: str = STAMP_MEMBER) -> DataFrame:
    """container_id, path (below /) and ts, as told by the files called ``name`` among ``members`` of archives.

    Their lines are ``path: seconds``, in the map or in its journal (a list, each
    line with a dash); paths are relative to the file's folder, which ``.`` stands
    for. Lines of another form tell nothing.
    """
    held = members.where((F.col("kind") == "file") & (base_name(F.col("name")) == name))
    folder = F.regexp_extract(F.concat(F.lit("/"), F.col("name")), r"^(.*)/[^/]*$", 1)
    each = held.select("container_id", folder.alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    form = r"""^\s*(?:-\s+)?\{?["']?(?:\./)?(.+?)/?["']?\s*:\s*(\d+(?:\.\d+)?)\}?\s*$"""
    each = each.where(F.col("line").rlike(form)).select("container_id", "folder", F.regexp_extract("line", form, 1).alias("own"), F.regexp_extract("line", form, 2).cast("double").alias("ts"))
    path = F.when(F.col("own") == ".", F.col("folder")).otherwise(F.concat_ws("/", "folder", "own"))
    return each.select("container_id", F.when(path == "", "/").otherwise(path).alias("path"), "ts").groupBy("container_id", "path").agg(F.max("ts").alias("ts"))


def newest_member_stamp(members: DataFrame, told: DataFrame) -> DataFrame:
    """container_id, archive_index and stamp: the latest of ``told`` (see :func:`member_stamps`) for a member or a folder above it."""
    above = F.array_append(ancestors(F.concat(F.lit("/"), F.col("name"))), F.lit("/"))
    each = members.select("container_id", "archive_index", F.explode(above).alias("path")).join(told, ["container_id", "path"])
    return each.groupBy("container_id", "archive_index").agg(F.max("ts").alias("stamp"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All stamps, the later one for a path in both."""
    return old.unionByName(new).groupBy("root", "path").agg(F.max("ts").alias("ts"))
