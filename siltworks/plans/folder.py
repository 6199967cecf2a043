"""A run over a folder: scan, skip by settings and stamps, optimise, replace, report, remember."""

from __future__ import annotations

import time
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import globs_column
from siltworks.operators.reports import error_text, report_text
from siltworks.operators.settings import folder_settings
from siltworks.operators.skip import MARKER, changed, skip_items
from siltworks.operators.stamps import NO_CONFIG, ancestor_stamp, compact, fingerprint, folder_status, marker_stamps, upsert
from siltworks.plans.optimize import described, optimize
from siltworks.sources.files import case_sensitive, with_content
from siltworks.sources.replace import replace_files
from siltworks.sources.scan import below_root, remove_stale, scan
from siltworks.sources.staging import stage
from siltworks.sources.stamp_store import StampStore, configuration

STAMPS, LAYERS = "root string, path string, ts double", "path string, option string, value string"
#: Statuses of the sink after which a file holds its new bytes.
WRITTEN = ("written", "done")
#: Settings that a tree's stamps depend on, and the name of a folder's own file.
LISTS, FLAGS, FILE = ("formats", "convert_to", "ignore"), ("bigger", "keep_metadata", "near_lossless", "recurse", "symlinks"), ".siltworks.yaml"


def optimize_folder(
    spark: SparkSession,
    root: str,
    known: DataFrame | None = None,
    layers: DataFrame | None = None,
    pinned: dict[str, str] | None = None,
    ignore: str = r"^\.|/\.",
    symlinks: bool = True,
    preserve: bool = False,
    dry_run: bool = False,
    store: StampStore | None = None,
    after: float | None = None,
    stale_seconds: float = 3600.0,
    **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """The reports of a run over ``root``, and all stamps after it.

    Files that are no newer than their stamp in ``known`` (root, path, ts), or than
    that of a folder above, are not read; ``after`` (seconds) stands for all stamps.
    ``layers`` (path, option, value) are settings of folders: whether one is entered
    (recurse) and its links count (symlinks), and those of :func:`optimize`, which
    the members of its containers get too; ``pinned`` beats them. Further options
    are those of :func:`optimize`. Files are replaced at once, unless it is a dry
    run. A folder gets a stamp if nothing below it failed or was left alone since it
    had changed; else only its other files do. A dry run stamps nothing. Marker
    files count as stamps of their folders. What a run that broke off left over goes
    if it is older than ``stale_seconds``.

    With a ``store`` stamps are read from there under the configuration of this run
    and committed to it at the end; files are journaled as soon as they are
    replaced, and marker files are removed once their stamps are committed. A root
    whose settings switch ``timestamps`` off has no stamps there.
    """
    pinned = pinned or {}
    # as the file system does, patterns tell cases apart or not
    ignore = ignore if case_sensitive(root) else f"(?i){ignore}"
    own = root_settings(spark, root, layers, pinned)
    store = None if own.get("timestamps", "true") == "false" else store
    config = run_configuration(root, layers, own, ignore, symlinks, options)
    known = spark.createDataFrame([], STAMPS) if known is None else known
    if store is not None:
        known = known.unionByName(store.load(root, config))
    found = stage(scan(spark, [root], layers, pinned, ignore, symlinks=symlinks))
    gone = spark.createDataFrame([], "path string, error string") if dry_run else stage(remove_stale(found, stale_seconds))
    # patterns are held against the path below the root
    below = found.where("kind = 'file' and not stale").select("name", "is_symlink", "bytes_in", "mtime", F.col("path").alias("whole"), below_root(F.col("path"), F.col("root")).alias("path"))
    # marker files of older runs stamp their folders, those above the root too
    marked = below.where(~F.regexp_replace("path", r"[^/]*$", "").rlike(ignore)).select(F.col("whole").alias("path"), "mtime")
    marks = marker_stamps(marked.unionByName(spark.createDataFrame(markers_above(root), "path string, mtime double")))
    known = upsert(known, marks.select(F.lit(root).alias("root"), "path", "ts"))
    wanted = skip_items(below, ignore, symlinks).select(F.col("whole").alias("item_id"), F.col("whole").alias("path"), F.col("path").alias("within"), "mtime")
    settled = layers is not None or bool(pinned)
    if settled:
        wanted = with_settings(wanted, spark.createDataFrame([], LAYERS) if layers is None else layers, pinned)
        named = F.coalesce(F.regexp_like("within", globs_column(F.element_at("settings", "ignore"))), F.lit(False))
        wanted = wanted.where(~named)
    stamps = ancestor_stamp(wanted, known.where(F.col("root") == root)).withColumnRenamed("item_id", "of")
    new = wanted.join(stamps, F.col("item_id") == F.col("of"), "left").where(changed(F.col("mtime"), F.col("stamp"), after))
    # contents are written once, here
    read = stage(described(with_content(new, ["settings"] if settled else [])))
    items = read.where("error is null").drop("error")
    reports = optimize(items, ignore=r"$^", dry_run=dry_run, **options)
    status = stage(replace_files(reports.where("changed"), preserve))
    now = time.time()
    told = reports.drop("data", "scanned", "item_id").join(status, "path", "left")
    # what could not be read, listed or removed has failed too
    listed = found.where("kind = 'error' and not is_symlink").select("path", "error")
    broken = read.where("error is not null").select("path", "error").unionByName(listed).unionByName(gone.where("error is not null"))
    broken = broken.select("path", F.col("path").alias("target"), F.lit(False).alias("changed"), F.lit("error").alias("kind"), "error")
    told = told.unionByName(broken, allowMissingColumns=True)
    text = report_text(F.col("path"), F.col("bytes_in"), F.col("bytes_out"), dry_run, bool(options.get("bigger")))
    told = stage(told.withColumn("text", F.when(F.col("error").isNull(), text).otherwise(error_text(F.col("path"), F.col("error")))))
    if dry_run:
        return told, known
    failed = F.col("error").isNotNull() | ~F.coalesce(F.col("status").isin(*WRITTEN), F.lit(True))
    done = told.select(F.col("target").alias("path"), failed.alias("failed"))
    files = done.where("not failed").select("path", F.lit(now).alias("ts"))
    if store is not None:
        store.journal(root, files, config)
    # after the writes, so that new files are no newer than their stamps
    folders = folder_status(done).where("not poisoned").where((F.col("folder") == root) | F.startswith("folder", F.lit(root.rstrip("/") + "/")))
    fresh = folders.select(F.col("folder").alias("path"), F.lit(now).alias("ts")).unionByName(files)
    after_run = stage(compact(upsert(known, fresh.select(F.lit(root).alias("root"), "path", "ts"))))
    if store is not None:
        store.commit(root, after_run.select("path", "ts"), config)
        own_marks = found.where((F.col("kind") == "file") & (F.col("name") == MARKER)).select("path", "mtime", F.lit(True).alias("stale"))
        remove_stale(own_marks).write.format("noop").mode("overwrite").save()
    return told, after_run


def root_settings(spark: SparkSession, root: str, layers: DataFrame | None, pinned: dict[str, str]) -> dict[str, str]:
    """The settings that hold at the root itself: a handful."""
    at = spark.createDataFrame([(root,)], "folder string")
    told = [] if layers is None else folder_settings(at, layers).select("option", "value").collect()
    return {r["option"]: r["value"] for r in told} | pinned


def run_configuration(root: str, layers: DataFrame | None, own: dict[str, str], ignore: str, symlinks: bool, options: Mapping[str, Any]) -> dict[str, Any]:
    """What stamps of ``root`` depend on: the settings at the root by value, and a digest of those of the folders below."""
    told: dict[str, Any] = {"ignore": [ignore], "symlinks": symlinks}
    told |= {k: options[k] for k in ("bigger", "convert_to") if k in options}
    told |= {k: [x.strip().upper() if k != "ignore" else x.strip() for x in own[k].split(",")] for k in LISTS if k in own}
    told |= {k: own[k].strip().lower() == "true" for k in FLAGS if k in own}
    digest = NO_CONFIG
    if layers is not None:
        inside = layers.where((F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/")))
        within = F.when(F.col("path") == root, F.lit("")).otherwise(F.concat(below_root(F.col("path"), F.lit(root)), F.lit("/")))
        # a folder has as many lines as there are options
        lines = F.array_join(F.sort_array(F.collect_set(F.concat("option", F.lit("="), "value"))), "\n")
        texts = inside.groupBy(F.concat(within, F.lit(FILE)).alias("path")).agg(lines.alias("text"))
        found = fingerprint(texts.withColumn("root", F.lit(root)), ["root"]).first()
        digest = found["fingerprint"] if found else NO_CONFIG
    return configuration(told, digest)


def with_settings(items: DataFrame, layers: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """``items`` (path) and settings: the map of all options that hold in their folder."""
    each = items.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    told = folder_settings(each, layers).where(~F.col("option").isin(*pinned) if pinned else F.lit(True))
    held = told.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("option", "value"))).alias("held"))
    fixed = F.create_map(*(F.lit(x) for pair in pinned.items() for x in pair)).cast("map<string,string>")
    none = F.create_map().cast("map<string,string>")
    return each.join(held, "folder", "left").withColumn("settings", F.map_concat(F.coalesce("held", none), fixed)).drop("folder", "held")


def markers_above(root: str) -> list[tuple[str, float]]:
    """path and mtime of the marker files in the folders above ``root``: one look for each."""
    found = [parent / MARKER for parent in Path(root).parents]
    return [(str(p), p.stat().st_mtime) for p in found if p.is_file()]
