"""A scan of folders by rounds: partitions list the folders of one depth, and their subfolders are the next round's.

The driver lists nothing; it asks a round's table whether a folder is left. So
there are as many rounds as the deepest folder has levels, and a round's work is
spread over its folders. A folder is entered if its own settings say so
(``recurse``), if its path isn't ignored, and once: of several links to one
(device, inode) that with the fewest levels, then the least path, is entered, and
none that was entered in an earlier round. So a loop of links ends.
"""

from __future__ import annotations

import os
import shutil
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.settings import folder_settings
from siltworks.operators.skip import WORKING_SUFFIX
from siltworks.sources.staging import stage

ENTRY = "root string, path string, name string, kind string, is_symlink boolean, bytes_in long, mtime double, dev long, ino long, error string"
#: Rows of a batch that a folder's listing is handed on in.
BATCH = 10_000
#: Folders that one task lists at most, about; fewer where cores would have none.
FOLDERS = 64


def _look(path: str, root: str, name: str, link: bool) -> tuple:
    """A row of ENTRY for what ``path`` is, links being followed."""
    try:
        found = os.stat(path)
    except OSError as error:
        return (root, path, name, "error", link, None, None, None, None, str(error))
    kind = "folder" if stat.S_ISDIR(found.st_mode) else "file" if stat.S_ISREG(found.st_mode) else "other"
    inode = found.st_ino - (1 << 64) if found.st_ino >= 1 << 63 else found.st_ino
    return (root, path, name, kind, link, found.st_size, found.st_mtime, found.st_dev, inode, None)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each folder, those that links lead to only where the folder's ``symlinks`` says so."""
    names, out = [c.split()[0] for c in ENTRY.split(", ")], []

    def frame() -> pd.DataFrame:
        got = pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("bytes_in", "dev", "ino")})
        out.clear()
        return got

    for part in batches:
        for root, folder, symlinks in zip(part["root"], part["path"], part["symlinks"]):
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        link = entry.is_symlink()
                        if symlinks or not link:
                            out.append(_look(entry.path, root, entry.name, link))
                        if len(out) >= BATCH:
                            yield frame()
            except OSError as error:
                out.append((root, folder, os.path.basename(folder), "error", False, None, None, None, None, str(error)))
        yield frame()


def _look_at_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ENTRY.split(", ")]
    for part in batches:
        rows = [_look(path, path, os.path.basename(path), os.path.islink(path)) for path in part["root"]]
        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("bytes_in", "dev", "ino")})


def below_root(path: Column, root: Column) -> Column:
    """The part of ``path`` below ``root``; the name of a root that is a file."""
    rest = F.substring(path, F.length(F.rtrim(root, F.lit("/"))) + 2, F.length(path))
    return F.when(path == root, F.regexp_extract(path, r"([^/]*)$", 1)).otherwise(rest)


def _with_settings(folders: DataFrame, layers: DataFrame | None, pinned: dict[str, str], recurse: bool, symlinks: bool) -> DataFrame:
    """``folders`` (path) and their own recurse and symlinks: pinned, else told by a layer at or above, else the run's."""
    usual = {"recurse": str(recurse).lower(), "symlinks": str(symlinks).lower()}
    out = folders
    if layers is None:
        for option, value in usual.items():
            out = out.withColumn(option, F.lit(pinned.get(option, value)).cast("boolean"))
        return out
    told = folder_settings(folders.select(F.col("path").alias("folder")), layers.where(F.col("option").isin(*usual)), pinned)
    told = told.groupBy("folder").agg(*(F.max(F.when(F.col("option") == o, F.lower(F.btrim("value")))).alias(o) for o in usual))
    out = folders.join(told.withColumnRenamed("folder", "path"), "path", "left")
    for option, value in usual.items():
        out = out.withColumn(option, F.lit(pinned[option]).cast("boolean") if option in pinned else F.coalesce(F.expr(f"try_cast({option} AS boolean)"), F.lit(value).cast("boolean")))
    return out


def scan(
    spark: SparkSession,
    roots: list[str],
    layers: DataFrame | None = None,
    pinned: dict[str, str] | None = None,
    ignore: str | None = None,
    recurse: bool = True,
    symlinks: bool = True,
) -> DataFrame:
    """root, path, name, kind, is_symlink, bytes_in, mtime and error of what lies at or below ``roots``, and stale.

    kind is ``file``, ``other`` (a pipe, a socket, a device) or ``error`` (a broken
    link, a folder that can't be listed). stale marks what a run that broke off
    left over. ``layers`` (path, option, value) are settings of folders, of which
    ``recurse`` says whether a folder is entered and ``symlinks`` whether links in
    it count; ``pinned`` beats them. Folders whose path below the root ``ignore``
    is found in aren't entered, nor are stale ones.
    """
    first = spark.createDataFrame([(r,) for r in roots], "root string").mapInPandas(_look_at_roots, ENTRY)
    rounds, entered = [stage(first)], None
    while True:
        found = rounds[-1].where("kind = 'folder'").where(~F.contains("name", F.lit(WORKING_SUFFIX)))
        if ignore:
            found = found.where((F.col("path") == F.col("root")) | ~below_root(F.col("path"), F.col("root")).rlike(ignore))
        folders = found.groupBy("dev", "ino").agg(F.min(F.struct("path", "root")).alias("of")).select("dev", "ino", "of.*")
        if entered is not None:
            folders = folders.join(entered, ["dev", "ino"], "left_anti")
        folders = _with_settings(folders, layers, pinned or {}, recurse, symlinks).where("recurse")
        folders = stage(folders)
        n = folders.count()
        if not n:
            break
        seen = folders.select("dev", "ino")
        entered = seen if entered is None else entered.unionByName(seen)
        listed = folders.select("root", "path", "symlinks").repartition(max(min(n, spark.sparkContext.defaultParallelism), -(-n // FOLDERS)), "path").mapInPandas(_list, ENTRY)
        rounds.append(stage(listed))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    stale = F.contains("name", F.lit(WORKING_SUFFIX))
    return out.where((F.col("kind") != "folder") | stale).select("root", "path", "name", "kind", "is_symlink", "bytes_in", "mtime", "error", stale.alias("stale"))


def remove_stale(found: DataFrame, seconds: float = 0.0) -> DataFrame:
    """path and error of what :func:`scan` marks as stale, once removed; ``seconds``: that much older than now at least."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            told = []
            for path in part["path"]:
                try:
                    shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.unlink(path)
                    told.append(None)
                except FileNotFoundError:
                    told.append(None)
                except OSError as error:
                    told.append(str(error))
            yield pd.DataFrame({"path": part["path"], "error": pd.Series(told, dtype=object)})

    old = found.where("stale").where(F.col("mtime") <= F.unix_timestamp() - F.lit(seconds))
    return old.select("path").mapInPandas(remove, "path string, error string")
