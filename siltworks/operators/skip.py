"""What isn't optimised: filters on names and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.paths import base_name

#: Names of this library's own files.
MARKER, STAMP_MEMBER = ".siltworks_timestamp", ".siltworks_stamps.yaml"
OWN_FILES = (".siltworks.yaml", ".siltworks_stamps.parquet", STAMP_MEMBER, MARKER)
WORKING_SUFFIX = ".siltworks-tmp"


def stale(path: Column) -> Column:
    """Left over by a run that broke off."""
    return F.contains(base_name(path), F.lit(WORKING_SUFFIX))


def wanted(path: Column, ignore: str, case_sensitive: Column | None = None) -> Column:
    """Neither this library's own file nor ignored; the expression is searched, not matched."""
    found = path.rlike(ignore)
    if case_sensitive is not None:
        found = F.when(case_sensitive, found).otherwise(path.rlike(f"(?i){ignore}"))
    return ~base_name(path).isin(*OWN_FILES) & ~found


def changed(mtime: Column, stamp: Column, after: float | None = None) -> Column:
    """Newer than its stamp, or without one; ``after`` stands for all stamps."""
    limit = F.lit(after) if after is not None else stamp
    return limit.isNull() | (mtime > limit)


def skip_items(items: DataFrame, ignore: str, symlinks: bool = True) -> DataFrame:
    out = items.where(wanted(F.col("path"), ignore) & ~stale(F.col("path")))
    return out if symlinks else out.where(~F.col("is_symlink"))


def member_action(name: Column, ignore: str, mtime: Column, stamp: Column, use_mtime: bool = True) -> Column:
    """``copy`` for members of an archive that are carried over as they are, else ``process``."""
    ok = wanted(name, ignore)
    return F.when(ok & changed(mtime, stamp) if use_mtime else ok, "process").otherwise("copy")
