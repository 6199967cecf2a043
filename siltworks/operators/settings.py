"""Settings of a folder: for each option the value of the nearest file above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.paths import ancestors


def folder_settings(folders: DataFrame, layers: DataFrame, pinned: dict[str, str] | None = None) -> DataFrame:
    """folder, option, value; ``layers``: path (of the folder whose file it is), option, value.

    Done over distinct folders, not items. ``pinned`` options (from the command
    line or the environment) beat all files.
    """
    distinct = folders.select("folder").distinct()
    each = distinct.select("folder", F.explode(ancestors(F.col("folder"))).alias("path"))
    held = each.join(layers, "path")
    out = held.groupBy("folder", "option").agg(F.max_by("value", F.length("path")).alias("value"))
    for option, value in (pinned or {}).items():
        out = out.withColumn("value", F.when(F.col("option") == option, F.lit(value)).otherwise(F.col("value")))
    return out
