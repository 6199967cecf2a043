"""Runs over what is new: a file stream whose batches update the stamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def optimize_stream(
    spark: SparkSession, root: str, state: str, run: Callable[[DataFrame], DataFrame], glob: str = "*"
) -> StreamingQuery:
    """Apply ``run`` (items with path and content, to reports) to files below ``root`` that no earlier run has seen.

    Reports are appended to ``state``/reports and stamps to ``state``/stamps, each
    batch under its number, so a batch that is run again replaces itself. Files
    that failed or were skipped get no stamp, so that a later run over what is
    unstamped tries them again. The stream ends when all files that there are have been read.
    """
    files = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(root)
    )

    def batch(rows: DataFrame, number: int) -> None:
        items = rows.select("path", F.col("modificationTime").cast("double").alias("mtime"), "content")
        run(items).drop("data").write.mode("overwrite").parquet(f"{state}/reports/batch={number}")
        reports = spark.read.parquet(f"{state}/reports/batch={number}")
        done = items.select("path", "mtime").join(reports.where("error is null").select("path"), "path", "left_semi")
        done.select(F.lit(root).alias("root"), "path", F.col("mtime").alias("ts")).write.mode("overwrite").parquet(f"{state}/stamps/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start()
