"""Tables that a run writes once and reads several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltworks.functions.batches import BATCH_BYTES

#: Spark's bound of the bytes of a batch that Python gets.
MOST = "spark.sql.execution.arrow.maxBytesPerBatch"

def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one where that is unset, in local mode only)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp("-stages"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    While it is written Python gets batches of BATCH_BYTES at most (or of one row
    that is larger): contents are wide, and each worker holds a batch. The
    session's own bound is there again afterwards.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}", spark.conf.get(MOST)
    spark.conf.set(MOST, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(MOST, before)
    return spark.read.parquet(path)
