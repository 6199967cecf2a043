"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL for DuckDB, which has no crc32, of an expression of ASCII text: a list of its bytes and of eight halvings for each is reduced.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({0}) + 1),
    lambda i: [ascii(substr({0}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the one that spark.checkpoint.dir names; only where that is unset in
    local mode (tests on one machine) a temporary folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """The same as a compressed Parquet table, for wide rows of which later steps read a few columns.

    It lasts as long as the application: what comes of it may be read at any time.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove, df.sparkSession)
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tables that go when the application ends.
_made: list[str] = []


def _remove(spark: SparkSession) -> None:
    """Remove the tables of an application that ends while its session is there."""
    if spark.sparkContext._jsc is not None:
        delete(spark, _made)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders of any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_new_text(rows: DataFrame, docs: DataFrame, new: Column) -> DataFrame:
    """The columns of ``docs`` from ``rows``, where they are the struct ``own`` and ``text`` is the text to have.

    n_chars, if there is one, is counted anew where ``new`` is true.
    """
    told = F.col("own").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        told = told.withField("n_chars", F.when(new, F.length("text").cast("long")).otherwise(F.col("own.n_chars")))
    return rows.select(told.alias("own")).select("own.*")


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, each with about ``size`` bytes of text or one longer text."""
    block = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if i < j)


def release(spark: SparkSession) -> None:
    """Have the driver collect what the plans of a finished round left.

    Spark drops shuffles and broadcasts only when the driver's JVM finds their
    plans unreachable; many small rounds would fill its heap before that.
    """
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables that live as long as the block: ``with Scratch(spark) as scratch``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.names = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        """Like :func:`table`."""
        self.folders.append(f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(self.folders[-1])
        return self.spark.read.parquet(self.folders[-1])

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """The same as a table in the shared warehouse, bucketed by ``key``: joins and sums by it need no exchange of its rows.

        The bucket count is that of the session's shuffle partitions, which is to be set by the size of the input.
        """
        self.names.append(f"bucketed_{uuid.uuid4().hex}")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").bucketBy(buckets, key).format("parquet").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folders)
