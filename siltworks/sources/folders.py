"""Small files on any file system that Spark reads: names, texts, and new files that appear whole or not at all."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI or path; used by the driver for metadata only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """What is in the folder, by name; nothing if it isn't there."""
        if not self.fs.exists(self._at("")):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at("")))

    def age(self, name: str) -> float:
        """Seconds since the epoch at which ``name`` was written."""
        return self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def text(self, name: str) -> str | None:
        """The text of a small file; null if it can't be read."""
        try:
            stream = self.fs.open(self._at(name))
        except Exception:  # noqa: BLE001  the gateway's error of any file system
            return None
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write ``name`` at once and as a whole; false, and nothing is changed, if there is one already.

        A local file is linked to its name, elsewhere it is renamed, which file
        systems like HDFS refuse where the name is taken.
        """
        temp, target = self._at(f"_{uuid.uuid4().hex}.tmp"), self._at(name)
        stream = self.fs.create(temp, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                try:
                    os.link(temp.toUri().getPath(), self.fs.makeQualified(target).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(target) and bool(self.fs.rename(temp, target))
        finally:
            self.fs.delete(temp, False)

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
