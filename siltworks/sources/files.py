"""A Python data source that scans folders as they are.

``spark.read.format("files").option("path", root)``: unlike ``binaryFile`` it
keeps names with a leading underscore or dot, and each folder is entered once, so
a loop of links ends. Options: recurse, symlinks, content (``none``, ``header`` or
``all``), batch (bytes of files for each partition, 64 MiB by default).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltworks.functions.sniff import HEADER
from siltworks.operators.skip import WORKING_SUFFIX


def listing(root: str, recurse: bool, symlinks: bool) -> Iterator[tuple[str, os.stat_result, bool]]:
    """(path, stat, is a link) of the regular files below ``root``: subfolders first, all by name."""
    seen: set[tuple[int, int]] = set()

    def folder(path: str, top: bool) -> Iterator[tuple[str, os.stat_result, bool]]:
        try:
            here = os.stat(path)
            entries = sorted(os.scandir(path), key=lambda e: e.name)
        except OSError:
            return
        if (here.st_dev, here.st_ino) in seen:
            return
        seen.add((here.st_dev, here.st_ino))
        links = [e for e in entries if symlinks or not e.is_symlink()]
        if recurse:
            for e in links:
                if e.is_dir():
                    yield from folder(e.path, False)
        for e in links:
            try:
                found = e.stat()
            except OSError:
                continue
            if stat.S_ISREG(found.st_mode) and WORKING_SUFFIX not in e.name:
                yield e.path, found, e.is_symlink()

    if os.path.isdir(root):
        yield from folder(root, True)
    elif os.path.isfile(root):
        yield root, os.stat(root), os.path.islink(root)
    else:
        raise FileNotFoundError(root)


class Batch(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k: str(options.get(k, "true")).lower() == "true"
        self.root, self.recurse, self.symlinks = options["path"], flag("recurse"), flag("symlinks")
        self.content, self.batch = options.get("content", "header"), int(options.get("batch", 64 << 20))

    def partitions(self) -> list[Batch]:
        out, rows, size = [], [], 0
        for path, found, link in listing(self.root, self.recurse, self.symlinks):
            rows.append((self.root, path, os.path.basename(path), link, found.st_size, found.st_mtime))
            size += found.st_size + 4096
            if size >= self.batch:
                out.append(Batch(rows))
                rows, size = [], 0
        return [*out, Batch(rows)] if rows or not out else out

    def read(self, partition: Batch) -> Iterator[tuple]:
        for row in partition.rows:
            data = None
            if self.content != "none":
                try:
                    with open(row[1], "rb") as file:
                        data = file.read(HEADER if self.content == "header" else -1)
                except OSError:
                    data = b""
            yield (*row, data)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "root string, path string, name string, is_symlink boolean, bytes_in long, mtime double, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSource)


def top_paths(paths: list[str], symlinks: bool = True) -> list[str]:
    """The roots of a run: each once, in order; a missing one is an error, as is having none."""
    missing = [p for p in paths if not os.path.lexists(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    out = sorted({os.path.abspath(p) for p in paths if symlinks or not os.path.islink(p)})
    if not out:
        raise ValueError("no paths to optimise")
    return out


def with_content(items: DataFrame, more: list[str] = ()) -> DataFrame:
    """path, content and error of ``items`` (path), and the columns ``more``, read where the rows are; a file that can't be read has the error."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples(index=False):
                try:
                    with open(row.path, "rb") as file:
                        got = (row.path, file.read(), None)
                except OSError as error:
                    got = (row.path, None, str(error))
                yield pd.DataFrame([(*got, *row[1:])], columns=["path", "content", "error", *more])

    kinds = dict(items.dtypes)
    return items.select("path", *more).mapInPandas(load, ", ".join(["path string", "content binary", "error string", *(f"{c} {kinds[c]}" for c in more)]))


def write_files(rows: DataFrame) -> DataFrame:
    """path and bytes of the files that ``rows`` (path, content) become, written where the rows are; folders are made as needed."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for part in batches:
            for path, content in zip(part["path"], part["content"]):
                folder = os.path.dirname(path)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(path, "wb") as file:
                    file.write(bytes(content or b""))
            yield pd.DataFrame({"path": part["path"], "bytes": [len(c or b"") for c in part["content"]]})

    return rows.select("path", "content").mapInPandas(put, "path string, bytes long")


def remove_files(rows: DataFrame) -> DataFrame:
    """path of the files that ``rows`` (path) tell, removed where the rows are; one that isn't there is none to remove."""

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path in part["path"]:
                with suppress(FileNotFoundError):
                    os.unlink(path)
            yield part

    return rows.select("path").mapInPandas(drop, "path string")


def case_sensitive(folder: str) -> bool:
    """Whether names that differ in case are different files in ``folder``: told by its own path, nothing is written."""
    other = folder.rstrip("/")
    other = other[: other.rfind("/") + 1] + other[other.rfind("/") + 1 :].swapcase()
    if other == folder.rstrip("/"):  # no letter to tell it by
        return os.path.normcase("A") == "A"
    return not (os.path.exists(other) and os.path.samefile(folder, other))
