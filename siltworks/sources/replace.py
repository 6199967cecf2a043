"""The sink: new bytes take the place of old files, whole or not at all."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siltworks.operators.skip import WORKING_SUFFIX


def replace_file(path: str, target: str, data: bytes, scanned: str, preserve: bool) -> str:
    """Write beside the target, then rename; run twice it does nothing the second time.

    A file that changed since the scan is left alone, and so is another file that
    has the name of the target.
    """
    if not os.path.exists(path):
        return "done" if os.path.exists(target) else "missing"
    with open(path, "rb") as file:
        now = hashlib.sha256(file.read()).hexdigest()
    if now != scanned:
        return "done" if now == hashlib.sha256(data).hexdigest() else "changed"
    if target != path and os.path.exists(target) and not os.path.samefile(path, target):
        with open(target, "rb") as file:
            if hashlib.sha256(file.read()).digest() != hashlib.sha256(data).digest():
                return "exists"
    old = os.stat(path)
    # each attempt of a task writes a file of its own
    temp = f"{target}.{uuid.uuid4().hex}{WORKING_SUFFIX}"
    with open(temp, "wb") as file:
        file.write(data)
        file.flush()
        os.fsync(file.fileno())
    os.chmod(temp, old.st_mode & 0o7777)
    if preserve:
        try:
            os.chown(temp, old.st_uid, old.st_gid)
        except OSError:
            pass
        os.utime(temp, ns=(old.st_atime_ns, old.st_mtime_ns))
    os.replace(temp, target)
    if path != target and not (os.path.exists(path) and os.path.samefile(path, target)):
        os.unlink(path)
    return "written"


def replace_files(results: DataFrame, preserve: bool = False) -> DataFrame:
    """path and status for rows of ``results`` (path, target, data, scanned: the old content's sha256)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            status = [replace_file(r.path, r.target, bytes(r.data), r.scanned, preserve) for r in part.itertuples()]
            yield pd.DataFrame({"path": part["path"], "status": status})

    return results.select("path", "target", "data", "scanned").mapInPandas(write, "path string, status string")
