"""Stamps that outlive a run: a table in versions for each root, under the configuration that they hold for.

    <store>/<digest of the root>/v-<id>/            path, ts: Parquet, never changed
    <store>/<digest of the root>/manifest-<n>.json  root, version, config, merged journals
    <store>/<digest of the root>/j-<id>/            path, ts of a run that has not ended yet
    <store>/<digest of the root>/journal-<id>.json  root, journal, config

The current version is the one that the highest manifest names. A commit writes
its version first and then puts a manifest of the next number, which is atomic; if
another run was first, its stamps are merged and the next number is tried, so no
commit is lost and none mixes with another. A run that is killed before that
leaves the old version as it was, and what it wrote to a journal is read by the
next run. Versions that no manifest names, and all but the newest manifests, go by
:meth:`StampStore.vacuum`.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.stamps import NO_CONFIG, compact, upsert
from siltworks.sources.folders import Folder

SCHEMA = "path string, ts double"
#: The options that stamps depend on, and what one that isn't recorded stands for.
DEFAULTS: Mapping[str, Any] = {
    "bigger": False, "convert_jpeg_to_jxl": False, "convert_to": [], "convert_webp_to_jxl": False,
    "formats": ["GIF", "JPEG", "JXL", "PNG", "SVG", "WEBP"], "ignore": [], "keep_metadata": True, "near_lossless": False,
    "recurse": True, "symlinks": True, "timestamps_ignore_archive_entry_mtimes": False,
}
FINGERPRINT = "folders_fingerprint"


def configuration(options: Mapping[str, Any], fingerprint: str = NO_CONFIG) -> dict[str, Any]:
    """The options that stamps depend on, in one form: sets in order, defaults filled in.

    An option that a later version adds or retires has its default on both sides,
    so it voids no stamps. ``fingerprint`` stands for the settings of folders below.
    """
    told = {k: options.get(k, v) for k, v in DEFAULTS.items()}
    told = {k: sorted(v) if isinstance(v, (list, tuple, set, frozenset)) else v for k, v in told.items()}
    return told | {FINGERPRINT: fingerprint}


def _same(recorded: Mapping[str, Any], config: Mapping[str, Any]) -> bool:
    """Whether a recorded configuration is that of a run, keys missing on either side being at their defaults."""
    full = lambda c: {**DEFAULTS, FINGERPRINT: NO_CONFIG, **c}
    return {k: v for k, v in full(recorded).items() if k in full(config)} == full(config)


def _contains(above: str, path: str) -> bool:
    return path == above or path.startswith(above.rstrip("/") + "/")


class StampStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _of(self, root: str) -> Folder:
        return Folder(self.spark, f"{self.folder}/{hashlib.sha256(root.encode()).hexdigest()[:32]}")

    @staticmethod
    def _manifests(at: Folder) -> list[tuple[int, str]]:
        names = [n for n in at.names() if n.startswith("manifest-") and n.endswith(".json")]
        return sorted((int(n[9:-5]), n) for n in names)

    def _current(self, at: Folder) -> tuple[int, dict[str, Any] | None]:
        """The highest number taken, and the newest manifest that can be read."""
        found = self._manifests(at)
        for _, name in reversed(found):
            try:
                return found[-1][0], json.loads(at.text(name) or "")
            except ValueError:
                continue
        return (found[-1][0] if found else 0), None

    def roots(self) -> list[str]:
        """The roots that have stamps or a journal."""
        out = []
        for name in Folder(self.spark, self.folder).names():
            at = Folder(self.spark, f"{self.folder}/{name}")
            told = self._current(at)[1] or next((json.loads(at.text(n) or "{}") for n in at.names() if n.startswith("journal-")), None)
            out += [told["root"]] if told and "root" in told else []
        return sorted(out)

    def _tables(self, root: str, config: Mapping[str, Any] | None) -> tuple[list[str], list[str]]:
        """Folders of the tables of ``root`` that hold under ``config`` (any, if null), and the journals among them."""
        at, tables, journals = self._of(root), [], []
        _, told = self._current(at)
        if told and (config is None or _same(told["config"], config)):
            tables.append(f"{at.path}/{told['version']}")
        for name in at.names():
            if name.startswith("journal-"):
                own = json.loads(at.text(name) or "{}")
                if own and own["journal"] not in (told or {}).get("merged", []) and (config is None or _same(own["config"], config)):
                    tables.append(f"{at.path}/{own['journal']}")
                    journals.append(own["journal"])
        return tables, journals

    def load(self, root: str, config: Mapping[str, Any] | None) -> DataFrame:
        """root, path and ts: what is known of ``root`` under ``config``, from its own table and those of roots above and below.

        Stamps under another configuration are void; without one (null) all count.
        """
        tables = [t for r in self.roots() if _contains(r, root) or _contains(root, r) for t in self._tables(r, config)[0]]
        if not tables:
            return self.spark.createDataFrame([], f"root string, {SCHEMA}")
        rows = self.spark.read.schema(SCHEMA).parquet(*tables)
        # of roots above only what lies above or below this root
        near = (F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/")) | F.startswith(F.lit(root), F.concat(F.rtrim(F.col("path"), F.lit("/")), F.lit("/")))
        return rows.where(near).groupBy("path").agg(F.max("ts").alias("ts")).select(F.lit(root).alias("root"), "path", "ts")

    def _write(self, at: Folder, rows: DataFrame, prefix: str) -> str:
        name = f"{prefix}-{uuid.uuid4().hex}"
        rows.select("path", "ts").write.parquet(f"{at.path}/{name}")
        return name

    def journal(self, root: str, stamps: DataFrame, config: Mapping[str, Any]) -> None:
        """Keep ``stamps`` (path, ts) of a run that has not ended; the next commit takes them in."""
        at = self._of(root)
        name = self._write(at, stamps, "j")
        at.put_new(f"journal-{name[2:]}.json", json.dumps({"root": root, "journal": name, "config": dict(config)}))

    def commit(self, root: str, fresh: DataFrame, config: Mapping[str, Any], tries: int = 20) -> int:
        """Add ``fresh`` (path, ts) to the stamps of ``root``; the number of the manifest that has them.

        Stamps under another configuration are replaced. Those that a folder above
        supersedes go.
        """
        at, fresh = self._of(root), fresh.select(F.lit(root).alias("root"), "path", "ts")
        for _ in range(tries):
            number, _told = self._current(at)
            tables, journals = self._tables(root, config)
            known = fresh
            if tables:
                old = self.spark.read.schema(SCHEMA).parquet(*tables).select(F.lit(root).alias("root"), "path", "ts")
                known = upsert(old, fresh)
            version = self._write(at, compact(known), "v")
            told = {"root": root, "version": version, "config": dict(config), "merged": journals, "time": time.time()}
            if at.put_new(f"manifest-{number + 1:012d}.json", json.dumps(told, sort_keys=True)):
                for name in journals:
                    at.remove(f"journal-{name[2:]}.json")
                    at.remove(name)
                return number + 1
            at.remove(version)
        raise RuntimeError(f"{root}: {tries} other commits came first")

    def vacuum(self, root: str, keep: int = 2, seconds: float = 86_400) -> list[str]:
        """Remove manifests before the last ``keep``, and tables older than ``seconds`` that no manifest or journal names."""
        at, gone = self._of(root), []
        names = at.names()
        numbered = [n for _, n in self._manifests(at)]
        held = {json.loads(at.text(n) or "{}").get("version") for n in numbered[-keep:]}
        held |= {f"j-{n[8:-5]}" for n in names if n.startswith("journal-")}
        for name in [*numbered[:-keep], *(n for n in names if n.startswith(("v-", "j-", "_")) and n not in held)]:
            if name in numbered or at.age(name) < time.time() - seconds:
                at.remove(name)
                gone.append(name)
        return gone
