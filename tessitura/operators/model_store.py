"""Fitted models in versioned folders: written whole, then made current by replacing one small file.

    <folder>/<name>/versions/<version>/<table>/   tables of the model
    <folder>/<name>/versions/<version>/manifest.json   key, settings, inputs, values, schemas; written last
    <folder>/<name>/current                            the version that serving reads

A version is never changed. ``current`` is replaced by rename, so a reader that opens a model has all tables of one
version, whatever becomes current while it serves. The key of a version is a digest of its settings and of its inputs
(name, length and time of every input file): what was fitted on other tables or with other settings is not found.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessitura.sources import files


@dataclass
class Model:
    """One version as a reader sees it."""

    version: str
    key: str
    settings: dict
    values: dict  # numbers and lists that aren't tables
    tables: dict[str, DataFrame]


def input_versions(spark: SparkSession, paths: Iterable[str]) -> dict[str, str]:
    """A digest of each input's files: names, lengths, times of change."""
    out = {}
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs, lines = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
        at = fs.listFiles(p, True)
        while at.hasNext():
            s = at.next()
            lines.append(f"{s.getPath().toUri().getPath()} {s.getLen()} {s.getModificationTime()}")
        out[path] = hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    return out


def key_of(settings: dict, inputs: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([settings, inputs], sort_keys=True).encode()).hexdigest()


class ModelStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str, version: str) -> str:
        return f"{self.folder}/{name}/versions/{version}"

    def publish(self, name: str, tables: dict[str, DataFrame], values: dict, *, settings: dict, inputs: dict[str, str], current: bool = True) -> str:
        """Write a version and make it current. A failure on the way leaves the current one."""
        version = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self._at(name, version)}/{table}")
        manifest = {"version": version, "key": key_of(settings, inputs), "settings": settings, "inputs": inputs, "values": values, "schemas": {t: df.schema.jsonValue() for t, df in tables.items()}}
        files.create(self.spark, f"{self._at(name, version)}/manifest.json", json.dumps(manifest))
        if current:
            self.make_current(name, version)
        return version

    def make_current(self, name: str, version: str) -> None:
        """Serve this version from now on; also the way back to an older one."""
        if not files.exists(self.spark, f"{self._at(name, version)}/manifest.json"):
            raise ValueError(f"{name} has no whole version {version}")
        files.replace(self.spark, f"{self.folder}/{name}/current", version)

    def open(self, name: str, version: str | None = None) -> Model | None:
        """The current version, or one by name; None if there is none."""
        version = version or files.read_text(self.spark, f"{self.folder}/{name}/current")
        text = files.read_text(self.spark, f"{self._at(name, version)}/manifest.json") if version else None
        if text is None:
            return None
        m = json.loads(text)
        tables = {t: self.spark.read.schema(T.StructType.fromJson(s)).parquet(f"{self._at(name, version)}/{t}") for t, s in m["schemas"].items()}
        return Model(version, m["key"], m["settings"], m["values"], tables)

    def get(self, name: str, fit: Callable[[], tuple[dict[str, DataFrame], dict]], *, settings: dict, inputs: dict[str, str]) -> Model:
        """The current version if it has these settings and inputs; else what ``fit`` returns (tables, values), published and current."""
        found = self.open(name)
        if found is None or found.key != key_of(settings, inputs):
            found = self.open(name, self.publish(name, *fit(), settings=settings, inputs=inputs))
        return found

    def versions(self, name: str) -> list[str]:
        return files.names(self.spark, f"{self.folder}/{name}/versions")

    def prune(self, name: str, keep: Iterable[str] = ()) -> list[str]:
        """Delete versions but the current one and ``keep``. Readers of others must be done."""
        held = {*keep, files.read_text(self.spark, f"{self.folder}/{name}/current")}
        gone = [v for v in self.versions(name) if v not in held]
        for v in gone:
            files.delete(self.spark, self._at(name, v))
        return gone

    def forget(self, name: str) -> None:
        files.delete(self.spark, f"{self.folder}/{name}")
