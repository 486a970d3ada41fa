"""Keyed tables that are changed in place: copy-on-write by buckets, one log of snapshots for all tables of a store.

Stock Parquet has no MERGE, and rewriting a catalog for a small batch costs the catalog. Here a table's rows are dealt to
``buckets`` by a hash of their key; a change reads and writes the buckets that its keys fall in and no other. What it
wrote becomes visible by one small file, ``log/<version>.json``, which names the folder of every bucket of every table:

* a reader takes one version and sees one snapshot of all tables, whatever is committed meanwhile;
* a change that fails before its log file leaves the old snapshot, and folders that nothing names (``vacuum``);
* of two changes made from one version, one gets the log file; the other is refused (``Conflict``) and may be retried;
* a change can carry the name and number of a stream's batch: the log says which batch was the last, so a batch that is
  delivered again is seen and left out (``done``).

Rows that are only added (``append``) go to a folder a change, which its own log file names; ``compact`` puts the
folders together. Old versions can be read until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.catalog import upsert
from tessitura.sources import files

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change has been committed since the version that this one was made from."""


@dataclass
class Snapshot:
    """What one log file says."""

    version: int = -1
    tables: dict[str, dict] = field(default_factory=dict)  # name: schema, keys, buckets, at (bucket number to folder)
    batches: dict[str, int] = field(default_factory=dict)  # stream: number of its last batch
    appended: dict[str, str] = field(default_factory=dict)  # table: folder that this change added
    compacted: dict[str, dict] = field(default_factory=dict)  # table: folder with all rows up to a version
    schemas: dict[str, dict] = field(default_factory=dict)  # of append-only tables


class Store:
    """A folder of tables. One object is a session of changes; any number may work on one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # the log

    def _log(self, version: int) -> str:
        return f"{self.folder}/log/{version:020d}.json"

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in files.names(self.spark, f"{self.folder}/log") if n.endswith(".json") and not n.startswith(".")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest, or that of a version."""
        if version is None:
            version = max(self.versions(), default=-1)
        return Snapshot() if version < 0 else Snapshot(**json.loads(files.read_text(self.spark, self._log(version))))

    def done(self, stream: str, batch: int) -> bool:
        """Whether the stream's batch has been committed."""
        return self.snapshot().batches.get(stream, -1) >= batch

    # reading

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """Rows of a keyed table in a version (the latest); resolved now, so later changes aren't seen."""
        at = self.snapshot(version).tables[table]
        return self._buckets(at, at["at"].values())

    def _buckets(self, at: dict, folders: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(at["schema"])
        paths = [f"{self.folder}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read_appended(self, table: str, version: int | None = None) -> DataFrame:
        """Rows of an append-only table up to a version."""
        last = self.snapshot(version)
        schema = T.StructType.fromJson(last.schemas[table])
        held = last.compacted.get(table)
        after = held["version"] if held else -1
        paths = [held["folder"]] if held else []
        paths += [f for v in self.versions() if after < v <= last.version and (f := self.snapshot(v).appended.get(table))]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    # changing

    def change(self) -> Change:
        """A change made from the latest version."""
        return Change(self, self.snapshot())

    def upsert(self, table: str, rows: DataFrame, keys: list[str], rules: dict[str, str], **options) -> int:
        """One table's change by itself; see ``Change.upsert``."""
        c = self.change()
        c.upsert(table, rows, keys, rules, **options)
        return c.commit()

    def compact(self, table: str) -> int:
        """Put the folders of an append-only table in one."""
        c = self.change()
        folder = f"data/{uuid.uuid4().hex}"
        self.read_appended(table, c.base.version).write.parquet(f"{self.folder}/{folder}")
        c.compacted[table] = {"folder": folder, "version": c.base.version}
        return c.commit()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that the last ``keep`` versions don't name; older versions can't be read then. No change may be under way."""
        last = [self.snapshot(v) for v in self.versions()]
        named: set[str] = set()
        for s in last[-keep:]:
            named |= {f.split("/")[1] for t in s.tables.values() for f in t["at"].values()} | {c["folder"].split("/")[1] for c in s.compacted.values()}
        for s in last:
            for table, folder in s.appended.items():
                if any(k.compacted.get(table, {"version": -1})["version"] < s.version <= k.version for k in last[-keep:]):
                    named.add(folder.split("/")[1])
        gone = [f for f in files.names(self.spark, f"{self.folder}/data") if f not in named]
        for f in gone:
            files.delete(self.spark, f"{self.folder}/data/{f}")
        return gone


class Change:
    """New buckets of any tables, which become visible together or not at all."""

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base = store, base
        self.tables: dict[str, dict] = {}
        self.appended: dict[str, str] = {}
        self.compacted: dict[str, dict] = {}
        self.schemas: dict[str, dict] = {}
        self.touched: dict[str, list[int]] = {}  # buckets written, by table

    def _bucket(self, keys: list[str], n: int):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def read(self, table: str) -> DataFrame:
        """The table as this change sees it: its own buckets, and else the base's."""
        at = self.tables.get(table) or self.base.tables[table]
        return self.store._buckets(at, at["at"].values())

    def read_for(self, table: str, keys_of: DataFrame) -> DataFrame:
        """The buckets that the keys of these rows fall in."""
        at = self.tables.get(table) or self.base.tables[table]
        wanted = {str(r[0]) for r in keys_of.select(self._bucket(at["keys"], at["buckets"])).distinct().collect()}
        return self.store._buckets(at, [f for b, f in at["at"].items() if b in wanted])

    def known(self, table: str) -> bool:
        return table in self.tables or table in self.base.tables

    def _held(self, table: str, schema: T.StructType, keys: list[str], buckets: int) -> dict:
        at = self.tables.get(table) or self.base.tables.get(table)
        if at is None:
            return {"schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "at": {}}
        if at["keys"] != keys:
            raise ValueError(f"{table} is keyed by {at['keys']}")
        return at

    def upsert(self, table: str, rows: DataFrame, keys: list[str], rules: dict[str, str], *, buckets: int = BUCKETS) -> None:
        """Merge rows by key, by the rules of ``catalog.upsert``; ``seq`` orders rows of one key. A new table gets its buckets and
        the columns ``keys`` and ``rules``; rules must name every column that isn't a key. Without rows nothing is written."""
        new = rows.select(*keys, *[c for c in rules if c in rows.columns], F.col("seq").cast("long").alias("seq"))
        self._write(table, new, keys, buckets, T.StructType([new.schema[c] for c in (*keys, *rules) if c in new.columns]), lambda old, new: upsert(old, new, keys, rules))

    def replace(self, table: str, rows: DataFrame, keys: list[str], *, buckets: int = BUCKETS) -> None:
        """Rows (one a key) take the place of those with their keys, or are added."""
        self._write(table, rows, keys, buckets, rows.schema, lambda old, new: old.join(new, keys, "left_anti").unionByName(new))

    def delete(self, table: str, keys_of: DataFrame) -> None:
        """Rows with these keys go."""
        at = self.tables.get(table) or self.base.tables[table]
        self._write(table, keys_of.select(*at["keys"]).distinct(), at["keys"], at["buckets"], T.StructType.fromJson(at["schema"]), lambda old, new: old.join(new, at["keys"], "left_anti"))

    def _write(self, table: str, new: DataFrame, keys: list[str], buckets: int, schema: T.StructType, merge) -> None:
        spark = self.store.spark
        at = self._held(table, schema, keys, buckets)
        schema, n = T.StructType.fromJson(at["schema"]), at["buckets"]
        touched = sorted(r[0] for r in new.select(self._bucket(keys, n)).distinct().collect())  # n at most
        if not touched:
            self.tables.setdefault(table, at)
            return
        old = self.store._buckets(at, [at["at"][str(b)] for b in touched if str(b) in at["at"]])
        merged = merge(old, new).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("__bucket", self._bucket(keys, n)).repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{self.store.folder}/{folder}")
        made = {int(f.split("=")[1]) for f in files.names(spark, f"{self.store.folder}/{folder}") if f.startswith("__bucket=")}
        now = {b: f for b, f in at["at"].items() if int(b) not in touched} | {str(b): f"{folder}/__bucket={b}" for b in made}
        self.tables[table] = at | {"at": now}
        self.touched[table] = sorted({*self.touched.get(table, []), *touched})

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows that are added as they are, once a table and change."""
        if table in self.appended:
            raise ValueError(f"{table} has been added to")
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.folder}/{folder}")
        self.appended[table] = folder
        self.schemas[table] = rows.schema.jsonValue()

    def commit(self, stream: str | None = None, batch: int | None = None) -> int:
        """Make all of it visible and return the new version; with a stream's batch, only if that hasn't been committed.

        Raises ``Conflict`` if another change came first: nothing of this one is visible then.
        """
        if stream is not None and self.base.batches.get(stream, -1) >= batch:
            raise Conflict(f"batch {batch} of {stream} is committed")
        version = self.base.version + 1
        record = {
            "version": version, "tables": self.base.tables | self.tables, "batches": self.base.batches | ({stream: batch} if stream is not None else {}), "appended": self.appended,
            "compacted": self.base.compacted | self.compacted, "schemas": self.base.schemas | self.schemas,
        }
        if not files.create(self.store.spark, self.store._log(version), json.dumps(record)):
            raise Conflict(f"version {version} is another's")
        return version
