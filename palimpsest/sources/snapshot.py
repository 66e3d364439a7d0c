"""Sets of tables with versions: a commit writes new folders, then one manifest that names them all.

A table is one folder or more: what a commit appends is a further one, until there
are MOST_FOLDERS, which the next commit that appends makes one again. Tables in
BUCKETED are dealt to buckets by a hash of their key, each with folders of its own:
a commit that changes rows by key reads and writes the buckets of these keys alone.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

MOST_FOLDERS = 16
#: Tables that are changed row by row, and the key of their rows.
BUCKETED = {"atoms": "id", "index_points": "id", "session_state": "key", "source_counts": "atom_id"}
BUCKETS = 64
_BUCKET = "_bucket"
#: Seconds that a commit waits for a manifest that another writer has begun.
PATIENCE = 10.0


def _paths(entry) -> list[str]:
    """Folders of a manifest's entry: a name, a list, or buckets."""
    if isinstance(entry, dict):
        return [p for b in sorted(entry["of"], key=int) for p in entry["of"][b]]
    return [entry] if isinstance(entry, str) else list(entry)


class SnapshotStore:
    """Tables below a folder of any Hadoop file system. Readers see the last manifest, whole or not at all."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/_manifests")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, version: int) -> dict | None:
        """A manifest, or None while it isn't written to its end."""
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """Entries of the tables of a version, by default of the last that is whole."""
        for v in reversed(self.versions()) if version is None else [version]:
            found = self._read(v)
            if found is not None:
                return found
        return {}

    def _base(self) -> tuple[int, dict]:
        """The last version and its manifest; waits for one that is being written."""
        until = time.monotonic() + PATIENCE
        while True:
            known = self.versions()
            if not known:
                return 0, {}
            found = self._read(known[-1])
            if found is not None:
                return known[-1], found
            if time.monotonic() > until:
                raise RuntimeError(f"version {known[-1]} was begun and not finished; vacuum() removes it")
            time.sleep(0.2)

    # --- reading

    def _reader(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return schemas.empty(self.spark, name)
        reader = self.spark.read
        return (reader.schema(schemas.TABLES[name]) if name in schemas.TABLES else reader).parquet(*paths)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._reader(name, _paths(self.manifest(version).get(name, [])))

    def buckets(self, name: str) -> dict[int, list[str]]:
        """Folders of each bucket of a table; an empty one has none."""
        entry = self.manifest().get(name, {"of": {}})
        return {int(b): p for b, p in entry["of"].items()} if isinstance(entry, dict) else {0: _paths(entry)}

    def _touched(self, entry: dict, key: str, *keys: DataFrame) -> list[int]:
        """Buckets of the keys: as many numbers as there are buckets at most."""
        found: set[int] = set()
        for df in keys:
            found |= {r[0] for r in df.select(self._bucket(key, entry["buckets"])).distinct().collect()}
        return sorted(found)

    @staticmethod
    def _bucket(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a bucketed table with the keys given; only their buckets are read."""
        key, entry = BUCKETED[name], self.manifest().get(name, [])
        if isinstance(entry, dict):
            rows = self._reader(name, [p for b in self._touched(entry, key, keys) for p in entry["of"].get(str(b), [])])
        else:
            rows = self._reader(name, _paths(entry))
        return rows.join(keys.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")

    # --- writing

    def staged(self, df: DataFrame) -> DataFrame:
        """df, written once and read back: ids and replies of models in it are fixed from then on."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _dealt(self, df: DataFrame, path: str, key: str, n: int) -> dict[str, list[str]]:
        """df written to path, a folder for each bucket that has rows."""
        df.withColumn(_BUCKET, self._bucket(key, n)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        names = [s.getPath().getName() for s in self._listed(path)]
        return {b.partition("=")[2]: [f"{path}/{b}"] for b in names if b.startswith(f"{_BUCKET}=")}

    def _merged(self, name: str, entry, rows: DataFrame | None, gone: DataFrame | None, path: str) -> dict:
        """The entry of a table after rows have taken the place of those of their keys, and those of gone have left."""
        key = BUCKETED[name]
        keys = [df.select(key) for df in (rows, gone) if df is not None]
        whole = not isinstance(entry, dict)
        after = {"buckets": self.n_buckets, "of": {}} if whole else {"buckets": entry["buckets"], "of": dict(entry["of"])}
        touched = [] if whole else self._touched(after, key, *keys)
        old = self._reader(name, _paths(entry) if whole else [p for b in touched for p in after["of"].get(str(b), [])])
        for df in keys:
            old = old.join(df.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
        written = self._dealt(old if rows is None else old.unionByName(rows.select(*old.columns)), path, key, after["buckets"])
        for b in touched:
            after["of"].pop(str(b), None)
        return after | {"of": after["of"] | written}

    def _appended(self, name: str, entry, df: DataFrame, path: str) -> dict:
        key = BUCKETED[name]
        if not isinstance(entry, dict):
            return self._merged(name, entry, df, None, path)
        of = dict(entry["of"])
        for b, new in self._dealt(df, path, key, entry["buckets"]).items():
            of[b] = [*of.get(b, []), *new]
        full = {b: p for b, p in of.items() if len(p) > MOST_FOLDERS}
        if full:
            again = self._dealt(self._reader(name, [p for paths in full.values() for p in paths]), f"{path}-again", key, entry["buckets"])
            of |= again
        return {"buckets": entry["buckets"], "of": of}

    def commit(self, tables: dict[str, DataFrame] | None = None, partition_by: dict[str, list[str]] | None = None, append: dict[str, DataFrame] | None = None, merge: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Write the tables given in place of the old ones, rows to be appended to others, rows to be merged by key, and keys that go; make them current together.

        batch: a stream's name and the number of its batch, which the manifest keeps; see seen().
        """
        version, names = self._base()
        version += 1
        fresh = lambda name: f"{self.root}/{name}/{version}-{uuid.uuid4().hex}"
        for name, df in (tables or {}).items():
            path = fresh(name)
            if name in BUCKETED:
                names[name] = {"buckets": self.n_buckets, "of": self._dealt(df, path, BUCKETED[name], self.n_buckets)}
            else:
                df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(path)
                names[name] = [path]
        for name, df in (append or {}).items():
            before = names.get(name, [])
            if name in BUCKETED:
                names[name] = self._appended(name, before, df, fresh(name))
                continue
            before = _paths(before)
            if len(before) >= MOST_FOLDERS:
                df, before = self._reader(name, before).unionByName(df), []
            df.write.parquet(path := fresh(name))
            names[name] = [*before, path]
        for name in {**(merge or {}), **(gone or {})}:
            rows = (merge or {}).get(name)
            keys = (gone or {}).get(name)
            names[name] = self._merged(name, names.get(name, []), None if rows is None else self.staged(rows), None if keys is None else self.staged(keys.select(BUCKETED[name])), fresh(name))
        if batch:
            names["_batches"] = names.get("_batches", {"of": {}})
            names["_batches"]["of"][batch[0]] = batch[1]
        self._publish(version, names)
        return version

    def _publish(self, version: int, names: dict) -> None:
        """Write the manifest where there is none: of two writers of a version, one creates the file and the other fails."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/_manifests/{version}.json"), False)
        except Exception as e:
            raise RuntimeError(f"version {version} was committed by another writer") from e
        stream.write(bytearray(json.dumps(names).encode()))
        stream.close()

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream, or a later one, is in the last version."""
        return self.manifest().get("_batches", {"of": {}})["of"].get(stream, -1) >= batch

    # --- cleaning

    def vacuum(self, keep: int = 1, older_than_hours: float = 24.0) -> int:
        """Delete manifests but the last `keep` whole ones, and folders that none of these names; returns how many folders went.

        What is younger than older_than_hours stays: a commit, a reader or a job may be at it.
        """
        limit = time.time() * 1000 - older_than_hours * 3_600_000
        whole = [(v, m) for v in self.versions() if (m := self._read(v)) is not None]
        kept = whole[-keep:]
        needed = {p for _, names in kept for table, entry in names.items() if table != "_batches" for p in _paths(entry)}
        went = 0
        for status in self._listed(f"{self.root}/_manifests"):
            version = status.getPath().getName().removesuffix(".json")
            if status.getModificationTime() <= limit and version not in {str(v) for v, _ in kept}:
                self._fs.delete(status.getPath(), False)
        for table in self._listed(self.root):
            name = table.getPath().getName()
            if not table.isDirectory() or name in ("_manifests", "_lexical"):
                continue
            for folder in self._listed(f"{self.root}/{name}"):
                path = f"{self.root}/{name}/{folder.getPath().getName()}"
                inner = [f"{path}/{s.getPath().getName()}" for s in self._listed(path) if s.isDirectory()] if folder.isDirectory() else []
                if folder.getModificationTime() > limit or path in needed:
                    continue
                dead = [path] if not needed.intersection(inner) else [p for p in inner if p not in needed]
                for p in dead:
                    self._fs.delete(self._path(p), True)
                went += len(dead)
        return went
