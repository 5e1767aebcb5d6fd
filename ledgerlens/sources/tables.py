"""Stored tables that change: Parquet folders by key bucket, listed by numbered versions.

A row lies in the bucket that the hash of its keys names, so a change reads and writes the
buckets of its own rows only. Every change writes new folders first and then publishes a
new version, a small JSON file that lists the folder of every bucket; publishing renames it
to the next number, which fails if another writer was there before. Readers see a whole version,
old or new, never half of one; a writer that dies before publishing leaves folders that no
version names. A writer that comes second takes the other's version as its base if the two
touched different buckets, else it raises Conflict and has changed nothing.

Cases: rows with null keys have a bucket like any other, and replace rows of equal keys, null included. Of several new rows
of a key one stays, by the hash of its columns. An empty change publishes nothing. Columns
that a change adds are null in older rows, columns it lacks are null in its own; a column of
another type is refused. Versions are kept until `dropped`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.storage import removed
from ledgerlens.sources import schema as declared

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer changed the same buckets."""


class StoredTable:
    """The table in a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, part: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)

    @classmethod
    def created(cls, spark: SparkSession, path: str, columns: T.StructType, keys: list[str], buckets: int = 64) -> StoredTable:
        """An empty table; a table that is there already is refused."""
        made = cls(spark, path)
        made._publish({"version": 0, "columns": columns.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}})
        return made

    @classmethod
    def declared(cls, spark: SparkSession, path: str, table: str, buckets: int = 64) -> StoredTable:
        """One of the tables of `schema`, by its unique columns, else by its id."""
        return cls.created(spark, path, declared.empty(spark, table).schema, declared.UNIQUE.get(table, ["id"]), buckets)

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds; the newest by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {version} of {self.path}" if known else f"no table in {self.path}")
        stream = self._fs.open(self._path(f"versions/{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Writes the version under a name of its own, then renames it to its number."""
        own, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{manifest['version']:08d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(own), self._fs.makeQualified(final), none)  # never over a file that is there
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(final):
                raise Conflict(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A version's rows, or those of some of its buckets."""
        m = self.manifest(version)
        columns = T.StructType.fromJson(m["columns"])
        folders = [f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(columns).parquet(*folders) if folders else self.spark.createDataFrame([], columns)

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, m: dict) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(m)).distinct().collect()}  # one number a bucket

    def _written(self, rows: DataFrame, m: dict) -> dict[str, str]:
        """The folders of the buckets that rows were written to."""
        to = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(m)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{to}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(to)) if s.isDirectory()]
        return {n.partition("=")[2]: f"{to}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _changed(self, base: dict, touched: set[int], folders: dict[str, str], columns: T.StructType) -> int:
        """Publishes the version in which the touched buckets lie in `folders`; over other writers' versions if they touched others."""
        while True:
            newest = self.manifest()
            if newest["version"] > base["version"]:
                moved = {int(b) for b in {*newest["folders"], *base["folders"]} if newest["folders"].get(b) != base["folders"].get(b)}
                if moved & touched or newest["columns"] != base["columns"]:
                    raise Conflict(f"{self.path}: buckets changed since version {base['version']}")
            kept = {b: f for b, f in newest["folders"].items() if int(b) not in touched}
            try:
                self._publish({**newest, "version": newest["version"] + 1, "columns": columns.jsonValue(), "folders": {**kept, **folders}})
                return newest["version"] + 1
            except Conflict:
                continue  # someone was faster: look at what they touched

    @staticmethod
    def _both(old: T.StructType, new: T.StructType) -> T.StructType:
        """All columns, the old ones first."""
        for f in new:
            if f.name in old.names and old[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {old[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        return T.StructType([*old, *(f for f in new if f.name not in old.names)])

    def upsert(self, rows: DataFrame, replace: bool = True) -> int:
        """Rows in the place of those with their keys, or, without `replace`, only where there are none; the version after it."""
        base = self.manifest()
        columns = self._both(T.StructType.fromJson(base["columns"]), rows.schema)
        touched = self._touched(rows, base)
        if not touched:
            return base["version"]
        new = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
        held = self.read(base["version"], touched)
        held = held.select(*[F.col(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
        keys, rest = base["keys"], [c for c in columns.names if c not in base["keys"]]
        ranked = [h.select(*keys, F.struct(F.lit(k).alias("newer"), F.xxhash64(*rest).alias("h"), *rest).alias("r")) for k, h in ((int(not replace), held), (int(replace), new))]
        merged = ranked[0].unionByName(ranked[1]).groupBy(*keys).agg(F.max_by("r", F.struct("r.newer", "r.h")).alias("r")).select(*keys, *[f"r.{c}" for c in rest])
        return self._changed(base, touched, self._written(merged.select(*columns.names), base), columns)

    def delete(self, condition: Column) -> int:
        """Without the rows that meet the condition; where it is null a row stays."""
        base = self.manifest()
        meets = F.coalesce(condition, F.lit(False))
        touched = self._touched(self.read(base["version"]).where(meets), base)
        if not touched:
            return base["version"]
        columns = T.StructType.fromJson(base["columns"])
        return self._changed(base, touched, self._written(self.read(base["version"], touched).where(~meets), base), columns)

    def refresh(self, rows: DataFrame) -> int:
        """All rows anew, whatever was there."""
        base = self.manifest()
        every = set(range(base["buckets"]))
        return self._changed(base, every, self._written(rows, base), rows.schema)

    def dropped(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the newest `keep`, and the data folders that no version names; returns those. Not while others write."""
        known = self.versions()
        for version in known[: max(len(known) - keep, 0)]:
            self._fs.delete(self._path(f"versions/{version:08d}.json"), False)
        named = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        folder = self._path("data")
        there = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        gone = sorted(n for n in there if n not in named)
        for n in gone:
            removed(self.spark, f"{self.path}/data/{n}")
        return gone
