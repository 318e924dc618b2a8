"""Several tables that change together: versions behind a manifest that is put in place in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class Snapshots:
    """Tables with a column trip_id, in ``buckets`` parts each by its hash.

    A version is one file, ``manifests/<number>.json``, that names the folder of
    every part of every table.  A commit writes the parts that it changes to new
    folders, beside those of older versions, and then moves its manifest into
    place; until then readers resolve the version before, and a run cut short
    leaves folders that no manifest names (``expire`` removes them).  What a commit
    writes grows with the parts that hold its trips, not with the tables.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str) -> None:
        """A file written aside and moved to a name that must not exist."""
        jvm = self.spark.sparkContext._jvm
        fs, aside = self._fs(f"aside/{uuid.uuid4().hex}")
        _, there = self._fs(path)
        fs.mkdirs(there.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(aside, there, options)
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(path) from e

    def versions(self) -> list[int]:
        """Numbers of the versions in place, ascending."""
        fs, p = self._fs("manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """That of a version, by default of the last one; null where there is none or its format is another."""
        every = self.versions()
        version = version if version is not None else every[-1] if every else None
        if version not in every:
            return None
        text = self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        return found if found.get("format") == FORMAT else None

    # tables

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, all its parts from the same one."""
        m = self.manifest(version)
        if m is None or name not in m["tables"]:
            raise KeyError(name)
        return self._rows(m["tables"][name])

    def _rows(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.root}/{p}" for k, p in table["parts"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("trip_id"), F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], trips: DataFrame | None = None, keys: dict[str, str] | None = None) -> int:
        """K1: in every one of ``tables`` the rows of ``trips``(trip_id), by default of all trips named by any of them, are replaced, at once.

        So a trip that a table's new rows do not name loses its old ones.  keys are
        kept with the version, as what a table was made from (S18); a table that
        changes without one loses its own.  Result: the
        version's number.  Rows may be read from the tables themselves.
        """
        old = self.manifest() or {"format": FORMAT, "tables": {}, "keys": {}}
        number = (self.versions() or [0])[-1] + 1
        if trips is None:
            named = [df.select("trip_id") for df in tables.values()]
            trips = named[0]
            for df in named[1:]:
                trips = trips.union(df)
        trips = trips.select("trip_id").distinct()
        touched = sorted(r[0] for r in trips.select(self._bucket().alias("b")).distinct().collect())  # bucket numbers only
        after = dict(old["tables"])
        for name, rows in tables.items():
            before = after.get(name)
            if before is not None:
                kept = self._rows(before, touched).join(trips, "trip_id", "left_anti")
                rows = kept.unionByName(rows.select(kept.columns))
            folder = f"data/{name}/{uuid.uuid4().hex}"
            rows.withColumn("__b", self._bucket()).repartition("__b", "trip_id").write.partitionBy("__b").parquet(f"{self.root}/{folder}")
            fs, p = self._fs(folder)
            new = {f.getPath().getName()[4:] for f in fs.listStatus(p) if f.getPath().getName().startswith("__b=")}
            parts = {k: v for k, v in (before or {"parts": {}})["parts"].items() if int(k) not in touched}
            # a schema read back from files allows nulls everywhere
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
            after[name] = {"schema": schema.jsonValue(), "parts": parts | {k: f"{folder}/__b={k}" for k in new}}
        self._put(f"manifests/{number:012d}.json", json.dumps({"format": FORMAT, "version": number, "tables": after, "keys": {k: v for k, v in old["keys"].items() if k not in tables} | (keys or {})}))
        return number

    def memo(self, name: str, key: str, compute) -> DataFrame:
        """A table made from inputs of this key, if the last version has it; else it is computed and committed."""
        m = self.manifest()
        if m is None or m["keys"].get(name) != key or name not in m["tables"]:
            rows = compute()
            trips = rows.select("trip_id")
            if m is not None and name in m["tables"]:
                trips = trips.union(self._rows(m["tables"][name]).select("trip_id"))
            self.commit({name: rows}, trips, {name: key})
        return self.read(name)

    def expire(self, keep: int = 2) -> None:
        """Removes all but the last versions, and data that none of those names; not while a commit is under way."""
        every = self.versions()
        kept = [self.manifest(v) for v in every[-keep:]]
        used = {p.rpartition("/")[0] for m in kept if m for t in m["tables"].values() for p in t["parts"].values()}
        for v in every[:-keep]:
            fs, p = self._fs(f"manifests/{v:012d}.json")
            fs.delete(p, False)
        fs, p = self._fs("data")
        if fs.exists(p):
            for t in fs.listStatus(p):
                for f in fs.listStatus(t.getPath()):
                    if f"data/{t.getPath().getName()}/{f.getPath().getName()}" not in used:
                        fs.delete(f.getPath(), True)
