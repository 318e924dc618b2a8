"""Tables in a folder: Parquet, partitioned by trip, replaced a partition at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Store:
    """Writes go through Spark's commit protocol: readers see a partition's old files or its new ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, where: Column | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df if where is None else df.where(where)

    def replace_trips(self, name: str, rows: DataFrame, key: list[str] | None = None, recency: str | None = None) -> None:
        """K1: all rows of the trips in ``rows`` are replaced; of rows with one key the most recent stays, of equally recent ones that with the least hash."""
        if key:
            w = Window.partitionBy("trip_id", *key).orderBy(*([F.desc(recency)] if recency else []), F.xxhash64(*rows.columns))
            rows = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        rows.repartition("trip_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trip_id").parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """K2: only the partitions of the trips concerned are written."""
        old = self.read(name).join(rows.select("trip_id").distinct(), "trip_id", "left_semi")
        kept = old.join(rows.select("trip_id", *key), ["trip_id", *key], "left_anti").unionByName(rows)
        self._swap(name, kept)

    def update(self, name: str, match: Column, values: dict[str, Column]) -> None:
        """K3: new values where match holds, in the partitions that have such rows."""
        df = self.read(name)
        trips = df.where(match).select("trip_id").distinct()
        hit = F.coalesce(match, F.lit(False))
        self._swap(name, df.join(trips, "trip_id", "left_semi").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()}))

    def override(self, name: str, log: str, kind: str, key: str, column: str, rows: DataFrame) -> None:
        """K4: rows(trip_id, key, value) are kept in the table ``log`` as overrides, then set in ``column``.

        The override is written first and both writes may be repeated, so a run
        cut short is finished by running it again.  Both tables exist.
        """
        source = F.col(key).cast("string")
        self.upsert(log, rows.select("trip_id", F.concat_ws(":", F.lit(kind), source).alias("id"), F.lit(kind).alias("target_type"), source.alias("target_id"), F.col("value").cast("string").alias("value")), ["id"])
        new = rows.select("trip_id", key, F.col("value").alias("__value"), F.lit(True).alias("__set"))
        old = self.read(name).join(rows.select("trip_id").distinct(), "trip_id", "left_semi")
        self._swap(name, old.join(new, ["trip_id", key], "left").withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).drop("__value", "__set").select(self.read(name).columns))

    def delete(self, name: str, match: Column) -> None:
        """K5.  A partition that loses all its rows is left empty."""
        df = self.read(name)
        keep = df.where(~F.coalesce(match, F.lit(False)))
        gone = df.where(match).select("trip_id").distinct()
        self._swap(name, keep.join(gone, "trip_id", "left_semi"), gone)

    def drop_trips(self, names: list[str], trips: list) -> None:
        """K5: a trip and its children."""
        for name in names:
            self.delete(name, F.col("trip_id").isin(trips))

    def drop_orphans(self, child: str, parent: str, key: str) -> int:
        """K6: children without a parent; how many."""
        kids = self.read(child)
        kept = kids.join(self.read(parent).select(key).distinct(), key, "left_semi")
        n = kids.count() - kept.count()
        if n:
            bad = kids.join(self.read(parent).select(key).distinct(), key, "left_anti").select("trip_id").distinct()
            self._swap(child, kept.join(bad, "trip_id", "left_semi").select(kids.columns), bad)
        return n

    def _swap(self, name: str, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Writes new partitions beside the table, then moves them in; rows may read the table itself.

        A partition that has lost all its rows is removed last, so a run cut short
        leaves old rows or new ones, and is finished by running it again.
        """
        aside = f"{self.root}/.{name}-new"
        rows.repartition("trip_id").write.mode("overwrite").partitionBy("trip_id").parquet(aside)
        fresh = self.spark.read.schema(self.read(name).schema).parquet(aside)
        empty = [] if touched is None else [r[0] for r in touched.join(fresh.select("trip_id").distinct(), "trip_id", "left_anti").collect()]  # trip ids only
        if not fresh.isEmpty():
            self.replace_trips(name, fresh)
        self._remove(name, empty)

    def _remove(self, name: str, trips: list) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in trips:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/trip_id={t}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Columns each version adds to a table, with their defaults.
VERSIONS = {2: {"confidence": "CAST(NULL AS FLOAT)"}, 3: {"is_override": "false"}, 4: {"zone": "CAST(NULL AS STRING)"}}


def migrated(df: DataFrame, version: int, target: int = 4, key: list[str] | None = None) -> DataFrame:
    """A table of an older version with the columns since added; rows stay, of those with one key that with the least hash."""
    if key:
        w = Window.partitionBy(*key).orderBy(F.xxhash64(*df.columns))
        df = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    for v in range(version + 1, target + 1):
        for name, default in VERSIONS.get(v, {}).items():
            if name not in df.columns:
                df = df.withColumn(name, F.expr(default))
    return df


def export_archive(trips: DataFrame, cap: int = 32 << 20) -> DataFrame:
    """K7: trips(id, title, visits) as archive texts; one over the cap is not exported but marked."""
    text = F.to_json(F.struct(F.lit("trip-archive").alias("format"), F.lit(1).alias("version"), F.struct("id", "title", "visits").alias("trip")))
    return trips.select("id", text.alias("text")).withColumn("fits", F.octet_length("text") <= cap)


def prepared(items: DataFrame, cached: DataFrame, compute, key: str = "id") -> DataFrame:
    """Rows of ``cached`` whose fingerprint still holds, and compute() of the other items."""
    todo = items.join(cached.select(key, "print"), [key, "print"], "left_anti")
    return cached.join(items.select(key, "print"), [key, "print"], "left_semi").unionByName(compute(todo))
