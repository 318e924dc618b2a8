"""Shared helpers: durable intermediate tables, bounded slices of Arrow batches, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="trekframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _cleanup() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone; the cluster's retention removes the folder
            return


atexit.register(_cleanup)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once in the shared folder.

    It cuts the lineage: later stages, and tasks repeated after an executor is
    lost, read files that every executor can see instead of computing df again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """name, or with underscores after it, as a name that is not among columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch: ten thousand long texts at once, the default, cost a task hundreds of MB."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, rows)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 1024, max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches so that each part's texts hold about max_bytes; a longer single text is a part of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start, held = 0, 0
        lengths = [0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start), texts.slice(start).to_pylist()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b: bigint, not null): (node, component), component the least node.

    Alternating large-star and small-star rounds.  A round moves each edge once
    or twice, so a hub's edges are dealt by Spark's skew join and no component is
    ever gathered in a task.  Nodes without an edge to another are not returned.
    """
    flat = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    flat = stored(flat, "edges")
    seen = flat.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = flat.union(flat.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        flat = stored(small, "edges")
        now = flat.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node but the roots has exactly one edge, to its root
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).union(flat.select("v", "v").distinct())
