"""Results that several parts of a plan use, worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once in the folder of spark.checkpoint.dir, which all executors share; a temporary folder where that is unset (tests)."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/trekframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
