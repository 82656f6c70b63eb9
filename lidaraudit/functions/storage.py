"""Tables that a job writes on its way: lineage ends there, and rounds start from files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, read again. Without that setting local masters get a temporary folder; on a cluster it is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: rounds need a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base := f"file://{tempfile.mkdtemp(prefix='lidaraudit-')}")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
