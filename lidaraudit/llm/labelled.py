"""Labelled rows to learn from: the training side of the fixed split, in a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int) -> Column:
    """The split of the contracts: crc32 of doc_id as text leaves no remainder. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def sample(labels: DataFrame, column: str, rows: int, each: bool, parts: int = 5) -> DataFrame:
    """doc_id, label, place: at most `rows` labelled rows (of each class) that aren't held out.

    They are those whose doc_id has the least hash, so reruns agree; place counts them from 0.
    Labels that are null, and doc_ids that are null or labelled differently twice, are left out.
    """
    ids = labels.where(~held_out(F.col("doc_id"), parts)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    ids = ids.where("doc_id is not null and label = other").select("doc_id", "label", F.xxhash64("doc_id").alias("order"))
    least = lambda x: x.orderBy("order", "doc_id").limit(rows)
    return least(ids.where("label = 1")).unionByName(least(ids.where("label = 0"))) if each else least(ids)
