"""Picture files of frames with their sizes, and which frames have a point cloud."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's beginning that are looked at first; where the size stands behind more, the whole file is.
HEAD = 1 << 18


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG file, from its head."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8:  # filling, or a mark without a body
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _place(path: str = "path") -> list[F.Column]:
    return [F.regexp_extract(path, "scene_([^/]+)/", 1).alias("scene_id"), F.regexp_extract(path, "frame_([0-9]+)/", 1).try_cast("int").alias("frame_index")]


def images(spark: SparkSession, path: str, head: int = HEAD) -> DataFrame:
    """scene_id, frame_index, asset_name, path, width, height of all pictures scene_<id>/frame_<n>/*.jpg, .jpeg or .png; unreadable ones have null sizes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", "true").load(path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [size_of(c) or (None, None) for c in batch["head"]]
            yield pd.DataFrame({"path": batch["path"], "width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})

    shape = "path string, width int, height int"
    first = files.select("path", F.substring("content", 1, head).alias("head")).mapInPandas(work, shape)
    longer = files.where(F.col("length") > head).select("path", F.col("content").alias("head"))
    unknown = first.where("width is null").select("path")
    whole = longer.join(unknown, "path", "left_semi").mapInPandas(work, shape)
    rows = first.join(whole.select("path", F.col("width").alias("w"), F.col("height").alias("h")), "path", "left").select("path", F.coalesce("width", "w").alias("width"), F.coalesce("height", "h").alias("height"))
    return rows.select(*_place(), F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("asset_name"), "path", "width", "height")


def frames_with_cloud(spark: SparkSession, expected: DataFrame, path: str) -> DataFrame:
    """Expected frames for which there is a file scene_<id>/frame_<n>/*.pcd; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", "true").load(path)
    return expected.join(files.select("path").select(*_place()).distinct(), ["scene_id", "frame_index"], "left_semi")
