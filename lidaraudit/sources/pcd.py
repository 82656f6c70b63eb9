"""Point-cloud files (PCD): ascii, binary and compressed bodies to rows of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The format's letters and sizes.
KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4"}


def decompressed(data: bytes, size: int) -> bytes:
    """LZF: a control byte under 32 begins that many literals and one more; else a copy of what came before."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        at = len(out) - ((c & 31) << 8) - data[i] - 1
        i += 1
        if at < 0:
            raise ValueError("a copy begins before the data")
        for k in range(n + 2):  # source and copy may overlap
            out.append(out[at + k])
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def read_points(content: bytes) -> np.ndarray:
    """x, y, z of all points; an error for missing axes, unknown types or modes, and short bodies."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("no DATA line")
        words = content[at:end].decode("ascii", "replace").split("#")[0].split()
        if words:
            head[words[0].upper()] = words[1:]
        at = end + 1
    fields = head.get("FIELDS", [])
    sizes = [int(x) for x in head.get("SIZE", ["4"] * len(fields))]
    kinds = head.get("TYPE", ["F"] * len(fields))
    counts = [int(x) for x in head.get("COUNT", ["1"] * len(fields))]
    n = int(head["POINTS"][0] if "POINTS" in head else head.get("WIDTH", ["0"])[0])
    if not {"x", "y", "z"} <= set(fields):
        raise ValueError("x, y and z are needed")
    if bad := [k for k in zip(kinds, sizes, strict=True) if k not in KINDS]:
        raise ValueError(f"type {bad[0]} isn't known")
    mode, body = head["DATA"][0].lower(), content[at:]
    first = dict(zip(fields, np.cumsum([0, *counts])[:-1].tolist(), strict=True))
    if mode == "ascii":
        values = body.split()
        width = sum(counts)
        if len(values) < n * width:
            raise ValueError("the body is too short")
        table = np.array(values[: n * width], dtype="S").reshape(n, width)
        return np.column_stack([table[:, first[a]].astype(np.float64) for a in "xyz"]) if n else np.zeros((0, 3))
    if mode == "binary":
        row = np.dtype([(f"{f}{i}", KINDS[k, s], (c,)) for i, (f, k, s, c) in enumerate(zip(fields, kinds, sizes, counts, strict=True))])
        table = np.frombuffer(body, row, n)
        return np.column_stack([table[f"{a}{fields.index(a)}"][:, 0].astype(np.float64) for a in "xyz"])
    if mode == "binary_compressed":
        packed, size = np.frombuffer(body, "<u4", 2).tolist()
        raw = decompressed(body[8 : 8 + packed], size)
        starts = np.cumsum([0, *[s * c * n for s, c in zip(sizes, counts, strict=True)]])
        column = lambda a: np.frombuffer(raw, KINDS[kinds[i := fields.index(a)], sizes[i]], n * counts[i], int(starts[i])).reshape(n, -1)[:, 0]
        return np.column_stack([column(a).astype(np.float64) for a in "xyz"])
    raise ValueError(f"mode {mode} isn't known")


def points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all files scene_<id>/frame_<n>/*.pcd under path; a file that can't be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", "true").load(path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    p, error = read_points(content), None
                except (ValueError, KeyError, IndexError) as e:
                    p, error = np.full((1, 3), np.nan), str(e)
                yield pd.DataFrame({"path": path, "point_idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "error": error})

    rows = files.select("path", "content").mapInPandas(work, "path string, point_idx long, x double, y double, z double, error string")
    return rows.selectExpr("regexp_extract(path, 'scene_([^/]+)/', 1) AS scene_id", "try_cast(regexp_extract(path, 'frame_([0-9]+)/', 1) AS int) AS frame_index", "point_idx", "x", "y", "z", "error", "path")
