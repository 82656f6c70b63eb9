"""Dictionaries of reference sizes and of categories: short documents kept beside the code, as tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = ("length", "width", "height")
DIMENSIONS = (
    "class_name string, class_order int, ref_id int, size_basis string, note string, ref_length double, ref_width double, ref_height double, "
    "tol_length double, tol_width double, tol_height double, tolerance double")


def dimensions(spark: SparkSession, document: Mapping[str, Any]) -> DataFrame:
    """One row per class of `classes`, in order; references or tolerances that aren't given are null.

    The rules judge each side by its own tolerance; `tolerance` is that of all sides, null where they differ or one is missing.
    """
    rows = []
    for i, (name, raw) in enumerate((document.get("classes") or {}).items()):
        refs, tols = ([None if (own.get(s)) is None else float(own[s]) for s in SIDES] for own in (raw.get("reference_size") or {}, raw.get("tolerance") or {}))
        rows.append((str(name), i, raw.get("id"), raw.get("size_basis"), raw.get("note"), *refs, *tols, tols[0] if len(set(tols)) == 1 else None))
    return spark.createDataFrame(rows, DIMENSIONS)


def categories(spark: SparkSession, document: Mapping[str, Any]) -> DataFrame:
    """name, category_order, description, dimension_keys (the name itself if none are given); empty and repeated names are errors."""
    rows: list[tuple] = []
    for i, raw in enumerate(document.get("categories") or [], 1):
        if not isinstance(raw, Mapping):
            raise ValueError(f"category {i} has to be an object")
        name = str(raw.get("name") or "").strip()
        if not name or name in {r[0] for r in rows}:
            raise ValueError(f"category {i} has no name" if not name else f"category {name} is there twice")
        keys = [k for k in (str(x).strip() for x in raw.get("dimension_keys") or [name]) if k]
        rows.append((name, i - 1, str(raw.get("description") or "").strip(), keys))
    if not rows:
        raise ValueError("there are no categories")
    return spark.createDataFrame(rows, "name string, category_order int, description string, dimension_keys array<string>")


def bullet_list(found: DataFrame) -> DataFrame:
    """One row: the categories as lines of a list, in order, each with its description."""
    line = F.concat(F.lit("- "), "name", F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""))
    return found.select(F.struct("category_order", line.alias("line")).alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))
