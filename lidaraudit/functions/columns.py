"""Column helpers: typed reads of raw text, keys, geometry and name patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_FIELDS = ("track_id", "target_id", "uuid", "object_id")
AXES = ("x", "y", "z")


def number(raw: Column) -> Column:
    """Text to double; null, blank or anything that isn't a number gives null."""
    return F.trim(raw).try_cast("double")


def filled(c: str) -> Column:
    """The text, or null where it is missing or empty."""
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def vector(prefix: str) -> Column:
    """struct<x,y,z> if all three columns are there, else null."""
    parts = [F.col(f"{prefix}_{a}") for a in AXES]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(whole, F.struct(*[p.alias(a) for p, a in zip(parts, AXES, strict=True)]))


def label() -> Column:
    """className, else label, else an empty text."""
    return F.coalesce(filled("className"), filled("label"), F.lit(""))


def key_value() -> Column:
    """What names an object over frames: the first field that is filled, else its number in the frame."""
    return F.coalesce(*[filled(c) for c in KEY_FIELDS], F.col("bbox_index").cast("string"))


def target_key(boxes: DataFrame) -> Column:
    """The stored key of an object, as far as boxes have that column: a row without one is told by its number in the frame.

    Boxes without the column have the key that would be stored.
    """
    if "resolved_target_key" not in boxes.columns:
        return key_value()
    return F.coalesce(filled("resolved_target_key"), F.concat(F.lit("bbox_index:"), F.coalesce(F.col("bbox_index").cast("string"), F.lit(""))))


def key_field() -> Column:
    picked = F.when(filled(KEY_FIELDS[0]).isNotNull(), KEY_FIELDS[0])
    for c in KEY_FIELDS[1:]:
        picked = picked.when(filled(c).isNotNull(), c)
    return picked.otherwise("bbox_index")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in AXES), F.lit(0.0)))


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference of two angles, around the circle."""
    return F.abs(F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi)


def above(value: Column, limit: float) -> Column:
    """value > limit; false for NaN, which Spark takes for the largest number."""
    return ~F.isnan(value) & (value > limit)


def below(value: Column, limit: float) -> Column:
    return ~F.isnan(value) & (value < limit)


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Rows of Rx * Ry * Rz."""
    (a, b), (c, d), (e, f) = ((F.cos(r), F.sin(r)) for r in (rx, ry, rz))
    return [
        [c * e, -c * f, d],
        [a * f + b * d * e, a * e - b * d * f, -b * c],
        [b * f - a * d * e, b * e + a * d * f, a * c],
    ]


def safe_name(text: Column) -> Column:
    """Letters, digits, `_`, `.` and `-`; other runs become `_`, and none of `._` stand at the ends."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def camera_name(url: Column, position: Column) -> Column:
    """The part of the address after /camera/ in lower case, else camera_<position>."""
    found = F.lower(F.regexp_extract(url, r"(?i)/camera/([A-Za-z0-9_\-]+)/", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.concat(F.lit("camera_"), position.cast("string")))


def numeric_suffix(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit("")).try_cast("bigint"), F.lit(1_000_000_000).cast("bigint"))


def frame_name(frame: Column) -> Column:
    return F.format_string("frame_%04d", frame)


def is_sampled(frame: Column, start: int, every: int) -> Column:
    """Each so many frames from the first one."""
    return F.lit(True) if every <= 1 else F.pmod(frame - start, F.lit(every)) == 0


def size_ratio(a: Column, b: Column) -> Column:
    """Largest quotient of the sorted sides of two boxes (arrays of three), either way round."""
    return F.array_max(F.zip_with(F.sort_array(a), F.sort_array(b), lambda x, y: F.greatest(F.greatest(x, F.lit(1e-6)) / F.greatest(y, F.lit(1e-6)), F.greatest(y, F.lit(1e-6)) / F.greatest(x, F.lit(1e-6)))))
