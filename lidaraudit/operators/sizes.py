"""Rules over the size of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.operators.tracks import entry, findings, keyed

OUTLIER_MIN, OUTLIER_MAX = 0.1, 30.0
SIDES = (("length", "x"), ("width", "y"), ("height", "z"))
#: Classes of a dictionary that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_CLASSES = 50_000


def sized(boxes: DataFrame) -> DataFrame:
    return keyed(boxes).withColumn("scale", C.vector("scale"))


def outlier_entries(least: float = OUTLIER_MIN, most: float = OUTLIER_MAX) -> list[Column]:
    """A side out of bounds, up to three findings of a box; a box with a side missing is left out."""
    side = lambda a: F.col(f"scale.{a}")
    return [entry("SizeOutlier", C.below(side(a), least) | C.above(side(a), most), side(a), i) for i, a in enumerate(C.AXES)]


def size_outlier(boxes: DataFrame, least: float = OUTLIER_MIN, most: float = OUTLIER_MAX) -> DataFrame:
    return findings(sized(boxes), outlier_entries(least, most))


def with_variants(dimensions: DataFrame) -> DataFrame:
    """class, variant: a class stands for itself, and a name with `_` for each of its beginnings before one.

    So classes meet their variants by equality, not by a test of prefixes.
    """
    parts = F.split("class_name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    return dimensions.select(F.explode(prefixes).alias("class"), F.col("class_name").alias("variant"), "*").withColumn("exact", F.col("class") == F.col("variant"))


def class_references(dimensions: DataFrame) -> DataFrame:
    """One row per class: how many candidates it has, and those with all references and tolerances, the class itself first, then in order.

    A side's tolerance is tol_<side>, or the one tolerance of all sides where there is no such column.
    """
    whole = dimensions.withColumns({f"tol_{s}": F.col(f"tol_{s}" if f"tol_{s}" in dimensions.columns else "tolerance") for s, _ in SIDES})
    given = [f"{kind}_{s}" for kind in ("ref", "tol") for s, _ in SIDES]
    usable = F.expr(" and ".join(f"{c} is not null" for c in given))
    one = F.struct((~F.col("exact")).alias("other"), "class_order", "variant", *given)
    return with_variants(whole).groupBy("class").agg(F.count("variant").alias("candidates"), F.sort_array(F.collect_list(F.when(usable, one))).alias("references"))


def with_references(rows: DataFrame, dimensions: DataFrame) -> DataFrame:
    """rows (label_of) with candidates and references of their class; the table of classes is broadcast if it is short."""
    table = class_references(dimensions)
    short = dimensions.count() <= BROADCAST_CLASSES
    return rows.join(F.broadcast(table) if short else table, rows.label_of == table["class"], "left").drop("class")


def mismatch_entries(strategy: str = "any_variant") -> list[Column]:
    """No variant of the class has a reference that all sides are near to; value: the least largest deviation.

    A class with one candidate takes that one's outcome; with several and strategy "skip", none. A reference of
    0 is infinitely far from any other size. Rows: sized() and with_references().
    """
    side = {s: F.col(f"scale.{a}") for s, a in SIDES}
    near = lambda r, s: side[s].between(r[f"ref_{s}"] * (1 - r[f"tol_{s}"]), r[f"ref_{s}"] * (1 + r[f"tol_{s}"]))
    off = lambda r, s: F.when(r[f"ref_{s}"] == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.abs(side[s] - r[f"ref_{s}"]), r[f"ref_{s}"]))
    passes = F.exists("references", lambda r: near(r, "length") & near(r, "width") & near(r, "height"))
    deviation = F.array_min(F.transform("references", lambda r: F.greatest(*[off(r, s) for s, _ in SIDES])))
    asked = F.col("scale").isNotNull() & (F.col("label_of") != "") & (F.size("references") > 0)
    if strategy == "skip":
        asked = asked & (F.col("candidates") == 1)
    return [entry("DimensionMismatch", F.coalesce(asked & ~passes, F.lit(False)), deviation)]


def best_variant(rows: DataFrame) -> DataFrame:
    """rows with the variant that they are judged by: the first that fits, else the one of the least largest deviation."""
    side = {s: F.col(f"scale.{a}") for s, a in SIDES}
    near = lambda r: F.forall(F.array(*[side[s].between(r[f"ref_{s}"] * (1 - r[f"tol_{s}"]), r[f"ref_{s}"] * (1 + r[f"tol_{s}"])) for s, _ in SIDES]), lambda x: x)
    off = lambda r: F.greatest(*[F.when(r[f"ref_{s}"] == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.abs(side[s] - r[f"ref_{s}"]), r[f"ref_{s}"])) for s, _ in SIDES])
    judged = F.transform("references", lambda r, i: F.struct(F.when(near(r), F.lit(-1.0)).otherwise(off(r)).alias("deviation"), i.alias("place"), r["variant"].alias("variant")))
    return rows.withColumn("variant", F.when(F.col("scale").isNotNull(), F.array_min(judged)["variant"]))


def dimension_mismatch(boxes: DataFrame, dimensions: DataFrame, strategy: str = "any_variant") -> DataFrame:
    return findings(with_references(sized(boxes), dimensions), mismatch_entries(strategy))


def reference_sizes(boxes: DataFrame) -> DataFrame:
    """Reference sides of a class: the median over frames of each object, then the median of these over objects."""
    rows = keyed(boxes).withColumn("scale", C.vector("scale")).where("scale is not null and label_of <> ''")
    one = rows.groupBy("label_of", "scene_id", "target_key").agg(*[F.median(f"scale.{a}").alias(s) for s, a in SIDES])
    return one.groupBy(F.col("label_of").alias("class_name")).agg(F.count("target_key").alias("objects"), *[F.median(s).alias(f"ref_{s}") for s, _ in SIDES])
