"""The traps of the rules, on rows made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.operators import frames, sizes, summary, tracks
from lidaraudit.plans import rules

FIELDS = "scene_id string, frame_index int, bbox_index long, track_id string, target_id string, uuid string, object_id string, label string, className string, position_x double, position_y double, position_z double, rotation_z double, scale_x double, scale_y double, scale_z double"


def boxes(spark, rows):
    full = []
    for i, r in enumerate(rows):
        v = {"track": "t", "label": "car", "x": 0.0, "turn": 0.0, "size": (1.0, 1.0, 1.0)} | r
        full.append(("s", v["frame"], i, v["track"], "", "", "", "", v["label"], v["x"], 0.0, 0.0, v["turn"], *v["size"]))
    return spark.createDataFrame(full, FIELDS)


def expected(spark, n, failed=()):
    return spark.createDataFrame([("s", f, f not in failed) for f in range(1, n + 1)], "scene_id string, frame_index int, read_ok boolean")


def found(df):
    return sorted((r["frame_index"], r["part"], r["value"]) for r in df.collect())


def test_nan_is_no_jump(spark):
    rows = tracks.history(boxes(spark, [{"frame": 1, "x": math.nan}, {"frame": 2}]))
    assert found(tracks.position_jump(rows)) == []


def test_jumps_need_the_next_frame_of_a_known_position(spark):
    rows = tracks.history(boxes(spark, [{"frame": 1}, {"frame": 2, "x": None}, {"frame": 3, "x": 100.0}, {"frame": 4, "x": 200.0}]))
    assert found(tracks.position_jump(rows)) == [(4, 0, 100.0)]


def test_angles_go_around(spark):
    rows = tracks.history(boxes(spark, [{"frame": 1, "turn": 3.13}, {"frame": 2, "turn": -3.13}, {"frame": 3, "turn": -1.0}]))
    assert [f for f, _, _ in found(tracks.rotation_jump(rows))] == [3]


def test_labels_are_compared_over_gaps_and_in_a_frame(spark):
    rows = tracks.history(boxes(spark, [{"frame": 1, "label": ""}, {"frame": 4}, {"frame": 4, "label": "bus"}]))
    assert [f for f, _, _ in found(tracks.label_consistency(rows))] == [4, 4]


def test_size_change_by_axis_and_zero_before(spark):
    rows = tracks.history(boxes(spark, [{"frame": 1, "size": (0.0, 1.0, 1.0)}, {"frame": 2, "size": (5.0, 2.0, 1.1)}]))
    assert found(tracks.size_consistency(rows)) == [(2, 1, 1.0)]


def test_broken_track_ignores_gaps_over_empty_frames(spark):
    b = boxes(spark, [{"frame": 1}, {"frame": 3}, {"frame": 5}, {"frame": 10}, *({"frame": f, "track": "o"} for f in (1, 2, 3, 5, 6, 7, 8, 9, 10))])
    out = found(tracks.broken_track(tracks.history(b, expected(spark, 10))).where("track_id = 't'"))
    assert out == [(3, 0, 1.0)]  # frame 4 is empty, and 6 to 9 are too many


def test_broken_track_with_ordinals_that_repeat_by_frame(spark):
    """Frame 2 is empty and frame 5 is not; the object has ordinal 0 throughout."""
    b = boxes(spark, [{"frame": f} for f in (1, 3, 4, 6)] + [{"frame": 5, "track": "o"}]).withColumn("bbox_index", F.lit(0).cast("long"))
    assert found(tracks.broken_track(tracks.history(b, expected(spark, 6))).where("track_id = 't'")) == [(6, 0, 1.0)]


def test_rules_share_one_window(spark):
    """One scan of the boxes, one exchange by object, one sort by its rows."""
    b, e = boxes(spark, [{"frame": 1}]), expected(spark, 2)
    dims = spark.createDataFrame([("car", 0, 1.0, 1.0, 1.0, 0.5)], DIMS)
    names = tuple(r for r in rules.RULES if r not in ("broken_track", "empty_frame"))
    plan = rules.box_rules(b, e, dims, names)._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert plan.count("scale_x") > 0 and len(windows) <= 2 and plan.count("Generate explode") == 2, plan
    assert len({line.split("], [")[-1] for line in windows}) == 1  # same partition and order: one exchange and one sort
    with pytest.warns(UserWarning, match="no_such_rule"):
        assert rules.box_rules(b, e, dims, ("no_such_rule",)).count() == 0


def test_a_reference_of_zero_and_equal_boxes(spark):
    dims = spark.createDataFrame([("car", 0, 0.0, 1.0, 1.0, 0.5)], DIMS)
    b = boxes(spark, [{"frame": 1}]).withColumn("bbox_index", F.lit(0).cast("long"))
    assert found(sizes.dimension_mismatch(b.unionAll(b), dims)) == [(1, 0, math.inf)] * 2


def test_runs_of_frames_merge(spark):
    b = boxes(spark, [{"frame": f, "size": (50.0, 50.0, 50.0)} for f in (4, 5, 6, 9)])
    out = tracks.persistent(sizes.size_outlier(b)).orderBy("first_frame").collect()
    assert [(r["first_frame"], r["last_frame"], r["occurrence_count"]) for r in out] == [(4, 6, 9), (9, 9, 3)]


def test_failed_frames_are_not_empty(spark):
    b, e = boxes(spark, [{"frame": f} for f in (1, 2, 3)]), expected(spark, 5, {4})
    assert [f for f, _, _ in found(frames.empty_frame_readable(b, e))] == [5]
    assert [f for f, _, _ in found(frames.missing_bbox(e))] == [4]
    assert found(frames.empty_frame(b, None)) == []


DIMS = "class_name string, class_order int, ref_length double, ref_width double, ref_height double, tolerance double"


@pytest.mark.parametrize(("label", "size", "hits"), [
    ("one", (3.0, 1.0, 1.0), 0),  # just at the limit
    ("one", (3.01, 1.0, 1.0), 1),
    ("two", (4.0, 1.0, 1.0), 0),  # fits the second variant
    ("two", (9.0, 9.0, 9.0), 1),
    ("none", (9.0, 9.0, 9.0), 0),
    ("other", (9.0, 9.0, 9.0), 0),
    ("tw", (9.0, 9.0, 9.0), 0),  # a beginning without the underscore is another class
])
def test_dimensions(spark, label, size, hits):
    dims = spark.createDataFrame([("one", 0, 2.0, 1.0, 1.0, 0.5), ("two_a", 1, 1.0, 1.0, 1.0, 0.5), ("two_b", 2, 4.0, 1.0, 1.0, 0.5), ("none", 3, None, None, None, 0.5)], DIMS)
    assert sizes.dimension_mismatch(boxes(spark, [{"frame": 1, "label": label, "size": size}]), dims).count() == hits


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("",), (None,), (" 1.5 ",), ("abc",), ("1_0",), ("-2e3",)], "t string")
    assert [r[0] for r in df.select(C.number(F.col("t"))).collect()] == [None, None, 1.5, None, None, -2000.0]


def test_summary_document_is_sorted(spark):
    b, e = boxes(spark, [{"frame": 2, "size": (50.0, 1.0, 1.0)}, {"frame": 1, "size": (50.0, 1.0, 1.0), "track": "a"}]), expected(spark, 3, {3})
    doc = summary.summary_document(tracks.persistent(sizes.size_outlier(b)), b, e).first()["document"]
    assert '"frames_with_issues":[1,2]' in doc and '"tracks_with_issues":["a","t"]' in doc and '"missing_bbox_frames":[3]' in doc


def test_names(spark):
    df = spark.createDataFrame([("..a b/c..",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.safe_name(F.col("t"))).collect()] == ["a_b_c", "unknown", "unknown"]
