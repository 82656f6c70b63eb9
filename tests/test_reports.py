"""Loaders, sinks and what is made of answers, on small inputs made by hand."""

import datetime
import json
import struct

import pytest
from pyspark.sql import functions as F

from lidaraudit.operators import assets, decisions, sizes, summary, tracks, verdicts
from lidaraudit.plans import registry
from lidaraudit.sources import calibration, dictionaries, images, tables
from lidaraudit.streaming import assets as stream

RIG = {"hardware": {"sensors": {
    "camera_labels": ["cam_b"],
    "cameras": {
        "cam_a": {"location": "left", "image_size": [4, 3], "intrinsic": [1, 0, 2, 0, 3, 4, 0, 0, 1], "extrinsic": [float(i == j) for i in range(4) for j in range(4)], "extrinsic_old": [0] * 16, "note": "x"},
        "cam_b": {"location": "front", "distortion_type": 1, "distort": [0.1, 0.2]},
    },
    "lidars": {"top": {"extrinct_matrix": [0] * 12}},
}}}


def test_calibration(spark):
    cameras, lidars = calibration.tables(spark, RIG)
    rows = cameras.orderBy("camera_order").collect()
    assert [(r["camera_id"], r["place"], r["width"], r["fx"], r["cy"]) for r in rows] == [("cam_b", "front", None, None, None), ("cam_a", "left", 4, 1.0, 4.0)]
    assert rows[0]["distortion"] == [0.1, 0.2] and list(rows[1]["extra"]) == ["extrinsic_old"] and len(lidars.first()["extrinsic"]) == 12
    assert calibration.unknown_labels(spark.createDataFrame([("cam_a",), ("cam_z",)], "camera_id string"), cameras).first()["camera_id"] == "cam_z"


@pytest.mark.parametrize(("change", "words"), [
    ({"camera_labels": ["cam_z"]}, "no such entry"), ({"camera_labels": "cam_a"}, "must be a list"), ({"cameras": []}, "mapping"),
    ({"cameras": {"c": {"intrinsic": [1]}}, "camera_labels": []}, "9 values, got 1"), ({"lidars": {"l": {"extrinct_matrix": [1] * 5}}}, "12 or 16"),
    ({"camera_labels": ["cam_a", "cam_a"]}, "unique"), ({"cameras": {1: {}, "1": {}}, "camera_labels": []}, "unique"),
    ({"cameras": {"c": {"extrinsic_old": [1]}}, "camera_labels": []}, "16 values, got 1"), ({"cameras": {"c": 5}, "camera_labels": []}, "mapping"),
])
def test_wrong_calibrations(spark, change, words):
    with pytest.raises(calibration.CalibrationError, match=words):
        calibration.tables(spark, {"hardware": {"sensors": RIG["hardware"]["sensors"] | change}})


def test_text_inside_a_document():
    inside = "hardware:\r  sensors:\r    cameras:\r      c: {}\r"
    blob = b"\x00\x01" + "Some title here".encode("utf-16le") + b"\xff\xfe\x01" + inside.encode("utf-16le") + "\rCalibri\rmore".encode("utf-16le")
    assert calibration.text_of_document(blob) == "hardware:\n  sensors:\n    cameras:\n      c: {}\n"
    for bad in (b"", "hardware: nothing".encode("utf-16le")):
        with pytest.raises(calibration.CalibrationError):
            calibration.text_of_document(bad)


def test_dictionaries(spark):
    dims = dictionaries.dimensions(spark, {"classes": {"a_low": {"id": 1, "reference_size": {"length": 1, "width": 2, "height": 3}, "tolerance": {"length": 0.5, "width": 0.5, "height": 0.5}}, "b": {"reference_size": None}}})
    assert [(r["class_name"], r["class_order"], r["ref_height"], r["tolerance"]) for r in dims.orderBy("class_order").collect()] == [("a_low", 0, 3.0, 0.5), ("b", 1, None, None)]
    cats = dictionaries.categories(spark, {"categories": [{"name": "b"}, {"name": "a", "description": "big", "dimension_keys": ["a_low", " "]}]})
    assert dictionaries.bullet_list(cats).first()["text"] == "- b\n- a: big" and [r["dimension_keys"] for r in cats.orderBy("category_order").collect()] == [["b"], ["a_low"]]
    for bad in ([], [{"name": " "}], [{"name": "a"}, {"name": "a"}], ["a"]):
        with pytest.raises(ValueError):
            dictionaries.categories(spark, {"categories": bad})


def test_pictures_and_clouds(spark, tmp_path):
    folder = tmp_path / "scene_5" / "frame_0002"
    folder.mkdir(parents=True)
    (folder / "cam_a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x00\x00\x00\x00")
    (folder / "cam_b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 300, 200) + b"\x01\x01\x11\x00")
    (folder / "cam_c.jpg").write_bytes(b"oops")
    (folder / "x.pcd").write_bytes(b"#")
    got = sorted(tuple(r[c] for c in ("scene_id", "frame_index", "asset_name", "width", "height")) for r in images.images(spark, str(tmp_path)).collect())
    assert got == [("5", 2, "cam_a", 640, 480), ("5", 2, "cam_b", 200, 300), ("5", 2, "cam_c", None, None)]
    (folder / "cam_d.jpg").write_bytes(b"\xff\xd8" + (b"\xff\xe1\xff\xff" + bytes(65533)) * 5 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 20) + b"\x01\x01\x11\x00")
    for head in (10, images.HEAD):  # the size stands behind what is looked at first
        again = {r["asset_name"]: (r["width"], r["height"]) for r in images.images(spark, str(tmp_path), head).collect()}
        assert again == {"cam_a": (640, 480), "cam_b": (200, 300), "cam_c": (None, None), "cam_d": (20, 30)}
    frames = spark.createDataFrame([("5", 1), ("5", 2)], "scene_id string, frame_index int")
    assert [r["frame_index"] for r in images.frames_with_cloud(spark, frames, str(tmp_path)).collect()] == [2]


def test_boxes_round_trip(spark, tmp_path):
    one = {c: "" for c in tables.BOXES} | {"scene_id": "s", "frame_index": "3", "bbox_index": "1", "uuid": "u9", "label": 'a,"b"', "scale_x": "1.5", "visible": "True", "point_count": "12", "is_hide": "maybe"}
    tables.write_boxes(spark.createDataFrame([one]).select(*tables.BOXES), str(tmp_path / "b"))
    r = tables.read_boxes(spark, str(tmp_path / "b")).first()
    assert (r["frame_index"], r["uuid"], r["label"], r["scale_x"], r["visible"], r["point_count"], r["is_hide"]) == (3, "u9", 'a,"b"', 1.5, True, 12, None)
    assert (r["resolved_target_field"], r["resolved_target_key"]) == ("uuid", "u9")


def test_capture_report(spark, tmp_path):
    frames = spark.createDataFrame([("s", 2, "x.png", 1)], "scene_id string, frame_index int, screenshot_path string, pcd_count int")
    tables.write_captures(frames, str(tmp_path / "c"))
    r = tables.read_captures(spark, str(tmp_path / "c")).first()
    assert r["frame_index"] == 2 and r["ai_status"] == "pending" and (r["pcd_count"], r["jpg_count"]) == (1, 0) and tuple(r.asDict()) == tables.CAPTURES


def test_report_is_ordered(spark, tmp_path):
    found = spark.createDataFrame([("s", 10, "a", "R"), ("s", 2, "b", "R"), ("s", 2, "a", "Z"), ("s", 2, "a", "R")], "scene_id string, frame_index int, track_id string, rule_id string").repartition(3)
    tables.write_report(found, str(tmp_path / "r"))
    lines = [x for p in sorted((tmp_path / "r").glob("*.csv")) for x in p.read_text().splitlines()[1:]]
    assert [x.split(",")[1] for x in lines] == ["2", "2", "2", "10"] and [x.split(",")[8] for x in lines] == ["R", "Z", "R", "R"]


def test_texts_and_documents(spark, tmp_path):
    boxes = spark.createDataFrame([("t", "", 1.0), ("", "u", None)], "track_id string, uuid string, scale_x double").selectExpr("*", "'' AS target_id", "'' AS object_id", "0L AS bbox_index")
    text = tables.mapping_report(summary.fill_rates(boxes, ["track_id", "scale_x", "object_id"]), summary.key_usage(boxes)).first()["text"]
    assert text == "Filled fields\nobject_id: 0 / 2\nscale_x: 1 / 2\ntrack_id: 1 / 2\nAlways empty: object_id\nObjects are named by\ntrack_id: 1\nuuid: 1\nMostly by: uuid"
    files = spark.createDataFrame([("s", 1, "u1", "pcd", True, None), ("s", 1, "u0", "jpg", False, "404")], "scene_id string, frame_index int, url string, kind string, ok boolean, error string")
    doc = json.loads(tables.download_metadata(files).first()["metadata"])
    assert (doc["ok"], doc["failed"], [f["url"] for f in doc["files"]]) == (1, 1, ["u0", "u1"])
    view = spark.createDataFrame([("s", 1, "c", [("cam", 1)], ("verified", 0.95))], "scene_id string, frame_index int, candidate_id string, views array<struct<camera:string,x1:int>>, vision struct<status:string,confidence:double>")
    tables.write_manifest(view, str(tmp_path / "m"))
    assert json.loads(next((tmp_path / "m" / "scene_id=s" / "frame_index=1").glob("*.txt")).read_text())["vision"] == {"status": "verified", "confidence": 0.95}


def test_all_clouds_of_a_stamp_are_kept(spark):
    t = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("s", t + datetime.timedelta(seconds=i), u) for i, u in enumerate(["http://h/lidar/5.25.pcd", "http://h/camera/A/5.25.jpg", "http://h/lidar/5.25.pcd?again"])], "scene_id string, arrival_ts timestamp, url string")
    a = assets.classified(events)
    r = assets.slots(a, assets.groups(a)).first()
    assert r["pcd_url"] == "http://h/lidar/5.25.pcd;http://h/lidar/5.25.pcd?again" and (r["pcd_count"], r["jpg_count"], r["status"]) == (2, 1, "warning")


def test_a_stream_group_isnt_cut_at_the_hour(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 59, 59)
    rows = [("s", t, "http://h/lidar/5.25.pcd")] + [("s", t + datetime.timedelta(seconds=1), f"http://h/camera/C{i}/5.25.jpg") for i in range(5)]
    rows += [("s", t + datetime.timedelta(days=2), "http://h/camera/C0/9.25.jpg"), ("s", t + datetime.timedelta(days=9), "http://h/lidar/99.25.pcd")]
    for i, own in enumerate((rows[:3], rows[3:7], rows[7:])):
        spark.createDataFrame(own, "scene_id string, arrival_ts timestamp, url string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    feed = spark.readStream.schema("scene_id string, arrival_ts timestamp, url string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.grouped(stream.arrivals(feed, "1 hour")).writeStream.outputMode("append").format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["group_key"], r["pcd_count"], r["jpg_count"], r["status"]) for r in spark.table("cut").collect()) == [("5.25", 1, 5, "ok"), ("9.25", 0, 1, "unclaimed")]


def test_round_robin_over_overlapping_groups(spark):
    """Against the loop itself, for several limits."""
    rows = [("s", i // 3, f"c{i:02}", i % 2 == 0, i % 3 == 0, i < 4) for i in range(30)] + [("t", 1, "only", True, False, False)]
    df = spark.createDataFrame(rows, "scene_id string, frame_index int, candidate_id string, a boolean, b boolean, c boolean")
    groups = {k: F.col(k) for k in "abc"} | {"other": F.lit(True)}
    for limit in (0, 1, 7, 25, 60):
        got = {r["candidate_id"]: (r["group_no"], r["turn"]) for r in decisions.diverse_sample(df, groups, limit).where("scene_id = 's'").collect()}
        if limit in (0, 60):
            assert got == {r[2]: (None, i + 1) for i, r in enumerate(rows[:30])}
            continue
        own = [[r[2] for r in rows[:30] if test(r)] for test in (lambda r: r[3], lambda r: r[4], lambda r: r[5], lambda r: True)]
        at, want = [0] * 4, {}
        while len(want) < limit:
            for g in range(4):
                while at[g] < len(own[g]) and own[g][at[g]] in want:
                    at[g] += 1
                if at[g] < len(own[g]) and len(want) < limit:
                    want[own[g][at[g]]] = (g, len(want) + 1)
        assert got == want
    assert decisions.diverse_sample(df, groups, 5).where("scene_id = 't'").count() == 1


def test_keys_cover_pictures_and_settings(spark):
    req = spark.createDataFrame([("s", 1, "c", "m"), ("s", 1, "d", "m")], "scene_id string, frame_index int, candidate_id string, metadata string")
    pics = lambda x: spark.createDataFrame([("s", 1, "c", "b.png", bytearray(b"2")), ("s", 1, "c", "a.png", bytearray(x))], "scene_id string, frame_index int, candidate_id string, name string, content binary")
    key = lambda x, **s: {r["candidate_id"]: r["key"] for r in decisions.request_keys(req, pics(x), **s).collect()}
    base = key(b"1", model="m1", prompt="p")
    assert base == key(b"1", prompt="p", model="m1") and len({base["c"], base["d"], key(b"9", model="m1", prompt="p")["c"], key(b"1", model="m2", prompt="p")["c"]}) == 4
    shown = spark.createDataFrame([({"a": 1, "_b": 2},)], "m map<string,int>").select(decisions.public_metadata(F.col("m"))).first()[0]
    assert shown == {"a": 1}


def test_missing_findings_have_their_frames(spark):
    rows = spark.createDataFrame([("s", 4, "c1", "car", 0.95, "seen", 1.0, 2.0, 3.0, "accepted", [2, 4, 9]), ("s", 5, "c2", "car", 0.95, "seen", 1.0, 2.0, 3.0, "background", [5])], "scene_id string, frame_index int, candidate_id string, possible_category string, confidence double, reason string, size_x double, size_y double, size_z double, outcome string, frames array<int>")
    (r,) = verdicts.missing_findings(rows).collect()
    assert (r["track_id"], r["first_frame"], r["last_frame"], r["occurrence_count"], r["ai_confidence"]) == ("vision_cluster_4_c1", 2, 9, 3, "0.9500")
    with pytest.raises(ValueError):
        verdicts.wrong_findings(rows, "majority")


def test_answers_are_parsed_once_for_each_use(spark, small):
    """Filters on parsed fields stay above the parsing: one parse of each kind of answer for the two branches of the findings."""
    plan = registry.queries()["vision_findings"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") + plan.count("parseJson") <= 2 and len(plan) < 60_000


def test_objects_without_a_track_stay_apart(spark):
    """Two boxes with an empty track in different frames are no object of two votes; one without any track is kept."""
    rows = [("s", 1, "a", ""), ("s", 5, "b", ""), ("s", 1, "c", None), ("s", 1, "d", "t"), ("s", 2, "e", "t")]
    votes = spark.createDataFrame([(*r, "VisionLabelMismatch", "view", "label_mismatch_vote", 0.95) for r in rows], "scene_id string, frame_index int, candidate_id string, track_id string, vote_rule string, vote_category string, vote_reason string, confidence double")
    told = lambda n: sorted((r["object_key"], r["n"], r["observations"]) for r in decisions.consensus(votes, n, 0.5).collect())
    assert told(2) == [("t", 2, 2)] and told(1) == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("t", 2, 2)]
    counted = verdicts.wrong_counters(votes, "track_consensus", 2, 0.5).first()
    assert (counted["wrong_report_findings"], counted["wrong_consensus_rejected"]) == (1, 3)


def test_each_side_has_its_tolerance(spark):
    dims = dictionaries.dimensions(spark, {"classes": {"car": {"reference_size": {"length": 4, "width": 2, "height": 1.5}, "tolerance": {"length": 0.5, "width": 0.5, "height": 0.4}}, "van": {"reference_size": {"length": 4, "width": 2, "height": 1.5}, "tolerance": {"length": 0.5, "width": 0.5}}}})
    boxes = spark.createDataFrame([(i, "car" if i < 9 else "van", *map(float, s)) for i, s in enumerate([(40, 20, 15), (4, 2, 2.05), (4, 2, 2.2), (6, 3, 0.9), (2, 1, 2.0)])], "bbox_index long, label string, scale_x double, scale_y double, scale_z double")
    boxes = boxes.selectExpr("'s' as scene_id", "1 as frame_index", "'t' as track_id", "'' as target_id", "'' as uuid", "'' as object_id", "'' as className", "*")
    assert sorted(r["bbox_index"] for r in sizes.dimension_mismatch(boxes, dims).collect()) == ["0", "2"]
    assert sizes.dimension_mismatch(boxes.withColumn("label", F.lit("van")), dims).count() == 0  # no tolerance of its height


def test_stored_keys(spark, tmp_path):
    boxes = spark.createDataFrame([(1, "K", "t1"), (2, "", "t2"), (3, None, "")], "bbox_index long, resolved_target_key string, track_id string").selectExpr("'s' as scene_id", "1 as frame_index", "'' as target_id", "'' as uuid", "'' as object_id", "'' as className", "'' as label", "*")
    assert [r["target_key"] for r in tracks.keyed(boxes).orderBy("bbox_index").collect()] == ["K", "bbox_index:2", "bbox_index:3"]
    assert [r["target_key"] for r in tracks.keyed(boxes.drop("resolved_target_key")).orderBy("bbox_index").collect()] == ["t1", "t2", "3"]
    tables.write_boxes(boxes, str(tmp_path / "b"))
    again = tables.read_boxes(spark, str(tmp_path / "b")).orderBy("bbox_index").collect()
    assert [(r["resolved_target_field"], r["resolved_target_key"]) for r in again] == [("", "K"), ("track_id", "t2"), ("bbox_index", "3")]


def test_rules_of_a_summary_are_ordered_by_count(spark):
    found = spark.createDataFrame([("s", 1, "t", r, "Warning") for r in ("A", "C", "C", "B")], "scene_id string, frame_index int, track_id string, rule_id string, severity string")
    boxes = spark.createDataFrame([("s", 1)], "scene_id string, bbox_index long")
    expected = spark.createDataFrame([("s", 1, True)], "scene_id string, frame_index int, read_ok boolean")
    assert '"warnings_by_rule":{"C":2,"A":1,"B":1}' in summary.summary_document(found, boxes, expected).first()["document"]
