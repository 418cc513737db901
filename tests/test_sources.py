import json

from trackloom.functions import geometry
from trackloom.sources import ground_truth


def test_annotations(spark, tmp_path):
    boxes = {
        "1": [{"id": 3, "BboxP": [0, 0, 10, 20]}, {"id": -1, "BboxP": [0, 0, 1, 1]}, {"id": "x", "bbox": [0, 0, 1, 1]}],
        "2": [{"gt_id": 4, "box": {"x": 1, "y": 2, "w": 3, "h": 4}}, {"track_id": 0, "bbox": {"left": 1, "top": 2, "right": 9, "bottom": 8}}],
        "9": [{"id": 5, "BboxP": [5, 5, 5, 9]}],
        "info": [{"id": 6, "BboxP": [0, 0, 2, 2]}],
    }
    (tmp_path / "camera_7_day.json").write_text(json.dumps(boxes))
    got = sorted(map(tuple, ground_truth.read(spark, str(tmp_path)).collect()))
    assert got == [("camera_7", 1, 3, 0.0, 0.0, 10.0, 20.0, 200.0), ("camera_7", 2, 0, 1.0, 2.0, 9.0, 8.0, 48.0), ("camera_7", 2, 4, 1.0, 2.0, 4.0, 6.0, 12.0)]
    assert ground_truth.read(spark, str(tmp_path), 2, 3, annotation_start=0).count() == 3


def test_sql_functions(spark):
    geometry.register(spark)
    row = spark.sql("SELECT round(iou(0, 0, 10, 10, 5, 0, 15, 10), 6) AS a, iou(0, 0, 0, 0, 0, 0, 0, 0) AS b, temporal_gap(1, 10, 11, 20) AS c, temporal_overlap(1, 10, 10, 20) AS d").first()
    assert tuple(row) == (0.333333, 0.0, 0, 1)


def test_annotations_of_other_shapes(spark):
    from trackloom.sources.ground_truth import parse_any

    texts = [
        ("camera_1", '{"7": [{"id": 1, "BboxP": [0, 0, 2, 2]}, {"id": 1, "BboxP": [0, 0, 2, 2]}]}'),
        ("camera_2", '{"frames": [{"frame_id": 3, "objects": [{"person_id": 4, "rect": {"x": 1, "y": 1, "w": 2, "h": 3}}]}]}'),
        ("camera_3", '{"seen": {"5": {"people": [{"identity": "6", "bbox": [0, 0, 1, 1]}, {"identity": -1, "bbox": [0, 0, 1, 1]}]}}}'),
        ("camera_4", "no JSON"),
        ("camera_5", None),
    ]
    rows = parse_any(spark.createDataFrame(texts, "camera string, value string")).orderBy("camera").collect()
    assert [tuple(r) for r in rows] == [
        ("camera_1", 7, 1, 0.0, 0.0, 2.0, 2.0, 4.0),
        ("camera_2", 3, 4, 1.0, 1.0, 3.0, 4.0, 6.0),
        ("camera_3", 5, 6, 0.0, 0.0, 1.0, 1.0, 1.0),
    ]


def test_malformed_annotations_lose_their_own_rows_only(spark):
    from trackloom.sources.ground_truth import parse, parse_any, parse_nested

    text = json.dumps(
        {
            "12.0": [{"id": 1, "person_id": 77, "BboxP": [0, 0, 2, 2]}, {"id": 2, "BboxP": ["abc", 0, 2, 2]}, {"id": 3, "BboxP": [1, 2]}, "text", None, 5],
            "meta": {"frame": 9, "id": 4, "bbox": [0, 0, 3, 3]},
            "13": {"id": 5, "BboxP": [0, 0, 1, 1]},
            "14": "none",
            "x": [{"id": 6, "BboxP": [0, 0, 1, 1]}],
            "15": [{"id": "nan", "BboxP": [0, 0, 1, 1]}, {"id": "7.9", "BboxP": ["0", "0", "1.5", "1"]}],
        }
    )
    files = spark.createDataFrame([("camera_1", text)], "camera string, value string")
    want = [("camera_1", 12, 1, 0.0, 0.0, 2.0, 2.0, 4.0), ("camera_1", 15, 7, 0.0, 0.0, 1.5, 1.0, 1.5)]
    assert sorted(map(tuple, parse(files).collect())) == sorted(map(tuple, parse_any(files).collect())) == want
    wrong = spark.createDataFrame([("camera_2", '{"a": {"frame": "x", "id": 1, "box": [0, 0, 1, 1]}, "b": {"frame": 1, "id": 1, "box": {"x": "q", "y": 0, "w": 1, "h": 1}}}')], "camera string, value string")
    assert parse_nested(wrong).count() == 0


def test_lists_by_size(spark):
    from trackloom.sources.ground_truth import parse_nested

    files = spark.createDataFrame([("camera_1", '{"frames": [{"frame": 3, "id": 4, "bbox": [1, 1, 2, 3]}]}')], "camera string, value string")
    assert [tuple(r) for r in parse_nested(files, "xywh").collect()] == [("camera_1", 3, 4, 1.0, 1.0, 3.0, 4.0, 6.0)]


def test_catalog_and_cosine(spark):
    import pytest

    from trackloom.sources import catalog

    assert catalog.case(spark, "case_6_multicamera_temporal_handoff")["cameras"] == ["camera_6", "camera_5"]
    assert catalog.cameras(spark).count() == 10
    with pytest.raises(KeyError):
        catalog.case(spark, "case_7")
    geometry.register(spark)
    assert round(spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c").first().c, 6) == 0.707107


def test_tracks_close_over_a_stream(spark, tmp_path):
    import datetime

    from trackloom.streaming.tracks import closed_tracks

    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(seconds=s), "camera_1", k, 0.5, 10.0) for k, times in (("a", (0, 10, 100)), ("b", (5,)), ("z", (900,))) for s in times]
    schema = "ts timestamp, camera string, track_key string, conf double, area double"
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={n}"))
    stream = closed_tracks(spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.track_key, r.num_rows) for r in spark.table("closed").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_the_load_counts_what_it_keeps(spark, tmp_path):
    """Case 6: 176 and 252 boxes, all within its frames, of 140 and 180 frames; two more lie outside."""
    from trackloom.sources import catalog

    case = catalog.case(spark, "case_6_multicamera_temporal_handoff")
    for camera, rows, first in (("camera_5", 176, 501), ("camera_6", 252, 369)):
        frames: dict = {}
        for k in range(rows):
            frames.setdefault(str(first + k * 274 // rows), []).append({"id": 10 + k, "BboxP": [k, 0, k + 5, 9]})
        frames["2000"] = [{"id": 14, "BboxP": [0, 0, 1, 1]}]
        (tmp_path / f"{camera}_2023-12-01.json").write_text(json.dumps(frames))
    (tmp_path / "camera_50_2023.json").write_text(json.dumps({"600": [{"id": 1, "BboxP": [0, 0, 1, 1]}]}))
    load = ground_truth.load_case(ground_truth.read(spark, str(tmp_path)), case)
    assert load.rows.count() == 428
    six, five = load.counters()
    assert (six["camera"], six["rows_before"], six["rows_after"], six["first_after"], six["last_before"], six["error"]) == ("camera_6", 253, 252, 369, 2000, None)
    assert (five["camera"], five["rows_before"], five["rows_after"], five["first_after"], five["error"]) == ("camera_5", 177, 176, 501, None)
    other = ground_truth.load_case(ground_truth.read(spark, str(tmp_path)), case | {"cameras": ["camera_50", "camera_7"], "source_frame_start": 1, "source_frame_end": 2})
    assert other.rows.count() == 0
    assert [r["error"] for r in other.counters()] == ["nothing within the frames", "no annotation"]


def test_a_wrong_schema_is_no_missing_file(spark, tmp_path):
    import pytest
    from pyspark.errors import ParseException

    from trackloom.sources.stages import read_csv

    assert read_csv(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ParseException):
        read_csv(spark, str(tmp_path / "none"), "a no_such_type")
