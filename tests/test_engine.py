"""Both stages of a case, from tables to scores, by hand-made cases."""

import json
import os

from pyspark.sql import functions as F

from trackloom.engine import IDENTITY_STAGES, TRACK_STAGES, Engine
from trackloom.operators import matching
from trackloom.operators.association import Rules
from trackloom.operators.tracks import Limits
from trackloom.sources import runs

DETECTION = "det_id long, camera string, frame int, track_id int, track_key string, x1 double, y1 double, x2 double, y2 double, conf double, area double, crop_path string"
TRUTH = "gt_ord long, camera string, source_frame int, gt_id int, x1 double, y1 double, x2 double, y2 double"
SPANS = [("camera_1", 1, 1, range(0, 5), 0), ("camera_1", 2, 1, range(8, 12), 0), ("camera_1", 3, 2, range(0, 12), 200), ("camera_2", 1, 1, range(3, 9), 0), ("camera_2", 9, 3, range(0, 1), 400)]


def case(spark):
    rows, truth = [], []
    for camera, track, person, frames, at in SPANS:
        for frame in frames:
            n = len(rows)
            rows.append((n, camera, frame, track, f"{camera}_T{track}", at + 0.0, 0.0, at + 40.0, 90.0, 0.9, 3600.0, f"crop_{n}"))
            if person != 3:
                truth.append((n, camera, frame, person, at + 1.0, 0.0, at + 41.0, 90.0))
    det = matching.to_source_frames(spark.createDataFrame(rows, DETECTION), 0)
    angles = {"camera_1_T1": [1.0, 0.0], "camera_1_T2": [0.99, 0.1], "camera_1_T3": [0.0, 1.0], "camera_2_T1": [0.98, -0.1], "camera_2_T9": [-1.0, 0.0]}
    return det, spark.createDataFrame(truth, TRUTH), spark.createDataFrame(list(angles.items()), "track_key string, vector array<double>")


def test_two_people_are_found_in_two_cameras(spark, tmp_path):
    det, truth, vectors = case(spark)
    engine = Engine(spark, str(tmp_path), "case", Limits(min_frames=3), Rules())
    engine.track(det, truth)
    engine.associate(vectors)
    for stage in TRACK_STAGES + IDENTITY_STAGES:
        assert engine.table(stage).count() >= 0
    ids = {r.track_key: r.global_id for r in engine.table("identities").collect()}
    assert ids["camera_1_T1"] == ids["camera_1_T2"] == ids["camera_2_T1"] != ids["camera_1_T3"] and len(ids) == 4
    assert engine.table("reid_score").first().reid_score == 1
    assert abs(engine.table("final_score").first().final_pipeline_score - 1) < 0.2
    shown = engine.labelled(det)
    assert shown.count() == det.count()


def test_a_run_is_known_by_its_parameters(spark, tmp_path):
    limits = spark.createDataFrame([("camera_1", 6)], "camera string, min_frames int")
    plain, other = Engine(spark, str(tmp_path), "case"), Engine(spark, str(tmp_path), "case", profiles=limits)
    assert plain.run_id != other.run_id
    det, truth, _ = case(spark)
    other.track(det, truth)
    kept = other.table("judged").where("is_valid").select("track_key")
    assert {r[0] for r in kept.collect()} == {"camera_1_T3", "camera_2_T1", "camera_2_T9"}


def stored(spark, path, *tables):
    """The tables written to files and read again."""
    for k, t in enumerate(tables):
        t.coalesce(1).write.mode("overwrite").parquet(f"{path}/{k}")
    return [spark.read.parquet(f"{path}/{k}") for k in range(len(tables))]


def made(engine):
    return {x["stage"] for x in engine.graph.log if not x["reused"]}


def test_stages_are_made_anew_when_what_they_are_made_of_changes(spark, tmp_path):
    root, given = str(tmp_path / "runs"), str(tmp_path / "in")
    det, truth, vectors = stored(spark, given, *case(spark))
    first = Engine(spark, root, "case", Limits(min_frames=3))
    first.track(det, truth)
    first.associate(vectors)
    assert made(first) == set(TRACK_STAGES + IDENTITY_STAGES)

    again = Engine(spark, root, "case", Limits(min_frames=3))
    again.track(*[spark.read.parquet(f"{given}/{k}") for k in (0, 1)])
    again.associate(spark.read.parquet(f"{given}/2"))
    assert made(again) == set()

    rules = Engine(spark, root, "case", Limits(min_frames=3), Rules(cross_threshold=0.99))
    rules.track(det, truth)
    rules.associate(vectors)
    assert made(rules) == set(IDENTITY_STAGES) - {"vectors"}

    limits = Engine(spark, root, "case", Limits(min_frames=1))
    limits.track(det, truth)
    assert made(limits) == set(TRACK_STAGES) - {"summary"}

    det.where("frame < 11").coalesce(1).write.mode("overwrite").parquet(f"{given}/3")
    other = Engine(spark, root, "case", Limits(min_frames=3))
    other.track(spark.read.parquet(f"{given}/3"), truth)
    other.associate(vectors)
    assert made(other) == set(TRACK_STAGES + IDENTITY_STAGES)
    assert first.table("summary").agg(F.max("last_frame")).first()[0] == 11 and other.table("summary").agg(F.max("last_frame")).first()[0] == 10


def test_runs_are_logged_exported_and_removed(spark, tmp_path):
    root, out = str(tmp_path / "runs"), str(tmp_path / "out")
    det, truth, vectors = case(spark)
    crops = det.join(vectors, "track_key").select(*det.columns, "vector")
    for k, limits in enumerate((Limits(), Limits(min_frames=3), Limits(min_frames=4))):
        engine = Engine(spark, root, "case", limits)
        engine.track(det, truth)
        engine.save(f"2024010{k}_000000")
    engine.associate(crops)
    engine.save("20240102_000000")
    engine.export(out, "run0")
    row = engine.table("vectors").where("track_key = 'camera_1_T3'").first()
    assert row.num_crops == 12 and row.representative_crop == "crop_9"
    assert json.loads((tmp_path / "runs/runs/case=case/run=20240102_000000/config_used.json").read_text())["limits"]["min_frames"] == 4
    log = json.loads((tmp_path / "runs/runs/case=case/run=20240102_000000/stage_log.json").read_text())
    assert [x["stage"] for x in log] == TRACK_STAGES + IDENTITY_STAGES
    lines = [line for f in sorted((tmp_path / "out/judged/run_id=run0").glob("*.csv")) for line in f.read_text().splitlines()[1:]]
    assert [line.split(",")[:2] for line in lines] == [["camera_1", "1"], ["camera_1", "2"], ["camera_1", "3"], ["camera_2", "1"], ["camera_2", "9"]]
    assert sorted(r.run for r in runs.list_runs(spark, root).collect()) == [f"2024010{k}_000000" for k in range(3)]
    for k in range(3):  # the order of runs is that of their last change
        os.utime(tmp_path / f"runs/runs/case=case/run=2024010{k}_000000", (k, k))
    assert runs.delete_expired(spark, root, 1) == 2
    assert [r.run for r in runs.list_runs(spark, root).collect()] == ["20240102_000000"]
    assert engine.table("final_score").count() == 1 and len(list((tmp_path / "runs/stage=judged").glob("key=*"))) == 1
    assert runs.delete_expired(spark, root, 1) == 0


def test_rows_come_back_in_the_order_written(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7919 % 1000, f"s{k}") for k in range(1000)], "n int, s string")
    for run in ("a", "b", "a"):
        runs.write_ordered(rows, str(tmp_path), ["-n"], run, files=7)
    assert len(list((tmp_path / "run_id=a").glob("*.parquet"))) == 7
    for run in ("a", "b"):
        got = runs.read_ordered(spark, str(tmp_path), run).collect()
        assert sorted((r.place, r.n) for r in got) == [(k + 1, 999 - k) for k in range(1000)]


def test_empty_tables_give_typed_results(spark, tmp_path):
    det, truth, vectors = case(spark)
    none = F.lit(False)
    engine = Engine(spark, str(tmp_path), "empty")
    engine.track(det.where(none), truth.where(none))
    engine.associate(vectors.where(none))
    assert engine.table("identities").count() == 0
    assert "merge_reason" in engine.table("pairs").columns
