"""Tracks closed by frames over a stream, against the batch summary."""

import random

import pytest

from trackloom.operators.tracks import summarize
from trackloom.streaming.tracks import closed_tracks_by_frame, late_rows

SCHEMA = "det_id long, video long, camera string, track_id int, frame int, conf double, area double, crop_path string, part int"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def close(spark, tmp_path, parts, buffer, late):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA.removesuffix(", part int")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed = closed_tracks_by_frame(stream, buffer, late)
    query = closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out")), late_rows(query)


def test_shuffled_files_give_the_batch_summary(spark, rocks, tmp_path):
    rng, rows = random.Random(5), []
    for video in range(2):
        for camera in "ab":
            for track in range(4):
                for frame in sorted(rng.sample(range(60), 25)):
                    rows.append((len(rows), video, f"camera_{camera}", track, frame, round(rng.random(), 6), float(rng.randrange(9)), rng.choice(["", f"crop_{len(rows)}"])))
    # all of a video before the next one, in no order inside it
    parts = []
    for video in range(2):
        own = [r for r in rows if r[1] == video]
        rng.shuffle(own)
        parts += [own[:120], own[120:]]
    parts.append([(9999, 9, "camera_z", 0, 0, 0.5, 1.0, "")])
    got, dropped = close(spark, tmp_path, parts, buffer=100, late=200)
    batch = spark.createDataFrame(rows, SCHEMA.removesuffix(", part int"))
    names = "camera video track_id num_frames num_crops avg_conf avg_area first_frame last_frame representative_crop".split()
    want = []
    for video in range(2):
        one = batch.where(f"video = {video}").selectExpr("*", "concat(camera, '_T', track_id) AS track_key")
        want += [(r.camera, video, r.track_id, r.num_frames, r.num_crops, pytest.approx(r.avg_conf), pytest.approx(r.avg_area), r.first_frame, r.last_frame, r.representative_crop) for r in summarize(one).collect()]
    assert dropped == 0
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want, key=lambda w: w[:5])


def test_gaps_close_tracks_and_late_rows_are_counted(spark, rocks, tmp_path):
    row = lambda k, frame, video=0, track=1: (k, video, "camera_1", track, frame, 0.5, 10.0 + k, f"c{k}")
    parts = [[row(0, 0), row(1, 30), row(2, 3)], [row(3, 27), row(4, 60)], [row(5, 5), row(6, 61)], [row(7, 0, video=1)]]
    got, dropped = close(spark, tmp_path, parts, buffer=10, late=20)
    found = sorted((r.video, r.first_frame, r.last_frame, r.num_frames, r.representative_crop) for r in got.collect())
    assert found == [(0, 0, 3, 2, "c2"), (0, 27, 30, 2, "c3"), (0, 60, 61, 2, "c6")] and dropped == 1
