"""The catalog of cases: their cameras, the frames that ground truth covers and the identities expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Case, title, cameras, kind of scene, true identities, first and last source frame.
CASES = (
    ("case_1_normal_success", "Case 1 - Single-Camera Normal Success", "camera_2", "single_camera_normal", 3, 1, 800),
    ("case_2_crowded_fragmentation", "Case 2 - Crowded / False Positive Sensitive", "camera_3", "single_camera_false_positive_sensitive", 9, 1201, 2000),
    ("case_3_failure_limitation", "Case 3 - Small/Distant Person Limitation", "camera_1", "single_camera_small_or_distant", 6, 801, 1600),
    ("case_4_multicamera_success", "Case 4 - Multi-Camera Same-Time Re-ID", "camera_1 camera_3", "multi_camera_same_time", 3, 1201, 2000),
    ("case_5_multicamera_3_video_stress", "Case 5 - Multi-Camera 3-Video Stress Test", "camera_1 camera_2 camera_3", "multi_camera_crowded_or_stress", 9, 1201, 2000),
    ("case_6_multicamera_temporal_handoff", "Case 6 - Multi-Camera Temporal Handoff", "camera_6 camera_5", "multi_camera_long_term_or_handoff", 3, 184, 1023),
)
_SCHEMA = "case_id string, title string, cameras array<string>, scene_type string, gt_identity int, source_frame_start int, source_frame_end int"


def catalog(spark: SparkSession) -> DataFrame:
    """One row for each case. Local frames begin at 0, annotations at 1; boxes are corners; matches need 0.5."""
    rows = spark.createDataFrame([(*c[:2], c[2].split(), *c[3:]) for c in CASES], _SCHEMA)
    return rows.select("*", F.lit(0).alias("local_frame_start"), F.lit(1).alias("annotation_frame_start"), F.lit("xyxy").alias("bbox_format"), F.lit(0.5).alias("gt_iou_threshold"))


def case(spark: SparkSession, case_id: str) -> dict:
    """The catalog's row of one case."""
    if case_id not in {c[0] for c in CASES}:
        raise KeyError(case_id)
    return catalog(spark).where(F.col("case_id") == case_id).first().asDict()


def cameras(spark: SparkSession) -> DataFrame:
    """A row for each case and camera."""
    return catalog(spark).select("case_id", F.explode("cameras").alias("camera"), "source_frame_start", "source_frame_end")


def camera_names() -> list[str]:
    """All cameras that cases have, in order."""
    return sorted({name for c in CASES for name in c[2].split()})


def union_cameras(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows of each camera named, one after the other; a camera without rows adds none."""
    parts = [rows.where(F.col("camera") == name) for name in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, rows.limit(0))


def contents(spark: SparkSession, detections: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """The catalog with the number of detections, tracks, true boxes and true identities in each case's cameras and frames."""
    places = F.broadcast(cameras(spark))  # a row for each case and camera
    inside = F.col("source_frame").between(F.col("source_frame_start"), F.col("source_frame_end"))
    seen = detections.join(places, "camera").where(inside).groupBy("case_id").agg(F.count(F.lit(1)).alias("num_detections"), F.countDistinct("track_key").alias("num_tracks"))
    true = ground_truth.join(places, "camera").where(inside).groupBy("case_id").agg(F.count(F.lit(1)).alias("num_boxes"), F.countDistinct("gt_id").alias("num_gt_ids"))
    return catalog(spark).join(seen, "case_id", "left").join(true, "case_id", "left").na.fill(0, ["num_detections", "num_tracks", "num_boxes", "num_gt_ids"])
