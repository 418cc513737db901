"""Overview tables of a case: tracks, cameras, ground truth, scores and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.association import numbered

#: The order in which each table is shown and exported (-: the largest first).
ORDERS = {
    "summary": ["camera", "track_id"],
    "coverage": ["camera", "gt_id"],
    "identities": ["global_id", "camera", "track_key"],
    "merged": ["global_id", "-cosine_similarity", "track_a", "track_b"],
}
JUDGED = ["track_key", "camera", "track_id", "num_frames", "num_crops", "avg_conf", "avg_area"]


def _with_truth(judged: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("track_key", "dominant_gt_id", F.col("track_gt_purity").alias("track_purity"))
    return judged.join(known, "track_key", "left")


def in_order(rows: DataFrame, table: str) -> DataFrame:
    """Adds ``place``: 1, 2, ... in the table's order, by which its readers and sinks may sort."""
    return numbered(rows, [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in ORDERS[table]], "place")


def track_overview(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Every track, kept or not, with its dominant identity (null: never matched against truth)."""
    return _with_truth(judged, truth).select(*JUDGED, "is_valid", "status", "dominant_gt_id", "track_purity")


def local_gallery(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Valid tracks that have a crop to show."""
    shown = judged.where("is_valid AND coalesce(representative_crop, '') <> ''").withColumnRenamed("representative_crop", "image_path")
    return _with_truth(shown, truth).select(*JUDGED, "image_path", "dominant_gt_id", "track_purity")


def case_overview(detections: DataFrame, ground_truth: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """One row on what a case holds; ``num_gt_ids`` is null without ground truth. ``videos`` has
    ``camera, duration_sec``; the longest one is told if it is given."""
    seen = detections.agg(
        F.array_join(F.array_sort(F.collect_set("camera")), ", ").alias("cameras"),
        F.min("source_frame").alias("first_source_frame"),
        F.max("source_frame").alias("last_source_frame"),
        F.countDistinct("track_key").alias("num_tracks"),
    )
    true = ground_truth.agg(F.nullif(F.countDistinct("gt_id"), F.lit(0)).alias("num_gt_ids"), F.count(F.lit(1)).alias("gt_rows"))
    if videos is not None:
        seen = seen.crossJoin(videos.agg(F.round(F.max(F.when(F.col("duration_sec") > 0, F.col("duration_sec"))), 2).alias("max_duration_sec")))
    return seen.crossJoin(true)  # one row each


def truth_info(detections: DataFrame, ground_truth: DataFrame, matched: DataFrame) -> DataFrame:
    """One row to see why nothing matches: rows, frame ranges and cameras on either side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.min("source_frame").alias(f"{name}_min_frame"),
            F.max("source_frame").alias(f"{name}_max_frame"),
            F.array_join(F.array_sort(F.collect_set("camera")), ", ").alias(f"{name}_cameras"),
        )

    hits = matched.agg(F.count(F.when(F.col("gt_id") > 0, 1)).alias("matched_rows"))
    return side(detections, "pred").crossJoin(side(ground_truth, "gt")).crossJoin(hits)  # one row each


def camera_status(cameras: DataFrame, detections: DataFrame, judged: DataFrame, scores: DataFrame) -> DataFrame:
    """Each camera of the catalog (``camera``): whether it has been run, its rows, valid tracks and score."""
    rows = detections.groupBy("camera").agg(F.count(F.lit(1)).alias("num_detections"))
    valid = judged.where("is_valid").groupBy("camera").agg(F.count(F.lit(1)).alias("num_valid_tracks"))
    scored = scores.select(F.col("scope").alias("camera"), "tracking_score")
    whole = cameras.join(rows, "camera", "left").join(valid, "camera", "left").join(scored, "camera", "left")
    status = F.when(F.col("num_detections").isNull(), "not_run").otherwise("done")
    return whole.withColumn("status", status).na.fill(0, ["num_detections", "num_valid_tracks"])


def score_table(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scores beside the standard metrics of the same scope."""
    return scores.join(metrics.select("scope", "raw_mota_simple", "motp_iou"), "scope", "left")


def score_rollup(scores: DataFrame) -> DataFrame:
    """Mean and least score over the cameras that have one (metrics themselves don't average)."""
    return scores.where("score_available AND scope <> 'all'").agg(
        F.avg("tracking_score").alias("mean_tracking_score"), F.min("tracking_score").alias("min_tracking_score"), F.count(F.lit(1)).alias("num_cameras_scored")
    )


def expected_identities(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """True identities that were matched; without any, those that dominate a track."""
    one = lambda df, c: df.where(F.col(c) > 0).agg(F.countDistinct(c).alias(c))
    both = one(matched, "gt_id").crossJoin(one(truth, "dominant_gt_id"))  # one row each
    return both.select(F.when(F.col("gt_id") > 0, F.col("gt_id")).otherwise(F.col("dominant_gt_id")).alias("expected_global_ids"))


def identity_overview(identities: DataFrame, verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """One row on association: tracks, identities, merges, reduction and purity."""
    ids = identities.agg(F.countDistinct("track_key").alias("num_local_tracks"), F.countDistinct("global_id").alias("num_global_ids"))
    merged = verdicts.agg(F.count(F.when(F.col("merge_status"), 1)).alias("num_merged_pairs"))
    row = ids.crossJoin(merged).crossJoin(totals)  # one row each
    reduced = (F.col("num_local_tracks") - F.col("num_global_ids")) / F.greatest(F.lit(1), F.col("num_local_tracks"))
    names = ["num_local_tracks", "num_global_ids", "num_merged_pairs"]
    return row.select(*names, reduced.alias("fragment_reduction_rate"), F.col("pure_global_id_rate").alias("mean_global_id_purity"), F.col("false_merge_count").alias("mixed_gid_count"))


def identity_truth(identities: DataFrame, matched: DataFrame) -> DataFrame:
    """Members of identities with each true identity they ever touched (null: none)."""
    real = matched.where("gt_id > 0").select("track_key", "camera", "gt_id").distinct()
    return identities.select("global_id", "track_key", "camera").join(real, ["track_key", "camera"], "left")


def overlay_truth(detections: DataFrame, matched: DataFrame) -> DataFrame:
    """Detections with the match of their camera, frame and track; of several the first (``det_id``)."""
    on = ["camera", "frame", "track_key"]
    first = matched.groupBy(*on).agg(F.min_by(F.struct("gt_id", "gt_iou"), "det_id").alias("first"))
    return detections.join(first, on, "left").select(*detections.columns, F.coalesce("first.gt_id", F.lit(-1)).alias("gt_id"), F.coalesce("first.gt_iou", F.lit(0.0)).alias("gt_iou"))
