"""Tracks: summaries of detections, quality filter, crop samples and track vectors.

``detections`` has ``det_id, camera, frame, track_id, track_key, x1, y1, x2, y2, conf, area,
crop_path``; ``det_id`` fixes the order wherever values tie.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import crop_quality, mean

TRACK = ["camera", "track_id", "track_key"]


@dataclass(frozen=True)
class Limits:
    min_frames: int = 1
    min_crops: int = 1
    min_avg_conf: float = 0.0
    min_avg_area: float = 0.0


def with_keys(detections: DataFrame) -> DataFrame:
    """Adds ``track_key`` where there is none yet: camera, ``_T`` and the track's number."""
    key = F.concat(F.col("camera").cast("string"), F.lit("_T"), F.col("track_id").cast("long").cast("string"))
    return detections if "track_key" in detections.columns else detections.withColumn("track_key", key)


def with_geometry(detections: DataFrame) -> DataFrame:
    """Adds ``width``, ``height`` and ``area`` of the boxes."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return detections.withColumns({"width": wide, "height": high, "area": wide * high})


def summarize(detections: DataFrame) -> DataFrame:
    """One row for each track, by one hash aggregation."""
    has_crop = F.coalesce(F.col("crop_path"), F.lit("")) != ""
    best = F.max_by("crop_path", F.struct("area", "conf", (-F.col("det_id")).alias("first")))
    return detections.groupBy(*TRACK).agg(
        F.countDistinct("frame").alias("num_frames"),
        F.sum(has_crop.cast("long")).alias("num_crops"),
        mean(F.col("conf")).alias("avg_conf"),
        mean(F.col("area")).alias("avg_area"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        best.alias("representative_crop"),
    )


def judge(summary: DataFrame, limits: Limits) -> DataFrame:
    """Adds a boolean for each limit, ``is_valid``, ``status`` and ``filter_reason``."""
    return _judge(summary, {name: F.lit(least) for name, least in asdict(limits).items()})


def judge_by_camera(summary: DataFrame, profiles: DataFrame, otherwise: Limits = Limits()) -> DataFrame:
    """As ``judge``, by the limits of each track's camera. ``profiles`` has a row for a camera and any
    of the limits as columns; ``otherwise`` stands in for missing cameras, columns and nulls."""
    named = {name: f"{name}_limit" for name in asdict(otherwise) if name in profiles.columns}
    known = summary.join(profiles.select("camera", *[F.col(n).alias(a) for n, a in named.items()]), "camera", "left")
    limits = {n: F.coalesce(F.col(named[n]), F.lit(least)) if n in named else F.lit(least) for n, least in asdict(otherwise).items()}
    return _judge(known, limits).drop(*named.values())


def _judge(summary: DataFrame, limits: dict[str, Column]) -> DataFrame:
    tests = {name: F.col(name.replace("min_", "num_") if name in ("min_frames", "min_crops") else name[4:]) >= least for name, least in limits.items()}
    valid = F.lit(True)
    for test in tests.values():
        valid = valid & test
    return summary.withColumns(
        {f"pass_{name}": test for name, test in tests.items()}
        | {
            "is_valid": valid,
            "status": F.when(valid, "valid").otherwise("filtered"),
            "filter_reason": F.concat_ws(", ", *[F.when(~test, name) for name, test in tests.items()]),
        }
    )


def keep_valid(detections: DataFrame, judged: DataFrame) -> DataFrame:
    return detections.join(judged.where("is_valid").select("track_key"), "track_key", "left_semi")


def full_span(vectors: DataFrame, detections: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Replaces what sampled crops said of span, length and means by what all rows say. ``also`` names columns that are
    the same in all rows of a track and come along."""
    whole = detections.groupBy("track_key", *also).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.countDistinct("frame").alias("num_frames"),
        mean(F.col("conf")).alias("avg_conf"),
        mean(F.col("area")).alias("avg_area"),
    )
    return vectors.drop("first_frame", "last_frame", "num_frames", "avg_conf", "avg_area").join(whole, "track_key", "left")


def top_crops(detections: DataFrame, most: int = 48) -> DataFrame:
    """The ``most`` crops of each track with the highest quality."""
    crops = detections.where("coalesce(crop_path, '') <> ''").withColumn("quality", crop_quality("conf", "area"))
    best = Window.partitionBy("track_key").orderBy(F.desc("quality"), "frame", "det_id")
    return crops.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def spread_crops(detections: DataFrame, most: int = 48) -> DataFrame:
    """``most`` crops of each track at even steps from its first to its last one."""
    crops = detections.where("coalesce(crop_path, '') <> ''")
    track = Window.partitionBy("track_key")
    numbered = crops.withColumns({"place": F.row_number().over(track.orderBy("frame", "det_id")) - 1, "n": F.count(F.lit(1)).over(track)})
    wanted = "array(0)" if most == 1 else f"transform(sequence(0, {most - 1}), i -> cast(bround(i * (n - 1) / {most - 1}, 0) AS int))"
    return numbered.where(f"n <= {most} OR array_contains({wanted}, place)").drop("n")


def track_vectors(crops: DataFrame) -> DataFrame:
    """Mean of each track's crop vectors, scaled to length 1 (``vector``, array of doubles), and ``num_crops``.

    Crops that come with ``det_id, frame, conf, area, crop_path`` also give the track's span, means and its
    ``representative_crop``, of the highest quality. All is one hash aggregation: places of the vectors are summed
    up apart, as exact decimals, so one row for a track and partition is shuffled. Vectors are of one length;
    another one is an error. Null vectors don't count."""
    known = crops.where("vector IS NOT NULL")
    one = known.select(F.size("vector").alias("n")).first()
    places = range(one["n"] if one else 0)
    same = F.when(F.size("vector") == len(places), F.col("vector")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    sums = [F.sum(F.get("whole", F.lit(k)).cast("decimal(18,12)")).cast("double").alias(f"__{k}") for k in places]
    more, names = [], []
    if {"det_id", "frame", "conf", "area", "crop_path"} <= set(crops.columns):
        best = F.max_by("crop_path", F.struct(crop_quality("conf", "area").alias("q"), (-F.col("frame")).alias("f"), (-F.col("det_id")).alias("d")))
        more = [F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), mean(F.col("conf")).alias("avg_conf"), mean(F.col("area")).alias("avg_area"), best.alias("representative_crop")]
        names = ["first_frame", "last_frame", "avg_conf", "avg_area", "representative_crop"]
    summed = known.withColumn("whole", same).groupBy("track_key").agg(F.count(F.lit(1)).alias("num_crops"), *more, *sums)
    listed = summed.select("track_key", "num_crops", *names, F.array(*[F.col(f"__{k}") / F.col("num_crops") for k in places]).cast("array<double>").alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    # an argument of a function is told once; inside the inner one the length would be summed up anew for each place
    scaled = F.transform(F.array(length), lambda whole: F.transform("mean", lambda x: x / whole))
    return listed.withColumn("vector", F.get(scaled, F.lit(0))).drop("mean")
