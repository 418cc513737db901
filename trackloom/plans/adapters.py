"""The test tables as object tracks: detections, ground truth and crop vectors.

The SQL is the same for Spark and for the engine that checks results; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Frame of the source video at which the local frames begin.
SOURCE_START = 100

DETECTIONS = """
SELECT *, concat(camera, '_T', cast(track_id AS string)) AS track_key, (x2 - x1) * (y2 - y1) AS area FROM (
SELECT event_id AS det_id, user_id, concat('camera_', cast(1 + user_id % 3 AS string)) AS camera,
 cast((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS int) AS frame,
 cast(user_id * 2 + CASE WHEN extract(day FROM ts) <= 15 THEN 0 ELSE 1 END AS int) AS track_id,
 cast(event_id * 37 % 900 AS double) AS x1, cast(event_id * 53 % 500 AS double) AS y1,
 cast(event_id * 37 % 900 + 40 + event_id % 50 AS double) AS x2,
 cast(event_id * 53 % 500 + 80 + 2 * (event_id % 50) AS double) AS y2,
 round(0.2 + value / 1000.0, 6) AS conf,
 CASE WHEN event_type = 'error' THEN '' ELSE concat('crop_', cast(event_id AS string)) END AS crop_path
FROM {events}) AS raw"""

#: Shifted boxes, one in eight left out. {gt_id}: what tells identities apart.
GROUND_TRUTH = """
SELECT det_id AS gt_ord, camera, cast(frame + 100 AS int) AS source_frame, cast({gt_id} AS int) AS gt_id,
 x1 + 3 * (det_id % 11) AS x1, y1, x2 + 3 * (det_id % 11) AS x2, y2
FROM {detections} AS d WHERE det_id % 8 <> 0"""
BY_BOX, BY_USER = "1 + (det_id % 40)", "1 + user_id % 40"

VECTORS = """
SELECT v.vec_id, d.track_key, v.embedding AS vector
FROM {embeddings} AS v
CROSS JOIN (SELECT 2 * count(DISTINCT user_id) AS n FROM {detections} AS y) AS one_row
JOIN (SELECT DISTINCT track_id, track_key FROM {detections} AS x) AS d ON d.track_id = v.vec_id % one_row.n"""

#: A vector for every crop.
CROPS = """
SELECT d.*, v.embedding AS vector FROM {detections} AS d
CROSS JOIN (SELECT count(*) AS n FROM {embeddings} AS x) AS one_row
JOIN {embeddings} AS v ON v.vec_id = d.det_id % one_row.n
WHERE d.crop_path <> ''"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def ground_truth(spark: SparkSession, sf_dir: str, gt_id: str = BY_BOX, **also: str) -> DataFrame:
    """``also``: further identities of the same boxes."""
    more = "".join(f"cast({value} AS int) AS {name}, " for name, value in also.items())
    return spark.sql(GROUND_TRUTH.replace("SELECT ", f"SELECT {more}", 1).replace("{gt_id}", gt_id), detections=detections(spark, sf_dir))


def crop_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VECTORS, detections=detections(spark, sf_dir), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
