"""Ground-truth annotations: JSON files of ``{frame: [{id, box}, ...]}``, one for each camera."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Names under which a box and an identity may be found, first one first.
BOX_NAMES = ("BboxP", "bboxP", "bbox", "box")
ID_NAMES = ("id", "gt_id", "person_id", "track_id")
#: The same, and a frame's, in annotations of other shapes.
NESTED_FRAME_NAMES = ("source_frame", "frame", "frame_id", "frame_index", "frame_number", "frameNumber", "image_id")
NESTED_ID_NAMES = ("person_id", "identity_id", "identity", "gt_id", "track_id", "subject_id", "object_id", "id")
NESTED_BOX_NAMES = ("BboxP", "bboxP", "bbox", "box", "bounding_box", "rect")
_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"


def _whole(column: str) -> Column:
    """A number in text, cut to a whole one; null for anything else."""
    return F.expr(f"try_cast(try_cast({column} AS double) AS int)")


def box_corners(box: Column, list_format: str = "xyxy") -> Column:
    """``struct<x1,y1,x2,y2>`` from a box in JSON: a list, or a record by corner or by size; a part
    that is no number is null."""
    at = lambda path: F.get_json_object(box, path).try_cast("double")
    listed = [at(f"$[{k}]") for k in range(4)]
    x, y = F.coalesce(at("$.x1"), at("$.left"), at("$.x")), F.coalesce(at("$.y1"), at("$.top"), at("$.y"))
    width, height = F.coalesce(at("$.w"), at("$.width")), F.coalesce(at("$.h"), at("$.height"))
    x2, y2 = F.coalesce(at("$.x2"), at("$.right"), x + width), F.coalesce(at("$.y2"), at("$.bottom"), y + height)
    if list_format == "xywh":
        listed = [*listed[:2], listed[0] + listed[2], listed[1] + listed[3]]
    parts = (F.coalesce(a, b).alias(n) for a, b, n in zip(listed, (x, y, x2, y2), ("x1", "y1", "x2", "y2"), strict=True))
    return F.struct(*parts)


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with a frame, an id that isn't negative and a box with an inside; adds ``gt_area``.
    What is no number makes its row go, not the load fail."""
    kept = rows.where("source_frame IS NOT NULL AND gt_id >= 0 AND x2 > x1 AND y2 > y1")
    return kept.withColumn("gt_area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def parse(files: DataFrame) -> DataFrame:
    """``camera, source_frame, gt_id, x1, y1, x2, y2, gt_area`` from rows ``camera, value`` (JSON);
    repeated rows stay once. Keys that are no numbers, values that are no lists and members that are
    no records are passed over; the others of the same file stay."""
    frames = files.select("camera", F.explode(F.from_json("value", "map<string,string>")).alias("frame", "items"))
    listed = frames.where(F.col("frame").rlike(_NUMBER)).select("camera", _whole("frame").alias("source_frame"), F.from_json("items", "array<string>").alias("items"))
    items = listed.select("camera", "source_frame", F.explode("items").alias("item"))
    found = lambda names: F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])
    raw = items.select("camera", "source_frame", found(ID_NAMES).alias("id"), box_corners(found(BOX_NAMES)).alias("b"))
    return valid_rows(raw.select("camera", "source_frame", _whole("id").alias("gt_id"), "b.*")).distinct()


def _records(text: str):
    """``frame, id, box`` (the last two as JSON) of every record at any depth of a JSON text. A record
    without a frame takes that of the nearest one around it, or else its nearest numeric key."""
    try:
        todo = [(json.loads(text), None)]
    except (TypeError, ValueError):
        return
    while todo:
        node, frame = todo.pop()
        if isinstance(node, list):
            todo += [(child, frame) for child in node]
        elif isinstance(node, dict):
            frame, who, box = (
                next((node[n] for n in names if node.get(n) is not None), default)
                for names, default in ((NESTED_FRAME_NAMES, frame), (NESTED_ID_NAMES, None), (NESTED_BOX_NAMES, None))
            )
            if frame is not None and who is not None and box is not None:
                yield str(frame), str(who), json.dumps(box)
            todo += [(child, key if frame is None and key.replace(".", "", 1).isdigit() else frame) for key, child in node.items()]


def parse_nested(files: DataFrame, list_format: str = "xyxy") -> DataFrame:
    """As ``parse``, from JSON of any shape; repeated rows stay once. A file is read by one task, as
    JSON can't be split; what it holds is judged by Spark afterwards."""

    def run(batches):
        for batch in batches:
            for camera, text in zip(batch["camera"], batch["value"], strict=True):
                yield pd.DataFrame([(camera, *r) for r in _records(text)], columns=["camera", "frame", "id", "box"])

    raw = files.select("camera", "value").mapInPandas(run, "camera string, frame string, id string, box string")
    return valid_rows(raw.select("camera", _whole("frame").alias("source_frame"), _whole("id").alias("gt_id"), box_corners(F.col("box"), list_format).alias("b")).select("camera", "source_frame", "gt_id", "b.*")).distinct()


def parse_any(files: DataFrame, list_format: str = "xyxy") -> DataFrame:
    """``parse``, and ``parse_nested`` for the cameras in which it finds nothing."""
    plain = parse(files)
    other = files.join(plain.select("camera").distinct(), "camera", "left_anti")
    return plain.unionByName(parse_nested(other, list_format))


def locate(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files under ``path``: ``camera`` (the part ``camera_<number>`` of the file's name, or else of its
    folder's, exactly, so that camera_1 isn't camera_10) and ``value``. Of several files for a camera the first by
    name is taken."""
    name = F.col("_metadata.file_path")
    found = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"(camera_\d+)(?!\d)[^/]*$", r"(camera_\d+)(?!\d)[^/]*/[^/]*$")], F.lit(""))
    files = spark.read.text(path, wholetext=True).select(found.alias("camera"), name.alias("name"), "value")
    return files.where("camera <> ''").groupBy("camera").agg(F.min_by("value", "name").alias("value"))


def read(spark: SparkSession, path: str, first_frame: int | None = None, last_frame: int | None = None, annotation_start: int = 1) -> DataFrame:
    """All annotation files under ``path``, one for each camera; frames counted from 0 are moved by one; both
    limits are inclusive."""
    gt = parse_any(locate(spark, path)).withColumn("source_frame", F.col("source_frame") + (1 if annotation_start == 0 else 0))
    return gt.where(F.lit(True) if first_frame is None else F.col("source_frame").between(first_frame, last_frame))


#: What is counted for each camera while a case's ground truth is loaded.
COUNTED = ("rows_before", "rows_after", "first_before", "last_before", "first_after", "last_after")


class Load:
    """Ground truth of a case and what its load has counted; the counts are there once an action has read ``rows``."""

    def __init__(self, rows: DataFrame, cameras: list[str], seen: Observation):
        self.rows, self.cameras, self._seen = rows, cameras, seen

    def counters(self) -> list[dict]:
        """A record for each camera of the case, with ``error`` where it gave nothing."""
        found = self._seen.get
        out = []
        for k, camera in enumerate(self.cameras):
            row = {"camera": camera} | {name: found[f"{name}_{k}"] for name in COUNTED}
            row["error"] = "no annotation" if not row["rows_before"] else "nothing within the frames" if not row["rows_after"] else None
            out.append(row)
        return out


def load_case(annotations: DataFrame, case: dict) -> Load:
    """Rows of the case's cameras and frames from parsed annotations, with counts before and after the range of
    frames from the same pass. ``case``: a row of the catalog."""
    cameras, seen = list(case["cameras"]), Observation()
    low, high = case["source_frame_start"], case["source_frame_end"]
    moved = annotations.withColumn("source_frame", F.col("source_frame") + (1 if case["annotation_frame_start"] == 0 else 0))
    counts, inside = [], F.col("source_frame").between(low, high)
    for k, camera in enumerate(cameras):
        before = F.col("camera") == camera
        for name, test in (("before", before), ("after", before & inside)):
            frame = F.when(test, F.col("source_frame"))
            counts += [F.count(frame).alias(f"rows_{name}_{k}"), F.min(frame).alias(f"first_{name}_{k}"), F.max(frame).alias(f"last_{name}_{k}")]
    observed = moved.observe(seen, *counts)
    return Load(observed.where(F.col("camera").isin(*cameras) & inside), cameras, seen)
