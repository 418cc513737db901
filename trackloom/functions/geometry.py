"""Column functions on boxes, spans and vectors, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL of the box and span functions; ``register`` makes them temporary functions.
SQL = {
    "iou": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE",
        "coalesce(greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1))"
        " / nullif(greatest(0, ax2 - ax1) * greatest(0, ay2 - ay1) + greatest(0, bx2 - bx1) * greatest(0, by2 - by1)"
        " - greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)), 0), 0)",
    ),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) + 1e-12D)",
    ),
    "temporal_overlap": ("a0 INT, a1 INT, b0 INT, b1 INT", "greatest(0, least(a1, b1) - greatest(a0, b0) + 1)"),
    "temporal_gap": ("a0 INT, a1 INT, b0 INT, b1 INT", "greatest(0, greatest(a0, b0) - least(a1, b1) - 1)"),
}


def iou(a: str, b: str) -> str:
    """SQL for the intersection over union of two boxes, 0 for an empty union; ``a`` and ``b`` are prefixes."""
    wide = f"greatest(0D, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    high = f"greatest(0D, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"greatest(0D, {p}x2 - {p}x1) * greatest(0D, {p}y2 - {p}y1)"
    union = f"({area(a)} + {area(b)} - {wide} * {high})"
    return f"CASE WHEN {union} > 0 THEN {wide} * {high} / {union} ELSE 0D END"


def overlap(a0, a1, b0, b1) -> Column:
    """Frames two spans share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)


def gap(a0, a1, b0, b1) -> Column:
    """Frames between two spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1) - 1)


def clip_box(width: int, height: int) -> list[Column]:
    """Corners rounded half to even and held inside the image; filter on x2 > x1 and y2 > y1 after it."""
    inside = lambda c, most: F.least(F.greatest(F.bround(c, 0), F.lit(0.0)), F.lit(float(most - 1))).cast("int").alias(c)
    return [inside("x1", width), inside("y1", height), inside("x2", width), inside("y2", height)]


def crop_quality(conf, area) -> Column:
    return F.col(conf) * F.log1p(area)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def weighted(weights: dict[str, float]) -> Column:
    """Weighted mean of columns, each held to 0..1, null as 0."""
    total = sum(weights.values())
    return sum((clamp01(F.col(c)) * w for c, w in weights.items()), F.lit(0.0)) / total


def mean(value: Column) -> Column:
    """Mean by an exact decimal sum, so that it doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(18,6)")).cast("double") / F.count(value)


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1", "yes", "valid"), F.lit(False))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_-]", "_"), "_+", "_")


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def register(spark: SparkSession) -> None:
    """``iou``, ``cosine``, ``temporal_gap`` and ``temporal_overlap`` for SQL. They are inlined into plans."""
    for name, (arguments, body) in SQL.items():
        kind = "INT" if name.startswith("temporal") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
