"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.stages import settle


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("__u")).agg(F.min("b").alias("__m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("__u"))
    return joined.select(F.col("b").alias("a"), F.least("a", "__m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("__u")).agg(F.min("b").alias("__m"))
    moved = links.join(least, F.col("a") == F.col("__u")).where("b <> __m").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    return moved.unionByName(least.select(F.col("__u").alias("a"), F.col("__m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for each node that has a link.

    ``links`` has two columns of ids; nulls and links of a node to itself are left out. Every
    round halves the depth of the trees at least; its links are a table in the shared folder.
    """
    x, y = links.columns
    links = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(f"`{x}` <> `{y}`").distinct()
    links, seen = settle(links), None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        links = settle(_small_star(_large_star(links)))
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
