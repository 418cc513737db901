"""Uniform shuffle into shards of exact size.

Two-level scheme. Rows fall into ``blocks`` by a seeded hash of their content, so the outcome is a
function of the rows and the seed alone: retries, other layouts and lost executors give the same
shards. A matrix says how many rows of each block go to each shard. Its rows sum to the block
sizes, its columns to the shard sizes (which differ by one at most), and it is drawn from the
multivariate hypergeometric law, as if every row had been dealt a ticket from one shuffled urn.
Each block is permuted, cut by its row of the matrix, exchanged, and permuted again in the shard.

Neither permutation needs a block or a shard in one task: ranks are taken in ``pieces`` whose
sizes are summed up first, and a rank is the piece's offset plus the rank in the piece. The driver
sees ``blocks`` counts (a parameter, not a function of the data) and draws ``blocks x shards``
numbers; offsets stay in Spark.

Defined results: null texts and null ids are rows like others; fully equal rows are
interchangeable; an empty table gives an empty table; more shards than rows leave shards empty;
input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import without

#: Rows that one piece holds on average.
PIECE_ROWS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``, by inversion outward from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    logs = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(logs(good, mode) + logs(bad, draws - mode) - logs(total, draws))
    left = rng.random()
    up, down, up_p, down_p = mode, mode, peak, peak
    left -= peak
    while left > 0 and (up < high or down > low):
        if up < high:
            up_p *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= up_p
            if left <= 0:
                return up
        if down > low:
            down_p *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= down_p
            if left <= 0:
                return down
        if up_p < 1e-300 and down_p < 1e-300:
            break
    return mode


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int = 0) -> list[list[int]]:
    """Rows for each block and shard; column sums are the shard sizes, the first ones one larger."""
    rng = random.Random(seed)
    total = sum(block_sizes)
    open_in = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for size in block_sizes:
        row, want, rest = [], size, sum(open_in)
        for s, places in enumerate(open_in):
            rest -= places
            taken = hypergeometric(rng, places, rest, want)
            row.append(taken)
            want -= taken
        open_in = [a - b for a, b in zip(open_in, row, strict=True)]
        matrix.append(row)
    return matrix


def ranked(df: DataFrame, group: str, key: str, pieces: int, rank: str) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within ``group`` in a random order given by the hash ``key``."""
    cut = df.withColumn("__piece", F.pmod(F.shiftright(key, 24), F.lit(pieces)).cast("int"))
    sizes = cut.groupBy(group, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("__g"), F.col("__piece").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(group, "__piece").orderBy(key)
    placed = cut.withColumn("__inside", F.row_number().over(inside) - 1)
    joined = placed.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__piece") == F.col("__p")))
    return joined.withColumn(rank, (F.col("__before") + F.col("__inside")).cast("long")).drop(
        "__piece", "__g", "__p", "__before", "__inside"
    )


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, blocks: int = 64) -> DataFrame:
    """All columns of ``docs``, plus ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard)."""
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Maps and variants can't be hashed as they are, nor what holds them; their JSON can.
    hashed = [F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    keyed = docs.select(*names, F.xxhash64(F.lit(seed), *hashed).alias("__key"))
    keyed = keyed.withColumn("__block", F.pmod("__key", F.lit(blocks)).cast("int"))
    found = {r["__block"]: r["n"] for r in keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [found.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, n_shards, seed)
    bounds = []
    for b, row in enumerate(matrix):
        ends, end = [], 0
        for n in row:
            ends.append(end := end + n)
        bounds.append((b, ends))
    cuts = F.broadcast(spark.createDataFrame(bounds, "__b int, __ends array<bigint>"))  # blocks rows
    total = sum(sizes)
    numbered = ranked(keyed, "__block", "__key", max(1, math.ceil(total / blocks / PIECE_ROWS)), "__rank")
    dealt = numbered.join(cuts, F.col("__block") == F.col("__b")).select(
        *names,
        F.xxhash64(F.lit(seed + 1), "__key").alias("__key"),
        F.expr("size(filter(__ends, e -> e <= __rank))").cast("int").alias("shard"),
    )
    again = ranked(dealt, "shard", "__key", max(1, math.ceil(total / n_shards / PIECE_ROWS)), "slot")
    return again.select(*names, "shard", "slot")
