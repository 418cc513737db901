"""Tracks against tracks in wide blocks: what leaves a block is a few rows for a track, or the pairs asked for.

Tracks lie in ranges of (camera, first frame, key). Two blocks meet in one task, which multiplies them in pieces,
so what is shuffled grows with tracks x blocks and what a task holds is two blocks and a product of two pieces.
Similarities are rounded to 1e-6, and ties go to the least keys. Products are taken in single precision first: they
only rule pairs out, by a bound on their error, and what may count is told by the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.sources.stages import settle

#: Rows of a block, at least and at most; blocks in a middling case; rows of the pieces multiplied at once.
LEAST_ROWS, MOST_ROWS, BLOCKS, PIECE = 256, 20_000, 16, 1000
#: Spans of a cluster that a block's task looks at; further ones are left to the merge.
SPANS = 8
SIDE = {"track": "track_key", "camera": "camera", "first_frame": "first_frame", "last_frame": "last_frame"}
#: Similarities are rounded, so a product may lie below what it is rounded to.
SLACK = 1e-6
#: Pairs whose similarity is told at once.
AT_ONCE = 50_000
#: Rows of a tile of pairs and columns of it; a tile is a row until Spark makes pairs of it.
TALL, WIDE = 64, 512


def in_blocks(tracks: DataFrame, by: tuple[str, ...] = ("camera", "first_frame", "track_key")) -> DataFrame:
    """Tracks with their ``block``, settled. They are read several times, so they should be settled too."""
    n = tracks.count()
    rows = max(LEAST_ROWS, min(MOST_ROWS, -(-n // BLOCKS)))
    blocks = max(1, -(-n // rows))
    kept = tracks.withColumn("vector", F.col("vector").cast("array<double>"))
    return settle(kept.repartitionByRange(blocks, *by).withColumn("block", F.spark_partition_id()))


def meetings(placed: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Each two blocks ``i <= j`` once: their rows twice, under the pair. ``wanted`` is a condition on what ``p`` and
    ``q`` tell of the blocks: least and most camera, first and last frame."""
    told = [f(c).alias(f"{n}_{c}") for c in ("camera", "first_frame", "last_frame") for n, f in (("least", F.min), ("most", F.max))]
    blocks = settle(placed.groupBy("block").agg(*told))  # a row for a block
    pairs = blocks.alias("p").join(blocks.alias("q"), F.col("p.block") <= F.col("q.block"))
    pairs = settle((pairs if wanted is None else pairs.where(wanted)).select(F.col("p.block").alias("i"), F.col("q.block").alias("j")))
    sides = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.where("i < j").select("i", "j", F.col("j").alias("block")))
    return placed.join(F.broadcast(sides), "block").repartition(max(1, pairs.count()), "i", "j")


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches)).combine_chunks()


class _Block:
    """The rows of a pair of blocks as arrays, in an order, and each block's rows cut into pieces of one camera."""

    def __init__(self, key: tuple, batches: Iterator[pa.RecordBatch], by_name: bool):
        rows = _table(batches)
        rank = pc.rank(rows["track_key"], tiebreaker="min").to_numpy()
        camera = rows["camera"].combine_chunks().dictionary_encode().indices.to_numpy()
        first = rows["first_frame"].to_numpy()
        order = np.lexsort((rank, camera) if by_name else (rank, first, camera))
        self.rows, self.rank, self.camera = rows.take(pa.array(order)), rank[order], camera[order]
        self.first, self.last = first[order].astype(np.int64), rows["last_frame"].to_numpy()[order].astype(np.int64)
        self.vectors = self.rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        self.near, self.slack = self.vectors, SLACK
        longest = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors).max(initial=0.0))
        if longest < 1e15:  # a sum of n products is off by n + 2 roundings at most, of 2**-24 each
            self.near, self.slack = self.vectors.astype(np.float32), SLACK + (self.vectors.shape[1] + 4) * 2.0**-24 * longest**2
        self.same = key[0] == key[1]
        block = self.rows["block"].to_numpy()
        self.sides = [self._pieces(np.flatnonzero(block == k.as_py())) for k in key]

    def _pieces(self, at: np.ndarray) -> list[np.ndarray]:
        cuts = np.flatnonzero(np.diff(self.camera[at])) + 1
        return [run[k : k + PIECE] for run in np.split(at, cuts) for k in range(0, len(run), PIECE)]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each two pieces once."""
        for m, a in enumerate(self.sides[0]):
            for b in self.sides[1][m:] if self.same else self.sides[1]:
                yield a, b

    def numbered(self) -> dict[int, int]:
        """The number of each piece, by its first row."""
        return {a[0]: k for k, a in enumerate(self.sides[0] if self.same else self.sides[0] + self.sides[1])}

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.vectors[a] @ self.vectors[b].T

    def about(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarities of all of two pieces, which rounded ones differ from by ``slack`` at most."""
        return self.near[a] @ self.near[b].T

    def told(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rounded similarity of each two rows."""
        parts = [np.einsum("ij,ij->i", self.vectors[x[k : k + AT_ONCE]], self.vectors[y[k : k + AT_ONCE]]) for k in range(0, len(x), AT_ONCE)]
        return np.round(np.concatenate(parts), 6) if parts else np.zeros(0)

    def ordered(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        swap = self.rank[x] > self.rank[y]
        return np.where(swap, y, x), np.where(swap, x, y)

    def pairs(self, x: np.ndarray, y: np.ndarray, value: np.ndarray, columns: dict[str, str], name: str = "cosine_similarity") -> pa.RecordBatch:
        """Pairs as rows, the track of lesser key as ``a``."""
        sides = self.ordered(x, y)
        names, held = [], []
        for side, at in zip("ab", sides, strict=True):
            for called, column in columns.items():
                names.append(f"{called}_{side}")
                held.append(self.rows[column].take(pa.array(at)).combine_chunks())
        return pa.RecordBatch.from_arrays([*held, pa.array(value)], [*names, name])


def _pairs_schema(placed: DataFrame, columns: dict[str, str], value: str = "cosine_similarity double") -> str:
    kinds = dict(placed.dtypes)
    return ", ".join(f"{n}_{x} {kinds[c]}" for x in "ab" for n, c in columns.items()) + f", {value}"


def tiles(tracks: DataFrame, told: dict[str, str]) -> DataFrame:
    """All pairs as tiles: ``p`` and ``q`` are lists of tracks with the columns ``told``, which hold those of ``SIDE``, and
    ``similar`` has the similarities of each of ``p`` to all of ``q``. ``q[k]`` comes behind ``p[m]`` if ``k + ahead > m``.

    Blocks are ranges of keys, so a pair's order is that of its blocks. Inside a block tracks lie in the order of their keys
    for the pairs within it, and by camera and time for those with other blocks, which leaves neighbouring rows alike."""
    placed = in_blocks(tracks, ("track_key",))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, same = _table(batches), key[0] == key[1]
        order = ["track_key"] if same else ["camera", "first_frame", "last_frame", "track_key"]
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order])).combine_chunks()
        block = rows["block"].to_numpy()
        vectors = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        sides = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in told.values()], list(told))
        left, right = (np.flatnonzero(block == k.as_py()) for k in key)
        for m in range(0, len(left), TALL):
            at, to = left[m : m + TALL], right[m:] if same else right
            similar = np.round(vectors[at] @ vectors[to].T, 6)
            cuts = np.append(np.arange(0, len(to), WIDE), len(to)).astype(np.int32)
            n = len(cuts) - 1
            p = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(at), sides.take(pa.array(np.tile(at, n))))
            q = pa.ListArray.from_arrays(cuts, sides.take(pa.array(to)))
            numbers = [similar[:, k:e].ravel() for k, e in zip(cuts, cuts[1:], strict=False)]
            ahead = cuts[:-1] if same else np.full(n, TALL, np.int32)
            yield pa.RecordBatch.from_arrays([p, q, pa.ListArray.from_arrays(cuts * len(at), np.concatenate(numbers)), pa.array(ahead)], ["p", "q", "similar", "ahead"])

    kinds = dict(placed.dtypes)
    side = "array<struct<" + ", ".join(f"`{n}`: {kinds[c]}" for n, c in told.items()) + ">>"
    met = meetings(placed).select("i", "j", "block", *dict.fromkeys(told.values()), "vector")
    return met.groupBy("i", "j").applyInArrow(run, f"p {side}, q {side}, similar array<double>, ahead int")


def every_pair(tracks: DataFrame, more: list[str]) -> DataFrame:
    """All pairs with both sides' columns, those of ``more`` too. What leaves a task are tiles, some bytes for a pair;
    Spark makes the rows of them, those of a track together, and no shuffle follows."""
    told = SIDE | {c: c for c in more}
    rows = tiles(tracks, told).select("q", "similar", "ahead", F.size("q").alias("wide"), F.posexplode("p").alias("m", "a"))
    pairs = rows.select("m", "a", "similar", "ahead", "wide", F.posexplode("q").alias("k", "b")).where("k + ahead > m")
    similar = F.get("similar", F.col("m") * F.col("wide") + F.col("k")).alias("cosine_similarity")
    return pairs.select(*[F.col(x)[n].alias(f"{n}_{x}") for x in "ab" for n in told], similar)


def top_pairs(placed: DataFrame, most: int) -> DataFrame:
    """The ``most`` similar pairs (of equal ones those of least keys): each two blocks give as many at most."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(key, batches, True)
        x, y, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for a, b in block.pieces():
            found = block.about(a, b)
            if a[0] == b[0]:
                found[block.rank[a][:, None] >= block.rank[b][None, :]] = -np.inf
            high = found.max(axis=1)
            least = (s[-1] if len(s) == most else -2.0) - block.slack
            if len(a) >= most:  # as many rows have a pair of such a similarity
                least = max(least, np.partition(high, -most)[-most] - 2 * block.slack)
            rows = np.flatnonzero(high >= least)
            at, to = np.nonzero(found[rows] >= least)
            p, q = block.ordered(a[rows[at]], b[to])
            x, y, s = np.append(x, p), np.append(y, q), np.append(s, block.told(p, q))
            keep = np.lexsort((block.rank[y], block.rank[x], -s))[:most]
            x, y, s = x[keep], y[keep], s[keep]
        yield block.pairs(x, y, s, SIDE)

    found = meetings(placed).select("i", "j", "block", *SIDE.values(), "vector").groupBy("i", "j").applyInArrow(run, _pairs_schema(placed, SIDE))
    return found.orderBy(F.desc("cosine_similarity"), "track_a", "track_b").limit(most)


def best_partners(placed: DataFrame, threshold: float = -2.0, skip: str | None = None, following: bool = False) -> DataFrame:
    """``src, dst, cosine_similarity``: each track's most similar one of another camera, if it is as similar as the
    threshold. ``skip`` names a column with the key of a track that doesn't count as its partner. ``following`` adds
    ``next_similarity``, that of the second (null: none)."""
    most = 2 if following else 1

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(key, batches, True)
        best, partner = np.full((most, len(block.rank)), -np.inf), np.full((most, len(block.rank)), -1)
        barred = pc.index_in(block.rows[skip], value_set=block.rows["track_key"].combine_chunks()).fill_null(-1).to_numpy() if skip else None

        def without_barred(seen: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
            for k in np.flatnonzero(np.isin(barred[mine], other)) if skip else ():
                seen[k, np.searchsorted(other, barred[mine[k]])] = -np.inf
            return seen

        # at first only what each row sees of each piece at most; then the pieces that may hold its best are looked into
        number = block.numbered()
        high, whole = np.full((len(number), len(block.rank)), -np.inf, block.near.dtype), {}
        for a, b in block.pieces():
            whole |= {number[a[0]]: a, number[b[0]]: b}
            if block.camera[a[0]] == block.camera[b[0]]:
                continue
            similar = block.about(a, b)
            high[number[a[0]], b] = without_barred(similar.T.copy(), b, a).max(axis=1) if skip else similar.max(axis=0)
            high[number[b[0]], a] = without_barred(similar, a, b).max(axis=1)
        bound = np.maximum(np.partition(high, -most, axis=0)[-most] if most <= len(high) else -np.inf, threshold + block.slack) - 2 * block.slack if len(high) else None
        for k, other in whole.items():
            mine = np.flatnonzero(high[k] >= bound)
            if not len(mine):
                continue
            seen = without_barred(block.about(mine, other), mine, other)
            least = bound[mine]
            if most <= len(other):
                least = np.maximum(least, np.partition(seen, -most, axis=1)[:, -most] - 2 * block.slack)
            row, to = np.divmod(np.flatnonzero(seen >= least.astype(seen.dtype)[:, None]), len(other))
            x, y = mine[row], other[to]
            s = block.told(x, y)
            x, y, s = x[s >= threshold], y[s >= threshold], s[s >= threshold]
            for n in range(most):  # those of before come along
                old = mine[partner[n, mine] >= 0]
                x, y, s = np.append(x, old), np.append(y, partner[n, old]), np.append(s, best[n, old])
            by = np.lexsort((block.rank[y], -s, x))
            x, y, s = x[by], y[by], s[by]
            starts = np.flatnonzero(np.diff(x, prepend=-1))
            place = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
            for n in range(most):
                best[n, x[place == n]], partner[n, x[place == n]] = s[place == n], y[place == n]
        names = block.rows["track_key"]
        for k in range(most):
            at = np.flatnonzero(partner[k] >= 0)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)).combine_chunks(), names.take(pa.array(partner[k, at])).combine_chunks(), pa.array(best[k, at])], ["src", "dst", "cosine_similarity"])

    apart = F.col("p.least_camera").eqNullSafe(F.col("q.most_camera")) & F.col("p.most_camera").eqNullSafe(F.col("q.least_camera"))
    columns = [*SIDE.values(), "vector"] + ([skip] if skip else [])
    found = meetings(placed, ~apart).select("i", "j", "block", *columns).groupBy("i", "j").applyInArrow(run, "src string, dst string, cosine_similarity double")
    if following:  # a block gives two rows for a track at most
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("cosine_similarity")).alias("less"), "dst"))).alias("found")
        two = found.groupBy("src").agg(ranked).select("src", F.get("found", F.lit(0)).alias("p"), F.get("found", F.lit(1)).alias("q"))
        return settle(two.select("src", "p.dst", (-F.col("p.less")).alias("cosine_similarity"), (-F.col("q.less")).alias("next_similarity")))
    best = F.min_by(F.struct("dst", "cosine_similarity"), F.struct((-F.col("cosine_similarity")).alias("s"), "dst")).alias("best")
    return settle(found.groupBy("src").agg(best).select("src", "best.*"))


def fragments(placed: DataFrame, low: float, high: float, max_gap: int, max_overlap: int, clashing: bool = True, judged: bool = False) -> DataFrame:
    """``track_a, track_b, root_a, root_b, cosine_similarity`` of pairs of one camera with ``low <= similarity < high`` that
    lie near each other in time and don't overlap. Without ``clashing`` only pairs of different clusters (``root``) that
    may be one: by ``firsts`` and ``lasts``, the spans of the tracks that a track's cluster has in its camera. ``judged``
    pairs have ``same`` (whether they are one cluster) in place of clusters and similarity."""
    columns = {"track": "track_key"} | ({} if judged else {"root": "root"})

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(key, batches, False)
        first, last = block.first, block.last
        root = block.rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        if not clashing:
            counts = pc.list_value_length(block.rows["firsts"]).to_numpy()
            spans = []
            for c in ("firsts", "lasts"):
                whole = block.rows[c].combine_chunks()
                values, starts = whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])[:-1]
                spans.append([values[np.minimum(starts + k, len(values) - 1)].astype(np.int64) for k in range(min(SPANS, counts.max()))])
        for a, b in block.pieces():
            if block.camera[a[0]] != block.camera[b[0]]:
                continue
            if min(last[a].min(), last[b].min()) - max(first[a].max(), first[b].max()) + 1 > max_overlap or max(first[a].min() - last[b].max(), first[b].min() - last[a].max()) - 1 > max_gap:
                continue
            similar = block.about(a, b)
            rows = np.flatnonzero(similar.max(axis=1) >= low - block.slack)
            similar = similar[rows] if len(rows) < len(a) else similar
            wanted = similar >= low - block.slack
            if high < np.inf:
                wanted &= similar < high + block.slack
            at, to = np.divmod(np.flatnonzero(wanted), len(b))
            x, y = a[rows[at]], b[to]
            shared = np.minimum(last[x], last[y]) - np.maximum(first[x], first[y]) + 1
            keep = (np.maximum(shared, 0) <= max_overlap) & (np.maximum(-shared, 0) <= max_gap)
            if a[0] == b[0]:
                keep &= block.rank[x] < block.rank[y]
            if not clashing:
                keep &= root[x] != root[y]
            at, to, x, y = at[keep], to[keep], x[keep], y[keep]
            if not clashing and len(x):
                bad = np.zeros(len(x), bool)
                for m, (fx, lx) in enumerate(zip(*spans, strict=True)):
                    for n, (fy, ly) in enumerate(zip(*spans, strict=True)):
                        shared = np.minimum(lx[x], ly[y]) - np.maximum(fx[x], fy[y]) + 1
                        bad |= (m < counts[x]) & (n < counts[y]) & ((shared > max_overlap) | (-shared > max_gap))
                at, to, x, y = at[~bad], to[~bad], x[~bad], y[~bad]
            s = similar[at, to].astype(float)
            near = np.flatnonzero((s < low + block.slack) | (s >= high - block.slack)) if judged else slice(None)
            s[near] = block.told(x[near], y[near])
            keep = (s >= low) & (s < high)
            x, y, s = x[keep], y[keep], s[keep]
            if len(x):
                yield block.pairs(x, y, root[x] == root[y], columns, "same") if judged else block.pairs(x, y, s, columns)

    apart = F.least("p.least_last_frame", "q.least_last_frame") - F.greatest("p.most_first_frame", "q.most_first_frame") + 1 > max_overlap
    far = F.greatest(F.col("p.least_first_frame") - F.col("q.most_last_frame"), F.col("q.least_first_frame") - F.col("p.most_last_frame")) - 1 > max_gap
    shared = (F.col("p.least_camera") <= F.col("q.most_camera")) & (F.col("q.least_camera") <= F.col("p.most_camera"))
    kept = [*SIDE.values(), "vector", "root"] + ([] if clashing else ["firsts", "lasts"])
    schema = _pairs_schema(placed, columns, "same boolean" if judged else "cosine_similarity double")
    return meetings(placed, shared & ~apart & ~far).select("i", "j", "block", *kept).groupBy("i", "j").applyInArrow(run, schema)


def told_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both ``vector_a`` and ``vector_b``, by their ``cosine_similarity`` instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[f"vector_{x}"].flatten().to_numpy(zero_copy_only=False).reshape(max(1, len(batch)), -1) for x in "ab")
            similar = np.round(np.einsum("ij,ij->i", a, b), 6)[: len(batch)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(similar)], [*names, "cosine_similarity"])

    names = [c for c in pairs.columns if c not in ("vector_a", "vector_b")]
    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cosine_similarity double")
