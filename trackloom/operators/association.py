"""Association of tracks into global identities: similarity, mutual neighbours, constrained merging.

``vectors`` has ``track_key, camera, first_frame, last_frame, vector``. Tracks are ordered by
``track_key``; similarities are rounded to 1e-6 and ties go to the least keys, which makes every
result a function of the rows alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import gap, overlap
from trackloom.operators import blocks
from trackloom.sources.stages import settle


@dataclass(frozen=True)
class Rules:
    """When two tracks may be one identity."""

    cross_camera: bool = True
    strict_intra: bool = True
    cross_threshold: float = 0.75
    intra_threshold: float = 0.80
    max_gap: int = 30
    max_overlap: int = 0
    mutual: bool = True


SIDE = {"track": "track_key", "camera": "camera", "first_frame": "first_frame", "last_frame": "last_frame"}
_PAIRS = pa.schema([(f"{n}_{x}", pa.int32() if n.endswith("frame") else pa.string()) for x in "ab" for n in SIDE] + [("cosine_similarity", pa.float64())])
_PAIRS_SQL = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'double' if f.type == pa.float64() else 'string'}" for f in _PAIRS)
#: Vectors that angles are measured to, and those they are chosen from; the rows of a block, at least and at most.
PIVOTS, SAMPLE, LEAST_ROWS, MOST_ROWS = 32, 512, 256, 2000


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _multiply(floor: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        block = rows["block"].to_numpy()
        left, right = (np.flatnonzero(block == k.as_py()) for k in key)
        vectors = _matrix(rows["vector"].chunk(0))
        similar = np.round(vectors[left] @ vectors[right].T, 6)
        names = pc.rank(rows["track_key"], tiebreaker="min").to_numpy()
        wanted = similar >= floor
        if key[0] == key[1]:
            wanted &= names[left][:, None] < names[right][None, :]
        at, to = np.nonzero(wanted)
        x, y = left[at], right[to]
        first = names[x] < names[y]
        a, b = pa.array(np.where(first, x, y)), pa.array(np.where(first, y, x))
        sides = [rows[c].take(side).cast(_PAIRS.field(f"{n}_a").type) for side in (a, b) for n, c in SIDE.items()]
        return pa.Table.from_arrays([*sides, pa.array(similar[at, to])], schema=_PAIRS)

    return run


def _angles(pivots: np.ndarray):
    """Adds the angle of each vector to each pivot, and the nearest pivot."""

    def run(batches):
        for batch in batches:
            angles = np.arccos(np.clip(_matrix(batch["vector"]) @ pivots.T, -1, 1)) if len(batch) else np.zeros((0, len(pivots)))
            nearest = angles.argmin(axis=1) if len(batch) else np.zeros(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(pivots), pa.int32()), pa.array(angles.ravel()))
            own = angles[np.arange(len(batch)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(nearest, pa.int32()), pa.array(own)], [*batch.schema.names, "angles", "nearest", "angle"])

    return run


def _spread(vectors: np.ndarray) -> np.ndarray:
    """``PIVOTS`` of the vectors, each the farthest from those before it."""
    chosen, nearest = [0], np.full(len(vectors), -1.0)
    while len(chosen) < min(PIVOTS, len(vectors)):
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
        chosen.append(int(nearest.argmin()))
    return vectors[chosen]


def near_blocks(placed: DataFrame, floor: float) -> DataFrame:
    """Pairs ``i <= j`` of blocks that may hold vectors with a similarity of ``floor`` or more.

    Angles obey the triangle inequality: if all of one block lie nearer to a pivot than all of another by
    more than the floor's angle, no two of them are that similar. Blocks meet in bins of their angles to
    the first pivot, and are then held against each other by all pivots."""
    reach = math.acos(max(-1.0, min(1.0, floor - 1e-6))) + 1e-9
    k = F.posexplode("angles").alias("pivot", "x")
    spans = placed.select("block", k).groupBy("block", "pivot").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    spans = settle(spans.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))), lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"))).alias("spans")))
    low, high = F.col("spans")[0]["low"], F.col("spans")[0]["high"]
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach).cast("int"), F.floor(b / reach).cast("int"))).alias("bin")
    left = spans.select(F.col("block").alias("i"), F.col("spans").alias("of_i"), bins(low, high))
    right = spans.select(F.col("block").alias("j"), F.col("spans").alias("of_j"), bins(F.greatest(low - reach, F.lit(0.0)), high + reach))
    apart = F.exists(F.zip_with("of_i", "of_j", lambda p, q: F.greatest(p["low"] - q["high"], q["low"] - p["high"])), lambda d: d > reach)
    return left.join(right, "bin").where((F.col("i") <= F.col("j")) & ~apart).select("i", "j").distinct()


def placed_vectors(vectors: DataFrame, block_rows: int | None = None, apart: bool = True) -> tuple[DataFrame, int]:
    """Tracks with vectors in blocks of about as many rows or fewer: ranges of (nearest pivot, angle to it, key), cut
    where the nearest pivot changes if they are to be kept ``apart``. Also the number of ranges."""
    kept = vectors.select(*SIDE.values(), F.col("vector").cast("array<double>").alias("vector"))
    n = kept.count()
    rows = block_rows or max(LEAST_ROWS, min(MOST_ROWS, n // 8))
    # chosen from the vectors of least hash, as many at every size; any choice gives the same pairs
    sample = [r[0] for r in kept.orderBy(F.xxhash64("track_key"), "track_key").select("vector").limit(SAMPLE).collect()]
    blocks = max(1, -(-n // rows))
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", angles array<double>, nearest int, angle double"
    measured = kept.mapInArrow(_angles(_spread(np.array(sample, float))), schema) if sample else kept.select("*", F.array(F.lit(0.0)).alias("angles"), F.lit(0).alias("nearest"), F.lit(0.0).alias("angle"))
    dealt = measured.repartitionByRange(blocks, "nearest", "angle", "track_key")
    dealt = dealt.withColumn("block", F.spark_partition_id() * PIVOTS + F.col("nearest") if apart else F.spark_partition_id())
    return settle(dealt.drop("nearest", "angle")), blocks


def similar_pairs(vectors: DataFrame, floor: float = -1.0, block_rows: int | None = None) -> DataFrame:
    """Every pair of tracks with at least ``floor`` similarity, with both sides' cameras and spans.

    Blocks of near vectors are multiplied, each two of them once, unless their angles to the pivots rule
    the floor out (``near_blocks``); what a task emits is bounded by the floor. Without a floor all pairs are
    asked for, so the work is quadratic in the tracks of a case."""
    placed, ranges = placed_vectors(vectors, block_rows, floor > -1)
    if floor <= -1:
        other = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("other")
        met = placed.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    else:
        near = settle(near_blocks(placed, floor))
        sides = near.select("i", "j", F.col("i").alias("block")).unionByName(near.where("i < j").select("i", "j", F.col("j").alias("block")))
        met = placed.join(sides, "block")
    return met.select("i", "j", "block", *SIDE.values(), "vector").groupBy("i", "j").applyInArrow(_multiply(floor), _PAIRS_SQL)


def pair_table(vectors: DataFrame, floor: float = -1.0, more: list[str] | None = None) -> DataFrame:
    """``similar_pairs`` with their gap and their overlap, and both sides' columns of ``more``.

    Without a floor every pair is made, in wide blocks (``blocks.every_pair``)."""
    pairs = similar_pairs(vectors, floor) if floor > -1 else blocks.every_pair(vectors.select(*SIDE.values(), "vector", *(more or [])), more or [])
    return _told(pairs, *[f"{c}_{x}" for c in more or [] for x in "ab"])


def _told(pairs: DataFrame, *more: str) -> DataFrame:
    spans = [F.col(c) for c in ("first_frame_a", "last_frame_a", "first_frame_b", "last_frame_b")]
    return pairs.select(
        *("track_a camera_a first_frame_a last_frame_a track_b camera_b first_frame_b last_frame_b".split()),
        (F.col("camera_a") == F.col("camera_b")).alias("same_camera"),
        gap(*spans).alias("temporal_gap"),
        overlap(*spans).alias("temporal_overlap"),
        "cosine_similarity",
        *more,
    )


def mutual_neighbours(pairs: DataFrame, threshold: float) -> DataFrame:
    """Cross-camera pairs in which each track is the other's best partner over all other cameras."""
    cross = pairs.where(~F.col("same_camera") & (F.col("cosine_similarity") >= threshold))
    both = cross.select(F.col("track_a").alias("src"), F.col("track_b").alias("dst"), "cosine_similarity").union(cross.select("track_b", "track_a", "cosine_similarity"))
    best = both.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("cosine_similarity")).alias("s"), "dst")).alias("dst"))
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return best.join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("track_a"), F.col("dst").alias("track_b"))


def classify(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``merge_reason``: why a pair may merge, or why not."""
    mutual = mutual_neighbours(pairs, rules.cross_threshold).withColumn("is_mutual", F.lit(True))
    return pairs.join(mutual, ["track_a", "track_b"], "left").withColumn("merge_reason", _reason(rules)).drop("is_mutual")


def _reason(rules: Rules):
    same, sim = F.col("same_camera"), F.col("cosine_similarity")
    fragment = F.lit(rules.strict_intra) & same & (sim >= rules.intra_threshold) & (F.col("temporal_gap") <= rules.max_gap)
    across = F.lit(rules.cross_camera) & ~same & (sim >= rules.cross_threshold)
    return (
        F.when(fragment & (F.col("temporal_overlap") <= rules.max_overlap), "intra_fragment_recovery")
        .when(fragment, "rejected_temporal_overlap")
        .when(across & F.lit(rules.mutual) & F.col("is_mutual"), "cross_camera_mnn")
        .when(across & F.lit(not rules.mutual), "cross_camera_threshold")
        .otherwise("not_merged")
    )


CANDIDATES = ("intra_fragment_recovery", "cross_camera_mnn", "cross_camera_threshold")


def _clashing(open_pairs: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """Pairs of clusters that can't be one: two of their tracks are of one camera, and overlap or lie too far apart."""
    side = lambda x: members.select(F.col("root").alias(f"root_{x}"), "camera", F.col("first_frame").alias(f"f_{x}"), F.col("last_frame").alias(f"l_{x}"))
    met = open_pairs.where("fresh AND root_a <> root_b").select("root_a", "root_b").distinct().join(side("a"), "root_a").join(side("b"), ["root_b", "camera"])
    shared = F.least("l_a", "l_b") - F.greatest("f_a", "f_b") + 1
    return met.where((shared > rules.max_overlap) | (-shared > rules.max_gap)).select("root_a", "root_b").distinct()


def _moved(rows: DataFrame, moves: DataFrame, *roots: str) -> DataFrame:
    """``rows`` by what their clusters are now; ``{root}_to`` is null for those that haven't changed."""
    changed = moves.select("from", "to").unionByName(moves.select(F.col("to").alias("from"), "to"))
    for root in roots:
        to = changed.select(F.col("from").alias(root), F.col("to").alias(f"{root}_to"))
        rows = rows.join(to, root, "left").withColumn(root, F.coalesce(f"{root}_to", root))
    return rows


def merge(classified: DataFrame, rules: Rules) -> DataFrame:
    """Merge decisions for the candidates: ``track_a, track_b, merged, root_a, root_b``, as if they were taken one
    by one, most similar first, each merge blocked that would put two tracks of one camera together that overlap
    or lie too far apart."""
    wanted = classified.where(F.col("merge_reason").isin(*CANDIDATES))
    ends = [wanted.select(F.col(f"track_{x}").alias("track"), F.col(f"camera_{x}").alias("camera"), F.col(f"first_frame_{x}").alias("first_frame"), F.col(f"last_frame_{x}").alias("last_frame"), F.col(f"track_{x}").alias("root")) for x in "ab"]
    members = settle(ends[0].unionByName(ends[1]).distinct())
    return decisions(wanted, decide(wanted.select("track_a", "track_b", "cosine_similarity", F.col("track_a").alias("root_a"), F.col("track_b").alias("root_b")), members, rules))


def decisions(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """``track_a, track_b, merged, root_a, root_b``. Once all is decided, candidates within a cluster are the merges:
    only a merge brings tracks together, and clusters that clash never become one."""
    root = lambda x: members.select(F.col("track").alias(f"track_{x}"), F.col("root").alias(f"root_{x}"))
    known = wanted.select("track_a", "track_b").join(root("a"), "track_a").join(root("b"), "track_b")
    return known.select("track_a", "track_b", (F.col("root_a") == F.col("root_b")).alias("merged"), "root_a", "root_b")


#: Candidates that one task decides, at most, and tracks of their clusters that it is given.
FEW, FEW_TRACKS = 100_000, 1_000_000


def decide(wanted: DataFrame, members: DataFrame, rules: Rules, few: int | None = None, fresh: bool = True) -> DataFrame:
    """``members`` (``track, camera, first_frame, last_frame, root``) by their clusters after the candidates of
    ``wanted`` (``track_a, track_b, cosine_similarity`` and the clusters of before, ``root_a, root_b``).

    A round decides many at once, each as it would be in order. Two clusters that clash never become one, so
    their candidates are blocked whenever that shows. A candidate that is the first one left at both of its
    clusters merges: neither cluster changes before its turn. Candidates inside one cluster are merges too,
    as only earlier ones can have joined it. Clusters are told by their least track. The number of
    rounds follows the longest chain of candidates that wait for each other, not the size of components. The last ``few``
    (``FEW``), however many there were, are taken in turn by one task. ``fresh`` is whether clusters of ``wanted`` may clash."""
    few = FEW if few is None else few
    order = F.struct((-F.col("cosine_similarity")).alias("s"), "track_a", "track_b", "root_a", "root_b")
    waiting = wanted.select("track_a", "track_b", "cosine_similarity", "root_a", "root_b", F.lit(fresh).alias("fresh"))
    while True:
        clash = _clashing(waiting, members, rules).withColumn("clash", F.lit(True))
        undecided = waiting.where("root_a <> root_b").join(clash, ["root_a", "root_b"], "left_anti")
        left = settle(undecided.select("track_a", "track_b", "cosine_similarity", "root_a", "root_b"))
        n = left.count()
        if not n:
            return members
        if n <= few:
            roots = left.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct()
            theirs = settle(members.join(roots, "root", "left_semi"))
            if theirs.count() <= FEW_TRACKS:
                return settle(_in_turn(left, theirs, members, rules))
        at = left.select(F.explode(F.array("root_a", "root_b")).alias("root"), order.alias("key"))
        first = at.groupBy("root").agg(F.min("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        moves = settle(first.select("key.track_a", "key.track_b", F.greatest("key.root_a", "key.root_b").alias("from"), F.least("key.root_a", "key.root_b").alias("to")))
        members = settle(_moved(members, moves, "root").select(*members.columns))
        rest = left.join(moves.select("track_a", "track_b"), ["track_a", "track_b"], "left_anti")
        moved = F.col("root_a_to").isNotNull() | F.col("root_b_to").isNotNull()
        waiting = _moved(rest, moves, "root_a", "root_b").select("track_a", "track_b", "cosine_similarity", "root_a", "root_b", moved.alias("fresh"))


def _in_turn(left: DataFrame, theirs: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """``members`` after the candidates ``left``, taken one by one; ``theirs`` are the tracks of these clusters."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        tracks, pairs = rows.filter(pc.is_null(rows["root_b"])), rows.filter(pc.is_valid(rows["root_b"]))
        pairs = pairs.take(pc.sort_indices(pairs, sort_keys=[("cosine_similarity", "descending"), ("track_a", "ascending"), ("track_b", "ascending")]))
        names = pc.unique(tracks["root_a"])
        names = names.take(pc.sort_indices(names))
        at = lambda column: pc.index_in(column, value_set=names).to_pylist()
        up, spans = list(range(len(names))), [{} for _ in names]
        for k, camera, first, last in zip(at(tracks["root_a"]), *(tracks[c].to_pylist() for c in ("camera", "first_frame", "last_frame")), strict=True):
            spans[k].setdefault(camera, []).append((first, last))
        spans = [{camera: seen for camera, seen in s.items() if camera is not None} for s in spans]

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def clash(p: dict, q: dict) -> bool:
            for camera in p.keys() & q.keys():
                for f, l in p[camera]:  # noqa: E741
                    for g, m in q[camera]:
                        shared = min(l, m) - max(f, g) + 1
                        if shared > rules.max_overlap or -shared > rules.max_gap:
                            return True
            return False

        for a, b in zip(at(pairs["root_a"]), at(pairs["root_b"]), strict=True):
            a, b = sorted((top(a), top(b)))
            if a != b and not clash(spans[a], spans[b]):
                up[b] = a
                for camera, seen in spans[b].items():
                    spans[a].setdefault(camera, []).extend(seen)
        changed = [k for k in range(len(names)) if top(k) != k]
        return pa.table({"from": names.take(pa.array(changed, pa.int64())), "to": names.take(pa.array([top(k) for k in changed], pa.int64()))})

    rows = left.unionByName(theirs.select(F.col("root").alias("root_a"), "camera", "first_frame", "last_frame"), allowMissingColumns=True)
    moves = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "from string, to string")
    return members.join(moves.withColumnRenamed("from", "root"), "root", "left").withColumn("root", F.coalesce("to", "root")).select(*members.columns)


#: Candidates of a camera taken at first, for each track and at least; how much more each further band holds.
EACH, AT_LEAST, WIDER = 2, 200_000, 32


def _bands(vectors: DataFrame, rules: Rules, each: int, at_least: int) -> list[float]:
    """Similarities at which the candidates within cameras are cut, falling, down to the threshold. They only say
    how many candidates are taken at once, as told by the pairs of ``4 * SAMPLE`` tracks (those of least hash, at every
    size); any cuts give the same result."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("track_key"), "track_key").select("camera", "first_frame", "last_frame", "vector").limit(4 * SAMPLE).collect()
    if len(rows) < 2:
        return [rules.intra_threshold]
    camera = np.unique([r.camera for r in rows], return_inverse=True)[1]
    first, last = np.array([r.first_frame for r in rows]), np.array([r.last_frame for r in rows])
    similar = np.array([r.vector for r in rows], float)
    similar = similar @ similar.T
    shared = np.minimum.outer(last, last) - np.maximum.outer(first, first) + 1
    fit = np.triu(np.equal.outer(camera, camera) & (np.maximum(shared, 0) <= rules.max_overlap) & (np.maximum(-shared, 0) <= rules.max_gap) & (similar >= rules.intra_threshold), 1)
    found = np.sort(similar[fit])[::-1]
    cuts, take = [], max(each * n, at_least) * (len(rows) / n) ** 2
    while take < len(found):
        cut = round(float(found[int(take)]), 6)
        if cut > rules.intra_threshold and (not cuts or cut < cuts[-1]):
            cuts.append(cut)
        take *= WIDER
    return [*cuts, rules.intra_threshold]


def partners(placed: DataFrame, rules: Rules, threshold: float | None = None) -> DataFrame:
    """``track_a, track_b, cosine_similarity`` of mutual neighbours, from each track's best partner."""
    return mutual(blocks.best_partners(placed, rules.cross_threshold if threshold is None else threshold), rules.cross_threshold)


def mutual(best: DataFrame, threshold: float) -> DataFrame:
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = best.where(F.col("cosine_similarity") >= threshold).join(back, ["src", "dst"]).where("src < dst")
    return found.select(F.col("src").alias("track_a"), F.col("dst").alias("track_b"), "cosine_similarity")


@dataclass(frozen=True)
class Associated:
    """What ``associate`` found: ``tracks`` with ``vector, root, firsts, lasts`` in blocks, the mutual neighbours, and the
    candidates that were merged, as ``pair_table`` with ``merge_status`` and ``merge_reason``."""

    tracks: DataFrame
    best: DataFrame | None
    mutual: DataFrame
    merged: DataFrame


def associate(vectors: DataFrame, rules: Rules, every_best: bool = False, each: int = EACH, at_least: int = AT_LEAST) -> Associated:
    """The clusters that ``merge`` makes of ``classify``'s candidates, without a row for each pair of tracks or each candidate.

    Mutual neighbours come of each track's best partner. Candidates within cameras, of which there may be far more than
    tracks, are taken in bands of falling similarity, so the order of decisions is kept: what a band leaves
    is decided by clusters alone. From the second band on candidates whose clusters clash already, which are
    blocked whatever comes, aren't made. ``every_best`` also gives best partners below the threshold. ``rules`` are those
    with ``mutual``; without it candidates of other cameras are as many as pairs above the threshold (``classify``, ``merge``)."""
    if not rules.mutual:
        raise ValueError("without mutual neighbours, classify the pairs and merge them")
    kept = vectors.select(*SIDE.values(), "vector")
    placed = blocks.in_blocks(kept)
    best = blocks.best_partners(placed, -2.0 if every_best else rules.cross_threshold, following=every_best)
    pairs = settle(mutual(best, rules.cross_threshold if rules.cross_camera else 3.0))
    members = settle(kept.select(F.col("track_key").alias("track"), "camera", "first_frame", "last_frame", F.col("track_key").alias("root")))
    cuts = _bands(placed, rules, each, at_least) if rules.strict_intra else [rules.intra_threshold]
    high = float("inf")
    for k, low in enumerate(cuts):
        across = pairs.where((F.col("cosine_similarity") < high) & ((F.col("cosine_similarity") >= low) | F.lit(low == cuts[-1])))
        band = _rooted(across, members).select("track_a", "track_b", "root_a", "root_b", "cosine_similarity")
        if rules.strict_intra:
            bare = settle(_open(blocks_of(placed, members), members, rules)) if k else placed.withColumn("root", F.col("track_key"))
            band = band.unionByName(blocks.fragments(bare, low, high, rules.max_gap, rules.max_overlap, clashing=k == 0))
        members, high = decide(settle(band), members, rules, fresh=k > 0), low
    tracks = settle(blocks_of(placed, members))
    return Associated(tracks, best, pairs, settle(_merges(tracks, pairs, rules)))


def _rooted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(members.select(F.col("track").alias(f"track_{x}"), F.col("root").alias(f"root_{x}")), f"track_{x}")
    return pairs


def _open(tracks: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """``tracks`` (``blocks_of``) whose clusters may still take a track of their camera: one fits before them, behind
    them or in a hole that isn't shorter than the shortest track. Most clusters are soon full, so bands after the first are small."""
    if rules.max_overlap > 0:
        return tracks
    shortest = members.agg(F.min(F.col("last_frame") - F.col("first_frame") + 1)).first()[0]
    behind = F.array_min("lasts") + rules.max_gap >= F.array_max("lasts")
    before = F.array_max("firsts") - rules.max_gap <= F.array_min("firsts")
    n = F.size("firsts")  # spans come in order and share no frame
    holes = F.zip_with(F.slice("firsts", F.lit(2), n), F.slice("lasts", F.lit(1), n - 1), lambda f, l: f - l - 1)  # noqa: E741
    return tracks.where(behind | before | F.exists(holes, lambda hole: hole >= shortest))


def _merges(tracks: DataFrame, pairs: DataFrame, rules: Rules) -> DataFrame:
    """The candidates that were merged: those of one cluster, as only a merge brings tracks together."""
    side = lambda x, *more: tracks.select(*[F.col(c).alias(f"{n}_{x}") for n, c in SIDE.items()], *more)
    across = pairs.join(side("a", F.col("root").alias("root_a")), "track_a").join(side("b", F.col("root").alias("root_b")), "track_b").where("root_a = root_b").drop("root_a", "root_b")
    known = across
    if rules.strict_intra:
        met = side("a", "root", "camera", F.col("vector").alias("vector_a")).join(side("b", "root", "camera", F.col("vector").alias("vector_b")), ["root", "camera"]).where("track_a < track_b")
        spans = [F.col(c) for c in ("first_frame_a", "last_frame_a", "first_frame_b", "last_frame_b")]
        inside = blocks.told_pairs(met.where((gap(*spans) <= rules.max_gap) & (overlap(*spans) <= rules.max_overlap)).drop("root", "camera"))
        known = across.unionByName(inside.where(F.col("cosine_similarity") >= rules.intra_threshold))
    reason = F.when(F.col("same_camera"), "intra_fragment_recovery").otherwise("cross_camera_mnn")
    return _told(known).withColumns({"merge_status": F.lit(True), "merge_reason": reason})


def blocks_of(placed: DataFrame, members: DataFrame) -> DataFrame:
    """``placed`` with each track's cluster (``root``) and the spans that the cluster has in its camera (``firsts, lasts``)."""
    spans = members.groupBy("root", "camera").agg(F.array_sort(F.collect_list(F.struct("first_frame", "last_frame"))).alias("spans"))
    of = members.select(F.col("track").alias("track_key"), "camera", "root").join(spans, ["root", "camera"])
    told = of.select("track_key", "root", F.col("spans.first_frame").alias("firsts"), F.col("spans.last_frame").alias("lasts"))
    return placed.drop("root", "firsts", "lasts").join(told, "track_key")


def candidate_verdicts(found: Associated, rules: Rules) -> DataFrame:
    """All candidates with ``merge_status`` and the final ``merge_reason``: those within cameras as rows that no shuffle sees."""
    roots = found.tracks.select(F.col("track_key").alias("track"), "root")
    whole = _rooted(found.mutual, roots).select("track_a", "track_b", (F.col("root_a") == F.col("root_b")).alias("merge_status"), F.lit("cross_camera_mnn").alias("merge_reason"))
    if rules.strict_intra:
        inside = blocks.fragments(found.tracks, rules.intra_threshold, float("inf"), rules.max_gap, rules.max_overlap, judged=True)
        whole = inside.select("track_a", "track_b", F.col("same").alias("merge_status"), F.lit("intra_fragment_recovery").alias("merge_reason")).unionByName(whole)
    return whole.withColumn("merge_reason", F.when(F.col("merge_status"), F.col("merge_reason")).otherwise("blocked_cluster_temporal_conflict"))


def with_partner(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tracks with the key of their mutual neighbour, ``partner`` (null: none)."""
    both = pairs.select(F.col("track_a").alias("track_key"), F.col("track_b").alias("partner")).unionByName(pairs.select("track_b", "track_a").toDF("track_key", "partner"))
    return tracks.join(both, "track_key", "left")


def every_verdict(tracks: DataFrame, rules: Rules, *more: str) -> DataFrame:
    """All pairs with their reason, as ``classify`` gives it for ``rules`` with ``mutual``. ``tracks`` has each track's ``partner``, so no pair is joined with anything;
    if it has clusters too (``root``) the pairs are those of ``verdicts``. Both sides' columns of ``more`` come along."""
    rooted = ["root"] if "root" in tracks.columns else []
    pairs = pair_table(tracks, more=["partner", *rooted, *more]).withColumn("is_mutual", F.coalesce(F.col("partner_a") == F.col("track_b"), F.lit(False)))
    pairs = pairs.withColumn("merge_reason", _reason(rules)).drop("is_mutual", "partner_a", "partner_b")
    if not rooted:
        return pairs
    wanted, same = F.col("merge_reason").isin(*CANDIDATES), F.col("root_a") == F.col("root_b")
    reason = F.when(wanted & ~same, "blocked_cluster_temporal_conflict").otherwise(F.col("merge_reason"))
    return pairs.withColumns({"merge_status": wanted & same, "merge_reason": reason}).drop("root_a", "root_b")


def verdicts(classified: DataFrame, merges: DataFrame) -> DataFrame:
    """All pairs with ``merge_status`` and the final ``merge_reason``."""
    joined = classified.join(merges.select("track_a", "track_b", "merged"), ["track_a", "track_b"], "left")
    return joined.withColumns(
        {
            "merge_status": F.coalesce("merged", F.lit(False)),
            "merge_reason": F.when(~F.col("merged"), "blocked_cluster_temporal_conflict").otherwise(F.col("merge_reason")),
        }
    ).drop("merged")


def number_identities(tracks: DataFrame, merges: DataFrame) -> DataFrame:
    """Adds ``global_id``: 1, 2, ... in the order of each identity's least track key."""
    roots = merges.select(F.col("track_a").alias("track_key"), F.col("root_a").alias("root")).union(merges.select("track_b", "root_b")).distinct()
    return number_clusters(tracks, roots)


def number_clusters(tracks: DataFrame, roots: DataFrame) -> DataFrame:
    """As ``number_identities``, by ``track_key, root``."""
    rooted = tracks.join(roots, "track_key", "left").withColumn("root", F.coalesce("root", "track_key"))
    ids = numbered(rooted.select("root").distinct(), "root", "global_id")
    return rooted.join(ids, "root").drop("root")


def numbered(rows: DataFrame, key, number: str) -> DataFrame:
    """Adds ``number``: 1, 2, ... in the order of ``key``, a column or a list of them. Rows are dealt into
    ranges of the key and numbered inside each; the ranges' sizes (a row each) give the offsets."""
    key = key if isinstance(key, list) else [key]
    ranged = settle(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__range", before.alias("__before")))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*key))
    placed = ranged.withColumn("__inside", inside).join(offsets, "__range")
    return placed.withColumn(number, (F.col("__before") + F.col("__inside")).cast("int")).drop("__range", "__inside", "__before")


def label_rows(detections: DataFrame, identities: DataFrame) -> DataFrame:
    return detections.join(identities.select("track_key", "global_id"), "track_key", "left")
