import random
import re

import numpy as np
import pytest

from trackloom.operators import association, blocks
from trackloom.operators.tracks import track_vectors

VECTORS = "track_key string, camera string, first_frame int, last_frame int, vector array<double>"


@pytest.mark.parametrize("strict", [True, False])
def test_rules_by_case(spark, strict):
    """Same-camera pairs: only similar, near ones are recovered, or rejected for their overlap."""
    rows = [("a", True, 0.9, 5, 0), ("b", True, 0.9, 0, 4), ("c", True, 0.1, 0, 4), ("d", True, 0.9, 99, 0), ("e", False, 0.9, 0, 4), ("f", False, 0.1, 0, 0)]
    pairs = spark.createDataFrame([(f"{n}1", f"{n}2", *r) for n, *r in rows], "track_a string, track_b string, same_camera boolean, cosine_similarity double, temporal_gap int, temporal_overlap int")
    found = {r.track_a[0]: r.merge_reason for r in association.classify(pairs, association.Rules(strict_intra=strict)).collect()}
    none = "not_merged"
    intra = {"a": "intra_fragment_recovery", "b": "rejected_temporal_overlap"} if strict else {"a": none, "b": none}
    assert found == {"c": none, "d": none, "e": "cross_camera_mnn", "f": none} | intra


@pytest.mark.parametrize("block_rows", [3, 7, 100])
def test_every_pair_comes_once(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(f"t{k}", "c", 0, 1, [rng.uniform(-0.5, 0.5) for _ in range(4)]) for k in range(20)]
    got = association.similar_pairs(spark.createDataFrame(rows, VECTORS), block_rows=block_rows).collect()
    want = {(a[0], b[0]): round(sum(x * y for x, y in zip(a[4], b[4], strict=True)), 6) for a in rows for b in rows if a[0] < b[0]}
    assert len(got) == len(want) and {(r.track_a, r.track_b): r.cosine_similarity for r in got} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_over_ranges(spark, n):
    names = sorted(f"t{k}" for k in range(n))
    rows = spark.createDataFrame([(x,) for x in names], "root string").repartition(7)
    got = association.numbered(rows, "root", "global_id").collect()
    assert sorted((r.global_id, r.root) for r in got) == list(enumerate(names, 1))


def fold(pairs, rules):
    """The decisions taken one by one: ``{(a, b): merged}`` and each track's cluster by its least track."""

    def clash(p, q):
        shared = min(p[2], q[2]) - max(p[1], q[1]) + 1
        return p[0] == q[0] and (shared > rules.max_overlap or -shared > rules.max_gap)

    group, said = {}, {}
    for a, b, _, p, q in pairs:
        group.setdefault(a, {a: p}), group.setdefault(b, {b: q})
    for a, b, _, _, _ in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        left, right = group[a], group[b]
        said[a, b] = left is right or not any(clash(p, q) for p in left.values() for q in right.values())
        if said[a, b] and left is not right:
            left.update(right)
            for t in right:
                group[t] = left
    return said, {t: min(g) for t, g in group.items()}


def random_graphs(n, rng):
    pairs = []
    for g in range(n):
        size, frames = rng.randrange(2, 9), rng.choice([6, 30, 100])
        spans = []
        for k in range(size):
            first = rng.randrange(frames)
            spans.append((f"g{g:04}_{k}", (rng.choice("xyz"), first, first + rng.randrange(12))))
        for i in range(size):
            for j in range(i + 1, size):
                if rng.random() < 0.6:
                    pairs.append((spans[i][0], spans[j][0], rng.choice([0.5, 0.6, 0.6, 0.7, rng.random()]), spans[i][1], spans[j][1]))
    # one long component, whose candidates wait for each other
    chain = [(f"h{k:03}", ("x", 20 * k, 20 * k + 9)) for k in range(30)]
    return pairs + [(a, b, 0.9 - 0.001 * k, p, q) for k, ((a, p), (b, q)) in enumerate(zip(chain, chain[1:], strict=False))]


@pytest.mark.parametrize("max_gap, max_overlap", [(10, 0), (60, 3)])
def test_rounds_decide_as_one_by_one(spark, max_gap, max_overlap):
    rules = association.Rules(max_gap=max_gap, max_overlap=max_overlap)
    pairs = random_graphs(1500, random.Random(max_gap))
    schema = "track_a string, track_b string, cosine_similarity double, camera_a string, first_frame_a int, last_frame_a int, camera_b string, first_frame_b int, last_frame_b int, merge_reason string"
    rows = [(a, b, s, *p, *q, "cross_camera_mnn") for a, b, s, p, q in pairs]
    got = association.merge(spark.createDataFrame(rows, schema), rules).collect()
    said, roots = fold(pairs, rules)
    assert {(r.track_a, r.track_b): r.merged for r in got} == said and len(got) == len(pairs)
    assert all(r.root_a == roots[r.track_a] and r.root_b == roots[r.track_b] for r in got)


def vectors(n, spread, seed):
    """``n`` unit vectors around a few directions; a small ``spread`` keeps them close."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, n)] / 4 + spread * rng.normal(size=(n, 16))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("spread, floor", [(0.02, 0.9), (1.0, 0.5), (0.1, -0.2)])
def test_candidates_above_a_floor(spark, spread, floor):
    made = vectors(400, spread, 1)
    rows = [(f"t{k:03}", "c", 0, 1, v) for k, v in enumerate(made)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.track_a, r.track_b): r.cosine_similarity for r in association.similar_pairs(df, floor, 20).collect()}
    want = {(r.track_a, r.track_b): r.cosine_similarity for r in association.similar_pairs(df, block_rows=150).collect()}
    assert len(want) == 400 * 399 // 2 and got == {k: s for k, s in want.items() if s >= floor}


@pytest.mark.parametrize("n", [300, 1200])
def test_far_blocks_are_not_multiplied(spark, n):
    rows = [(f"t{k:05}", "c", 0, 1, v) for k, v in enumerate(vectors(n, 0.02, 2))]
    placed, _ = association.placed_vectors(spark.createDataFrame(rows, VECTORS), n // 20)
    sizes = {r.block: r["count"] for r in placed.groupBy("block").count().collect()}
    met = sum(sizes[r.i] * sizes[r.j] for r in association.near_blocks(placed, 0.9).collect())
    print(f"{n} vectors in {len(sizes)} blocks: {2 * met / n**2:.2f} of all pairs multiplied")
    assert met < 0.2 * n * n / 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert association.similar_pairs(none, 0.5).count() == association.similar_pairs(none).count() == 0


def small_case(n, seed):
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, 80, n)
    copies = [v if k % 7 else v0 for k, (v, v0) in enumerate(zip(vectors(n, 0.3, seed), [vectors(1, 0.3, seed)[0]] * n, strict=True))]
    return [(f"t{k:04}", f"c{k % 3}", int(s), int(s + rng.integers(3, 20)), v) for k, (s, v) in enumerate(zip(starts, copies, strict=True))]


@pytest.mark.parametrize("at_least", [20, 10**6])
def test_association_without_a_row_for_each_pair(spark, at_least):
    """The same clusters and verdicts as over all pairs, with candidates in bands and with all at once."""
    rules = association.Rules(cross_threshold=0.3, intra_threshold=0.25, max_gap=60)
    df = spark.createDataFrame(small_case(90, 3), VECTORS)
    classified = association.classify(association.pair_table(df), rules)
    merges = association.merge(classified, rules)
    want = {(r.track_a, r.track_b): (r.merge_status, r.merge_reason) for r in association.verdicts(classified, merges).collect()}
    found = association.associate(df, rules, each=0, at_least=at_least)
    cuts = association._bands(df, rules, 0, at_least)
    assert len(cuts) == 1 if at_least == 10**6 else len(cuts) > 1
    got = {(r.track_a, r.track_b): (r.merge_status, r.merge_reason) for r in association.candidate_verdicts(found, rules).collect()}
    assert got == {k: v for k, v in want.items() if v[0] or v[1].startswith("blocked_")} and {v[0] for v in got.values()} == {True, False}
    assert {(r.track_a, r.track_b): (r.merge_status, r.merge_reason) for r in found.merged.collect()} == {k: v for k, v in got.items() if v[0]}
    every = association.every_verdict(association.with_partner(found.tracks, found.mutual), rules).collect()
    assert len(every) == 90 * 89 // 2 and {(r.track_a, r.track_b): (r.merge_status, r.merge_reason) for r in every} == want


def test_partners_and_top_pairs_of_equal_ones(spark):
    rows = small_case(300, 4)
    df, rank = spark.createDataFrame(rows, VECTORS), {r[0]: r for r in rows}
    placed = blocks.in_blocks(df)
    pairs = {(r.track_a, r.track_b): r.cosine_similarity for r in association.similar_pairs(df).collect()}
    top = sorted(pairs, key=lambda p: (-pairs[p], p))[:20]
    assert [(r.track_a, r.track_b) for r in blocks.top_pairs(placed, 20).collect()] == top
    both = [(a, b, s) for p, s in pairs.items() for a, b in (p, p[::-1]) if rank[a][1] != rank[b][1]]
    first = {a: min((-s, b) for x, b, s in both if x == a) for a in rank}
    assert {r.src: (-r.cosine_similarity, r.dst) for r in blocks.best_partners(placed).collect()} == first
    barred = spark.createDataFrame([(a, b) for a, (_, b) in first.items()], "track_key string, skip string")
    second = {a: min((-s, b) for x, b, s in both if x == a and b != first[a][1]) for a in rank}
    assert {r.src: (-r.cosine_similarity, r.dst) for r in blocks.best_partners(placed.join(barred, "track_key"), skip="skip").collect()} == second


def test_what_leaves_a_block_is_no_row_for_each_pair(spark):
    """A row for a track and block at most, where every pair was one; the candidates aren't shuffled."""
    df = spark.createDataFrame(small_case(600, 5), VECTORS)
    placed = blocks.in_blocks(df)
    met = blocks.meetings(placed)
    assert met.count() <= 600 * (placed.select("block").distinct().count() + 1)
    assert blocks.best_partners(placed).count() <= 600


@pytest.mark.parametrize("n, tall, wide, least", [(1, 64, 512, 256), (70, 64, 512, 256), (70, 3, 7, 256), (150, 4, 9, 20), (150, 64, 512, 20)])
def test_every_pair_leaves_its_task_in_tiles(spark, monkeypatch, n, tall, wide, least):
    """Tasks send few rows for many pairs, and each pair comes once, in the order of its keys, with both sides' columns."""
    for name, value in (("TALL", tall), ("WIDE", wide), ("LEAST_ROWS", least)):
        monkeypatch.setattr(blocks, name, value)
    rows = [(*r, None if k % 5 else f"p{k}") for k, r in enumerate(small_case(n, 8))]
    df = spark.createDataFrame(rows, VECTORS + ", more string").repartition(3)
    parts = max(1, -(-n // max(least, -(-n // blocks.BLOCKS))))
    met = parts * (parts + 1) // 2
    # blocks are of about the same size: twice the tiles of even ones are room enough
    assert blocks.tiles(df, blocks.SIDE).count() <= 2 * met * -(-n // (parts * tall)) * -(-n // (parts * wide)) + 2 * met
    got = association.pair_table(df, more=["more"]).collect()
    of = {r[0]: r for r in rows}
    assert len(got) == n * (n - 1) // 2 == len({(r.track_a, r.track_b) for r in got})
    for r in got:
        a, b = of[r.track_a], of[r.track_b]
        assert r.track_a < r.track_b
        assert (r.camera_a, r.first_frame_a, r.last_frame_a, r.more_a) == (*a[1:4], a[5]) and (r.camera_b, r.first_frame_b, r.last_frame_b, r.more_b) == (*b[1:4], b[5])
        assert r.same_camera == (a[1] == b[1]) and r.cosine_similarity == pytest.approx(sum(x * y for x, y in zip(a[4], b[4], strict=True)), abs=1e-6)


def test_tracks_of_a_tile_lie_near_in_time(spark, monkeypatch):
    """Of two blocks, whose keys tell the order of each pair, tracks come by camera and time."""
    for name, value in (("TALL", 4), ("WIDE", 9), ("LEAST_ROWS", 20)):
        monkeypatch.setattr(blocks, name, value)
    made = blocks.tiles(spark.createDataFrame(small_case(150, 8), VECTORS), blocks.SIDE).collect()
    across = [t for t in made if t.ahead == 4]  # within a block it is a multiple of 9
    assert len(across) > len(made) / 2
    for side in [x for t in across for x in (t.p, t.q)]:
        spans = [(r.camera, r.first_frame, r.last_frame) for r in side]
        assert spans == sorted(spans)
    assert all(max(r.track for r in t.p) < min(r.track for r in t.q) for t in across)


def test_second_partners(spark):
    rows = small_case(300, 6)
    df, of = spark.createDataFrame(rows, VECTORS), {r[0]: r for r in rows}
    pairs = {(r.track_a, r.track_b): r.cosine_similarity for r in association.similar_pairs(df).collect()}
    seen = {a: [] for a in of}
    for p, s in pairs.items():
        for a, b in (p, p[::-1]):
            if of[a][1] != of[b][1]:
                seen[a].append((-s, b))
    want = {a: (x[0][1], -x[0][0], -x[1][0]) for a, x in ((a, sorted(x)) for a, x in seen.items())}
    assert {r.src: (r.dst, r.cosine_similarity, r.next_similarity) for r in blocks.best_partners(blocks.in_blocks(df), following=True).collect()} == want


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_the_last_candidates_are_taken_in_turn(spark, few):
    """Any number of them gives the same clusters; a chain of candidates is no chain of rounds any more."""
    rules, settled = association.Rules(max_gap=60, max_overlap=3), []
    pairs = random_graphs(200, random.Random(7))
    wanted = spark.createDataFrame([(a, b, s, a, b) for a, b, s, _, _ in pairs], "track_a string, track_b string, cosine_similarity double, root_a string, root_b string")
    spans = {t: p for a, b, _, p, q in pairs for t, p in ((a, p), (b, q))}
    members = spark.createDataFrame([(t, *p, t) for t, p in spans.items()], "track string, camera string, first_frame int, last_frame int, root string")
    before, association.settle = association.settle, lambda df: settled.append(1) or before(df)
    try:
        got = {r.track: r.root for r in association.decide(wanted, members, rules, few).collect()}
    finally:
        association.settle = before
    assert got == fold(pairs, rules)[1]
    assert len(settled) <= 3 if few == 10**6 else len(settled) > 6


def test_full_clusters_are_left_out_of_further_bands(spark):
    """A cluster of two halves of the time takes no third track; one with room before, behind or inside may."""
    rules = association.Rules(max_gap=60)
    rows = [("a", 0, 300, "a"), ("b", 330, 700, "a"), ("c", 0, 300, "c"), ("d", 100, 140, "d"), ("e", 150, 170, "d"), ("f", 0, 100, "f"), ("g", 150, 400, "f")]
    members = spark.createDataFrame([(t, "x", f, l, r) for t, f, l, r in rows], "track string, camera string, first_frame int, last_frame int, root string")
    placed = members.selectExpr("track AS track_key", "camera", "first_frame", "last_frame", "array(1.0D) AS vector", "0 AS block")
    left = association._open(association.blocks_of(placed, members), members, rules)
    assert {r.track_key for r in left.collect()} == set("abcdefg")  # holes of 29 and 49 frames, and tracks of 21
    long = members.where("track NOT IN ('d', 'e')")
    assert {r.track_key for r in association._open(association.blocks_of(placed, long), long, rules).collect()} == {"c"}


def test_a_vector_is_summed_up_once_for_its_length(spark):
    crops = spark.createDataFrame([("t1", [3.0, 0.0]), ("t1", [3.0, 8.0]), ("t2", [0.0, 2.0])], "track_key string, vector array<double>")
    found = track_vectors(crops)
    got = {r.track_key: r.vector for r in found.collect()}
    assert got == {"t1": pytest.approx([0.6, 0.8]), "t2": pytest.approx([0.0, 1.0])}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    within = re.findall(r"lambdafunction\(\(lambda \S+ / (.*?), lambda", plan)  # what each place is divided by
    assert within and not any("aggregate(" in x for x in within)
