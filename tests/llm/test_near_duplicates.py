import random

from trackloom.llm.near_duplicates import group_near_duplicates, keep_one, mark_duplicates

SCHEMA = "doc_id long, text string, Kept string"


def brute(rows, n, percent):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()

    ids = {i: i for i, *_ in rows}

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return {i: (len(x), root(i)) for i, x in sets}


def texts(seed, groups, copies, words):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(*words))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((len(rows) + 100, " ".join(own).title()))
    return rows


def test_matches_brute_force(spark):
    rows = [(i, t, "x") for i, t in texts(1, 60, 12, (5, 200))]
    rows += [(1, None, None), (2, "", None), (3, " \n ", None), (4, "one", None), (5, "ONE", None), (6, "one two", None)]
    want = brute(rows, 4, 80)
    got = group_near_duplicates(spark.createDataFrame(rows, SCHEMA), n=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_copies(spark):
    base = [f"w{k}" for k in range(400)]
    rng, rows = random.Random(4), []
    for i in range(600):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(400)] = f"y{i}"
        rows.append((i, " ".join(own), None))
    got = group_near_duplicates(spark.createDataFrame(rows, SCHEMA), n=4).collect()
    assert {r.component_id for r in got} == {0}


def test_nulls_ties_and_clashing_columns(spark):
    text = "a b c d e f g"
    rows = [(7, text, "x"), (7, text, "x"), (None, text, "y"), (9, text, "z"), (None, "p q r s t", "n"), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(group_near_duplicates(df).collect(), key=str)
    assert len(got) == 6
    assert [r.kept for r in got if r.doc_id == 7] == [True, True]
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 9] == [(7, False)]
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("7", False), ("None", True), ("None", True)]
    marked = mark_duplicates(df)
    assert marked.columns == ["doc_id", "text", "component_id", "kept"] and marked.count() == 6
    assert group_near_duplicates(df.limit(0)).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "None", "None", "None"]


def test_large_regions_lose_no_link(spark, monkeypatch):
    """Pairs of copies inside regions with far more nodes than are met as neighbours, over many blocks."""
    from trackloom.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 7)
    common = [f"c{k}" for k in range(150)]
    rows = [(2 * k + half, " ".join(common + [f"u{k}x{j}" for j in range(60)] + ["end"] * half)) for k in range(60) for half in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in group_near_duplicates(docs, n=4, neighbours=1).collect()}
    assert found == {k: k - k % 2 for k in range(120)}


def test_blocks_by_shingles_match_brute_force(spark, monkeypatch):
    """A large region with many pairs just below the threshold; blocks of few shingles, some of one long text."""
    from trackloom.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 2000)
    rng, base, rows = random.Random(8), [f"c{k}" for k in range(300)], []
    for k in range(90):
        own = list(base) + [f"l{k}x{j}" for j in range(rng.randrange(60))]
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = f"y{k}"
        rows.append((k, " ".join(own), None))
    rows.append((900, " ".join(f"z{k}" for k in range(20_000)), None))
    got = group_near_duplicates(spark.createDataFrame(rows, SCHEMA), n=4, neighbours=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def test_neighbours_meet_across_partitions(spark):
    """The pairs of a sorted region don't depend on where partitions begin."""
    from trackloom.llm import near_duplicates

    rng = random.Random(6)
    rows = [(k, bytes(rng.randrange(256) if rng.random() < 0.2 else 7 for _ in range(64)), k // 40, 5) for k in range(120)]
    table = spark.createDataFrame([(i, bytearray(s), tree, region, bytearray(s)) for i, s, tree, region in rows], "id long, sketch binary, tree int, region long, turned binary")
    found, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in (1, 5, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(tuple, near_duplicates._meet(table, 8).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for tree in range(3):
        ordered = sorted((s, i) for i, s, t, _ in rows if t == tree)
        for k, (s, i) in enumerate(ordered):
            want |= {(min(i, j), max(i, j)) for z, j in ordered[k + 1 : k + 9] if sum(x == y for x, y in zip(s, z, strict=True)) >= near_duplicates.MIN_AGREEING}
    assert found[0] == found[1] == found[2] and {(a, b) for a, b, _ in found[0]} == want and len(want) > 100
