"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full sets.

A document's set holds the distinct n-word shingles. Documents with equal sets are one node from
the start, and so are the texts of one id. A node's signature has 64 MinHash values. Each of the forest's 21 trees is a sorted
order over the signatures that begins with three values of its own (the root region) and goes on
through the others. The rows of all trees are range-partitioned by that order, so a region of any
size spreads over tasks, and each node meets the nodes that follow it in its region: all of them
where the region is small, and otherwise the ``neighbours`` with which it shares the longest
prefix, i.e. the depth adapts to the density of the region. A pair of similarity 0.8 misses all 21
root regions with probability 3e-7.

Candidates whose sketches (eight bits of each value) agree in fewer than 38 of 64 places are left
out. The rest is confirmed on full sets in two steps: first each node with its best candidate,
then every candidate that still lies between two components. So a group of n copies costs about n
comparisons of sets, and the links that are skipped join nodes that are connected already.

The neighbours met are no cap: in regions with more nodes than that, all pairs of nodes which still
lie in different components have their sketches compared, in blocks of about ``BLOCK_ROWS`` nodes
or ``BLOCK_SHINGLES`` shingles, and those that agree are confirmed on full sets in the same task,
which returns links only. Regions of one component, the usual case, have none.

Defined results: texts without words (null, empty) have empty sets and are linked with nothing;
fewer words than n are one shingle; rows with equal ids count as one document; rows with a null id
are members of their text's group (component null if no member has an id); repeated rows come out
as often as they came in; an empty table gives an empty table; other columns pass through
``mark_duplicates`` and are replaced where their names clash with added ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import at_most, hashed_words, join_spread, mix, ngram_hashes, settle, slices, without
from trackloom.operators.graph import components

VALUES, TREES, ROOT = 64, 21, 3
MIN_AGREEING = 38
#: Ids up to which the nodes to be compared are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Nodes and shingles in a block of a large region, about; a task compares two blocks at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 2000, 1_000_000

_A = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(_A)

_NODES = "id long, n_shingles long, key_a long, key_b long, regions array<long>, sketch binary"


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    words, firsts = hashed_words(texts)
    grams = ngram_hashes(words, n)
    for a, b in zip(firsts.tolist(), firsts[1:].tolist(), strict=False):
        yield np.unique(grams[a : b - n + 1]) if b - a >= n else ngram_hashes(words[a:b], b - a)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * _A + _B).min(axis=0), out=least)
    return least


def _measure(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sizes, digests, regions, sketches = [], [], [], []
            for found in shingle_sets(rows["text"], n):
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if not len(found):
                    regions.append(np.zeros(0, np.int64))
                    sketches.append(b"")
                    continue
                values = signature(found)
                roots = values[: TREES * ROOT].reshape(TREES, ROOT)
                regions.append(mix(mix(mix(roots[:, 0]) + roots[:, 1]) + roots[:, 2]).view(np.int64))
                sketches.append(((values >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes())
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, regions)]), pa.int32()), pa.array(np.concatenate(regions)))
            columns = [rows["id"], pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), listed, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _NODES.split(", ")])

    return run


def _pairs(rows: pd.DataFrame, width: int, old: int = 0) -> pd.DataFrame:
    """Nodes within ``width`` rows of each other in one region whose sketches agree; pairs of the first ``old`` rows
    are known, and so are those of one ``part`` if there is such a column."""
    part = rows["part"].to_numpy() if "part" in rows else np.arange(len(rows))
    root = rows["region"].to_numpy() ^ (rows["tree"].to_numpy(np.int64) << 58)
    ids, found = rows["id"].to_numpy(), [np.zeros((3, 0), np.int64)]
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, VALUES)
    for k in range(1, width + 1):
        at = np.flatnonzero(root[k:] == root[:-k])
        at = at[(at + k >= old) & (part[at] != part[at + k])]
        agree = (sketch[at] == sketch[at + k]).sum(axis=1)
        at, agree = at[agree >= MIN_AGREEING], agree[agree >= MIN_AGREEING]
        a, b = ids[at], ids[at + k]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b), agree])[:, a != b])
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b", "agree"])


_MET = "a long, b long, agree int, tree int, region long, turned binary, id long, sketch binary, part int"


def _neighbours(width: int):
    """Pairs of nodes near each other in sorted rows of (tree, region, turned, id, sketch), and the first and
    last ``width`` rows of the partition themselves, for the pairs across its edges."""
    edge = ["tree", "region", "turned", "id", "sketch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, None
        for batch in batches:
            whole = batch if last is None else pd.concat([last, batch], ignore_index=True)
            yield _pairs(whole, width, 0 if last is None else len(last)).reindex(columns=["a", "b", "agree", *edge, "part"])
            if first is None or len(first) < width:
                new = batch.head(width - (0 if first is None else len(first)))
                first = new if first is None else pd.concat([first, new], ignore_index=True)
            last = whole.tail(width)
        if last is not None:
            for rows in (first, last):
                yield rows.reindex(columns=["a", "b", "agree", *edge]).assign(part=TaskContext.get().partitionId())

    return run


def _across_edges(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pairs(rows.sort_values(["turned", "id"], ignore_index=True), width)

    return run


def _meet(rows: DataFrame, neighbours: int) -> DataFrame:
    """``a, b, agree``: nodes that meet as neighbours in some tree. Partitions of the sorted rows are ranges, so
    the rows at their edges (twice ``neighbours`` for each) meet once more, by region."""
    order = ["tree", "region", "turned", "id"]
    met = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours(neighbours), _MET))
    at = ["tree", "region"]
    edges = met.where("a IS NULL").select(*order, "sketch", "part").distinct()
    shared = edges.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*at)
    over = edges.join(shared, at, "left_semi").groupBy(*at).applyInPandas(_across_edges(neighbours), "a long, b long, agree int")
    both = met.where("a IS NOT NULL").select("a", "b", "agree").unionByName(over)
    return settle(both.groupBy("a", "b").agg(F.max("agree").alias("agree")))


def _across(percent: int):
    """Links between nodes of two blocks (or of one) in different components, confirmed on full sets.

    A pair is left to the first tree in which it shares a region, and to the links found before
    it, so a task returns fewer links than it has nodes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, _, i, j = key
        ids, block, of = rows["id"].to_numpy(), rows["block"].to_numpy(), rows["of"].to_numpy().copy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        sets = [flat[end - size : end] for end, size in zip(ends, sizes, strict=True)]
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, VALUES)
        earlier = np.stack(rows["regions"])[:, :tree]
        mark, right, found = np.zeros(len(distinct), bool), np.flatnonzero(block == j), []
        for one in np.flatnonzero(block == i):
            other = right[of[right] != of[one]]
            if i == j:
                other = other[other > one]
            other = other[100 * np.minimum(sizes[other], sizes[one]) >= percent * np.maximum(sizes[other], sizes[one])]
            other = other[(sketch[other] == sketch[one]).sum(axis=1) >= MIN_AGREEING]
            other = other[~(earlier[other] == earlier[one]).any(axis=1)]
            if not len(other):
                continue
            mark[sets[one]] = True
            starts = np.cumsum(sizes[other]) - sizes[other]
            both = np.add.reduceat(mark[np.concatenate([sets[k] for k in other])], starts, dtype=np.int64)
            mark[sets[one]] = False
            for k in other[100 * both >= percent * (sizes[other] + sizes[one] - both)]:
                if of[k] != of[one]:
                    found.append((ids[one], ids[k]))
                    of[of == of[k]] = of[one]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def _remaining(groups: DataFrame, known: DataFrame, texts: DataFrame, n: int, percent: int, neighbours: int) -> DataFrame:
    """Links that the neighbours left out: both ends in one large region, but in different components."""
    at = ["tree", "region"]
    rows = groups.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "n_shingles", F.posexplode("regions").alias(*at))
    large = settle(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where(F.col("n") > neighbours + 1))
    placed = join_spread(settle(rows), large, at).join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("of", F.coalesce("component", "id"))
    placed = settle(placed.select("id", "n_shingles", *at, "n", "weight", "of"))
    sizes = placed.groupBy(*at, "of").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), "of").alias("size"))
    mixed = settle(sizes.groupBy(*at).agg(F.max("size").alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    rows = settle(join_spread(placed, mixed, at))
    # the largest component's blocks come first and meet the other ones only
    blocks = lambda nodes, weight: F.ceil(F.greatest(nodes / BLOCK_ROWS, weight / BLOCK_SHINGLES))
    rows = rows.withColumns({"mains": blocks(F.col("main.n"), F.col("main.weight")), "others": blocks(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight"))})
    is_main = F.col("of") == F.col("main.of")
    own = F.when(is_main, F.pmod(F.xxhash64("id"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), "others"))
    first = F.when(is_main, F.col("mains")).otherwise(F.lit(0).cast("long"))
    met = rows.withColumns({"block": own, "other": F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1))})
    whole = groups.select(F.col("rep").alias("id"), "sketch", "regions").join(_sets_of(texts, rows.select("id").distinct(), n), "id")
    met = met.select("id", "of", "block", *at, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(whole, "id")
    return met.groupBy(*at, "i", "j").applyInPandas(_across(percent), "a long, b long")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found = [x.tobytes() for x in shingle_sets(rows["text"], n)]
            yield pa.RecordBatch.from_arrays([rows["id"], pa.array(found, pa.binary())], ["id", "shingles"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    held.append(False)
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                held.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[held, ["a", "b"]]

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(_compare(percent), "a long, b long").distinct()


def _sets_of(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Full sets of the nodes in ``ids``."""
    wanted = texts.join(F.broadcast(ids) if at_most(ids, BROADCAST_IDS) else ids, "id", "left_semi")
    return settle(wanted.mapInArrow(_sets(n), "id long, shingles binary").dropDuplicates())


def _same_document(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between an id whose rows have different texts and the nodes of these texts."""
    some = nodes.where("id IS NOT NULL AND n_shingles > 0")
    key = F.struct("key_a", "key_b")
    many = some.groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("id")
    named = some.join(many, "id", "left_semi").join(groups.select("key_a", "key_b", "rep"), ["key_a", "key_b"])
    return named.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()


def group_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, neighbours: int = 8) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    ``docs`` needs ``doc_id`` (long) and ``text``. Linked are documents with
    ``100 * |intersection| >= percent * |union|``, for 80 <= percent, which trees and sketches are made for
    (below, too many links would be missed)."""
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    nodes = settle(texts.mapInArrow(_measure(n), _NODES))
    groups = settle(
        nodes.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "regions", "sketch")])
    )
    rows = groups.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "sketch", F.posexplode("regions").alias("tree", "region"))
    turned = F.expr(f"concat(substring(sketch, 1 + {ROOT} * (tree + 1)), substring(sketch, 1, {ROOT} * (tree + 1)))")
    pairs = _meet(rows.withColumn("turned", turned), neighbours)

    sets = _sets_of(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), n)
    best = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
    first = settle(_confirm(pairs.withColumn("k", F.row_number().over(best)).where("k = 1"), sets, percent))
    known = components(first)
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)")
    links = settle(first.unionByName(_confirm(apart, sets, percent)).unionByName(_same_document(nodes, groups)))
    known = components(links)
    rest = settle(_remaining(groups, known, texts, n, percent, neighbours))
    if not rest.isEmpty():
        known = components(links.unionByName(rest))

    merged = groups.join(known, F.col("rep") == F.col("node"), "left").select("key_a", "key_b", F.coalesce("component", "rep").alias("root"))
    # copies, of which a key may have a third of all, are spread
    some = join_spread(nodes.where("n_shingles > 0"), settle(merged), ["key_a", "key_b"])
    placed = some.unionByName(nodes.where("n_shingles = 0").withColumn("root", F.lit(None).cast("long")))
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("root"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        own.alias("component_id"),
        (own.isNull() | F.col("id").eqNullSafe(own)).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the least id of each group, once however often it is
    repeated (of different texts the one of least hash), and all rows with a null id."""
    found = group_near_duplicates(docs, **options)
    ids = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    stay = docs.join(ids.where("__kept"), F.col("doc_id") == F.col("__id"))
    once = stay.where("__n = 1").select(*docs.columns)
    least = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    repeated = stay.where("__n > 1").withColumn("__place", F.row_number().over(least)).where("__place = 1").select(*docs.columns)
    return once.unionByName(repeated).unionByName(docs.where("doc_id IS NULL"))


def mark_duplicates(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` with ``component_id`` and ``kept`` (joined by id; null ids stay kept)."""
    found = group_near_duplicates(docs, **options).where("doc_id IS NOT NULL")
    found = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("component_id"), F.max("kept").alias("kept"))
    docs = without(docs, "component_id", "kept")
    joined = docs.join(found, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return joined.withColumn("kept", F.coalesce("kept", F.lit(True)))
