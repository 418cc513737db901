"""Shared prefixes of conversations as a trie, merged from partial tries.

A turn is known by the SHA-256 of its role and text, and a node by a 128-bit hash of its parent's and
its turn's, so nothing but digests is shuffled. Conversations are dealt by ranges of their ids and
pass through in order; each task keeps a partial trie of those it has seen (members, the least one,
and the ends that fall on each node) and emits it whenever it holds ``most`` nodes. Partial tries are
merged by node, over ever larger groups of ranges, so a node that every conversation passes is summed
from a few rows at a time. A path of ``2^k`` steps up is known when a node is made, so the bottom-up
roll-up takes a number of rounds logarithmic in the greatest depth: after round k each node holds the
sums of its subtree down to ``2^k`` steps.

Ends on a node are ids in runs, which the ranges keep in order; a node's digest takes them from a
sorted stream, so a node on which a third of all conversations end needs no more memory than others.

Defined results: null roles and texts are empty; rows without an id belong to no conversation and
are left out; equal turns of one conversation are ordered by their digest; repeated rows are turns of
their own; an empty table gives an empty trie (no rows); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import join_spread, settle

#: Nodes that a partial trie holds at most, ids in a run of ends at most, and ranges merged at once.
MOST_NODES, RUN, FAN = 100_000, 50_000, 32
ROOT = bytes(16)
_NODES = "node binary, depth long, ups array<binary>, conv_id long, n_convs long, words long, ends array<long>"
_SCHEMA = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("ups", pa.list_(pa.binary())), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))])


def rebuild(conversations: DataFrame, family: int = 20, most_shared: int = 4) -> DataFrame:
    """``conv_id, idx, turn_hash, words``: each conversation's turns after its first h, behind the first h
    of the conversation ``conv_id - conv_id % family`` (h: crc32 of the id modulo ``most_shared``), and a
    row of index 0 for the conversation itself."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.sha2(F.concat(F.sha2(whole("role"), 256), F.sha2(whole("text"), 256)), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.regexp_count(whole("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "said")
    own = settle(turns.select("conv_id", F.row_number().over(order).alias("idx"), F.unhex("said").alias("turn_hash"), "words"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int")
    all_ids = own.where("idx = 1").select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    # at most family x (most_shared - 1) rows for a head
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("idx") < most_shared)).select(F.col("conv_id").alias("first"), "idx", "turn_hash", "words")
    taken = all_ids.join(heads, "first").where("idx <= h").select("conv_id", "idx", "turn_hash", "words")
    nothing = all_ids.select("conv_id", F.lit(0).alias("idx"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("words"))
    return nothing.unionByName(taken).unionByName(own.where(F.col("idx") > shared))


def partial_tries(conversations: Iterator[tuple[int, Iterator[tuple[bytes, int]]]], most: int = MOST_NODES) -> Iterator[tuple]:
    """Rows of partial tries: node, depth, nodes 1, 2, 4, ... steps up, least member, members, words and a run of ends.

    ``conversations``: ids in ascending order, with the digests and words of their turns. The hashes of
    one conversation's path, 16 bytes for a turn, are held while it passes."""
    nodes: dict[bytes, list] = {}
    held = 0

    def rows() -> Iterator[tuple]:
        for key, (depth, ups, conv, n, words, ends) in nodes.items():
            yield key, depth, ups, conv, n, words, ends[:RUN]
            for k in range(RUN, len(ends), RUN):
                yield key, depth, ups, conv, 0, words, ends[k : k + RUN]
        nodes.clear()

    for conv, turns in conversations:
        path, words = [ROOT], 0
        while True:
            node = nodes.get(path[-1])
            if node is None:
                ups = [path[-1 - (1 << k)] for k in range((len(path) - 1).bit_length())]
                node = nodes[path[-1]] = [len(path) - 1, ups, conv, 0, words, []]
                held += 1 + len(ups) // 4
            node[3] += 1
            said, words = next(turns, (None, 0))
            if said is None:
                break
            if held >= most:
                yield from rows()
                held = 0
            path.append(hashlib.blake2b(path[-1] + said, digest_size=16).digest())
        node[5].append(conv)
        held += 1
    yield from rows()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tries of a task's conversations, whose rows (``conv_id, idx, turn_hash, words``) are sorted."""
    seen = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("conv_id", "turn_hash", "words")), strict=True))
    # the first row of each conversation is its own, without a turn
    convs = ((conv, ((said, words) for _, said, words in rows if said is not None)) for conv, rows in groupby(seen, key=lambda r: r[0]))
    held, ends = [], 0
    for row in partial_tries(convs, MOST_NODES):
        held.append(row)
        ends += len(row[-1])
        if len(held) == 10_000 or ends >= 10 * RUN:
            yield _batch(held, _SCHEMA)
            held, ends = [], 0
    if held:
        yield _batch(held, _SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def merge(partials: DataFrame, parts: int) -> DataFrame:
    """One row for each node, from partial tries numbered by ``part``, ``FAN`` of them at a time."""
    sums = [F.first(c).alias(c) for c in ("depth", "ups", "words")] + [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    table = partials.select("node", "depth", "ups", "words", "conv_id", "n_convs", "part")
    while parts > FAN:
        parts = -(-parts // FAN)
        table = table.groupBy("node", F.floor(F.col("part") / FAN).alias("part")).agg(*sums)
    return table.groupBy("node").agg(*sums)


def _up(table: DataFrame, steps: int, sums: dict[str, str]) -> DataFrame:
    """Each node's ``sums`` (name: what it takes from the node ``2^steps`` below) added to by those below it."""
    own = F.struct("node", F.struct(*[c for c in table.columns if c not in ("node", *sums)]).alias("info"), *[F.col(c) for c in sums])
    nothing = F.lit(None).cast(dict(table.select(own.alias("x")).select("x.info").dtypes)["info"])
    above = F.struct(F.get("ups", F.lit(steps)).alias("node"), nothing.alias("info"), *[F.expr(e).cast("long").alias(c) for c, e in sums.items()])
    both = table.select(F.explode(F.array(own, above)).alias("x")).select("x.*").where("node IS NOT NULL")
    return both.groupBy("node").agg(F.first("info", ignorenulls=True).alias("info"), *[F.sum(c).alias(c) for c in sums]).select("node", "info.*", *sums)


def roll_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """Adds ``n_children``, and ``n_leaves`` and ``saved_tokens`` of the subtrees."""
    table = _up(nodes.withColumn("n_children", F.lit(0).cast("long")), 0, {"n_children": "1"})
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    table = table.withColumns({"n_leaves": leaf, "saved_tokens": saved}).drop("words")
    for k in range(deepest.bit_length()):
        table = _up(table, k, {"n_leaves": "n_leaves", "saved_tokens": "saved_tokens"})
    return table


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = (row for b in batches for row in zip(b["node"].to_pylist(), b["ends"], strict=True))
    held: list[tuple] = []
    for node, group in groupby(runs, key=lambda r: r[0]):
        digest, first = hashlib.sha256(), True
        for _, run in group:
            digest.update(("" if first else ",").encode() + ",".join(map(str, run.as_py())).encode())
            first = False
        held.append((node, digest.hexdigest()))
        if len(held) == 10_000:
            yield _batch(held, _ENDS)
            held = []
    if held:
        yield _batch(held, _ENDS)


_ENDS = pa.schema([("end_node", pa.binary()), ("sha", pa.string())])


def build_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    ``conversations`` has ``conv_id, turn, role, text``."""
    rows = rebuild(conversations).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "idx")
    partials = settle(rows.select("conv_id", "turn_hash", "words").mapInArrow(_build, _NODES).withColumn("part", F.spark_partition_id()))
    parts, deepest = partials.agg(F.coalesce(F.max("part") + 1, F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    nodes = settle(roll_up(merge(partials, parts), deepest).withColumn("up", F.get("ups", F.lit(0))).drop("ups"))
    runs = partials.where(F.size("ends") > 0).select("node", "ends", F.get("ends", F.lit(0)).alias("least"))
    sorted_runs = runs.repartition("node").sortWithinPartitions("node", "least").select("node", "ends")
    ends = sorted_runs.mapInArrow(_hash_ends, "end_node binary, sha string")
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    below = join_spread(nodes.where("up IS NOT NULL"), parents, ["up"])
    top = nodes.where("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    placed = below.unionByName(top).join(ends, F.col("node") == F.col("end_node"), "left")
    none = hashlib.sha256().hexdigest()
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
