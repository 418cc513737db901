"""op2's shards and slots recomputed in plain Python over a whole table."""

import math
import zlib

import duckdb
import pytest
import xxhash

from trackloom.llm import sharding
from trackloom.llm.registry import op2_sharding

SF = "/root/testdata/sf0.001"


def chained(*values):
    """Spark's xxhash64: each value's bytes under the hash of those before; signed."""
    h = 42
    for value, size in values:
        h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def ranks(keys, pieces):
    """The place of each key by its piece, then itself."""
    order = sorted(keys, key=lambda k: ((k >> 24) % pieces, k))
    return {k: n for n, k in enumerate(order)}


@pytest.mark.parametrize("piece_rows", [4096, 2])
def test_shards_and_slots(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(sharding, "PIECE_ROWS", piece_rows)
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    key = {}
    for i, text in docs:
        data = text.encode()
        key[i] = chained((17, 4), (i, 8), (len(data) + 8, 8), (zlib.crc32(data), 8))
    blocks = [[] for _ in range(64)]
    for k in key.values():
        blocks[k % 64].append(k)
    matrix = sharding.communication_matrix([len(b) for b in blocks], 24, 17)
    pieces = max(1, math.ceil(len(docs) / 64 / piece_rows))
    shard = {}
    for block, row in zip(blocks, matrix, strict=True):
        ends = [sum(row[: s + 1]) for s in range(24)]
        for k, n in ranks(block, pieces).items():
            shard[k] = sum(e <= n for e in ends)
    again = {k: chained((18, 4), (k, 8)) for k in key.values()}
    pieces = max(1, math.ceil(len(docs) / 24 / piece_rows))
    slot = {}
    for s in range(24):
        own = {again[k]: k for k in shard if shard[k] == s}
        slot |= {own[k]: n for k, n in ranks(own, pieces).items()}
    got = {r.doc_id: (r.shard, r.slot) for r in op2_sharding(spark, SF).collect()}
    assert got == {i: (shard[k], slot[k]) for i, k in key.items()}


def test_maps_anywhere_in_a_column(spark):
    docs = spark.range(40).selectExpr("id", "map('a', id) AS m", "named_struct('m', map(1, id)) AS s", "array(map('k', id)) AS l", "parse_json(concat('[', id, ']')) AS v")
    got = sharding.shuffle_into_shards(docs, 3).select("id", "shard", "slot").collect()
    assert sorted(r.id for r in got) == list(range(40))
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate((14, 13, 13)) for k in range(n)]
