"""Sharding, packing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from trackloom.llm import packing, secrets, sharding
from trackloom.llm.registry import tokenizer

DOCS = "doc_id long, text string, Shard string"


@pytest.mark.parametrize("n", [0, 5, 997])
def test_shards(spark, n):
    rows = [(i if i % 7 else None, f"text {i % 50}" if i % 11 else None, "x") for i in range(n)] + [(1, "same", "y")] * (n // 2)
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, DOCS), n_shards=24).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, (r[:2] for r in rows)))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_uniform_and_repeatable(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(2400)], "doc_id long, text string")
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs.repartition(7)).collect()}
    assert first == again
    halves = Counter(first[i][0] for i in range(1200))  # 50 expected in each
    assert all(25 <= halves[s] <= 75 for s in range(24))


def test_matrix_has_the_margins():
    matrix = sharding.communication_matrix([10, 0, 35, 7], 6, seed=3)
    assert [sum(r) for r in matrix] == [10, 0, 35, 7]
    assert [sum(c) for c in zip(*matrix, strict=True)] == [9, 9, 9, 9, 8, 8]
    draws = Counter(sharding.hypergeometric(random.Random(k), 3, 4, 3) for k in range(20000))
    for k, want in enumerate((4, 18, 12, 1)):
        assert abs(draws[k] / 20000 - want / 35) < 0.015


def test_plan_places_every_piece():
    rng = random.Random(2)
    for capacity, n in ((2048, 5000), (64, 300), (16, 1)):
        lengths = Counter(min(capacity, 1 + int(rng.lognormvariate(np.log(capacity) - 1.3, 1))) for _ in range(n))
        runs, total = packing.plan(dict(lengths), capacity, groups=16)
        places, numbers = defaultdict(list), defaultdict(list)
        for length, first, count, sequence, offset in runs:
            numbers[length] += range(first, first + count)
            for k in range(count):
                places[sequence + k].append((offset, length))
        assert all(sorted(v) == list(range(lengths[x])) for x, v in numbers.items()) and set(numbers) == set(lengths)
        assert sorted(places) == list(range(total))
        for used in places.values():
            at = 0
            for offset, length in sorted(used):
                assert offset == at
                at += length
            assert at <= capacity
        assert total <= 1.06 * -(-sum(a * b for a, b in lengths.items()) // capacity) + 1
    assert packing.plan({}, 2048) == ([], 0)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    path, rng = tokenizer("word_bpe_49k.json"), random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "Beta's", "漢字", "été", "x1y", "<|endoftext|>", "a b", "\x1c"]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    rows = [*enumerate(texts), (70, None), (71, ""), (None, "null id"), (72, "same text"), (72, "same text"), (73, "long " * 500)]
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    got = packing.pack(docs, path, capacity=128, with_ids=True).collect()
    library, whole = Tokenizer.from_file(path), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (len(ids), zlib.crc32(r.ids)) == (r.length, r.ids_crc32) and r.start == 128 * r.piece
        whole[r.doc_id].append((r.start, ids.tolist()))
    for i, text in rows:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        have = sum((ids for _, ids in sorted(whole[i])), [])
        assert have == want if i != 72 else len(have) == 2 * len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for used in by.values():
        used.sort()
        assert [o for o, _ in used] == [sum(n for _, n in used[:k]) for k in range(len(used))] and sum(n for _, n in used) <= 128
    assert packing.pack(docs.limit(0), path).count() == 0


def test_pipeline_against_its_rules(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen.append((name, docs.columns, docs.collect()))
    counts = [len(rows) for *_, rows in seen]
    assert 200 > counts[0] > counts[1] >= counts[2] == counts[3] > 100
    assert all(c == columns for _, c, _ in seen[:-1])
    ids = [{r.doc_id for r in rows} for *_, rows in seen]
    assert ids[4] == ids[3] == ids[2] <= ids[1] <= ids[0] and len(ids[1]) == counts[1]
    before = {r.doc_id: r.text for r in seen[2][2]}
    for r in seen[3][2]:
        assert r.n_chars == len(r.text) and ("[secret]" in r.text) == bool(secrets.Scanner().spans(before[r.doc_id]))
    assert {(r.doc_id, r.piece) for r in seen[4][2]} == {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf_dir).collect()}
