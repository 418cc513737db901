"""Words made to collide under a polynomial hash, and long pre-tokens: the operators against the libraries."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trackloom.llm import importance, language_model, near_duplicates, packing, registry, repeats, token_counts
from trackloom.llm.common import Known, segment_digests

DOC = "doc_id long, text string"


def pair(n, letters="ab"):
    """Two words of ``n`` letters with equal polynomial hashes modulo 2^64 for any base and letters (n >= 1024)."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_colliding_words(spark, n):
    one, two = pair(n)
    docs = spark.createDataFrame([(2, one), (5, two)], DOC)
    assert {r.component_id for r in near_duplicates.group_near_duplicates(docs, n=4).collect()} == {2, 5}
    byte_level = Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, registry.tokenizer("byte_bpe_50k.json")).collect()}
    assert counts == {k: len(byte_level.encode(t, add_special_tokens=False).ids) for k, t in ((2, one), (5, two))}
    word_level = Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json"))
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, registry.tokenizer("word_bpe_49k.json")).collect()}
    assert packed == {k: zlib.crc32(np.array([*word_level.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in ((2, one), (5, two))}
    scored = {r.doc_id: r.n_known for r in language_model.score(docs, docs["doc_id"] == 5).collect()}
    assert scored == {2: 2, 5: 1}
    ids, of = importance.features(pa.array([one, two]), 1 << 30)
    assert len(set(ids.tolist())) == 2
    words = " ".join(["x%d" % k for k in range(60)])
    same = spark.createDataFrame([(1, f"{words} {one}"), (2, f"{words} {two}")], DOC)
    found = repeats.find_repeats(same, min_words=1, passage_words=50).collect()
    assert found and all(r.doc_id == 2 and r.span_end <= len(words) for r in found)


def test_digests_tell_segments_apart():
    rng = random.Random(2)
    words = list({bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 40))) for _ in range(20_000)} | {b"\x00" * k for k in range(1, 600)})
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    one, two = segment_digests(data, ends - sizes, ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    again = segment_digests(np.frombuffer(b"?" + words[5] + b"?", np.uint8), np.array([1]), np.array([1 + len(words[5])]))
    assert (again[0][0], again[1][0]) == (one[5], two[5])


def test_equal_hashes_with_other_checks_are_apart():
    known = Known(4)
    hashes, checks = np.array([7, 7, 7, 23], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert known.look_up(hashes, lambda at: np.array([10 * k for k in at], np.int32), checks).tolist() == [0, 10, 0, 30]
    assert known.look_up(hashes[:1], lambda at: np.array([99], np.int32), np.array([3], np.uint64)).tolist() == [99]


rng = random.Random(7)
LONG = {
    "ideographs": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) + ("。" if k % 30 == 29 else "") for k in range(330_000)),
    "unbroken ideographs": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(330_000)),
    "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)),
    "base64": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000)),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_pre_tokens(kind):
    text = LONG[kind]
    began = time.process_time()
    count = token_counts.Counter(registry.tokenizer("byte_bpe_50k.json")).count(pa.array([text]))
    took = time.process_time() - began
    assert count.tolist() == [len(Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)]
    began = time.process_time()
    ids, _ = packing.WordIds(registry.tokenizer("word_bpe_49k.json")).encode(pa.array([text]), 0)
    packed = time.process_time() - began
    assert ids[:-1].tolist() == Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    print(f"{kind}: op8 {took:.1f} s, op9 {packed:.1f} s of CPU for {len(text.encode()) / 1e6:.1f} MB, vocabularies' reading included")
    assert took < 15 and packed < 15
