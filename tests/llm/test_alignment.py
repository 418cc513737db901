"""Aligned tokenizers against both libraries over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trackloom.llm import alignment, registry
from trackloom.llm.byte_pairs import byte_letters

LETTERS = {c: k for k, c in enumerate(byte_letters())}


def brute(texts):
    """The contract's columns for each text, from whole encodings."""
    a_side = Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer("piece_bpe_32k.model"))
    a_name = {k: t for t, k in a_side.get_vocab().items()}
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        spell_a = [bytes(LETTERS[c] for c in a_name[x]) for x in a]
        spell_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_side.id_to_piece(x)]]
        whole = (" " + text).encode()
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            found.append(None)
            continue
        ends = [set(), set()]
        marks = [[], []]
        for side, spelled in enumerate((spell_a, spell_b)):
            at = 0
            for s in spelled:
                at += len(s)
                ends[side].add(at)
                marks[side].append(at)
        both = sorted(ends[0] & ends[1])
        groups, links, start = [], [], 0
        for end in both:
            inside = [[x for x, m in zip(ids, ms, strict=True) if start < m <= end] for ids, ms in zip((a, b), marks, strict=True)]
            groups.append(inside)
            links.append((inside[0][-1], inside[1][-1]))
            start = end
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


FILES = [registry.tokenizer(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def run(spark, texts, files=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, *FILES[:files]).collect()}
    return [got[k] for k in range(len(texts))]


def test_whole_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows])


@pytest.mark.parametrize("files", [2, 3])
def test_any_text(spark, files):
    rng = random.Random(1)
    units = [" ", "  ", "\n", "\t", " ", "　", "▁", "a", "the", "'s", "’", "12", "é", "汉字", "😀", "</s>", "<0x41>", "<|endoftext|>", ".", "--", "x" * 40, "́", "\x00", "\r\n", "ﬁ"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    texts += [None, "", " ", "   ", "a ", " a", "\n", "the cat  sat", "the cat  sat", "汉" * 3000, "x" * 5000, "word " * 2000]
    assert run(spark, texts, files) == brute(texts)


@pytest.mark.parametrize("shares", [3, 10**6])
def test_hot_ids_are_dealt_out(spark, monkeypatch, shares):
    monkeypatch.setattr(alignment, "SHARES", shares)
    texts = [f"of the {w} and the {w}" for w in ("cat", "hats", "zebra", "of") for _ in range(40)]
    assert run(spark, texts) == brute(texts)


def test_edges(spark):
    files = registry.tokenizer("byte_bpe_50k.json"), registry.tokenizer("piece_bpe_32k.model")
    rows = [(None, "a b", 1, 2), (None, "a b", 1, 2), (2**60, None, 1, 2), (5, "▁", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, n_a int")
    got = alignment.align(docs, *files).collect()
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in got) == [("1152921504606846976", 0, 0), ("5", 0, 0), ("None", 2, 4), ("None", 2, 4)]
    assert alignment.align(docs.limit(0), *files).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    own = alignment.Aligner(registry.tokenizer("byte_bpe_50k.json"), registry.tokenizer("piece_bpe_32k.model"))
    for text in ("a b c", "d e f g h", "a b i"):
        assert list(own.documents([text, text]))[0][0] == len(text.split())
        assert len(own.known) <= 8
