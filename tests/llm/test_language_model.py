import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import language_model
from trackloom.llm.language_model import CUTOFF, discounts, score

SCHEMA = "doc_id long, text string, history string"


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1



def brute(rows):
    docs = []
    for i, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]
        docs.append((i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, words))
    uni, pairs = Counter(), Counter()
    for _, held, words in docs:
        if not held:
            uni.update(words)
            pairs.update(zip(["<s>", *words], words, strict=False))
    n, v, seen = sum(uni.values()), len(uni), Counter()
    by = defaultdict(list)
    for (h, w), c in pairs.items():
        seen[h] += c
        by[h].append((w, c))
    d1, d2 = (discounts([sum(x == r for x in c.values()) for r in range(1, CUTOFF + 2)]) for c in (uni, pairs))
    cut = lambda d, c: c * (d[c] if c <= CUTOFF else 1.0)
    spent = sum(cut(d1, c) for c in uni.values()) / (n + 1)
    one = lambda w: cut(d1, uni[w]) / (n + 1) if w in uni else 1 - spent

    def two(h, w):
        if (h, w) in pairs:
            return cut(d2, pairs[h, w]) / (seen[h] + 1)
        if not seen[h]:
            return one(w)
        left = 1 - sum(cut(d2, c) for _, c in by[h]) / (seen[h] + 1)
        return left / (1 - sum(one(x) for x, _ in by[h])) * one(w)

    out = {}
    for i, held, words in docs:
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i] = (held, len(words), sum(w in uni for w in words), n, base, sum(math.log10(two(h, w)) for h, w in zip(["<s>", *words], words, strict=False)))
    totals = [sum(two(h, w) for w in [*uni, None]) for h in [*by, "never"]]
    return out, totals


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(60))).title(), "x") for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "chunk"), [(1, 300, 2000), (2, 12, 50)])
def test_matches_brute_force(spark, seed, n, chunk):
    rows = [*corpus(seed, n), (1001, None, None), (1002, "", None), (None, "w1 w2", None)]
    want, totals = brute(rows)
    assert totals == pytest.approx([1.0] * len(totals))
    got = score(spark.createDataFrame(rows, SCHEMA), held(), chunk_tokens=chunk, range_keys=500).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(2, "a b", None)] * 3, SCHEMA)
    assert len({tuple(r) for r in score(df, held()).collect()}) == 1 and score(df, held()).count() == 3
    assert score(df.limit(0), held()).count() == 0
    alone = score(df, F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.score == 0


def test_packed_keys_come_back():
    import numpy as np

    keys = np.array([0, 1, 5, 2**40, 2**63, 2**64 - 1], np.uint64)
    assert (language_model._unpack(language_model._pack(keys)) == keys).all()
    counts = np.array([0, 127, 128, 2**40])
    assert (language_model._wide(language_model._slim(counts)) == counts).all()


def katz(n):
    """Factors from a least-squares line through log n_r, in plain Python."""
    k = CUTOFF
    xs, ys = [math.log(r) for r in range(1, k + 2)], [math.log(x) for x in n]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    b = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    smooth = [None, *(math.exp(my + b * (x - mx)) for x in xs)]
    top = (k + 1) * smooth[k + 1] / smooth[1]
    return [1.0, *(((r + 1) * smooth[r + 1] / (r * smooth[r]) - top) / (1 - top) for r in range(1, k + 1))]


@pytest.mark.parametrize(
    "n",
    [
        [200420, 57120, 23804, 13644, 12859, 6775],  # words of sf0.1: the raw formula gives 1.223 for r = 4
        [1482341, 227973, 46941, 19718, 17404, 6993],  # its pairs: 1.106
        [3600, 900, 400, 225, 144, 100],  # on a power law already: fitted and raw counts agree
    ],
)
def test_discounts_are_good_turing(n):
    got = list(discounts(n))
    assert got == pytest.approx(katz(n)) and all(0 < x < 1 for x in got[1:]) and got[1:] == sorted(got[1:])
    assert got != pytest.approx([1.0, *((r - 0.5) / r for r in range(1, CUTOFF + 1))])
    if n[0] == 3600:
        top = 6 * n[5] / n[0]
        assert got[1:] == pytest.approx([((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, CUTOFF + 1)])


@pytest.mark.parametrize("n", [[0] * 6, [9, 0, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1], [1, 0, 0, 7, 0, 3], [0, 0, 0, 0, 5, 900], [10**12, 1, 0, 0, 0, 0]])
def test_discounts_hold_for_any_counts(n):
    got = discounts(n)[1:]
    assert all(0 < x < 1 for x in got) and list(got) == sorted(got)
    steeper = [discounts([10**6, 10**6 // 2 - d, *(10**6 // r for r in range(3, 7))])[1:] for d in (0, 10)]
    assert steeper[0] == pytest.approx(steeper[1], abs=1e-4)  # no jump where the power passes -1


def test_scores_take_the_good_turing_factors(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(1.0))}" for _ in range(30)), None) for i in range(80)]
    monkeypatch.setitem(brute.__globals__, "discounts", katz)
    want, _ = brute(rows)
    got = score(spark.createDataFrame(rows, SCHEMA), held()).collect()
    assert [r.score for r in got] == pytest.approx([want[r.doc_id][5] for r in got], rel=1e-9)
