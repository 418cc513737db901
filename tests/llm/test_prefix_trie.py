"""The prefix trie against plain Python, and its edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trackloom.llm import prefix_trie

CONVERSATION = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, sha(sha(role or "") + sha(text or "")), role or "", text or ""))
    for c in turns:
        turns[c] = [t[3:] for t in sorted(turns[c])]
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def run(spark, rows):
    got = prefix_trie.build_trie(spark.createDataFrame(rows, CONVERSATION).repartition(7)).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got)


@pytest.mark.parametrize("most, run_size, fan", [(3, 2, 2), (100_000, 50_000, 32)])
def test_against_plain_python(spark, monkeypatch, most, run_size, fan):
    monkeypatch.setattr(prefix_trie, "RUN", run_size)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "MOST_NODES", most)
    rng = random.Random(most)
    rows = []
    for c in range(300):
        if rng.random() < 0.1:
            continue
        rows += [(c, rng.choice([k, k, 0, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "c d e", "", None])) for k in range(rng.choice([1, 2, 3, 9]))]
    rows += [(1000 + c, k, "user", "same words here") for c in range(50) for k in range(40)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    # a conversation may be left without turns: its own ones go and there are none to take their place
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "x"), (None, 0, "user", "y"), (2**60, 0, None, None), (2**60, 0, None, None), (2**60, None, "é", "w " * 100_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[0][:5] == (lone, 0, -1, 2, 1)


def test_partial_tries_hold_few_nodes(monkeypatch):
    turns = [(bytes([k]) * 32, 1) for k in range(100)]
    convs = [(c, iter(turns)) for c in range(4)]
    rows = list(prefix_trie.partial_tries(iter(convs), most=10))
    assert sum(r[4] for r in rows) == 4 * 101 and len({r[0] for r in rows}) == 101
    assert [len(r[2]) for r in rows[:5]] == [0, 1, 2, 2, 3]
