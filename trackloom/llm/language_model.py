"""Katz backoff language model: learned from and applied to whole tables.

Order two. A word pair seen in training has its Good-Turing discounted relative frequency; any
other pair has the backoff weight of its history times the word's own probability, which is again
discounted, the rest going to one class of unknown words. Histories hold one count more than were
seen, so a backoff weight is never zero, and weights are the exact quotients that make each
history's probabilities sum to one.

Corpus statistics are tables, never the driver's. Texts are read once, into chunks of some
``chunk_tokens`` tokens kept as numbers of the chunk's own words. Each chunk sends its distinct
words and pairs, hashed to 64 bits and cut by hash ranges, with its training counts; the task of a
range adds them up and answers every chunk with the totals, in the order asked. One chunk is told
that it owns a pair, and adds the pair to its history's sums, so each pair counts once. Backoff
weights come from these sums by one aggregation, and join the (document, history) rows that backed
off; a common history backs off in nearly every document, so histories with a thousandth of these
rows are broadcast (a thousand at most). A frequent word is one entry for each chunk. The number of ranges grows with
the tokens, up to 32,768; beyond (some terabytes of text) ranges grow instead, and larger chunks
are called for.

Counts of counts are smoothed first, by a power law fitted to their logarithms as in Simple
Good-Turing, and Katz's formula takes the fitted values; so one law holds at every size, and its
factors always lie between 0 and 1. Where the fit falls no faster than 1/r, Katz's factors have
their limit at 1/r; with fewer than two counts to fit, the power is -2 (Zipf). Defined results: a null or empty text is its end token; a null id hashes as
empty text and so counts as training; repeated rows count each time; an empty table gives no rows;
without training documents every token is unknown, with probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import hashed_words, join_spread, mix, settle, slices

#: Neither is a word's hash, but by a chance of 2**-64.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" "))
#: Counts up to which Good-Turing discounts apply.
CUTOFF = 5
MAX_RANGES = 1 << 15
#: Documents after which a chunk ends whatever its tokens; rows are numbered by ``ROW_BITS`` bits within one.
MOST_DOCS, ROW_BITS = 1 << 20, 21

#: ``doc_ids`` and ``lengths``: 64-bit numbers; ``null_ids`` and ``held``: a bit for each document.
_CHUNKS = "chunk long, doc_ids binary, null_ids binary, held binary, lengths binary, vocab binary, tokens binary"
_ASKED = "kind int, bucket int, chunk long, keys binary, counts binary"
_ANSWERS = "kind int, bucket int, chunk long, totals binary, owned binary, stats array<long>"
_FOUND = (
    "kind int, row long, doc_id long, held boolean, n_tokens long, n_known long, base_score double, "
    "part double, history long, n long, mass double, lower_mass double, seen long"
)
WORDS, PAIRS = 1, 2
DOC, EVENT, SUMS = 0, 1, 2


def _chunks(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, docs, made, held = TaskContext.get().partitionId(), 0, 0, 0, []

        def chunk() -> pa.RecordBatch:
            ids = pa.concat_arrays([r["doc_id"] for r, *_ in held])
            vocab, tokens = np.unique(np.concatenate([t for _, t, _ in held]), return_inverse=True)
            values = {
                "chunk": part << 20 | made,
                "doc_ids": pc.fill_null(ids, 0).to_numpy().tobytes(),
                "null_ids": np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                "held": np.packbits(pa.concat_arrays([r["held"] for r, *_ in held]).to_numpy(zero_copy_only=False)).tobytes(),
                "lengths": np.concatenate([n for *_, n in held]).astype(np.int64).tobytes(),
                "vocab": vocab.tobytes(),
                "tokens": tokens.astype(np.int32).tobytes(),
            }
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == "chunk" else pa.binary()) for k, v in values.items()], list(values))

        for rows in slices(batches):
            words, firsts = hashed_words(rows["text"])
            held.append((rows, np.insert(words, firsts[1:], END), np.diff(firsts) + 1))
            size, docs = size + len(held[-1][1]), docs + len(rows)
            if size >= chunk_tokens or docs >= MOST_DOCS:
                yield chunk()
                size, docs, made, held = 0, 0, made + 1, []
        if held:
            yield chunk()

    return run


class _Chunk:
    """One chunk's arrays: tokens, histories and distinct pairs."""

    def __init__(self, row):
        self.vocab = np.frombuffer(row.vocab, np.uint64)
        self.tokens = np.frombuffer(row.tokens, np.int32)
        self.lengths = np.frombuffer(row.lengths, np.int64)
        self.held = np.unpackbits(np.frombuffer(row.held, np.uint8), count=len(self.lengths)).astype(bool)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]
        self.history = np.roll(self.tokens, 1)
        self.history[self.first] = len(self.vocab)  # stands for the beginning
        self.names = np.append(self.vocab, BEGIN)
        keys = mix(mix(self.names[self.history]) + self.vocab[self.tokens])
        self.pairs, self.at, self.pair = np.unique(keys, return_index=True, return_inverse=True)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as gaps of as many bytes as the widest one needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, packed[0])
    wide = np.zeros((len(gaps), 8), np.uint8)
    wide[:, : packed[0]] = gaps
    return np.cumsum(wide.view(np.uint64).reshape(-1), dtype=np.uint64)


def _slim(counts: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<i{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def _ask(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = _Chunk(row)
                for kind, keys, of in ((WORDS, own.vocab, own.tokens), (PAIRS, own.pairs, own.pair)):
                    counts = np.bincount(of[own.train], minlength=len(keys))
                    edges = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys)), np.arange((1 << bits) + 1))
                    full = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
                    yield pd.DataFrame(
                        {
                            "kind": kind,
                            "bucket": full,
                            "chunk": row.chunk,
                            "keys": [_pack(keys[edges[b] : edges[b + 1]]) for b in full],
                            "counts": [_slim(counts[edges[b] : edges[b + 1]]) for b in full],
                        }
                    )

    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    asked = asked.sort_values("chunk")
    keys = [_unpack(k) for k in asked["keys"]]
    counts = np.concatenate([_wide(c) for c in asked["counts"]])
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(at, counts).astype(np.int64)
    owned = np.zeros(len(at), bool)
    owned[first] = True
    edges = np.cumsum([0, *map(len, keys)])
    parts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    stats = [int((totals == r).sum()) for r in range(1, CUTOFF + 2)] + [int(totals.sum()), int((totals > 0).sum())]
    n, known = len(asked) + 1, {"kind": asked["kind"].iloc[0], "bucket": asked["bucket"].iloc[0]}
    return pd.DataFrame(
        {
            "chunk": [*asked["chunk"], -1],
            "totals": [*(_slim(totals[at[p]]) for p in parts), None],
            "owned": [*(np.packbits(owned[p]).tobytes() for p in parts), None],
            "stats": [*[None] * (n - 1), stats],
        }
    ).assign(**known)[["kind", "bucket", "chunk", "totals", "owned", "stats"]]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Katz's Good-Turing factor for each count up to ``CUTOFF`` (place 0 unused).

    Of n_r fitted by C r^b, (r + 1) n_(r+1) / (r n_r) is (1 + 1/r)^(b+1), and (k + 1) n_(k+1) / n_1
    is (k + 1)^(b+1)."""
    n, k = [0, *counts_of_counts], CUTOFF
    at = [r for r in range(1, len(n)) if n[r]]
    power = -2.0
    if len(at) > 1:
        # A count next to empty places stands for them too; the last one reaches as far up as down.
        wide = np.diff([0, *at, 2 * at[-1] - at[-2]])
        power = float(np.polyfit(np.log(at), np.log([2 * n[r] / w for r, w in zip(at, wide[:-1] + wide[1:], strict=True)]), 1)[0])
    found = np.ones(k + 1)
    rise, up = np.log1p(1 / np.arange(1, k + 1)), min(power + 1, 0.0)
    top = np.log(k + 1)
    found[1:] = 1 - (np.expm1(up * rise) / np.expm1(up * top) if up < -1e-9 else rise / top)
    return found


def _score(stats: dict[int, list[int]]):
    n, v = stats[WORDS][-2:]
    word_d, pair_d = discounts(stats[WORDS][:-2]), discounts(stats[PAIRS][:-2])
    unknown = (1 + sum(c * r * (1 - word_d[r]) for r, c in enumerate(stats[WORDS][:CUTOFF], 1))) / (n + 1)

    def discounted(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= CUTOFF, by[np.minimum(counts, CUTOFF)], 1.0)

    def run(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(chunks.itertuples(index=False))
        own = _Chunk(row)
        answers = answers.sort_values("bucket")
        words, pairs = (answers[answers["kind"] == k] for k in (WORDS, PAIRS))
        count = np.concatenate([_wide(t) for t in words["totals"]])
        seen = np.concatenate([_wide(t) for t in pairs["totals"]])
        owned = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(_wide(t))) for o, t in zip(pairs["owned"], pairs["totals"], strict=True)]).astype(bool)
        alone = np.where(count > 0, discounted(count, word_d) / (n + 1), unknown)
        begun = np.append(count, count[np.searchsorted(own.vocab, END)])  # as often as texts end

        # Each pair owned here, once: its share of its history's mass.
        mine = owned & (seen > 0)
        history, word = own.history[own.at[mine]], own.tokens[own.at[mine]]
        mass = np.bincount(history, discounted(seen[mine], pair_d), len(begun))
        lower = np.bincount(history, alone[word], len(begun))
        sums = np.flatnonzero(np.bincount(history, minlength=len(begun)))
        found = [pd.DataFrame({"kind": SUMS, "history": own.names[sums].view(np.int64), "mass": mass[sums], "lower_mass": lower[sums], "seen": begun[sums]})]

        of_pair = seen[own.pair]
        backed = (of_pair == 0) & (begun[own.history] > 0)
        logs = np.log10(np.where(of_pair > 0, discounted(of_pair, pair_d) / (begun[own.history] + 1), alone[own.tokens]))
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[own.tokens]
        docs = len(own.lengths)
        rows = (row.chunk << ROW_BITS) + np.arange(docs)
        per_doc = lambda x: np.bincount(own.doc, x, docs)
        found.append(
            pd.DataFrame(
                {
                    "kind": DOC,
                    "row": rows,
                    "doc_id": pd.arrays.IntegerArray(np.frombuffer(row.doc_ids, np.int64).copy(), np.unpackbits(np.frombuffer(row.null_ids, np.uint8), count=docs).astype(bool)),
                    "held": own.held,
                    "n_tokens": own.lengths,
                    "n_known": per_doc(count[own.tokens] > 0).astype(np.int64),
                    "base_score": per_doc(base),
                    "part": per_doc(logs),
                }
            )
        )
        events, times = np.unique(own.doc[backed].astype(np.int64) * len(begun) + own.history[backed], return_counts=True)
        found.append(pd.DataFrame({"kind": EVENT, "row": rows[events // len(begun)], "history": own.names[events % len(begun)].view(np.int64), "n": times}))
        for part in found:  # whole numbers stay so where other kinds of rows have none
            for c in part.columns.intersection(["row", "n_tokens", "n_known", "history", "n", "seen"]):
                part[c] = part[c].astype("Int64")
        whole = pd.concat(found, ignore_index=True)
        return whole[[c.split()[0] for c in _FOUND.split(", ")]]

    return run


def score(docs: DataFrame, held_out, chunk_tokens: int = 1_500_000, range_keys: int = 1_000_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` for each row of ``docs``. ``held_out``: a boolean column; the other rows are learned from."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    chunks = settle(texts.mapInArrow(_chunks(chunk_tokens), _CHUNKS))
    tokens = chunks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    tokens //= 4
    bits = min(MAX_RANGES.bit_length() - 1, max(0, tokens // range_keys).bit_length())
    asked = chunks.mapInPandas(_ask(bits), _ASKED)
    answers = settle(asked.groupBy("kind", "bucket").applyInPandas(_answer, _ANSWERS))
    summed = answers.where("chunk = -1").select("kind", F.posexplode("stats").alias("k", "n")).groupBy("kind", "k").agg(F.sum("n").alias("n")).collect()
    stats = {kind: [0] * (CUTOFF + 3) for kind in (WORDS, PAIRS)}
    for r in summed:
        stats[r["kind"]][r["k"]] = r["n"]
    per_chunk = answers.where("chunk >= 0").drop("stats").groupBy("chunk")
    found = settle(chunks.groupBy("chunk").cogroup(per_chunk).applyInPandas(_score(stats), _FOUND))

    sums = found.where(f"kind = {SUMS}").groupBy("history").agg(F.sum("mass").alias("mass"), F.sum("lower_mass").alias("lower_mass"), F.max("seen").alias("seen"))
    weights = settle(sums.select("history", F.log10((1 - F.col("mass") / (F.col("seen") + 1)) / (1 - F.col("lower_mass"))).alias("weight")))
    events = join_spread(found.where(f"kind = {EVENT}").select("row", "history", "n"), weights, ["history"])
    backed = events.groupBy(F.col("row").alias("__row")).agg(F.sum(F.col("n") * F.col("weight")).alias("backed"))
    rows = found.where(f"kind = {DOC}").join(backed, F.col("row") == F.col("__row"), "left")
    return rows.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(stats[WORDS][-2]).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("part") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )
