"""Token boundaries of two tokenizers aligned, and the pairs of ids that end together.

A text, behind a space, is cut before each space that follows a character other than white space:
neither tokenizer joins anything across such a place (the byte-level one cuts there, and the other
has no piece with a space behind another character, which is checked), so both encode each cut by
itself and every cut ends a group. Cuts met before are looked up by their text; a batch's new ones go
through the libraries in one call each.

Postings, the number of times that a document links two ids, are shuffled by the id of the second
tokenizer. A task reads sorted streams of them: for each id first the pair's totals, of which it
keeps one number for each partner, then the documents' postings, each of which it turns into what it
adds to the document. Ids that hold more than a share of the postings are dealt over several tasks,
each with the id's totals. Adding up by document ends it.

Defined results: a null or empty text, or one that either tokenizer doesn't spell byte by byte, has
no tokens; texts of any length are encoded whole; repeated rows and null ids are rows of their own;
ties are all counted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.byte_pairs import byte_letters
from trackloom.llm.common import settle, slices

#: Cuts that a worker remembers at most, and the characters of all of them.
MEMORY, MEMORY_CHARS = 500_000, 64_000_000
#: Cuts that go through the second library in one call.
CALL = 1000
#: Fixed value: how byte-level tokenizers of this family cut text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class no version of Unicode has changed.
_SETTLED = re.compile(r"[\t\n\r -~\xa1-\u024f]+")
#: Shares of all postings into which ids are dealt.
SHARES = 2000
_CUT = re.compile(r"(?<=\S)(?= )")
_DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, in a row."""
    return np.repeat(starts - _edges(sizes)[:-1], sizes) + np.arange(sizes.sum())


class Aligner:
    """Both tokenizers, and what is known of cuts. A cut has a number; arrays hold, for each number, its tokens of
    either kind, its groups as text and its linked pairs. A cut that isn't spelled byte by byte has none (``bad``)."""

    def __init__(self, byte_level: str, pieces: str, ranks: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters = {c: k for k, c in enumerate(byte_letters())}
        spelled_a = {k: bytes(letters[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.a_bytes = [spelled_a.get(k, b"") for k in range(max(spelled_a) + 1)]
        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                merges = {base64.b64decode(token): int(k) for token, k in map(bytes.split, file)}
            if any(self.a_bytes[k] != token for token, k in merges.items()):
                raise ValueError("the two files hold different vocabularies")
            self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelled_b = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in spelled_b):
            raise ValueError("a piece holds a space behind another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(spelled_b)]
        self.a_size, self.b_size = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.before = len(self.b.encode("a"))
        # ids in decimal, as they stand inside a group and at the end of its first and second half
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.names = pa.array([f"{k}{c}".encode() for size, c in ((n, ","), (n, "|"), (m, ","), (m, ";")) for k in range(size)], pa.binary())
        self.name_places = 0, n, 2 * n, 2 * n + m
        self._restart()

    def _restart(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.sizes = np.zeros((4, 0), np.int64)  # tokens of a, of b, groups, whether bad
        self.pairs, self.pair_edges = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.texts = pa.array([], pa.binary())

    def _ids(self, cuts: list[str]) -> tuple[list[int], list[int]]:
        """Ids of cuts in a row; each but the last ends with a character other than white space."""
        whole = "".join(cuts)
        # the same merges as ranks are faster to go by; where the libraries might class a character apart, the first one says
        plain = self.ranked and _SETTLED.fullmatch(whole)
        a = self.ranked.encode_ordinary(whole) if plain else self.a.encode(whole, add_special_tokens=False).ids
        b = []
        for k in range(0, len(cuts), CALL):
            # a letter in front takes the space that the library adds
            b += self.b.encode("a" + "".join(cuts[k : k + CALL]))[self.before :]
        return a, b

    def _learn(self, cuts: list[str]) -> None:
        """Numbers new cuts, each of which begins with a space. Those with an end or a character that could join
        something across it, or hide how it is spelled, go alone."""
        odd = [c for c in cuts if c[-1].isspace() or "▁" in c]
        alone = set(odd)
        even = [c for c in cuts if c not in alone]
        settled = [bool(_SETTLED.fullmatch(c)) for c in even]
        groups = [[c for c, x in zip(even, settled, strict=True) if x == k] for k in (True, False)]
        for some in [g for g in groups if g] + [[c] for c in odd]:
            a, b = self._ids(some)
            whole = "".join(some).encode()
            if all(b"".join(map(side.__getitem__, ids)) == whole for side, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                self._add(some, np.array(a, np.int64), np.array(b, np.int64))
            elif len(some) > 1:
                self._learn(some[: len(some) // 2])
                self._learn(some[len(some) // 2 :])
            else:
                self._number(some, np.array([[0], [0], [0], [1]]), np.zeros(0, np.int64), pa.array([b""], pa.binary()))

    def _add(self, cuts: list[str], a: np.ndarray, b: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(c.encode()) for c in cuts])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        cut = [np.searchsorted(side, ends, "right") for side in (a_ends, b_ends, common)]
        sizes = np.stack([np.diff(c, prepend=0) for c in cut] + [np.zeros(len(cuts), np.int64)])
        # a group's tokens of a come before its tokens of b
        a_at = np.arange(len(a)) + np.repeat(np.concatenate([[0], b_last[:-1] + 1]), np.diff(a_last, prepend=-1))
        b_at = np.arange(len(b)) + np.repeat(a_last + 1, np.diff(b_last, prepend=-1))
        name = np.empty(len(a) + len(b), np.int64)
        name[a_at], name[b_at] = a + self.name_places[0], b + self.name_places[2]
        name[a_at[a_last]] += self.name_places[1]
        name[b_at[b_last]] += self.name_places[3] - self.name_places[2]
        said = self.names.take(pa.array(name))
        places = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1][_edges(sizes[0] + sizes[1])].copy()
        texts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(places), said.buffers()[2]])
        self._number(cuts, sizes, b[b_last] << 32 | a[a_last], texts)

    def _number(self, cuts: list[str], sizes: np.ndarray, pairs: np.ndarray, texts: pa.Array) -> None:
        first = len(self.known)
        self.known.update(zip(cuts, range(first, first + len(cuts)), strict=True))
        self.chars += sum(map(len, cuts))
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.pairs = np.concatenate([self.pairs, pairs])
        self.pair_edges = np.concatenate([self.pair_edges, self.pair_edges[-1] + np.cumsum(sizes[2])])
        self.texts = pa.concat_arrays([self.texts, texts])

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """For each text: tokens of either kind, groups, their digest, and the links' pairs (``b << 32 | a``)."""
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        whole = [c for cuts in cut for c in cuts]
        if len(self.known) > MEMORY or self.chars > MEMORY_CHARS:
            self._restart()
        new = set(whole) - self.known.keys()
        if new:
            self._learn(sorted(new))
        number = np.fromiter(map(self.known.__getitem__, whole), np.int64, len(whole))
        edges = _edges(np.array([len(c) for c in cut], np.int64))
        sizes = self.sizes[:, number]
        n_a, n_b, n_groups, bad = (np.diff(_edges(s)[edges]) for s in sizes)
        pairs = self.pairs[_runs(self.pair_edges[number], sizes[2])]
        pair_edges = _edges(sizes[2])[edges]
        said = self.texts.take(pa.array(number))
        places = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1][edges] if len(whole) else edges
        data = memoryview(said.buffers()[2]) if len(whole) else b""
        for k in range(len(texts)):
            if bad[k] or not n_a[k]:
                yield 0, 0, 0, "", pairs[:0]
            else:
                yield n_a[k], n_b[k], n_groups[k], hashlib.sha256(data[places[k] : places[k + 1] - 1]).hexdigest(), pairs[pair_edges[k] : pair_edges[k + 1]]


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str, ranks: str | None) -> Aligner:
    """One for each worker process, so that what it knows lasts between tasks."""
    return Aligner(byte_level, pieces, ranks)


def _encode(byte_level: str, pieces: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, pieces, ranks)
        for rows in slices(batches, most=1_000_000):
            counts, shas, links, sizes = [], [], [], []
            for n_a, n_b, n_groups, sha, pairs in own.documents(rows["text"].to_pylist()):
                counts.append((n_a, n_b, n_groups))
                shas.append(sha)
                found, times = np.unique(pairs, return_counts=True)
                links.append((found, times))
                sizes.append(len(found))
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            pair, times = (np.concatenate([x[k] for x in links]) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (pair & 0xFFFFFFFF, pair >> 32, times)]
            n = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([rows["row"], rows["doc_id"], *n, pa.array(shas, pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "n"])

    return run


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What postings add to their documents. Rows are sorted by ``key``, totals (``row`` null) before postings, then ``a``."""
    at, partners, totals, most = None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        key, a, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "a", "n"))
        row = batch["row"]
        is_total = row.is_null().to_numpy(zero_copy_only=False)
        rows = row.fill_null(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        out_rows, best, sums = [], [], []
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True):
            if key[s] != at:
                at, partners, totals, most = key[s], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            split = s + int(is_total[s:e].sum())
            if split > s:
                partners, totals = np.concatenate([partners, a[s:split]]), np.concatenate([totals, n[s:split]])
                most = totals.max()
            if split < e:
                count = totals[np.searchsorted(partners, a[split:e])]
                out_rows.append(rows[split:e])
                sums.append(n[split:e] * count)
                best.append(np.where(count == most, n[split:e], 0))
        if out_rows:
            where, which = np.unique(np.concatenate(out_rows), return_inverse=True)
            add = [np.zeros(len(where), np.int64) for _ in range(2)]
            for to, values in zip(add, (best, sums), strict=True):
                np.add.at(to, which, np.concatenate(values))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (where, *add)], ["row", "n_best", "count_sum"])


def _postings(docs: DataFrame) -> DataFrame:
    listed = F.explode(F.arrays_zip("b", "a", "n")).alias("x")
    return docs.select("row", listed).select("row", "x.b", "x.a", F.col("x.n").cast("long").alias("n"))


def align(docs: DataFrame, byte_level: str, pieces: str, ranks: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    ``byte_level``, ``pieces``: paths of the two tokenizers' files, the same on every executor. ``ranks``: the
    first one's merges as a file of ranks, by which most new cuts are encoded faster, with the same ids."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = settle(numbered.mapInArrow(_encode(byte_level, pieces, ranks), _DOCS))
    totals = settle(_postings(encoded).groupBy("b", "a").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("postings")))
    # one row for each id of a vocabulary
    held = totals.groupBy("b").agg(F.sum("postings").alias("held"))
    whole = held.agg(F.sum("held")).first()[0] or 1
    salts = held.select("b", F.ceil(F.col("held") * SHARES / whole).cast("int").alias("salts"))
    spread = F.broadcast(salts.where("salts > 1"))
    many = F.coalesce("salts", F.lit(1))
    posted = _postings(encoded).join(spread, "b", "left").select("b", F.pmod(F.xxhash64("row"), many).cast("int").alias("salt"), "a", "row", "n")
    known = totals.join(spread, "b", "left").select("b", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), "a", F.lit(None).cast("long").alias("row"), "n")
    streams = known.unionByName(posted).select(F.expr("shiftleft(cast(b AS long), 32) + salt").alias("key"), "a", "row", "n")
    streams = streams.repartition("key").sortWithinPartitions("key", F.col("row").isNotNull(), "a")
    added = streams.mapInArrow(_contribute, "row long, n_best long, count_sum long")
    sums = added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    light = encoded.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return light.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
