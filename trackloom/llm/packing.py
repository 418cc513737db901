"""Best-fit packing of token sequences by a linear grouping scheme.

Texts become token ids and an end id; only documents longer than the capacity are cut. What is
packed is planned on the histogram of piece lengths, which has at most ``capacity`` rows whatever
the corpus: large lengths are sorted, dealt into groups of equal cardinality and rounded up to each
group's largest; configurations of these few sizes are filled one after another, each as full as
the sizes left allow and used as often as they last; then the lengths themselves take the places
of the rounded ones, and small lengths go, largest first, to the sequences that they fill best. The
plan is a table of runs: so many pieces of a length, in so many consecutive sequences, at one
offset. Its size follows the capacity and the number of groups, not the corpus, and it is
broadcast. Spark numbers the pieces of each length and looks up their runs.

Numbers within a length are taken in hashed pieces of it, so a frequent length is not one task's.

Defined results: a null or empty text is one piece that holds the end id alone; rows that are
equal are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.byte_pairs import BytePairs
from trackloom.llm.common import Known, segment_digests, settle, slices, text_bytes, word_places
from trackloom.llm.sharding import ranked

#: Pieces that one number range of a length holds on average.
PIECE_ROWS = 4096


#: Classes of bytes: white space, marks, letters, all others.
_BLANK, _MARK, _LETTER, _REST = range(4)
_KINDS = np.full(256, _REST, np.uint8)
_KINDS[[*b" \t\n\r\x0b\x0c"]], _KINDS[[*b".,;:!?()\"-"]] = _BLANK, _MARK
_KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER


def _plain_letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's class and the bytes in lower case, for ASCII and the letters of Latin-1 (lead byte C3)."""
    kinds, low = _KINDS[data], data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs for times and divided by
    kinds[lead] = kinds[lead + 1] = _LETTER
    low[lead[data[lead + 1] <= 0x9E] + 1] += 0x20
    return kinds, low


#: Tells words that go through the library from plain runs of the same letters.
_WHOLE = np.uint64(0x5851F42D4C957F2D)


class WordIds:
    """Ids of texts. The tokenizer drops white space, joins nothing across it and lower-cases.

    In words of Latin letters and plain marks, runs of either are pre-tokens, whose tokens the
    transducer of ``byte_pairs`` finds; other words go through the library, a batch's new ones in one
    text, where each id belongs to the word that its offset lies in. Either are looked up by 128-bit
    hashes first; what is kept is a pool of ids and each unit's place in it."""

    MAX_IDS, MAX_UNITS = 8_000_000, 2_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(path), Known(20)
        with open(path, encoding="utf-8") as file:
            self.pairs = BytePairs(json.load(file), self.library)
        self._restart()

    def _restart(self) -> None:
        self.known.clear()
        self.pool, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new units."""
        first = len(self.edges) - 1
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(counts)])
        self.pool = np.concatenate([self.pool, ids])
        return first + np.arange(len(counts), dtype=np.int32)

    def _by_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(b" ".join(words).decode(), add_special_tokens=False)
        ends = np.cumsum([len(w.decode()) + 1 for w in words])
        word = np.searchsorted(ends, np.fromiter((a for a, _ in found.offsets), np.int64, len(found)), "right")
        return np.bincount(word, minlength=len(words)), np.array(found.ids, np.uint32)

    def _units(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units begin and end, and whether each is a plain run: runs of letters or marks, or else whole words."""
        starts, ends, _ = word_places(data, offsets)
        rest = np.concatenate([[0], np.cumsum(kinds == _REST)])
        plain = rest[ends] == rest[starts]
        change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        word = np.searchsorted(starts, change, "right") - 1
        begin = np.zeros(len(data), bool)
        begin[change[(word >= 0) & plain[word] & (change < ends[word])]] = True
        begin[starts] = True
        begins = np.flatnonzero(begin)
        word = np.cumsum(np.bincount(np.searchsorted(begins, starts), minlength=len(begins))) - 1
        return begins, np.minimum(np.append(begins[1:], len(data)), ends[word]), plain[word]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by ``end_id``, and where each begins (one more than texts)."""
        if len(self.pool) > self.MAX_IDS or len(self.edges) > self.MAX_UNITS:
            self._restart()
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.full(len(texts), end_id, np.uint32), np.arange(len(texts) + 1)
        kinds, low = _plain_letters(data)
        starts, ends, plain = self._units(data, offsets, kinds)
        number = np.zeros(len(starts), np.int64)
        for kind, find, text in ((plain, self.pairs.encode, low), (~plain, self._by_library, data)):
            a, b, held = starts[kind], ends[kind], text.tobytes()
            spelled = lambda at: [held[s:e] for s, e in zip(a[at].tolist(), b[at].tolist(), strict=True)]  # noqa: B023, E731
            hashes, checks = segment_digests(text, a, b)
            checks = checks if kind is plain else checks ^ _WHOLE
            number[kind] = self.known.look_up(hashes, lambda at: self._add(*find(spelled(at))), checks)  # noqa: B023
        sizes = self.edges[number + 1] - self.edges[number]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(before[-1]) + np.repeat(self.edges[number] - before[:-1], sizes)]
        firsts = before[np.searchsorted(starts, offsets)]
        return np.insert(ids, firsts[1:], end_id), firsts + np.arange(len(firsts))


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    """One for each worker process, kept between tasks."""
    return WordIds(path)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for rows in slices(batches):
            ids, begins = words.encode(rows["text"], end_id)
            pieces = -(-np.diff(begins) // capacity)
            row = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(begins)[row] - start)
            held, at = ids.astype("<u4").tobytes(), 4 * (begins[row] + start)
            parts = [held[a : a + 4 * n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [rows["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
            columns.append(pa.array(parts if with_ids else [None] * len(parts), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _large_configurations(counts: list[tuple[int, int]], capacity: int) -> Iterator[tuple[list[int], int]]:
    """For (size, how many), largest first: lists of places in ``counts`` and how often to use them."""
    left = [n for _, n in counts]
    for top in range(len(counts)):
        while left[top]:
            origin = np.full(capacity + 1, -1)
            reached = np.zeros(capacity + 1, bool)
            reached[counts[top][0]] = True
            for g in range(top, len(counts)):
                size = counts[g][0]
                for _ in range(min(left[g] - (g == top), capacity // size)):
                    new = np.zeros_like(reached)
                    new[size:] = reached[:-size]
                    new &= ~reached
                    if not new.any():
                        break
                    origin[new] = g
                    reached |= new
            at, chosen = int(np.flatnonzero(reached)[-1]), [top]
            while at > counts[top][0]:
                chosen.append(int(origin[at]))
                at -= counts[chosen[-1]][0]
            times = min(left[g] // n for g, n in Counter(chosen).items())
            for g in chosen:
                left[g] -= times
            yield chosen, times


def plan(histogram: dict[int, int], capacity: int, groups: int = 256, large_from: int | None = None) -> tuple[list[tuple], int]:
    """Runs (length, first number, pieces, first sequence, offset) and the number of sequences."""
    large_from = capacity // 4 if large_from is None else large_from
    runs: list[tuple] = []
    used: Counter = Counter()  # pieces of a length that have a place
    free: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
    total = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n

    lengths = sorted((x for x in histogram if x >= large_from), reverse=True)
    share = max(1, -(-sum(histogram[x] for x in lengths) // groups))
    held: list[list[list[int]]] = []  # for each group: [length, pieces] runs, largest first
    room = 0
    for length in lengths:
        n = histogram[length]
        while n:
            if not room:
                held.append([])
                room = share
            take = min(n, room)
            held[-1].append([length, take])
            n, room = n - take, room - take
    sizes = [(g[0][0], sum(n for _, n in g)) for g in held]
    for chosen, times in _large_configurations(sizes, capacity):
        columns = []
        for g in chosen:  # the next ``times`` pieces of the group, as runs of one length
            column, need = [], times
            while need:
                take = min(need, held[g][0][1])
                column.append([held[g][0][0], take])
                held[g][0][1] -= take
                need -= take
                if not held[g][0][1]:
                    held[g].pop(0)
            columns.append(column)
        while columns[0]:
            n, offset = min(c[0][1] for c in columns), 0
            for column in columns:
                place(column[0][0], n, total, offset)
                offset += column[0][0]
                column[0][1] -= n
                if not column[0][1]:
                    column.pop(0)
            free.setdefault(capacity - offset, []).append((total, n))
            total += n

    for length in sorted((x for x in histogram if x < large_from), reverse=True):
        n = histogram[length]
        while n:
            best = min((f for f in free if f >= length), default=None)
            if best is None:  # new sequences, filled with this length as far as it goes
                each = capacity // length
                opened = max(1, n // each)
                fill = min(each, n)
                for k in range(fill):
                    place(length, opened, total, k * length)
                free.setdefault(capacity - fill * length, []).append((total, opened))
                total, n = total + opened, n - fill * opened
                continue
            sequence, count = free[best].pop()
            if not free[best]:
                del free[best]
            take = min(n, count)
            place(length, take, sequence, capacity - best)
            free.setdefault(best - length, []).append((sequence, take))
            if take < count:
                free.setdefault(best, []).append((sequence + take, count - take))
            n -= take
    return runs, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = 256, with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``, and ``ids`` (little-endian unsigned 32-bit) if asked for.

    ``tokenizer``: path of a tokenizers file that drops white space, the same on every executor."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = settle(texts.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), kinds))
    pieces = pieces if with_ids else pieces.drop("ids")
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(found, capacity, groups)
    table = docs.sparkSession.createDataFrame(runs, "__length long, __first long, __n long, __sequence long, offset long")
    keyed = pieces.withColumn("__key", F.xxhash64("doc_id", "piece", "length", "ids_crc32"))
    numbered = ranked(keyed, "length", "__key", max(1, -(-max(found.values(), default=0) // PIECE_ROWS)), "__number")
    inside = (F.col("length") == F.col("__length")) & (F.col("__number") >= F.col("__first")) & (F.col("__number") < F.col("__first") + F.col("__n"))
    placed = numbered.join(F.broadcast(table), inside)
    return placed.select(*pieces.columns, (F.col("__sequence") + F.col("__number") - F.col("__first")).alias("sequence_id"), "offset")
