"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.stages import settle  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most(df: DataFrame, n: int) -> bool:
    """Whether ``df`` has ``n`` rows or fewer, reading little more than that."""
    return df.limit(n + 1).count() <= n


def join_spread(rows: DataFrame, other: DataFrame, on: list[str], parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``other``, which has each key once. What belongs to keys with a share of ``1 / parts``
    of the rows or more is broadcast (``parts`` keys at most); the rest is shuffled, in which no key is hot then.
    Both are read several times, so they should be settled."""
    key = F.xxhash64(*on)
    counts = rows.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    keys = [r["__key"] for r in counts.where(F.col("__n") >= rows.count() / parts).collect()]
    hot = key.isin(keys) if keys else F.lit(False)
    near = rows.where(hot).join(F.broadcast(other.where(hot)), on)
    return near.unionByName(rows.where(~hot).join(other.where(~hot), on))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add (names compare without case)."""
    gone = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in gone]
    return df.select(*[F.col(f"`{c}`") for c in keep])


#: Bytes of text that are worked on at once, whatever the number of rows in an Arrow batch.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in ``column`` (a longer text is a run by itself)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more than texts); null: empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of each text begin and end, and the number of each text's first word (one more than texts).
    ``blank``: for each value of ``data``, whether it is white space."""
    inside = ~blank[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges], end[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams of hashed words, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m]
    for k in range(1, n):
        out = mix(out) + words[k : k + m]
    return mix(out)


#: Bytes in lower case (A-Z as a-z).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Segments of more bytes are hashed one by one.
_LONG = 256
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def segment_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each ``data[start:end]``.

    Eight bytes of all segments are taken at a time and mixed into two chains by different bijections, so
    no choice of one block undoes another in both; long segments are hashed by XXH3."""
    size = data.dtype.itemsize
    raw = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
    begin, length = starts.astype(np.int64) * size, (ends - starts).astype(np.int64) * size
    blocks = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    one = mix(length.astype(np.uint64) + _FIRST)
    two = mix(one + _SECOND)
    live = np.flatnonzero((length > 0) & (length <= _LONG))
    at, left = begin[live], length[live]
    while len(live):
        block = blocks[at] & _MASKS[np.minimum(left, 8)]
        one[live] = mix((one[live] ^ block) * _FIRST)
        two[live] = mix((two[live] + block) ^ _SECOND) * _FIRST
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > _LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(raw[begin[k] : begin[k] + length[k]])
        one[k], two[k] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return mix(one + (two >> np.uint64(1))), two


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``."""
    return segment_digests(data, starts, ends)[0]


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row (A-Z as a-z), and each text's first one (one more than texts)."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = word_places(data, offsets)
    return segment_hashes(LOWER[data] if lower else data, starts, ends), firsts


class Known:
    """Numbers of hashed strings, in a table of ``1 << bits`` places where a newer string replaces an older one.
    A string is told by 128 bits, or by 64 where those are the whole of it."""

    def __init__(self, bits: int = 20):
        self.mask, self.keys, self.values = np.uint64((1 << bits) - 1), np.zeros((2, 1 << bits), np.uint64), np.zeros(1 << bits, np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.keys[0, 0] = 1  # no hash has place 0 and is 1

    def look_up(self, hashes: np.ndarray, make: Callable[[np.ndarray], np.ndarray], checks: np.ndarray | None = None) -> np.ndarray:
        """A number for each hash with its second one; ``make`` gives those of the places where an unknown one stands first."""
        checks = hashes if checks is None else checks
        at = hashes & self.mask
        found, missing = self.values[at], np.flatnonzero((self.keys[0, at] != hashes) | (self.keys[1, at] != checks))
        if len(missing):
            order = missing[np.lexsort((missing, checks[missing], hashes[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
            first = order[new]
            made = make(first)
            found[order] = made[np.cumsum(new) - 1]
            self.keys[0, at[first]], self.keys[1, at[first]], self.values[at[first]] = hashes[first], checks[first], made
        return found
