"""Substring dedup by hashing units of lines.

A text is cut into units: at line ends and at sentence ends, where sentences of fewer than
``unit_words`` words are joined with what follows. Whether a cut falls behind a sentence depends on
that sentence alone, so a passage has the same units wherever it stands, save for its first and
last one. Units are normalised (lower case, single spaces) and reduced to 128-bit digests, which
are grouped over the whole corpus; the occurrence of the least (doc_id, row, offset) stays and the
others go. Neighbouring units that go are joined, and a run is reported from ``min_words`` words
on, with its code point offsets in the original text.

Passages that hold no whole unit are found with ``passage_words``: of the runs of half as many words
that begin in a stretch of the other half, the one of least hash is a unit too (winnowing), so two
texts that share ``passage_words`` words share at least one. These units may overlap; one that
overlaps the place that stays goes only behind it.

Digests that hold a thousandth of all units or more are looked up by a broadcast (at most 1000
rows by that definition), the rest by a shuffle, in which no key is then hot.

Defined results: null and empty texts have no units; of repeated rows the first of the scan keeps its units;
null ids rank first; an empty table gives no rows; other columns are ignored by ``find_repeats``,
and ``remove_repeats`` keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.byte_pairs import powers
from trackloom.llm.common import mix, segment_digests, settle, slices, text_bytes, word_places

_END = re.compile(r"[.!?]+(?=\s)|\n")
_UNITS = "doc_id long, row long, start int, end int, word_from int, word_to int, hash_a long, hash_b long"


def cut(text: str, unit_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of each unit; together the units with words cover the text's words."""
    start = sentence = 0
    held: list[str] = []
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        words = text[sentence:end].split()
        held += words
        if len(words) >= unit_words or end == len(text):
            if held:
                yield start, end, held
            start, held = end, []
        sentence = end


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower case and whether it is white space."""
    low = np.arange(0x110000, dtype=np.uint32)
    low[:0x20000] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x20000)]
    blank = np.zeros(0x110000, bool)
    blank[[c for c in range(0x4000) if chr(c).isspace()]] = True
    return low, blank


def winnow(texts: pa.Array, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen runs of words of all texts: their text, place (start, end, first word, word behind) and digest."""
    size = passage_words // 2
    data, offsets = text_bytes(texts)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low, blank = _letters()
    starts, ends, firsts = word_places(codes, edges, blank)
    if len(starts) < passage_words:
        return np.zeros(0, np.int64), np.empty((0, 4), np.int64), np.empty((0, 2), np.int64)
    digests = segment_digests(low[codes], starts, ends)
    up, down = powers(len(starts))
    n, runs = len(starts) - size + 1, []
    for words in digests:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        runs.append(mix((sums[size:] - sums[:-size]) * down[:n]))
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    begins = np.flatnonzero(text[passage_words - 1 :] == text[: len(text) - passage_words + 1])
    stretch = np.lib.stride_tricks.sliding_window_view(runs[0], passage_words - size + 1)
    least = [stretch[begins[k : k + 100_000]].argmin(axis=1) for k in range(0, len(begins), 100_000)]
    at = np.unique(begins + np.concatenate([np.zeros(0, np.int64), *least]).astype(np.int64))
    of = text[at]
    place = np.stack([starts[at] - edges[of], ends[at + size - 1] - edges[of], at - firsts[of], at - firsts[of] + size], axis=1)
    return of, place, np.stack([r[at] for r in runs], axis=1).view(np.int64)


def _units(unit_words: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owners, found, digests = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                at = 0
                for start, end, words in cut(text or "", unit_words):
                    found.append((start, end, at, at + len(words)))
                    owners.append(k)
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass")))
                    at += len(words)
            owner = np.array(owners, np.int64)
            place, key = np.array(found, np.int64).reshape(-1, 4), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            if passage_words:
                owner, place, key = (np.concatenate(x) for x in zip((owner, place, key), winnow(batch["text"], passage_words), strict=True))
            place = place.astype(np.int32)
            at = pa.array(owner)
            columns = [batch["doc_id"].take(at), batch["row"].take(at), *(pa.array(c) for c in place.T.copy()), *(pa.array(c) for c in key.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _UNITS.split(", ")])

    return run


def find_repeats(docs: DataFrame, unit_words: int = 5, min_words: int = 25, parts: int = 1000, passage_words: int = 0, row: str | None = None) -> DataFrame:
    """A row for each run of repeated units: ``doc_id``, ``row`` (of the scan), ``span_start``,
    ``span_end`` (end exclusive), ``n_words`` and ``kept_doc_id``, where its first unit stays.

    ``min_words``: 1 for every repeated unit. ``passage_words``: 0, or the length (2 or more) from
    which no shared passage is missed. ``row``: a column of longs that numbers the rows, or the
    order of the scan."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), "text")
    units = settle(texts.mapInArrow(_units(unit_words, passage_words), _UNITS))
    place = F.struct("doc_id", "row", "start", "end", "word_to")
    groups = units.groupBy("hash_a", "hash_b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    groups = settle(groups.where("n > 1"))
    hot = groups.where(F.col("n") * parts >= units.count())
    found = units.join(F.broadcast(hot), ["hash_a", "hash_b"]).unionByName(
        units.join(F.broadcast(hot), ["hash_a", "hash_b"], "left_anti").join(groups.join(F.broadcast(hot), ["hash_a", "hash_b"], "left_anti"), ["hash_a", "hash_b"])
    )
    gone = found.where("row <> first.row OR start <> first.start")
    for c, at in (("start", "first.end"), ("word_from", "first.word_to")):
        gone = gone.withColumn(c, F.when(F.col("row") == F.col("first.row"), F.greatest(c, at)).otherwise(F.col(c)))
    by = Window.partitionBy("row").orderBy("word_from", "word_to")
    before = F.max("word_to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.where("word_from < word_to").withColumn("new", F.coalesce((F.col("word_from") > before).cast("int"), F.lit(1)))
    runs = gone.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "run")
    spans = runs.agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("span_start"),
        F.max("end").alias("span_end"),
        (F.max("word_to") - F.min("word_from")).cast("long").alias("n_words"),
        F.min_by("first.doc_id", F.struct("word_from", "word_to")).alias("kept_doc_id"),
    )
    return spans.where(F.col("n_words") >= min_words).select("doc_id", "row", "span_start", "span_end", "n_words", "kept_doc_id")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, each row's own ones; null ids rank first."""
    names = docs.columns
    docs = settle(docs.withColumn("__row", F.monotonically_increasing_id()))
    spans = find_repeats(docs, row="__row", **options)
    spans = spans.groupBy(F.col("row").alias("__of")).agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("__cuts"))
    joined = docs.join(spans, F.col("__row") == F.col("__of"), "left")
    # What lies between the furthest end so far and the next start stays.
    left = F.expr("""
        aggregate(__cuts, named_struct('at', 0, 'kept', ''),
          (s, c) -> named_struct('at', greatest(s.at, c.span_end),
            'kept', s.kept || CASE WHEN c.span_start > s.at THEN substring(text, s.at + 1, c.span_start - s.at) ELSE '' END),
          s -> s.kept || substring(text, s.at + 1))""")
    return joined.select(*[F.when(F.col("__cuts").isNotNull(), left).otherwise(F.col(c)).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names])
