"""Token counts by compiled finite-state transducers.

Byte-level BPE is two transducers in a row. The first one cuts text into pre-tokens. It is a table
over nine states and eleven classes of characters whose transitions say where a cut falls: before
the character read or before the one preceding it. A cut emits the tokens of the pre-token that
begins there. A batch of texts is one array of classes, cut into chunks; a chunk's map says, for
each state it may be entered in, the state it is left in and the tokens it emits. All nine states
run side by side until they agree, which takes a few characters, and one runs on from there. The
maps are composed by a parallel prefix scan, which gives the state that every chunk is entered in
(so its cuts and emissions) and then the tokens emitted before each chunk; a text's count is the
difference of that number between its two ends.

The second transducer reads the bytes of a pre-token and counts its tokens (see ``byte_pairs``). A
batch's new pre-tokens step through it side by side; their emissions are kept in a table of fixed
size under 128-bit hashes and compiled again when they have been replaced.

Special strings in a text are one token each, as the library takes them by default.

Defined results: a null or empty text has no bytes and no tokens; texts of any length are counted
whole; repeated rows, ties and null ids are counted like others; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.byte_pairs import BytePairs
from trackloom.llm.common import Known, segment_digests, slices, text_bytes

CHUNK = 512

# States and classes of the cutter.
FRESH, LETTERS, NUMBERS, OTHERS, SPACE, BLANK, QUOTE, QUOTE_RV, QUOTE_L = range(9)
C_LETTER, C_NUMBER, C_OTHER, C_QUOTE, C_SPACE, C_BLANK, C_END, C_STMD, C_RV, C_E, C_L = range(11)
HERE, BACK = 1, 2  # a cut before the character read; before the one preceding it


def _compile_cutter() -> tuple[np.ndarray, np.ndarray]:
    to, cut = np.zeros((9, 11), np.uint8), np.zeros((9, 11), np.uint8)
    letters = (C_LETTER, C_STMD, C_RV, C_E, C_L)
    run = dict.fromkeys(letters, LETTERS) | {C_NUMBER: NUMBERS, C_OTHER: OTHERS, C_QUOTE: QUOTE, C_SPACE: SPACE, C_BLANK: BLANK, C_END: FRESH}
    for c, state in run.items():
        for s in range(9):
            to[s, c], cut[s, c] = state, HERE
        same = {LETTERS: c in letters, NUMBERS: c == C_NUMBER, OTHERS: c in (C_OTHER, C_QUOTE)}
        for s in (s for s, stays in same.items() if stays):
            to[s, c], cut[s, c] = s, 0
        if c in (C_OTHER, C_QUOTE):  # what follows a quote or a space joins it
            to[QUOTE, c], cut[QUOTE, c] = OTHERS, 0
        if c in (C_SPACE, C_BLANK):
            cut[SPACE, c] = cut[BLANK, c] = 0
        elif c != C_END:  # white space ends: its last character stands alone or leads
            to[SPACE, c], cut[SPACE, c] = OTHERS if c == C_QUOTE else state, BACK
            cut[BLANK, c] = BACK | HERE
    for s, ending in ((QUOTE_RV, C_E), (QUOTE_L, C_L)):  # 're 've 'll, or else a quote and letters
        to[s], cut[s] = to[LETTERS], cut[LETTERS] | BACK
        to[s, ending], cut[s, ending] = FRESH, 0
    to[QUOTE, C_STMD], cut[QUOTE, C_STMD] = FRESH, 0
    to[QUOTE, C_RV], cut[QUOTE, C_RV] = QUOTE_RV, 0
    to[QUOTE, C_L], cut[QUOTE, C_L] = QUOTE_L, 0
    return to, cut


def _compile_steps() -> np.ndarray:
    """One byte for each state and class (places ``16 * state + class``): the next state times 16, and the cut."""
    to, cut = _compile_cutter()
    steps = np.zeros((16, 16), np.uint8)
    steps[:9, :11] = to << 4 | cut
    return steps.reshape(-1)


STEPS = _compile_steps()


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maps (state left in, tokens emitted) by state entered in, one after the other."""
    left, emitted = first
    at = left.astype(np.intp)
    return np.take_along_axis(then[0], at, 1), emitted + np.take_along_axis(then[1], at, 1)


def scan(left: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composed map of all chunks up to and with each one."""
    step = 1
    while step < len(left):
        later = compose((left[:-step], emitted[:-step]), (left[step:], emitted[step:]))
        left, emitted = (np.concatenate([old[:step], new]) for old, new in zip((left, emitted), later, strict=True))
        step *= 2
    return left, emitted


def chunk_maps(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pre-tokens begin, for classes that end with ``C_END``; for each chunk, the states it may be left
    in and the one it is entered in."""
    n = len(classes)
    chunks = np.pad(classes, (0, -n % CHUNK), constant_values=C_END).reshape(-1, CHUNK).T.copy()
    lanes, said, apart = np.tile(np.arange(9, dtype=np.uint8) << 4, (chunks.shape[1], 1)), np.empty_like(chunks), 0
    while apart < CHUNK and (lanes != lanes[:, :1]).any():
        lanes = STEPS[(lanes & 0xF0) | chunks[apart][:, None]] & 0xF0
        apart += 1
    state = lanes[:, 0]
    for k in range(apart, CHUNK):
        state = said[k] = STEPS[(state & 0xF0) | chunks[k]]
    left = lanes >> 4 if apart == CHUNK else np.repeat(state[:, None] >> 4, 9, axis=1)
    entered = np.concatenate([[FRESH], scan(left, np.zeros(left.shape, np.int64))[0][:-1, FRESH]]).astype(np.uint8)
    state = entered << 4
    for k in range(apart):
        state = said[k] = STEPS[(state & 0xF0) | chunks[k]]
    said = said.T.reshape(-1)[: n + 1]
    begins = (said & HERE).astype(bool)
    begins[: len(said) - 1] |= (said[1:] & BACK).astype(bool)
    return np.flatnonzero(begins[:n]), left, entered


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.transducer, self.emitted = BytePairs(spec, self.library), Known(21)
        self.classes = np.full(0x110000, 255, np.uint8)
        self.classes[0xD800] = C_END

    def _class_of(self, code: int) -> int:
        """A character's class, by how the library's own pre-tokenizer takes it."""
        c = chr(code)
        named = {"'": C_QUOTE, " ": C_SPACE, "e": C_E, "l": C_L} | dict.fromkeys("stmd", C_STMD) | dict.fromkeys("rv", C_RV)
        if c in named:
            return named[c]
        parts = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        return C_LETTER if parts(f"a{c}a") == 1 else C_NUMBER if parts(f"1{c}1") == 1 else C_OTHER if parts(f"!{c}!") == 1 else C_BLANK

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == 255).any():
            for code in np.unique(codes[found == 255]):
                self.classes[code] = self._class_of(int(code))
            found = self.classes[codes]
        return found

    def _blank_specials(self, whole: str, edges: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The number of specials in each text; in ``codes`` they become ends."""
        n = np.zeros(len(edges) - 1, np.int64)
        for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
            at = a
            while at < b:
                found = min(((p, -len(s)) for s in self.specials if (p := whole.find(s, at, b)) >= 0), default=None)
                if found is None:
                    break
                at = found[0] - found[1]
                codes[found[0] : at], n[k] = 0xD800, n[k] + 1
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. A lone surrogate, which no text holds, stands at its end."""
        data, offsets = text_bytes(texts)
        whole = data.tobytes().decode()
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        totals = np.zeros(len(texts), np.int64)
        if any(s in whole for s in self.specials):
            totals += self._blank_specials(whole, edges, codes)
        codes = np.insert(codes, edges[1:], 0xD800)
        ends = edges[1:] + np.arange(len(texts))
        starts, left, entered = chunk_maps(self._classes(codes))
        counts = self._emissions(codes, starts)
        # Tokens emitted before each chunk, by the composed maps, and before each pre-token.
        chunk = starts // CHUNK
        emitted = np.zeros(left.shape, np.int64)
        emitted[np.arange(len(left)), entered] = np.bincount(chunk, counts, len(left)).astype(np.int64)
        before = np.concatenate([[0], scan(left, emitted)[1][:-1, FRESH]])
        running = np.concatenate([[0], np.cumsum(counts)])
        at_chunk = running[np.searchsorted(starts, np.arange(len(left)) * CHUNK)]
        at_end = np.searchsorted(starts, ends)  # ends are pre-tokens of their own
        told = before[chunk[at_end]] + running[at_end] - at_chunk[chunk[at_end]]
        return totals + np.diff(told, prepend=0)

    def _emissions(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(codes))
        some = np.flatnonzero(codes[starts] != 0xD800)
        a, b = starts[some], ends[some]
        spelled = lambda at: [codes[s:e].tobytes().decode("utf-32-le").encode() for s, e in zip(a[at].tolist(), b[at].tolist(), strict=True)]
        counts = np.zeros(len(starts), np.int64)
        hashes, checks = segment_digests(codes, a, b)
        counts[some] = self.emitted.look_up(hashes, lambda at: self.transducer.count(spelled(at)), checks)
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process, so that it stays compiled between tasks."""
    return Counter(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for rows in slices(batches):
            n = own.count(rows["text"])
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["n_bytes"], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row of ``docs``.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library that cuts by the usual
    pattern, the same on every executor."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text").mapInArrow(
        _count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
