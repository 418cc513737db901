"""Secret scan: fixed patterns, and strings that a dictionary-primed compressor finds novel.

The patterns find assignments to telling names, access key ids and long hexadecimal runs. Beyond
them, candidates are

* runs of 16 or more key characters with letters and digits that have a sensitive word within 48
  characters before them, on the same line or the one before, or behind them on the same line. ``=``
  belongs to a run as padding at its end; within it, it ends a name, so every value of
  ``private_key=VALUE`` is a candidate whose sensitive word may stand in the run before it (the whole
  run is tried if no value is a secret);
* runs whose own beginning tells what they are (``ghp_``, ``xoxb-``, a web hook's path), and passwords in
  addresses (``//name:password@host``), of 8 or more characters;
* the body of a private key's block, as one.

A candidate's novelty is the number of bytes by which it lengthens the zstandard frame of its surroundings (128 characters before, 64 after) under a
dictionary of common identifiers: text that repeats its surroundings or is built from known names
costs little, random keys cost what their alphabet demands. From ``min_novelty`` bytes per
character on it is reported.

One pass, no shuffle. Defined results: a null or empty text has no spans; texts of any length are
read whole; repeated rows and null ids are scanned like others; an empty table gives none; other
columns are ignored by ``scan``, and ``redact`` keeps them all.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import slices

KINDS = ("assign", "access", "hex", "novel")

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"key|token|secret|passw|credential|auth|private|bearer|signature|pwd", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Beginnings of tokens that services give out; passwords in addresses; blocks of private keys.
TELLING = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk_(?:live|test)_|rk_live_|npm_|pypi-|AIza|SG\.|hooks\.slack\.com/services/)([A-Za-z0-9+/_.=-]{8,})")
ADDRESS = re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{8,128})@")
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{16,}?)\s*-----END")
#: Characters of the shortest value in a run.
SHORTEST = 16
VALUE = re.compile(r"[^=]+(?:=+\Z)?")

#: Identifiers that source code is full of; callers may pass their own.
IDENTIFIERS = (
    "access_key_id secret_access_key client_secret client_id api_key api_token auth_token bearer "
    "authorization credentials private_key public_key password passwd username session_id request_id "
    "getElementById addEventListener createElement querySelector configuration environment connection "
    "application_context response_headers content_type application/json charset=utf-8 database_url "
    "import from return class function const static public private protected void string integer boolean "
    "http://www.example.com https://api.example.com/v1/users localhost:8080 /usr/local/lib/python/site-packages "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx"
)


class Scanner:
    def __init__(self, identifiers: str = IDENTIFIERS, min_novelty: float = 0.5):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False)
        self.min_novelty = min_novelty

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes for each character of the candidate."""
        before, after = text[max(0, start - 128) : start], text[end : end + 64]
        return (self.size(before + text[start:end] + after) - self.size(before + after)) / (end - start)

    def novel(self, text: str, start: int, end: int, taken: list[tuple[int, int]]) -> bool:
        run = text[start:end]
        if run.isalpha() or run.isdigit():
            return False
        at = bisect.bisect_left(taken, (end,))  # spans taken lie apart, so only the last one before the end can reach in
        if at and taken[at - 1][1] > start:
            return False
        return self.novelty(text, start, end) >= self.min_novelty

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end), sorted; kind is a place in ``KINDS``."""
        if not text:
            return []
        low, found = text.lower(), []
        if any(name in low for name in _NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        taken: list[tuple[int, int]] = []
        for s, _, e in sorted(found):
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        own = [m.span(1) for pattern, sign in ((TELLING, None), (ADDRESS, "://"), (BLOCK, "PRIVATE KEY-----")) if sign is None or sign in text for m in pattern.finditer(text)]
        told = [(s, 3, e) for s, e in sorted(own) if self.novel(text, s, e, taken)]
        for s, _, e in told:
            bisect.insort(taken, (s, e))
        found += told
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            near = max(0, start - 48)
            line = text.rfind("\n", near, start)
            word = SENSITIVE.search(text, max(near, text.rfind("\n", near, max(line, near)) + 1), end)
            behind = text.find("\n", end, end + 48)
            after = SENSITIVE.search(text, end, behind if behind >= 0 else end + 48)
            if not word and not after:
                continue
            told_before = lambda at: bool(after) or word.end() <= at  # noqa: B023, E731
            values = [(start + v.start(), start + v.end()) for v in VALUE.finditer(m.group()) if v.end() - v.start() >= SHORTEST]
            novel = [(s, 3, e) for s, e in values if told_before(s) and self.novel(text, s, e, taken)]
            if not novel and values != [(start, end)] and told_before(start) and self.novel(text, start, end, taken):
                novel = [(start, 3, end)]
            found += novel
        return sorted(found)


_SCANNED = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]


def _scan(identifiers: str, min_novelty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(identifiers, min_novelty)
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                spans = scanner.spans(text)
                said = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans]
                base = ",".join(x for k, x in said if k < 3)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said), counts[3]))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], _SCANNED)

    return run


def scan(docs: DataFrame, identifiers: str = IDENTIFIERS, min_novelty: float = 0.5) -> DataFrame:
    """``doc_id``, counts by kind, ``base_sha256`` and ``spans`` (kind:start:end, comma-joined)."""
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(identifiers, min_novelty), kinds)


def redact(docs: DataFrame, mask: str = "[secret]", identifiers: str = IDENTIFIERS, min_novelty: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans become one. Other
    columns pass as they are."""
    text_at = [c.lower() for c in docs.columns].index("text")
    name = docs.columns[text_at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(identifiers, min_novelty)
        for batch in slices(batches, name):
            texts = []
            for text in batch.column(text_at).to_pylist():
                at, parts = 0, []
                for start, _, end in scanner.spans(text):
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                texts.append("".join([*parts, text[at:]]) if parts else text)
            columns = [pa.array(texts, c.type) if k == text_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
