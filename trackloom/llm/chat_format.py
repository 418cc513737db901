"""Conversations rendered by a compiled chat template, and read back.

A conversation's turns are sorted (``turn``, null first, then role and text) and stream through the
template's closures, one turn in memory at a time; what comes out is cut into parts, so a
conversation of any length neither becomes one value nor is gathered. ``loss`` says where text of
``generation`` blocks lies. Turns carry control strings around them; texts are escaped, so they hold
none, and reading back is exact.

A conversation stands in order in one task, as its digests are made in order; sorts spill. Defined
results: null roles and texts are empty; rows without ``conv_id`` are one conversation of theirs;
repeated rows are turns of their own; ties don't depend on the order of rows; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.chat_templates import Template, unescape

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: An assistant's turn is <s>text</s>, any other one [INST]role, line's end, text[/INST].
CHAT = """
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%}
    {{ '<s>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' -}}
  {%- else -%}
    [INST]{{ m.role | line }}{{ '\\n' ~ (m.text | escape) }}[/INST]
  {%- endif -%}
{%- endfor -%}
"""
PART_CHARS = 1 << 20
_PARTS = "conv_id long, part int, start long, text string, loss array<struct<start:long,end:long>>"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def cut(pieces: Iterable[tuple[str, int]], part_chars: int = PART_CHARS) -> Iterator[tuple[int, str, list[dict]]]:
    """Rendered pieces as parts of ``part_chars`` characters (the last one may be shorter): where each
    begins, its text, and the stretches of generated text in it, by their place in the whole."""
    start, held, size, loss, inside = 0, [], 0, [], 0
    for text, block in pieces:
        while text:
            taken = text[: part_chars - size]
            at, text = start + size, text[len(taken) :]
            if block and block == inside and loss and loss[-1]["end"] == at:
                loss[-1]["end"] += len(taken)
            elif block:
                loss.append({"start": at, "end": at + len(taken)})
            inside, size = block, size + len(taken)
            held.append(taken)
            if size == part_chars:
                yield start, "".join(held), loss
                start, held, size, loss = start + size, [], 0, []
    if size or not start:
        yield start, "".join(held), loss


def _records(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def _batched(rows: Iterable[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_PART_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _format(source: str, controls: tuple[str, ...], part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)

        def parts() -> Iterator[tuple]:
            for conv, rows in groupby(_records(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in rows)
                for k, (start, text, loss) in enumerate(cut(template.render(messages=messages), part_chars)):
                    yield conv, k, start, text, loss

        yield from _batched(parts(), _PART_SCHEMA, lambda row: len(row[3]) + 100)

    return run


def format_conversations(conversations: DataFrame, source: str = CHAT, controls: tuple[str, ...] = CONTROLS, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, start, text, loss`` for each conversation, its parts from 0 in order within a task.

    ``loss``: the places (code points of the whole conversation, end exclusive) of text generated by
    the model. ``conversations`` has ``conv_id, turn, role, text``."""
    Template(source, controls)  # a mistake in the template shows on the driver
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return sorted_turns.select("conv_id", "role", "text").mapInArrow(_format(source, controls, part_chars), _PARTS)


_MARKS = re.compile("|".join(map(re.escape, CONTROLS)))
_HELD = max(map(len, CONTROLS)) - 1


def read_turns(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts out of a conversation formatted by ``CHAT``, given in any cuts."""
    opened, held, rest = "", [], ""
    for text, last in _with_end(texts):
        rest += text
        at = 0
        while found := _MARKS.search(rest, at):
            held.append(rest[at : found.start()])
            at, mark = found.end(), found[0]
            if mark in ("<s>", "[INST]"):
                if opened or any(held):
                    raise ValueError(f"{mark} is out of place")
                opened = mark
            elif (opened, mark) not in (("<s>", "</s>"), ("[INST]", "[/INST]")):
                raise ValueError(f"{mark} is out of place")
            else:
                whole, opened = "".join(held), ""
                role, said = ("assistant", whole) if mark == "</s>" else whole.split("\n", 1)
                yield unescape(role), unescape(said)
            held = []
        safe = len(rest) if last else max(at, len(rest) - _HELD)
        held.append(rest[at:safe])
        rest = rest[safe:]
    if opened or any(held):
        raise ValueError("text outside of turns")


def _with_end(texts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    for text in texts:
        yield text, False
    yield "", True


def _digest(parts: Iterable[tuple]) -> tuple:
    """Counts and digests of one conversation from its parts ``(start, text, loss)``."""
    turns, loss, n, chars, lossy, cut_off = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""

    def texts() -> Iterator[str]:
        nonlocal chars, lossy, cut_off
        for start, text, stretches in parts:
            for s in stretches:
                said = cut_off + text[s["start"] - start : s["end"] - start]
                # an escape may be cut in two at the end of a part
                odd = (len(said) - len(said.rstrip("\\"))) % 2
                said, cut_off = (said[:-1], "\\") if odd else (said, "")
                said = unescape(said)
                loss.update(said.encode())
                lossy += len(said)
            chars += len(text)
            yield text

    for role, text in read_turns(texts()):
        turns.update(f"{role}\n{text}\n".encode())
        n += 1
    return n, turns.hexdigest(), lossy, loss.hexdigest(), chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, parts in groupby(_records(batches, "conv_id", "start", "text", "loss"), key=lambda r: r[0]):
            yield conv, *_digest(p[1:] for p in parts)

    yield from _batched(rows(), _DIGEST_SCHEMA, lambda row: 300)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the rows of
    ``format_conversations`` by ``CHAT``, as they come from it (in order within each task)."""
    return formatted.select("conv_id", "start", "text", "loss").mapInArrow(_read, _DIGESTS)
