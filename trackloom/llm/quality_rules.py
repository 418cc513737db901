"""Rule-based quality filter: a threshold table compiled into one projection.

Every rule is ``metric <op> threshold`` where the metric is a ratio of counts taken from the whole
text. ``measure`` computes the counts with SQL functions only; ``apply_rules`` turns the table of
rules into one boolean column per rule plus the verdict, in a single ``select``. There is no
shuffle, so the cost is linear in the bytes of text.

Defined results: a null or empty text has zero words and is rejected; very long texts are measured
whole; repeated rows and tied ids are measured independently; an empty table gives an empty table;
input columns whose names clash with added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import WORD, without

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by are this not or from at an "
    "le la les de des du et en un une que qui pour dans par sur au avec est "
    "el los las del que y en un una por con para se no su al "
    "der die das und zu den von mit ist nicht ein eine auf dem im sich"
)

#: Words in one window of the repeated-words measure.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``numerator / denominator`` compares as stated (0 / 0 counts as 0)."""

    name: str
    numerator: str
    denominator: str
    at_least: float | None = None
    at_most: float | None = None

    def column(self):
        value = F.when(F.col(self.denominator) > 0, F.col(self.numerator) / F.col(self.denominator)).otherwise(0.0)
        ok = F.lit(True)
        if self.at_least is not None:
            ok = ok & (value >= self.at_least)
        if self.at_most is not None:
            ok = ok & (value <= self.at_most)
        return ok


#: The production table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", at_least=2.0, at_most=14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", at_most=0.3),
    Rule("shouts_per_word", "n_shouts", "n_words", at_most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", at_least=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=0.5),
)

ADDED = (
    "n_words word_chars n_symbols n_shouts n_lines n_dup_lines n_stop_words n_repeat_words "
    "base_failed kept"
).split()

# Window hashes that occur again, as positions; then the words these windows cover.
_REPEATS = """
CASE WHEN size(__windows) = size(array_distinct(__windows)) THEN 0L ELSE
  transform(
    transform(array(sort_array(transform(__windows, (x, i) -> struct(x AS h, i AS i)))), s ->
      sort_array(transform(
        filter(transform(s, (e, k) -> struct(e.h AS h, e.i AS i, k AS k)),
               e -> coalesce(get(s, e.k - 1).h = e.h, false) OR coalesce(get(s, e.k + 1).h = e.h, false)),
        e -> e.i))),
    p -> aggregate(transform(p, (x, k) -> least({w}, coalesce(get(p, k + 1) - x, {w}))),
                   0L, (a, b) -> a + b))[0]
END""".replace("{w}", str(WINDOW))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts the rules use."""
    docs = without(docs, *[c for c in ADDED if c != text.lower()], "__words", "__lines", "__windows")
    source = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        "*",
        F.regexp_extract_all(source, F.lit(WORD), F.lit(0)).alias("__words"),
        F.expr(rf"filter(split(coalesce(`{text}`, ''), '\\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("__lines"),
    )
    parts = ", ".join(f"get(__words, i + {k})" for k in range(WINDOW))
    windows = split.withColumn(
        "__windows",
        F.expr(
            f"CASE WHEN size(__words) < {WINDOW} THEN array() ELSE "
            f"transform(sequence(0, size(__words) - {WINDOW}), i -> xxhash64({parts})) END"
        ),
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    length = lambda c: F.length(c).cast("long")
    counts = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        length(F.array_join("__words", "")).alias("word_chars"),
        length(F.regexp_replace(source, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        length(F.regexp_replace(source, r"[^!]+", "")).alias("n_shouts"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(__words, w -> lower(w) IN ({stop})))").cast("long").alias("n_stop_words"),
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"),
    )
    # As rows of a generator the counts are taken once, wherever a filter on them ends up.
    return windows.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline_outer(F.array(counts)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``measure`` plus ``base_failed``, a boolean ``pass_<rule>`` for each rule, and ``kept``."""
    docs = without(docs, *[f"pass_{r.name}" for r in rules])
    measured = measure(docs, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        verdict = verdict & rule.column()
    return measured.select(
        "*",
        failed.alias("base_failed"),
        *[r.column().alias(f"pass_{r.name}") for r in rules],
        verdict.alias("kept"),
    )
