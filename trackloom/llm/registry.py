"""The numbered queries over the corpus tables and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import alignment, chat_format, decontamination, importance, language_model, near_duplicates, packing, prefix_trie, quality_rules, repeats, secrets, sharding, statements, token_counts
from trackloom.llm.common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents"), min_words=1, passage_words=50).drop("row")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    shards = sharding.shuffle_into_shards(light)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return shards.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select("doc_id", *base, "n_shouts", "n_stop_words", *[c for c in judged.columns if c.startswith("pass_")])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.tiktoken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repeats,
        op2_sharding,
        op3_importance,
        op4_decontamination,
        op5_quality_rules,
        op6_secrets,
        op7_near_duplicates,
        op8_token_counts,
        op9_packing,
        op10_language_model,
        op11_chat_format,
        op12_alignment,
        op13_prefix_trie,
    )
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS.split()))

#: Counts and verdicts of the quality rules; {docs} is the input relation.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
x AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM x)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM v, (SELECT unnest(range(8)) AS o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(w, lambda s: lower(s) IN ({stop}))) AS BIGINT) AS n_stop_words,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
q AS (SELECT *,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END BETWEEN 2 AND 14 AS pass_mean_word_length,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END <= 0.3 AS pass_symbols_per_word,
        CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END <= 0.3 AS pass_shouts_per_word,
        CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END >= 0.02 AS pass_stop_words,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5 AS pass_repeated_lines FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_shouts, n_dup_lines, n_stop_words, n_repeat_words, base_failed,
  pass_mean_word_length, pass_symbols_per_word, pass_shouts_per_word, pass_stop_words, pass_repeated_lines,
  NOT base_failed AND pass_mean_word_length AND pass_symbols_per_word AND pass_shouts_per_word
    AND pass_stop_words AND pass_repeated_lines AS kept
FROM q
""".replace("{stop}", _STOP)

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": statements.DECONTAMINATION,
    "op5_quality_rules": QUALITY_SQL.replace("{docs}", "documents"),
    "op7_near_duplicates": statements.NEAR_DUPLICATES,
    "op10_language_model": statements.LANGUAGE_MODEL,
    "op11_chat_format": statements.CHAT_FORMAT,
    "op13_prefix_trie": statements.PREFIX_TRIE,
}
