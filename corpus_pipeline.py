"""A corpus cleaning pipeline built from the operators in ``trackloom.llm``.

Stages take and return tables; each one's result is written and read again as the next one's
input. Rows rejected by the quality rules go, one document of each near-duplicate group stays,
documents that hold a benchmark item go, secrets are masked in the text (``n_chars`` follows), and
what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontamination, near_duplicates, packing, quality_rules, secrets
from trackloom.llm.common import settle, table
from trackloom.llm.registry import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, with the columns they came with, whatever those are called. A null or empty
    text has fewer than 20 words and goes; equal rows are judged alike; an empty table stays empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"))
    return quality_rules.apply_rules(rows, text="__text").where("kept").select("__row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id; rows without an id, and those with a null or empty
    text and an id of their own, stay. Of rows with one id one stays. An empty table stays empty."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item; null and empty texts hold none. Equal rows are judged alike, rows of
    one id each by itself, other columns pass as they are; an empty table or benchmark takes nothing away."""
    return decontamination.remove_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their texts; ``n_chars`` follows where it is there (null for a null text).
    Other columns pass as they are; an empty table stays empty."""
    masked = secrets.redact(docs)
    counted = {f.name: F.char_length("text").cast(f.dataType) for f in docs.schema.fields if f.name.lower() == "n_chars"}
    return masked.withColumns(counted) if counted else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences (see ``packing.pack``): a null or empty text is a piece of its end id alone,
    repeated rows are pieces of their own, an empty table gives none."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Compression, MinHash and tokenizers have no SQL; tests hold run() against a version of it in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
