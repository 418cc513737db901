"""Quality selection by importance resampling.

Two generative models of hashed words and word pairs, one of target text and one of all text, give
each document the log ratio of its probabilities. A Gumbel variate, a function of the seed and the
id, is added, and the k largest sums are kept: a sample without replacement whose chances are
proportional to the ratios.

The model of all text counts every document. The target model counts the labelled documents that
are good and not toxic, of at most ``max_labels`` labels (the ones with the least hashed ids): their
ids are broadcast. Both models are one row for each of ``buckets`` buckets, whatever the corpus.
The k-th largest sum is found by counting in bins (at most 4096 at a time) on sums rounded to 1e-6;
rows tied with it are all kept.

Defined results: null and empty texts have ratio 0; equal ids share a variate (null ids do too), and
each row is drawn by itself;
without target labels every ratio comes from the smoothing alone; an empty table gives no rows;
added columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import hashed_words, mix, ngram_hashes, settle, slices

BUCKETS = 1 << 14
MAX_LABELS = 200_000


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and the text that each belongs to."""
    words, firsts = hashed_words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    pairs, inside = ngram_hashes(words, 2), text[1:] == text[:-1]
    found = np.concatenate([mix(words), pairs[inside]]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([text, text[1:][inside]])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for rows in slices(batches):
            found, text = features(rows["text"], buckets)
            raw += np.bincount(found, minlength=buckets)
            good = rows["good"].to_numpy(zero_copy_only=False)
            target += np.bincount(found[good[text]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, float]:
    """log p(bucket | target) - log p(bucket | all), add-one smoothed; the share of labels that are target."""
    good = F.expr("coalesce(quality = 1 AND toxic = 0, false)")
    sample = labels.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = settle(sample.select("doc_id", good.alias("good")))
    share = sample.agg(F.avg(F.col("good").cast("double"))).first()[0]
    ids = sample.where("good").select(F.col("doc_id").alias("__id")).distinct().withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left")
    parts = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count(buckets), "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.ones((2, buckets))
    counts[:, rows["bucket"].to_numpy(np.int64)] += rows[["target", "raw"]].to_numpy(float).T
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return logs[0] - logs[1], share if share is not None else 1.0


def _score(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found, text = features(rows["text"], len(ratios))
            n, weights = np.bincount(text, minlength=len(rows)), np.bincount(text, ratios[found], len(rows))
            names = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in names), pa.array(n), pa.array(weights)], [*names, "n_features", "log_weight"])

    return run


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a column of longs, by counting in ever narrower bins."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = df.where(F.col(key).between(low, high))
        counts = inside.groupBy(F.expr(f"({key} - ({low})) div {width}").alias("bin")).count()
        for at, n in sorted(((r["bin"], r["count"]) for r in counts.collect()), reverse=True):
            if k <= n:
                break
            k -= n
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """``doc_id``, ``n_features``, ``log_weight``, ``key`` and ``kept`` for each row of ``docs``.

    ``share``: of the rows to keep; by default that of the labels that make the target (quality 1, not toxic)."""
    scored = _scored(docs, labels, share, seed, buckets, max_labels)
    return scored.drop("text_key")


def _scored(docs: DataFrame, labels: DataFrame, share: float | None, seed: int, buckets: int, max_labels: int) -> DataFrame:
    """``resample`` with ``text_key``, a hash of the text, which tells rows of one id apart."""
    ratios, good = log_ratios(docs, labels, buckets, max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    scored = texts.mapInArrow(_score(ratios), "doc_id long, text_key long, n_features long, log_weight double")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(unit)))
    keyed = settle(keyed.withColumn("__key", F.round(F.col("key") * 1e6).cast("long")))
    k = round((good if share is None else share) * keyed.count())
    least = kth_largest(keyed, "__key", k)
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("__key") >= least).drop("__key")


def keep_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs`` that were drawn, those with a null id among them."""
    drawn = _scored(docs, labels, share, seed, buckets, max_labels).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left_semi")
