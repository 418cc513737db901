"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens: marked positions are hashed, the others are
ignored, so a hit survives substitutions at the ignored places. Every position of every document
is hashed under each mask and joined with the hashes of the benchmark. Around each hit the item is
laid along the document and compared token by token; an item counts as found if 80 % of its
tokens agree, or 11 of 13 within some window of 13.

Three masks find every such place of items of 8 to 25 tokens (by enumeration of all substitutions)
but for one pattern at 10 and one at 15 tokens; a fourth mask is there for these lengths. Items of
fewer than 8 tokens have masks of their own: all tokens up to 4, where nothing may differ, and all
but one of 5 to 7. Masks for lengths that the benchmark has no item of aren't hashed.

The documents are never shuffled: the benchmark's hashes are broadcast, in pieces of at most
``BROADCAST_SEEDS`` for each of which the documents are read once more, and only hits leave the
scan. Hits are reduced to one row for each document and item before anything else is done with
them.

Tokens are runs of letters and digits of the lower-cased text. Defined results: null or empty
texts match nothing, nor do items without tokens; texts of any length are searched whole; null ids
form one group in the result, but their rows are searched and removed each by itself; repeated rows
count as one; an empty table on either side gives no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import at_most, settle

#: The masks. 1: the token is hashed.
MASKS = ("111011", "1101011", "11001011")
#: The mask for items of these lengths, and the lengths whose masks are built from them.
FOURTH, FOURTH_FOR, SHORT = "11011", (10, 15), range(1, 8)

#: Seeds that are broadcast at once (about 100 bytes each).
BROADCAST_SEEDS = 500_000

WINDOW, WINDOW_AGREE = 13, 11


def masks_for(lengths: list[int], share: float) -> list[tuple[str, tuple[int, ...]]]:
    """Masks, each with the item lengths it is for (none named: all beyond ``SHORT``)."""
    found = [(m, ()) for m in MASKS]
    if set(FOURTH_FOR) & set(lengths):
        found.append((FOURTH, FOURTH_FOR))
    for n in sorted(set(lengths) & set(SHORT)):
        if share * n > n - 1:
            found.append(("1" * n, (n,)))
        else:
            # without the first or the last token, which may lie beyond the document's edge, and without one between
            found.append(("1" * (n - 1), (n,)))
            found += [("1" * k + "0" + "1" * (n - 1 - k), (n,)) for k in range(1, n - 1)]
    return found


def _tokens(text: str) -> str:
    return rf"transform(regexp_extract_all(lower(`{text}`), '[\\p{{L}}\\p{{N}}]+', 0), t -> xxhash64(t))"


def _seed_hash(number: int, mask: str) -> str:
    marked = ", ".join(f"get(w, i + {k})" for k, c in enumerate(mask) if c == "1")
    return f"xxhash64({number}, {marked})"


def _seeds(df: DataFrame, words: str, prefix: str, masks: list[tuple[str, tuple[int, ...]]], whole: bool) -> DataFrame:
    """A row for each position and mask, without the words: ``<prefix>_at`` and ``<prefix>_seed``.

    ``words``: SQL for the tokens, bound once for each text by the outer function. ``whole``: masks
    that reach over the end or are for other lengths give none; elsewhere such seeds meet no other."""
    keys = [c for c in df.columns if c not in ("words", "text")]
    fits = lambda m, n: f"i <= size(w) - {len(m)} AND " + (f"size(w) IN ({', '.join(map(str, n))})" if n else f"size(w) > {max(SHORT)}")
    seed = lambda k, m, n: f"IF({fits(m, n)}, {_seed_hash(k, m)}, NULL)" if whole else _seed_hash(k, m)
    hashes = ", ".join(f"named_struct('at', i, 'seed', {seed(k, *m)})" for k, m in enumerate(masks))
    least = min(len(m) for m, _ in masks)
    each = f"transform(array({words}), w -> IF(size(w) < {least}, array(), flatten(transform(sequence(0, size(w) - {least}), i -> array({hashes})))))[0]"
    places = df.select(*keys, F.explode(F.expr(each)).alias("__p"))
    found = places.select(*keys, F.col("__p.at").alias(f"{prefix}_at"), F.col("__p.seed").alias(f"{prefix}_seed"))
    return found.where(f"{prefix}_seed IS NOT NULL") if whole else found


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = 0.8,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each document and item found in it: ``doc_id``, ``item_id``, ``item_tokens``,
    ``agreeing`` (most tokens in agreement) and ``first_token`` (where the item starts in the
    document; the least among equals)."""
    return _summed(_overlaps(docs, benchmark, share, id_col, text, item_col, item_text))


def _key(id_col: str, text: str):
    return F.xxhash64(F.col(id_col), F.col(text))


def _overlaps(docs: DataFrame, benchmark: DataFrame, share: float, id_col: str, text: str, item_col: str, item_text: str) -> DataFrame:
    """A row for each place where an item is found, with the document's row key."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.expr(_tokens(item_text)).alias("words")).where(F.size("words") > 0).dropDuplicates()
    items = settle(items.withColumn("item_key", F.xxhash64("item_id", "words")))
    special = [*SHORT, *FOURTH_FOR]
    lengths = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n").isin(special)).distinct().collect()]
    masks = masks_for(lengths, share)
    seeds = settle(_seeds(items.select("item_key", "words"), "words", "item", masks, whole=True))
    pieces = max(1, -(-seeds.count() // BROADCAST_SEEDS))
    texts = docs.select(_key(id_col, text).alias("row_key"), F.col(text).alias("text"))
    hits = None
    for k in range(pieces):
        piece = F.broadcast(seeds.where(F.pmod("item_seed", F.lit(pieces)) == k))
        some = _seeds(texts, _tokens("text"), "doc", masks, whole=False).join(piece, F.col("doc_seed") == F.col("item_seed"))
        hits = some if hits is None else hits.unionByName(some)
    # Several seeds of one item that lie alike make one alignment.
    laid = settle(hits.select("row_key", "item_key", (F.col("doc_at") - F.col("item_at")).alias("first_token")).distinct())
    keys = laid.select("row_key").distinct()
    held = docs.select(_key(id_col, text).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    held = held.join(F.broadcast(keys) if at_most(keys, BROADCAST_SEEDS) else keys, "row_key", "left_semi").dropDuplicates(["row_key"])
    whole = laid.join(held.select("row_key", "doc_id", F.expr(_tokens("text")).alias("words")), "row_key")
    named = items.select("item_key", "item_id", F.col("words").alias("item_words"))
    whole = whole.join(F.broadcast(named) if pieces == 1 else named, "item_key")
    same = whole.select(
        "row_key",
        "doc_id",
        "item_id",
        F.size("item_words").alias("item_tokens"),
        "first_token",
        F.expr(
            "filter(sequence(0, size(item_words) - 1), k -> first_token + k >= 0"
            " AND get(words, first_token + k) = item_words[k])"
        ).alias("same"),
    )
    in_window = F.expr(
        f"exists(same, k -> size(filter(same, j -> j >= k AND j < k + {WINDOW})) >= {WINDOW_AGREE})"
    )
    agreeing = F.size("same")
    return same.where((agreeing >= F.lit(share) * F.col("item_tokens")) | ((agreeing >= WINDOW_AGREE) & in_window))


def _summed(found: DataFrame) -> DataFrame:
    agreeing = F.size("same")
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(agreeing.alias("n"), (-F.col("first_token")).alias("at"), F.col("item_tokens").alias("m"))).alias("b")
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.m").alias("item_tokens"),
        F.col("b.n").alias("agreeing"),
        (-F.col("b.at")).alias("first_token"),
    )


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, whatever their ids."""
    places = _overlaps(docs, benchmark, share, id_col, text, item_col, item_text)
    found = settle(places.select(F.col("row_key").alias("__key")).distinct())
    return docs.join(F.broadcast(found) if at_most(found, BROADCAST_SEEDS) else found, _key(id_col, text) == F.col("__key"), "left_anti")
