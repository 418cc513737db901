"""Ids of 64 bits beside null ones, very long texts, null and repeated rows: every operator and the pipeline."""

import random
import zlib

import pytest

import corpus_pipeline
from trackloom.llm import decontamination, importance, quality_rules, registry, repeats, secrets

BIG = 2**60 + 1
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
ITEM = "what is the capital city of france and how many people live there today"


def text(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", f"word{rng.randrange(10**6)}", f"word{rng.randrange(10**6)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """One partition: big ids, a null one between them, repeated rows, null and empty texts and a long one."""
    folder = str(tmp_path_factory.mktemp("sf"))
    long = text(9, 60_000)
    rows = [(BIG, text(1)), (None, text(2)), (BIG + 2, text(3)), (BIG + 4, text(1)), (BIG + 6, None), (BIG + 8, ""), (BIG + 10, text(3) + " tail"), (5, text(5)), (5, text(5))]
    rows += [(6, f"{long} {ITEM} private_key=Zx8Qp2LmN7vB4kT9sW3eR6yU1iO5aHdF"), (7, f"{text(7)} {ITEM}"), (None, None)]
    docs = [(i, t, "en", "x", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(BIG, 1, 0), (5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def ids_of(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


ONE_ROW_EACH = ["op2_sharding", "op3_importance", "op5_quality_rules", "op6_secrets", "op7_near_duplicates", "op8_token_counts", "op10_language_model"]


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_every_id_comes_back(spark, sf, name):
    folder, rows = sf
    assert ids_of(registry.QUERIES[name](spark, folder)) == sorted(str(i) for i, _ in rows)


def test_ids_of_the_others(spark, sf):
    folder, rows = sf
    assert set(ids_of(registry.op9_packing(spark, folder))) == {str(i) for i, _ in rows}
    assert ids_of(registry.op4_decontamination(spark, folder)) == ["6", "7"]
    found = registry.op1_repeats(spark, folder).select("doc_id", "kept_doc_id").distinct().collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} >= {(BIG + 4, BIG), (BIG + 10, BIG + 2), (5, 5)}


def test_groups_of_big_ids(spark, sf):
    folder, _ = sf
    got = {r.doc_id: r.component_id for r in registry.op7_near_duplicates(spark, folder).where("doc_id IS NOT NULL").collect()}
    assert got == {BIG: BIG, BIG + 2: BIG + 2, BIG + 4: BIG, BIG + 6: BIG + 6, BIG + 8: BIG + 8, BIG + 10: BIG + 2, 5: 5, 6: 6, 7: 7}


def test_whole_columns_pass_redaction(spark, sf):
    rows = [(BIG, "auth=Zx8Qp2LmN7vB4kT9sW3eR6yU1iO5aHdF", None, BIG), (None, None, 3, None), (BIG + 2, "plain", None, 2**62 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, small int, other long").coalesce(1)
    got = sorted(map(tuple, secrets.redact(docs).collect()), key=str)
    assert got == sorted([(BIG, "auth=[secret]", None, BIG), *rows[1:]], key=str)


def test_long_texts_are_read_whole(spark, sf):
    folder, rows = sf
    n = len(dict(rows)[6].split())
    one = lambda name: registry.QUERIES[name](spark, folder).where("doc_id = 6").first()
    assert one("op3_importance").n_features == 2 * n - 1
    assert one("op5_quality_rules").n_words == n and one("op10_language_model").n_tokens == n + 1
    assert one("op6_secrets").spans.startswith("novel:") and int(one("op6_secrets").spans.split(":")[2]) == len(dict(rows)[6])


def test_shard_columns(spark, sf):
    folder, rows = sf
    got = registry.op2_sharding(spark, folder).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert len({r.shard for r in got}) == len(rows) and {r.slot for r in got} == {0}
    assert registry.op2_sharding(spark, folder).columns[:7] == "doc_id size text_crc32 law shard slot grown_shard".split()


def test_rows_of_one_id_are_told_apart(spark):
    """Two texts of one id, and of none: what is found in one row is not taken from the other."""
    line = "this very line of words stands in two rows of the table"
    rows = [(1, f"{line}\nfirst of its kind"), (2, f"{line}\nand more"), (2, "x" * 60 + "\nanother text without it"), (None, text(20)), (None, f"{text(21)}\n{line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.text for r in repeats.remove_repeats(docs, min_words=1).collect()}
    assert sum(line in t for t in left) == 1 and rows[2][1] in left and rows[3][1] in left
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.keep_sample(docs, labels, share=1.0).count() == len(rows)
    bench = spark.createDataFrame([(1, line)], "item_id long, text string")
    assert {r.text for r in decontamination.remove_overlaps(docs, bench).collect()} == {rows[2][1], rows[3][1]}


def test_pipeline_over_the_edges(spark, sf):
    folder, rows = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = stage(spark, docs, folder)
        assert k == 4 or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if k == 0:
            assert ids_of(docs) == sorted(str(i) for i, t in rows if t)
            docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
    assert ids_of(docs.where("piece = 0")) == sorted([str(BIG), str(BIG + 2), "5", "None"])


def test_pipeline_against_plain_python(spark):
    """All five stages rebuilt from their rules: counts, all pairs of shingle sets, tokens laid side by side, the
    contract's patterns (and the scanner's own spans), the library's ids."""
    import re
    from collections import Counter

    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    stop = set(quality_rules.STOP_WORDS.split())

    def good(t):
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        n = len(words)
        if n < 20 or 100 * len(covered) > 30 * n:
            return False
        share = lambda m: m / n
        return (
            2 <= share(sum(map(len, words))) <= 14
            and share(len(re.findall(r"[#*$%&|<>]", t))) <= 0.3
            and share(t.count("!")) <= 0.3
            and share(sum(w.lower() in stop for w in words)) >= 0.02
            and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.5
        )

    kept = [(i, t) for i, t in docs if good(t)]
    sets = {i: {tuple(w[k : k + 5]) for w in [split(t.encode().lower().decode())] for k in range(max(1, len(w) - 4))} for i, t in kept}
    root = {i: i for i in sets}
    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[:k]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    kept = [(i, t) for i, t in kept if root[i] == i]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def holds(have, want):
        where = {}
        for k, w in enumerate(have):
            where.setdefault(w, []).append(k)
        same = {}
        for j, w in enumerate(want):
            for k in where.get(w, ()):
                same.setdefault(k - j, []).append(j)
        return any(len(s) >= 0.8 * len(want) or any(sum(j <= x < j + 13 for x in s) >= 11 for j in s) for s in same.values())

    kept = [(i, t) for i, t in kept if not any(holds(tokens(t), tokens(w)) for _, w in items)]
    base = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""")
    library, want = Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json")), set()
    for i, t in kept:
        spans, masked, at = [(s, e) for s, _, e in secrets.Scanner().spans(t)], "", 0
        assert all(any(s <= m.start() and m.end() <= e for s, e in spans) for m in base.finditer(t))
        for s, e in sorted(spans):
            if s >= at:
                masked += t[at:s] + "[secret]"
            at = max(at, e)
        ids = [*library.encode(masked + t[at:], add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = b"".join(x.to_bytes(4, "little") for x in ids[start : start + 2048])
            want.add((i, piece, start, len(part) // 4, zlib.crc32(part)))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want) > 100


def test_quality_stage_keeps_the_callers_columns(spark):
    good = " ".join(f"the word{k} of it" for k in range(30))
    rows = [(1, good, 99, False, "x", 7.5), (2, None, 1, True, None, 0.0), (None, good, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean, label string, pass_stop_words double")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted((rows[0], rows[2]), key=str)
    masked = corpus_pipeline.mask_secrets(spark, docs, "")
    assert masked.columns == docs.columns and masked.count() == 3
