"""Global identities: purity, summaries, pairwise evaluation, scores and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import mean, weighted

#: Weights of the scores.
REID_WEIGHTS = {"mean_global_id_purity": 0.40, "mixed_gid_quality": 0.25, "fragment_reduction_quality": 0.25, "merge_quality": 0.10}
FINAL_WEIGHTS = {"tracking_score": 0.60, "reid_score": 0.40}

#: Hints, by the condition that calls for them ({t}: the cross-camera threshold).
REID_HINTS = {
    "num_cross_camera_merged = 0 AND abs(max_cross_similarity - {t}) <= 0.04": "Belum ada merge lintas kamera, tetapi similarity tertinggi dekat threshold. Turunkan cross_threshold sedikit jika GT mendukung.",
    "num_cross_camera_merged > 3": "Merge lintas kamera cukup banyak. Naikkan cross_threshold atau aktifkan MNN untuk menekan false merge.",
    "num_intra_camera_merged = 0 AND num_merged_pairs = 0": "Tidak ada fragment yang tersambung. Jika track satu kamera terpecah, aktifkan strict intra atau turunkan intra_threshold.",
    "identity_precision < 0.90": "Evaluasi GT menunjukkan indikasi false merge. Naikkan threshold dan perketat filter track.",
    "top_unmerged_cross_similarity >= {t}": "Ada pasangan similarity tinggi yang tidak di-merge. Cek MNN dan overlap temporal sebelum menurunkan threshold.",
}

#: Colours (blue, green, red) of identities 1 to 12.
PALETTE = (
    (255, 255, 0),
    (0, 255, 255),
    (255, 0, 255),
    (0, 180, 255),
    (80, 255, 80),
    (255, 120, 80),
    (120, 80, 255),
    (0, 255, 140),
    (255, 200, 0),
    (180, 255, 0),
    (0, 128, 255),
    (255, 0, 128),
)

#: What is said of the pairwise evaluation.
NO_TRACK_TRUTH = "GT track-level data tidak tersedia; pairwise Re-ID evaluation tidak aktif."
NO_PAIR = "Tidak ada pasangan track valid untuk pairwise Re-ID evaluation."
NO_POSITIVE_PAIR = "No positive association pair available; Re-ID association is not required for this case."
SOME_POSITIVE_PAIR = "Pairwise association evaluation tersedia karena ada minimal satu positive GT pair."

EVALUATED = ("TP_pair", "FP_pair", "FN_pair", "TN_pair")


def _names(column: str):
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def evaluate_identities(identities: DataFrame, matched: DataFrame) -> DataFrame:
    """What each identity holds; it is pure with at most one true identity inside."""
    real = matched.where("gt_id > 0").select("track_key", "camera", "gt_id").distinct()
    joined = identities.select("global_id", "track_key", "camera").join(real, ["track_key", "camera"], "left")
    grouped = joined.groupBy("global_id").agg(
        _names("track_key").alias("tracks"),
        _names("camera").alias("cameras"),
        F.array_sort(F.collect_set("gt_id")).alias("ids"),
        F.countDistinct("track_key").alias("num_tracks"),
        F.countDistinct("camera").alias("num_cameras"),
    )
    inside = F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]"))
    return grouped.select("global_id", "tracks", "cameras", inside.alias("gt_ids_inside"), "num_tracks", "num_cameras", (F.size("ids") <= 1).alias("is_pure_global_id"), F.element_at(F.concat("ids", F.array(F.lit(None).cast("int"))), 1).alias("least_gt_id"))


def identity_totals(evaluated: DataFrame) -> DataFrame:
    pure = F.col("is_pure_global_id")
    return evaluated.agg(
        F.count(F.lit(1)).alias("total_global_ids"),
        F.count(F.when(F.col("num_tracks") > 1, 1)).alias("matched_global_ids"),
        F.coalesce(F.count(F.when(pure, 1)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("pure_global_id_rate"),
        F.count(F.when(~pure, 1)).alias("false_merge_count"),
    )


def summarize_identities(identities: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Members, cameras and span of each identity, with its least true identity and purity 0 or 1."""
    base = identities.groupBy("global_id").agg(
        F.countDistinct("track_key").alias("num_tracks"),
        _names("camera").alias("cameras"),
        F.countDistinct("camera").alias("num_cameras"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        _names("track_key").alias("members"),
    )
    pure = evaluated.select("global_id", F.col("least_gt_id").alias("dominant_gt_id"), F.col("is_pure_global_id").cast("double").alias("global_id_purity"), (~F.col("is_pure_global_id")).alias("is_mixed_gid"))
    return base.join(pure, "global_id", "left")


def representatives(identities: DataFrame) -> DataFrame:
    """Each identity's track with the largest mean area (then confidence, then least key), and its members."""
    best = F.min_by("track_key", F.struct((-F.col("avg_area")).alias("a"), (-F.col("avg_conf")).alias("c"), "track_key"))
    members = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("camera", "track_id", "track_key"))), lambda m: m["track_key"]))
    return identities.groupBy("global_id").agg(best.alias("representative"), members.alias("members_json"), _names("camera").alias("cameras"))


def merge_evidence(verdicts: DataFrame, identities: DataFrame) -> DataFrame:
    """Merged pairs with their identity and whether they lie within a camera."""
    ids = identities.select(F.col("track_key").alias("track_a"), "global_id")
    kind = F.when(F.col("camera_a") == F.col("camera_b"), "intra_camera").otherwise("cross_camera")
    return verdicts.where("merge_status").join(ids, "track_a").select("global_id", "track_a", "track_b", "camera_a", "camera_b", kind.alias("merge_type"), "cosine_similarity", "merge_reason")


def pairwise_detail(identities: DataFrame, truth: DataFrame, verdicts: DataFrame, min_purity: float = 0.8) -> DataFrame:
    """Every pair of tracks (a row of ``verdicts``), judged by identity and by dominant truth."""
    known = tracks_judged(identities, truth)
    side = lambda x: known.select(F.col("track_key").alias(f"track_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in JUDGED])
    return judged_pairs(verdicts.join(side("a"), "track_a").join(side("b"), "track_b"), min_purity)


#: What a track is judged by in a pair.
JUDGED = ["global_id", "dominant_gt_id", "track_purity"]


def tracks_judged(identities: DataFrame, truth: DataFrame) -> DataFrame:
    return identities.select("track_key", "global_id").join(truth.select("track_key", "dominant_gt_id", F.col("track_gt_purity").alias("track_purity")), "track_key", "left")


def judged_pairs(joined: DataFrame, min_purity: float = 0.8) -> DataFrame:
    """``pairwise_detail`` of pairs that hold both tracks' ``JUDGED``."""
    real = F.coalesce((F.col("dominant_gt_id_a") > 0) & (F.col("dominant_gt_id_b") > 0), F.lit(False))
    pure = F.coalesce((F.col("track_purity_a") >= min_purity) & (F.col("track_purity_b") >= min_purity), F.lit(False))
    same_gt = F.when(real, F.col("dominant_gt_id_a") == F.col("dominant_gt_id_b"))
    same_id = F.coalesce(F.col("global_id_a") == F.col("global_id_b"), F.lit(False))
    kind = (
        F.when(~real, "skipped_no_gt")
        .when(~pure, "skipped_low_purity")
        .when(same_gt & same_id, "TP_pair")
        .when(same_gt, "FN_pair")
        .when(same_id, "FP_pair")
        .otherwise("TN_pair")
    )
    return joined.select(
        *("track_a track_b camera_a camera_b global_id_a global_id_b dominant_gt_id_a dominant_gt_id_b track_purity_a track_purity_b".split()),
        same_gt.alias("same_gt"),
        (F.col("global_id_a") == F.col("global_id_b")).alias("same_global_id"),
        kind.alias("pair_eval_type"),
        *("cosine_similarity temporal_gap temporal_overlap merge_status merge_reason".split()),
        F.when(F.col("merge_reason").startswith("blocked_"), F.col("merge_reason")).alias("reject_reason"),
    )


def _pair_counts(tracks: DataFrame) -> DataFrame:
    """How many pairs of tracks are of each kind, from the sizes of groups: no pair becomes a row."""
    cells = tracks.groupBy("global_id", "dominant_gt_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda name: F.coalesce(F.expr("sum(n * (n - 1) div 2)"), F.lit(0)).alias(name)
    within = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n"))
    row = cells.where("global_id IS NOT NULL").agg(pairs("tp_pair"))
    for name, groups in (("same_gt", within("dominant_gt_id")), ("same_id", within("global_id").where("global_id IS NOT NULL")), ("all", cells.agg(F.sum("n").alias("n")))):
        row = row.crossJoin(groups.agg(pairs(f"{name}_pair")))  # rows of one row each
    fp, fn = F.col("same_id_pair") - F.col("tp_pair"), F.col("same_gt_pair") - F.col("tp_pair")
    return row.select("tp_pair", fp.alias("fp_pair"), fn.alias("fn_pair"), (F.col("all_pair") - F.col("same_gt_pair") - fp).alias("tn_pair"))


def pairwise_summary(identities: DataFrame, truth: DataFrame, min_purity: float = 0.8) -> DataFrame:
    """One row over all pairs of tracks, as ``pairwise_detail`` judges them; the ratios are null where no two
    tracks should have been one. Three cases have a row of their own: without tracks or their truth nothing is
    available; without a pair to judge purity and the later counts are null; without two tracks that should
    have been one the ratios are."""
    there = identities.agg((F.count(F.lit(1)) > 0).alias("some_ids")).crossJoin(truth.agg((F.count(F.lit(1)) > 0).alias("some_truth")))  # one row each
    tracks = identities.select("track_key", "global_id").join(truth, "track_key").where((F.col("dominant_gt_id") > 0) & (F.col("track_gt_purity") >= min_purity))
    per_id = tracks.groupBy("global_id").agg(F.countDistinct("dominant_gt_id").alias("n"))
    row = _pair_counts(tracks)
    row = row.crossJoin(tracks.agg(F.countDistinct("track_key").alias("num_eval_tracks"), F.countDistinct("dominant_gt_id").alias("expected_global_ids"), F.countDistinct("global_id").alias("num_global_ids")))
    row = row.crossJoin(per_id.agg(F.count(F.when(F.col("n") > 1, 1)).alias("mixed_gid_count"), F.avg((F.col("n") <= 1).cast("double")).alias("mean_global_id_purity")))
    row = row.crossJoin(there).withColumn("some_ids", F.col("some_ids") & F.col("some_truth"))
    tp, fp, fn = F.col("tp_pair"), F.col("fp_pair"), F.col("fn_pair")
    known, judged = tp + fn > 0, tp + fp + fn + F.col("tn_pair") > 0
    if_judged = lambda c: F.when(judged, c)
    note = F.when(~F.col("some_ids"), NO_TRACK_TRUTH).when(~judged, NO_PAIR).when(known, SOME_POSITIVE_PAIR).otherwise(NO_POSITIVE_PAIR)
    precision, recall = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    return row.select(
        F.col("some_ids").alias("score_available"),
        known.alias("association_eval_available"),
        "num_eval_tracks",
        (tp + fn).alias("positive_pair_count"),
        (fp + F.col("tn_pair")).alias("negative_pair_count"),
        (tp + fp).alias("predicted_positive_pair_count"),
        *[c.lower() for c in EVALUATED],
        F.when(known, precision).alias("pairwise_precision"),
        F.when(known, recall).alias("pairwise_recall"),
        F.when(known, 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)).alias("pairwise_f1"),
        F.when(known, fp / F.greatest(F.lit(1), tp + fp)).alias("false_merge_rate"),
        F.when(known, fn / F.greatest(F.lit(1), tp + fn)).alias("false_split_rate"),
        *[if_judged(F.col(c)).alias(c) for c in ("mean_global_id_purity", "mixed_gid_count", "expected_global_ids", "num_global_ids")],
        if_judged(F.greatest(F.lit(0), F.col("num_eval_tracks") - F.col("expected_global_ids"))).alias("reduction_required"),
        if_judged(F.greatest(F.lit(0), F.col("num_eval_tracks") - F.col("num_global_ids"))).alias("reduction_achieved"),
        note.alias("note"),
    )


def confusion(summary: DataFrame) -> DataFrame:
    """The 2 x 2 matrix as rows."""
    cells = "stack(2, 'same_gt', tp_pair, fn_pair, 'different_gt', fp_pair, tn_pair) AS (actual, same_global_id, different_global_id)"
    return summary.selectExpr(cells)


def reid_score(identities: DataFrame, verdicts: DataFrame, totals: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: reduction of fragments, purity and merge quality, and their weighted score."""
    row = identities.agg(F.countDistinct("track_key").alias("num_local_tracks"), F.countDistinct("global_id").alias("num_global_ids"))
    row = row.crossJoin(verdicts.agg(F.count(F.when(F.col("merge_status"), 1)).alias("num_merged_pairs")))
    row = row.crossJoin(totals.select(F.col("pure_global_id_rate").alias("mean_global_id_purity"), F.col("false_merge_count").alias("mixed_gid_count")))
    row = row.crossJoin(matched.where("gt_id > 0").agg(F.countDistinct("gt_id").alias("expected_global_ids")))
    row = row.withColumns(
        {
            "reduction_required": F.greatest(F.lit(0), F.col("num_local_tracks") - F.col("expected_global_ids")),
            "reduction_achieved": F.greatest(F.lit(0), F.col("num_local_tracks") - F.col("num_global_ids")),
            "mixed_gid_quality": 1 - F.col("mixed_gid_count") / F.greatest(F.lit(1), F.col("num_global_ids")),
        }
    )
    none = F.col("reduction_required") == 0
    row = row.withColumns(
        {
            "fragment_reduction_quality": F.when(none, 1.0).otherwise(F.least(F.lit(1.0), F.col("reduction_achieved") / F.greatest(F.lit(1), F.col("reduction_required")))),
            "merge_quality": F.when(none & (F.col("mixed_gid_count") == 0), 1.0).when(F.col("num_merged_pairs") > 0, F.col("mean_global_id_purity")).otherwise(0.0),
        }
    )
    return row.withColumn("reid_score", weighted(REID_WEIGHTS))


def final_score(tracking: DataFrame, reid: DataFrame) -> DataFrame:
    """Both scores of the case and their weighted mean; unavailable if either is."""
    both = tracking.where("scope = 'all'").select("score_available", "tracking_score").crossJoin(reid.select("reid_score"))
    known = F.col("score_available") & F.col("reid_score").isNotNull()
    return both.select(known.alias("score_available"), F.when(known, weighted(FINAL_WEIGHTS)).alias("final_pipeline_score"), "tracking_score", "reid_score")


def diagnostics(identities: DataFrame, verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """One row on an association run."""
    merged, cross, sim = F.col("merge_status"), ~F.col("same_camera"), F.col("cosine_similarity")
    row = verdicts.agg(
        F.count(F.lit(1)).alias("num_pairs"),
        F.count(F.when(merged, 1)).alias("num_merged_pairs"),
        F.count(F.when(cross, 1)).alias("num_cross_camera_pairs"),
        F.count(F.when(cross & merged, 1)).alias("num_cross_camera_merged"),
        F.count(F.when(~cross & merged, 1)).alias("num_intra_camera_merged"),
        F.max(F.when(cross, sim)).alias("max_cross_similarity"),
        F.max(F.when(cross & ~merged, sim)).alias("top_unmerged_cross_similarity"),
    )
    return _diagnosed(row, verdicts.where("merge_status"), identities, totals)


def diagnostics_of_merges(identities: DataFrame, merged: DataFrame, totals: DataFrame, best: DataFrame, best_unmerged: DataFrame) -> DataFrame:
    """As ``diagnostics``, without a row for each pair: numbers of pairs come from the tracks of each camera, the most
    similar ones from each track's best partner in other cameras, and from its best one it isn't merged with."""
    cameras = identities.groupBy("camera").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    row = cameras.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("within")).select(pairs(F.col("n")).alias("num_pairs"), "within")
    cross = ~F.col("same_camera")
    row = row.crossJoin(merged.agg(F.count(F.lit(1)).alias("num_merged_pairs"), F.count(F.when(cross, 1)).alias("num_cross_camera_merged"), F.count(F.when(~cross, 1)).alias("num_intra_camera_merged")))
    row = row.crossJoin(best.agg(F.max("cosine_similarity").alias("max_cross_similarity"))).crossJoin(best_unmerged.agg(F.max("cosine_similarity").alias("top_unmerged_cross_similarity")))
    row = row.withColumn("num_cross_camera_pairs", F.col("num_pairs") - F.col("within"))
    names = "num_pairs num_merged_pairs num_cross_camera_pairs num_cross_camera_merged num_intra_camera_merged max_cross_similarity top_unmerged_cross_similarity"
    return _diagnosed(row.select(*names.split()), merged, identities, totals)


def _diagnosed(row: DataFrame, merged: DataFrame, identities: DataFrame, totals: DataFrame) -> DataFrame:
    counts = merged.groupBy("merge_reason").agg(F.count(F.lit(1)).alias("n"))
    row = row.crossJoin(counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("merge_reason", "n"))))).alias("merge_reason_counts")))
    row = row.crossJoin(identities.agg(F.countDistinct("track_key").alias("num_local_tracks"), F.countDistinct("global_id").alias("num_global_ids")))
    rate = F.col("pure_global_id_rate")  # stands for all three
    return row.crossJoin(totals.select(*[rate.alias(f"identity_{n}") for n in ("precision", "recall", "f1")]))


def overlay_labels(labelled: DataFrame) -> DataFrame:
    """What is drawn on a box: its label (short on small boxes), the colour of its identity, from the palette
    or else by its hue, and the text's, black (0) on light colours and white (255) on dark ones."""
    gid = F.coalesce("global_id", "track_id")
    small = (F.col("x2") - F.col("x1") < 80) | (F.col("y2") - F.col("y1") < 100)
    label = F.when(small, F.concat(F.lit("G"), gid, F.lit("|T"), F.col("track_id"))).otherwise(F.concat(F.lit("GID:"), gid, F.lit(" | T"), F.col("track_id")))
    hue = gid * 67 % 180
    palette = F.array(*[F.array(*map(F.lit, c)) for c in PALETTE])

    def shade(place: int, sector: int):
        """Of a colour with saturation 230 and value 255; a hue is 1/30 of a sector."""
        at = (hue / 30 + sector) % 6
        mixed = F.round(255 - 230 * F.greatest(F.lit(0.0), F.least(at, 4 - at, F.lit(1.0)))).cast("int")
        return F.when(gid.between(1, len(PALETTE)), F.get(F.get(palette, gid.cast("int") - 1), F.lit(place))).otherwise(mixed)

    coloured = labelled.select("det_id", "camera", "frame", label.alias("label"), hue.alias("hue"), shade(0, 1).alias("blue"), shade(1, 3).alias("green"), shade(2, 5).alias("red"))
    light = 0.114 * F.col("blue") + 0.587 * F.col("green") + 0.299 * F.col("red")
    return coloured.withColumn("text_colour", F.when(light >= 150, 0).otherwise(255))
