"""One query for each operator, over the adapted test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry
from trackloom.operators import association, blocks, identities, matching, overviews, tracks
from trackloom.plans import adapters
from trackloom.sources import ground_truth as annotations
from trackloom.sources import catalog, runs
from trackloom.sources.stages import expired, export_csv, read_csv, run_id, settle, shared_folder
from trackloom.streaming.tracks import closed_tracks, closed_tracks_by_frame

LIMITS = tracks.Limits(min_frames=30, min_crops=24)
RULES = association.Rules(cross_threshold=0.30, intra_threshold=0.25, max_gap=60, max_overlap=0)
QUERIES: dict = {}
#: What no reader of matches looks at.
UNREAD = ["x1", "y1", "x2", "y2", "crop_path", "user_id"]


def query(f):
    QUERIES[f.__name__] = f
    return f


class Case:
    """The inputs and intermediate tables of one scale, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}
        self.det = matching.to_source_frames(adapters.detections(spark, sf_dir), adapters.SOURCE_START)

    def gt(self, gt_id: str = adapters.BY_BOX) -> DataFrame:
        return adapters.ground_truth(self.spark, self.sf_dir, gt_id)

    def judged(self) -> DataFrame:
        return tracks.judge(tracks.summarize(self.det), LIMITS)

    def valid(self) -> DataFrame:
        return tracks.keep_valid(self.det, self.judged())

    def matched(self, gt_id: str = adapters.BY_BOX) -> DataFrame:
        """A settled stage, as most of its readers read it several times."""
        if gt_id not in self.made:
            self.made[gt_id] = settle(matching.match(self.det, self.gt(gt_id)).drop(*UNREAD))
        return self.made[gt_id]

    def match_both(self) -> None:
        """Both matches from one pass, as they differ by the names of the same boxes only."""
        gt = adapters.ground_truth(self.spark, self.sf_dir, adapters.BY_BOX, by_user=adapters.BY_USER)
        both = settle(matching.match(self.det, gt, also=("by_user",)).drop(*UNREAD))
        self.made[adapters.BY_BOX] = both.drop("by_user")
        self.made[adapters.BY_USER] = both.withColumn("gt_id", F.coalesce("by_user", F.lit(-1))).drop("by_user")

    def vectors(self) -> DataFrame:
        # settled, as they are read twice; a track's key tells its camera and number
        means = tracks.track_vectors(settle(adapters.crop_vectors(self.spark, self.sf_dir))).drop("num_crops")
        return tracks.full_span(means, self.det, ("camera", "track_id"))

    def associate(self, every_best: bool = False) -> tuple[association.Associated, DataFrame, DataFrame]:
        """What association found, the merged pairs, and identities; each a settled stage. No pair that isn't a
        candidate becomes a row."""
        vectors = settle(self.vectors().drop("num_frames"))  # frames aren't counted, as nothing below asks for it
        found = association.associate(vectors, RULES, every_best)
        ids = association.number_clusters(vectors.drop("vector"), found.tracks.select("track_key", "root"))
        return found, found.merged, settle(ids)


@query
def q_track_summary(spark, sf_dir):
    return tracks.summarize(Case(spark, sf_dir).det)


@query
def q_filter_reasons(spark, sf_dir):
    return Case(spark, sf_dir).judged().select("track_key", "pass_min_frames", "pass_min_crops", "pass_min_avg_conf", "pass_min_avg_area", "is_valid", "status", "filter_reason")


@query
def q_valid_rows(spark, sf_dir):
    return Case(spark, sf_dir).valid().select("det_id", "camera", "track_key", "frame")


@query
def q_source_frame(spark, sf_dir):
    return Case(spark, sf_dir).det.select("det_id", "source_frame")


@query
def q_gt_match(spark, sf_dir):
    case = Case(spark, sf_dir)
    return matching.match(case.det, case.gt()).where("is_matched").select("det_id", "gt_id", F.round("gt_iou", 9).alias("gt_iou"))


@query
def q_match_all(spark, sf_dir):
    case = Case(spark, sf_dir)
    return matching.match(case.det, case.gt()).select("det_id", "camera", "source_frame", "gt_id", F.round("gt_iou", 9).alias("gt_iou"), "is_matched")


@query
def q_track_gt(spark, sf_dir):
    return matching.track_truth(Case(spark, sf_dir).matched())


@query
def q_id_switches(spark, sf_dir):
    return matching.id_switches(Case(spark, sf_dir).matched())


@query
def q_gt_coverage(spark, sf_dir):
    case = Case(spark, sf_dir)
    return matching.coverage(case.matched(), case.gt()).drop("track_list")


@query
def q_gt_coverage_display(spark, sf_dir):
    case = Case(spark, sf_dir)
    shown = matching.coverage(case.matched(), case.gt())
    return shown.select("camera", "gt_id", "track_list", F.when(F.col("detected_frames") > 0, "covered").otherwise("missed").alias("status"))


@query
def q_tracking_eval(spark, sf_dir):
    case = Case(spark, sf_dir)
    found = matching.evaluate(case.matched(), case.gt()).where("scope = 'all'")
    return found.select("raw_detections", "unique_tracks", "gt_rows", "gt_coverage_rate", "pred_match_rate", "mean_track_purity", "mean_gt_iou", "id_switch_count", "fragmentation_avg", "fragmentation_score", "false_positive_rate", F.round("score", 9).alias("score"))


@query
def q_fragmentation(spark, sf_dir):
    case = Case(spark, sf_dir)
    return matching.evaluate(case.matched(), case.gt()).where("scope <> 'all'").select("scope", "fragmentation_avg")


@query
def q_mot_metrics(spark, sf_dir):
    case = Case(spark, sf_dir)
    found = matching.standard_metrics(matching.evaluate(case.matched(), case.gt())).where("scope = 'all'")
    return found.select("scope", "score_available", "total_gt_rows", "total_prediction_rows", "tp", "fp", "fn", "precision", "recall", F.round("f1", 9).alias("f1"), F.round("raw_mota_simple", 9).alias("raw_mota_simple"), "motp_iou", "identity_coverage_rate", "fragmentation_avg", "mean_track_purity", "false_positive_rate", "note")


def _score(case: Case) -> DataFrame:
    """Scores of the case and of each camera."""
    matched = case.matched()
    found = matching.tracking_score(matching.evaluate(matched, case.gt()), matching.coverage(matched, case.gt()), case.judged())
    return found.select("scope", "score_available", F.round("tracking_score", 9).alias("tracking_score"), "identity_coverage_rate", "precision", "recall", "mean_track_purity", "mixed_track_count", "num_valid_tracks")


@query
def q_score_by_camera(spark, sf_dir):
    return _score(Case(spark, sf_dir)).where("scope <> 'all'")


@query
def q_case_score(spark, sf_dir):
    return _score(Case(spark, sf_dir)).where("scope = 'all'")


def _tracking_diagnostics(case: Case) -> DataFrame:
    matched, gt = case.matched(), case.gt()
    return matching.diagnostics(case.det, case.valid(), case.judged(), matching.evaluate(matched, gt), matching.coverage(matched, gt))


@query
def q_diag_tracking(spark, sf_dir):
    row = _tracking_diagnostics(Case(spark, sf_dir))
    return row.select("raw_rows", "valid_rows", "first_frame_min", "last_frame_max", "num_valid_tracks", "avg_conf_mean", "avg_area_mean", "num_valid_tracks_per_camera", "gt_coverage_rate", "precision", "recall", "id_switch_count")


@query
def q_hints_tracking(spark, sf_dir):
    return matching.hints(_tracking_diagnostics(Case(spark, sf_dir)), "tracking", matching.TRACKING_HINTS)


@query
def q_topk_quality(spark, sf_dir):
    return tracks.top_crops(Case(spark, sf_dir).det, 8).select("track_key", "det_id", "frame", F.round("quality", 6).alias("quality"))


@query
def q_topk_uniform(spark, sf_dir):
    return tracks.spread_crops(Case(spark, sf_dir).det, 8).select("track_key", "det_id", "frame", "place")


@query
def q_track_vectors(spark, sf_dir):
    means = tracks.track_vectors(adapters.crop_vectors(spark, sf_dir))
    return means.select("track_key", F.posexplode("vector").alias("place", "x")).select("track_key", "place", F.round("x", 6).alias("x"))


@query
def q_full_span(spark, sf_dir):
    return Case(spark, sf_dir).vectors().select("track_key", "camera", "first_frame", "last_frame", "num_frames", "avg_conf", "avg_area")


@query
def q_pairs(spark, sf_dir):
    return association.pair_table(settle(Case(spark, sf_dir).vectors()))


@query
def q_top_pairs(spark, sf_dir):
    pairs = blocks.top_pairs(blocks.in_blocks(settle(Case(spark, sf_dir).vectors())), 20)
    return pairs.select("track_a", "track_b", "cosine_similarity")


@query
def q_mnn(spark, sf_dir):
    best = blocks.best_partners(blocks.in_blocks(settle(Case(spark, sf_dir).vectors())), 0.30)
    return association.mutual(best, 0.30).select("track_a", "track_b")


@query
def q_pair_verdict(spark, sf_dir):
    vectors = settle(Case(spark, sf_dir).vectors())
    mutual = association.partners(blocks.in_blocks(vectors), RULES)
    pairs = association.every_verdict(association.with_partner(vectors, mutual), RULES)
    return pairs.select("track_a", "track_b", "same_camera", "temporal_gap", "temporal_overlap", "merge_reason")


@query
def q_greedy_merge(spark, sf_dir):
    return association.candidate_verdicts(Case(spark, sf_dir).associate()[0], RULES)


@query
def q_global_meta(spark, sf_dir):
    return Case(spark, sf_dir).associate()[2].select("global_id", "camera", "track_key", "first_frame", "last_frame")


@query
def q_label_rows(spark, sf_dir):
    case = Case(spark, sf_dir)
    return association.label_rows(case.det, case.associate()[2]).select("det_id", "track_key", "global_id")


@query
def q_overlay_labels(spark, sf_dir):
    case = Case(spark, sf_dir)
    return identities.overlay_labels(association.label_rows(case.det, case.associate()[2]))


def _gids(case: Case, every_best: bool = False):
    found, merged, ids = case.associate(every_best)
    matched = case.matched(adapters.BY_USER)
    return found, merged, ids, matched, identities.evaluate_identities(ids, matched)


@query
def q_gid_eval(spark, sf_dir):
    return _gids(Case(spark, sf_dir))[4].drop("least_gt_id")


@query
def q_gid_summary(spark, sf_dir):
    _, _, ids, _, found = _gids(Case(spark, sf_dir))
    return identities.summarize_identities(ids, found)


@query
def q_gallery_filters(spark, sf_dir):
    _, _, ids, _, found = _gids(Case(spark, sf_dir))
    table = identities.summarize_identities(ids, found)
    return table.select("global_id", (F.col("num_cameras") > 1).alias("multi_camera"), (F.col("num_cameras") <= 1).alias("single_camera"), "is_mixed_gid")


@query
def q_gid_rep(spark, sf_dir):
    return identities.representatives(Case(spark, sf_dir).associate()[2])


@query
def q_merge_evidence(spark, sf_dir):
    _, pairs, ids = Case(spark, sf_dir).associate()
    return identities.merge_evidence(pairs, ids)


def _pairwise(case: Case) -> DataFrame:
    _, _, ids, matched, _ = _gids(case)
    return identities.pairwise_summary(ids, matching.track_truth(matched))


@query
def q_pairwise_detail(spark, sf_dir):
    found, _, ids, matched, _ = _gids(Case(spark, sf_dir))
    known = settle(association.with_partner(found.tracks, found.mutual).join(identities.tracks_judged(ids, matching.track_truth(matched)), "track_key"))
    return identities.judged_pairs(association.every_verdict(known, RULES, *identities.JUDGED)).select("track_a", "track_b", "dominant_gt_id_a", "dominant_gt_id_b", "same_gt", "same_global_id", "pair_eval_type", "merge_status", "reject_reason")


@query
def q_pairwise_summary(spark, sf_dir):
    return _pairwise(Case(spark, sf_dir))


@query
def q_confusion(spark, sf_dir):
    return identities.confusion(_pairwise(Case(spark, sf_dir)))


def _reid(case: Case) -> DataFrame:
    _, pairs, ids, matched, found = _gids(case)
    return identities.reid_score(ids, pairs, identities.identity_totals(found), matched)


@query
def q_reid_score(spark, sf_dir):
    return _reid(Case(spark, sf_dir)).withColumn("reid_score", F.round("reid_score", 9))


@query
def q_final_score(spark, sf_dir):
    case = Case(spark, sf_dir)
    case.match_both()
    found = identities.final_score(_score(case), _reid(case))
    return found.select("score_available", F.round("final_pipeline_score", 8).alias("final_pipeline_score"))


def _reid_diagnostics(case: Case) -> DataFrame:
    found, merged, ids, _, evaluated = _gids(case, every_best=True)
    # a track has one mutual neighbour at most, which is its best partner
    partner = association.with_partner(found.best.withColumnRenamed("src", "track_key"), merged.where("NOT same_camera"))
    others = partner.select(F.when(F.col("partner").isNull(), F.col("cosine_similarity")).otherwise(F.col("next_similarity")).alias("cosine_similarity"))
    return identities.diagnostics_of_merges(ids, merged, identities.identity_totals(evaluated), found.best, others)


@query
def q_diag_reid(spark, sf_dir):
    return _reid_diagnostics(Case(spark, sf_dir))


@query
def q_hints_reid(spark, sf_dir):
    rules = {test.replace("{t}", str(RULES.cross_threshold)): text for test, text in identities.REID_HINTS.items()}
    return matching.hints(_reid_diagnostics(Case(spark, sf_dir)), "reid", rules)


@query
def q_camera_union(spark, sf_dir):
    return catalog.union_cameras(Case(spark, sf_dir).det, catalog.camera_names()).select("camera", "track_key", "det_id")


@query
def q_distinct_gt(spark, sf_dir):
    return Case(spark, sf_dir).gt().dropDuplicates(["camera", "source_frame", "gt_id"]).select("camera", "source_frame", "gt_id")


@query
def q_missing_cameras(spark, sf_dir):
    wanted = catalog.cameras(spark).select("camera").distinct()
    return wanted.join(Case(spark, sf_dir).gt(), "camera", "left_anti")


@query
def q_retention(spark, sf_dir):
    """Runs beyond the five newest of each case; tracks stand for runs, first frames for their age."""
    runs = tracks.summarize(Case(spark, sf_dir).det).select(F.col("camera").alias("case_id"), F.col("track_key").alias("run"), F.col("first_frame").alias("modified"))
    return expired(runs, 5).select(F.col("case_id").alias("camera"), F.col("run").alias("track_key"), "place")


@query
def q_bbox_variants(spark, sf_dir):
    """Boxes written in four ways as JSON, and read back."""
    det = Case(spark, sf_dir).det
    whole = {c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    sized = {"w": whole["x2"] - whole["x1"], "h": whole["y2"] - whole["y1"]}
    corner = lambda names: F.to_json(F.struct(*[v.alias(n) for n, v in zip(names, whole.values(), strict=True)]))
    size = lambda w, h: F.to_json(F.struct(whole["x1"].alias("x"), whole["y1"].alias("y"), sized["w"].alias(w), sized["h"].alias(h)))
    kinds = [F.to_json(F.array(*whole.values())), corner(("x1", "y1", "x2", "y2")), corner(("left", "top", "right", "bottom")), size("w", "h"), size("width", "height")]
    written = F.element_at(F.array(*kinds), (F.col("det_id") % len(kinds) + 1).cast("int"))
    return det.select("det_id", annotations.box_corners(written).alias("b")).select("det_id", "b.*")


@query
def q_box_clip(spark, sf_dir):
    det = Case(spark, sf_dir).det
    halves = det.select("det_id", (F.col("x1") - 20.5).alias("x1"), (F.col("y1") + 0.5).alias("y1"), (F.col("x2") + 10.5).alias("x2"), (F.col("y2") + 1.5).alias("y2"))
    return halves.select("det_id", *geometry.clip_box(800, 450)).where("x2 > x1 AND y2 > y1")


@query
def q_name_sanitise(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", geometry.safe_name(F.col("url")).alias("name"))


@query
def q_fingerprint(spark, sf_dir):
    det = Case(spark, sf_dir).det.select("track_key").distinct()
    return det.select("track_key", geometry.fingerprint(F.col("track_key")).alias("fingerprint"))


@query
def q_closed_tracks(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("det_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = Case(spark, sf_dir).det.join(events, "det_id")
    found = closed_tracks(rows, "12 hours", "1 day").groupBy("track_key").agg(F.count(F.lit(1)).alias("sessions"), F.sum("num_rows").alias("num_rows"))
    return found


@query
def q_track_overview(spark, sf_dir):
    case = Case(spark, sf_dir)
    return overviews.track_overview(case.judged(), matching.track_truth(case.matched()))


@query
def q_local_gallery(spark, sf_dir):
    case = Case(spark, sf_dir)
    return overviews.local_gallery(case.judged(), matching.track_truth(case.matched()))


@query
def q_case_overview(spark, sf_dir):
    case = Case(spark, sf_dir)
    videos = spark.createDataFrame([("camera_1", 12.345), ("camera_2", 70.0), ("camera_3", None)], "camera string, duration_sec double")
    return overviews.case_overview(case.det, case.gt(), videos)


@query
def q_gt_info(spark, sf_dir):
    case = Case(spark, sf_dir)
    return overviews.truth_info(case.det, case.gt(), case.matched())


@query
def q_camera_status(spark, sf_dir):
    case = Case(spark, sf_dir)
    cameras = catalog.cameras(spark).select("camera").distinct()
    return overviews.camera_status(cameras, case.det, case.judged(), _score(case))


@query
def q_score_table(spark, sf_dir):
    case = Case(spark, sf_dir)
    metrics = matching.standard_metrics(matching.evaluate(case.matched(), case.gt()))
    found = overviews.score_table(_score(case), metrics).where("scope <> 'all'")
    return found.select("scope", "tracking_score", F.round("raw_mota_simple", 9).alias("raw_mota_simple"), "motp_iou")


@query
def q_score_rollup(spark, sf_dir):
    found = overviews.score_rollup(_score(Case(spark, sf_dir)))
    return found.withColumn("mean_tracking_score", F.round("mean_tracking_score", 7))


@query
def q_expected_ids(spark, sf_dir):
    matched = Case(spark, sf_dir).matched()
    return overviews.expected_identities(matched, matching.track_truth(matched))


@query
def q_reid_summary(spark, sf_dir):
    _, pairs, ids, _, found = _gids(Case(spark, sf_dir))
    return overviews.identity_overview(ids, pairs, identities.identity_totals(found))


@query
def q_gid_truth(spark, sf_dir):
    _, _, ids, matched, _ = _gids(Case(spark, sf_dir))
    return overviews.identity_truth(ids, matched)


@query
def q_overlay_truth(spark, sf_dir):
    case = Case(spark, sf_dir)
    return overviews.overlay_truth(case.det, case.matched()).select("det_id", "gt_id", F.round("gt_iou", 9).alias("gt_iou"))


@query
def q_camera_limits(spark, sf_dir):
    profiles = spark.createDataFrame([("camera_1", 10, 5), ("camera_2", 60, None)], "camera string, min_frames int, min_crops int")
    judged = tracks.judge_by_camera(tracks.summarize(Case(spark, sf_dir).det), profiles, LIMITS)
    return judged.select("track_key", "is_valid", "filter_reason")


def _annotations(case: Case, record) -> DataFrame:
    """Ground truth as annotation texts, one for each frame of a camera."""
    return case.gt().groupBy("camera", "source_frame").agg(F.collect_list(record).alias("records"))


@query
def q_annotation_rows(spark, sf_dir):
    frames = _annotations(Case(spark, sf_dir), F.struct(F.col("gt_id").alias("id"), F.array("x1", "y1", "x2", "y2").alias("BboxP")))
    return annotations.parse(frames.select("camera", F.to_json(F.create_map(F.col("source_frame").cast("string"), "records")).alias("value")))


@query
def q_annotation_nested(spark, sf_dir):
    size = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    frames = _annotations(Case(spark, sf_dir), F.struct(F.col("gt_id").alias("person_id"), size.alias("rect")))
    image = F.struct(F.col("source_frame").alias("frame_id"), F.col("records").alias("objects"))
    return annotations.parse_nested(frames.select("camera", F.to_json(F.struct(F.array(image).alias("frames"))).alias("value")))


@query
def q_case_catalog(spark, sf_dir):
    """The catalog with the detections and true boxes that lie in each case's cameras and frames."""
    case = Case(spark, sf_dir)
    found = catalog.contents(spark, case.det, case.gt())
    return found.withColumn("cameras", F.array_join("cameras", ", "))


@query
def q_annotation_locate(spark, sf_dir):
    """Annotations of a camera written as several files, of which the first by name is read."""
    block = F.lpad(F.floor(F.col("source_frame") / 100).cast("string"), 4, "0").alias("block")
    record = F.struct(F.col("gt_id").alias("id"), F.array("x1", "y1", "x2", "y2").alias("BboxP"))
    frames = Case(spark, sf_dir).gt().groupBy("camera", block, "source_frame").agg(F.collect_list(record).alias("records"))
    texts = frames.groupBy("camera", "block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("source_frame").cast("string"), "records")))).alias("value"))
    root = f"{shared_folder(spark)}/annotations-{uuid.uuid4().hex}"
    texts.select(F.concat("camera", F.lit("_"), "block").alias("file"), "value").repartition("file").write.partitionBy("file").text(root)
    return annotations.read(spark, root)


#: A case of its own for the test tables.
OWN_CASE = {"cameras": ["camera_1", "camera_2", "camera_9"], "source_frame_start": 200, "source_frame_end": 500, "annotation_frame_start": 0}


@query
def q_gt_load(spark, sf_dir):
    """What the load of a case's ground truth counts for each camera, from one pass."""
    load = annotations.load_case(q_annotation_rows(spark, sf_dir), OWN_CASE)
    settle(load.rows)
    fields = ", ".join(f"{n} {'long' if n.startswith('rows') else 'int'}" for n in annotations.COUNTED)
    return spark.createDataFrame([tuple(r.values()) for r in load.counters()], f"camera string, {fields}, error string")


@query
def q_sink_order(spark, sf_dir):
    """Summaries written in order as two runs, one of them again, and read from the first by file and row."""
    summary, root = tracks.summarize(Case(spark, sf_dir).det), f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    for run, rows in (("a", summary.limit(0)), ("b", summary), ("a", summary), ("c", summary.limit(0))):
        runs.write_ordered(rows, root, overviews.ORDERS["summary"], run, files=5)
    return runs.read_ordered(spark, root, "a").select("place", "camera", "track_id", "num_frames")


@query
def q_stream_tracks(spark, sf_dir):
    """Tracks closed by a stream of detections as three videos, by frames; those still open at its end aren't told."""
    det = Case(spark, sf_dir).det.select("det_id", F.floor(F.col("frame") / 240).alias("video"), "camera", "track_id", (F.col("frame") % 240).alias("frame"), "conf", "area", "crop_path")
    root, name = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    det.write.parquet(f"{root}/in")
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = closed_tracks_by_frame(spark.readStream.schema(det.schema).parquet(f"{root}/in"), buffer=12, late=20)
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/at").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{root}/out")


@query
def q_order_summary(spark, sf_dir):
    return overviews.in_order(tracks.summarize(Case(spark, sf_dir).det), "summary").select("place", "track_key")


@query
def q_order_coverage(spark, sf_dir):
    case = Case(spark, sf_dir)
    return overviews.in_order(matching.coverage(case.matched(), case.gt()), "coverage").select("place", "camera", "gt_id")


@query
def q_order_identities(spark, sf_dir):
    return overviews.in_order(Case(spark, sf_dir).associate()[2], "identities").select("place", "global_id", "track_key")


@query
def q_order_merged(spark, sf_dir):
    _, pairs, ids = Case(spark, sf_dir).associate()
    return overviews.in_order(identities.merge_evidence(pairs, ids), "merged").select("place", "global_id", "track_a", "track_b")


@query
def q_track_keys(spark, sf_dir):
    return tracks.with_keys(Case(spark, sf_dir).det.drop("track_key")).select("det_id", "track_key")


@query
def q_box_geometry(spark, sf_dir):
    return tracks.with_geometry(Case(spark, sf_dir).det).select("det_id", "width", "height", "area")


@query
def q_track_crops(spark, sf_dir):
    """What all crops say of their tracks, with the vector's first place."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    crops = spark.sql(adapters.CROPS, detections=Case(spark, sf_dir).det, embeddings=embeddings)
    return tracks.track_vectors(crops).withColumn("first_place", F.round(F.get("vector", F.lit(0)), 6)).drop("vector")


@query
def q_truthy(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, ("true", "YES", "1", "Valid", "no", "0", None))), (F.col("det_id") % 7).cast("int"))
    return Case(spark, sf_dir).det.select("det_id", geometry.truthy(said).alias("is_true"))


@query
def q_run_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", run_id("ts").alias("run_id"))


@query
def q_csv_rescan(spark, sf_dir):
    """A summary written as CSV and read again, beside a file that isn't there."""
    kinds, root = "track_key string, num_frames long, first_frame int", f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    export_csv(tracks.summarize(Case(spark, sf_dir).det), root, ["track_key", "num_frames", "first_frame"])
    return read_csv(spark, root, kinds).unionByName(read_csv(spark, f"{root}-none", kinds))
