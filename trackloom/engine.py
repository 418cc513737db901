"""The two stages of a case from its tables to its scores, each result a stage table of the run.

    engine = Engine(spark, "/data/runs", "case_1", limits=Limits(min_frames=30))
    engine.track(detections, ground_truth)
    engine.associate(crop_vectors)
    engine.table("final_score").show()

Stages form a graph: each is known by what it was made of, is reused while that stays the same, and is
made anew when it changes (``StageGraph``). Other detections change every stage, other limits those from
the filter on, other rules of association their own ones only. A stage that reads another reads its
table, not its plan. ``save`` leaves the run's configuration and stage log; ``delete_expired`` removes
old runs.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import association, identities, matching, overviews, tracks
from trackloom.sources import runs, stages

TRACK_STAGES = "summary judged valid matched track_truth coverage evaluation metrics scores camera_scores diagnostics hints".split()
IDENTITY_STAGES = "vectors classified merges pairs identities identity_eval identity_totals identity_summary pair_eval pair_summary reid_score final_score reid_diagnostics reid_hints".split()


class Engine:
    def __init__(self, spark: SparkSession, root: str, case: str, limits: tracks.Limits = tracks.Limits(), rules: association.Rules = association.Rules(), profiles: DataFrame | None = None, threshold: float = 0.5):
        """``profiles``: limits by camera (see ``judge_by_camera``), ``limits`` for the others.
        ``threshold``: least intersection over union of a match."""
        self.spark, self.root, self.case, self.limits, self.rules, self.profiles, self.threshold = spark, root, case, limits, rules, profiles, threshold
        # one row for a camera, so it is small
        self.by_camera = sorted(map(str, profiles.collect())) if profiles is not None else []
        self.graph = runs.StageGraph(spark, root)
        self.run_id = f"{case}-{runs.digest(case, asdict(limits), asdict(rules), self.by_camera, threshold)}"

    def table(self, stage: str) -> DataFrame:
        return self.graph.table(stage)

    def track(self, detections: DataFrame, ground_truth: DataFrame) -> None:
        """Filter and evaluate tracks. ``detections`` needs ``source_frame`` (``to_source_frames``)."""
        put, table = self.graph.stage, self.table
        self.graph.source("detections", detections)
        self.graph.source("ground_truth", ground_truth)
        put("summary", "detections", lambda: tracks.summarize(detections))
        judge = tracks.judge if self.profiles is None else lambda s, limits: tracks.judge_by_camera(s, self.profiles, limits)
        put("judged", "summary", lambda: judge(table("summary"), self.limits), asdict(self.limits), self.by_camera)
        put("valid", "detections judged", lambda: tracks.keep_valid(detections, table("judged")))
        put("matched", "valid ground_truth", lambda: matching.match(table("valid"), ground_truth, self.threshold), self.threshold)
        put("track_truth", "matched", lambda: matching.track_truth(table("matched")))
        put("coverage", "matched ground_truth", lambda: matching.coverage(table("matched"), ground_truth))
        put("evaluation", "matched ground_truth", lambda: matching.evaluate(table("matched"), ground_truth))
        put("metrics", "evaluation", lambda: matching.standard_metrics(table("evaluation")))
        put("scores", "evaluation coverage judged", lambda: matching.tracking_score(table("evaluation"), table("coverage"), table("judged")))
        put("camera_scores", "scores metrics", lambda: overviews.score_table(table("scores"), table("metrics")).where("scope <> 'all'"))
        put("diagnostics", "detections valid judged evaluation coverage", lambda: matching.diagnostics(detections, table("valid"), table("judged"), table("evaluation"), table("coverage")))
        put("hints", "diagnostics", lambda: matching.hints(table("diagnostics"), "tracking", matching.TRACKING_HINTS), matching.TRACKING_HINTS)

    def associate(self, crop_vectors: DataFrame) -> None:
        """Join tracks into identities and score them, after ``track``. ``crop_vectors``: ``track_key, vector``,
        and if known the crop's ``det_id, frame, conf, area, crop_path``."""
        put, table, rules = self.graph.stage, self.table, self.rules
        self.graph.source("crop_vectors", crop_vectors)

        def vectors() -> DataFrame:
            known = tracks.track_vectors(crop_vectors).join(table("valid").select(*tracks.TRACK).distinct(), "track_key")
            return tracks.full_span(known, table("valid"))

        put("vectors", "crop_vectors valid", vectors)
        put("classified", "vectors", lambda: association.classify(association.pair_table(table("vectors")), rules), asdict(rules))
        put("merges", "classified", lambda: association.merge(table("classified"), rules), asdict(rules))
        put("pairs", "classified merges", lambda: association.verdicts(table("classified"), table("merges")))
        put("identities", "vectors merges", lambda: association.number_identities(table("vectors").drop("vector"), table("merges")))
        put("identity_eval", "identities matched", lambda: identities.evaluate_identities(table("identities"), table("matched")))
        put("identity_totals", "identity_eval", lambda: identities.identity_totals(table("identity_eval")))
        put("identity_summary", "identities identity_eval", lambda: identities.summarize_identities(table("identities"), table("identity_eval")))
        put("pair_eval", "identities track_truth pairs", lambda: identities.pairwise_detail(table("identities"), table("track_truth"), table("pairs")))
        put("pair_summary", "identities track_truth", lambda: identities.pairwise_summary(table("identities"), table("track_truth")))
        put("reid_score", "identities pairs identity_totals matched", lambda: identities.reid_score(table("identities"), table("pairs"), table("identity_totals"), table("matched")))
        put("final_score", "scores reid_score", lambda: identities.final_score(table("scores"), table("reid_score")))
        put("reid_diagnostics", "identities pairs identity_totals", lambda: identities.diagnostics(table("identities"), table("pairs"), table("identity_totals")))
        hints = {test.replace("{t}", str(rules.cross_threshold)): text for test, text in identities.REID_HINTS.items()}
        put("reid_hints", "reid_diagnostics", lambda: matching.hints(table("reid_diagnostics"), "reid", hints), hints)

    def save(self, run: str | None = None) -> str:
        """Leaves the run's configuration, stage keys and stage log; ``run`` is its start (``run_id``) by default."""
        run = run or self.spark.range(1).select(stages.run_id(F.current_timestamp())).first()[0]
        self.graph.save_run(self.case, run, config_used={"limits": asdict(self.limits), "rules": asdict(self.rules), "limits_by_camera": self.by_camera, "gt_iou_threshold": self.threshold})
        return run

    def export(self, path: str, run: str, kind: str = "csv") -> None:
        """The run's tables in their orders, each in a folder of its own by run."""
        for stage, order in (("judged", "summary"), ("coverage", "coverage"), ("identities", "identities")):
            runs.write_ordered(self.table(stage), f"{path}/{stage}", overviews.ORDERS[order], run, kind)
        merged = identities.merge_evidence(self.table("pairs"), self.table("identities"))
        runs.write_ordered(merged, f"{path}/merged", overviews.ORDERS["merged"], run, kind)

    def labelled(self, detections: DataFrame) -> DataFrame:
        """Detections with identity, label and colour, for drawing."""
        rows = association.label_rows(detections, self.table("identities"))
        return identities.overlay_labels(rows)
