"""The queries in plain SQL, for the engine that checks results."""

from __future__ import annotations

from trackloom.operators import identities, matching
from trackloom.plans import adapters

_DET = adapters.DETECTIONS.format(events="events")
_mean = lambda x: f"(CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / count({x}))"


def _gt(by: str) -> str:
    return adapters.GROUND_TRUTH.replace("{gt_id}", by).replace("{detections}", "det")


def _match(name: str, gt: str) -> str:
    inter = "greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1))"
    union = f"((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {inter})"
    return f"""
{name}_c AS (SELECT d.det_id, g.gt_id, {inter} / {union} AS iou, row_number() OVER (PARTITION BY d.det_id ORDER BY {inter} / {union} DESC, g.gt_ord) AS k
  FROM det d JOIN {gt} g ON d.camera = g.camera AND d.source_frame = g.source_frame),
{name} AS (SELECT d.*, CASE WHEN c.iou >= 0.5 THEN c.gt_id ELSE -1 END AS gt_id, CASE WHEN c.iou >= 0.5 THEN c.iou ELSE 0 END AS gt_iou,
  coalesce(c.iou >= 0.5, false) AS is_matched FROM det d LEFT JOIN {name}_c c ON d.det_id = c.det_id AND c.k = 1)"""


def _truth(name: str, matched: str) -> str:
    return f"""
{name}_v AS (SELECT track_key, gt_id, count(*) AS n, row_number() OVER (PARTITION BY track_key ORDER BY count(*) DESC, gt_id) AS k FROM {matched} WHERE gt_id > 0 GROUP BY 1, 2),
{name}_t AS (SELECT track_key, max(CASE WHEN k = 1 THEN gt_id END) AS g, max(CASE WHEN k = 1 THEN n END) AS n, sum(n) AS rows FROM {name}_v GROUP BY 1),
{name} AS (SELECT b.*, coalesce(t.g, -1) AS dominant_gt_id, CAST(coalesce(t.n, 0) AS BIGINT) AS dominant_frames, coalesce(t.n / t.rows, 0) AS track_gt_purity FROM (
  SELECT camera, track_id, track_key, count(DISTINCT frame) AS num_frames, count(DISTINCT CASE WHEN gt_id > 0 THEN frame END) AS matched_frames,
   coalesce({_mean('CASE WHEN gt_id > 0 THEN gt_iou END')}, 0) AS mean_gt_iou, {_mean('conf')} AS avg_conf, {_mean('area')} AS avg_area,
   min(frame) AS first_frame, max(frame) AS last_frame FROM {matched} GROUP BY 1, 2, 3) b LEFT JOIN {name}_t t ON b.track_key = t.track_key)"""


_BASE = f"""
det AS (SELECT *, frame + {adapters.SOURCE_START} AS source_frame FROM ({_DET}) AS x),
gt AS ({_gt(adapters.BY_BOX)}),
gu AS ({_gt(adapters.BY_USER)}),
summ AS (SELECT camera, track_id, track_key, count(DISTINCT frame) AS num_frames, CAST(count(*) FILTER (crop_path <> '') AS BIGINT) AS num_crops,
  {_mean('conf')} AS avg_conf, {_mean('area')} AS avg_area, min(frame) AS first_frame, max(frame) AS last_frame FROM det GROUP BY 1, 2, 3),
rep AS (SELECT track_key, crop_path AS representative_crop FROM (SELECT *, row_number() OVER (PARTITION BY track_key ORDER BY area DESC, conf DESC, det_id) AS k FROM det) WHERE k = 1),
judged AS (SELECT *, num_frames >= 30 AS pass_min_frames, num_crops >= 24 AS pass_min_crops, avg_conf >= 0 AS pass_min_avg_conf, avg_area >= 0 AS pass_min_avg_area,
  num_frames >= 30 AND num_crops >= 24 AS is_valid FROM summ),
valid AS (SELECT * FROM det WHERE track_key IN (SELECT track_key FROM judged WHERE is_valid)),
{_match('m', 'gt').strip()},
{_truth('tt', 'm').strip()},
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera, source_frame, gt_id, track_key ORDER BY det_id) AS k FROM m WHERE gt_id > 0) WHERE k = 1),
cov AS (SELECT g.*, coalesce(s.detected_frames, 0) AS detected_frames, coalesce(s.tracks, 0) AS tracks, coalesce(s.mean_iou, 0) AS mean_iou, coalesce(s.mean_conf, 0) AS mean_conf,
  coalesce(s.track_list, '') AS track_list, coalesce(s.detected_frames, 0) / g.gt_frames AS coverage_per_gt
  FROM (SELECT camera, gt_id, count(DISTINCT source_frame) AS gt_frames, min(source_frame) AS first_source_frame, max(source_frame) AS last_source_frame FROM gt GROUP BY 1, 2) g
  LEFT JOIN (SELECT camera, gt_id, count(DISTINCT source_frame) AS detected_frames, count(DISTINCT track_key) AS tracks, {_mean('gt_iou')} AS mean_iou, {_mean('conf')} AS mean_conf,
    string_agg(DISTINCT track_key, ', ' ORDER BY track_key) AS track_list FROM once GROUP BY 1, 2) s ON g.camera = s.camera AND g.gt_id = s.gt_id),
modal AS (SELECT * FROM (SELECT camera, gt_id, source_frame, track_key, row_number() OVER (PARTITION BY camera, gt_id, source_frame ORDER BY count(*) DESC, track_key) AS k
  FROM m WHERE gt_id > 0 GROUP BY 1, 2, 3, 4) WHERE k = 1),
sw AS (SELECT camera, gt_id, CAST(coalesce(sum(CASE WHEN p <> track_key THEN 1 ELSE 0 END), 0) AS BIGINT) AS switches FROM
  (SELECT *, lag(track_key) OVER (PARTITION BY camera, gt_id ORDER BY source_frame) AS p FROM modal) GROUP BY 1, 2),
scopes AS (SELECT DISTINCT camera AS scope, camera FROM det UNION ALL SELECT DISTINCT 'all', camera FROM det),
ev0 AS (SELECT s.scope, count(*) AS raw_detections, count(DISTINCT track_key) AS unique_tracks, count(*) FILTER (gt_id > 0) AS matched_rows,
  count(DISTINCT CASE WHEN gt_id > 0 THEN concat(m.camera, '|', source_frame, '|', gt_id) END) AS covered_rows, count(DISTINCT CASE WHEN gt_id > 0 THEN gt_id END) AS detected_gt_ids,
  coalesce({_mean('CASE WHEN gt_id > 0 THEN gt_iou END')}, 0) AS mean_gt_iou FROM m JOIN scopes s ON m.camera = s.camera GROUP BY 1),
ev1 AS (SELECT s.scope, count(*) AS gt_rows, count(DISTINCT gt_id) AS total_gt_ids FROM gt JOIN scopes s ON gt.camera = s.camera GROUP BY 1),
ev2 AS (SELECT s.scope, {_mean('CASE WHEN matched_frames > 0 THEN track_gt_purity END')} AS mean_track_purity, count(*) FILTER (track_gt_purity < 1) AS mixed_track_count FROM tt JOIN scopes s ON tt.camera = s.camera GROUP BY 1),
ev3 AS (SELECT scope, {_mean('n')} AS fragmentation_avg FROM (SELECT s.scope, m.camera, gt_id, count(DISTINCT track_key) AS n FROM m JOIN scopes s ON m.camera = s.camera WHERE gt_id > 0 GROUP BY 1, 2, 3) GROUP BY 1),
ev4 AS (SELECT s.scope, CAST(sum(switches) AS BIGINT) AS id_switch_count FROM sw JOIN scopes s ON sw.camera = s.camera GROUP BY 1),
ev AS (SELECT *, covered_rows / gt_rows AS gt_coverage_rate, matched_rows / raw_detections AS pred_match_rate, (raw_detections - matched_rows) / raw_detections AS false_positive_rate,
  1 / greatest(1, fragmentation_avg) AS fragmentation_score FROM ev0 JOIN ev1 USING (scope) JOIN ev2 USING (scope) JOIN ev3 USING (scope) JOIN ev4 USING (scope)),
sc0 AS (SELECT s.scope, count(*) AS ids, count(*) FILTER (detected_frames > 0) AS found FROM cov JOIN scopes s ON cov.camera = s.camera GROUP BY 1),
sc1 AS (SELECT s.scope, count(*) AS num_valid_tracks FROM judged j JOIN scopes s ON j.camera = s.camera WHERE is_valid GROUP BY 1),
sc AS (SELECT scope, true AS score_available, found / ids AS identity_coverage_rate, pred_match_rate AS precision, gt_coverage_rate AS recall, mean_track_purity, mixed_track_count, num_valid_tracks,
  (0.2 * found / ids + 0.15 * pred_match_rate + 0.15 * gt_coverage_rate + 0.2 * 2 * pred_match_rate * gt_coverage_rate / (pred_match_rate + gt_coverage_rate) + 0.15 * mean_track_purity
   + 0.05 / greatest(1, fragmentation_avg) + 0.05 * (1 - false_positive_rate) + 0.05 * greatest(0, 1 - mixed_track_count / num_valid_tracks)) AS tracking_score
  FROM ev JOIN sc0 USING (scope) JOIN sc1 USING (scope))"""

_VECTORS = f"""
crops AS ({adapters.VECTORS.format(embeddings="embeddings", detections="det")}),
elem AS (SELECT track_key, i - 1 AS place, CAST(sum(CAST(vector[i] AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM crops) GROUP BY 1, 2),
vec AS (SELECT track_key, list_transform(a, lambda v: v / (sqrt(list_sum(list_transform(a, lambda w: w * w))) + 1e-12)) AS v FROM (SELECT track_key, list(x ORDER BY place) AS a FROM elem GROUP BY 1)),
trk AS (SELECT v.track_key, s.camera, s.track_id, s.first_frame AS f0, s.last_frame AS f1, s.num_frames, s.avg_conf, s.avg_area, v.v, row_number() OVER (ORDER BY v.track_key) AS idx FROM vec v JOIN summ s ON v.track_key = s.track_key),
pr AS (SELECT a.track_key AS track_a, a.camera AS camera_a, a.f0 AS first_frame_a, a.f1 AS last_frame_a, b.track_key AS track_b, b.camera AS camera_b, b.f0 AS first_frame_b, b.f1 AS last_frame_b,
  a.idx AS ia, b.idx AS ib, a.camera = b.camera AS same_camera, greatest(0, greatest(a.f0, b.f0) - least(a.f1, b.f1) - 1) AS temporal_gap, greatest(0, least(a.f1, b.f1) - greatest(a.f0, b.f0) + 1) AS temporal_overlap,
  round(list_dot_product(a.v, b.v), 6) AS cosine_similarity FROM trk a JOIN trk b ON a.idx < b.idx),
dir AS (SELECT track_a AS src, track_b AS dst, cosine_similarity AS s FROM pr WHERE NOT same_camera AND cosine_similarity >= 0.3 UNION ALL SELECT track_b, track_a, cosine_similarity FROM pr WHERE NOT same_camera AND cosine_similarity >= 0.3),
top AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS k FROM dir) WHERE k = 1),
mnn AS (SELECT a.src AS track_a, a.dst AS track_b FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
vd AS (SELECT pr.*, CASE WHEN same_camera AND cosine_similarity >= 0.25 AND temporal_gap <= 60 AND temporal_overlap <= 0 THEN 'intra_fragment_recovery'
  WHEN same_camera AND cosine_similarity >= 0.25 AND temporal_gap <= 60 AND temporal_overlap > 0 THEN 'rejected_temporal_overlap' WHEN NOT same_camera AND cosine_similarity >= 0.3 AND mnn.track_a IS NOT NULL THEN 'cross_camera_mnn' ELSE 'not_merged' END AS merge_reason
  FROM pr LEFT JOIN mnn ON pr.track_a = mnn.track_a AND pr.track_b = mnn.track_b)"""

_MERGE = """
cand AS (SELECT *, row_number() OVER (ORDER BY cosine_similarity DESC, ia, ib) AS k FROM vd WHERE merge_reason IN ('intra_fragment_recovery', 'cross_camera_mnn')),
st(k, roots, flags) AS (
 SELECT 0::bigint, (SELECT list(idx ORDER BY idx) FROM trk), []::boolean[]
 UNION ALL
 SELECT k, CASE WHEN bad THEN roots ELSE list_transform(roots, lambda r: CASE WHEN r = greatest(ra, rb) THEN least(ra, rb) ELSE r END) END, list_append(flags, NOT bad)
 FROM (SELECT c.k, st.roots, st.flags, st.roots[c.ia] AS ra, st.roots[c.ib] AS rb,
   EXISTS (SELECT 1 FROM trk x JOIN trk y ON x.camera = y.camera WHERE st.roots[c.ia] <> st.roots[c.ib] AND st.roots[x.idx] = st.roots[c.ia] AND st.roots[y.idx] = st.roots[c.ib]
     AND (least(x.f1, y.f1) - greatest(x.f0, y.f0) + 1 > 0 OR greatest(x.f0, y.f0) - least(x.f1, y.f1) - 1 > 60)) AS bad
   FROM st JOIN cand c ON c.k = st.k + 1) z),
done AS (SELECT roots, flags FROM st ORDER BY k DESC LIMIT 1),
flag AS (SELECT unnest(flags) AS ok, generate_subscripts(flags, 1) AS k FROM done),
root AS (SELECT unnest(roots) AS r, generate_subscripts(roots, 1) AS idx FROM done),
ids AS (SELECT t.track_key, t.camera, t.track_id, t.f0 AS first_frame, t.f1 AS last_frame, t.avg_conf, t.avg_area, dense_rank() OVER (ORDER BY root.r) AS global_id FROM trk t JOIN root ON t.idx = root.idx),
fin AS (SELECT vd.* EXCLUDE (merge_reason), coalesce(f.ok, false) AS merge_status, CASE WHEN f.ok THEN vd.merge_reason WHEN f.ok = false THEN 'blocked_cluster_temporal_conflict' ELSE vd.merge_reason END AS merge_reason
  FROM vd LEFT JOIN cand c ON vd.ia = c.ia AND vd.ib = c.ib LEFT JOIN flag f ON c.k = f.k)"""

_IDS = f"""
{_match('u', 'gu').strip()},
{_truth('ut', 'u').strip()},
ge0 AS (SELECT i.global_id, i.track_key, i.camera, r.gt_id FROM ids i LEFT JOIN (SELECT DISTINCT track_key, camera, gt_id FROM u WHERE gt_id > 0) r ON i.track_key = r.track_key AND i.camera = r.camera),
ge AS (SELECT global_id, string_agg(DISTINCT track_key, ', ' ORDER BY track_key) AS tracks, string_agg(DISTINCT camera, ', ' ORDER BY camera) AS cameras,
  concat('[', coalesce(array_to_string(list_sort(list_distinct(list(gt_id))), ', '), ''), ']') AS gt_ids_inside, count(DISTINCT track_key) AS num_tracks, count(DISTINCT camera) AS num_cameras,
  count(DISTINCT gt_id) <= 1 AS is_pure_global_id, min(gt_id) AS least_gt_id FROM ge0 GROUP BY 1),
gs AS (SELECT i.*, g.least_gt_id AS dominant_gt_id, CASE WHEN is_pure_global_id THEN 1.0::double ELSE 0.0::double END AS global_id_purity, NOT is_pure_global_id AS is_mixed_gid FROM (
  SELECT global_id, count(DISTINCT track_key) AS num_tracks, string_agg(DISTINCT camera, ', ' ORDER BY camera) AS cameras, count(DISTINCT camera) AS num_cameras, min(first_frame) AS first_frame, max(last_frame) AS last_frame,
  string_agg(DISTINCT track_key, ', ' ORDER BY track_key) AS members FROM ids GROUP BY 1) i JOIN ge g ON i.global_id = g.global_id),
kn AS (SELECT i.track_key, i.global_id, t.dominant_gt_id, t.track_gt_purity FROM ids i JOIN ut t ON i.track_key = t.track_key),
pd AS (SELECT f.track_a, f.track_b, a.dominant_gt_id AS dominant_gt_id_a, b.dominant_gt_id AS dominant_gt_id_b,
  CASE WHEN a.dominant_gt_id > 0 AND b.dominant_gt_id > 0 THEN a.dominant_gt_id = b.dominant_gt_id END AS same_gt, a.global_id = b.global_id AS same_global_id,
  CASE WHEN NOT (a.dominant_gt_id > 0 AND b.dominant_gt_id > 0) THEN 'skipped_no_gt' WHEN NOT (a.track_gt_purity >= 0.8 AND b.track_gt_purity >= 0.8) THEN 'skipped_low_purity'
   WHEN a.dominant_gt_id = b.dominant_gt_id AND a.global_id = b.global_id THEN 'TP_pair' WHEN a.dominant_gt_id = b.dominant_gt_id THEN 'FN_pair' WHEN a.global_id = b.global_id THEN 'FP_pair' ELSE 'TN_pair' END AS pair_eval_type,
  f.merge_status, CASE WHEN f.merge_reason LIKE 'blocked_%' THEN f.merge_reason END AS reject_reason
  FROM fin f JOIN kn a ON f.track_a = a.track_key JOIN kn b ON f.track_b = b.track_key),
et AS (SELECT * FROM kn WHERE dominant_gt_id > 0 AND track_gt_purity >= 0.8),
ps0 AS (SELECT count(*) FILTER (pair_eval_type = 'TP_pair') AS tp_pair, count(*) FILTER (pair_eval_type = 'FP_pair') AS fp_pair, count(*) FILTER (pair_eval_type = 'FN_pair') AS fn_pair, count(*) FILTER (pair_eval_type = 'TN_pair') AS tn_pair FROM pd),
ps1 AS (SELECT count(*) AS num_eval_tracks, count(DISTINCT dominant_gt_id) AS expected_global_ids, count(DISTINCT global_id) AS num_global_ids FROM et),
ps2 AS (SELECT count(*) FILTER (n > 1) AS mixed_gid_count, avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS mean_global_id_purity FROM (SELECT global_id, count(DISTINCT dominant_gt_id) AS n FROM et GROUP BY 1)),
ps AS (SELECT tp_pair + fp_pair + fn_pair + tn_pair > 0 AS score_available, tp_pair + fn_pair > 0 AS association_eval_available, num_eval_tracks, tp_pair + fn_pair AS positive_pair_count, fp_pair + tn_pair AS negative_pair_count,
  tp_pair + fp_pair AS predicted_positive_pair_count, tp_pair, fp_pair, fn_pair, tn_pair,
  CASE WHEN tp_pair + fn_pair > 0 THEN tp_pair / greatest(1, tp_pair + fp_pair) END AS pairwise_precision, CASE WHEN tp_pair + fn_pair > 0 THEN tp_pair / greatest(1, tp_pair + fn_pair) END AS pairwise_recall,
  CASE WHEN tp_pair + fn_pair > 0 THEN 2 * (tp_pair / greatest(1, tp_pair + fp_pair)) * (tp_pair / greatest(1, tp_pair + fn_pair)) / greatest(1e-9::double, tp_pair / greatest(1, tp_pair + fp_pair) + tp_pair / greatest(1, tp_pair + fn_pair)) END AS pairwise_f1,
  CASE WHEN tp_pair + fn_pair > 0 THEN fp_pair / greatest(1, tp_pair + fp_pair) END AS false_merge_rate, CASE WHEN tp_pair + fn_pair > 0 THEN fn_pair / greatest(1, tp_pair + fn_pair) END AS false_split_rate,
  mean_global_id_purity, mixed_gid_count, expected_global_ids, num_global_ids, greatest(0, num_eval_tracks - expected_global_ids) AS reduction_required, greatest(0, num_eval_tracks - num_global_ids) AS reduction_achieved,
  CASE WHEN tp_pair + fn_pair > 0 THEN 'Pairwise association evaluation tersedia karena ada minimal satu positive GT pair.' ELSE 'No positive association pair available; Re-ID association is not required for this case.' END AS note FROM ps0, ps1, ps2),
rs0 AS (SELECT (SELECT count(*) FROM ids) AS num_local_tracks, (SELECT count(DISTINCT global_id) FROM ids) AS num_global_ids, (SELECT count(*) FILTER (merge_status) FROM fin) AS num_merged_pairs,
  (SELECT count(*) FILTER (is_pure_global_id) / count(*) FROM ge) AS mean_global_id_purity, (SELECT count(*) FILTER (NOT is_pure_global_id) FROM ge) AS mixed_gid_count, (SELECT count(DISTINCT gt_id) FROM u WHERE gt_id > 0) AS expected_global_ids),
rs1 AS (SELECT *, greatest(0, num_local_tracks - expected_global_ids) AS reduction_required, greatest(0, num_local_tracks - num_global_ids) AS reduction_achieved, 1 - mixed_gid_count / num_global_ids AS mixed_gid_quality FROM rs0),
rs2 AS (SELECT *, CASE WHEN reduction_required = 0 THEN 1.0::double ELSE least(1, reduction_achieved / reduction_required) END AS fragment_reduction_quality,
  CASE WHEN reduction_required = 0 AND mixed_gid_count = 0 THEN 1.0::double WHEN num_merged_pairs > 0 THEN mean_global_id_purity ELSE 0 END AS merge_quality FROM rs1),
rs AS (SELECT *, 0.4 * mean_global_id_purity + 0.25 * mixed_gid_quality + 0.25 * fragment_reduction_quality + 0.1 * merge_quality AS reid_score FROM rs2),
dg AS (SELECT count(*) AS num_pairs, count(*) FILTER (merge_status) AS num_merged_pairs, count(*) FILTER (NOT same_camera) AS num_cross_camera_pairs, count(*) FILTER (NOT same_camera AND merge_status) AS num_cross_camera_merged,
  count(*) FILTER (same_camera AND merge_status) AS num_intra_camera_merged, max(cosine_similarity) FILTER (NOT same_camera) AS max_cross_similarity, max(cosine_similarity) FILTER (NOT same_camera AND NOT merge_status) AS top_unmerged_cross_similarity,
  (SELECT concat('{{', string_agg(concat('"', merge_reason, '":', n), ',' ORDER BY merge_reason), '}}') FROM (SELECT merge_reason, count(*) AS n FROM fin WHERE merge_status GROUP BY 1)) AS merge_reason_counts,
  (SELECT count(*) FROM ids) AS num_local_tracks, (SELECT count(DISTINCT global_id) FROM ids) AS num_global_ids, (SELECT mean_global_id_purity FROM rs0) AS identity_precision FROM fin)""".replace("{{", "{").replace("}}", "}")

_diag = f"""SELECT (SELECT count(*) FROM det) AS raw_rows, (SELECT count(*) FROM valid) AS valid_rows, (SELECT min(frame) FROM valid) AS first_frame_min, (SELECT max(frame) FROM valid) AS last_frame_max,
 count(*) AS num_valid_tracks, {_mean('avg_conf')} AS avg_conf_mean, {_mean('avg_area')} AS avg_area_mean,
 (SELECT concat('{{', string_agg(concat('"', camera, '":', n), ',' ORDER BY camera), '}}') FROM (SELECT camera, count(*) AS n FROM judged WHERE is_valid GROUP BY 1)) AS num_valid_tracks_per_camera,
 (SELECT {_mean('coverage_per_gt')} FROM cov) AS gt_coverage_rate, (SELECT pred_match_rate FROM ev WHERE scope = 'all') AS precision, (SELECT gt_coverage_rate FROM ev WHERE scope = 'all') AS recall,
 (SELECT id_switch_count FROM ev WHERE scope = 'all') AS id_switch_count FROM judged WHERE is_valid"""


def _hints(stage: str, rules: dict[str, str], row: str) -> str:
    some = " UNION ALL ".join(f"SELECT '{text}' AS hint FROM ({row}) WHERE {test}" for test, text in rules.items())
    return f"SELECT '{stage}' AS stage, hint FROM ({some}) UNION ALL SELECT '{stage}', '{matching.NO_HINT}' WHERE NOT EXISTS ({some})"


_score = "SELECT scope, score_available, round(tracking_score, 9) AS tracking_score, identity_coverage_rate, precision, recall, mean_track_purity, mixed_track_count, num_valid_tracks FROM sc"
_T = {
    "q_track_summary": "SELECT summ.*, representative_crop FROM summ JOIN rep USING (track_key)",
    "q_filter_reasons": "SELECT track_key, pass_min_frames, pass_min_crops, pass_min_avg_conf, pass_min_avg_area, is_valid, CASE WHEN is_valid THEN 'valid' ELSE 'filtered' END AS status, concat_ws(', ', CASE WHEN NOT pass_min_frames THEN 'min_frames' END, CASE WHEN NOT pass_min_crops THEN 'min_crops' END) AS filter_reason FROM judged",
    "q_valid_rows": "SELECT det_id, camera, track_key, frame FROM valid",
    "q_source_frame": "SELECT det_id, source_frame FROM det",
    "q_gt_match": "SELECT det_id, gt_id, round(gt_iou, 9) AS gt_iou FROM m WHERE is_matched",
    "q_match_all": "SELECT det_id, camera, source_frame, gt_id, round(gt_iou, 9) AS gt_iou, is_matched FROM m",
    "q_track_gt": "SELECT * FROM tt",
    "q_id_switches": "SELECT * FROM sw",
    "q_gt_coverage": "SELECT * EXCLUDE (track_list) FROM cov",
    "q_gt_coverage_display": "SELECT camera, gt_id, track_list, CASE WHEN detected_frames > 0 THEN 'covered' ELSE 'missed' END AS status FROM cov",
    "q_tracking_eval": "SELECT raw_detections, unique_tracks, gt_rows, gt_coverage_rate, pred_match_rate, mean_track_purity, mean_gt_iou, id_switch_count, fragmentation_avg, fragmentation_score, false_positive_rate, round(greatest(0, least(1, 0.30 * gt_coverage_rate + 0.25 * pred_match_rate + 0.20 * mean_track_purity + 0.20 * mean_gt_iou + 0.05 * fragmentation_score - 0.05 * false_positive_rate - 0.005 * id_switch_count)), 9) AS score FROM ev WHERE scope = 'all'",
    "q_fragmentation": "SELECT scope, fragmentation_avg FROM ev WHERE scope <> 'all'",
    "q_mot_metrics": "SELECT scope, true AS score_available, gt_rows AS total_gt_rows, raw_detections AS total_prediction_rows, matched_rows AS tp, raw_detections - matched_rows AS fp, gt_rows - covered_rows AS fn, matched_rows / raw_detections AS precision, matched_rows / (matched_rows + gt_rows - covered_rows) AS recall, round(2 * pred_match_rate * (matched_rows / (matched_rows + gt_rows - covered_rows)) / (pred_match_rate + matched_rows / (matched_rows + gt_rows - covered_rows)), 9) AS f1, round(1 - (gt_rows - covered_rows + raw_detections - matched_rows + id_switch_count) / gt_rows, 9) AS raw_mota_simple, mean_gt_iou AS motp_iou, detected_gt_ids / total_gt_ids AS identity_coverage_rate, fragmentation_avg, mean_track_purity, false_positive_rate, 'Metrik akademik berbasis GT. MOTA sederhana memakai FN, FP, dan ID switch dari evaluasi tracking.' AS note FROM ev WHERE scope = 'all'",
    "q_score_by_camera": f"{_score} WHERE scope <> 'all'",
    "q_case_score": f"{_score} WHERE scope = 'all'",
    "q_diag_tracking": _diag.replace("{{", "{").replace("}}", "}"),
    "q_hints_tracking": _hints("tracking", matching.TRACKING_HINTS, f"SELECT d.*, false_positive_rate, mean_track_purity, fragmentation_avg FROM ({_diag}) d, ev WHERE scope = 'all'"),
    "q_topk_quality": "SELECT track_key, det_id, frame, round(quality, 6) AS quality FROM (SELECT *, conf * ln(1 + area) AS quality, row_number() OVER (PARTITION BY track_key ORDER BY conf * ln(1 + area) DESC, frame, det_id) AS k FROM det WHERE crop_path <> '') WHERE k <= 8",
    "q_topk_uniform": "SELECT track_key, det_id, frame, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY track_key ORDER BY frame, det_id) - 1 AS k, count(*) OVER (PARTITION BY track_key) AS n FROM det WHERE crop_path <> '') WHERE n <= 8 OR list_contains(list_transform(range(8), lambda i: round_even(i * (n - 1) / 7, 0)), k)",
    "q_camera_union": "SELECT camera, track_key, det_id FROM det WHERE camera IN ('camera_1', 'camera_2', 'camera_3', 'camera_5', 'camera_6')",
    "q_distinct_gt": "SELECT DISTINCT camera, source_frame, gt_id FROM gt",
    "q_missing_cameras": "SELECT * FROM (VALUES ('camera_1'), ('camera_2'), ('camera_3'), ('camera_5'), ('camera_6')) c(camera) WHERE camera NOT IN (SELECT camera FROM gt)",
    "q_retention": "SELECT camera, track_key, CAST(place AS INT) AS place FROM (SELECT camera, track_key, row_number() OVER (PARTITION BY camera ORDER BY first_frame DESC, track_key) AS place FROM summ) WHERE place > 5",
    "q_bbox_variants": "SELECT det_id, x1, y1, x2, y2 FROM det",
    "q_box_clip": "SELECT * FROM (SELECT det_id, CAST(least(greatest(round_even(x1 - 20.5, 0), 0), 799) AS INT) AS x1, CAST(least(greatest(round_even(y1 + 0.5, 0), 0), 449) AS INT) AS y1, CAST(least(greatest(round_even(x2 + 10.5, 0), 0), 799) AS INT) AS x2, CAST(least(greatest(round_even(y2 + 1.5, 0), 0), 449) AS INT) AS y2 FROM det) WHERE x2 > x1 AND y2 > y1",
    "q_name_sanitise": "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g') AS name FROM pages",
    "q_fingerprint": "SELECT DISTINCT track_key, substring(sha256(track_key), 1, 16) AS fingerprint FROM det",
    "q_closed_tracks": "SELECT track_key, CAST(sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS num_rows FROM (SELECT d.track_key, e.ts, lag(e.ts) OVER (PARTITION BY d.track_key ORDER BY e.ts) AS p FROM det d JOIN events e ON d.det_id = e.event_id) GROUP BY 1",
}
_V = {
    "q_track_vectors": "SELECT track_key, CAST(place AS INT) AS place, round(x, 6) AS x FROM (SELECT track_key, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS place FROM vec)",
    "q_full_span": "SELECT track_key, camera, f0 AS first_frame, f1 AS last_frame, num_frames, avg_conf, avg_area FROM trk",
    "q_pairs": "SELECT * EXCLUDE (ia, ib) FROM pr",
    "q_top_pairs": "SELECT track_a, track_b, cosine_similarity FROM pr ORDER BY cosine_similarity DESC, track_a, track_b LIMIT 20",
    "q_mnn": "SELECT * FROM mnn",
    "q_pair_verdict": "SELECT track_a, track_b, same_camera, temporal_gap, temporal_overlap, merge_reason FROM vd",
}
_PALETTE = "[" + ", ".join(str(list(c)) for c in identities.PALETTE) + "]"
_COLOURS = f"""SELECT det_id, camera, frame, label, hue, c[1] AS blue, c[2] AS green, c[3] AS red, CAST(CASE WHEN 0.114 * c[1] + 0.587 * c[2] + 0.299 * c[3] >= 150 THEN 0 ELSE 255 END AS INT) AS text_colour FROM (
 SELECT *, CASE WHEN g BETWEEN 1 AND 12 THEN {_PALETTE}[g] ELSE CASE hue // 30 WHEN 0 THEN [p, t, 255] WHEN 1 THEN [p, 255, q] WHEN 2 THEN [t, 255, p] WHEN 3 THEN [255, q, p] WHEN 4 THEN [255, p, t] ELSE [q, p, 255] END END AS c FROM (
 SELECT *, 25 AS p, CAST(round(255 - 230 * f) AS INT) AS q, CAST(round(255 - 230 * (1 - f)) AS INT) AS t FROM (SELECT *, hue / 30 - hue // 30 AS f FROM (SELECT l.*, coalesce(i.global_id, d.track_id) AS g FROM ({{labels}}) l JOIN det d ON l.det_id = d.det_id LEFT JOIN ids i ON d.track_key = i.track_key))))"""
_M = {
    "q_greedy_merge": "SELECT track_a, track_b, merge_status, merge_reason FROM fin WHERE merge_status OR merge_reason LIKE 'blocked_%'",
    "q_global_meta": "SELECT CAST(global_id AS INT) AS global_id, camera, track_key, first_frame, last_frame FROM ids",
    "q_label_rows": "SELECT det_id, det.track_key, CAST(global_id AS INT) AS global_id FROM det LEFT JOIN ids USING (track_key)",
    "q_overlay_labels": _COLOURS.replace("{labels}", "SELECT det_id, det.camera, frame, CASE WHEN x2 - x1 < 80 OR y2 - y1 < 100 THEN concat('G', coalesce(global_id, det.track_id), '|T', det.track_id) ELSE concat('GID:', coalesce(global_id, det.track_id), ' | T', det.track_id) END AS label, CAST(coalesce(global_id, det.track_id) * 67 % 180 AS INT) AS hue FROM det LEFT JOIN ids USING (track_key)"),
    "q_gid_rep": "SELECT CAST(global_id AS INT) AS global_id, first(track_key ORDER BY avg_area DESC, avg_conf DESC, track_key) AS representative, concat('[\"', string_agg(track_key, '\",\"' ORDER BY camera, track_id), '\"]') AS members_json, string_agg(DISTINCT camera, ', ' ORDER BY camera) AS cameras FROM ids GROUP BY 1",
    "q_merge_evidence": "SELECT CAST(i.global_id AS INT) AS global_id, f.track_a, f.track_b, camera_a, camera_b, CASE WHEN camera_a = camera_b THEN 'intra_camera' ELSE 'cross_camera' END AS merge_type, cosine_similarity, merge_reason FROM fin f JOIN ids i ON f.track_a = i.track_key WHERE merge_status",
}
_I = {
    "q_gid_eval": "SELECT * EXCLUDE (least_gt_id) REPLACE (CAST(global_id AS INT) AS global_id) FROM ge",
    "q_gid_summary": "SELECT * REPLACE (CAST(global_id AS INT) AS global_id) FROM gs",
    "q_gallery_filters": "SELECT CAST(global_id AS INT) AS global_id, num_cameras > 1 AS multi_camera, num_cameras <= 1 AS single_camera, is_mixed_gid FROM gs",
    "q_pairwise_detail": "SELECT * FROM pd",
    "q_pairwise_summary": "SELECT * FROM ps",
    "q_confusion": "SELECT 'same_gt' AS actual, tp_pair AS same_global_id, fn_pair AS different_global_id FROM ps UNION ALL SELECT 'different_gt', fp_pair, tn_pair FROM ps",
    "q_reid_score": "SELECT * REPLACE (round(reid_score, 9) AS reid_score) FROM rs",
    "q_final_score": "SELECT true AS score_available, round(0.6 * round(tracking_score, 9) + 0.4 * reid_score, 8) AS final_pipeline_score FROM sc, rs WHERE scope = 'all'",
    "q_diag_reid": "SELECT *, identity_precision AS identity_recall, identity_precision AS identity_f1 FROM dg",
    "q_hints_reid": _hints("reid", {k.replace("{t}", "0.3"): v for k, v in identities.REID_HINTS.items()}, "SELECT * FROM dg"),
}

_JUDGED = "j.track_key, j.camera, j.track_id, j.num_frames, j.num_crops, j.avg_conf, j.avg_area"
_info = lambda n, t: f"(SELECT count(*) FROM {t}) AS {n}_rows, (SELECT min(source_frame) FROM {t}) AS {n}_min_frame, (SELECT max(source_frame) FROM {t}) AS {n}_max_frame, (SELECT string_agg(DISTINCT camera, ', ' ORDER BY camera) FROM {t}) AS {n}_cameras"
_box = "camera, source_frame, gt_id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS gt_area FROM gt WHERE x2 > x1 AND y2 > y1"
_T |= {
    "q_track_overview": f"SELECT {_JUDGED}, is_valid, CASE WHEN is_valid THEN 'valid' ELSE 'filtered' END AS status, dominant_gt_id, track_gt_purity AS track_purity FROM judged j LEFT JOIN tt ON j.track_key = tt.track_key",
    "q_local_gallery": f"SELECT {_JUDGED}, representative_crop AS image_path, dominant_gt_id, track_gt_purity AS track_purity FROM judged j JOIN rep r ON j.track_key = r.track_key LEFT JOIN tt ON j.track_key = tt.track_key WHERE is_valid AND representative_crop <> ''",
    "q_case_overview": "SELECT string_agg(DISTINCT camera, ', ' ORDER BY camera) AS cameras, min(source_frame) AS first_source_frame, max(source_frame) AS last_source_frame, count(DISTINCT track_key) AS num_tracks, CAST(70 AS DOUBLE) AS max_duration_sec, (SELECT count(DISTINCT gt_id) FROM gt) AS num_gt_ids, (SELECT count(*) FROM gt) AS gt_rows FROM det",
    "q_gt_info": f"SELECT {_info('pred', 'det')}, {_info('gt', 'gt')}, (SELECT count(*) FROM m WHERE gt_id > 0) AS matched_rows",
    "q_camera_status": "SELECT c.camera, coalesce(n, 0) AS num_detections, coalesce(num_valid_tracks, 0) AS num_valid_tracks, round(tracking_score, 9) AS tracking_score, CASE WHEN n IS NULL THEN 'not_run' ELSE 'done' END AS status FROM (VALUES ('camera_1'), ('camera_2'), ('camera_3'), ('camera_5'), ('camera_6')) c(camera) LEFT JOIN (SELECT camera, count(*) AS n FROM det GROUP BY 1) d ON c.camera = d.camera LEFT JOIN sc ON c.camera = sc.scope",
    "q_score_table": "SELECT scope, round(tracking_score, 9) AS tracking_score, round(1 - (gt_rows - covered_rows + raw_detections - matched_rows + id_switch_count) / gt_rows, 9) AS raw_mota_simple, mean_gt_iou AS motp_iou FROM sc JOIN ev USING (scope) WHERE scope <> 'all'",
    "q_score_rollup": "SELECT round(avg(round(tracking_score, 9)), 7) AS mean_tracking_score, min(round(tracking_score, 9)) AS min_tracking_score, count(*) AS num_cameras_scored FROM sc WHERE scope <> 'all'",
    "q_expected_ids": "SELECT count(DISTINCT gt_id) AS expected_global_ids FROM m WHERE gt_id > 0",
    "q_overlay_truth": "SELECT d.det_id, f.gt_id, round(f.gt_iou, 9) AS gt_iou FROM det d JOIN (SELECT *, row_number() OVER (PARTITION BY camera, frame, track_key ORDER BY det_id) AS k FROM m) f ON d.camera = f.camera AND d.frame = f.frame AND d.track_key = f.track_key AND f.k = 1",
    "q_camera_limits": "SELECT track_key, num_frames >= f AND num_crops >= c AS is_valid, concat_ws(', ', CASE WHEN num_frames < f THEN 'min_frames' END, CASE WHEN num_crops < c THEN 'min_crops' END) AS filter_reason FROM (SELECT *, CASE camera WHEN 'camera_1' THEN 10 WHEN 'camera_2' THEN 60 ELSE 30 END AS f, CASE camera WHEN 'camera_1' THEN 5 ELSE 24 END AS c FROM summ)",
    "q_annotation_rows": f"SELECT DISTINCT {_box}",
    "q_annotation_nested": f"SELECT DISTINCT {_box}",
}
_I |= {
    "q_reid_summary": "SELECT num_local_tracks, num_global_ids, num_merged_pairs, (num_local_tracks - num_global_ids) / num_local_tracks AS fragment_reduction_rate, mean_global_id_purity, mixed_gid_count FROM rs0",
    "q_gid_truth": "SELECT DISTINCT CAST(global_id AS INT) AS global_id, track_key, camera, gt_id FROM ge0",
}

_CASES = """
 ('case_1_normal_success', 'Case 1 - Single-Camera Normal Success', 'camera_2', 'single_camera_normal', 3, 1, 800),
 ('case_2_crowded_fragmentation', 'Case 2 - Crowded / False Positive Sensitive', 'camera_3', 'single_camera_false_positive_sensitive', 9, 1201, 2000),
 ('case_3_failure_limitation', 'Case 3 - Small/Distant Person Limitation', 'camera_1', 'single_camera_small_or_distant', 6, 801, 1600),
 ('case_4_multicamera_success', 'Case 4 - Multi-Camera Same-Time Re-ID', 'camera_1, camera_3', 'multi_camera_same_time', 3, 1201, 2000),
 ('case_5_multicamera_3_video_stress', 'Case 5 - Multi-Camera 3-Video Stress Test', 'camera_1, camera_2, camera_3', 'multi_camera_crowded_or_stress', 9, 1201, 2000),
 ('case_6_multicamera_temporal_handoff', 'Case 6 - Multi-Camera Temporal Handoff', 'camera_6, camera_5', 'multi_camera_long_term_or_handoff', 3, 184, 1023)"""
_T |= {
    "q_case_catalog": f"""SELECT v.*, 0 AS local_frame_start, 1 AS annotation_frame_start, 'xyxy' AS bbox_format, CAST(0.5 AS DOUBLE) AS gt_iou_threshold, coalesce(num_detections, 0) AS num_detections, coalesce(num_tracks, 0) AS num_tracks, coalesce(num_boxes, 0) AS num_boxes, coalesce(num_gt_ids, 0) AS num_gt_ids
 FROM (VALUES {_CASES}) v(case_id, title, cameras, scene_type, gt_identity, source_frame_start, source_frame_end)
 LEFT JOIN (SELECT case_id, count(*) AS num_detections, count(DISTINCT track_key) AS num_tracks FROM det JOIN (VALUES {_CASES}) c(case_id, t, cs, s, g, f0, f1) ON list_contains(string_split(cs, ', '), camera) AND source_frame BETWEEN f0 AND f1 GROUP BY 1) a ON v.case_id = a.case_id
 LEFT JOIN (SELECT case_id, count(*) AS num_boxes, count(DISTINCT gt_id) AS num_gt_ids FROM gt JOIN (VALUES {_CASES}) c(case_id, t, cs, s, g, f0, f1) ON list_contains(string_split(cs, ', '), camera) AND source_frame BETWEEN f0 AND f1 GROUP BY 1) b ON v.case_id = b.case_id""",
    "q_annotation_locate": f"SELECT DISTINCT {_box} AND source_frame // 100 = (SELECT min(h.source_frame // 100) FROM gt h WHERE h.camera = gt.camera)",
    "q_gt_load": """SELECT c.camera, count(b.f) AS rows_before, count(CASE WHEN f BETWEEN 200 AND 500 THEN f END) AS rows_after, min(f) AS first_before, max(f) AS last_before, min(CASE WHEN f BETWEEN 200 AND 500 THEN f END) AS first_after, max(CASE WHEN f BETWEEN 200 AND 500 THEN f END) AS last_after,
 CASE WHEN count(b.f) = 0 THEN 'no annotation' WHEN count(CASE WHEN f BETWEEN 200 AND 500 THEN f END) = 0 THEN 'nothing within the frames' END AS error
 FROM (VALUES ('camera_1'), ('camera_2'), ('camera_9')) c(camera) LEFT JOIN (SELECT DISTINCT camera, source_frame + 1 AS f, gt_id, x1, y1, x2, y2 FROM gt WHERE x2 > x1 AND y2 > y1) b ON c.camera = b.camera GROUP BY 1""",
    "q_sink_order": "SELECT row_number() OVER (ORDER BY camera, track_id) AS place, camera, track_id, num_frames FROM summ",
    "q_stream_tracks": f"""SELECT camera, video, track_id, concat(camera, '_T', track_id) AS track_key, count(DISTINCT f) AS num_frames, CAST(count(*) FILTER (crop_path <> '') AS BIGINT) AS num_crops, {_mean('conf')} AS avg_conf, {_mean('area')} AS avg_area, min(f) AS first_frame, max(f) AS last_frame,
 first(crop_path ORDER BY area DESC, conf DESC, det_id) AS representative_crop FROM (
  SELECT *, sum(CASE WHEN f - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY camera, track_id, video ORDER BY f, det_id) AS piece FROM (
   SELECT *, lag(f) OVER (PARTITION BY camera, track_id, video ORDER BY f, det_id) AS p FROM (SELECT *, CAST(frame // 240 AS BIGINT) AS video, CAST(frame % 240 AS INT) AS f FROM det)))
 GROUP BY camera, video, track_id, piece HAVING video < (SELECT max(frame // 240) FROM det) OR max(f) + 13 <= (SELECT max(frame) % 240 FROM det) - 20""",
    "q_order_summary": "SELECT CAST(row_number() OVER (ORDER BY camera, track_id) AS INT) AS place, track_key FROM summ",
    "q_order_coverage": "SELECT CAST(row_number() OVER (ORDER BY camera, gt_id) AS INT) AS place, camera, gt_id FROM cov",
    "q_track_keys": "SELECT det_id, track_key FROM det",
    "q_box_geometry": "SELECT det_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM det",
    "q_track_crops": f"""SELECT c.*, round(x1 / (sqrt(x2) + 1e-12), 6) AS first_place FROM (SELECT track_key, count(*) AS num_crops, min(frame) AS first_frame, max(frame) AS last_frame, {_mean('conf')} AS avg_conf, {_mean('area')} AS avg_area, first(crop_path ORDER BY conf * ln(1 + area) DESC, frame, det_id) AS representative_crop FROM det WHERE crop_path <> '' GROUP BY 1) c
 JOIN (SELECT track_key, max(CASE WHEN i = 1 THEN x END) AS x1, sum(x * x) AS x2 FROM (SELECT track_key, i, CAST(sum(CAST(vector[i] AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM ({adapters.CROPS.format(detections="det", embeddings="embeddings")})) GROUP BY 1, 2) GROUP BY 1) v ON c.track_key = v.track_key""",
    "q_truthy": "SELECT det_id, det_id % 7 < 4 AS is_true FROM det",
    "q_run_ids": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events",
    "q_csv_rescan": "SELECT track_key, num_frames, first_frame FROM summ",
}
_M |= {
    "q_order_identities": "SELECT CAST(row_number() OVER (ORDER BY global_id, camera, track_key) AS INT) AS place, CAST(global_id AS INT) AS global_id, track_key FROM ids",
    "q_order_merged": "SELECT CAST(row_number() OVER (ORDER BY i.global_id, cosine_similarity DESC, track_a, track_b) AS INT) AS place, CAST(i.global_id AS INT) AS global_id, track_a, track_b FROM fin JOIN ids i ON fin.track_a = i.track_key WHERE merge_status",
}

ORACLE_SQL = {k: f"WITH {_BASE} {v}" for k, v in _T.items()}
ORACLE_SQL |= {k: f"WITH {_BASE}, {_VECTORS} {v}" for k, v in _V.items()}
ORACLE_SQL |= {k: f"WITH RECURSIVE {_BASE}, {_VECTORS}, {_MERGE} {v}" for k, v in _M.items()}
ORACLE_SQL |= {k: f"WITH RECURSIVE {_BASE}, {_VECTORS}, {_MERGE}, {_IDS} {v}" for k, v in _I.items()}
