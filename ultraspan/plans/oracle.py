"""DuckDB SQL for the registered queries: plain definitions (pixel sets, stencils, recursive closures) where ours are
sweeps, halos and components."""

from __future__ import annotations

import math

_BOXES = """boxes AS (
  SELECT user_id::VARCHAR AS recording, event_id AS box_id, event_id * 7 % 64 AS freq_start, event_id * 7 % 64 + event_id % 11 AS freq_end,
         hour(ts) * 60 + minute(ts) AS t_start, hour(ts) * 60 + minute(ts) + floor(value)::BIGINT AS t_end, event_type AS label, value AS score, event_id % 2 AS side
  FROM events),
pred0 AS (SELECT * FROM boxes WHERE side = 0), truth0 AS (SELECT * FROM boxes WHERE side = 1),
pred AS (SELECT recording, min(box_id) AS box_id, freq_start, freq_end, t_start, t_end, label FROM pred0 GROUP BY ALL),
truth AS (SELECT recording, min(box_id) AS box_id, freq_start, freq_end, t_start, t_end, label FROM truth0 GROUP BY ALL),
recs AS (SELECT DISTINCT recording FROM boxes)"""

_AREA = "(({0}.t_end - {0}.t_start + 1) * ({0}.freq_end - {0}.freq_start + 1))"


def _pairs(a: str, b: str, name: str) -> str:
    shared = "((least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start) + 1) * (least(a.freq_end, b.freq_end) - greatest(a.freq_start, b.freq_start) + 1))"
    return f"""{name} AS (
  SELECT a.recording, a.box_id AS a_id, a.label AS a_label, b.box_id AS b_id, b.label AS b_label, b.t_start AS b_ts, b.t_end AS b_te, b.freq_start AS b_fs, b.freq_end AS b_fe,
         {shared}::DOUBLE / ({_AREA.format('a')} + {_AREA.format('b')} - {shared}) AS iou
  FROM {a} a JOIN {b} b ON a.recording = b.recording AND a.t_start <= b.t_end AND b.t_start <= a.t_end AND a.freq_start <= b.freq_end AND b.freq_start <= a.freq_end)"""


_BEST = f"""{_pairs('truth', 'pred', 'tp')}, {_pairs('pred', 'truth', 'pt')},
per_truth AS (SELECT t.recording, t.box_id, t.label, count(tp.b_id) AS n_matches, coalesce(max(tp.iou), 0) AS value FROM truth t LEFT JOIN tp ON tp.a_id = t.box_id GROUP BY ALL),
per_pred AS (SELECT t.recording, t.box_id, t.label, count(pt.b_id) AS n_matches, coalesce(max(pt.iou), 0) AS value FROM pred t LEFT JOIN pt ON pt.a_id = t.box_id GROUP BY ALL)"""


def _scores(thresholds: str, beta: float, per: str = "per") -> str:
    b2 = beta * beta
    return f"""
counts AS (
  SELECT r.recording, th.threshold,
         (SELECT count(*) FROM {per}_truth p WHERE p.recording = r.recording) AS n_truth,
         (SELECT count(*) FROM {per}_truth p WHERE p.recording = r.recording AND n_matches > 0 AND value >= th.threshold) AS truth_hits,
         (SELECT count(*) FROM {per}_pred p WHERE p.recording = r.recording) AS n_pred,
         (SELECT count(*) FROM {per}_pred p WHERE p.recording = r.recording AND n_matches > 0 AND value >= th.threshold) AS pred_hits
  FROM recs r, (SELECT unnest({thresholds}::DOUBLE[]) AS threshold) th),
pr AS (SELECT *, CASE WHEN truth_hits + n_pred - pred_hits > 0 THEN truth_hits::DOUBLE / (truth_hits + n_pred - pred_hits) ELSE 0 END AS p, CASE WHEN n_truth > 0 THEN truth_hits::DOUBLE / n_truth ELSE 0 END AS r FROM counts),
scores AS (SELECT *, CASE WHEN {b2} * p + r = 0 THEN 0 ELSE {1 + b2} * p * r / ({b2} * p + r) END AS f FROM pr)"""


_PIXELS = """
px AS (SELECT recording, side, t, unnest(generate_series(freq_start, freq_end)) AS f FROM (SELECT *, unnest(generate_series(t_start, t_end)) AS t FROM boxes)),
own AS (SELECT recording, {what}, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS p, max(side) AS t_ FROM px GROUP BY ALL)"""


def _iou_global(what: str) -> str:
    return f"WITH {_BOXES},{_PIXELS.format(what=what)} SELECT recording, round(sum(p * t_)::DOUBLE / count(*), 6) AS iou FROM own GROUP BY recording"


_FRAMES = """frames AS (
  SELECT label::VARCHAR AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS mags FROM embeddings),
cells AS (SELECT recording, frame, unnest(range(0, 64)) AS bin, unnest(mags) AS mag FROM frames),
sizes AS (SELECT recording, count(*) AS n FROM frames GROUP BY recording)"""


def _stencil(weights: dict[tuple[int, int], float], source: str = "cells") -> str:
    """Weighted sum over neighbours (frequency shift, time shift), edges repeated."""
    rows = ", ".join(f"({q}, {p}, {w!r}::DOUBLE)" for (q, p), w in weights.items())
    return f"""(SELECT c.recording, c.frame, c.bin, sum(x.mag * k.w) AS v
  FROM {source} c JOIN sizes s USING (recording), (VALUES {rows}) k(q, p, w), {source} x
  WHERE x.recording = c.recording AND x.frame = least(greatest(c.frame + k.p, 0), s.n - 1) AND x.bin = least(greatest(c.bin + k.q, 0), 63)
  GROUP BY ALL)"""


def _gauss(sx: float, sy: float, diagonal: bool = False) -> dict[tuple[int, int], float]:
    if diagonal:  # rows are frequency: the first index of the kernel
        w = {(p, q): math.exp(-(((q - p) / sx) ** 2 + ((q + p) / sy) ** 2)) for p in (-1, 0, 1) for q in (-1, 0, 1)}
    else:
        w = {(f, t): math.exp(-(f * f / (2 * sy * sy))) * math.exp(-(t * t / (2 * sx * sx))) for f in (-1, 0, 1) for t in (-1, 0, 1)}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def _filtered(weights: dict[tuple[int, int], float]) -> str:
    return f"WITH {_FRAMES} SELECT recording, frame, bin, round(v, 6) AS value FROM {_stencil(weights)}"


def _closure(nodes: str, edges: str) -> str:
    """node, root: smallest node reachable over edges (u, v)."""
    return f"""
reach AS (SELECT id AS node, id AS root FROM {nodes} UNION SELECT e.v, r.root FROM reach r JOIN {edges} e ON e.u = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


def _db(x: str, ref: float, amin: float) -> str:
    return f"(20 * log10(greatest({x}, {amin!r}::DOUBLE)) - {20 * math.log10(max(amin, ref))!r}::DOUBLE)"


_SIGNAL = """sig AS (SELECT user_id::VARCHAR AS recording, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def _stft(n_fft: int, win: int, hop: int, power: int, source: str = "sig") -> str:
    half, left = n_fft // 2, (n_fft - win) // 2
    return f"""
tt AS (SELECT recording, any_value(n) AS n FROM {source} GROUP BY recording HAVING any_value(n) > {half}),
fr AS (SELECT recording, n, unnest(range(0, n // {hop} + 1)) AS frame FROM tt),
tap AS (SELECT recording, n, frame, j, frame * {hop} - {half} + j AS i FROM fr, (SELECT unnest(range(0, {n_fft})) AS j)),
pos AS (SELECT recording, frame, j, CASE WHEN i < 0 THEN -i WHEN i >= n THEN 2 * (n - 1) - i ELSE i END AS s FROM tap),
win AS (SELECT a.recording, a.frame, a.j, g.x * CASE WHEN a.j >= {left} AND a.j < {left + win} THEN 0.5 - 0.5 * cos(2 * pi() * (a.j - {left}) / {win}) ELSE 0 END AS x FROM pos a JOIN {source} g ON g.recording = a.recording AND g.s = a.s),
dft AS (SELECT recording, frame, k AS bin, sqrt(pow(sum(x * cos(2 * pi() * k * j / {n_fft})), 2) + pow(sum(x * sin(2 * pi() * k * j / {n_fft})), 2)) AS m FROM win, (SELECT unnest(range(0, {half + 1})) AS k) GROUP BY ALL)
SELECT recording, frame, bin, round(pow(m, {power}) / {1 if power == 1 else 7}, 6) AS value FROM dft"""


_NEAREST = "greatest(0, least({n} - 1, ceil(({v} - 0.0) / {d} - 0.5)))::BIGINT"
_ANN = """ann AS (
  SELECT (user_id % 5)::VARCHAR AS folder, user_id::VARCHAR AS begin_file, event_id AS box_id, (hour(ts) * 60 + minute(ts)) * 60.0::DOUBLE + floor(second(ts)) * 130.0::DOUBLE - 3000.0 AS begin_time,
         (hour(ts) * 60 + minute(ts)) * 60.0::DOUBLE + floor(second(ts)) * 130.0::DOUBLE - 3000.0 + value * 60.0::DOUBLE AS end_time,
         (event_id * 7 % 64) * 1300.0::DOUBLE - 2000.0 AS low_freq, (event_id * 7 % 64) * 1300.0::DOUBLE - 2000.0 + (event_id % 11) * 900.0::DOUBLE AS high_freq, event_type AS usv_type
  FROM events)"""
#: Pixel spans of the two grids: (last - first) / n.
_TS, _FS = "(60.0::DOUBLE * 2879 / 2880)", "(1000.0::DOUBLE * 79 / 80)"
_EDT = "(0.001024::DOUBLE * (n - 1) / n)"
_EFS = "(1000.0::DOUBLE * 63 / 64)"

_MODELS = """models AS (
  SELECT *, 'every' AS model FROM pred0 UNION ALL SELECT *, 'high' FROM pred0 WHERE score > 30 UNION ALL SELECT *, 'low' FROM pred0 WHERE freq_end < 32)"""
_MODEL_SCORES = f"""{_MODELS},
mp AS (SELECT model, recording, min(box_id) AS box_id, freq_start, freq_end, t_start, t_end, label FROM models GROUP BY ALL),
mm AS (SELECT m.model, m.recording, m.box_id AS p_id, t.box_id AS t_id,
   ((least(m.t_end, t.t_end) - greatest(m.t_start, t.t_start) + 1) * (least(m.freq_end, t.freq_end) - greatest(m.freq_start, t.freq_start) + 1)) AS shared, {_AREA.format('m')} AS ma, {_AREA.format('t')} AS ta
   FROM mp m JOIN truth t ON m.recording = t.recording AND m.t_start <= t.t_end AND t.t_start <= m.t_end AND m.freq_start <= t.freq_end AND t.freq_start <= m.freq_end),
hit AS (SELECT *, shared::DOUBLE / (ma + ta - shared) AS iou FROM mm),
every AS (SELECT recording, unnest(['every', 'high', 'low']) AS model FROM recs),
mc AS (SELECT e.model, e.recording, (SELECT count(*) FROM truth t WHERE t.recording = e.recording) AS n_truth,
   (SELECT count(DISTINCT t_id) FROM hit h WHERE h.model = e.model AND h.recording = e.recording AND iou >= 0.1) AS th,
   (SELECT count(*) FROM mp m WHERE m.model = e.model AND m.recording = e.recording) AS n_pred,
   (SELECT count(DISTINCT p_id) FROM hit h WHERE h.model = e.model AND h.recording = e.recording AND iou >= 0.1) AS ph FROM every e),
ms AS (SELECT *, CASE WHEN th + n_pred - ph > 0 THEN th::DOUBLE / (th + n_pred - ph) ELSE 0 END AS p, CASE WHEN n_truth > 0 THEN th::DOUBLE / n_truth ELSE 0 END AS r FROM mc)"""

_LABELS = f"""{_pairs('pred', 'truth', 'pt')},
best AS (SELECT a_id, arg_max(b_label, (iou, -b_te, -b_ts, -b_fs, -b_id)) AS l FROM pt GROUP BY a_id),
lab AS (SELECT p.recording, p.box_id, p.label AS predicted, coalesce(best.l, 'noise') AS "true" FROM pred p LEFT JOIN best ON best.a_id = p.box_id)"""


def _merged(source: str, dt: int, df: int) -> str:
    return f"""WITH RECURSIVE {_BOXES},
src AS (SELECT *, box_id AS id FROM {source}),
e AS (SELECT a.id AS u, b.id AS v FROM src a JOIN src b ON a.recording = b.recording AND a.t_start - {dt} <= b.t_end AND b.t_start <= a.t_end + {dt} AND a.freq_start - {df} <= b.freq_end AND b.freq_start <= a.freq_end + {df} AND a.id <> b.id),
{_closure('src', 'e')}
SELECT recording, min(box_id) AS box_id, min(freq_start) AS freq_start, max(freq_end) AS freq_end, min(t_start) AS t_start, max(t_end) AS t_end, round(avg(score), 6) AS score, count(*) AS n_merged{{label}}
FROM src JOIN roots ON node = id GROUP BY recording, root"""


_ENTROPY = """ent AS (SELECT recording, frame, CASE WHEN min(mag) = 0 THEN 0 ELSE exp(avg(ln(mag))) / avg(mag) END AS e FROM {cells} GROUP BY ALL HAVING sum(mag) > 0)"""


def _smooth(width: int) -> str:
    lo, hi = width // 2, (width - 1) // 2
    own = f"(PARTITION BY recording ORDER BY frame ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"
    return f"sm AS (SELECT recording, frame, (sum(e) OVER {own} + ({width} - count(*) OVER {own})) / {width} AS e FROM ent)"


def _ranges(cells: str = "cells") -> str:
    return f"""{_ENTROPY.format(cells=cells)}, {_smooth(3)},
rg AS (SELECT recording, min(frame) AS first, max(frame) AS last FROM (SELECT recording, frame, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS g FROM sm WHERE e < 0.64) GROUP BY recording, g)"""


def _rows(cells: str) -> str:
    own = "(PARTITION BY recording, first, last ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"""en AS (SELECT r.recording, r.first, r.last, c.bin, avg(c.mag * c.mag) AS e FROM rg r JOIN {cells} c ON c.recording = r.recording AND c.frame BETWEEN r.first AND r.last GROUP BY ALL),
em AS (SELECT *, avg(e) OVER (PARTITION BY recording, first, last) AS m FROM en),
es AS (SELECT *, (sum(e) OVER {own} + (3 - count(*) OVER {own}) * m) / 3 AS x FROM em),
rr AS (SELECT recording, first AS t_start, last AS t_end, min(bin) AS lo, max(bin) AS hi FROM (SELECT *, bin - row_number() OVER (PARTITION BY recording, first, last ORDER BY bin) AS g FROM es WHERE x > 1.3 * m) GROUP BY recording, first, last, g)"""


_LOUD = f"""loud AS (SELECT recording, frame AS t_start, frame AS t_end, 0 AS last FROM frames WHERE list_max(mags) > 0.36),
px AS (SELECT recording, n, ceil(2 * 0.001024::DOUBLE / {_EDT})::BIGINT AS least, ceil(0.001024::DOUBLE * (n - 1) / {_EDT})::BIGINT AS stop FROM sizes),
al AS (SELECT * FROM loud UNION ALL SELECT recording, stop, stop, 1 FROM px),
gp AS (SELECT *, greatest(0, coalesce(max(t_end) OVER (PARTITION BY recording ORDER BY t_start, last, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM al),
spans AS (SELECT gp.recording, s AS span_start, t_start AS span_end FROM gp JOIN px USING (recording) WHERE t_start - s >= least),
wq AS (SELECT s.recording, span_start, span_end, bin, quantile_cont(mag, 0.75) AS q FROM spans s JOIN cells c ON c.recording = s.recording AND c.frame >= span_start AND c.frame < span_end WHERE span_end - span_start > 1 GROUP BY ALL),
wt AS (SELECT recording, span_start, span_end, avg(q) AS weight FROM wq GROUP BY ALL)"""

_CLIP = f"""cm AS (SELECT recording, n, ceil(0.01::DOUBLE / {_EDT})::BIGINT AS t_lo, ceil(0.03::DOUBLE / {_EDT})::BIGINT AS t_hi, ceil(5000.0::DOUBLE / {_EFS})::BIGINT AS f_lo FROM sizes)"""
_HALF = "(SELECT *, 'train' AS part, 0 AS t_lo, ceil(36000.0::DOUBLE / {ts})::BIGINT AS t_hi FROM boxes UNION ALL SELECT *, 'test', ceil(36000.0::DOUBLE / {ts})::BIGINT, ceil(60.0::DOUBLE * 2879 / {ts})::BIGINT FROM boxes)".format(ts=_TS)
_FTOP = f"ceil(1000.0::DOUBLE * 79 / {_FS})::BIGINT"

_CONFIGS = "cfg AS (SELECT p_partkey::VARCHAR AS config_id, p_partkey % 25 % 5 + 2 AS num_iter, 0 AS smoothing, 0.5::DOUBLE + (p_partkey % 25) * 0.015::DOUBLE AS flood_threshold, 0.2::DOUBLE + (p_partkey % 25) * 0.06::DOUBLE AS balloon_latent, (1.0 + p_partkey % 25 % 3)::DOUBLE AS sigma FROM part)"
_TRIALS = "tr AS (SELECT user_id::VARCHAR AS recording, count(*) AS n_boxes, unnest(range(0, 25)) AS n FROM events GROUP BY user_id), trials AS (SELECT recording, n::VARCHAR AS config_id, ((n_boxes * 7 + n * 13) % 17) / 17.0::DOUBLE AS score, n_boxes FROM tr)"
_CHUNKS = """cp AS (SELECT recording, t_start // 100 AS chunk_id, t_start % 100 + 0.7::DOUBLE AS ts, freq_start + 0.9::DOUBLE AS fs, t_start % 100 + score + 0.2::DOUBLE AS te, freq_end + 0.1::DOUBLE AS fe, box_id % 4 AS label_id, (box_id % 10) / 10.0::DOUBLE AS score FROM boxes),
cc AS (SELECT recording, floor(fs)::BIGINT AS freq_start, floor(fe)::BIGINT AS freq_end, floor(ts)::BIGINT + chunk_id * 100 AS t_start, floor(te)::BIGINT + chunk_id * 100 AS t_end, label_id::INT AS label_id, score FROM cp WHERE score > 0.3)"""
_MASK = "(mag > 0.13::DOUBLE)"

ORACLE: dict[str, str] = {
    "detection_scores": f"WITH {_BOXES}, {_BEST}, {_scores('[0.1]', 1.0)} SELECT recording, threshold, n_truth, truth_hits, n_pred, pred_hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_score FROM scores",
    "iou_elementwise": f"WITH {_BOXES}, {_pairs('truth', 'pred', 'tp')} SELECT recording, a_id AS target_id, b_id AS cover_id, round(iou, 6) AS iou FROM tp",
    "matches": f"WITH {_BOXES}, {_pairs('truth', 'pred', 'tp')} SELECT t.recording, t.box_id AS target_id, b_id AS cover_id, round(iou, 6) AS iou FROM truth t LEFT JOIN tp ON a_id = box_id",
    "iou_global_2d": _iou_global("t, f"),
    "iou_global_time": _iou_global("t"),
    "iou_global_freq": _iou_global("f"),
    "coverage_2d": f"WITH {_BOXES},{_PIXELS.format(what='t, f')} SELECT recording, CASE WHEN sum(p) > 0 THEN round(sum(p * t_)::DOUBLE / sum(p), 6) ELSE 0 END AS a_covered, CASE WHEN sum(t_) > 0 THEN round(sum(p * t_)::DOUBLE / sum(t_), 6) ELSE 0 END AS b_covered FROM own GROUP BY recording",
    "iou_per_target_max": f"WITH {_BOXES}, {_BEST} SELECT recording, box_id, label, n_matches, round(value, 6) AS value FROM per_truth",
    "iou_by_label": f"WITH {_BOXES}, {_BEST} SELECT recording, label, row_number() OVER (PARTITION BY recording, label ORDER BY round(value, 6)) - 1 AS place, round(value, 6) AS value FROM per_truth",
    "count_hits": f"WITH {_BOXES}, {_BEST} SELECT recording, count(*) FILTER (n_matches > 0 AND value >= 0.1) AS hits, count(*) AS total FROM per_truth GROUP BY ALL",
    "hits_per_label": f"WITH {_BOXES}, {_BEST} SELECT recording, label, count(*) FILTER (n_matches > 0 AND value >= 0.1) AS hits, count(*) AS total FROM per_truth GROUP BY ALL",
    "detection_precision": f"WITH {_BOXES}, {_BEST}, {_scores('[0.1]', 1.0)} SELECT recording, round(p, 6) AS precision FROM scores",
    "detection_recall": f"WITH {_BOXES}, {_BEST}, {_scores('[0.1]', 1.0)} SELECT recording, round(r, 6) AS recall FROM scores",
    "recall_per_label": f"WITH {_BOXES}, {_BEST} SELECT recording, label, count(*) FILTER (n_matches > 0 AND value >= 0.1) AS hits, count(*) AS total, round(count(*) FILTER (n_matches > 0 AND value >= 0.1)::DOUBLE / count(*), 6) AS recall FROM per_truth GROUP BY ALL",
    "metrics_at_thresholds": f"WITH {_BOXES}, {_BEST}, {_scores('[0.05, 0.1, 0.2]', 2.0)} SELECT recording, threshold, n_truth, truth_hits, n_pred, pred_hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_score FROM scores",
    "f_beta": "WITH x AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE * 10 AS p, l_tax::DOUBLE * 10 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE round(1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r), 6) END AS f_score FROM x",
    "union_detections": f"WITH {_BOXES}, {_MODELS} SELECT model, label, count(*) AS n, min(box_id) AS first_id FROM models GROUP BY ALL",
    "model_summary": f"WITH {_BOXES}, {_MODEL_SCORES} SELECT model, metric, round(sum(v) / (SELECT count(*) FROM recs) * 100, 6) AS value FROM (SELECT model, 'precision' AS metric, p AS v FROM ms UNION ALL SELECT model, 'recall', r FROM ms) GROUP BY ALL",
    "model_summary_wide": f"WITH {_BOXES}, {_MODEL_SCORES}, w AS (SELECT model, round(sum(r) / (SELECT count(*) FROM recs) * 100, 6) AS v FROM ms GROUP BY model) SELECT 'recall' AS metric, max(CASE WHEN model = 'every' THEN v END) AS every, max(CASE WHEN model = 'high' THEN v END) AS high, max(CASE WHEN model = 'low' THEN v END) AS low FROM w",
    "recall_per_class_macro": f"WITH {_BOXES}, {_BEST}, x AS (SELECT recording, label, count(*) FILTER (n_matches > 0 AND value >= 0.1)::DOUBLE / count(*) AS r FROM per_truth GROUP BY ALL) SELECT 'every' AS model, label, 0.1::DOUBLE AS threshold, round(sum(r) / (SELECT count(*) FROM recs) * 100, 6) AS value FROM x GROUP BY label",
    "match_labels": f"WITH {_BOXES}, {_LABELS} SELECT * FROM lab",
    "confusion_matrix": f"WITH {_BOXES}, {_LABELS} SELECT \"true\", " + ", ".join(f"count(*) FILTER (predicted = '{x}') AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view")) + " FROM lab WHERE \"true\" <> 'noise' GROUP BY \"true\"",
    "accuracy": f"WITH {_BOXES}, {_LABELS} SELECT round(avg(CASE WHEN predicted = \"true\" THEN 1.0 ELSE 0.0 END) * 100, 6)::DOUBLE AS accuracy FROM lab",
    "annotations_to_boxes": f"""WITH {_ANN}, c AS (SELECT *, least(greatest(begin_time, 0), 60.0::DOUBLE * 2879) AS b, least(greatest(end_time, 0), 60.0::DOUBLE * 2879) AS e, least(greatest(low_freq, 0), 1000.0::DOUBLE * 79) AS l, least(greatest(high_freq, 0), 1000.0::DOUBLE * 79) AS h FROM ann)
SELECT begin_file AS recording, box_id, floor(l / {_FS})::BIGINT AS freq_start, ceil(h / {_FS})::BIGINT AS freq_end, floor(b / {_TS})::BIGINT AS t_start, ceil(e / {_TS})::BIGINT AS t_end, usv_type AS label FROM c WHERE l < h AND b < e""",
    "unknown_files": "SELECT DISTINCT user_id::VARCHAR AS recording FROM events WHERE user_id % 3 = 0",
    "boxes_to_si": f"WITH {_BOXES} SELECT recording, box_id, round(60.0::DOUBLE * t_start, 6) AS time_start, round(60.0::DOUBLE * t_end, 6) AS time_end, round(1000.0::DOUBLE * freq_start, 6) AS freq_start, round(1000.0::DOUBLE * freq_end, 6) AS freq_end, CASE WHEN label <> 'view' THEN label END AS label FROM boxes",
    "nearest_index_boxes": f"WITH {_ANN} SELECT begin_file AS recording, box_id, {_NEAREST.format(v='low_freq', d='1000.0::DOUBLE', n=80)} AS freq_start, {_NEAREST.format(v='high_freq', d='1000.0::DOUBLE', n=80)} AS freq_end, {_NEAREST.format(v='begin_time', d='60.0::DOUBLE', n=2880)} AS t_start, {_NEAREST.format(v='end_time', d='60.0::DOUBLE', n=2880)} AS t_end FROM ann",
    "filter_boxes": f"WITH {_BOXES} SELECT recording, box_id FROM boxes WHERE 60 * t_end - 60 * t_start > 1800 AND 1000 * freq_end - 1000 * freq_start > 4000",
    "filter_by_ratio": f"WITH {_BOXES} SELECT recording, box_id FROM boxes WHERE t_end > t_start AND freq_end - freq_start < 0.2::DOUBLE * (t_end - t_start)",
    "filter_detection_size": f"WITH {_BOXES} SELECT recording, box_id FROM boxes WHERE freq_end - freq_start < 8 AND t_end - t_start < 120 AND (freq_start + freq_end) / 2.0::DOUBLE >= ceil(18000.0::DOUBLE / {_FS})",
    "distinct_boxes": f"WITH {_BOXES} SELECT recording, min(box_id) AS box_id, freq_start, freq_end, t_start, t_end, label FROM boxes GROUP BY ALL",
    "box_distances": f"""WITH {_BOXES} SELECT a.recording, a.box_id AS a_box_id, b.box_id AS b_box_id,
  CASE WHEN a.t_start BETWEEN b.t_start AND b.t_end OR b.t_start BETWEEN a.t_start AND a.t_end THEN 0 ELSE least(abs(a.t_start - b.t_end), abs(b.t_start - a.t_end)) END AS time_px,
  CASE WHEN a.freq_start BETWEEN b.freq_start AND b.freq_end OR b.freq_start BETWEEN a.freq_start AND a.freq_end THEN 0 ELSE least(abs(a.freq_start - b.freq_end), abs(b.freq_start - a.freq_end)) END AS freq_px
FROM truth0 a JOIN pred0 b ON a.recording = b.recording AND a.t_start - 10 <= b.t_end AND b.t_start <= a.t_end + 10 AND a.freq_start - 5 <= b.freq_end AND b.freq_start <= a.freq_end + 5""",
    "merge_boxes": _merged("pred0", 2, 1).format(label=""),
    "merge_boxes_si": _merged("truth0", 2, 1).format(label=", 'call' AS label"),
    "clip_boxes": f"""WITH {_BOXES}, p AS (SELECT *, ceil(18000.0::DOUBLE / {_TS})::BIGINT AS tl, ceil(54000.0::DOUBLE / {_TS})::BIGINT AS th, ceil(10000.0::DOUBLE / {_FS})::BIGINT AS fl, {_FTOP} AS fh FROM boxes)
SELECT recording, box_id, label, side, least(greatest(freq_start, fl), fh) - fl AS freq_start, least(greatest(freq_end, fl), fh) - fl AS freq_end, least(greatest(t_start, tl), th) - tl AS t_start, least(greatest(t_end, tl), th) - tl AS t_end FROM p WHERE t_end > tl AND t_start < th AND freq_end > fl AND freq_start < fh""",
    "train_test_split": f"""WITH {_BOXES} SELECT recording, box_id, label, side, least(greatest(freq_start, 0), {_FTOP}) AS freq_start, least(greatest(freq_end, 0), {_FTOP}) AS freq_end, least(greatest(t_start, t_lo), t_hi) - t_lo AS t_start, least(greatest(t_end, t_lo), t_hi) - t_lo AS t_end, part
FROM {_HALF} WHERE t_end > t_lo AND t_start < t_hi AND freq_end > 0 AND freq_start < {_FTOP}""",
    "classify_by_frequency": f"WITH {_BOXES} SELECT recording, box_id, CASE WHEN (freq_start + freq_end) / 2.0::DOUBLE > ceil(30000.0::DOUBLE / {_FS}) THEN '50-khz' ELSE '22-khz' END AS label FROM boxes",
    "classification_windows": f"""WITH {_BOXES}, w AS (SELECT *, t_end - t_start <= 40 AS short, unnest(CASE WHEN t_end - t_start <= 40 THEN [t_start] ELSE generate_series(t_start, t_end - 40, 20) END) AS s FROM boxes)
SELECT recording, box_id, CASE WHEN short THEN 0 ELSE (s - t_start) // 20 END AS window, greatest(0, s - 5) AS t_start, least(2880, CASE WHEN short THEN t_end ELSE s + 40 END + 5) AS t_end, greatest(0, freq_start - 3) AS freq_start, least(80, freq_end + 3) AS freq_end FROM w""",
    "position_features": f"WITH {_BOXES} SELECT recording, box_id, round(cos(least(freq_start, 60) * (pi() / 2 / 60)), 6) AS start_cos, round(sin(least(freq_start, 60) * (pi() / 2 / 60)), 6) AS start_sin, round(cos(least(freq_end, 60) * (pi() / 2 / 60)), 6) AS end_cos, round(sin(least(freq_end, 60) * (pi() / 2 / 60)), 6) AS end_sin FROM boxes",
    "reduce_window_predictions": f"""WITH {_BOXES}, w AS (SELECT *, unnest(CASE WHEN t_end - t_start <= 40 THEN [0] ELSE range(0, (t_end - 40 - t_start) // 20 + 1) END) AS win FROM boxes),
p AS (SELECT box_id, win, 'c' || ((box_id + win) % 4) AS class, ((box_id * 13 + win * 7) % 10) / 10.0::DOUBLE AS s FROM w), b AS (SELECT box_id, arg_max(class, (s, -win)) AS class FROM p WHERE s >= 0.6 GROUP BY box_id)
SELECT recording, box_id, coalesce(class, label) AS label FROM boxes LEFT JOIN b USING (box_id)""",
    "clean_labels": f"WITH {_ANN}, l AS (SELECT begin_file, CASE usv_type WHEN 'view' THEN 'background' WHEN 'click' THEN '22-khz' WHEN 'error' THEN 'nan' ELSE usv_type END AS usv_type FROM ann) SELECT begin_file, usv_type, count(*) AS n FROM l WHERE usv_type <> 'background' GROUP BY ALL",
    "align_annotation_times": f"""WITH {_ANN}, f AS (SELECT folder, begin_file, quantile_cont(begin_time, 0.5) AS m, count(*) / 16.0::DOUBLE AS d FROM ann GROUP BY ALL),
o AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY folder ORDER BY m, begin_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, row_number() OVER (PARTITION BY folder ORDER BY m, begin_file) = 1 AS first FROM f)
SELECT folder, begin_file, box_id, round(begin_time - shift, 6) AS begin_time, round(end_time - shift, 6) AS end_time, first OR begin_time - shift > 0 AS in_order FROM ann JOIN o USING (folder, begin_file)""",
    "get_signal": "SELECT user_id::VARCHAR AS recording, user_id::VARCHAR AS name, (user_id % 5)::VARCHAR AS folder, count(*) AS n_samples FROM events WHERE user_id = 7 GROUP BY user_id",
    "pending_configs": f"WITH {_BOXES}, every AS (SELECT recording, unnest(['0', '1', '2', '3']) AS config_id FROM recs) SELECT * FROM every EXCEPT SELECT recording, (box_id % 4)::VARCHAR FROM boxes WHERE freq_end > 60",
    "noise_spans": f"""WITH {_BOXES}, px AS (SELECT recording, ceil(1200.0::DOUBLE / {_TS})::BIGINT AS least, ceil(60.0::DOUBLE * 2879 / {_TS})::BIGINT AS stop FROM recs),
al AS (SELECT recording, t_start, t_end, 0 AS last FROM truth0 UNION ALL SELECT recording, stop, stop, 1 FROM px),
gp AS (SELECT *, greatest(0, coalesce(max(t_end) OVER (PARTITION BY recording ORDER BY t_start, last, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM al)
SELECT recording, s AS span_start, t_start AS span_end FROM gp JOIN px USING (recording) WHERE t_start - s >= least""",
    "noise_span_weights": f"WITH {_FRAMES}, {_LOUD} SELECT recording, span_start, span_end, round(weight, 6) AS weight FROM wt",
    "spectral_entropy": f"WITH {_FRAMES}, {_ENTROPY.format(cells='cells')} SELECT recording, frame, round(e, 6) AS entropy FROM ent",
    "entropy_moving_average": f"WITH {_FRAMES}, {_ENTROPY.format(cells='cells')}, {_smooth(5)} SELECT recording, frame, round(e, 6) AS entropy FROM sm",
    "low_entropy_ranges": f"WITH {_FRAMES}, {_ranges()} SELECT * FROM rg",
    "high_energy_rows": f"WITH {_FRAMES}, {_ranges()}, {_rows('cells')} SELECT recording, t_start, t_end, lo AS first, hi AS last FROM rr",
    "detect_entropy_energy": f"WITH {_FRAMES}, hc AS (SELECT * FROM cells WHERE bin > 9), {_ranges('hc')}, {_rows('hc')} SELECT recording, lo AS freq_start, hi AS freq_end, t_start, t_end FROM rr WHERE t_end > t_start AND hi - lo < 4.0 * (t_end - t_start)",
    "noise_profile": f"WITH {_FRAMES}, nd AS (SELECT recording, bin, {_db('mag', 1.0, 1e-20)} AS db FROM cells WHERE frame < 20), nf AS (SELECT recording, bin, greatest(db, max(db) OVER (PARTITION BY recording) - 40) AS db FROM nd) SELECT recording, bin, round(avg(db) + 1.5 * stddev_pop(db), 6) AS threshold FROM nf GROUP BY ALL",
    "amplitude_to_db": f"WITH {_FRAMES}, x AS (SELECT recording, frame, bin, {_db('mag', 0.5, 1e-4)} AS db FROM cells) SELECT recording, frame, bin, round(greatest(db, max(db) OVER (PARTITION BY recording) - 40), 6) AS value FROM x",
    "db_to_amplitude": f"WITH {_FRAMES} SELECT recording, frame, bin, round(2 * pow(10, mag / 20), 6) AS value FROM cells",
    "display_range": f"WITH {_FRAMES} SELECT recording, round(pow(10, quantile_cont(log10(mag), 0.01) FILTER (mag > 0)), 6) AS low, round(max(mag), 6) AS high FROM cells GROUP BY recording",
    "clip_spectrogram": f"WITH {_FRAMES}, {_CLIP} SELECT c.recording, frame - t_lo AS frame, bin - f_lo AS bin, round(mag, 6) AS value FROM cells c JOIN cm USING (recording) WHERE frame >= t_lo AND frame < t_hi AND bin >= f_lo AND bin < ceil(40000.0::DOUBLE / {_EFS})",
    "clipped_meta": f"""WITH {_FRAMES}, {_CLIP}, g AS (SELECT recording, 64 - f_lo AS height, least(t_hi, n) - t_lo AS width, t_lo, f_lo FROM cm)
SELECT recording, height, width, round(t_lo * 0.001024::DOUBLE, 6) AS t_first, round((t_lo + width - 1) * 0.001024::DOUBLE, 6) AS t_last, f_lo * 1000.0::DOUBLE AS f_first, (f_lo + height - 1) * 1000.0::DOUBLE AS f_last, round(0.001024::DOUBLE * (width - 1) / width, 6) AS t_pixel, round(1000.0::DOUBLE * (height - 1) / height, 6) AS f_pixel FROM g""",
    "spec_and_boxes_clip": f"""WITH {_FRAMES}, {_CLIP}, g AS (SELECT recording, n, t_lo * 0.001024::DOUBLE AS c0, (least(t_hi, n) - 1) * 0.001024::DOUBLE AS c1, f_lo * 1000.0::DOUBLE AS g0, 63000.0::DOUBLE AS g1 FROM cm),
p AS (SELECT recording, ceil(c0 / {_EDT})::BIGINT AS tl, ceil(c1 / {_EDT})::BIGINT AS th, ceil(g0 / {_EFS})::BIGINT AS fl, ceil(g1 / {_EFS})::BIGINT AS fh FROM g),
b AS (SELECT recording, frame AS box_id, frame % 40 AS fs, frame % 40 + 6 AS fe, frame AS ts, frame + 4 AS te FROM frames)
SELECT recording, box_id, least(greatest(fs, fl), fh) - fl AS freq_start, least(greatest(fe, fl), fh) - fl AS freq_end, least(greatest(ts, tl), th) - tl AS t_start, least(greatest(te, tl), th) - tl AS t_end FROM b JOIN p USING (recording) WHERE te > tl AND ts < th AND fe > fl AND fs < fh""",
    "pixels": f"WITH {_FRAMES} SELECT recording, ceil(0.0205::DOUBLE / {_EDT})::BIGINT AS t_px, ceil(18000.0::DOUBLE / {_EFS})::BIGINT AS f_px FROM sizes",
    "preprocess_spectrogram": f"WITH {_FRAMES} SELECT recording, frame, bin - 18 AS bin, round(pow(ln(CASE WHEN mag = 0 THEN 1e-8 ELSE mag END) / ln(10.0::DOUBLE), 2), 6) AS value FROM cells WHERE bin >= 18",
    "sliding_chunks": f"WITH {_FRAMES}, st AS (SELECT recording, unnest(range(0, n - 12, 9)) AS first FROM sizes WHERE n > 12) SELECT s.recording, first // 9 AS chunk_id, first, frame, bin, round(mag, 6) AS value FROM st s JOIN cells c ON c.recording = s.recording AND c.frame BETWEEN first AND first + 11",
    "stft": f"WITH {_SIGNAL}, {_stft(16, 16, 8, 1)}",
    "stft_short_window": f"WITH {_SIGNAL}, {_stft(16, 8, 4, 2)}",
    "signal_slice": f"WITH {_SIGNAL}, cut AS (SELECT recording, x, s - floor(n * 0.25)::BIGINT AS s, floor(n * 0.75)::BIGINT - floor(n * 0.25)::BIGINT AS n FROM sig WHERE s >= floor(n * 0.25) AND s < floor(n * 0.75)), {_stft(16, 16, 8, 1, 'cut')}",
    "gaussian_filter": _filtered(_gauss(1.0, 2.0)),
    "diagonal_filter": _filtered(_gauss(1.0, 2.0, True)),
    "transient_suppression": f"""WITH {_FRAMES}, h AS {_stencil(_gauss(0.3, 1.8))}, v AS {_stencil(_gauss(1.8, 0.3))}, d1 AS {_stencil(_gauss(0.3, 1.8, True))}, d2 AS {_stencil(_gauss(1.8, 0.3, True))}
SELECT c.recording, c.frame, c.bin, round(0.4 * c.mag + 0.6 * (greatest(h.v, d1.v, d2.v) - v.v), 6) AS value FROM cells c JOIN h USING (recording, frame, bin) JOIN v USING (recording, frame, bin) JOIN d1 USING (recording, frame, bin) JOIN d2 USING (recording, frame, bin)""",
    "bilateral_filter": f"""WITH {_FRAMES}, k AS (SELECT c.recording, c.frame, c.bin, x.mag, exp(-(o.q * o.q + o.p * o.p) / 8.0::DOUBLE - (x.mag - c.mag) * (x.mag - c.mag) / 0.02::DOUBLE) AS w
  FROM cells c JOIN sizes s USING (recording), (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(q, p), cells x
  WHERE x.recording = c.recording AND x.frame = CASE WHEN c.frame + o.p < 0 THEN 1 WHEN c.frame + o.p >= s.n THEN s.n - 2 ELSE c.frame + o.p END AND x.bin = CASE WHEN c.bin + o.q < 0 THEN 1 WHEN c.bin + o.q > 63 THEN 62 ELSE c.bin + o.q END)
SELECT recording, frame, bin, round(sum(w * mag) / sum(w), 6) AS value FROM k GROUP BY ALL""",
    "find_bounding_boxes": f"""WITH RECURSIVE {_FRAMES}, m AS (SELECT recording, frame, bin, recording || ':' || (frame * 64 + bin) AS id FROM cells WHERE {_MASK}),
e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON a.recording = b.recording AND abs(a.frame - b.frame) + abs(a.bin - b.bin) = 1), {_closure('m', 'e')},
bb AS (SELECT recording, min(bin) AS freq_start, max(bin) AS freq_end, min(frame) AS t_start, max(frame) AS t_end, count(*) AS n_cells FROM m JOIN roots ON node = id GROUP BY recording, root)
SELECT * FROM bb WHERE t_end > t_start AND freq_end > freq_start""",
    "ones_level_set": f"WITH {_FRAMES} SELECT recording, frame, bin, CASE WHEN frame = 0 OR frame = n - 1 OR bin IN (0, 63) THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM cells JOIN sizes USING (recording)",
    "eroded_level_set": f"""WITH RECURSIVE {_FRAMES}, m AS (SELECT recording, frame, bin, frame = 0 OR frame = n - 1 OR bin IN (0, 63) AS edge FROM cells JOIN sizes USING (recording) WHERE {_MASK} OR frame = 0 OR frame = n - 1 OR bin IN (0, 63)),
o AS (SELECT recording, frame, bin FROM m WHERE edge UNION SELECT m.recording, m.frame, m.bin FROM o JOIN m ON m.recording = o.recording AND abs(m.frame - o.frame) <= 1 AND abs(m.bin - o.bin) <= 1)
SELECT c.recording, c.frame, c.bin, CASE WHEN o.bin IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM cells c LEFT JOIN o USING (recording, frame, bin)""",
    "combine_chunk_predictions": f"WITH {_BOXES}, {_CHUNKS} SELECT * FROM cc",
    "score_batches": f"WITH {_FRAMES}, st AS (SELECT recording, unnest(range(0, n - 12, 9)) AS first FROM sizes WHERE n > 12) SELECT s.recording, first // 9 AS chunk_id, f.frame, round(list_sum(list_transform(mags, lambda x: x * x)) / 64, 6) AS score FROM st s JOIN frames f ON f.recording = s.recording AND f.frame BETWEEN first AND first + 11",
    "latent_to_params": "WITH p AS (SELECT p_partkey, p_partkey % 19 / 10.0::DOUBLE + 0.1::DOUBLE AS l FROM part) SELECT p_partkey, CASE WHEN l > 1 THEN -1 ELSE 1 END::BIGINT AS balloon, round(CASE WHEN l > 1 THEN 2 - l ELSE l END, 6) AS threshold FROM p",
    "config_params": f"WITH {_CONFIGS} SELECT config_id, num_iter, smoothing, round(flood_threshold, 6) AS flood_threshold, round(balloon_latent, 6) AS balloon_latent, sigma, CASE WHEN balloon_latent > 1 THEN -1 ELSE 1 END::BIGINT AS balloon, round(CASE WHEN balloon_latent > 1 THEN 2 - balloon_latent ELSE balloon_latent END, 6) AS threshold FROM cfg",
    "best_config": f"WITH {_CONFIGS}, {_TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, config_id) AS k FROM trials) SELECT recording, config_id, round(score, 6) AS score, sigma FROM r JOIN cfg USING (config_id) WHERE k = 1",
    "trial_log": f"WITH {_CONFIGS}, {_TRIALS} SELECT config_id, recording, round(score, 1) AS score, n_boxes, round(num_iter::DOUBLE, 1) AS num_iter, 0.0::DOUBLE AS smoothing, round(flood_threshold, 1) AS flood_threshold, round(balloon_latent, 1) AS balloon_latent, round(sigma, 1) AS sigma FROM trials JOIN cfg USING (config_id)",
}

_SUM = f"""{_pairs('truth', 'pred', 'tp')}, {_pairs('pred', 'truth', 'pt')},
tpx AS (SELECT a.recording, a.box_id, t, unnest(generate_series(a.freq_start, a.freq_end)) AS f FROM (SELECT *, unnest(generate_series(t_start, t_end)) AS t FROM {{own}}) a),
cpx AS (SELECT recording, a_id, t, unnest(generate_series(b_fs, b_fe)) AS f FROM (SELECT *, unnest(generate_series(b_ts, b_te)) AS t FROM {{pairs}})),
al AS (SELECT box_id AS id, t, f, 1 AS x, 0 AS y FROM tpx WHERE box_id IN (SELECT a_id FROM {{pairs}}) UNION ALL SELECT a_id, t, f, 0, 1 FROM cpx),
u AS (SELECT id, t, f, max(x) AS x, max(y) AS y FROM al GROUP BY ALL),
v AS (SELECT id, sum(x * y)::DOUBLE / count(*) AS value FROM u GROUP BY id)"""
ORACLE["iou_per_target_sum"] = f"WITH {_BOXES}, {_SUM.format(own='truth', pairs='tp')} SELECT t.recording, t.box_id, t.label, (SELECT count(*) FROM tp WHERE a_id = t.box_id) AS n_matches, coalesce(round(v.value, 6), 0) AS value FROM truth t LEFT JOIN v ON v.id = t.box_id"

for _name, _keep in (("noise_spans_with_calls", ""), ("noise_spans_without_calls", "NOT ")):
    ORACLE[_name] = f"""WITH {_BOXES}, s AS (SELECT recording, box_id::VARCHAR AS config_id, ceil(t_start * 60.0::DOUBLE / {_TS}) AS lo, ceil(t_end * 60.0::DOUBLE / {_TS}) AS hi FROM pred0)
SELECT recording, config_id FROM s WHERE {_keep}EXISTS (SELECT 1 FROM truth0 t WHERE t.recording = s.recording AND t.t_end > s.lo AND t.t_start < s.hi)"""

_TRI = {(q, p): (3 - abs(q)) * (2 - abs(p)) for q in range(-2, 3) for p in range(-1, 2)}
_TRI = {k: v / sum(_TRI.values()) for k, v in _TRI.items()}
ORACLE["noise_gate"] = f"""WITH {_FRAMES}, raw AS (SELECT recording, frame, bin, mag, {_db('mag', 1.0, 1e-20)} AS db FROM cells),
nf AS (SELECT recording, bin, greatest(db, max(db) OVER (PARTITION BY recording) - 60) AS db FROM raw WHERE frame < 20),
th AS (SELECT recording, bin, avg(db) + 0.5 * stddev_pop(db) AS th FROM nf GROUP BY ALL),
d AS (SELECT recording, frame, bin, mag, greatest(db, max(db) OVER (PARTITION BY recording) - 60) AS db FROM raw),
k AS (SELECT d.recording, d.frame, d.bin, d.mag, d.db, (d.db < th.th)::INT AS m, min(d.db) OVER (PARTITION BY d.recording) AS low FROM d JOIN th USING (recording, bin)),
s AS (SELECT c.recording, c.frame, c.bin, sum(x.m * w.w) * 0.8 AS m FROM k c, (VALUES {", ".join(f"({q}, {p}, {w!r}::DOUBLE)" for (q, p), w in _TRI.items())}) w(q, p, w), k x WHERE x.recording = c.recording AND x.frame = c.frame + w.p AND x.bin = c.bin + w.q GROUP BY ALL)
SELECT k.recording, k.frame, k.bin, round(pow(10, (k.db * (1 - s.m) + k.low * s.m) / 20) * sign(k.mag), 6) AS value FROM k JOIN s USING (recording, frame, bin)"""

for _name, _what in (("coverage_time", "t"), ("coverage_freq", "f")):
    ORACLE[_name] = f"WITH {_BOXES},{_PIXELS.format(what=_what)} SELECT recording, CASE WHEN sum(p) > 0 THEN round(sum(p * t_)::DOUBLE / sum(p), 6) ELSE 0 END AS a_covered, CASE WHEN sum(t_) > 0 THEN round(sum(p * t_)::DOUBLE / sum(t_), 6) ELSE 0 END AS b_covered FROM own GROUP BY recording"


def _sum_values(own: str, pairs: str) -> str:
    """per_<own>: IoU of each box with the union of all that it meets, from pixel sets."""
    return f"""{own}_x AS (SELECT box_id, t, unnest(generate_series(freq_start, freq_end)) AS f FROM (SELECT *, unnest(generate_series(t_start, t_end)) AS t FROM {own})),
{own}_c AS (SELECT a_id, t, unnest(generate_series(b_fs, b_fe)) AS f FROM (SELECT *, unnest(generate_series(b_ts, b_te)) AS t FROM {pairs})),
{own}_u AS (SELECT id, t, f, max(x) AS x, max(y) AS y FROM (SELECT box_id AS id, t, f, 1 AS x, 0 AS y FROM {own}_x UNION ALL SELECT a_id, t, f, 0, 1 FROM {own}_c) GROUP BY ALL),
{own}_v AS (SELECT id, sum(x * y)::DOUBLE / count(*) AS value FROM {own}_u GROUP BY id),
per_{own} AS (SELECT o.recording, o.box_id, o.label, (SELECT count(*) FROM {pairs} WHERE a_id = o.box_id) AS n_matches, v.value FROM {own} o JOIN {own}_v v ON v.id = o.box_id)"""


ORACLE["metrics_at_thresholds_sum"] = f"WITH {_BOXES}, {_pairs('truth', 'pred', 'tp')}, {_pairs('pred', 'truth', 'pt')}, {_sum_values('truth', 'tp')}, {_sum_values('pred', 'pt')}, {_scores('[0.05, 0.1, 0.2]', 1.0)} SELECT recording, threshold, n_truth, truth_hits, n_pred, pred_hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f_score FROM scores"

ORACLE["merge_predictions_per_label"] = f"""WITH RECURSIVE {_BOXES}, {_CHUNKS},
src AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM cc WHERE label_id IN (1, 2)),
e AS (SELECT a.id AS u, b.id AS v FROM src a JOIN src b ON a.recording = b.recording AND a.label_id = b.label_id AND a.t_start - 2 <= b.t_end AND b.t_start <= a.t_end + 2 AND a.freq_start <= b.freq_end AND b.freq_start <= a.freq_end AND a.id <> b.id),
{_closure('src', 'e')}
SELECT recording, min(freq_start) + 18 AS freq_start, max(freq_end) + 18 AS freq_end, min(t_start) AS t_start, max(t_end) AS t_end, CASE label_id WHEN 1 THEN 'sh' ELSE 'fm' END AS label, round(avg(score), 6) AS score
FROM src JOIN roots ON node = id GROUP BY recording, label_id, root"""

ORACLE["standardize_pad"] = f"""WITH {_FRAMES},
cr AS (SELECT f.recording, f.frame AS box_id, c.bin - f.frame % 50 AS r, c.frame - f.frame AS k, c.mag FROM frames f JOIN cells c ON c.recording = f.recording AND c.frame BETWEEN f.frame AND f.frame + 4 AND c.bin BETWEEN f.frame % 50 AND f.frame % 50 + 7),
m AS (SELECT recording, box_id, avg(mag) AS m, stddev_pop(mag) AS s FROM cr GROUP BY ALL),
w AS (SELECT max(n) AS w FROM (SELECT count(DISTINCT k) AS n FROM cr GROUP BY recording, box_id)),
g AS (SELECT recording, box_id, m, s, greatest(w, 4) AS w, r, unnest(range(0, greatest(w, 4))) AS k FROM (SELECT m.*, w.w, unnest(range(0, 8)) AS r FROM m, w))
SELECT g.recording, g.box_id, 8 AS height, g.w AS width, g.r AS row, g.k AS "column", coalesce(round((c.mag - m) / s, 6), 0) AS value FROM g LEFT JOIN cr c ON c.recording = g.recording AND c.box_id = g.box_id AND c.r = g.r AND c.k = g.k"""

_G = {k: math.exp(-0.5 * k * k) for k in range(-4, 5)}
_G = {k: v / sum(_G.values()) for k, v in _G.items()}
_DOWN = ", ".join(f"{' + '.join(f'{w!r} * mags[least(greatest(bin + {k}, 0), 63) + 1]' for k, w in ((k, v * (k if d else 1)) for k, v in _G.items()))} AS {n}" for n, d in (("g", 0), ("d", 1)))


def _across(column: str, weights: dict[int, float]) -> str:
    """A sum over neighbouring frames; the first and the last one repeat."""
    at = lambda k: f"coalesce(lead({column}, {k}) OVER w, last_value({column}) OVER e)" if k >= 0 else f"coalesce(lag({column}, {-k}) OVER w, first_value({column}) OVER e)"
    return " + ".join(f"{w!r} * {at(k)}" for k, w in weights.items())


_EDGES = f"""{_FRAMES},
v AS (SELECT recording, frame, bin, {_DOWN} FROM (SELECT *, unnest(range(0, 64)) AS bin FROM frames)),
h AS (SELECT recording, frame, bin, {_across('d', _G)} AS y, {_across('g', {k: k * v for k, v in _G.items()})} AS x FROM v
      WINDOW w AS (PARTITION BY recording, bin ORDER BY frame), e AS (PARTITION BY recording, bin ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edges AS MATERIALIZED (SELECT recording, frame, bin, 1 / sqrt(1 + 100 * sqrt(y * y + x * x)) AS g FROM h)"""
ORACLE["inverse_gaussian_gradient"] = f"WITH {_EDGES} SELECT recording, frame, bin, round(g, 6) AS value FROM edges"

_ALONG = "t AS (PARTITION BY recording, bin ORDER BY frame), f AS (PARTITION BY recording, frame ORDER BY bin)"
_FLOOD = """m AS (SELECT recording, frame, bin, frame = 0 OR frame = n - 1 OR bin IN (0, 63) AS edge FROM {0} JOIN sizes USING (recording) WHERE {1} OR frame = 0 OR frame = n - 1 OR bin IN (0, 63)),
o AS (SELECT recording, frame, bin FROM m WHERE edge UNION SELECT m.recording, m.frame, m.bin FROM o JOIN m ON m.recording = o.recording AND abs(m.frame - o.frame) <= 1 AND abs(m.bin - o.bin) <= 1)"""


def _slope(x: str, w: str) -> str:
    """Central differences, one-sided at the ends."""
    return f"CASE WHEN lag({x}) OVER {w} IS NULL THEN lead({x}) OVER {w} - {x} WHEN lead({x}) OVER {w} IS NULL THEN {x} - lag({x}) OVER {w} ELSE (lead({x}) OVER {w} - lag({x}) OVER {w}) / 2.0 END"


def _contour(steps: int, threshold: float, balloon: int) -> str:
    """The contour from ``u0`` (recording, frame, bin, u) over ``edges``, step by step."""
    best = "greatest" if balloon > 0 else "least"
    near = lambda x, w: f"{best}({x}, coalesce(lag({x}) OVER {w}, 0), coalesce(lead({x}) OVER {w}, 0))"
    out = [f"s AS MATERIALIZED (SELECT *, {_slope('g', 't')} AS gt, {_slope('g', 'f')} AS gf FROM edges WINDOW {_ALONG})"]
    for k in range(steps):
        out.append(f"""a{k} AS (SELECT *, {near('u', 't')} AS wide FROM u{k} WINDOW {_ALONG}),
b{k} AS (SELECT *, {near('wide', 'f')} AS moved FROM a{k} WINDOW {_ALONG}),
c{k} AS (SELECT recording, frame, bin, gt, gf, CASE WHEN g > {threshold / abs(balloon)!r}::DOUBLE THEN moved ELSE u END::DOUBLE AS u FROM b{k} JOIN s USING (recording, frame, bin)),
d{k} AS (SELECT *, gf * ({_slope('u', 'f')}) + gt * ({_slope('u', 't')}) AS pull FROM c{k} WINDOW {_ALONG}),
u{k + 1} AS MATERIALIZED (SELECT recording, frame, bin, CASE WHEN pull > 0 THEN 1 WHEN pull < 0 THEN 0 ELSE u END::DOUBLE AS u FROM d{k})""")
    return ",\n".join(out) + f" SELECT recording, frame, bin, u AS value FROM u{steps}"


_ONES = "u0 AS (SELECT recording, frame, bin, CASE WHEN frame = 0 OR frame = n - 1 OR bin IN (0, 63) THEN 0.0 ELSE 1.0 END::DOUBLE AS u FROM edges JOIN sizes USING (recording))"
_ERODED = "u0 AS (SELECT c.recording, c.frame, c.bin, CASE WHEN o.bin IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS u FROM edges c LEFT JOIN o USING (recording, frame, bin))"
ORACLE["contour_ones"] = f"WITH {_EDGES}, {_ONES}, {_contour(5, 0.3, -1)}"
ORACLE["contour_eroded"] = f"WITH RECURSIVE {_EDGES}, {_FLOOD.format('edges', 'g > 0.45')}, {_ERODED}, {_contour(3, 0.3, 1)}"

ORACLE["standardize_in_batches"] = f"""WITH {_FRAMES},
b AS (SELECT recording, frame AS box_id, frame % 50 AS f, 1 + frame % 3 + CASE WHEN frame % 29 = 0 THEN 40 ELSE 0 END AS len FROM frames),
cr AS (SELECT b.recording, b.box_id, (length(bin(len * len)) - 1) || '-6-0' AS batch, c.bin - f AS r, c.frame - b.box_id AS k, c.mag FROM b JOIN cells c ON c.recording = b.recording AND c.frame BETWEEN b.box_id AND b.box_id + len - 1 AND c.bin BETWEEN f AND f + 7),
m AS (SELECT recording, box_id, batch, avg(mag) AS m, stddev_pop(mag) AS s FROM cr GROUP BY ALL),
w AS (SELECT batch, max(n) AS w FROM (SELECT batch, count(DISTINCT k) AS n FROM cr GROUP BY recording, box_id, batch) GROUP BY batch),
g AS (SELECT recording, box_id, batch, m, s, w, r, unnest(range(0, w)) AS k FROM (SELECT m.*, w.w, unnest(range(0, 8)) AS r FROM m JOIN w USING (batch)))
SELECT g.recording, g.box_id, g.batch, 8 AS height, g.w AS width, g.r AS row, g.k AS "column", coalesce(round((c.mag - m) / s, 6), 0) AS value FROM g LEFT JOIN cr c ON c.recording = g.recording AND c.box_id = g.box_id AND c.r = g.r AND c.k = g.k"""


def _unit(*columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(columns)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


ORACLE["choose_noise_span"] = f"""WITH {_FRAMES}, {_LOUD},
b AS (SELECT recording, arg_min((span_start, span_end), (-ln(1 - {_unit("'1'", 'recording', 'span_start', 'span_end')}) / weight, span_start)) AS s FROM wt WHERE weight > 0 GROUP BY recording),
r AS (SELECT recording, ceil(3 * 0.001024::DOUBLE / {_EDT})::BIGINT AS least, coalesce(b.s[1], 0) AS a, coalesce(b.s[2], n - 1) AS z, b.s IS NULL AS fallback FROM sizes LEFT JOIN b USING (recording)),
c AS (SELECT *, z - a - least AS room, CASE WHEN z - a - least > 0 THEN a + floor({_unit("'1'", 'recording', "'place'")} * (z - a - least + 1))::BIGINT ELSE a END AS span_start FROM r)
SELECT recording, span_start, CASE WHEN room > 0 THEN span_start + least ELSE z END AS span_end, fallback FROM c"""

#: The searched ranges.
_SPACE = {"num_iter": (1.0, 40.0), "smoothing": (0.0, 7.99), "flood_threshold": (0.1, 0.99), "balloon_latent": (0.2, 1.8), "sigma": (1.0, 10.0)}
_DRAWS = ", ".join(f"round({lo!r}::DOUBLE + {_unit(chr(39) + '3' + chr(39), chr(39) + k + chr(39), 'id')} * {hi - lo!r}::DOUBLE, 6) AS {k}" for k, (lo, hi) in _SPACE.items())
ORACLE["sample_configs"] = f"WITH n AS (SELECT unnest(range(0, count(*))) AS id FROM part) SELECT id::VARCHAR AS config_id, {_DRAWS} FROM n"

ORACLE["read_annotations"] = f"WITH {_ANN} SELECT 'folder=' || folder AS folder, box_id AS selection, begin_file, begin_time, end_time, low_freq, high_freq, usv_type FROM ann"
ORACLE["read_recordings"] = """WITH e AS (SELECT user_id, least(floor(value), 127) / 128.0::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT (user_id % 5) || '/' || user_id || '.wav' AS recording, user_id || '.wav' AS name, 16 AS sample_rate, n AS n_samples, n / 16.0::DOUBLE AS duration, sample // 16 AS chunk_id, sample, value FROM e"""
ORACLE["read_noise_spans"] = f"WITH {_BOXES} SELECT recording, box_id::VARCHAR AS config_id, t_start * 60.0::DOUBLE AS start, t_end * 60.0::DOUBLE AS \"end\" FROM pred0"
ORACLE["read_detections"] = f"WITH {_BOXES} SELECT recording, 'c' AS config_id, box_id, label, score, round(t_start * 60.0::DOUBLE, 6) AS time_start, round(t_end * 60.0::DOUBLE, 6) AS time_end, round(freq_start * 1000.0::DOUBLE, 6) AS freq_start, round(freq_end * 1000.0::DOUBLE, 6) AS freq_end FROM pred0"
ORACLE["write_metrics"] = f"WITH {_TRIALS} SELECT recording, config_id, round(score, 6) AS score, n_boxes FROM trials"

ORACLE["evaluate_detectors"] = f"""WITH {_BOXES}, {_MODEL_SCORES},
mx AS (SELECT model, recording, t, unnest(generate_series(freq_start, freq_end)) AS f, 1 AS p, 0 AS y FROM (SELECT *, unnest(generate_series(t_start, t_end)) AS t FROM mp)),
tx AS (SELECT recording, t, unnest(generate_series(freq_start, freq_end)) AS f FROM (SELECT *, unnest(generate_series(t_start, t_end)) AS t FROM truth)),
al AS (SELECT model, recording, t, f, max(p) AS p, max(y) AS y FROM (SELECT * FROM mx UNION ALL SELECT e.model, x.recording, x.t, x.f, 0, 1 FROM tx x JOIN every e USING (recording)) GROUP BY ALL),
io AS (SELECT model, recording, sum(p * y)::DOUBLE / count(*) AS v FROM al GROUP BY ALL),
v AS (SELECT model, 'precision@0.1' AS metric, p AS v FROM ms UNION ALL SELECT model, 'recall@0.1', r FROM ms UNION ALL SELECT model, 'f_score@0.1', CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END FROM ms UNION ALL SELECT model, 'iou', v FROM io)
SELECT model, metric, round(sum(v) / (SELECT count(*) FROM recs) * 100, 6) AS value FROM v GROUP BY ALL"""
