"""Metrics, rollups and statistics as aggregates over recorded calls."""

from __future__ import annotations


from ..functions import similarity
from ..sql import computed, either, relation
from .scoring import primary
from .selection import percentiles, weighted_percentiles

_P50_P95 = "percentile(latency_s, 0.5) AS p50_s, percentile(latency_s, 0.95) AS p95_s"
_ENDS = {"p50_s": 0.5, "p95_s": 0.95}


def latency_percentiles(name: str, source: str, keys: str) -> None:
    """Relation of the exact median and 95th percentile of source's latencies by keys, by distributed selection."""
    computed(name, f"SELECT {keys}, {_P50_P95} FROM {source} GROUP BY {keys}", lambda run: percentiles(run(f"SELECT {keys}, latency_s FROM {source}"), keys.split(", "), "latency_s", _ENDS))


relation("first_pass", "SELECT * FROM scored WHERE pass = 'A'")
latency_percentiles("metric_latency", "first_pass", "model_id, kind, task, split")
relation("metrics", f"""
SELECT m.model_id, m.kind, m.task, m.split, m.n, m.score, m.invalid_rate, m.within_rate, m.judged, l.p50_s, l.p95_s, m.usd FROM metric_latency l JOIN (SELECT model_id, kind, task, split, count(*) AS n, {primary()} AS score, avg(CASE WHEN valid AND error IS NULL THEN 0e0 ELSE 1e0 END) AS invalid_rate, CASE WHEN task = 'summarisation' THEN avg(CAST(e AS DOUBLE)) END AS within_rate, task = 'summarisation' AND sum(b) > 0 AS judged, avg(coalesce(cost_usd, 0e0)) AS usd
  FROM first_pass GROUP BY model_id, kind, task, split) m ON m.model_id = l.model_id AND m.kind = l.kind AND m.task = l.task AND m.split = l.split
""")
#: Gold and predicted labels in one column, so that a label counts whichever side it stands on.
relation("label_sides", """
SELECT p.model_id, p.split, i.gold AS label, 1 AS n_gold, 0 AS n_pred, CASE WHEN p.ok AND p.label = i.gold THEN 1 ELSE 0 END AS n_both FROM topic_parsed p JOIN topic_items i ON i.item_id = p.item_id AND i.split = p.split WHERE p.pass = 'A'
UNION ALL SELECT model_id, split, label, 0, 1, 0 FROM topic_parsed WHERE pass = 'A' AND ok
""")
relation("weighted_values", "SELECT task, split, latency_s AS v, CAST(1 + k % 3 AS DOUBLE) AS w FROM calls WHERE kind = 'cloud'")




def weighted_p(source: str, keys: str) -> str:
    """(keys, p, value) of source's values v with weights w: between the row where the weights pass p and the one before."""
    return f"""
SELECT {keys}, p, min_by(CASE WHEN v0 IS NULL OR v0 = v OR p * total > c - w + w / n THEN v ELSE v0 + (v - v0) * (p * total - (c - w)) / (w / n) END, c) AS value
FROM (SELECT {keys}, v, w, n, sum(w) OVER (PARTITION BY {keys} ORDER BY v, each ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(w) OVER (PARTITION BY {keys}) AS total, lag(v) OVER (PARTITION BY {keys} ORDER BY v, each) AS v0
  FROM (SELECT {keys}, v, w AS each, sum(w) AS w, count(*) AS n FROM {source} WHERE w > 0 GROUP BY {keys}, v, w) x) s CROSS JOIN (SELECT * FROM (VALUES (0.5e0), (0.95e0)) AS t(p)) q WHERE total > 0 AND c >= p * total GROUP BY {keys}, p
"""


def weighted(name: str, source: str, keys: str) -> None:
    """That relation, by distributed selection."""
    computed(name, weighted_p(source, keys), lambda run: weighted_percentiles(run(f"SELECT {keys}, v, w FROM {source}"), keys.split(", "), "v", "w", [0.5, 0.95]))


weighted("weighted_p", "weighted_values", "task, split")
latency_percentiles("call_latency", "calls", "model_id, task, split, pass")
latency_percentiles("task_latency", "calls", "task")
computed(
    "event_percentiles",
    "SELECT event_type, percentile(value, 0.5) AS p50, percentile(value, 0.95) AS p95 FROM events GROUP BY event_type",
    lambda run: percentiles(run("SELECT event_type, value FROM events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}),
)
relation("hours", "SELECT CAST(floor(t / 3600) AS BIGINT) AS h, count(*) AS n FROM completions GROUP BY 1")
relation("hour_series", "SELECT g.h, coalesce(c.n, 0) AS n FROM (SELECT explode(sequence(CAST(0 AS BIGINT), last)) AS h FROM (SELECT max(h) AS last FROM hours) e) g LEFT JOIN hours c ON g.h = c.h")
#: Completions by whole minutes since the first one, up to the last one's; a minute without any has zero. Minutes are made day by day.
_MINUTE = either("timestampdiff(MINUTE, (SELECT min(ts) FROM events), ts)", "date_sub('minute', (SELECT min(ts) FROM events), ts)")
relation("minute_counts", f"SELECT minute, count(*) AS n FROM (SELECT {_MINUTE} AS minute FROM events) m GROUP BY minute")
relation("minute_series", """
SELECT g.minute, coalesce(c.n, 0) AS n FROM (SELECT last, day * 1440 + within AS minute FROM (SELECT last, day, explode(sequence(CAST(0 AS BIGINT), CAST(1439 AS BIGINT))) AS within FROM (SELECT last, explode(sequence(CAST(0 AS BIGINT), CAST(floor(last / 1440) AS BIGINT))) AS day FROM (SELECT max(minute) AS last FROM minute_counts) e) d) w) g
LEFT JOIN minute_counts c ON g.minute = c.minute WHERE g.minute <= g.last
""")
relation("judge_rates", """
SELECT avg(CASE WHEN label_pass THEN CASE WHEN predicted_pass THEN 1e0 ELSE 0e0 END END) AS tpr, avg(CASE WHEN NOT label_pass THEN CASE WHEN predicted_pass THEN 0e0 ELSE 1e0 END END) AS tnr FROM judged_holdout
""")
relation("judged_holdout", "SELECT id, label_pass, label_pass = (id % 10 <> 0) AS predicted_pass FROM judged")
relation("pair_scores", "SELECT item_id AS id, gold_match AS match, score FROM pair_similarity WHERE split = 'calib'")
relation("supplier_pairs", f"""
SELECT s.id, s.nation = t.nation AS match, {", ".join(f"s.{f} AS l_{f}, t.{f} AS r_{f}" for f in similarity.WEIGHTS)} FROM company_records s JOIN company_records t ON t.id = s.id + 1
""")
relation("supplier_scores", similarity.scored("supplier_pairs", ["id", "match"]))


def tuning(name: str, source: str) -> None:
    """Relations of source's scores (score, match): F1 by threshold, and the best with the band where both classes lie.

    Thresholds are the distinct scores of six places, 0 and 1; of equal F1 the lowest counts. Without overlap, or with
    one class, the band is the threshold.
    """
    relation(f"{name}_sweep", f"""
SELECT t, CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT t, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER () - sum(pos) OVER up AS fn FROM (SELECT t, sum(pos) AS pos, sum(neg) AS neg FROM (
  SELECT round(score, 6) AS t, CASE WHEN match THEN 1 ELSE 0 END AS pos, CASE WHEN match THEN 0 ELSE 1 END AS neg FROM {source} UNION ALL SELECT 0e0, 0, 0 UNION ALL SELECT 1e0, 0, 0) x GROUP BY t) y WINDOW up AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z
""")
    relation(f"{name}_tuned", f"""
SELECT threshold, f1, CASE WHEN lo <= hi THEN lo ELSE threshold END AS band_low, CASE WHEN lo <= hi THEN hi ELSE threshold END AS band_high FROM (SELECT t AS threshold, f1, row_number() OVER (ORDER BY f1 DESC, t) AS rn FROM {name}_sweep) s
CROSS JOIN (SELECT min(CASE WHEN match THEN score END) AS lo, max(CASE WHEN NOT match THEN score END) AS hi FROM {source}) b WHERE rn = 1
""")


tuning("pair", "pair_scores")
tuning("supplier", "supplier_scores")


def stratified(source: str, n: int) -> str:
    """Proportional allocation of n over source (grp, n), rounded half-even; what is over or short goes round the groups that can take it, largest first."""
    return f"""SELECT grp, n, CAST(base + CASE WHEN able AND rank <= abs(diff) THEN CASE WHEN diff < 0 THEN -1 ELSE 1 END ELSE 0 END AS BIGINT) AS take FROM (SELECT grp, n, base, diff, able, row_number() OVER (PARTITION BY able ORDER BY n DESC, grp) AS rank FROM (
  SELECT grp, n, base, diff, CASE WHEN diff < 0 THEN base > 0 ELSE base < n END AS able FROM (SELECT grp, n, base, CAST({n} - sum(base) OVER () AS BIGINT) AS diff FROM (SELECT grp, n, least(n, CAST(bround({n}e0 * n / sum(n) OVER (), 0) AS BIGINT)) AS base FROM {source}) x) y) z) w"""


relation("event_strata", "SELECT event_type AS grp, count(*) AS n FROM events GROUP BY event_type")
relation("period_slots", """
SELECT task, CAST(base + CASE WHEN rn <= abs(diff) THEN CASE WHEN diff < 0 THEN -1 ELSE 1 END ELSE 0 END AS BIGINT) AS slots, rn FROM (SELECT task, base, row_number() OVER (ORDER BY task) AS rn, CAST(100 - sum(base) OVER () AS BIGINT) AS diff FROM (SELECT task, CAST(bround(100 * weight, 0) AS BIGINT) AS base FROM (SELECT m.task, m.weight / sum(m.weight) OVER () AS weight FROM mix m LEFT SEMI JOIN items i ON i.task = m.task) w) a) b
""")

QUERIES = {
    "agg_macro_f1": """
SELECT model_id, split, round(avg(CASE WHEN g + p = 0 THEN 0e0 ELSE 2e0 * b / (g + p) END), 9) AS macro_f1, count(*) AS labels, sum(b) / CAST(sum(g) AS DOUBLE) AS accuracy FROM (SELECT model_id, split, label, sum(n_gold) AS g, sum(n_pred) AS p, sum(n_both) AS b FROM label_sides GROUP BY model_id, split, label) x GROUP BY model_id, split""",
    "agg_binary_f1": """
SELECT model_id, split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision_, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall_,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT model_id, split, sum(a) AS tp, sum(b) AS fp, sum(c) AS fn FROM scored WHERE task = 'entity_matching' AND pass = 'A' GROUP BY model_id, split) x""",
    "agg_field_accuracy": """
SELECT model_id, split, sum(n_right) / CAST(sum(n_fields) AS DOUBLE) AS field_accuracy, avg(CASE WHEN valid AND n_right = n_fields THEN 1e0 ELSE 0e0 END) AS exact_rate FROM field_scores WHERE pass = 'A' GROUP BY model_id, split""",
    "agg_pii_f2": """
SELECT model_id, split, r AS recall_, p AS precision_, CASE WHEN 4 * p + r = 0 THEN 0e0 ELSE 5 * p * r / (4 * p + r) END AS f2, 1e0 - r AS leak_rate, zero_leak_rate, invalid_rate FROM (SELECT model_id, split, CASE WHEN sum(gold_n) = 0 THEN 1e0 ELSE sum(caught) / CAST(sum(gold_n) AS DOUBLE) END AS r,
  CASE WHEN sum(pred_n) = 0 THEN 0e0 ELSE sum(tp) / CAST(sum(pred_n) AS DOUBLE) END AS p, avg(CASE WHEN zero_leak THEN 1e0 ELSE 0e0 END) AS zero_leak_rate, avg(CASE WHEN valid THEN 0e0 ELSE 1e0 END) AS invalid_rate FROM span_scores WHERE pass = 'A' GROUP BY model_id, split) x""",
    "agg_summary": """
SELECT model_id, split, count(*) AS n, CASE WHEN count(*) FILTER (WHERE judged) > 0 THEN count(*) FILTER (WHERE passed) / CAST(count(*) FILTER (WHERE judged) AS DOUBLE) END AS pass_rate, CASE WHEN sum(n_facts) > 0 THEN sum(n_present) / CAST(sum(n_facts) AS DOUBLE) END AS fact_recall,
  avg(CASE WHEN within_limit THEN 1e0 ELSE 0e0 END) AS within_rate FROM summary_scores WHERE pass = 'A' GROUP BY model_id, split""",
    "summarise_metrics": "SELECT model_id, task, split, n, score, invalid_rate, within_rate FROM metrics",
    "metrics_by_model_task_split": "SELECT model_id, task, split, n, score, p50_s, p95_s FROM metrics",
    "latency_rollup": """
SELECT l.model_id, l.task, l.split, l.pass, l.n, p.p50_s, p.p95_s, l.mean_s, CASE WHEN s.wall_s <= 0 THEN 0e0 ELSE round(s.n / s.wall_s * 3600, 4) END AS tasks_per_hour FROM (SELECT model_id, task, split, pass, count(*) AS n, round(avg(latency_s), 9) AS mean_s
FROM calls GROUP BY model_id, task, split, pass) l JOIN call_latency p ON p.model_id = l.model_id AND p.task = l.task AND p.split = l.split AND p.pass = l.pass JOIN (SELECT model_id, task, split, pass, sum(n) AS n, sum(wall_s) AS wall_s FROM segments GROUP BY model_id, task, split, pass) s ON s.model_id = l.model_id AND s.task = l.task AND s.split = l.split AND s.pass = l.pass""",
    "segment_records": "SELECT model_id, task, split, pass, segment, n, round(wall_s, 6) AS wall_s FROM segments",
    "throughput_segments": "SELECT flag, status, CAST(sum(n) AS BIGINT) AS n, sum(wall_s) AS wall_s, CASE WHEN sum(wall_s) <= 0 THEN 0e0 ELSE sum(n) / sum(wall_s) * 3600 END AS tasks_per_hour FROM throughput GROUP BY flag, status",
    "cloud_usd_per_task": "SELECT model_id, task, round(avg(coalesce(cost_usd, 0e0)), 12) AS usd, count(*) AS calls FROM calls WHERE kind = 'cloud' AND split = 'test' AND pass = 'A' GROUP BY model_id, task",
    "usd_per_task": """
SELECT model_id, task, round(max_by(usd, rank), 12) AS usd FROM (SELECT model_id, task, usd, 0 AS rank FROM local_costs UNION ALL SELECT model_id, task, avg(coalesce(cost_usd, 0e0)), 1 FROM calls WHERE kind = 'cloud' AND split = 'calib' AND pass = 'A' GROUP BY model_id, task
  UNION ALL SELECT DISTINCT model_id, task, 0e0, 2 FROM calls WHERE kind = 'baseline') u GROUP BY model_id, task""",
    "judge_tpr_tnr": "SELECT avg(CASE WHEN label_pass THEN CASE WHEN predicted_pass THEN 1e0 ELSE 0e0 END END) AS tpr, avg(CASE WHEN NOT label_pass THEN CASE WHEN predicted_pass THEN 0e0 ELSE 1e0 END END) AS tnr FROM judged",
    "judge_calibration_metrics": """
SELECT part, n, tpr, tnr, (tpr + tnr) / 2 AS balanced_accuracy, CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1e0 ELSE 0e0 END ELSE (po - pe) / (1 - pe) END AS kappa, invalid_rate FROM (SELECT part, n, CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) END AS tpr, CASE WHEN n > p THEN tn / CAST(n - p AS DOUBLE) END AS tnr,
  (tp + tn) / CAST(n AS DOUBLE) AS po, (CAST(p AS DOUBLE) * q + CAST(n - p AS DOUBLE) * (n - q)) / (CAST(n AS DOUBLE) * n) AS pe, invalid / CAST(n AS DOUBLE) AS invalid_rate
FROM (SELECT part, count(*) AS n, count(*) FILTER (WHERE label_pass) AS p, count(*) FILTER (WHERE predicted_pass) AS q, count(*) FILTER (WHERE label_pass AND predicted_pass) AS tp, count(*) FILTER (WHERE NOT label_pass AND NOT predicted_pass) AS tn, count(*) FILTER (WHERE id % 23 = 0) AS invalid FROM judged GROUP BY part) x) y""",
    "cohen_kappa": """
SELECT model_id, CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1e0 ELSE 0e0 END ELSE (po - pe) / (1 - pe) END AS kappa FROM (SELECT x.model_id, max(x.same) / CAST(max(x.n) AS DOUBLE) AS po, sum(x.a * x.b) / (CAST(max(x.n) AS DOUBLE) * max(x.n)) AS pe FROM (
  SELECT s.model_id, s.label, CAST(sum(s.a) AS DOUBLE) AS a, CAST(sum(s.b) AS DOUBLE) AS b, t.n, t.same FROM (SELECT p.model_id, i.gold AS label, 1 AS a, 0 AS b FROM topic_parsed p JOIN topic_items i ON i.item_id = p.item_id AND i.split = p.split UNION ALL SELECT model_id, coalesce(label, 'none'), 0, 1 FROM topic_parsed) s
  JOIN (SELECT p.model_id, count(*) AS n, count(*) FILTER (WHERE p.label = i.gold) AS same FROM topic_parsed p JOIN topic_items i ON i.item_id = p.item_id AND i.split = p.split GROUP BY p.model_id) t ON t.model_id = s.model_id GROUP BY s.model_id, s.label, t.n, t.same) x GROUP BY x.model_id) y""",
    "balanced_accuracy": "SELECT avg(r) AS balanced_accuracy FROM (SELECT label_pass, avg(CASE WHEN label_pass = predicted_pass THEN 1e0 ELSE 0e0 END) AS r FROM judged GROUP BY label_pass) x",
    "judge_summary": """
SELECT s.model_id, s.split, s.n, s.p AS raw_rate, CASE WHEN r.tpr + r.tnr > 1 THEN least(1e0, greatest(0e0, (s.p + r.tnr - 1) / (r.tpr + r.tnr - 1))) END AS corrected, round(s.fact_recall, 9) AS fact_recall, k.agreement
FROM (SELECT model_id, split, count(*) AS n, avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END) AS p, avg(fact_recall) AS fact_recall FROM judge_passed WHERE judged GROUP BY model_id, split) s CROSS JOIN judge_rates r
LEFT JOIN (SELECT b.model_id, b.split, avg(CASE WHEN b.passes = (f.present AND f.right_one) THEN 1e0 ELSE 0e0 END) AS agreement FROM brief_facts b JOIN facts f ON f.model_id = b.model_id AND f.split = b.split AND f.item_id = b.item_id AND f.ix = b.ix WHERE b.pass = 'A' AND f.has_judge AND f.has_verdict GROUP BY b.model_id, b.split) k ON k.model_id = s.model_id AND k.split = s.split""",
    "call_stats": "SELECT model_id, count(*) AS calls, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (WHERE error LIKE 'http%') AS http_errors, round(sum(cost_usd), 6) AS usd FROM calls GROUP BY model_id",
    "completed_keys": "SELECT DISTINCT model_id, task, split, item_id, coalesce(pass, 'A') AS pass FROM calls",
    "peak_merge": """
SELECT coalesce(o.u, n.u) AS user_id, greatest(o.peak, n.peak) AS peak FROM (SELECT user_id AS u, max(value) AS peak FROM events WHERE event_id % 2 = 0 GROUP BY user_id) o FULL OUTER JOIN (SELECT user_id AS u, max(value) AS peak FROM events WHERE event_id % 2 = 1 GROUP BY user_id) n ON o.u = n.u""",
    "load_contaminated": "SELECT user_id, avg(CASE WHEN value * 10 > 100 THEN 1e0 ELSE 0e0 END) AS share, avg(CASE WHEN value * 10 > 100 THEN 1e0 ELSE 0e0 END) > 0.1e0 AS contaminated FROM events GROUP BY user_id",
    "contaminated_windows": "SELECT count(*) AS windows, count(*) FILTER (WHERE share > 0.1e0) AS flagged FROM (SELECT user_id, avg(CASE WHEN value * 10 > 100 THEN 1e0 ELSE 0e0 END) AS share FROM events GROUP BY user_id) w",
    "power_incremental": """
SELECT user_id, samples, round(load_w - idle_w, 9) AS incremental_watts, round(load_w - idle_w, 9) <= 0 OR round(load_w - idle_w, 9) >= 100 AS out_of_range, charge < 95 AS not_full FROM (SELECT user_id, count(*) AS samples, min(50 + value) AS charge, avg(CASE WHEN event_type = 'view' THEN value END) AS idle_w, avg(CASE WHEN event_type <> 'view' THEN value END) AS load_w FROM events GROUP BY user_id) x""",
    "router_stats": "SELECT c.task, c.n, c.escalations, p.p50_s, p.p95_s, c.cloud_calls, c.local_calls FROM task_latency p JOIN (SELECT task, count(*) AS n, count(*) FILTER (WHERE retries > 0) AS escalations, count(*) FILTER (WHERE kind = 'cloud') AS cloud_calls, count(*) FILTER (WHERE kind = 'local') AS local_calls FROM calls GROUP BY task) c ON c.task = p.task",
    "local_only_cloud_calls": """
SELECT coalesce(CAST(sum(greatest(0, b.n - coalesce(a.n, 0))) AS BIGINT), 0) AS leaked FROM (SELECT c.task, count(*) AS n FROM calls c JOIN route r ON r.task = c.task WHERE r.local_only AND c.kind = 'cloud' GROUP BY c.task) b LEFT JOIN (SELECT c.task, count(*) AS n FROM calls c JOIN route r ON r.task = c.task WHERE r.local_only AND c.kind = 'cloud' AND c.item_id < 60 GROUP BY c.task) a ON a.task = b.task""",
    "downloads_total": "SELECT count(*) AS repos, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(new_bytes) AS BIGINT) AS new_bytes FROM (SELECT p_brand, sum(p_size) * 1000 AS bytes, sum(CASE WHEN p_brand < 'Brand#3' THEN 0 ELSE p_size END) * 1000 AS new_bytes FROM part GROUP BY p_brand) d",
    "combined_memory": "SELECT CAST(sum(peak) AS BIGINT) + 300 AS total_mb FROM (SELECT model_id, max(prompt_tokens * 40) AS peak FROM calls WHERE kind = 'local' GROUP BY model_id) x",
    "token_estimate": "SELECT conv_id, CAST(sum(ceil(length(text) / 3e0) + 8) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "dry_run_cost": """
SELECT c.model_id, count(*) AS calls, CAST(sum(c.prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(o.cap + 64) AS BIGINT) AS output_tokens, round(sum(c.prompt_tokens * m.prompt_price + (o.cap + 64) * m.completion_price), 9) AS usd FROM calls c JOIN models m ON c.model_id = m.model_id JOIN output_caps o ON o.task = c.task WHERE m.kind = 'cloud' GROUP BY ROLLUP (c.model_id)""",
    "spend_block": "SELECT l.command, round(sum(coalesce(l.actual_usd, 0e0)), 4) AS usd, round(100 * sum(coalesce(l.actual_usd, 0e0)) / max(t.total), 6) AS share_pct, max(t.total) > max(s.cap_usd) AS over_cap FROM ledger_v l CROSS JOIN (SELECT sum(actual_usd) AS total FROM ledger_v) t CROSS JOIN run_settings s GROUP BY l.command",
    # statistics
    "rogan_gladen": """
SELECT doc_id, CASE WHEN tpr + tnr - 1 <= 0 THEN NULL ELSE least(1e0, greatest(0e0, (p + tnr - 1) / (tpr + tnr - 1))) END AS corrected FROM (SELECT doc_id, (doc_id % 101) / 100e0 AS p, 0.5e0 + (doc_id % 7) / 14e0 AS tpr, 0.45e0 + (doc_id % 5) / 10e0 AS tnr FROM documents) d""",
    "p50_p95": "SELECT event_type, p50, p95 FROM event_percentiles",
    "weighted_percentile": "SELECT task, split, p, round(value, 9) AS value FROM weighted_p",
    "stratified_allocation": stratified("event_strata", 100),
    "period_allocation": "SELECT task, slots FROM period_slots",
    "period_schedule": "SELECT row_number() OVER (ORDER BY (rn * 7919 + slot * 104729) % 1000003, task, slot) AS place, task FROM (SELECT task, rn, explode(sequence(CAST(1 AS BIGINT), slots)) AS slot FROM period_slots WHERE slots > 0) x",
    "round_robin": "SELECT d.doc_id, (row_number() OVER (PARTITION BY d.source, d.doc_id % 64 ORDER BY d.doc_id) * 64 + d.doc_id % 64) % s.n AS slot FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON s.source = d.source",
    "threshold_tune": "SELECT threshold, round(f1, 9) AS f1, round(band_low, 9) AS band_low, round(band_high, 9) AS band_high FROM pair_tuned",
    "threshold_sweep": "SELECT t, round(f1, 9) AS f1 FROM pair_sweep",
    "fuzzy_decision": "SELECT s.item_id, s.split, s.score >= t.threshold AS match FROM pair_similarity s CROSS JOIN pair_tuned t",
    "fuzzy_similarity": "SELECT id, match, round(score, 6) AS similarity FROM supplier_scores",
    "fuzzy_tuning": "SELECT threshold, round(f1, 9) AS f1, round(band_low, 9) AS band_low, round(band_high, 9) AS band_high FROM supplier_tuned",
    # windows and top-k
    "pareto_frontier": """
SELECT task, model_id, usd, score FROM (SELECT task, model_id, usd, score, max(score) OVER (PARTITION BY task ORDER BY usd, score DESC, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT task, model_id, round(usd, 12) AS usd, score FROM metrics WHERE split = 'test' AND score IS NOT NULL) m) x WHERE best IS NULL OR score > best""",
    "per_minute_tph": "SELECT minute, n, n * 60 AS tph FROM minute_series",
    "soak_throttle": """
SELECT first5, last5, CASE WHEN first5 > 0 THEN last5 / first5 END AS factor FROM (SELECT avg(CASE WHEN h < 5 THEN CAST(n AS DOUBLE) END) AS first5, avg(CASE WHEN h >= full_hours - 5 THEN CAST(n AS DOUBLE) END) AS last5 FROM hour_series CROSS JOIN (SELECT CAST(floor(max(t) / 3600) AS BIGINT) AS full_hours FROM completions) f WHERE h < full_hours) x""",
    "role_model": "SELECT m.role, min_by(m.model_id, m.pos) AS model_id, CAST(sum(s.calls) AS BIGINT) AS calls FROM models m JOIN seen_models s ON s.model_id = m.model_id WHERE m.kind = 'cloud' GROUP BY m.role",
    "best_score": "SELECT task, split, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS best FROM metrics GROUP BY task, split",
    "judge_select": """
SELECT part, n, ba, price FROM (SELECT j.part, j.n, j.ba, p.price, row_number() OVER (ORDER BY j.ba DESC NULLS LAST, p.price, j.part) AS rn FROM (SELECT part, count(*) AS n, round(avg(CASE WHEN label_pass = predicted_pass THEN 1e0 ELSE 0e0 END), 9) AS ba FROM judged GROUP BY part) j JOIN (SELECT pos AS part, coalesce(prompt_price, 0e0) + coalesce(completion_price, 0e0) AS price FROM models) p ON p.part = j.part) y WHERE rn = 1""",
    # incremental
    "stream_tumbling_minute": "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1",
    "stream_router_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events",
    # helpers
    "other_load": "SELECT seq, greatest(0e0, system_pct * cores - own_pct) AS other_cpu, greatest(0e0, used_gb - own_gb) AS other_gb FROM (SELECT event_id AS seq, value / 2 AS system_pct, 4 + event_id % 5 AS cores, value AS own_pct, value / 3 AS used_gb, 4e0 AS own_gb FROM events) s",
    "judge_scores_latest": "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "progress_counts": "SELECT model_id, task, count(*) AS n, round(100e0 * count(*) FILTER (WHERE NOT valid) / count(*), 6) AS invalid_pct FROM scored GROUP BY model_id, task",
    "mix_unknown_tasks": "SELECT task FROM (SELECT task FROM mix UNION ALL SELECT 'translation') m LEFT ANTI JOIN (SELECT DISTINCT task AS t FROM calls) c ON m.task = c.t",
    "display_model": "SELECT m.model_id, CASE WHEN m.kind = 'baseline' THEN m.model_id ELSE coalesce(c.recorded, m.model_id) END AS display FROM models m LEFT JOIN (SELECT model_id, min_by(kind || '/' || model_id, seq) AS recorded FROM calls WHERE k % 5 = 0 GROUP BY model_id) c ON c.model_id = m.model_id",
    "usage_records": "SELECT seq, prompt_tokens, completion_tokens, k % 4 AS reasoning_tokens, 0 AS cached_tokens, model_id AS provider FROM calls WHERE kind = 'cloud'",
    "window_list": "SELECT name, started, contaminated FROM (SELECT 'window ' || user_id AS name, min(ts) AS started, avg(CASE WHEN value * 10 > 100 THEN 1e0 ELSE 0e0 END) > 0.1e0 AS contaminated FROM events GROUP BY user_id UNION ALL SELECT 'window new', max(ts), FALSE FROM events) w",
    "power_text": """
SELECT CASE WHEN h.mode = 'configured' OR p.measured = 0 THEN 'configured: ' || CAST(CAST(h.idle_w AS BIGINT) AS STRING) || ' W idle, ' || CAST(CAST(h.load_w AS BIGINT) AS STRING) || ' W incremental' ELSE 'measured (battery telemetry): ' || CAST(CAST(h.idle_w AS BIGINT) AS STRING) || ' W idle, ' || CAST(CAST(h.load_w AS BIGINT) AS STRING) || ' W incremental' END AS text, p.modes, p.calls
FROM hardware h CROSS JOIN (SELECT count(*) FILTER (WHERE q.mode = 'measured') AS measured, count(DISTINCT q.mode) AS modes, CAST(sum(s.calls) AS BIGINT) AS calls FROM power_probes q JOIN seen_models s ON s.model_id = q.model_id) p""",
    "finite_or_null": "SELECT event_id, CASE WHEN isnan(x) OR abs(x) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE x END AS x FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS x FROM events) e",
    "data_cards": "SELECT lang, source, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lang, source",
    "judge_table": "SELECT model_id, count(*) AS n, avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END) AS pass_rate FROM judge_passed WHERE split = 'test' AND judged GROUP BY model_id",
    "per_minute_counts_filled": "SELECT count(*) AS hours, count(*) FILTER (WHERE n = 0) AS empty_hours FROM hour_series",
}
