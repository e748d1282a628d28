"""Cost model: fixed, energy and per-task costs, break-even, sensitivity, ledger audits."""

from __future__ import annotations

from ..operators import aggregates  # noqa: F401
from ..sql import relation

INF = "CAST('Infinity' AS DOUBLE)"
#: Watts of a local model: its probe's where measuring is on and the probe was measured, else as configured.
relation("power_for", """
SELECT m.model_id, CASE WHEN h.mode = 'measured' AND p.mode = 'measured' AND p.incremental_w IS NOT NULL THEN p.incremental_w ELSE h.load_w END AS watts, CASE WHEN h.mode = 'measured' AND p.mode = 'measured' AND p.incremental_w IS NOT NULL THEN p.idle_w ELSE h.idle_w END AS idle_watts,
  CASE WHEN h.mode = 'measured' AND p.mode = 'measured' AND p.incremental_w IS NOT NULL THEN 'measured' ELSE 'configured' END AS watts_label FROM models m CROSS JOIN hardware h LEFT JOIN power_probes p ON p.model_id = m.model_id WHERE m.kind = 'local'
""")
relation("fixed_cost", "SELECT price * allocation / (12 * years) + idle_w * 24 * 30 / 1000 * kwh * allocation + ops AS fixed_usd FROM hardware")
#: Tasks an hour by model and task: with one call at a time on test, else on calib; with several on test. Zero is not measured.
relation("local_tph", """
SELECT model_id, task, coalesce(nullif(max(CASE WHEN pass = 'A' AND split = 'test' THEN tph END), 0), nullif(max(CASE WHEN pass = 'A' AND split = 'calib' THEN tph END), 0)) AS c1, nullif(max(CASE WHEN pass = 'B' AND split = 'test' THEN tph END), 0) AS c4
FROM (SELECT model_id, task, split, pass, CASE WHEN sum(wall_s) > 0 THEN sum(n) / sum(wall_s) * 3600 ELSE 0e0 END AS tph FROM segments WHERE kind = 'local' GROUP BY model_id, task, split, pass) s GROUP BY model_id, task
""")
relation("local_rates", """
SELECT t.model_id, t.task, t.c1, t.c4, CASE WHEN s.throttle > 0 THEN least(1e0, s.throttle) ELSE 1e0 END AS throttle, CASE WHEN s.throttle > 1 THEN 'soak, capped at 1' WHEN s.throttle > 0 THEN 'soak' ELSE 'no soak, taken as 1' END AS throttle_source,
  coalesce(t.c4, t.c1) * CASE WHEN s.throttle > 0 THEN least(1e0, s.throttle) ELSE 1e0 END AS sustained, CASE WHEN t.c4 IS NOT NULL THEN 'several at a time' WHEN t.c1 IS NOT NULL THEN 'one at a time' ELSE 'not measured' END AS throughput_source FROM local_tph t LEFT JOIN soaks s ON s.model_id = t.model_id
""")
relation("local_costs", f"""
SELECT x.*, CASE WHEN monthly > 0 THEN fixed_usd / monthly + energy_usd ELSE {INF} END AS usd FROM (
SELECT l.model_id, l.task, l.c1, l.c4, l.throttle, l.throttle_source, l.sustained, l.throughput_source, p.watts, p.idle_watts, p.watts_label, h.price * h.allocation / (12 * h.years) + p.idle_watts * 24 * 30 / 1000 * h.kwh * h.allocation + h.ops AS fixed_usd,
  CASE WHEN l.sustained > 0 THEN p.watts / (l.sustained / 3600) / 3.6e6 * h.kwh ELSE {INF} END AS energy_usd, coalesce(l.sustained, 0e0) * h.hours * 30 AS capacity, r.monthly
FROM local_rates l JOIN power_for p ON p.model_id = l.model_id CROSS JOIN hardware h JOIN route r ON r.task = l.task) x
""")
#: Quality, speed and price of each model on each task and split. Summaries are rated by the corrected pass rate where a judge was asked.
relation("candidates", """
SELECT m.model_id, m.kind, d.provider, d.role, d.pos, m.task, m.split, m.n, CASE WHEN m.judged THEN CASE WHEN j.tpr + j.tnr > 1 THEN least(1e0, greatest(0e0, (m.score + j.tnr - 1) / (j.tpr + j.tnr - 1))) END ELSE m.score END AS score, m.judged, m.invalid_rate, m.within_rate, m.p50_s, m.p95_s,
  CASE m.kind WHEN 'local' THEN l.usd WHEN 'cloud' THEN m.usd ELSE 0e0 END AS usd
FROM metrics m JOIN models d ON d.model_id = m.model_id CROSS JOIN judge_rates j LEFT JOIN local_costs l ON l.model_id = m.model_id AND l.task = m.task
""")
relation("task_universe", "SELECT task FROM mix UNION SELECT task FROM candidates")
relation("bars", """
SELECT r.task, b.best, CASE WHEN r.absolute_bar IS NOT NULL THEN r.absolute_bar ELSE r.relative_bar * b.best END AS bar FROM route r LEFT JOIN (SELECT task, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS best FROM candidates WHERE split = 'calib' GROUP BY task) b ON b.task = r.task
""")
relation("cheapest_cloud", f"""
SELECT task, model_id, CASE WHEN usd < {INF} THEN usd END AS usd, score FROM (SELECT c.task, c.model_id, t.usd, t.score, row_number() OVER (PARTITION BY c.task ORDER BY coalesce(t.usd, {INF}), c.model_id) AS rn
FROM candidates c JOIN bars b ON b.task = c.task LEFT JOIN candidates t ON t.model_id = c.model_id AND t.task = c.task AND t.split = 'test' WHERE c.split = 'calib' AND c.kind = 'cloud' AND NOT isnan(c.score) AND c.score >= b.bar) x WHERE rn = 1
""")
relation("best_local", """
SELECT task, model_id, score, usd FROM (SELECT task, model_id, score, usd, row_number() OVER (PARTITION BY task ORDER BY score DESC, model_id) AS rn FROM candidates WHERE kind = 'local' AND split = 'calib' AND score IS NOT NULL) x WHERE rn = 1
""")
relation("best_broad", """
SELECT task, model_id, kind, score FROM (SELECT task, model_id, kind, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, model_id) AS rn FROM candidates WHERE kind IN ('local', 'baseline') AND split = 'calib' AND score IS NOT NULL) x WHERE rn = 1
""")
relation("break_even", """
SELECT b.task, b.model_id, c.model_id AS cloud, c.usd AS cloud_usd, l.energy_usd, l.capacity, l.monthly, l.idle_watts, b.score >= q.bar AS meets, CASE WHEN c.usd - l.energy_usd > 0 THEN l.fixed_usd / (c.usd - l.energy_usd) END AS volume,
  CASE WHEN c.usd IS NULL THEN 'no-cloud' WHEN NOT coalesce(b.score >= q.bar, FALSE) THEN 'local-below-bar' WHEN c.usd - l.energy_usd <= 0 THEN 'never' WHEN l.fixed_usd / (c.usd - l.energy_usd) > l.capacity THEN 'infeasible' ELSE 'break-even' END AS verdict
FROM best_local b JOIN local_costs l ON l.model_id = b.model_id AND l.task = b.task JOIN bars q ON q.task = b.task LEFT JOIN cheapest_cloud c ON c.task = b.task
""")
#: The task with the largest weight among those where a local model meets the bar, the first by name of equals.
relation("headline", """
SELECT coalesce(min_by(task, place), 'classification') AS task, count(*) > 0 AS any_met FROM (SELECT r.task, row_number() OVER (ORDER BY r.weight DESC, r.task) AS place FROM best_broad b JOIN bars q ON q.task = b.task JOIN route r ON r.task = b.task WHERE b.score >= q.bar) x
""")
relation("sensitivity", """
SELECT e.task, y.years, x.mult, (h.price * h.allocation / (12 * y.years) + e.idle_watts * 24 * 30 / 1000 * h.kwh * h.allocation + h.ops) AS fixed_usd, e.cloud_usd * x.mult - e.energy_usd AS margin, e.capacity, e.monthly, e.meets
FROM headline k JOIN break_even e ON e.task = k.task CROSS JOIN hardware h CROSS JOIN (SELECT * FROM (VALUES (2e0), (3e0), (5e0)) AS t(years)) y CROSS JOIN (SELECT * FROM (VALUES (0.5e0), (1e0), (2e0)) AS t(mult)) x WHERE e.cloud_usd IS NOT NULL
""")
#: Spend before each entry, in two levels: by day, and within a day, so that a command's history is no single task.
relation("running_ledger", """
SELECT l.command, l.seq, l.actual_usd, l.reserved_usd, d.before + l.own AS spent FROM (SELECT command, seq, ts, actual_usd, reserved_usd, sum(actual_usd) OVER (PARTITION BY command, ts ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM ledger_v) l
JOIN (SELECT command, ts, sum(usd) OVER (PARTITION BY command ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - usd AS before FROM (SELECT command, ts, sum(actual_usd) AS usd FROM ledger_v GROUP BY command, ts) x) d ON d.command = l.command AND d.ts = l.ts
""")
relation("shared", f"""
SELECT l.model_id, l.task, m.utilisation, m.machines, CASE WHEN m.volume > 0 THEN m.machines * l.fixed_usd / m.volume + l.energy_usd ELSE 0e0 END AS usd FROM local_costs l JOIN (SELECT model_id, sum(CASE WHEN capacity > 0 THEN monthly / capacity ELSE 0e0 END) AS utilisation,
  greatest(1, CAST(ceil(sum(CASE WHEN capacity > 0 THEN monthly / capacity ELSE 0e0 END)) AS BIGINT)) AS machines, sum(monthly) AS volume FROM local_costs GROUP BY model_id) m ON m.model_id = l.model_id
""")

QUERIES = {
    "fixed_usd_per_month": "SELECT c.model_id, round(f.fixed_usd, 6) AS fixed_usd, c.n AS calls, round(f.fixed_usd / c.n, 9) AS per_recorded_call FROM (SELECT model_id, count(*) AS n FROM calls WHERE kind = 'local' GROUP BY model_id) c CROSS JOIN fixed_cost f",
    "power_for": "SELECT p.model_id, p.watts, p.idle_watts, p.watts_label, c.n AS calls FROM power_for p JOIN (SELECT model_id, count(*) AS n FROM calls GROUP BY model_id) c ON c.model_id = p.model_id",
    "energy_usd_per_task": f"SELECT e.event_id, CASE WHEN e.value <= 10 THEN {INF} ELSE h.load_w / (e.value / 3600) / 3.6e6 * h.kwh END AS energy_usd FROM events e CROSS JOIN hardware h",
    "local_usd_per_task": f"SELECT s.s_suppkey, CASE WHEN s.s_acctbal <= 0 THEN {INF} ELSE f.fixed_usd / s.s_acctbal + 1e-5 END AS usd FROM supplier s CROSS JOIN fixed_cost f",
    "local_costs": "SELECT model_id, task, round(c1, 4) AS c1, round(c4, 4) AS c4, throttle, throttle_source, throughput_source, watts_label, round(sustained, 4) AS sustained, round(capacity, 2) AS capacity, round(usd, 9) AS usd FROM local_costs",
    "machines_needed": "SELECT model_id, task, CASE WHEN capacity <= 0 THEN NULL ELSE CAST(ceil(monthly * 40 / capacity) AS BIGINT) END AS machines FROM local_costs",
    "break_even": "SELECT task, model_id, cloud, round(volume, 2) AS volume, verdict FROM break_even",
    "break_even_table": "SELECT task, model_id, verdict, round(cloud_usd, 9) AS cloud_usd, round(energy_usd, 12) AS energy_usd, round(capacity, 2) AS capacity, volume <= monthly AS within_volume FROM break_even",
    "shared_machine": "SELECT model_id, task, round(utilisation, 9) AS utilisation, machines, round(usd, 9) AS usd FROM shared",
    "sensitivity_grid": """
SELECT task, years, mult, round(CASE WHEN margin > 0 THEN fixed_usd / margin END, 4) AS volume, CASE WHEN NOT coalesce(meets, FALSE) THEN 'local-below-bar' WHEN margin <= 0 THEN 'never' WHEN fixed_usd / margin > capacity THEN 'infeasible' ELSE 'break-even' END AS verdict, margin > 0 AND fixed_usd / CASE WHEN margin > 0 THEN margin ELSE 1e0 END <= monthly AS within_volume FROM sensitivity""",
    "sensitivity_note": """
SELECT k.task, CASE WHEN h.price IS NULL THEN 'no hardware, so the fixed cost cannot vary' WHEN e.task IS NULL THEN 'no break-even row for the headline task' WHEN e.cloud_usd IS NULL THEN 'no cloud model meets the bar' WHEN e.energy_usd = CAST('Infinity' AS DOUBLE) THEN 'no local throughput was measured' ELSE 'shown' END AS note FROM headline k CROSS JOIN hardware h LEFT JOIN break_even e ON e.task = k.task""",
    "reservation_usd": "SELECT c.seq, round(((ceil(c.prompt_tokens * 4 / 3e0) + 8) * coalesce(m.prompt_price, 0e0) + (o.cap + 64) * coalesce(m.completion_price, 0e0)) * 1.2e0, 12) AS reserved FROM calls c JOIN models m ON c.model_id = m.model_id JOIN output_caps o ON o.task = c.task",
    "settled_cost": "SELECT c.seq, round(coalesce(CASE WHEN c.k % 4 = 0 THEN NULL ELSE c.cost_usd END, c.prompt_tokens * m.prompt_price + c.completion_tokens * m.completion_price), 12) AS usd, CASE WHEN c.k % 4 = 0 THEN 'tokens x snapshot' ELSE 'usage.cost' END AS source FROM calls c JOIN models m ON c.model_id = m.model_id",
    "budget_audit": "SELECT l.command, count(*) AS n, count(*) FILTER (WHERE round(l.spent - l.actual_usd + l.reserved_usd, 6) > least(s.cap_usd, 60e0)) AS refused FROM running_ledger l CROSS JOIN run_settings s GROUP BY l.command",
    "budget_warn_crossing": "SELECT l.command, min_by(l.seq, l.spent) AS first_seq, round(min(l.spent), 4) AS spent FROM running_ledger l CROSS JOIN run_settings s WHERE l.spent >= s.warn_usd AND l.spent - l.actual_usd < s.warn_usd GROUP BY l.command",
    "monthly_volume": "SELECT r.task, r.monthly AS volume, c.n AS recorded FROM route r JOIN (SELECT task, count(*) AS n FROM calls GROUP BY task) c ON c.task = r.task",
    "quality_bar": "SELECT c.model_id, c.task, c.split, round(b.bar, 9) AS bar, coalesce(NOT isnan(c.score) AND c.score >= b.bar, FALSE) AS meets FROM candidates c JOIN bars b ON b.task = c.task",
    "gap_to_bar": "SELECT c.model_id, c.task, c.split, round(CASE WHEN c.score IS NULL OR isnan(c.score) THEN NULL ELSE greatest(0e0, b.bar - c.score) END, 9) AS gap FROM candidates c JOIN bars b ON b.task = c.task",
    "latency_cap": "SELECT r.task, r.cap_s, c.late FROM route r JOIN (SELECT c.task, count(*) FILTER (WHERE c.latency_s > t.cap_s) AS late FROM calls c JOIN route t ON t.task = c.task GROUP BY c.task) c ON c.task = r.task",
    "bar_config": "SELECT r.task, r.relative_bar, r.absolute_bar, c.models FROM route r JOIN (SELECT task, count(DISTINCT model_id) AS models FROM calls GROUP BY task) c ON c.task = r.task",
    "task_universe": "SELECT u.task, m.weight, c.n FROM task_universe u LEFT JOIN mix m ON m.task = u.task LEFT JOIN (SELECT task, count(*) AS n FROM candidates GROUP BY task) c ON c.task = u.task",
    "candidate_table": "SELECT model_id, kind, provider, task, split, n, score, judged, invalid_rate, within_rate, p50_s, p95_s, round(usd, 9) AS usd FROM candidates",
    "calib_test_drift": """
SELECT c.model_id, c.task, c.score AS calib_score, t.score AS test_score, coalesce(c.score >= b.bar AND NOT coalesce(t.score >= b.bar, FALSE), FALSE) AS drift FROM candidates c LEFT JOIN candidates t ON t.model_id = c.model_id AND t.task = c.task AND t.split = 'test' JOIN bars b ON b.task = c.task WHERE c.split = 'calib'""",
    "results_table": """
SELECT t.task, t.model_id, CASE t.kind WHEN 'local' THEN 0 WHEN 'cloud' THEN 1 WHEN 'baseline' THEN 2 ELSE 3 END AS kind_order, t.score, round(t.usd * 1000, 6) AS usd_per_1k, round(CASE WHEN t.kind = 'baseline' THEN greatest(1e-4, t.usd * 1000) ELSE t.usd * 1000 END, 6) AS chart_usd, t.p50_s, t.p95_s, coalesce(c.score >= b.bar, FALSE) AS meets_on_calib, coalesce(c.score >= b.bar, FALSE) AND NOT coalesce(t.score >= b.bar, FALSE) AS drift
FROM candidates t JOIN bars b ON b.task = t.task LEFT JOIN candidates c ON c.model_id = t.model_id AND c.task = t.task AND c.split = 'calib' WHERE t.split = 'test'""",
    "local_perf": "SELECT l.model_id, l.task, round(l.c1, 4) AS c1, round(l.c4, 4) AS c4, round(l.capacity, 2) AS capacity, c.p50_s, c.p95_s FROM local_costs l LEFT JOIN candidates c ON l.model_id = c.model_id AND l.task = c.task AND c.split = 'test'",
    "cheapest_cloud": "SELECT task, model_id, round(usd, 9) AS usd FROM cheapest_cloud",
    "cheapest_single_cloud": "SELECT model_id, CASE WHEN cost < CAST('Infinity' AS DOUBLE) THEN round(cost, 9) END AS cost, met, chosen FROM cloud_totals",
}
#: Of cloud models that meet every mixed task's bar the one with the least weighted price; none if there is no such model.
relation("cloud_totals", """
SELECT model_id, cost, met, met = of_tasks AND row_number() OVER (PARTITION BY met = of_tasks ORDER BY cost, pos) = 1 AS chosen FROM (SELECT x.*, (SELECT count(*) FROM mix) AS of_tasks FROM (SELECT c.model_id, min(c.pos) AS pos, sum(r.weight * coalesce(t.usd, CAST('Infinity' AS DOUBLE))) AS cost, count(*) FILTER (WHERE c.score >= b.bar) AS met FROM candidates c JOIN route r ON r.task = c.task JOIN bars b ON b.task = c.task
  LEFT JOIN candidates t ON t.model_id = c.model_id AND t.task = c.task AND t.split = 'test' WHERE c.split = 'calib' AND c.kind = 'cloud' GROUP BY c.model_id) x) y
""")
relation("single_cloud", "SELECT model_id, cost FROM cloud_totals WHERE chosen")
