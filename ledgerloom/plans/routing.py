"""Planner, offline replay, mixed workload and verdicts.

A plan's chain has at most three positions, so a replay joins each item with them and keeps what comes up to the first
that passes: no loop over positions. Plans are made with the constraints of the settings and without; replays run with
gates and without, on test and, for verdicts, on calib.
"""

from __future__ import annotations

from ..operators.aggregates import latency_percentiles, relation, weighted
from ..operators.scoring import primary
from . import costs, gates  # noqa: F401

relation("plan_modes", "SELECT * FROM (VALUES (TRUE), (FALSE)) AS t(constrained)")
#: Summaries of a task that no judge saw are planned by a proxy.
relation("plan_scores", """
SELECT c.*, CASE WHEN c.task = 'summarisation' AND NOT max(c.judged) OVER (PARTITION BY c.task, c.split) THEN c.within_rate * (1 - c.invalid_rate) ELSE c.score END AS plan_score, c.task = 'summarisation' AND NOT max(c.judged) OVER (PARTITION BY c.task, c.split) AS proxy FROM candidates c
""")
relation("plan_bars", "SELECT r.task, CASE WHEN r.absolute_bar IS NOT NULL THEN r.absolute_bar ELSE r.relative_bar * max(CASE WHEN isnan(p.plan_score) THEN NULL ELSE p.plan_score END) END AS bar FROM route r LEFT JOIN plan_scores p ON p.task = r.task AND p.split = 'calib' GROUP BY r.task, r.absolute_bar, r.relative_bar")
relation("planned", """
SELECT m.constrained, c.task, c.model_id, c.kind, c.provider, c.plan_score AS score, c.usd, c.p95_s, b.bar, c.proxy, r.below_bar_ok, m.constrained AND r.local_only AS stays,
  CASE WHEN m.constrained AND r.local_only AND c.kind = 'cloud' THEN 'cloud_excluded_local_only' WHEN c.plan_score IS NULL OR isnan(c.plan_score) OR c.plan_score < b.bar THEN 'below_bar' WHEN c.p95_s IS NOT NULL AND NOT isnan(c.p95_s) AND c.p95_s > r.cap_s THEN 'latency_p95_exceeds_cap' END AS dropped
FROM plan_scores c JOIN plan_bars b ON b.task = c.task JOIN route r ON r.task = c.task CROSS JOIN plan_modes m WHERE c.split = 'calib'
""")
relation("survivors", """
SELECT *, row_number() OVER (PARTITION BY constrained, task ORDER BY score DESC, by_cost) AS by_quality FROM (SELECT constrained, task, model_id, kind, provider, score, usd, row_number() OVER (PARTITION BY constrained, task ORDER BY CASE WHEN usd IS NULL OR isnan(usd) THEN 1 ELSE 0 END, usd, model_id) AS by_cost FROM planned WHERE dropped IS NULL) x
""")
#: The best local model of a task without survivors that has to stay local, where the settings let it serve.
relation("below_bar", """
SELECT constrained, task, model_id, kind, provider FROM (SELECT p.*, row_number() OVER (PARTITION BY p.constrained, p.task ORDER BY p.score DESC, p.model_id) AS rn FROM planned p LEFT ANTI JOIN survivors s ON s.constrained = p.constrained AND s.task = p.task WHERE p.stays AND p.below_bar_ok AND p.kind <> 'cloud' AND p.score IS NOT NULL) x WHERE rn = 1
""")
relation("fallback", """
SELECT s.constrained, s.task, min_by(s.model_id, s.by_cost) AS model_id FROM survivors s JOIN survivors p ON p.constrained = s.constrained AND p.task = s.task AND p.by_cost = 1 AND p.provider <> s.provider GROUP BY s.constrained, s.task
""")
relation("chain", """
SELECT y.constrained, y.task, y.model_id, m.kind, row_number() OVER (PARTITION BY y.constrained, y.task ORDER BY y.pos) AS pos, y.best, y.below FROM (SELECT constrained, task, model_id, min(pos) AS pos, max(best) AS best, max(below) AS below FROM (SELECT constrained, task, model_id, 1 AS pos, 0 AS best, 0 AS below FROM survivors WHERE by_cost = 1
 UNION ALL SELECT constrained, task, model_id, 2, 0, 0 FROM fallback UNION ALL SELECT constrained, task, model_id, 3, 1, 0 FROM survivors WHERE by_quality = 1 UNION ALL SELECT constrained, task, model_id, 1, 1, 1 FROM below_bar) x GROUP BY constrained, task, model_id) y JOIN models m ON m.model_id = y.model_id
""")
relation("replay_modes", """
SELECT * FROM (VALUES ('router (no gates, no constraints)', FALSE, FALSE, 'test'), ('router (gates, no constraints)', FALSE, TRUE, 'test'), ('router (gates, constraints)', TRUE, TRUE, 'test'), ('router (gates, constraints)', TRUE, TRUE, 'calib')) AS t(row_name, constrained, gated, split)
""")
relation("attempts", """
SELECT m.row_name, i.split, i.task, i.item_id, h.pos, h.model_id, h.kind, h.best, m.constrained AND r.local_only AS stays, s.seq IS NOT NULL AS called, coalesce(s.latency_s, 0e0) AS latency_s, CASE WHEN h.kind = 'cloud' THEN coalesce(s.cost_usd, 0e0) ELSE 0e0 END AS cost_usd,
  coalesce(s.valid AND s.error IS NULL, FALSE) AS usable, coalesce(s.valid AND s.error IS NULL AND (NOT m.gated OR g.passed), FALSE) AS passes, s.a, s.b, s.c, s.d, s.e
FROM replay_modes m JOIN items i ON i.split = m.split JOIN chain h ON h.constrained = m.constrained AND h.task = i.task JOIN route r ON r.task = i.task LEFT JOIN scored s ON s.task = i.task AND s.split = i.split AND s.item_id = i.item_id AND s.model_id = h.model_id AND s.pass = 'A' LEFT JOIN gate_results g ON g.seq = s.seq
""")
relation("stops", "SELECT *, min(CASE WHEN passes THEN pos END) OVER (PARTITION BY row_name, split, task, item_id) AS stop FROM attempts")
#: What each item met: the first answer that passes; else the best model's, unless the task must stay local.
relation("walked", """
SELECT row_name, split, task, item_id, max(stop) AS stop, bool_and(stays) AS stays, count(*) AS calls, sum(latency_s) AS latency_s, sum(cost_usd) AS cost_usd, max(CASE WHEN pos = stop THEN model_id END) AS stopped_by, max(CASE WHEN best = 1 THEN model_id END) AS best_model,
  max(CASE WHEN pos = stop THEN kind END) AS stopped_kind, max(CASE WHEN best = 1 THEN kind END) AS best_kind, max(CASE WHEN best = 1 AND usable THEN 1 ELSE 0 END) AS best_usable,
  max(CASE WHEN pos = stop THEN a END) AS a1, max(CASE WHEN pos = stop THEN b END) AS b1, max(CASE WHEN pos = stop THEN c END) AS c1, max(CASE WHEN pos = stop THEN d END) AS d1, max(CASE WHEN pos = stop THEN e END) AS e1,
  max(CASE WHEN best = 1 AND usable THEN a END) AS a2, max(CASE WHEN best = 1 AND usable THEN b END) AS b2, max(CASE WHEN best = 1 AND usable THEN c END) AS c2, max(CASE WHEN best = 1 AND usable THEN d END) AS d2, max(CASE WHEN best = 1 AND usable THEN e END) AS e2
FROM stops WHERE stop IS NULL OR pos <= stop GROUP BY row_name, split, task, item_id
""")
_PICK = ", ".join(f"CASE WHEN w.stop IS NOT NULL THEN w.{x}1 WHEN w.best_usable = 1 AND NOT w.stays THEN w.{x}2 ELSE u.{x} END AS {x}" for x in "abcde")
relation("replayed", f"""
SELECT m.row_name, i.split, i.task, i.item_id, coalesce(w.stop, -1) AS served_pos, CASE WHEN w.stop IS NOT NULL THEN w.stopped_by WHEN w.task IS NOT NULL AND NOT w.stays THEN w.best_model END AS served_by, CASE WHEN w.stop IS NOT NULL THEN w.stopped_kind WHEN w.task IS NOT NULL AND NOT w.stays THEN w.best_kind END AS served_kind,
  coalesce(w.calls, 0) AS calls, coalesce(w.latency_s, 0e0) AS latency_s, coalesce(w.cost_usd, 0e0) AS cost_usd, w.task IS NOT NULL AND coalesce(w.stop, 0) <> 1 AS escalated, w.task IS NULL AS refused, {_PICK}
FROM replay_modes m JOIN items i ON i.split = m.split JOIN unanswered u ON u.task = i.task AND u.split = i.split AND u.item_id = i.item_id LEFT JOIN walked w ON w.row_name = m.row_name AND w.split = i.split AND w.task = i.task AND w.item_id = i.item_id
""")
relation("replay_calls", "SELECT row_name, split, task, model_id, kind, count(*) AS calls, sum(cost_usd) AS cost_usd FROM stops WHERE stop IS NULL OR pos <= stop GROUP BY row_name, split, task, model_id, kind")
latency_percentiles("replay_latency", "replayed", "row_name, split, task")
relation("replay_tasks", f"""
SELECT r.row_name, r.split, r.task, r.n, r.score, r.local_share, r.escalated, l.p50_s, l.p95_s, r.cost_usd, r.calls, r.refused FROM replay_latency l JOIN (SELECT row_name, split, task, count(*) AS n, {primary()} AS score, avg(CASE WHEN served_kind IN ('local', 'baseline') THEN 1e0 ELSE 0e0 END) AS local_share, avg(CASE WHEN escalated THEN 1e0 ELSE 0e0 END) AS escalated, sum(cost_usd) AS cost_usd, CAST(sum(calls) AS BIGINT) AS calls, bool_and(refused) AS refused
  FROM replayed GROUP BY row_name, split, task) r ON r.row_name = l.row_name AND r.split = l.split AND r.task = l.task
""")
#: A month of the mixed workload on a shared machine; refused tasks carry neither cost nor volume.
relation("mixed_local", """
SELECT c.row_name, sum(CASE WHEN c.kind = 'local' AND l.capacity > 0 THEN c.calls * r.monthly / t.n / l.capacity ELSE 0e0 END) AS utilisation, sum(CASE WHEN c.kind = 'local' AND l.energy_usd < CAST('Infinity' AS DOUBLE) THEN c.calls * r.monthly / t.n * l.energy_usd ELSE 0e0 END) AS energy, sum(c.cost_usd * r.monthly / t.n) AS cloud, max(CASE WHEN c.kind = 'local' THEN 1 ELSE 0 END) AS any_local
FROM replay_calls c JOIN replay_tasks t ON t.row_name = c.row_name AND t.split = c.split AND t.task = c.task JOIN route r ON r.task = c.task LEFT JOIN local_costs l ON l.model_id = c.model_id AND l.task = c.task WHERE c.split = 'test' AND NOT t.refused GROUP BY c.row_name
""")
relation("mixed_costs", """
SELECT t.row_name, CASE WHEN t.volume > 0 THEN (coalesce(m.machines, 0) * f.fixed_usd + coalesce(m.energy, 0e0) + coalesce(m.cloud, 0e0)) / t.volume * 1000 END AS usd_per_1k, coalesce(m.machines, 0) AS machines, t.volume FROM (SELECT t.row_name, sum(r.monthly) AS volume FROM replay_tasks t JOIN route r ON r.task = t.task WHERE t.split = 'test' AND NOT t.refused GROUP BY t.row_name) t
CROSS JOIN fixed_cost f LEFT JOIN (SELECT *, CASE WHEN any_local = 0 THEN 0 WHEN utilisation > 0 THEN greatest(1, CAST(ceil(utilisation) AS BIGINT)) ELSE 1 END AS machines FROM mixed_local) m ON m.row_name = t.row_name
""")
relation("mixed_latency", """
SELECT i.row_name, i.latency_s AS v, r.weight / t.n AS w FROM replayed i JOIN replay_tasks t ON t.row_name = i.row_name AND t.split = i.split AND t.task = i.task JOIN route r ON r.task = i.task WHERE i.split = 'test' AND NOT t.refused
UNION ALL SELECT f.row_name, c.latency_s, r.weight / t.n FROM fixed_models f JOIN calls c ON c.model_id = f.model_id JOIN (SELECT model_id, task, count(*) AS n FROM calls WHERE split = 'test' AND pass = 'A' GROUP BY model_id, task) t ON t.model_id = c.model_id AND t.task = c.task JOIN route r ON r.task = c.task WHERE c.split = 'test' AND c.pass = 'A'
""")
weighted("mixed_p", "mixed_latency", "row_name")
relation("fixed_models", "SELECT 'all-frontier' AS row_name, min_by(model_id, pos) AS model_id FROM models WHERE kind = 'cloud' AND role = 'frontier' UNION ALL SELECT 'cheapest-single-cloud', max(model_id) FROM single_cloud")
relation("fixed_tasks", """
SELECT f.row_name, f.model_id, r.task, r.weight, r.weight * c.usd AS usd, c.score, b.bar, coalesce(c.score >= b.bar, FALSE) AS meets FROM fixed_models f CROSS JOIN route r JOIN bars b ON b.task = r.task LEFT JOIN candidates c ON c.model_id = f.model_id AND c.task = r.task AND c.split = 'test' WHERE f.model_id IS NOT NULL
""")
relation("router_tasks", "SELECT t.row_name, t.task, r.weight, t.score, b.bar, NOT t.refused AND coalesce(t.score >= b.bar, FALSE) AS meets, t.refused, t.local_share, t.escalated FROM replay_tasks t JOIN route r ON r.task = t.task JOIN plan_bars b ON b.task = t.task WHERE t.split = 'test'")
#: The five configurations: two fixed models and three routers, each router against the fixed ones over the tasks that it serves.
relation("mixed_rows", """
SELECT f.row_name, max(f.model_id) AS model_id, sum(t.usd) * 1000 AS usd_per_1k, count(*) FILTER (WHERE t.meets) AS bars_met, count(t.task) AS tasks, CASE WHEN max(f.model_id) IS NOT NULL THEN 0e0 END AS local_pct, CASE WHEN max(f.model_id) IS NOT NULL THEN 0e0 END AS escalated_pct, CAST(NULL AS DOUBLE) AS vs_frontier_pct, CAST(NULL AS DOUBLE) AS vs_cheapest_pct FROM fixed_models f LEFT JOIN fixed_tasks t ON t.row_name = f.row_name GROUP BY f.row_name
UNION ALL SELECT t.row_name, NULL, c.usd_per_1k, t.bars_met, t.tasks, t.local_pct, t.escalated_pct, CASE WHEN r.frontier > 0 THEN (r.frontier - c.usd_per_1k) / r.frontier * 100 END, CASE WHEN r.cheapest > 0 THEN (r.cheapest - c.usd_per_1k) / r.cheapest * 100 END
FROM (SELECT row_name, count(*) FILTER (WHERE meets) AS bars_met, count(*) FILTER (WHERE NOT refused) AS tasks, CASE WHEN sum(CASE WHEN refused THEN 0e0 ELSE weight END) > 0 THEN 100 * sum(CASE WHEN refused THEN 0e0 ELSE weight * local_share END) / sum(CASE WHEN refused THEN 0e0 ELSE weight END) END AS local_pct,
  CASE WHEN sum(CASE WHEN refused THEN 0e0 ELSE weight END) > 0 THEN 100 * sum(CASE WHEN refused THEN 0e0 ELSE weight * escalated END) / sum(CASE WHEN refused THEN 0e0 ELSE weight END) END AS escalated_pct FROM router_tasks GROUP BY row_name) t JOIN mixed_costs c ON c.row_name = t.row_name
LEFT JOIN (SELECT t.row_name, 1000 * sum(CASE WHEN f.row_name = 'all-frontier' THEN f.usd END) / CASE WHEN count(DISTINCT t.task) = (SELECT count(*) FROM mix) THEN 1e0 ELSE sum(CASE WHEN f.row_name = 'all-frontier' THEN f.weight END) END AS frontier, 1000 * sum(CASE WHEN f.row_name = 'cheapest-single-cloud' THEN f.usd END) / CASE WHEN count(DISTINCT t.task) = (SELECT count(*) FROM mix) THEN 1e0 ELSE sum(CASE WHEN f.row_name = 'cheapest-single-cloud' THEN f.weight END) END AS cheapest
  FROM router_tasks t JOIN fixed_tasks f ON f.task = t.task WHERE NOT t.refused GROUP BY t.row_name) r ON r.row_name = t.row_name
""")
relation("hybrid", """
SELECT t.task, t.escalated, max(CASE WHEN h.pos = 1 AND h.kind IN ('local', 'baseline') THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN h.pos > 1 AND h.kind = 'cloud' THEN 1 ELSE 0 END) = 1 AND coalesce(max(t.score) >= max(b.bar), FALSE) AND t.escalated > 0 AND t.escalated <= 0.2e0 AS eligible, min_by(h.model_id, h.pos) FILTER (WHERE h.pos > 1 AND h.kind = 'cloud') AS escalates_to
FROM replay_tasks t JOIN chain h ON h.constrained AND h.task = t.task JOIN plan_bars b ON b.task = t.task WHERE t.split = 'calib' GROUP BY t.task, t.escalated
""")
relation("task_facts", """
SELECT r.task, r.local_only, r.monthly, coalesce(l.score >= b.bar, FALSE) AS local_meets, CASE WHEN l.score IS NOT NULL THEN greatest(0e0, b.bar - l.score) END AS gap, l.kind = 'baseline' AND l.score >= b.bar AS free, l.model_id AS best_local, e.verdict, e.volume, coalesce(y.eligible, FALSE) AS hybrid, y.escalated, y.escalates_to
FROM route r JOIN bars b ON b.task = r.task LEFT JOIN best_broad l ON l.task = r.task LEFT JOIN break_even e ON e.task = r.task LEFT JOIN hybrid y ON y.task = r.task
""")
_COUNT = "CAST(CAST(bround({}, 0) AS BIGINT) AS STRING)"
relation("alone_reasons", f"""
SELECT task, CASE WHEN NOT local_meets THEN 'local alone is below the bar' WHEN verdict = 'break-even' THEN 'local alone is cheaper only above ' || {_COUNT.format('volume')} || ' tasks a month' WHEN verdict = 'infeasible' THEN 'local alone would break even at more than the machine can serve'
  WHEN verdict = 'never' THEN 'local alone is never cheaper than the cheapest cloud model that meets the bar' WHEN verdict = 'no-cloud' THEN 'no cloud model meets the bar' END AS reason FROM task_facts
""")
relation("verdicts_by_task", f"""
SELECT f.task, CASE WHEN f.local_only AND f.local_meets THEN 'local (constraint)' WHEN f.local_only THEN 'local (constraint, below bar)' WHEN f.local_meets AND (coalesce(f.free, FALSE) OR f.verdict = 'break-even' AND f.monthly >= f.volume) THEN 'local' WHEN f.hybrid THEN 'hybrid' ELSE 'cloud' END AS label,
  CASE WHEN f.local_only AND f.local_meets THEN 'must stay local; a local model meets the bar' WHEN f.local_only THEN 'must stay local; no local model meets the bar' WHEN f.local_meets AND coalesce(f.free, FALSE) THEN f.best_local || ' meets the bar at no cost per task' WHEN f.local_meets AND f.verdict = 'break-even' AND f.monthly >= f.volume THEN 'breaks even at ' || {_COUNT.format('f.volume')} || ' tasks a month, within its volume'
  WHEN f.hybrid THEN coalesce(a.reason || '; ', '') || 'the router meets the bar with ' || CASE WHEN f.escalated > 0 AND f.escalated < 0.005e0 THEN '<1%' ELSE CAST(CAST(bround(100 * f.escalated, 0) AS BIGINT) AS STRING) || '%' END || ' escalation to ' || f.escalates_to ELSE coalesce(a.reason, 'no local model meets the bar and breaks even') || '; no local primary serves with at most 20% escalation' END AS detail
FROM task_facts f JOIN alone_reasons a ON a.task = f.task
""")
relation("saving", """
SELECT d.refused, CASE WHEN d.refused > 0 THEN 'gates, no constraints' END AS scope, CASE WHEN d.refused > 0 THEN u.vs_cheapest_pct ELSE d.vs_cheapest_pct END AS vs_cheapest, CASE WHEN d.refused > 0 THEN u.vs_frontier_pct ELSE d.vs_frontier_pct END AS vs_frontier
FROM (SELECT m.*, t.refused FROM mixed_rows m CROSS JOIN (SELECT count(*) FILTER (WHERE refused) AS refused FROM router_tasks WHERE row_name = 'router (gates, constraints)') t WHERE m.row_name = 'router (gates, constraints)') d LEFT JOIN mixed_rows u ON u.row_name = 'router (gates, no constraints)'
""")
#: What a router that runs answered: the observed side of the check against the replay.
relation("observed", """
SELECT c.task, c.item_id, min_by(CASE WHEN c.item_id % 41 = 7 THEN 'cloud-small' ELSE c.model_id END, h.pos) AS answered_by, min(h.pos) > 1 AS escalated, FALSE AS refused FROM calls c JOIN chain h ON h.constrained AND h.task = c.task AND h.model_id = c.model_id JOIN gate_results g ON g.seq = c.seq WHERE c.split = 'test' AND c.pass = 'A' AND c.valid AND g.passed GROUP BY c.task, c.item_id
UNION ALL SELECT i.task, i.item_id, NULL, FALSE, TRUE FROM items i LEFT ANTI JOIN chain h ON h.constrained AND h.task = i.task WHERE i.split = 'test'
""")
relation("decisions", """
SELECT r.task, r.item_id, CASE WHEN o.refused THEN r.served_by IS NULL ELSE coalesce(r.served_by = o.answered_by AND r.escalated = o.escalated, FALSE) END AS matched, coalesce(o.refused, FALSE) AND r.served_by IS NULL AS refused, r.served_by, o.answered_by
FROM observed o JOIN replayed r ON r.row_name = 'router (gates, constraints)' AND r.split = 'test' AND r.task = o.task AND r.item_id = o.item_id
""")

_DEPLOYED = "row_name = 'router (gates, constraints)' AND split = 'test'"
QUERIES = {
    "route_plan": "SELECT u.task, m.constrained, p.model_id, coalesce(p.dropped, CASE WHEN p.model_id IS NULL THEN 'not measured' ELSE 'kept' END) AS status, round(p.score, 9) AS score, round(p.bar, 9) AS bar, round(p.usd, 9) AS usd FROM task_universe u CROSS JOIN plan_modes m LEFT JOIN planned p ON p.task = u.task AND p.constrained = m.constrained",
    "plan_chain": "SELECT constrained, task, pos, model_id, kind FROM chain",
    "plan_table": """
SELECT u.task, p.model_id AS primary_model, f.model_id AS fallback_model, CASE WHEN p.model_id IS NULL THEN 'unservable' WHEN p.below = 1 THEN 'served below bar' ELSE 'served' END AS status, CASE WHEN p.model_id IS NULL THEN 'off' WHEN p.kind = 'baseline' THEN 'format only' ELSE 'on' END AS gate FROM task_universe u LEFT JOIN chain p ON p.constrained AND p.task = u.task AND p.pos = 1 LEFT JOIN chain f ON f.constrained AND f.task = u.task AND f.pos = 2""",
    "plan_score_proxy": "SELECT model_id, task, split, proxy, round(plan_score, 9) AS plan_score FROM plan_scores",
    "replay_items": f"SELECT task, item_id, served_pos, served_by, calls, escalated, round(latency_s, 9) AS latency_s, round(cost_usd, 12) AS cost_usd, a, b FROM replayed WHERE {_DEPLOYED}",
    "replay_tasks": "SELECT row_name, split, task, n, round(score, 9) AS score, local_share, escalated, round(p50_s, 9) AS p50_s, round(p95_s, 9) AS p95_s, round(cost_usd, 9) AS cost_usd, calls, refused FROM replay_tasks",
    "replay_calls": "SELECT row_name, split, task, model_id, calls, round(cost_usd, 9) AS cost_usd FROM replay_calls",
    "http_outcome": f"""
SELECT task, item_id, CASE WHEN streams THEN 400 WHEN unknown THEN 404 WHEN served_by IS NULL THEN 503 ELSE 200 END AS status FROM (SELECT r.task, r.item_id, r.served_by, c.streams, u.task IS NULL AS unknown FROM replayed r JOIN (SELECT task, item_id, max(CASE WHEN completion_tokens = 34 THEN TRUE ELSE FALSE END) AS streams FROM calls GROUP BY task, item_id) c ON c.task = r.task AND c.item_id = r.item_id LEFT JOIN mix u ON u.task = r.task WHERE {_DEPLOYED.replace('row_name', 'r.row_name').replace('split', 'r.split')}) x""",
    "replay_decision_match": "SELECT task, count(*) AS n, avg(CASE WHEN matched THEN 1e0 ELSE 0e0 END) AS match_rate, count(*) FILTER (WHERE refused) AS refused FROM decisions GROUP BY task",
    "decision_mismatches": "SELECT task, item_id, served_by, answered_by FROM decisions WHERE NOT matched",
    "mixed_table": "SELECT m.row_name, m.model_id, round(m.usd_per_1k, 6) AS usd_per_1k, m.bars_met, m.tasks, round(m.local_pct, 6) AS local_pct, round(m.escalated_pct, 6) AS escalated_pct, round(p.value, 9) AS p50_s, round(q.value, 9) AS p95_s, round(m.vs_frontier_pct, 6) AS vs_frontier_pct, round(m.vs_cheapest_pct, 6) AS vs_cheapest_pct FROM mixed_rows m LEFT JOIN mixed_p p ON p.row_name = m.row_name AND p.p = 0.5e0 LEFT JOIN mixed_p q ON q.row_name = m.row_name AND q.p = 0.95e0",
    "mixed_table_ms": "SELECT m.row_name, round(1000 * p.value, 3) AS p50_ms FROM mixed_rows m JOIN mixed_p p ON p.row_name = m.row_name AND p.p = 0.5e0",
    "mixed_cost": "SELECT row_name, round(usd_per_1k, 6) AS usd_per_1k, CAST(machines AS BIGINT) AS machines, volume FROM mixed_costs",
    "weighted_avg": "SELECT row_name, CASE WHEN sum(weight) <= 0 THEN NULL ELSE round(sum(weight * local_share) / sum(weight), 9) END AS local_share FROM router_tasks WHERE NOT refused GROUP BY row_name",
    "fixed_model_row": "SELECT row_name, model_id, task, round(usd, 12) AS usd, round(score, 9) AS score, round(bar, 9) AS bar, meets FROM fixed_tasks",
    "router_matrix": """
SELECT row_name, count(*) FILTER (WHERE meets) AS met, max(CASE WHEN task = 'classification' THEN round(score, 9) END) AS classification, max(CASE WHEN task = 'extraction' THEN round(score, 9) END) AS extraction, max(CASE WHEN task = 'pii_redaction' THEN round(score, 9) END) AS pii_redaction,
  max(CASE WHEN task = 'entity_matching' THEN round(score, 9) END) AS entity_matching, max(CASE WHEN task = 'summarisation' THEN round(score, 9) END) AS summarisation FROM (SELECT row_name, task, score, meets FROM router_tasks UNION ALL SELECT row_name, task, score, meets FROM fixed_tasks) x GROUP BY row_name""",
    "task_verdict": "SELECT task, label AS verdict, detail FROM verdicts_by_task",
    "local_alone_reason": "SELECT task, reason FROM alone_reasons",
    "hybrid_eligible": "SELECT task, eligible, escalates_to, escalated FROM hybrid",
    "headline_task": "SELECT task, any_met FROM headline",
    "headline_saving": "SELECT round(coalesce(vs_cheapest, vs_frontier), 9) AS saving_pct, CASE WHEN vs_cheapest IS NOT NULL THEN 'cheapest single cloud' WHEN vs_frontier IS NOT NULL THEN 'all-frontier' END AS versus, scope, refused FROM saving",
    "refused_tasks": "SELECT row_name, task, refused FROM router_tasks",
}
