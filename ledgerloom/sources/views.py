"""Adapter relations over the synthetic tables: recorded calls, models, judgements, ledger, texts."""

from __future__ import annotations

from ..sql import either, relation

relation("calls", """
SELECT event_id AS seq, item_id, model_ix,
  CASE model_ix WHEN 0 THEN 'local-a' WHEN 1 THEN 'local-b' WHEN 2 THEN 'cloud-frontier' WHEN 3 THEN 'cloud-small'
       WHEN 4 THEN 'cloud-large' WHEN 5 THEN 'cloud-family' ELSE 'baseline' END AS model_id,
  CASE WHEN model_ix < 2 THEN 'local' WHEN model_ix < 6 THEN 'cloud' ELSE 'baseline' END AS kind,
  CASE item_id % 5 WHEN 0 THEN 'classification' WHEN 1 THEN 'extraction' WHEN 2 THEN 'pii_redaction'
       WHEN 3 THEN 'entity_matching' ELSE 'summarisation' END AS task,
  CASE WHEN item_id % 3 = 0 THEN 'calib' ELSE 'test' END AS split,
  CASE WHEN model_ix < 2 AND item_id % 11 = 10 THEN 'B' ELSE 'A' END AS pass,
  item_id % 4 AS gold,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % (5 + model_ix) = 0 THEN (item_id + 1) % 4 ELSE item_id % 4 END AS pred,
  (k % 17 <> 0) AND (k % 19 <> 0) AS valid,
  CASE WHEN k % 19 = 0 THEN 'http_500' END AS error,
  value / 100 AS latency_s,
  CASE WHEN model_ix BETWEEN 2 AND 5 THEN value / 100000 ELSE 0e0 END AS cost_usd,
  k % 3 AS retries, 50 + k AS prompt_tokens, 5 + k % 30 AS completion_tokens, ts AS t_start, k
FROM (SELECT event_id, value, ts, CAST(floor(event_id / 7) AS BIGINT) AS item_id, event_id % 7 AS model_ix,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e
""")
relation("models", """
SELECT * FROM (VALUES
  (0, 'local-a', 'local', 'local', 'local', 0e0, 0e0), (1, 'local-b', 'local', 'local', 'local', 0e0, 0e0),
  (2, 'cloud-frontier', 'cloud', 'frontier', 'vendor-x', 1.6e-6, 4.8e-6), (3, 'cloud-small', 'cloud', 'small-closed', 'vendor-y', 2e-7, 8e-7),
  (4, 'cloud-large', 'cloud', 'open-large', 'vendor-z', 4e-7, 1.2e-6), (5, 'cloud-family', 'cloud', 'open-same-family', 'vendor-y', 1e-7, 4e-7),
  (6, 'baseline', 'baseline', 'baseline', 'baseline', 0e0, 0e0)) AS t(pos, model_id, kind, role, provider, prompt_price, completion_price)
""")
relation("mix", """
SELECT * FROM (VALUES ('classification', 0.30e0), ('extraction', 0.25e0), ('pii_redaction', 0.20e0), ('entity_matching', 0.15e0),
  ('summarisation', 0.10e0)) AS t(task, weight)
""")
#: Settings as a file gives them: a row that is there counts, even if its value is null.
relation("bar_settings", "SELECT * FROM (VALUES ('default', 0.95e0, CAST(NULL AS DOUBLE)), ('pii_redaction', CAST(NULL AS DOUBLE), 0.72e0)) AS t(task, relative_bar, absolute_bar)")
relation("cap_settings", "SELECT * FROM (VALUES ('default', 5e0), ('extraction', CAST(NULL AS DOUBLE)), ('summarisation', 9e0)) AS t(task, cap_s)")
relation("volume_settings", "SELECT * FROM (VALUES ('extraction', 9000e0)) AS t(task, volume)")
relation("local_only_tasks", "SELECT * FROM (VALUES ('pii_redaction')) AS t(task)")
relation("run_settings", "SELECT 50000e0 AS monthly_volume, FALSE AS below_bar_ok, 14.5e0 AS cap_usd, 11e0 AS warn_usd")
relation("route", """
SELECT m.task, m.weight, CASE WHEN o.task IS NOT NULL THEN o.relative_bar WHEN d.task IS NOT NULL THEN d.relative_bar ELSE 0.95e0 END AS relative_bar, CASE WHEN o.task IS NOT NULL THEN o.absolute_bar ELSE d.absolute_bar END AS absolute_bar,
  CASE WHEN c.task IS NOT NULL THEN c.cap_s ELSE e.cap_s END AS cap_s, l.task IS NOT NULL AS local_only, s.below_bar_ok, coalesce(v.volume, s.monthly_volume * m.weight) AS monthly
FROM mix m CROSS JOIN run_settings s LEFT JOIN bar_settings o ON o.task = m.task LEFT JOIN bar_settings d ON d.task = 'default' LEFT JOIN cap_settings c ON c.task = m.task LEFT JOIN cap_settings e ON e.task = 'default'
LEFT JOIN volume_settings v ON v.task = m.task LEFT JOIN local_only_tasks l ON l.task = m.task
""")
relation("hardware", """
SELECT 1200e0 AS price, 3e0 AS years, 1e0 AS allocation, 5e0 AS idle_w, 20e0 AS load_w, 0.30e0 AS kwh, 8e0 AS hours, 0e0 AS ops, 'measured' AS mode
""")
relation("power_probes", "SELECT * FROM (VALUES ('local-a', 'measured', 18.5e0, 4e0), ('local-b', 'unavailable', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))) AS t(model_id, mode, incremental_w, idle_w)")
relation("soaks", "SELECT * FROM (VALUES ('local-a', 0.98e0), ('local-b', 1.02e0)) AS t(model_id, throttle)")
#: Stretches of calls with their wall time; of several for a key the one of the latest session counts.
relation("segments", """
SELECT model_id, kind, task, split, pass, segment, n, wall_s FROM (SELECT *, row_number() OVER (PARTITION BY model_id, task, split, pass, segment ORDER BY session DESC) AS rn FROM (
  SELECT model_id, kind, task, split, pass, CAST(floor(item_id / 40) AS BIGINT) AS segment, item_id % 2 AS session, count(*) AS n, sum(latency_s) / CASE pass WHEN 'B' THEN 3e0 ELSE 1e0 END AS wall_s
  FROM calls GROUP BY model_id, kind, task, split, pass, CAST(floor(item_id / 40) AS BIGINT), item_id % 2) x WHERE n > 0) y WHERE rn = 1
""")
relation("judged", "SELECT doc_id AS id, quality = 1 AS label_pass, toxic = 0 AS predicted_pass, doc_id % 5 AS part FROM labels")
#: Seconds are counted as clocks show them: parts of a second are cut off on both sides before the difference.
_SINCE = either("timestampdiff(SECOND, date_trunc('second', (SELECT min(ts) FROM events)), date_trunc('second', ts))", "timestampdiff(SECOND, (SELECT min(ts) FROM events), ts)")
relation("completions", f"SELECT event_id, {_SINCE} AS t FROM events")
relation("pipeline_commands", "SELECT * FROM (VALUES ('bench', 0), ('judge calibrate', 1), ('judge score', 2), ('route replay', 3)) AS t(command, place)")
relation("ledger_v", """
SELECT o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'judge score' WHEN '2-HIGH' THEN 'bench' WHEN '3-MEDIUM' THEN 'judge calibrate' WHEN '5-LOW' THEN 'adhoc' ELSE 'a trial' END AS command, o_orderdate AS ts, o_totalprice / 1000000 AS actual_usd,
  o_totalprice / 900000 AS reserved_usd, CASE WHEN o_orderkey % 3 = 0 THEN 'usage.cost' ELSE 'tokens x snapshot' END AS cost_source FROM orders
""")
relation("raw_json", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' done'
  WHEN 3 THEN '<think>maybe {</think> ' || props WHEN 4 THEN '<think>never ended ' || props ELSE substr(props, 1, 4) END AS raw FROM events
""")
relation("summaries", """
SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'assistant') AS summary, max_by(text, turn) FILTER (WHERE role = 'user') AS asked,
  count(*) AS turns FROM conversations GROUP BY conv_id
""")
relation("throughput", """
SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS segment, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS wall_s
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber
""")
relation("company_pairs", """
SELECT s.s_suppkey AS id, s.s_name AS left_name, t.s_name AS right_name, s.s_nationkey AS left_nation, t.s_nationkey AS right_nation,
  s.s_acctbal AS left_bal, t.s_acctbal AS right_bal, s.s_nationkey = t.s_nationkey AS match
FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1
""")
