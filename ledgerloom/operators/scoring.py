"""Scans, projections, validation, joins and per-row scores over recorded calls."""

from __future__ import annotations

from ..functions import macros as m
from ..sources import tasks  # noqa: F401  registers the relations used here
from ..sql import relation

#: What scores of a kind add up from: one row a call. a to e are sums by kind, see ``primary``.
relation("outcomes", """
SELECT p.seq, p.ok AS valid, CASE WHEN p.ok AND p.label = i.gold THEN 1 ELSE 0 END AS a, 1 AS b, 0 AS c, 0 AS d, 0 AS e FROM topic_parsed p JOIN topic_items i ON i.item_id = p.item_id AND i.split = p.split
UNION ALL SELECT seq, ok, CASE WHEN ok AND match AND gold_match THEN 1 ELSE 0 END, CASE WHEN ok AND match AND NOT gold_match THEN 1 ELSE 0 END, CASE WHEN NOT (ok AND coalesce(match, FALSE)) AND gold_match THEN 1 ELSE 0 END, 0, 0 FROM match_parsed
UNION ALL SELECT seq, valid, CAST(n_right AS INTEGER), CAST(n_fields AS INTEGER), CASE WHEN n_right = n_fields THEN 1 ELSE 0 END, 0, 0 FROM field_scores
UNION ALL SELECT seq, valid, CAST(caught AS INTEGER), CAST(gold_n AS INTEGER), CAST(tp AS INTEGER), CAST(pred_n AS INTEGER), CASE WHEN zero_leak THEN 1 ELSE 0 END FROM span_scores
UNION ALL SELECT seq, valid, CASE WHEN passed THEN 1 ELSE 0 END, CASE WHEN judged THEN 1 ELSE 0 END, CAST(n_present AS INTEGER), CAST(n_facts AS INTEGER), CASE WHEN within_limit THEN 1 ELSE 0 END FROM summary_scores
""")
relation("scored", """
SELECT c.seq, c.model_id, c.kind, c.task, c.split, c.pass, c.item_id, c.latency_s, c.cost_usd, c.retries, c.error, c.prompt_tokens, c.completion_tokens, o.valid, o.a, o.b, o.c, o.d, o.e FROM calls c JOIN outcomes o ON o.seq = c.seq
""")
#: What an item scores without a usable answer.
relation("items", "SELECT DISTINCT task, split, item_id FROM calls")
#: What an item's gold holds: fields, spans, a match, facts.
relation("gold_counts", """
SELECT task, split, item_id, CAST(n AS INTEGER) AS n FROM (SELECT 'extraction' AS task, split, item_id, count(*) AS n FROM enquiry_gold GROUP BY split, item_id UNION ALL SELECT 'pii_redaction', split, item_id, count(*) FROM letter_spans GROUP BY split, item_id
UNION ALL SELECT 'entity_matching', split, item_id, max(CASE WHEN gold_match THEN 1 ELSE 0 END) FROM match_answers GROUP BY split, item_id UNION ALL SELECT 'summarisation', split, item_id, count(DISTINCT ix) FROM brief_tokens GROUP BY split, item_id) g
""")
relation("unanswered", """
SELECT i.task, i.split, i.item_id, 0 AS a, CASE WHEN i.task = 'classification' THEN 1 WHEN i.task IN ('extraction', 'pii_redaction') THEN coalesce(g.n, 0) ELSE 0 END AS b, CASE WHEN i.task = 'entity_matching' THEN coalesce(g.n, 0) ELSE 0 END AS c, CASE WHEN i.task = 'summarisation' THEN coalesce(g.n, 0) ELSE 0 END AS d,
  CASE WHEN i.task = 'pii_redaction' AND coalesce(g.n, 0) = 0 THEN 1 ELSE 0 END AS e FROM items i LEFT JOIN gold_counts g ON g.task = i.task AND g.item_id = i.item_id AND g.split = i.split
""")


def primary(task: str = "task", n: str = "count(*)") -> str:
    """A kind's main metric over sums of outcomes: accuracy, F1, field accuracy, F2, pass rate of what was judged."""
    share = lambda x, y, none: f"CASE WHEN sum({y}) = 0 THEN {none} ELSE sum({x}) / CAST(sum({y}) AS DOUBLE) END"
    recall, precision = share("a", "b", "1e0"), share("c", "d", "0e0")
    return (
        f"CASE {task} WHEN 'classification' THEN sum(a) / CAST({n} AS DOUBLE) WHEN 'entity_matching' THEN CASE WHEN 2 * sum(a) + sum(b) + sum(c) = 0 THEN 0e0 ELSE 2e0 * sum(a) / (2 * sum(a) + sum(b) + sum(c)) END"
        f" WHEN 'extraction' THEN {share('a', 'b', 'NULL')} WHEN 'pii_redaction' THEN CASE WHEN 4 * ({precision}) + ({recall}) = 0 THEN 0e0 ELSE 5 * ({precision}) * ({recall}) / (4 * ({precision}) + ({recall})) END ELSE {share('a', 'b', 'NULL')} END"
    )


QUERIES = {
    # scans and connectors
    "predictions_pass_a": "SELECT model_id, task, split, item_id, pred, valid FROM calls WHERE pass = 'A'",
    "scan_calls_by_kind": "SELECT kind, pass, count(*) AS n FROM calls GROUP BY kind, pass",
    "ledger_total": "SELECT round(sum(coalesce(actual_usd, 0e0)), 4) AS total_usd, count(*) AS entries FROM ledger_v",
    "ledger_by_command": """
SELECT command, row_number() OVER (ORDER BY place, command) AS pipeline_order, usd, calls FROM (SELECT l.command, coalesce(p.place, 99) AS place, round(sum(coalesce(l.actual_usd, 0e0)), 4) AS usd, count(*) AS calls FROM ledger_v l LEFT JOIN pipeline_commands p ON p.command = l.command GROUP BY l.command, coalesce(p.place, 99)) x""",
    "price_snapshot_join": """
SELECT m.model_id, p.taken, TRY_CAST(p.prompt AS DOUBLE) AS prompt, TRY_CAST(p.completion AS DOUBLE) AS completion FROM seen_models m LEFT JOIN
 (SELECT model_id, max(taken) AS taken, max_by(prompt, seq) AS prompt, max_by(completion, seq) AS completion FROM price_snapshots GROUP BY model_id) p ON p.model_id = m.model_id""",
    "price_snapshot_merge": """
SELECT base_url, model_id, taken, round(TRY_CAST(prompt AS DOUBLE), 15) AS prompt FROM (SELECT base_url, model_id, taken, prompt, row_number() OVER (PARTITION BY base_url, model_id ORDER BY taken DESC, seq DESC) AS rn FROM price_snapshots) x WHERE rn = 1""",
    "model_dim": """
SELECT model_id, max_by(kind, pos) AS kind, max_by(provider, pos) AS provider, max(pos) AS pos, max(calls) AS calls
FROM (SELECT m.model_id, m.kind, m.provider, m.pos, s.calls FROM seen_models s JOIN models m ON m.model_id = s.model_id UNION ALL SELECT model_id, kind, 'recorded', -1, calls FROM seen_models) m GROUP BY model_id""",
    "hardware_dim": "SELECT r.monthly_volume, h.price, h.idle_w, h.load_w, h.price IS NULL AS absent, c.calls, round(c.busy_s, 6) AS busy_s FROM run_settings r CROSS JOIN (SELECT count(*) AS calls, sum(latency_s) AS busy_s FROM calls WHERE kind = 'local') c LEFT JOIN hardware h ON h.allocation > 0",
    "deep_merge_upsert": """
SELECT coalesce(o.path, n.path) AS path, coalesce(n.v, o.v) AS v FROM (SELECT 'orders/' || o_orderpriority AS path, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderpriority) o
FULL OUTER JOIN (SELECT 'orders/' || o_orderpriority AS path, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority < '4' GROUP BY o_orderpriority
  UNION ALL SELECT 'suppliers', count(*) FROM supplier) n ON o.path = n.path""",
    "config_merge": """
SELECT coalesce(n.model_id, o.model_id) AS model_id, coalesce(n.kind, o.kind) AS kind, coalesce(o.pos, 100 + n.pos) AS pos
FROM (SELECT DISTINCT model_id, kind, model_ix AS pos FROM calls WHERE split = 'calib' AND model_ix < 5) o FULL OUTER JOIN (SELECT DISTINCT model_id, kind || '-new' AS kind, model_ix AS pos FROM calls WHERE split = 'test' AND model_ix > 2) n ON o.model_id = n.model_id""",
    "download_budget": """
SELECT r.repo, r.revision, r.bytes, coalesce(c.cached, 0) AS cached, greatest(0, r.bytes - coalesce(c.cached, 0)) AS new_bytes, sum(r.bytes) OVER () <= 2000000000 AS within_cap
FROM (SELECT p_brand AS repo, 'r' || substr(p_brand, -2) AS revision, CAST(sum(coalesce(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END, 0)) * 1000 AS BIGINT) AS bytes FROM part GROUP BY p_brand) r
LEFT JOIN (SELECT p_brand AS repo, max(CAST(p_size * 20000 AS BIGINT)) AS cached, 'r' || substr(p_brand, -2) || CASE WHEN p_brand < 'Brand#3' THEN 'abc' ELSE '' END AS hash FROM part WHERE p_brand < 'Brand#4' GROUP BY p_brand) c ON c.repo = r.repo AND startswith(c.hash, r.revision)""",
    "parse_strip_wrappers": f"SELECT event_id, {m.unwrapped('t')} AS content FROM (SELECT event_id, {m.without_reasoning('raw')} AS t FROM raw_json) r",
    "parse_first_label": "SELECT seq, said AS label FROM topic_parsed",
    "parse_classification": "SELECT seq, ok, label FROM topic_parsed",
    "parse_match": "SELECT seq, match, ok FROM match_parsed",
    "parse_summary": "SELECT seq, ok, CASE WHEN ok THEN length(summary) END AS chars FROM brief_parsed",
    "prompt_render": f"""
SELECT 'classification' AS kind, item_id, 'Choose one label: card payment?, Lost card, transfer, top up.' || char(10) || 'Answer with the label only.' AS system, text AS user_text FROM topic_items UNION ALL
SELECT 'extraction', item_id, 'Give a JSON object with: company, email, phone, country, seats, budget, currency, meeting, urgency.', text FROM enquiry_items UNION ALL
SELECT 'pii_redaction', item_id, 'List personal data as JSON: [{{"type": ..., "text": ...}}].', text FROM letters UNION ALL
SELECT 'summarisation', item_id, 'Summarise in at most ' || max_words || ' words.', text FROM brief_items""",
    "judge_prompt": """
SELECT p.seq, 'Facts:' || char(10) || t.facts || char(10) || 'Source:' || char(10) || i.text || char(10) || 'Summary:' || char(10) || p.summary AS prompt FROM brief_parsed p JOIN brief_items i ON i.item_id = p.item_id AND i.split = p.split
JOIN (SELECT item_id, split, array_join(transform(array_sort(collect_list(substr('000' || ix, -4) || token)), x -> CAST(CAST(substr(x, 1, 4) AS INTEGER) AS STRING) || '. ' || substr(x, 5)), char(10)) AS facts FROM brief_tokens GROUP BY item_id, split) t ON t.item_id = p.item_id AND t.split = p.split WHERE p.ok""",
    "date_header_extract": f"""
SELECT id, CASE WHEN d = '' THEN NULL ELSE regexp_extract(d, '([0-9]{{4}})$', 1) || '-' || {m.month_number("regexp_extract(d, '([A-Z][a-z]{2}) [0-9]{4}$', 1)")} || '-' || substr('0' || regexp_extract(d, '^([0-9]+)', 1), -2) END AS reference_date
FROM (SELECT id, regexp_extract(raw, '(?m)^Date: [A-Z][a-z]{{2}}, ([0-9]{{1,2}} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{{4}})', 1) AS d FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'no header' WHEN 1 THEN 'see Date: Mon, 3 Jan 2024' ELSE
  'To: x' || char(10) || 'Date: Mon, ' || day(CAST(o_orderdate AS DATE)) || ' ' || CASE month(CAST(o_orderdate AS DATE)) {' '.join(f"WHEN {i} THEN '{x[:3]}'" for i, x in enumerate(m.MONTHS, 1))} END || ' ' || year(CAST(o_orderdate AS DATE)) || char(10) || 'Hi' END AS raw FROM orders) o) x""",
    "match_item_from_input": """
SELECT id, get_json_object(raw, '$.left.name') AS left_name, get_json_object(raw, '$.right.name') AS right_name, get_json_object(raw, '$.right.vat_id') AS right_vat FROM match_inputs""",
    "user_input": "SELECT id, raw AS text FROM match_inputs UNION ALL SELECT item_id, text FROM topic_items",
    "task_alias": "SELECT DISTINCT regexp_replace(alias, '^ledgerloom/', '') AS task FROM (SELECT CASE WHEN seq % 2 = 0 THEN 'ledgerloom/' ELSE '' END || task AS alias FROM calls) c",
    "last_user_message": "SELECT conv_id, coalesce(asked, '') AS message FROM talks",
    "prediction_validity": """
SELECT c.seq, o.valid AND c.error IS NULL AS valid, coalesce(c.error, CASE WHEN NOT o.valid THEN 'no parse' END) AS error FROM calls c JOIN outcomes o ON o.seq = c.seq""",
    "provider_class": "SELECT model_id, CASE WHEN kind = 'cloud' THEN regexp_extract(provider || '/' || model_id, '^([^/]+)/', 1) ELSE kind END AS provider_class, kind IN ('local', 'baseline') AS is_local, calls FROM (SELECT m.model_id, m.kind, m.provider, s.calls FROM seen_models s JOIN models m ON m.model_id = s.model_id) x",
    "stratification_key": """
SELECT 'classification' AS task, item_id, gold AS stratum FROM topic_items UNION ALL SELECT 'entity_matching', item_id, CASE WHEN max(CASE WHEN gold_match THEN 1 ELSE 0 END) = 1 THEN 'true' ELSE 'false' END FROM match_parsed GROUP BY item_id
UNION ALL SELECT 'pii_redaction', l.item_id, CASE WHEN count(s.span) > 0 THEN 'true' ELSE 'false' END FROM letters l LEFT JOIN letter_spans s ON s.item_id = l.item_id AND s.split = l.split GROUP BY l.item_id UNION ALL SELECT task, item_id, CAST(NULL AS STRING) FROM enquiry_items""",
    "output_cap": """
SELECT d.task, coalesce(c.cap, t.cap, d.cap) AS cap, k.calls, k.longest FROM output_caps d JOIN (SELECT task, count(*) AS calls, max(completion_tokens) AS longest FROM calls GROUP BY task) k ON k.task = d.task LEFT JOIN (SELECT * FROM (VALUES ('extraction', 600), ('summarisation', 300)) AS t(task, cap)) t ON t.task = d.task LEFT JOIN (SELECT * FROM (VALUES ('summarisation', 200)) AS t(task, cap)) c ON c.task = d.task""",
    "validate_items": f"""
SELECT kind, id, errors FROM (
SELECT 'classification' AS kind, i.item_id AS id, concat_ws('; ', CASE WHEN {m.trimmed("coalesce(i.text, '')")} = '' THEN 'no text' END, CASE WHEN t.label IS NULL THEN 'unknown label' END) AS errors FROM (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN ' ' ELSE text END AS text, CASE WHEN item_id % 8 = 0 THEN 'other' ELSE gold END AS gold FROM topic_items) i LEFT JOIN topics t ON t.label = i.gold
UNION ALL SELECT 'extraction', item_id, concat_ws('; ', CASE WHEN count(gold) < 8 THEN 'missing field' END) FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 AND pos = 1 THEN NULL ELSE gold END AS gold FROM enquiry_gold) g GROUP BY item_id
UNION ALL SELECT 'pii_redaction', l.item_id, concat_ws('; ', CASE WHEN count(*) FILTER (WHERE NOT (s.s >= 0 AND s.s < s.e AND s.e <= length(l.text))) > 0 THEN 'span out of text' END, CASE WHEN count(*) FILTER (WHERE s.type NOT IN ('EMAIL', 'PHONE', 'NAME', 'IBAN', 'DATE_OF_BIRTH')) > 0 THEN 'unknown type' END)
  FROM letters l JOIN (SELECT split, item_id, CASE WHEN item_id % 5 = 0 AND type = 'NAME' THEN 'ODD' ELSE type END AS type, s, CASE WHEN item_id % 6 = 0 THEN e + 1000 ELSE e END AS e FROM letter_spans) s ON s.item_id = l.item_id AND s.split = l.split GROUP BY l.item_id
UNION ALL SELECT 'entity_matching', id, concat_ws('; ', CASE WHEN name IS NULL OR name = '' THEN 'no side' END, CASE WHEN id % 10 = 3 THEN 'no match flag' END) FROM company_records
UNION ALL SELECT 'summarisation', b.item_id, concat_ws('; ', CASE WHEN b.max_words <= 0 THEN 'no word limit' END, CASE WHEN count(t.ix) = 0 THEN 'no facts' END) FROM (SELECT item_id, split, CASE WHEN item_id % 4 = 0 THEN 0 ELSE max_words END AS max_words FROM briefs) b LEFT JOIN brief_tokens t ON t.item_id = b.item_id AND t.split = b.split GROUP BY b.item_id, b.max_words) x""",
    "dataset_validate": """
SELECT s.task, s.split, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN s.task || '/' || s.split || ': empty split' END AS error FROM (SELECT t.task, p.split FROM (SELECT DISTINCT task FROM items) t CROSS JOIN (SELECT * FROM (VALUES ('calib'), ('test'), ('train')) AS v(split)) p) s LEFT JOIN (SELECT task, split, count(*) AS n FROM items GROUP BY task, split) c ON c.task = s.task AND c.split = s.split""",
    "dataset_split_sizes": "SELECT task, count(*) FILTER (WHERE split = 'calib') AS calib, count(*) FILTER (WHERE split = 'test') AS test, CASE WHEN count(*) FILTER (WHERE split = 'train') > 0 THEN count(*) FILTER (WHERE split = 'train') END AS train FROM items GROUP BY task",
    "preflight_bad": """
SELECT seq, (pred IS NULL AND (length_stop OR reasoning > 0)) OR (length_stop AND reasoning > 0) AS bad FROM (SELECT seq, pred, k % 6 = 0 AS length_stop, k % 4 AS reasoning FROM calls) c""",
    "dataset_drift": """
SELECT r.page_id, r.old_sha, n.now_sha, n.page_id IS NULL OR n.now_sha <> r.old_sha AS drifted FROM (SELECT page_id, sha2(url, 256) AS old_sha FROM pages UNION ALL SELECT -1, 'gone') r LEFT JOIN (SELECT page_id, sha2(CASE WHEN page_id % 10 = 0 THEN url || '/' ELSE url END, 256) AS now_sha FROM pages WHERE page_id % 17 <> 5) n ON n.page_id = r.page_id""",
    # joins
    "score_join": "SELECT c.model_id, c.task, c.split, c.item_id, i.gold, c.pred FROM calls c JOIN (SELECT DISTINCT task, split, item_id, gold FROM calls) i ON c.task = i.task AND c.split = i.split AND c.item_id = i.item_id WHERE c.pass = 'A'",
    "judge_left_join": """
SELECT p.model_id, p.split, p.item_id, v.item_id IS NOT NULL AS judge_present, v.has_verdict FROM brief_parsed p LEFT JOIN verdicts v ON p.model_id = v.model_id AND p.split = v.split AND p.item_id = v.item_id WHERE p.pass = 'A'""",
    "resume_anti_join": """
SELECT i.task, i.split, i.item_id, m.model_id, p.pass FROM items i CROSS JOIN models m CROSS JOIN (SELECT * FROM (VALUES ('A')) AS t(pass)) p
LEFT ANTI JOIN (SELECT DISTINCT model_id, task, split, item_id, coalesce(pass, 'A') AS pass FROM calls WHERE k % 3 <> 0) d ON d.model_id = m.model_id AND d.task = i.task AND d.split = i.split AND d.item_id = i.item_id AND d.pass = p.pass""",
    "judge_todo": """
SELECT c.model_id, c.split, c.item_id FROM calls c LEFT ANTI JOIN verdicts j ON c.model_id = j.model_id AND c.split = j.split AND c.item_id = j.item_id LEFT ANTI JOIN (SELECT model_id FROM models WHERE kind = 'baseline') b ON b.model_id = c.model_id WHERE c.task = 'summarisation' AND c.pass = 'A'""",
    "judge_cache_split": """
SELECT w.doc_id, w.place, c.id IS NOT NULL AS cached FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) w LEFT JOIN (SELECT DISTINCT id FROM judged WHERE part <> 2) c ON c.id = w.doc_id""",
    "judge_items_join": "SELECT l.doc_id, d.n_chars, l.quality = 1 AS label_pass, d.doc_id IS NULL AS transcript_missing FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "pii_overlap_join": "SELECT seq, span, gs, ge, os, oe, same_type FROM covered",
    "key_token_agreement_rows": """
SELECT b.seq, b.ix, b.passes AS key_check, f.present AND f.right_one AS judge, b.passes = (f.present AND f.right_one) AS agree FROM brief_facts b LEFT JOIN (SELECT * FROM facts WHERE has_judge AND has_verdict) f ON f.model_id = b.model_id AND f.split = b.split AND f.item_id = b.item_id AND f.ix = b.ix WHERE b.pass = 'A'""",
    # scores
    "score_classification": "SELECT p.seq, p.ok AS valid, CASE WHEN p.ok AND p.label = i.gold THEN 1 ELSE 0 END AS correct, CASE WHEN p.ok THEN p.label END AS pred FROM topic_parsed p JOIN topic_items i ON i.item_id = p.item_id AND i.split = p.split",
    "score_matching": "SELECT m.seq, o.a AS tp, o.b AS fp, o.c AS fn FROM match_parsed m JOIN outcomes o ON o.seq = m.seq",
    "score_extraction": "SELECT seq, valid, n_fields, n_right, valid AND n_right = n_fields AND n_fields > 0 AS exact FROM field_scores",
    "score_pii": "SELECT seq, valid, gold_n, caught, pred_n, tp, zero_leak FROM span_scores",
    "score_summary": "SELECT seq, valid, n_facts, n_present, within_limit, judged, passed FROM summary_scores",
    "judge_pass_rule": "SELECT model_id, split, item_id, judged, passed, fact_recall FROM judge_passed",
    "pii_occurrences": "SELECT seq, pos, type, s, e FROM entry_places",
    "collapse_offsets": "SELECT split, item_id, spaced, size(places) AS kept, try_element_at(places, 1) - 1 AS first_place, try_element_at(places, CAST(size(places) AS INTEGER)) - 1 AS last_place FROM letter_texts",
}
relation("match_inputs", """
SELECT s.id, '{"left": {"name": "' || s.name || '", "vat_id": "' || s.vat_id || '"}, "right": {"name": "' || t.name || '", "vat_id": "' || t.vat_id || '"}}' AS raw FROM company_records s JOIN company_records t ON t.id = s.id + 1
""")
relation("seen_models", "SELECT model_id, max(kind) AS kind, count(*) AS calls FROM calls GROUP BY model_id")
#: Price lists as providers gave them over time, a row a model and day; some prices are no numbers.
relation("price_snapshots", """
SELECT o.o_orderkey AS seq, o.o_orderdate AS taken, m.provider AS base_url, m.model_id, CASE WHEN o.o_orderkey % 23 = 0 THEN 'bad' ELSE CAST(m.prompt_price * (900 + o.o_orderkey % 200) / 1000 AS STRING) END AS prompt, CAST(m.completion_price AS STRING) AS completion
FROM orders o JOIN models m ON m.pos = 2 + o.o_orderkey % 4 WHERE m.kind = 'cloud'
""")
relation("output_caps", "SELECT * FROM (VALUES ('classification', 16), ('entity_matching', 16), ('extraction', 400), ('pii_redaction', 500), ('summarisation', 350)) AS t(task, cap)")
