"""Adapter relations: items and raw answers of the five kinds of task, with texts and gold values made from the tables.

Answers are what models would write: labels with quotes and reasons, JSON in fences and prose, reasoning blocks, errors.
Everything is parsed and scored from there.
"""

from __future__ import annotations

from ..functions import macros as m
from ..sql import computed, relation
from . import views  # noqa: F401

# --- classification: the topic of a ticket ---
relation("topics", "SELECT * FROM (VALUES (0, 'card payment?'), (1, 'Lost card'), (2, 'transfer'), (3, 'top up')) AS t(topic, label)")
relation("topic_items", """
SELECT i.task, i.split, i.item_id, t.label AS gold, 'My question is on ' || CASE i.item_id % 7 WHEN 6 THEN 'something else' ELSE lower(t.label) END || ', number ' || i.item_id AS text
FROM (SELECT DISTINCT task, split, item_id, gold FROM calls WHERE task = 'classification') i JOIN topics t ON t.topic = i.gold
""")
relation("topic_answers", """
SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, c.error, CASE c.k % 8 WHEN 0 THEN '```' || char(10) || upper(t.label) || char(10) || '```' WHEN 1 THEN ' "' || t.label || '." ' || char(10) || 'as it says so'
  WHEN 2 THEN '<think>is it ' || coalesce(t.label, '') || '?</think>' || char(10) || '  ' || lower(t.label) || '!' WHEN 3 THEN 'none of these' WHEN 4 THEN CASE WHEN c.pred IS NULL THEN ' .. ' ELSE t.label END ELSE t.label END AS raw
FROM calls c LEFT JOIN topics t ON t.topic = c.pred WHERE c.task = 'classification'
""")
relation("topic_parsed", f"""
SELECT seq, model_id, kind, split, pass, item_id, error, said, l.label AS label, l.label IS NOT NULL AND error IS NULL AS ok
FROM (SELECT *, {m.label_line('content')} AS said FROM (SELECT *, {m.unwrapped('t')} AS content FROM (SELECT *, {m.without_reasoning("coalesce(raw, '')")} AS t FROM topic_answers) a) b) c
LEFT JOIN topics l ON {m.folded_label('l.label')} = lower(c.said)
""")

# --- extraction: fields of an enquiry ---
relation("fields", """
SELECT * FROM (VALUES (0, 'company', 'string', TRUE, TRUE, NULL), (1, 'email', 'email', FALSE, FALSE, NULL), (2, 'phone', 'phone', FALSE, FALSE, NULL), (3, 'country', 'country', TRUE, FALSE, NULL), (4, 'seats', 'int', FALSE, FALSE, NULL),
  (5, 'budget', 'amount', FALSE, FALSE, NULL), (6, 'currency', 'currency', FALSE, FALSE, 'USD|EUR|GBP'), (7, 'meeting', 'date', FALSE, FALSE, NULL), (8, 'urgency', 'enum', TRUE, FALSE, 'low|medium|high')) AS t(pos, field, type, required, grounded, allowed)
""")
relation("enquiries", """
SELECT task, split, item_id, 'Company ' || n || ' Ltd' AS company, 'office' || n || '@firm' || n % 9 || '.example.com' AS email, '+44 7700 9' || substr('00000' || n, -5) AS phone, CASE n % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' ELSE 'CA' END AS country,
  CAST(1 + n % 90 AS STRING) AS seats, CAST(1000 * (1 + n % 60) AS STRING) AS budget, CASE n % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency, CAST(CAST('2024-01-01' AS DATE) + CAST(n % 300 AS INTEGER) AS STRING) AS meeting,
  CASE n % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS urgency, '2024-01-01' AS reference_date, n
FROM (SELECT DISTINCT task, split, item_id, item_id AS n FROM calls WHERE task = 'extraction') i
""")
relation("enquiry_items", """
SELECT task, split, item_id, reference_date, 'Date: Mon, 1 Jan 2024' || char(10) || 'We at ' || company || ' write from ' || CASE n % 6 WHEN 0 THEN 'Great Britain' WHEN 1 THEN 'the USA' WHEN 2 THEN 'Canada' WHEN 3 THEN 'GB' WHEN 4 THEN 'abroad, ring 212-555-0100,' ELSE 'far away' END
  || '. Mail ' || email || ' or ring 07700 9' || substr('00000' || n, -5) || '. We need ' || seats || ' seats, budget ' || currency || ' ' || CASE n % 2 WHEN 0 THEN substr(budget, 1, length(budget) - 3) || 'k' ELSE substr(budget, 1, length(budget) - 3) || ',000.00' END || '. Urgency is ' || urgency || ', let us meet on ' || meeting || '.' AS text FROM enquiries
""")
_GOLD = "CASE f.field WHEN 'company' THEN e.company WHEN 'email' THEN e.email WHEN 'phone' THEN e.phone WHEN 'country' THEN e.country WHEN 'seats' THEN e.seats WHEN 'budget' THEN e.budget WHEN 'currency' THEN e.currency WHEN 'meeting' THEN CASE WHEN e.n % 11 = 0 THEN NULL ELSE e.meeting END ELSE e.urgency END"
relation("enquiry_gold", f"SELECT e.split, e.item_id, f.pos, f.field, f.type, f.required, f.grounded, f.allowed, {_GOLD} AS gold FROM enquiries e CROSS JOIN fields f")
relation("enquiry_said", f"""
SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, c.error, c.valid AS ok, f.pos, f.field, f.type, f.required, f.grounded, f.allowed, f.gold, CASE WHEN NOT c.valid THEN NULL
  WHEN f.field = 'company' THEN CASE WHEN c.k % 7 = 0 THEN ' company  ' || c.item_id || ' LTD ' WHEN c.k % 13 = 0 THEN 'Another Firm' ELSE f.gold END
  WHEN f.field = 'email' THEN upper(f.gold) WHEN f.field = 'phone' THEN CASE WHEN c.k % 5 = 0 THEN '07700 9' || substr('00000' || c.item_id, -5) ELSE f.gold END
  WHEN f.field = 'country' THEN CASE WHEN c.k % 11 = 0 THEN NULL WHEN f.gold = 'GB' AND c.k % 2 = 0 THEN 'United Kingdom' WHEN c.k % 9 = 0 THEN 'CA' ELSE f.gold END
  WHEN f.field = 'seats' THEN CASE WHEN c.k % 6 = 0 THEN 'many' ELSE ' ' || f.gold END WHEN f.field = 'budget' THEN CASE WHEN c.k % 4 = 0 THEN 'about ' || f.gold || '.004' WHEN c.k % 10 = 1 THEN '99999' ELSE f.gold || '.0' END
  WHEN f.field = 'currency' THEN lower(f.gold) WHEN f.field = 'meeting' THEN CASE WHEN c.k % 8 = 1 THEN 'Next Tuesday' WHEN c.k % 8 = 2 THEN '2024-02-30' ELSE f.gold || 'T10:00:00Z' END ELSE CASE WHEN c.k % 12 = 5 THEN 'URGENT' ELSE upper(f.gold) END END AS said
FROM calls c JOIN enquiry_gold f ON f.item_id = c.item_id WHERE c.task = 'extraction'
""")
relation("enquiry_fields", f"SELECT *, {m.normal_field('type', 'gold', 'allowed')} AS gold_value, {m.normal_field('type', 'said', 'allowed')} AS said_value FROM enquiry_said")
relation("field_scores", """
SELECT seq, model_id, kind, split, pass, item_id, ok AS valid, count(*) AS n_fields, count(*) FILTER (WHERE ok AND gold_value IS NOT DISTINCT FROM said_value) AS n_right
FROM enquiry_fields GROUP BY seq, model_id, kind, split, pass, item_id, ok
""")

# --- personal data: spans of a letter ---
relation("letters", """
SELECT split, item_id, text, name, mail, phone, birth FROM (SELECT *, 'Dear ' || name || ',' || char(10) || char(10) || 'write to ' || mail || ' or  ring ' || phone || '. Opened on 21/08/2023. Born on ' || birth || ' in town.' || char(10) || 'Switchboard: +44 20 7946 0' || substr('000' || item_id % 1000, -3) || '. Pay to '
  || CASE WHEN item_id % 2 = 0 THEN 'GB82WEST12345698765432' ELSE 'GB82WEST12345698765433' END || '. Yours, Ann' || char(9) || ' Lee' || item_id || ' (' || mail || ')' AS text
FROM (SELECT DISTINCT split, item_id, 'Ann Lee' || item_id AS name, 'ann' || item_id || '@mail' || item_id % 7 || '.example.org' AS mail, '+44 7700 9' || substr('00000' || item_id, -5) AS phone, '1' || (900 + item_id % 99) || '-03-1' || item_id % 10 AS birth FROM calls WHERE task = 'pii_redaction') i) x
""")
relation("letter_texts", f"""
SELECT *, {m.kept_places('text')} AS places,
  regexp_replace(regexp_replace(text, '^[{m.WS}]+', ''), '[{m.WS}]+', ' ' /*g*/) AS spaced FROM letters
""")
relation("letter_spans", """
SELECT split, item_id, row_number() OVER (PARTITION BY split, item_id ORDER BY type, s) AS span, type, s, e FROM (
  SELECT split, item_id, 'EMAIL' AS type, position(mail IN text) - 1 AS s, position(mail IN text) - 1 + length(mail) AS e FROM letters UNION ALL
  SELECT split, item_id, 'PHONE', position(phone IN text) - 1, position(phone IN text) - 1 + length(phone) FROM letters UNION ALL
  SELECT split, item_id, 'NAME', position(name IN text) - 1, position(name IN text) - 1 + length(name) FROM letters UNION ALL
  SELECT split, item_id, 'NAME', position('Yours, Ann' IN text) + 6, position('Yours, Ann' IN text) + 7 + length(name) FROM letters UNION ALL
  SELECT split, item_id, 'DATE_OF_BIRTH', position(birth IN text) - 1, position(birth IN text) - 1 + length(birth) FROM letters) x
""")
relation("letter_entries", """
SELECT * FROM (SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, p.pos, CASE p.pos WHEN 0 THEN 'EMAIL' WHEN 1 THEN CASE WHEN c.k % 5 = 0 THEN 'IBAN' ELSE 'PHONE' END WHEN 2 THEN 'NAME' WHEN 3 THEN 'EMAIL' WHEN 4 THEN 'EMAIL' WHEN 5 THEN 'IBAN' ELSE 'DATE_OF_BIRTH' END AS type,
  CASE p.pos WHEN 0 THEN l.mail WHEN 1 THEN CASE WHEN c.k % 4 = 0 THEN substr(l.phone, 1, 12) ELSE '  ' || l.phone END WHEN 2 THEN CASE WHEN c.k % 3 = 0 THEN NULL ELSE 'Ann  ' || substr(l.name, 5) END WHEN 3 THEN CASE WHEN c.k % 7 = 0 THEN 'nobody@else.example.net' END
    WHEN 4 THEN CASE WHEN c.k % 6 = 0 THEN l.mail END WHEN 5 THEN CASE WHEN l.item_id % 2 = 0 AND c.k % 3 <> 1 THEN 'GB82WEST12345698765432' END ELSE CASE WHEN c.k % 9 <> 0 THEN l.birth END END AS text
FROM calls c JOIN letters l ON l.item_id = c.item_id AND l.split = c.split CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS t(pos)) p WHERE c.task = 'pii_redaction' AND c.valid) x WHERE text IS NOT NULL
""")
relation("entry_texts", f"SELECT *, {m.one_spaced('text')} AS wanted FROM letter_entries")
relation("entry_places", f"""
SELECT seq, model_id, kind, split, pass, item_id, pos, type, try_element_at(places, CAST(place AS INTEGER)) - 1 AS s, try_element_at(places, CAST(place + length(wanted) - 1 AS INTEGER)) AS e FROM (
SELECT e.seq, e.model_id, e.kind, e.split, e.pass, e.item_id, e.pos, e.type, e.wanted, l.places, explode({m.occurrences('l.spaced', 'e.wanted')}) AS place FROM entry_texts e JOIN letter_texts l ON l.item_id = e.item_id AND l.split = e.split WHERE e.wanted <> '') x
""")
relation("covered", """
SELECT o.seq, o.pos, g.span, o.type = g.type AS same_type, g.s AS gs, g.e AS ge, o.s AS os, o.e AS oe FROM entry_places o JOIN letter_spans g ON g.item_id = o.item_id AND g.split = o.split AND 5 * (least(o.e, g.e) - greatest(o.s, g.s)) >= 4 * (g.e - g.s)
""")
relation("span_scores", """
SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, c.valid, g.gold_n, coalesce(h.caught, 0) AS caught, coalesce(p.pred_n, 0) AS pred_n, coalesce(t.tp, 0) AS tp, coalesce(h.caught, 0) = g.gold_n AS zero_leak
FROM calls c JOIN (SELECT item_id, split, count(*) AS gold_n FROM letter_spans GROUP BY item_id, split) g ON g.item_id = c.item_id AND g.split = c.split
LEFT JOIN (SELECT seq, count(DISTINCT span) AS caught FROM covered GROUP BY seq) h ON h.seq = c.seq LEFT JOIN (SELECT seq, count(*) AS pred_n FROM letter_entries GROUP BY seq) p ON p.seq = c.seq
LEFT JOIN (SELECT seq, count(DISTINCT pos) AS tp FROM covered WHERE same_type GROUP BY seq) t ON t.seq = c.seq WHERE c.task = 'pii_redaction'
""")

# --- entity matching: two records of companies ---
relation("company_records", """
SELECT s_suppkey AS id, s_name AS name, (s_suppkey % 40) || ' Market Street' AS street, 'P' || s_suppkey % 17 || ' ' || s_nationkey AS postcode, 'City ' || s_nationkey AS city, n_name AS country, 'firm' || s_suppkey || '.example.com' AS domain, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'V' || s_suppkey % 60 END AS vat_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '+1 (204) 555-0' || (100 + s_suppkey % 90) END AS phone, s_nationkey AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
relation("match_answers", """
SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, c.error, c.valid, c.gold % 2 = 1 AS gold_match, CASE c.k % 6 WHEN 0 THEN '{"match": ' || said || '}' WHEN 1 THEN '```json' || char(10) || '{"why": "names", "match": ' || said || '}' || char(10) || '```' WHEN 2 THEN '{"match": "' || said || '"}'
  WHEN 3 THEN 'I think {"match":' || said || ', "sure": 1} is right' WHEN 4 THEN CASE WHEN c.pred IS NULL THEN 'yes' ELSE '{"match" : ' || said || '}' END ELSE '<think>{"match": true}</think>{"match":' || said || '}' END AS raw
FROM (SELECT *, CASE WHEN coalesce(pred, 0) % 2 = 1 THEN 'true' ELSE 'false' END AS said FROM calls WHERE task = 'entity_matching') c
""")
_PAIR = '(?s)[{][^{}]*"match"[ \t\n\r]*:[ \t\n\r]*(true|false)[ \t\n\r]*[,}]'
relation("match_parsed", f"""
SELECT *, CASE WHEN found = '' THEN NULL ELSE found = 'true' END AS match, found <> '' AND error IS NULL AS ok FROM (SELECT *, regexp_extract(content, '{_PAIR}', 1) AS found FROM (SELECT *, {m.unwrapped('t')} AS content FROM (SELECT *, {m.without_reasoning('raw')} AS t FROM match_answers) a) b) c
""")

# --- summaries of conversations ---
relation("talks", """
SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'assistant') AS summary, max_by(text, turn) FILTER (WHERE role = 'user') AS asked, count(*) AS turns FROM conversations GROUP BY conv_id
""")
relation("briefs", """
SELECT split, item_id, 40 AS max_words, 'Owner' || n % 97 AS owner, CASE n % 3 WHEN 0 THEN '$' || (1 + n % 40) || ',500' WHEN 1 THEN (1 + n % 40) || '.5k' ELSE '€ ' || (1 + n % 40) || '500' END AS amount, CAST(1 + n % 28 AS STRING) || CASE n % 4 WHEN 0 THEN ' April' WHEN 1 THEN ' Sept' WHEN 2 THEN ' december' ELSE ' May' END AS day,
  CASE n % 5 WHEN 0 THEN 'the end of the month' ELSE 'the board' END AS phrase, n FROM (SELECT DISTINCT split, item_id, item_id AS n FROM calls WHERE task = 'summarisation') i
""")
relation("brief_items", """
SELECT split, item_id, max_words, 'Ana: ' || owner || ' will pay ' || amount || ' until ' || day || ' 2024.' || char(10) || 'Ben: I will tell ' || phrase || ' before 21/08/2023, ticket 7734.' AS text FROM briefs
""")
relation("brief_tokens", """
SELECT split, item_id, 0 AS ix, 'owner' AS token_kind, owner AS token FROM briefs UNION ALL SELECT split, item_id, 1, 'amount', amount FROM briefs UNION ALL SELECT split, item_id, 1, 'owner', owner FROM briefs
UNION ALL SELECT split, item_id, 2, 'date', day FROM briefs UNION ALL SELECT split, item_id, 3, 'fact', phrase FROM briefs
""")
relation("brief_answers", """
SELECT c.seq, c.model_id, c.kind, c.split, c.pass, c.item_id, c.error, b.max_words, b.n, CASE c.k % 11 WHEN 0 THEN ' ' || char(10) WHEN 1 THEN '<think>' || b.owner WHEN 2 THEN '```' || char(10) || s || char(10) || '```' ELSE '<think>short</think>' || char(10) || s || CASE WHEN c.k % 7 = 2 THEN replace(' and so on, to be sure, once more', ' ', '  again ') || ' for all of the people who asked about this matter on that day or any other' ELSE '' END END AS raw
FROM (SELECT c.*, CASE c.k % 3 WHEN 0 THEN lower(b.owner) ELSE b.owner END || CASE WHEN c.k % 5 = 0 THEN ' gives something' ELSE ' gives ' || CASE c.k % 4 WHEN 0 THEN b.amount WHEN 1 THEN CAST(1 + b.n % 40 AS STRING) || ',500.00' WHEN 2 THEN CAST(1 + b.n % 40 AS STRING) || '.5K' ELSE '$' || (1 + b.n % 40) || '500' END END
  || ' by ' || CASE c.k % 6 WHEN 0 THEN b.day WHEN 1 THEN 'April ' || (1 + b.n % 28) WHEN 2 THEN (1 + b.n % 28) || '/12' WHEN 3 THEN '2024-05-' || substr('0' || (1 + b.n % 28), -2) WHEN 4 THEN 'then, ref 4711' ELSE b.day || ' 2024' END || ' for ' || CASE WHEN c.k % 8 = 0 THEN 'all' ELSE b.phrase END AS s FROM calls c JOIN briefs b ON b.item_id = c.item_id AND b.split = c.split WHERE c.task = 'summarisation') c
JOIN briefs b ON b.item_id = c.item_id AND b.split = c.split
""")
relation("brief_parsed", f"""
SELECT seq, model_id, kind, split, pass, item_id, error, max_words, content AS summary, content <> '' AND error IS NULL AS ok, {m.words('content')} AS n_words FROM (SELECT *, {m.unwrapped('t')} AS content FROM (SELECT *, {m.without_reasoning('raw')} AS t FROM brief_answers) a) b
""")
_CHECKED = "p.seq, p.model_id, p.kind, p.split, p.pass, p.item_id, t.ix, t.token_kind, t.token, p.summary, p.ok, contains(lower(p.summary), lower(t.token)) AS stands"
computed("token_checks", f"""
SELECT {_CHECKED}, {m.token_passes('t.token_kind', 't.token', 'p.summary')} AS passes
FROM brief_parsed p JOIN brief_tokens t ON t.item_id = p.item_id AND t.split = p.split
""", lambda run: run(f"""
SELECT {_CHECKED}, {m.states('t', 'p', 'summary')} AS passes
FROM (SELECT seq, model_id, kind, split, pass, item_id, summary, ok, {m.stated('summary')} FROM brief_parsed) p JOIN (SELECT split, item_id, ix, token_kind, token, {m.meant('token_kind', 'token')} FROM brief_tokens) t ON t.item_id = p.item_id AND t.split = p.split
"""))
#: What a judge said of each fact, where it was asked and its verdict could be read.
relation("facts", """
SELECT c.model_id, c.task, c.split, c.item_id, f.ix, (c.k + f.ix) % 19 <> 0 AS present, (c.k + f.ix) % 23 <> 0 AS right_one, CASE WHEN c.k % 14 = 0 THEN 1 + c.k % 2 ELSE 0 END AS claims, c.k % 13 <> 0 AS has_judge, c.k % 29 <> 3 AS has_verdict
FROM calls c CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(ix)) f WHERE c.task = 'summarisation' AND c.kind <> 'baseline' AND c.pass = 'A'
""")
relation("verdicts", """
SELECT model_id, split, item_id, bool_and(has_verdict) AS has_verdict, count(*) FILTER (WHERE present AND right_one) AS n_good, max(claims) AS claims FROM facts WHERE has_judge GROUP BY model_id, split, item_id
""")
relation("brief_facts", """
SELECT seq, model_id, kind, split, pass, item_id, ok, ix, bool_and(stands) AS stands, bool_and(passes) AS passes FROM token_checks GROUP BY seq, model_id, kind, split, pass, item_id, ok, ix
""")
relation("summary_scores", """
SELECT p.seq, p.model_id, p.kind, p.split, p.pass, p.item_id, p.ok AS valid, f.n_facts, CASE WHEN p.ok THEN f.n_present ELSE 0 END AS n_present, p.ok AND p.n_words <= p.max_words AS within_limit, v.item_id IS NOT NULL AS judged,
  CASE WHEN v.item_id IS NULL THEN NULL ELSE p.ok AND v.has_verdict AND v.n_good >= ceil(0.8e0 * f.n_facts) AND v.claims = 0 AND p.n_words <= p.max_words END AS passed,
  CASE WHEN v.item_id IS NULL OR f.n_facts = 0 THEN NULL WHEN NOT p.ok OR NOT v.has_verdict THEN 0e0 ELSE v.n_good / CAST(f.n_facts AS DOUBLE) END AS fact_recall
FROM brief_parsed p JOIN (SELECT seq, count(*) AS n_facts, count(*) FILTER (WHERE stands) AS n_present FROM brief_facts GROUP BY seq) f ON f.seq = p.seq LEFT JOIN verdicts v ON v.model_id = p.model_id AND v.split = p.split AND v.item_id = p.item_id AND p.pass = 'A'
""")
relation("judge_passed", "SELECT model_id, split, item_id, judged, coalesce(passed, FALSE) AS passed, fact_recall, within_limit, valid FROM summary_scores WHERE pass = 'A' AND kind <> 'baseline'")
