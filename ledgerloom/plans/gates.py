"""Evidence gates: what an answer must show before a chain stops at it.

Each kind's relation reads the parsed answer and its source text and gives (seq, passed, reason). What needs more than SQL
(a close but not literal match, learnt baselines) comes in as relations that can be replaced: ``grounded_more``,
``topic_baseline``; ``frames`` fills them with the full functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import dates, similarity  # noqa: F401  dates has the days that phrases mean
from ..functions import macros as m
from ..functions import text as t
from ..operators import aggregates, scoring  # noqa: F401
from ..sql import computed, relation

#: Predictions that a gate compares with: of the baseline trained for labels, and of the similarity of pairs, tuned on calib.
relation("topic_baseline", "SELECT item_id, split, label AS base_label FROM topic_parsed WHERE kind = 'baseline' AND ok")
relation("gate_topics", """
SELECT p.seq, CASE WHEN NOT p.ok THEN FALSE WHEN p.kind = 'baseline' OR b.base_label IS NULL THEN TRUE ELSE b.base_label = p.label END AS passed,
  CASE WHEN NOT p.ok THEN 'invalid_label' WHEN p.kind = 'baseline' THEN NULL WHEN b.base_label IS NULL THEN 'baseline_unavailable' WHEN b.base_label <> p.label THEN 'disagrees_with_baseline' END AS reason FROM topic_parsed p LEFT JOIN topic_baseline b ON b.item_id = p.item_id AND b.split = p.split
""")
relation("match_pairs", f"""
SELECT i.item_id, i.split, i.gold_match, {", ".join(f"s.{f} AS l_{f}, t.{f} AS r_{f}" for f in similarity.WEIGHTS)} FROM (SELECT DISTINCT item_id, split, gold_match FROM match_answers) i
CROSS JOIN (SELECT max(s_suppkey) AS last FROM supplier) z JOIN company_records s ON s.id = 1 + i.item_id % (z.last - 1) JOIN company_records t ON t.id = s.id + 1
""")
_PAIR_KEYS = ["item_id", "split", "gold_match"]


def _similarities(run: Callable[[str], DataFrame]) -> DataFrame:
    """Pairs are small and take long to compare, so they are dealt to all cores; by their bytes they would be one task's."""
    cores = SparkSession.active().sparkContext.defaultParallelism
    return run(similarity.scored(f"(SELECT /*+ REPARTITION({2 * cores}) */ * FROM match_pairs)", _PAIR_KEYS))


computed("pair_similarity", similarity.scored("match_pairs", _PAIR_KEYS), _similarities)
relation("match_band", "SELECT threshold, band_low, band_high FROM pair_tuned")
relation("gate_pairs", """
SELECT p.seq, CASE WHEN NOT p.ok THEN FALSE WHEN p.kind = 'baseline' OR s.score IS NULL OR s.score BETWEEN b.band_low AND b.band_high THEN TRUE ELSE p.match = (s.score >= b.threshold) END AS passed,
  CASE WHEN NOT p.ok THEN 'invalid_match_json' WHEN p.kind = 'baseline' THEN NULL WHEN s.score IS NULL THEN 'baseline_unavailable' WHEN s.score BETWEEN b.band_low AND b.band_high THEN 'inside_uncertainty_band' WHEN p.match <> (s.score >= b.threshold) THEN 'disagrees_with_baseline' END AS reason
FROM match_parsed p LEFT JOIN pair_similarity s ON s.item_id = p.item_id AND s.split = p.split CROSS JOIN match_band b
""")
t.country_relation("country_hits", "enquiry_items", ["split", "item_id"])
#: Values that stand in their source but for a few letters: from ``frames``.
relation("grounded_more", "SELECT CAST(NULL AS BIGINT) AS seq, CAST(NULL AS STRING) AS field WHERE FALSE")


def _evidence(items: str, low: str, numbers: str, thousands: str, marked: str) -> str:
    """Why a field has no evidence, by expressions over what items has of a text."""
    return f"""
SELECT f.seq, f.pos, CASE WHEN f.said IS NULL THEN CASE WHEN f.required THEN 'missing_required:' || f.field END
  WHEN f.grounded THEN CASE WHEN {m.one_spaced('f.said')} <> '' AND (contains({low}, lower({m.one_spaced('f.said')})) OR g.seq IS NOT NULL) THEN NULL ELSE 'ungrounded:' || f.field END
  WHEN f.type = 'phone' THEN CASE WHEN NOT {t.digits_in('f.said', 'i.text', numbers)} THEN 'phone_not_in_source:' || f.field END
  WHEN f.type = 'country' THEN CASE WHEN h.code IS NULL AND NOT {m.has_words(marked, 'upper(trim(f.said))')} THEN 'country_not_in_source:' || f.field END
  WHEN f.type = 'date' THEN CASE WHEN i.reference_date IS NOT NULL AND d.day IS NULL THEN 'date_not_rederivable:' || f.field END
  WHEN f.type = 'enum' THEN CASE WHEN size(filter(split(f.allowed, '[|]'), a -> lower(a) = lower(trim(f.said)))) = 0 THEN 'not_in_enum:' || f.field END
  WHEN f.type = 'amount' THEN CASE WHEN NOT {t.amount_in('f.said', 'i.text', numbers, thousands)} THEN 'amount_not_in_source:' || f.field END END AS reason
FROM enquiry_said f JOIN {items} i ON i.item_id = f.item_id AND i.split = f.split LEFT JOIN country_hits h ON f.type = 'country' AND h.item_id = f.item_id AND h.split = f.split AND h.code = upper(trim(f.said))
LEFT JOIN (SELECT DISTINCT split, item_id, day FROM dates_derived) d ON f.type = 'date' AND d.item_id = f.item_id AND d.split = f.split AND d.day = {m.iso_date('f.said')} LEFT JOIN (SELECT DISTINCT seq, field FROM grounded_more) g ON g.seq = f.seq AND g.field = f.field WHERE f.ok
"""


#: A text's patterns run once an item in Spark, not once a field and model.
_ITEMS = f"""(SELECT split, item_id, reference_date, lower({m.one_spaced('text')}) AS low, {m.digits('text')} AS numbers, {t.thousands_in('text')} AS thousands, {m.marked_text('text')} AS marked FROM enquiry_items)"""
computed(
    "enquiry_evidence",
    _evidence("enquiry_items", f"lower({m.one_spaced('i.text')})", m.digits("i.text"), t.thousands_in("i.text"), m.marked_text("i.text")),
    lambda run: run(_evidence(_ITEMS, "i.low", "i.numbers", "i.thousands", "i.marked")),
)
relation("gate_enquiries", """
SELECT seq, reason IS NULL AS passed, reason FROM (SELECT seq, min_by(reason, pos) FILTER (WHERE reason IS NOT NULL) AS reason FROM enquiry_evidence GROUP BY seq) x UNION ALL SELECT DISTINCT seq, FALSE, 'invalid_json' FROM enquiry_said WHERE NOT ok
""")
relation("letter_found", t.found_pii("letters", "split, item_id"))
relation("letter_missed", """
SELECT DISTINCT c.seq FROM calls c JOIN letter_found f ON f.item_id = c.item_id AND f.split = c.split LEFT JOIN entry_texts e ON e.seq = c.seq AND (contains(lower(e.wanted), lower(f.text)) OR contains(lower(f.text), lower(e.wanted))) WHERE c.task = 'pii_redaction' AND c.valid AND e.seq IS NULL
""")
relation("letter_stray", "SELECT DISTINCT e.seq FROM entry_texts e JOIN letter_texts l ON l.item_id = e.item_id AND l.split = e.split WHERE e.wanted = '' OR NOT contains(lower(l.spaced), lower(e.wanted))")
relation("gate_letters", """
SELECT c.seq, c.valid AND (c.kind = 'baseline' OR (s.seq IS NULL AND m.seq IS NULL)) AS passed, CASE WHEN NOT c.valid THEN 'invalid_json' WHEN c.kind = 'baseline' THEN NULL WHEN s.seq IS NOT NULL THEN 'predicted_span_not_in_text' WHEN m.seq IS NOT NULL THEN 'regex_baseline_span_missed' END AS reason
FROM calls c LEFT JOIN letter_stray s ON s.seq = c.seq LEFT JOIN letter_missed m ON m.seq = c.seq WHERE c.task = 'pii_redaction'
""")
#: Fixed value: words of a summary whose task names no limit.
MAX_WORDS = 120
_NUMBERS = "transform(regexp_extract_all(p.summary, '[0-9][0-9,]*(?:[.][0-9]+)?', 0), x -> regexp_replace(x, '[^0-9]', '' /*g*/))"
relation("gate_briefs", f"""
SELECT seq, reason IS NULL AS passed, reason FROM (SELECT p.seq, CASE WHEN NOT p.ok THEN 'empty_summary' WHEN p.n_words > coalesce(nullif(p.max_words, 0), {MAX_WORDS}) THEN 'over_word_limit' WHEN size(filter({_NUMBERS}, x -> length(x) >= 2 AND NOT contains({m.digits('i.text')}, x))) > 0 THEN 'number_not_in_source'
  WHEN size(filter(regexp_extract_all(p.summary, '{t.WRITTEN_DATE}', 0), x -> NOT contains(lower({m.one_spaced('i.text')}), lower({m.one_spaced('x')})))) > 0 THEN 'date_not_in_source' END AS reason FROM brief_parsed p JOIN brief_items i ON i.item_id = p.item_id AND i.split = p.split) x
""")
relation("gate_results", """
SELECT c.seq, c.model_id, c.task, c.split, c.item_id, g.passed, g.reason FROM calls c JOIN (SELECT seq, passed, reason FROM gate_topics UNION ALL SELECT seq, passed, reason FROM gate_pairs UNION ALL SELECT seq, passed, reason FROM gate_enquiries UNION ALL SELECT seq, passed, reason FROM gate_letters UNION ALL SELECT seq, passed, reason FROM gate_briefs) g ON g.seq = c.seq WHERE c.pass = 'A'
""")

QUERIES = {
    "gate_classification": "SELECT seq, passed, reason FROM gate_topics",
    "gate_matching": "SELECT seq, passed, reason FROM gate_pairs",
    "gate_extraction": "SELECT seq, passed, reason FROM gate_enquiries",
    "gate_field_evidence": "SELECT seq, pos, reason FROM enquiry_evidence",
    "gate_pii": "SELECT seq, passed, reason FROM gate_letters",
    "gate_summary": "SELECT seq, passed, reason FROM gate_briefs",
    "gate_results": "SELECT seq, model_id, task, passed, reason FROM gate_results",
    "gate_thresholds": "SELECT threshold, round(band_low, 9) AS band_low, round(band_high, 9) AS band_high FROM match_band",
}
