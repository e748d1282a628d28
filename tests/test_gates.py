"""Gates by hand: literal words with any sign, countries, dates, limits, labels before numbers, replay of unserved items."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog, sql
from ledgerloom.functions import fuzzy, similarity
from ledgerloom.functions import macros as m
from ledgerloom.functions import text as t
from ledgerloom.plans import gates

SAID = "seq long, model_id string, kind string, split string, pass string, item_id long, error string, ok boolean, pos int, field string, type string, required boolean, grounded boolean, allowed string, gold string, said string"
ITEMS = "task string, split string, item_id long, reference_date string, text string"


def evidence(spark, rows):
    """Reasons of (type, text, answer) rows."""
    said = spark.createDataFrame([(i, "m", "local", "test", "A", i, None, True, 0, "f", kind, True, False, "low|high", None, answer) for i, (kind, _, answer) in enumerate(rows)], SAID)
    items = spark.createDataFrame([("extraction", "test", i, "2024-01-01", text) for i, (_, text, _) in enumerate(rows)], ITEMS)
    got = sql.run(spark, "", "SELECT seq, reason FROM enquiry_evidence", {"enquiry_said": said, "enquiry_items": items, "calls": said.limit(0).withColumn("task", F.lit("x"))})
    found = dict(map(tuple, got.collect()))
    return [found[i] for i in range(len(rows))]


def test_words_between_boundaries_equal_an_escaped_pattern(spark):
    rng, signs = random.Random(5), "ab_1é日 .,()[]+*?\\^$|{}-\n\x01\x02"
    pairs = []
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        start = rng.randrange(len(text) + 1)
        word = text[start : start + rng.randrange(1, 5)] if rng.random() < 0.7 else "".join(rng.choice(signs) for _ in range(rng.randrange(4)))
        pairs.append((text, word, bool(word and re.search(rf"\b{re.escape(word)}\b", text))))
    df = spark.createDataFrame(pairs, "x string, y string, want boolean")
    assert df.filter(f"want <> {m.whole_word('x', 'y')}").collect() == [] and 50 < sum(w for *_, w in pairs) < 3900


def test_answers_with_every_sign(spark):
    rows = [("country", f"we ship to UK{c} and on", f"UK{c}Great Britain") for c in string.punctuation + " "] + [("country", "we write from UxKx", "U.K."), ("country", "the U.K.s office", "U.K."), ("country", "in (GB", "GB")]
    got = evidence(spark, rows)
    assert got[:-3] == ["country_not_in_source:f"] * (len(rows) - 3) and got[-3:] == ["country_not_in_source:f", None, None]
    whole = [("country", f"from UK{c}GREAT BRITAIN now", f"uk{c}Great Britain") for c in string.punctuation]
    assert evidence(spark, whole) == [None] * len(whole)


def test_country_evidence(spark):
    rows = [("please reach us", "US", False), ("please reach US", "US", True), ("united states of america", "US", True), ("united  states", "US", False), ("THE NETHERLANDS", "NL", True), ("call +44 20", "GB", True), ("00 1 204", "CA", True), ("call 212-555-0100", "US", True), ("in franced", "FR", False), ("in_FRANCE", "FR", False), ("uk", "GB", False)]
    got = evidence(spark, [("country", text, code) for text, code, _ in rows])
    assert [r is None for r in got] == [want for *_, want in rows]
    plan = sql.run(spark, "", "SELECT * FROM country_text_hits", {"country_texts": spark.createDataFrame([(1, "x")], "c_custkey long, text string")})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fields_of_other_types(spark):
    rows = [("phone", "ring 07700 900123", "+44 7700 900123", None), ("phone", "ring 1", "22", "phone_not_in_source:f"), ("amount", "about 12k", "12000.0", None), ("amount", "about 12k", "13000", "amount_not_in_source:f"), ("enum", "x", " HIGH ", None), ("enum", "x", "mid", "not_in_enum:f"), ("country", "x", None, "missing_required:f"), ("date", "on 2024-02-03", "2024-02-03", None), ("date", "on 2024-02-03", "2024-02-04", "date_not_rederivable:f")]
    assert evidence(spark, [r[:3] for r in rows]) == [r[3] for r in rows]


def brief(spark, summary, source, limit=9):
    parsed = spark.createDataFrame([(1, "m", "local", "test", "A", 1, None, limit, summary, summary != "", len(summary.split()))], "seq long, model_id string, kind string, split string, pass string, item_id long, error string, max_words int, summary string, ok boolean, n_words int")
    items = spark.createDataFrame([("test", 1, limit, source)], "split string, item_id long, max_words int, text string")
    return sql.run(spark, "", "SELECT reason FROM gate_briefs", {"brief_parsed": parsed, "brief_items": items}).first()[0]


@pytest.mark.parametrize(
    ("summary", "source", "limit", "reason"),
    [
        ("", "x", 9, "empty_summary"),
        ("a b c", "x", 2, "over_word_limit"),
        ("w " * 120, "x", None, None),
        ("w " * 121, "x", None, "over_word_limit"),
        ("w " * 121, "x", 0, "over_word_limit"),
        ("pay 1,500", "owes 1500 now", 9, None),
        ("pay 15", "owes 16", 9, "number_not_in_source"),
        ("due April 14, 2031", "due April 14, in room 2031", 9, "date_not_in_source"),
        ("due april 14, 2031", "Due April 14,  2031.", 9, None),
        ("due 14\nApril 2024", "by 14 April 2024", 9, None),
        ("due 3rd May", "by 3 May", 9, "date_not_in_source"),
        ("in Maya 12", "12", 9, None),
    ],
)
def test_summaries(spark, summary, source, limit, reason):
    assert brief(spark, summary, source, limit) == reason


def test_labels_before_numbers(spark):
    def found(text):
        return {r["text"] for r in sql.run(spark, "", catalog.STATEMENTS["regex_pii"], {"texts": spark.createDataFrame([(1, text)], "doc_id long, text string")}).collect()}

    assert found("Switchboard (9 to 5): +44 20 7946 0000") == set()
    assert found("Switchboard" + " " * 29 + "07700 900123") == set() and found("Switchboard" + " " * 30 + "07700 900123") == {"07700 900123"}
    assert found("main line 07700 900111, mine is 07700 900123") == {"07700 900123"} - {"07700 900123"}
    assert found("mine is 07700 900123, main line 07700 900111") == {"07700 900123"}
    assert found("no numbers") == set() and found("07700 900123") == {"07700 900123"}


def test_matching_uses_a_split_of_its_own(spark):
    """calib and test share ids: each row meets the similarity of its split, once."""
    parsed = spark.createDataFrame([(1, "m", "local", "calib", "A", 5, None, True, True, "", True, True), (2, "m", "local", "test", "A", 5, None, True, False, "", True, True)], "seq long, model_id string, kind string, split string, pass string, item_id long, error string, valid boolean, gold_match boolean, found string, match boolean, ok boolean")
    scores = spark.createDataFrame([(5, "calib", True, 0.9), (5, "test", False, 0.1), (6, "calib", False, 0.2), (7, "calib", True, 0.8)], "item_id long, split string, gold_match boolean, score double")
    got = sql.run(spark, "", "SELECT seq, passed, reason FROM gate_pairs", {"match_parsed": parsed, "pair_similarity": scores})
    assert sorted(map(tuple, got.collect())) == [(1, True, None), (2, False, "disagrees_with_baseline")]


def plain_similarity(left, right):
    said = lambda x: (x or "").strip().lower()
    total = 0.0
    for f, w in similarity.WEIGHTS.items():
        a, b = said(left[f]), said(right[f])
        if f == "vat_id":
            s = 100.0 if a and a == b else 0.0
        elif f == "phone":
            a, b = re.sub(r"[^0-9]", "", left[f] or ""), re.sub(r"[^0-9]", "", right[f] or "")
            s = fuzzy.indel(a, b) if a or b else 0.0
        else:
            s = fuzzy.token_set(a, b) if f == "name" else fuzzy.indel(a, b)
        total += w * s / 100
    return total


def test_record_similarity(spark):
    rng = random.Random(8)
    say = lambda n: None if rng.random() < 0.1 else "".join(rng.choice("ab Cé1") for _ in range(rng.randrange(n)))
    rows = [{f"{s}_{f}": say(90 if i % 7 == 0 else 14) for s in "lr" for f in similarity.WEIGHTS} | {"id": i} for i in range(250)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in rows[0]))
    df.createOrReplaceTempView("some_pairs")
    got = {r["id"]: r["score"] for r in spark.sql(similarity.scored("some_pairs", ["id"])).collect()}
    for r in rows:
        want = plain_similarity(*({f: r[f"{s}_{f}"] for f in similarity.WEIGHTS} for s in "lr"))
        assert abs(got[r["id"]] - want) < 1e-9, r


def test_unserved_items_score_by_their_gold(spark):
    items = spark.createDataFrame([(task, "test", 2) for task in ("classification", "extraction", "pii_redaction", "entity_matching", "summarisation")] + [("entity_matching", "calib", 2)], "task string, split string, item_id long")
    given = {
        "items": items,
        "enquiry_gold": spark.createDataFrame([("test", 2, i) for i in range(3)], "split string, item_id long, pos int"),
        "letter_spans": spark.createDataFrame([("test", 2, 1), ("test", 2, 2)], "split string, item_id long, span int"),
        "match_answers": spark.createDataFrame([("test", 2, True), ("calib", 2, False)], "split string, item_id long, gold_match boolean"),
        "brief_tokens": spark.createDataFrame([("test", 2, 0), ("test", 2, 0), ("test", 2, 1)], "split string, item_id long, ix int"),
    }
    got = {(r["task"], r["split"]): tuple(r)[3:] for r in sql.run(spark, "", "SELECT task, split, item_id, a, b, c, d, e FROM unanswered", given).collect()}
    assert got == {
        ("classification", "test"): (0, 1, 0, 0, 0), ("extraction", "test"): (0, 3, 0, 0, 0), ("pii_redaction", "test"): (0, 2, 0, 0, 0),
        ("entity_matching", "test"): (0, 0, 1, 0, 0), ("entity_matching", "calib"): (0, 0, 0, 0, 0), ("summarisation", "test"): (0, 0, 0, 2, 0),
    }


def test_signed_numbers(spark):
    values = [0, 5, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 7]
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string").withColumn("x", F.col("v").cast("decimal(20,0)"))
    assert [r[0] for r in df.orderBy("i").selectExpr(t.signed_64("x")).collect()] == [v - 2**64 if v >= 2**63 else v for v in values]
    assert gates.MAX_WORDS == 120
