"""Hand-worked values of the cost model, statistics, parsers and similarities."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog, sql  # noqa: F401  the catalog registers the relations
from ledgerloom.functions import fuzzy, parsing, text
from ledgerloom.operators.resampling import bootstrap_ci, corrected_rates, stratified_sample


def one(spark, statement):
    return spark.sql(statement).first()


def test_fixed_cost(spark):
    row = one(spark, sql.statement("SELECT fixed_usd FROM fixed_cost"))
    assert row[0] == pytest.approx(1200 / 36 + 5 * 24 * 30 / 1000 * 0.30)


def test_weighted_percentile(spark):
    def of(values, p):
        df = spark.createDataFrame([("t", "s", float(v), float(w)) for v, w in values], "task string, split string, v double, w double")
        return sql.run(spark, "", f"SELECT value FROM weighted_p WHERE p = {p}e0", {"weighted_values": df}).first()[0]

    def plain(values, p):  # the reference rule, row by row
        rows, c, total = sorted(values), 0.0, sum(w for _, w in values)
        for i, (v, w) in enumerate(rows):
            if p * total <= c + w + 1e-12:
                return v if not i else rows[i - 1][0] + (v - rows[i - 1][0]) * (p * total - c) / w
            c += w

    assert of([(v, 1) for v in (5, 1, 3, 9, 2, 7)], 0.5) == pytest.approx(3.0)
    assert of([(10, 1), (20, 1), (30, 2)], 0.5) == pytest.approx(20.0)
    ties = [(1, 2), (1, 1), (2, 3), (2, 3), (2, 1), (5, 2)]
    for p in (0.5, 0.95):
        assert of(ties, p) == pytest.approx(plain(ties, p))


def test_mod97(spark):
    q = f"SELECT {text.MOD97} AS m FROM (SELECT {text._numeric('substr(iban, 5) || substr(iban, 1, 4)')} AS n FROM (SELECT 'GB82WEST12345698765432' AS iban) a) b"
    assert one(spark, q)[0] == 1


@pytest.mark.parametrize(
    ("raw", "value"),
    [('so {"a": 1} then', {"a": 1}), ("{broken [1, 2]", [1, 2]), ("none", None), ('{"a": {"b": []}}x', {"a": {"b": []}}), (None, None)],
)
def test_first_value(raw, value):
    assert parsing.first_value(raw) == value


def test_wrappers_and_labels(spark):
    rows = [("<think>a</think>```json\n{}\n```",), ("<think>open end",), ("\n \"'Yes.'\" \nmore",), ("  ",)]
    df = spark.createDataFrame(rows, "raw string").select(parsing.strip_wrappers(F.col("raw")).alias("s"), parsing.first_label(F.col("raw")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("{}", "{}"), ("", None), ("\"'Yes.'\" \nmore", "Yes"), ("", None)]


def test_verdicts():
    fact = lambda i, **k: {"index": i, "present": True, "correct": True} | k
    good = {"facts": [fact(1), fact(0, correct=False)], "unsupported_claims": ["x"]}
    assert parsing.verdict(good, 2) == ([(0, True, False), (1, True, True)], ["x"])
    for bad in ({"facts": [fact(0), fact(0)], "unsupported_claims": []}, {"facts": [fact(True)], "unsupported_claims": []}, {"facts": [fact(0, present="true")], "unsupported_claims": []}, [], None):
        assert parsing.verdict(bad, 1 if bad else 0) is None


def test_similarities():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    for a, b in [("kitten", "sitting"), ("", "x"), ("abcabc", "bcabca"), ("same", "same")]:
        assert fuzzy.common_subsequence(a, b) == slow(a, b)
    assert fuzzy.indel("ab", "ab") == 100 and fuzzy.token_set("acme ltd", "ltd acme group") == 100 and fuzzy.partial("acme", "the acme group") == 100


def test_bootstrap_covers(spark):
    df = spark.range(1200).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 5 < 2).cast("int").alias("ok"), F.lit(1).alias("one"))
    for r in bootstrap_ci(df, ["g"], "ok", "one", "id").collect():
        assert r["low"] < r["estimate"] < r["high"] and r["high"] - r["low"] < 0.2


def test_stratified_sample(spark):
    odd = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    assert {r["g"]: r["count"] for r in stratified_sample(odd, "g", 6, "i").groupBy("g").count().collect()} == {"a": 3, "b": 2, "c": 1}
    df = spark.range(3000).select("id", (F.col("id") % 10 < 7).cast("int").alias("g"))
    got = stratified_sample(df, "g", 101, "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {1: 71, 0: 30}
    assert stratified_sample(df, "g", 0, "id").count() == 0 and stratified_sample(df, "g", 5000, "id").count() == 3000


def test_partial_ratio_equals_every_window():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n = len(short)
        want = max(fuzzy.indel(short, w) for i in range(1 - n, len(long)) if (w := long[max(0, i) : i + n]))
        assert abs(fuzzy.partial(a, b) - want) < 1e-9, (a, b)


def shown(spark, statement, **tables):
    return [tuple(r) for r in sql.run(spark, "", statement, tables).collect()]


def test_wrappers_take_the_first_fence(spark):
    raw = spark.createDataFrame([(1, '```json {"a": 1}``` then ```other```'), (2, "<THINK>x</think> ok <think>never"), (3, "```c++\n int x;\n```"), (4, " plain ")], "event_id long, raw string")
    assert sorted(shown(spark, catalog.STATEMENTS["parse_strip_wrappers"], raw_json=raw)) == [(1, '{"a": 1}'), (2, "ok"), (3, "int x;"), (4, "plain")]
    got = raw.select("event_id", parsing.strip_wrappers(F.col("raw"))).orderBy("event_id").collect()
    assert [r[1] for r in got] == ['{"a": 1}', "ok", "int x;", "plain"]


def test_normal_fields(spark):
    rows = [("string", " Acme   LTD ", "acme ltd"), ("email", " A@B.C ", "a@b.c"), ("phone", "+44 (0)7", "4407"), ("phone", "none", None), ("country", "uk", "GB"), ("country", "fr", "FR"), ("int", "1,200", "1200"), ("int", "1.5", None), ("amount", "$1,234.567", "123457"), ("amount", "-", None), ("date", "2024-02-29T10:00", "2024-02-29"), ("date", "2024-02-30", "2024-02-30"), ("date", "Next Week", "next week"), ("enum", "HIGH", "high"), ("enum", "odd", "odd"), ("string", None, None)]
    df = spark.createDataFrame([(i, t, s, "low|high") for i, (t, s, _) in enumerate(rows)], "item_id int, type string, said string, allowed string").withColumn("field", F.col("type"))
    got = shown(spark, catalog.STATEMENTS["normalize_field"], field_samples=df)
    assert {i: v for i, _, _, v in got} == {i: w for i, (_, _, w) in enumerate(rows)}


def test_key_tokens(spark):
    rows = [("amount", "12.5k", "pays $12,500 now", True), ("amount", "12,500", "12.5K", True), ("amount", "12500", "12600", False), ("amount", "n/a", "1", False), ("date", "14 April", "on April 14th", True), ("date", "14 April", "14/4", True), ("date", "14 April", "2024-04-14", True), ("date", "14 April", "15 April", False), ("date", "next Monday", "by NEXT monday", True), ("owner", "Ana", "ANA will", True), ("owner", "Ana", "Bob", False)]
    parsed = spark.createDataFrame([(i, "m", "local", "test", "A", i, None, 9, s, True, 3) for i, (_, _, s, _) in enumerate(rows)], "seq long, model_id string, kind string, split string, pass string, item_id long, error string, max_words int, summary string, ok boolean, n_words int")
    tokens = spark.createDataFrame([("test", i, 0, k, t) for i, (k, t, _, _) in enumerate(rows)], "split string, item_id long, ix int, token_kind string, token string")
    got = dict(shown(spark, "SELECT seq, passes FROM token_checks", brief_parsed=parsed, brief_tokens=tokens))
    assert got == {i: want for i, (_, _, _, want) in enumerate(rows)}


def test_occurrences_and_spans(spark):
    text = " Ann  Lee met Ann\tLee; aaaa"
    letters = spark.createDataFrame([("test", 1, text, "n", "m", "p", "b")], "split string, item_id long, text string, name string, mail string, phone string, birth string")
    entries = spark.createDataFrame([(9, "m", "local", "test", "A", 1, 0, "NAME", "Ann Lee"), (9, "m", "local", "test", "A", 1, 1, "X", "aa"), (9, "m", "local", "test", "A", 1, 2, "X", "zz")], "seq long, model_id string, kind string, split string, pass string, item_id long, pos int, type string, text string")
    got = sorted(shown(spark, "SELECT pos, s, e FROM entry_places", letters=letters, letter_entries=entries))
    assert [(p, text[s:e]) for p, s, e in got] == [(0, "Ann  Lee"), (0, "Ann\tLee"), (1, "aa"), (1, "aa"), (1, "aa")]


def test_personal_data_by_patterns(spark):
    text = "Mail a.b@x.example.org and c@y.example.com. Switchboard: +44 20 7946 0000 but mobile 07700 900123. Opened 21/08/2023. Born on 4 March 1980 there. GB82WEST12345698765432 GB82WEST12345698765433"
    got = shown(spark, catalog.STATEMENTS["regex_pii"], texts=spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((k, t) for _, k, t in got) == [("DATE_OF_BIRTH", "4 March 1980"), ("EMAIL", "a.b@x.example.org"), ("EMAIL", "c@y.example.com"), ("IBAN", "GB82WEST12345698765432"), ("PHONE", "07700 900123")]


def test_planner_by_hand(spark):
    """Dropped, cheapest first, next of another provider, best quality; a task without survivors is unservable."""
    rows = [("a", "local-a", "local", "local", 0.9, 5.0, 1.0), ("a", "cloud-small", "cloud", "vendor-y", 0.95, 1.0, 1.0), ("a", "cloud-family", "cloud", "vendor-y", 0.96, 2.0, 1.0), ("a", "cloud-frontier", "cloud", "vendor-x", 1.0, 9.0, 1.0), ("a", "cloud-large", "cloud", "vendor-z", 0.99, 3.0, 99.0), ("b", "local-a", "local", "local", 0.1, 1.0, 1.0), ("b", "cloud-small", "cloud", "vendor-y", 1.0, 1.0, 1.0)]
    candidates = spark.createDataFrame([(m, k, p, "r", 0, t, "calib", 9, s, False, 0.0, None, 0.1, q, u) for t, m, k, p, s, u, q in rows], "model_id string, kind string, provider string, role string, pos int, task string, split string, n long, score double, judged boolean, invalid_rate double, within_rate double, p50_s double, p95_s double, usd double")
    route = spark.createDataFrame([("a", 0.5, 0.9, None, 5.0, False, False, 10.0), ("b", 0.5, 0.9, None, None, True, False, 10.0)], "task string, weight double, relative_bar double, absolute_bar double, cap_s double, local_only boolean, below_bar_ok boolean, monthly double")
    mix = route.select("task", "weight")
    given = {"candidates": candidates, "route": route, "mix": mix}
    assert sorted(shown(spark, "SELECT task, pos, model_id FROM chain WHERE constrained", **given)) == [("a", 1, "cloud-small"), ("a", 2, "local-a"), ("a", 3, "cloud-frontier")]
    status = dict(shown(spark, "SELECT model_id, dropped FROM planned WHERE constrained AND task = 'a'", **given))
    assert status["cloud-large"] == "latency_p95_exceeds_cap" and status["local-a"] is None
    plan = {r[0]: r[1:] for r in shown(spark, catalog.STATEMENTS["plan_table"], **given)}
    assert plan["b"] == (None, None, "unservable", "off") and plan["a"][2] == "served"
    served = route.withColumn("below_bar_ok", F.lit(True))
    assert ("b", 1, "local-a") in shown(spark, "SELECT task, pos, model_id FROM chain WHERE constrained", candidates=candidates, route=served, mix=mix)


def test_replay_by_hand(spark):
    """Four items: a direct pass, an error that escalates, a gate that fails, a chain that runs out."""
    chain = spark.createDataFrame([(c, "a", m, k, p, b, 0) for c in (True, False) for m, k, p, b in (("local-a", "local", 1, 0), ("cloud-small", "cloud", 2, 1))], "constrained boolean, task string, model_id string, kind string, pos int, best int, below int")
    items = spark.createDataFrame([("a", "test", i) for i in range(1, 5)], "task string, split string, item_id long")
    calls = [(1, "local-a", 1, None, True), (2, "local-a", 2, "http_500", True), (3, "cloud-small", 2, None, True), (4, "local-a", 3, None, True), (5, "cloud-small", 3, None, True), (6, "local-a", 4, None, False), (7, "cloud-small", 4, None, True)]
    scored = spark.createDataFrame([(s, m, "local" if m == "local-a" else "cloud", "a", "test", "A", i, 1.0, 0.5, 0, e, 1, 1, v, 1, 1, 0, 0, 0) for s, m, i, e, v in calls], "seq long, model_id string, kind string, task string, split string, pass string, item_id long, latency_s double, cost_usd double, retries int, error string, prompt_tokens int, completion_tokens int, valid boolean, a int, b int, c int, d int, e int")
    gates = spark.createDataFrame([(s, m, "a", "test", i, s not in (4, 7), None) for s, m, i, _, _ in calls], "seq long, model_id string, task string, split string, item_id long, passed boolean, reason string")
    route = spark.createDataFrame([("a", 1.0, 0.9, None, None, False, False, 10.0)], "task string, weight double, relative_bar double, absolute_bar double, cap_s double, local_only boolean, below_bar_ok boolean, monthly double")
    unanswered = items.select("task", "split", "item_id", *[F.lit(0).alias(x) for x in "abcde"])
    given = {"chain": chain, "items": items, "scored": scored, "gate_results": gates, "route": route, "unanswered": unanswered}
    q = "SELECT item_id, served_pos, served_by, calls, escalated, latency_s, cost_usd, a FROM replayed WHERE row_name = 'router (gates, constraints)' AND split = 'test'"
    assert sorted(shown(spark, q, **given)) == [(1, 1, "local-a", 1, False, 1.0, 0.0, 1), (2, 2, "cloud-small", 2, True, 2.0, 0.5, 1), (3, 2, "cloud-small", 2, True, 2.0, 0.5, 1), (4, -1, "cloud-small", 2, True, 2.0, 0.5, 1)]
    local = given | {"route": route.withColumn("local_only", F.lit(True))}
    assert [r for r in shown(spark, q, **local) if r[0] == 4] == [(4, -1, None, 2, True, 2.0, 0.5, 0)]


def test_bootstrap_equals_a_direct_resample(spark):
    values = [1, 0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("g", i, v, 1) for i, v in enumerate(values)], "g string, i int, ok int, w int").repartition(3)
    got = bootstrap_ci(df, ["g"], "ok", "w", "i").first()
    rng, k = random.Random(7), len(values)
    plain = sorted(sum(values[rng.randrange(k)] for _ in range(k)) / k for _ in range(1000))
    assert (got["estimate"], got["low"], got["high"]) == pytest.approx((sum(values) / k, plain[25], plain[974]))


def test_corrected_rate_resamples_the_holdout(spark):
    passed = spark.createDataFrame([("m", i, i % 3 > 0) for i in range(30)], "m string, i int, ok boolean")
    holdout = spark.createDataFrame([(i, i % 2 == 0, (i % 2 == 0) != (i % 7 == 0)) for i in range(40)], "id int, y boolean, s boolean")
    got = corrected_rates(passed, ["m"], "ok", "i", holdout, "y", "s", "id").first()
    rng, ev, ho, out = random.Random(7), [i % 3 > 0 for i in range(30)], [(i % 2 == 0, (i % 2 == 0) != (i % 7 == 0)) for i in range(40)], []
    for _ in range(1000):
        p = sum(ev[rng.randrange(30)] for _ in range(30)) / 30
        drawn = [ho[rng.randrange(40)] for _ in range(40)]
        tpr = sum(s for y, s in drawn if y) / sum(y for y, _ in drawn)
        tnr = sum(not s for y, s in drawn if not y) / sum(not y for y, _ in drawn)
        out.append(min(1, max(0, (p + tnr - 1) / (tpr + tnr - 1))))
    out.sort()
    assert (got["low"], got["high"]) == pytest.approx((out[25], out[974])) and got["low"] < got["corrected"] < got["high"]


def test_tuning_prefers_the_better_f1(spark):
    df = spark.createDataFrame([(0.2, False), (0.4, True), (0.5, False), (0.9, True), (0.95, True)], "score double, match boolean")
    from ledgerloom import frames

    row = frames.tuned(df, "score", "match").first()
    assert tuple(row) == (0.4, pytest.approx(6 / 7), 0.4, 0.5)
    shared = df.withColumn("id", F.monotonically_increasing_id())
    assert shown(spark, "SELECT threshold, band_low, band_high FROM pair_tuned", pair_scores=shared) == [(0.4, 0.4, 0.5)]


def test_grounding_of_whole_values(spark):
    from ledgerloom import frames

    schema = "seq long, model_id string, kind string, split string, pass string, item_id long, error string, ok boolean, pos int, field string, type string, required boolean, grounded boolean, allowed string, gold string, said string, gold_value string, said_value string"
    say = [("Acme Group Ltd", True), ("Acme Grupp Ltd", True), ("Other", False), (" ", False)]
    fields = spark.createDataFrame([(i, "m", "local", "calib", "A", 1, None, True, 0, "company", "string", True, True, None, s, s, s.strip() or None, (s.strip() or None) if c else "x") for i, (s, c) in enumerate(say)], schema)
    items = spark.createDataFrame([("t", "calib", 1, "2024-01-01", "x" * 500 + " we at ACME  group ltd write")], "task string, split string, item_id long, reference_date string, text string")
    given = {"enquiry_fields": fields, "enquiry_items": items}
    got = {r["seq"]: r["ratio"] for r in frames.partial_ratio(spark, "", given).collect()}
    plain = max(fuzzy.indel("acme grupp ltd", w) for i in range(-13, 520) if (w := ("x" * 500 + " we at acme group ltd write")[max(0, i) : i + 14]))
    assert got[0] == 100 and got[1] == pytest.approx(plain, abs=1e-6) and got[2] < 80 and got[3] == 0
    assert frames.grounding_ratio(spark, "", given).first()[0] == pytest.approx(min(100, max(80, plain)), abs=1e-6)
    assert {r["seq"] for r in frames.grounded(spark, "", given).collect() if r["grounded"]} == {0, 1}


def test_label_baseline_reads_whole_texts(spark, tmp_path):
    from ledgerloom import frames

    head = "same words " * 40
    docs = [(i, f"l{i % 4}", [head + "ja", "nein", "pp qq pp qq rr rr", "qq pp rr qq rr pp"][i % 4]) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = frames.tfidf(spark, str(tmp_path)).collect()
    assert len(got) == 80 and all(r["label"] == r["prediction"] for r in got)


def test_seconds_of_completions_are_those_of_clocks(spark):
    """A minute begins anew with its first second, whatever parts of a second the first event has."""
    rows = [(0, "2024-01-01 00:00:11.9"), (1, "2024-01-01 00:00:12.1"), (2, "2024-01-01 01:00:11.1"), (3, "2024-01-01 01:00:10.95")]
    events = spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts")
    assert sorted(map(tuple, sql.run(spark, "", "SELECT event_id, t FROM completions", {"events": events}).collect())) == [(0, 0), (1, 1), (2, 3600), (3, 3599)]
    assert sorted(map(tuple, catalog.over(spark, "per_minute_tph", {"events": events}).collect())) == [(0, 3, 180), (1, 1, 60)]


def test_places_of_texts_in_other_texts(spark):
    """Spark's short ways equal the plain one: overlaps, nowhere, at both ends, signs of several bytes."""
    from ledgerloom.functions import macros

    texts = ["aaa", "abc", "x aé日aé", "  a \t\nb  ", "\n", "日 日", "ab", "a  b"]
    rows = [(t, q) for t in texts for q in ["a", "aa", "aé", "日", "abcd", " ", "b  ", "é日a", "zz"]] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "t string, q string").selectExpr("t", "q", f"{macros.occurrences('t', 'q')} AS at", f"{macros.kept_places('t')} AS kept")
    for r in df.collect():
        if r.t is not None and r.q is not None:
            assert (r.at or []) == [i + 1 for i in range(len(r.t)) if r.t.startswith(r.q, i)], (r.t, r.q)
        if r.t is not None:
            assert r.kept == [i + 1 for i, c in enumerate(r.t) if c not in macros.WS or i > 0 and r.t[i - 1] not in macros.WS], r.t


def test_a_kept_table_is_looked_up_once_in_a_run(spark, monkeypatch):
    from ledgerloom import storage

    asked, published = [], storage.published
    monkeypatch.setattr(storage, "published", lambda spark, name, *a: (asked.append(name), published(spark, name, *a))[1])
    catalog.queries()["candidate_table"](spark, "/root/testdata/sf0.001")
    assert len(asked) == len(set(asked)) and sum(n.startswith("covered-") for n in asked) == 1


def test_large_tables_in_small_files_arent_broadcast(spark):
    """A file's bytes say little of its rows; what is small indeed is broadcast still."""
    from ledgerloom import storage

    many = storage.kept(lambda: spark.range(500_000).selectExpr("id AS seq", "'x' AS reason", "'a label' AS model_id"), spark, "many", "v")
    few = storage.kept(lambda: spark.range(20).coalesce(1).selectExpr("id AS seq", "'x' AS reason"), spark, "few", "v")
    plan = lambda right: sql.run(spark, "", "SELECT c.model_id, g.reason FROM calls c JOIN gate_results g ON g.seq = c.seq", {"calls": many, "gate_results": right})._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(many) and "BroadcastHashJoin" in plan(few)


def test_the_driver_keeps_little_of_statements(spark):
    for name in sql.LEAN:
        spark.conf.unset(name)
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    sql.run(spark, "", "SELECT * FROM fields")
    assert all(spark.conf.get(name) == value for name, value in sql.LEAN.items())


def test_throughput_is_counted_by_minutes(spark):
    """Sixty seconds from the first completion make a minute, to the part of a second; one without completions has zero; none, no minutes."""
    times = ["00:00:11.9", "00:01:11.8", "00:01:11.9", "00:04:00", "00:04:12", None]
    events = spark.createDataFrame([(t and f"2024-01-01 {t}",) for t in times], "ts string").selectExpr("CAST(ts AS timestamp_ntz) AS ts")
    got = lambda rows: sorted(map(tuple, catalog.over(spark, "per_minute_tph", {"events": rows}).collect()))
    assert got(events) == [(0, 2, 120), (1, 1, 60), (2, 0, 0), (3, 1, 60), (4, 1, 60)]
    days = events.limit(1).unionByName(spark.sql("SELECT CAST('2024-01-03 00:00:11.9' AS timestamp_ntz) AS ts"))
    assert [m for m, n, _ in got(days) if n] == [0, 2880] and len(got(days)) == 2881
    assert got(events.limit(0)) == got(events.filter("ts IS NULL")) == []
