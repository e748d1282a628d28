"""Documents merged as tables, ledgers that stay equal, models and numbers of gates that are kept."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog, frames, storage  # noqa: F401  the catalog registers the relations
from ledgerloom.sources import rundir


def some(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False, 3, -1.5, "", 'a "quoted" \\ text', "é\n日", 10**15])
    if kind == 1:
        return [some(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 2:
        return {}
    return {rng.choice(["a", "b", "c.d", 'q"', "é"]): some(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_merge_equals_the_driver_side_one(spark):
    rng = random.Random(3)
    whole = lambda: {k: some(rng) for k in rng.sample(["a", "b", "c", "d"], rng.randrange(4))}
    old, new = ({i: whole() for i in range(250) if rng.random() < 0.9} for _ in range(2))
    old |= {900: {"run": {"models": {"m": {"n": 1, "f": [1, {"x": 2}]}}, "gone": {"x": 1}}, "tasks": {}}, 901: {"a": {"b": 1}}, 902: {"a": 1}, 903: {"a": {}}}
    new |= {900: {"run": {"models": {"m": {"f": [3]}, "k": {}}, "gone": None}, "tasks": {"t": 1}}, 901: {"a": {}}, 902: {"a": {}}, 903: {"a": {"c": {}}}}
    table = lambda docs: spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "key long, doc string").repartition(3)
    got = {r["key"]: json.loads(r["doc"]) for r in rundir.merged_documents(table(old), table(new)).collect()}
    assert got == {k: rundir.merged(old.get(k, {}), new.get(k, {})) for k in old.keys() | new.keys()}


def test_leaves_come_together_again(spark):
    docs = [{"a": {"b": [1, 2], "c": {}}, "é\"": "x"}, {}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(7, "{broken"), (8, None)], "key long, doc string")
    rows = rundir.leaves(df)
    assert sorted((r["key"], tuple(r["path"]), r["text"]) for r in rows.collect()) == [(0, ("a", "b"), "[1,2]"), (0, ("a", "c"), "{}"), (0, ('é"',), '"x"'), (1, (), "{}")]
    assert {r["key"]: json.loads(r["doc"]) for r in rundir.assembled(rows).collect()} == dict(enumerate(docs))


def test_two_ledgers_are_one_unit(spark, tmp_path, monkeypatch):
    run, common, schema = f"{tmp_path}/r1/ledger", f"{tmp_path}/ledger", "command string, actual_usd double"
    both = lambda: [sorted(map(tuple, rundir.ledger(spark, p, common, schema).collect())) for p in (run, common)]
    assert both() == [[], []]
    rundir.append_ledger(spark.createDataFrame([("bench", 1.0)], schema), run, common, "b1")
    paid, mark = spark.createDataFrame([("judge", 2.0), ("judge", 2.0)], schema), storage.mark
    monkeypatch.setattr(storage, "mark", lambda *a: 1 / 0)  # it fails when both are written and nothing counts
    with pytest.raises(ZeroDivisionError):
        rundir.append_ledger(paid, run, common, "b2")
    assert both() == [[("bench", 1.0)]] * 2
    monkeypatch.setattr(storage, "mark", mark)
    for _ in range(2):
        assert rundir.append_ledger(paid, run, common, "b2") == "b2"
    assert both() == [[("bench", 1.0), ("judge", 2.0), ("judge", 2.0)]] * 2
    spark.createDataFrame([("x", 9.0)], schema).write.parquet(f"{run}/batch=b3")  # it fails between the two
    assert both()[0] == both()[1]
    rundir.append_ledger(spark.createDataFrame([("other", 3.0)], schema), f"{tmp_path}/r2/ledger", common)
    assert len(both()[0]) == 3 and len(both()[1]) == 4


def test_gates_train_once(spark, monkeypatch):
    topics = spark.createDataFrame([("classification", s, i, f"l{i % 3}", f"say word{i % 3} and more {i}") for i in range(60) for s in ("calib", "test")], "task string, split string, item_id long, gold string, text string")
    calls, fit = [], frames.label_baseline
    monkeypatch.setattr(frames, "label_baseline", lambda *a: (calls.append(1), fit(*a))[1])
    for _ in range(2):
        got = frames.topic_model(spark, "", {"topic_items": topics})(topics.filter("split = 'test'")).collect()
        assert len(calls) == 1 and all(r["predicted"] == r["gold"] for r in got)
    frames.topic_model(spark, "", {"topic_items": topics.filter("NOT (split = 'calib' AND item_id = 5)")})
    assert len(calls) == 2


def test_numbers_are_tuned_once(spark, tmp_path, monkeypatch):
    data, calls, ratio = "/root/testdata/sf0.001", [], frames.grounding_ratio
    monkeypatch.setattr(frames, "grounding_ratio", lambda *a: (calls.append(1), ratio(*a))[1])
    first = frames.gate_numbers(spark, data).collect()
    assert frames.gate_numbers(spark, data).collect() == first and len(calls) <= 1


def test_vocabulary_has_no_collisions(spark):
    """Words that a small table of hashes would mix up: each label has one of 3,000 words of its own."""
    rows = spark.createDataFrame([(f"word{i} common text", f"l{i % 2}") for i in range(1500)] * 2, "text string, label string")
    got = frames.label_baseline(rows, "text", "label")(rows.distinct()).collect()
    assert all(r["label"] == r["predicted"] for r in got)


def test_baseline_is_the_best_fit_by_tables_of_terms(spark, monkeypatch):
    """Weights by terms are a table's rows; slopes of the plain dense problem vanish at them; a saved model says the same."""
    import math
    import re
    import tempfile

    import numpy as np

    texts = ["red apple pie", "green apple tart", "blue sky high", "sky is blue", "apple sky", "", "Red red APPLE x y"]
    rows = [(t, f"l{i % 3}") for i, t in enumerate(texts * 3)] + [("red apple pie", "l0")] * 4
    df = spark.createDataFrame(rows, "text string, label string")
    monkeypatch.setattr(frames, "VOCABULARY", 1, raising=False)
    model = frames.label_baseline(df, "text", "label")
    table = {r["term"]: r for r in model.terms.collect()}
    words = [re.findall(r"\b\w\w+\b", t.lower()) for t, _ in rows]
    terms = [w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for w in words]
    names = sorted({t for ts in terms for t in ts})
    table = {t: table.pop(h) for t, h in spark.createDataFrame([(t,) for t in names], "t string").selectExpr("t", "xxhash64(t)").collect()} | table
    assert sorted(table) == names
    idf = {t: math.log((len(rows) + 1) / (sum(t in ts for ts in terms) + 1)) + 1 for t in names}
    assert all(abs(table[t]["idf"] - idf[t]) < 1e-12 for t in names)
    x = np.array([[ts.count(t) * idf[t] for t in names] for ts in terms])
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    y = np.array([[label == s for s in model.labels] for _, label in rows])
    w, b = np.array([table[t]["weights"] for t in names]), np.array(model.bases)
    chances = np.exp(x @ w + b)
    left = (chances / chances.sum(1, keepdims=True) - y) / len(rows)
    assert abs(x.T @ left + w / len(rows)).max() < 1e-4 and abs(left.sum(0)).max() < 1e-4 and abs(w).max() > 0.3
    scores = {t: dict(zip(model.labels, s, strict=True)) for (t, _), s in zip(rows, x @ w + b, strict=True)}
    want = sorted(map(tuple, model(df.select("text")).collect()))
    assert [t for t, _ in want] == sorted(t for t, _ in rows) and all(scores[t][said] > max(scores[t].values()) - 1e-9 for t, said in want)
    model.save(at := tempfile.mkdtemp() + "/model")
    assert sorted(map(tuple, frames.LabelBaseline.load(at)(df.select("text")).collect())) == want


def test_baseline_is_fitted_on_all_rows(spark, monkeypatch):
    """Beyond any sample: each of 8,000 rows has a word of its own that alone tells its label; blocks of any size say the same."""
    from ledgerloom.operators import baseline

    rows = spark.range(8000).selectExpr("concat('word', id, ' common text') AS text", "CASE WHEN id % 10 < 9 THEN concat('l', id % 2) END AS label")
    model, fits = frames.label_baseline(rows, "text", "label"), []
    table = {r["term"]: r for r in model.terms.collect()}
    assert len(table) == 2 * 7200 + 3 and model.labels == ["l0", "l1"]
    assert {round(r["idf"], 9) for r in table.values()} == {1.0, round(math.log(7201 / 2) + 1, 9)}
    said = lambda m, df: sorted(map(tuple, m(df).collect()), key=str)
    assert all(r[2] == r[1] for r in said(model, rows.filter("label IS NOT NULL").withColumn("more", F.lit(1)).select("text", "label")))
    monkeypatch.setattr(baseline, "ENTRIES", 3000)
    fits.append(frames.label_baseline(rows, "text", "label"))
    assert fits[0].bits > model.bits == 0
    for term, r in {r["term"]: r for r in fits[0].terms.collect()}.items():
        assert r["idf"] == table[term]["idf"] and r["weights"] == pytest.approx(table[term]["weights"], abs=1e-4)
    odd = spark.createDataFrame([(None,), ("",), ("word1 common text",), ("word1 common text",), ("unheard of",)], "text string")
    want = said(model, rows.select("text").unionByName(odd))
    for bits in (500, 3000):  # blocks of predictions finer than those of the fit
        monkeypatch.setattr(baseline, "ENTRIES", bits)
        assert said(fits[0], rows.select("text").unionByName(odd)) == want == said(model, rows.select("text").unionByName(odd))
    assert said(model, odd.limit(0)) == [] and said(frames.label_baseline(rows.limit(0), "text", "label"), odd.filter("text IS NULL OR text = ''")) == [("", None), (None, None)]
