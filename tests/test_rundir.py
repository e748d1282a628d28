import gzip
import json

import pytest

from ledgerloom import config
from ledgerloom.report import render
from ledgerloom.sources import rundir


def test_logs(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    assert rundir.predictions(spark, str(run)).count() == 0
    call = lambda i, p: {"model_id": "m", "task": "t", "split": "test", "item_id": str(i), "pass": p}
    rundir.export_gzip([call(1, "A"), call(2, "B")], str(run / "predictions.jsonl.gz"))
    rundir.export_gzip([call(3, "A")], str(run / "predictions.jsonl.gz"))
    assert sorted(r["item_id"] for r in rundir.predictions(spark, str(run)).collect()) == ["1", "3"]
    every = rundir.predictions(spark, str(run), None)
    work = spark.createDataFrame([("m", "t", "test", str(i), "A") for i in range(5)], "model_id string, task string, split string, item_id string, pass string")
    assert sorted(r["item_id"] for r in rundir.to_do(work, every).collect()) == ["0", "2", "4"]
    (run / "ledger.jsonl").write_text('{"command": "bench", "actual_usd": 1.5}\n\nnot json\n{"command": "judge"}\n')
    assert rundir.run_log(spark, str(run), "ledger").count() == 2
    assert gzip.open(run / "predictions.jsonl.gz").read().count(b"\n") == 3


def test_documents(tmp_path):
    path = str(tmp_path / "a.json")
    rundir.write_document({"b": {"x": 1}, "a": 1}, path)
    rundir.write_document({"b": {"y": 2}, "a": [2]}, path, merge=True)
    assert rundir.read_document(path) == {"a": [2], "b": {"x": 1, "y": 2}}
    assert rundir.read_document(str(tmp_path / "none"), 7) == 7
    before = rundir.fingerprint([path])
    rundir.write_document({}, path)
    assert rundir.fingerprint([path]) != before


def test_items(spark, tmp_path):
    path = tmp_path / "i.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"id": "1", "text": "hello", "spans": [{"start": 0, "end": 5, "type": "NAME"}]}, {"id": "", "text": "x", "spans": [{"start": 0, "end": 2, "type": "ODD"}]}]))
    got = rundir.item_errors(rundir.items(spark, str(path), "pii_redaction"), "pii_redaction", types=["NAME"]).collect()
    assert [r["errors"] for r in got] == [[], ["no id", "span out of text", "unknown type"]]


def test_config(spark):
    route = config.checked(config.Route, {"latency_p95_max_s": {"default": 5.0, "extraction": None}, "expected_monthly_volume": {"summarisation": 9.0}})
    assert route.cap("extraction") is None and route.cap("classification") == 5.0 and route.volume("summarisation") == 9.0
    assert route.table(spark).count() == 5
    with pytest.raises(ValueError, match="unknown keys"):
        config.checked(config.Route, {"speed": 1})
    with pytest.raises(ValueError, match="sum to 1"):
        config.Route(workload_mix={"a": 0.5})
    with pytest.raises(ValueError, match="unique"):
        config.models([{"id": "a", "kind": "local"}] * 2)
    assert config.Model("x", "cloud", "vendor/model").provider_class == "vendor"


def test_formats(spark):
    assert render.percent(0.1234) == "12.3 %" and render.percent(float("nan")) == render.MISSING and render.share(0.004) == "<1 %"
    assert render.usd_per_1k(2e-6) == "$0.0020" and render.whole(1234.6) == "1,235"
    assert render.markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")).splitlines()[2] == "| 1 | a\\|b |"


def test_task_specs(spark, tmp_path):
    from ledgerloom import specs

    for name, kind in (("b", "extraction"), ("a", "classification")):
        (tmp_path / name).mkdir()
        values = {"name": name, "kind": kind, "calib": "c.jsonl", "test": "t.jsonl"} | ({"fields": {"x": {"type": "enum", "values": ["p", "q"], "required": True}, "y": {"type": "int"}}} if name == "b" else {"labels": ["l"], "max_tokens": 9})
        (tmp_path / name / "task.json").write_text(json.dumps(values))
        (tmp_path / name / "c.jsonl").write_text("{}\n")
    tasks = specs.catalogue(str(tmp_path))
    assert [t.name for t in tasks] == ["a", "b"] and [t.name for t in specs.selected(f"all, {tmp_path}/b", str(tmp_path))] == ["a", "b", "b"]
    assert tasks[0].output_cap() == 9 and tasks[0].output_cap({"classification": 4}) == 4 and tasks[1].output_cap() == 400
    with pytest.raises(ValueError, match="no split"):
        tasks[0].split_path("train")
    assert list(tasks[0].entry(True)["sha256"]) == ["calib"]
    assert [tuple(r) for r in specs.table(spark, tasks).collect()] == [("b", 0, "x", "enum", True, False, "p|q"), ("b", 1, "y", "int", False, False, None)]
    recorded = [{"name": "b", "source": f"{tmp_path}/b/task.json"}, {"name": "gone", "source": "/nowhere/task.json"}, {"name": "a", "source": "bundled"}]
    assert sorted(specs.of_run(recorded, str(tmp_path))) == ["a", "b"]
    (tmp_path / "b" / "task.json").write_text(json.dumps({"name": "b", "kind": "extraction", "calib": "c", "test": "t", "speed": 1}))
    with pytest.raises(ValueError, match="unknown keys"):
        specs.load_task(str(tmp_path / "b"))


def test_runs_and_configuration(spark, tmp_path):
    for n in ("r1", "r2"):
        (tmp_path / n).mkdir()
    assert rundir.resolve_run(str(tmp_path)).endswith("r2") and rundir.resolve_run(str(tmp_path), "r1").endswith("r1")
    with pytest.raises(FileNotFoundError):
        rundir.resolve_run(str(tmp_path), "r9")
    c = config.checked(config.Config, {"project": "p", "models": [{"id": "m", "kind": "cloud", "model": "v/m", "provider": "secret"}], "hardware": {"name": "box", "purchase_price_usd": 9.0, "lifetime_years": 3.0, "electricity_usd_per_kwh": 0.3, "idle_watts": 5.0, "incremental_watts": 20.0}})
    assert c.model("m").provider_class == "v" and "secret" not in json.dumps(c.recorded()) and c.machine().table(spark).first()["idle_w"] == 5.0
    with pytest.raises(KeyError):
        c.model("x")
    df = spark.createDataFrame([("bench", 1.0)], "command string, actual_usd double")
    rundir.append_ledger(df, f"{tmp_path}/r1/ledger", f"{tmp_path}/ledger")
    rundir.append_ledger(df, f"{tmp_path}/r2/ledger", f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2 and spark.read.parquet(f"{tmp_path}/r1/ledger").count() == 1


def test_pages_and_sentences():
    page = render.to_html("# A `x`\n\nsome **bold** <b>\nmore\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n")
    assert page == "<h1>A <code>x</code></h1>\n<p>some <strong>bold</strong> &lt;b&gt; more</p>\n<ul><li>one</li><li>two</li></ul>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table>\n"
    text = render.headline_text({"a": "m"}, 5, {"task": "a", "any_met": True, "verdict": "break-even", "volume": 1234.4, "monthly": 9000.0}, {"pct": 12.34, "versus": "the cheapest"}, ["p"])
    assert text == "A local model met the quality bar on only 1 of 5 tasks: a (m); p, which must stay local, is refused. The headline task, a, breaks even at 1,234 tasks a month (its volume: 9,000). The router costs 12.3% less on the mixed workload than the cheapest."
    assert "| a | local | why |" in render.decision_record(1, "T", [{"task": "a", "verdict": "local", "detail": "why"}], text, "2024-01-01")
