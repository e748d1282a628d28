"""The corpus pipeline on the smallest documents: each stage against brute force on its own input."""

import importlib.util
import re
import sys
from pathlib import Path

import pytest

import corpus_pipeline

_spec = importlib.util.spec_from_file_location("llm_operator_checks", Path(__file__).with_name("test_operators.py"))
checks = importlib.util.module_from_spec(_spec)
sys.modules[_spec.name] = checks
_spec.loader.exec_module(checks)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items()
    for i, t in before.items():
        words, _, _, _, repeated = checks.plain_quality(t) if len(t) < 8000 else (99, 0, 0, 0, 0)
        if words < 20 or 100 * repeated > 30 * words:
            assert i not in after
    assert len(after) > 0.7 * len(before)


def test_near_duplicate_stage(stages):
    before = texts(stages[1])
    classes = checks.plain_classes(before, 5, 80)
    assert set(texts(stages[2])) == {i for i, (_, c) in classes.items() if i == c}


def test_suffix_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    seen = set()
    for i in sorted(before):
        raw = before[i].encode()
        marks = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                marks[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        assert after[i] == bytes(b for b, m in zip(raw, marks, strict=True) if not m).decode("utf-8", "ignore")


def test_secret_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    for r in stages[4]:
        assert r["n_chars"] == len(r["text"]) or before[r["doc_id"]] == r["text"]
    for i, t in before.items():
        spans = [s.split(":") for s in checks.plain_spans(t).split(",") if s]
        for kind, a, b in spans:
            value = t[int(a) : int(b)]
            secret = re.split(r"[:=]\x20*[\"']?", value)[-1] if kind == "assign" else value
            assert secret not in after[i]
        if not spans and "[SECRET]" not in after[i]:
            assert after[i] == t


def test_packing_stage(stages):
    assert checks.check_packing(stages[5], texts(stages[4])) == 0
