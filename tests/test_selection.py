"""Percentiles by distributed selection against built-in ones, whatever the size of a leaf."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators.selection import percentiles, weighted_percentiles


@pytest.fixture(scope="module")
def values(spark):
    rng, rows = random.Random(9), []
    for g, n, of in (("a", 900, lambda: rng.random()), ("b", 700, lambda: float(rng.randrange(4))), ("c", 1, lambda: 2.0), ("d", 300, lambda: 7.0), ("e", 400, lambda: rng.choice([-1e9, 1e-9, 3.0]) * rng.random()), (None, 350, lambda: rng.gauss(0, 1)), ("f", 500, lambda: 1.0 if rng.random() < 0.999 else 0.0)):
        rows += [(g, i, of(), rng.choice([0.5, 1.0, 2.5, 0.0])) for i in range(n)]
    rows += [("a", -1, None, 1.0), ("only null", 0, None, 1.0), ("b", -2, 3.0, None)]
    return rows


@pytest.mark.parametrize("leaf", [3, 40, 100_000])
def test_equals_percentile(spark, values, leaf):
    df = spark.createDataFrame(values, "g string, i int, v double, w double").repartition(3)
    ends = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in percentiles(df, ["g"], "v", ends, leaf).collect()}
    want = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in ends.items()]).collect()}
    assert set(got) == set(want)
    for g, row in want.items():
        assert got[g] == (pytest.approx(row) if row[0] is not None else row)


def plain(rows, p):
    rows, c, total = sorted(rows), 0.0, sum(w for _, w in rows)
    for i, (v, w) in enumerate(rows):
        if p * total <= c + w:
            return v if not i else rows[i - 1][0] + (v - rows[i - 1][0]) * (p * total - c) / w
        c += w


@pytest.mark.parametrize("leaf", [3, 40, 100_000])
def test_equals_a_walk_over_weights(spark, values, leaf):
    df = spark.createDataFrame(values, "g string, i int, v double, w double").repartition(3)
    got = {(r["g"], r["p"]): r["value"] for r in weighted_percentiles(df, ["g"], "v", "w", [0.05, 0.5, 0.95], leaf).collect()}
    held = {}
    for g, _, v, w in values:
        if v is not None and w:
            held.setdefault(g, []).append((v, w))
    assert set(got) == {(g, p) for g in held for p in (0.05, 0.5, 0.95)}
    for (g, p), v in got.items():
        assert v == pytest.approx(plain(held[g], p), rel=1e-9), (g, p)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double, w double")
    assert percentiles(df, ["g"], "v", {"m": 0.5}).collect() == [] and weighted_percentiles(df, ["g"], "v", "w", [0.5]).collect() == []


def test_store(spark, tmp_path):
    """Published at once, one table of two writers, nested files are seen, old versions go."""
    a = storage.kept(lambda: spark.range(3).toDF("x"), spark, "t1", "v1")
    assert storage.kept(lambda: 1 / 0, spark, "t1", "v1").count() == 3 == a.count()
    home = f"{storage.shared_dir(spark)}/derived/t1"

    def other(path):  # another writer is done while this one writes
        storage.published(spark, "t1", "v2", lambda p: spark.range(5).toDF("x").write.parquet(p))
        spark.range(5).toDF("x").write.parquet(path)

    at = storage.published(spark, "t1", "v2", other)
    assert at == storage.published(spark, "t1", "v2", None) and spark.read.parquet(at).count() == 5
    with pytest.raises(ZeroDivisionError):
        storage.kept(lambda: 1 / 0, spark, "t1", "v3")
    assert not [n for n, _ in storage.listed(spark, home) if n.startswith("v3")]
    spark.range(1).write.parquet(f"{home}/v4.unfinished")
    storage.evict(spark, "t1", "v2", grace=-5)
    assert {n.split(".")[0] for n, _ in storage.listed(spark, home)} == {"v2"} and spark.read.parquet(at).count() == 5
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f").write_text("x")
    before = storage.state(spark, [str(tmp_path / "a")])
    assert before == storage.state(spark, [str(tmp_path / "a")])
    (tmp_path / "a" / "b" / "f").write_text("xy")
    assert storage.state(spark, [str(tmp_path / "a")]) != before != storage.state(spark, [str(tmp_path / "none")])
