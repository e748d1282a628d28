"""Resamples have one law at all sizes: shares of strata, widths of intervals, coverage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import resampling


def test_shares_of_strata_are_multinomial():
    """Eight strata of uneven sizes: draws add up exactly, with the mean and variance of n draws with replacement."""
    sizes, resamples, n = [5, 0, 40, 3, 900, 2, 1, 49], 4000, 1000

    def path(stratum):
        own, other = [], []
        for level in (1, 2, 3):
            width = 8 >> level
            node = stratum // width
            own.append(sum(sizes[node * width : (node + 1) * width]))
            other.append(sum(sizes[(node ^ 1) * width : ((node ^ 1) + 1) * width]))
        return own, other

    drawn = np.stack([resampling.draws_in_stratum(7, 3, s, *path(s), n, resamples) for s in range(8)])
    assert (drawn.sum(0) == n).all() and (drawn[1] == 0).all()
    for s, k in enumerate(sizes):
        p = k / sum(sizes)
        assert abs(drawn[s].mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / resamples) + 1e-9
        assert abs(drawn[s].var() - n * p * (1 - p)) < 0.15 * n * p * (1 - p) + 1e-9
    p, q = sizes[4] / 1000, sizes[7] / 1000
    assert abs(np.cov(drawn[4], drawn[7])[0, 1] + n * p * q) < 0.15 * n * p * q


@pytest.mark.parametrize("leaf", [64, 700, 5000])
def test_width_is_the_laws(spark, leaf):
    """The same interval, but for its own noise, in however many strata the rows are."""
    n, share = 20_000, 0.3
    df = spark.range(n).select(F.lit("g").alias("g"), "id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 3).cast("int").alias("ok"), F.lit(1).alias("w")).repartition(5)
    r = resampling.bootstrap_ci(df, ["g"], "ok", "w", "id", leaf=leaf).first()
    want = 2 * 1.96 * math.sqrt(share * (1 - share) / n)
    assert r["low"] < r["estimate"] < r["high"] and 0.88 * want < r["high"] - r["low"] < 1.12 * want
    again = resampling.bootstrap_ci(df.repartition(2), ["g"], "ok", "w", "id", leaf=leaf).first()
    assert tuple(again) == tuple(r)


@pytest.mark.parametrize(("n", "groups", "leaf"), [(200, 120, 5000), (200, 120, 40), (20_000, 40, 3000)])
def test_intervals_cover(spark, n, groups, leaf):
    """Of many samples from one law, about 95 in 100 intervals hold its mean."""
    df = spark.range(n * groups).select((F.col("id") % groups).alias("g"), "id", (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(100)) < 40).cast("int").alias("ok"), F.lit(1).alias("w"))
    rows = resampling.bootstrap_ci(df, ["g"], "ok", "w", "id", resamples=400, leaf=leaf).collect()
    covered = sum(r["low"] <= 0.4 <= r["high"] for r in rows) / groups
    assert len(rows) == groups and covered > 0.95 - 3.5 * math.sqrt(0.95 * 0.05 / groups)
    assert covered < 1 or groups < 100


def test_groups_without_keys_or_rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("ok"), F.lit(1).alias("w"))
    r = resampling.bootstrap_ci(df, [], "ok", "w", "id", leaf=50).first()
    assert r["low"] < 0.5 < r["high"] and r["estimate"] == 0.5
    assert resampling.bootstrap_ci(df.limit(0).withColumn("g", F.lit("x")), ["g"], "ok", "w", "id").collect() == []
    nulls = df.withColumn("g", F.when(F.col("id") < 200, F.lit(None).cast("string")).otherwise("b"))
    assert {r["g"] for r in resampling.bootstrap_ci(nulls, ["g"], "ok", "w", "id", leaf=30).collect()} == {None, "b"}


def test_corrected_rates_have_one_law(spark):
    passed = spark.range(3000).select(F.lit("m").alias("m"), "id", (F.col("id") % 10 < 7).alias("ok"))
    holdout = spark.range(500).select("id", (F.col("id") % 2 == 0).alias("y"), ((F.col("id") % 2 == 0) != (F.col("id") % 11 == 0)).alias("s"))
    a, b = (resampling.corrected_rates(passed, ["m"], "ok", "id", holdout, "y", "s", "id", leaf=leaf).first() for leaf in (5000, 100))
    assert a["corrected"] == b["corrected"] and a["raw"] == 0.7
    assert abs(a["low"] - b["low"]) < 0.012 and abs(a["high"] - b["high"]) < 0.012 and a["low"] < a["corrected"] < a["high"]
    none = resampling.corrected_rates(passed, ["m"], "ok", "id", holdout.limit(0), "y", "s", "id").first()
    assert none["corrected"] is None and none["low"] is None
