"""Exact percentiles of groups of any size: pivots, sums by bracket, and an order of the one bracket that is left.

A group's values are cut at pivots that a sketch gives; what lies in a bracket is counted, or weighed, before the
shuffle. The bracket that holds a percentile's place is cut again until it has at most ``leaf`` rows or one value; only
then its rows are ordered. So no task holds more than ``leaf`` rows of a group, pivots steer only the work, and the
result is exact. Groups that are small from the start are ordered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage

#: Rows of a group that one task may order, and pivots of a round.
LEAF, PIVOTS = 100_000, 63


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"__{k}"])
    return out


def _narrowed(rows: DataFrame, places: DataFrame, keys: list[str], weighted: bool, leaf: int) -> DataFrame:
    """Places (keys, p, at) with the bracket of values (low, high] that holds each, of leaf rows or of one value.

    at is a rank from 0, or with weights the weight to be reached; below is what lies under the bracket, before the
    largest value there, least the smallest weight in it.
    """
    spans = ["low", "high"]
    state = places
    big = (F.col("n") > leaf) & (F.col("least_v") < F.col("most_v"))
    while state.filter(big).head(1):
        ranges = state.filter(big).select(*[F.col(k).alias(f"__{k}") for k in keys], *spans).distinct()
        inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
        held = rows.join(ranges, _same(rows, ranges, keys) & inside).select(*keys, "v", "w", *spans)
        parts = [i / PIVOTS for i in range(PIVOTS)]
        pivots = held.groupBy(*keys, *spans).agg(F.percentile_approx("v", parts, 10_000).alias("pivots"))
        pivots = pivots.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(s).alias(f"__{s}") for s in spans], "pivots")
        cut = held.join(pivots, _same(held, pivots, [*keys, *spans])).withColumn("i", F.size(F.filter("pivots", lambda p: p < F.col("v"))))
        cut = cut.select(*keys, *spans, "v", "w", "i", F.get("pivots", F.col("i") - 1).alias("from_v"), F.get("pivots", F.col("i")).alias("to_v"))
        each = cut.groupBy(*keys, *spans, "i").agg(
            F.count(F.lit(1)).alias("m"), F.sum("w").alias("mass"), F.min("v").alias("v1"), F.max("v").alias("v2"), F.min("w").alias("w1"), F.first("from_v").alias("from_v"), F.first("to_v").alias("to_v")
        )
        upto = Window.partitionBy(*keys, *spans).orderBy("i")  # a row a bracket
        before = upto.rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("under", F.coalesce(F.sum("mass").over(before), F.lit(0.0))).withColumn("prior", F.max("v2").over(before)).withColumn("last", F.lead("i").over(upto).isNull())
        right = each.select(*[F.col(c).alias(f"__{c}") for c in [*keys, *spans]], "m", "mass", "v1", "v2", "w1", "from_v", "to_v", "under", "prior", "last")
        big_rows = state.filter(big)
        joined = big_rows.join(right, _same(big_rows, right, [*keys, *spans]))
        if weighted:
            joined = joined.filter((F.col("below") + F.col("under") + F.col("mass") >= F.col("at")) | F.col("last"))
            first = Window.partitionBy(*keys, "p").orderBy("under")
            joined = joined.withColumn("first", F.row_number().over(first)).filter("first = 1")
        else:
            joined = joined.filter((F.col("below") + F.col("under") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("under") + F.col("mass")))
        down = joined.select(
            *keys, "p", "at", (F.col("below") + F.col("under")).alias("below"), F.coalesce("prior", "before").alias("before"), F.coalesce("from_v", "low").alias("low"), F.coalesce("to_v", "high").alias("high"),
            F.col("m").alias("n"), F.col("v1").alias("least_v"), F.col("v2").alias("most_v"), F.col("w1").alias("least_w"),
        )
        state = storage.scratch(state.filter(~big).unionByName(down), "brackets")
    return state


def _places(groups: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """A row a group and place, from its whole range."""
    nothing = F.lit(None).cast("double")
    return groups.select(*keys, F.explode(at).alias("x"), "n", "least_v", "most_v", "least_w").select(
        *keys, F.col("x.p").alias("p"), F.col("x.at").alias("at"), F.lit(0.0).alias("below"), nothing.alias("before"), nothing.alias("low"), nothing.alias("high"), "n", "least_v", "most_v", "least_w"
    )


def _ordered(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the brackets that have several values, with their place."""
    several = state.filter(F.col("least_v") < F.col("most_v"))
    right = several.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in several.columns if c not in keys])
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    return rows.join(right, _same(rows, right, keys) & inside).select(*keys, "v", "w", "p", "at", "below", "before")


def percentiles(df: DataFrame, keys: list[str], value: str, ends: dict[str, float], leaf: int = LEAF) -> DataFrame:
    """keys and, by name, exact percentiles of value, between the two nearest ranks; null where a group has no value."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1.0).alias("w"))
    groups = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least_v"), F.max("v").alias("most_v"), F.lit(1.0).alias("least_w"))
    if (groups.agg(F.max("n")).first()[0] or 0) <= leaf:
        return rows.groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(name) for name, p in ends.items()])
    groups = storage.scratch(groups, "groups")
    rows = rows.filter("v IS NOT NULL")
    ranks = []
    for name, p in ends.items():
        place = (F.col("n") - 1) * p
        ranks += [F.struct(F.lit(f"{name}<").alias("p"), F.floor(place).cast("double").alias("at")), F.struct(F.lit(f"{name}>").alias("p"), F.ceil(place).cast("double").alias("at"))]
    state = _narrowed(rows, _places(groups.filter("n > 0"), keys, F.array(*ranks)), keys, False, leaf)
    placed = _ordered(rows, state, keys).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "p").orderBy("v")) - 1)
    found = placed.filter(F.col("r") == F.col("at") - F.col("below")).select(*keys, "p", "v")
    found = found.unionByName(state.filter(F.col("least_v") >= F.col("most_v")).select(*keys, "p", F.col("most_v").alias("v")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == f"{name}{side}", F.col("v"))).alias(f"{name}{side}") for name in ends for side in "<>"])
    right = wide.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in wide.columns if c not in keys])

    def between(name: str, p: float) -> Column:
        place = (F.col("n") - 1) * p
        low, high = F.col(f"`{name}<`"), F.col(f"`{name}>`")
        return F.when(F.ceil(place) == F.floor(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return groups.join(right, _same(groups, right, keys), "left").select(*keys, *[between(name, p).alias(name) for name, p in ends.items()])


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, weight: str, ps: list[float], leaf: int = LEAF) -> DataFrame:
    """keys, p and value: rows in order of value and weight, the first at which the weights reach p of their sum.

    The value lies between the row before and that row, by how far into its weight the place is. Rows without value or
    of no weight don't count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter("v IS NOT NULL AND w > 0")
    groups = storage.scratch(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.sum("w").alias("total"), F.min("v").alias("least_v"), F.max("v").alias("most_v"), F.min("w").alias("least_w")), "groups")
    at = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.col("total") * float(p)).alias("at")) for p in ps])
    state = _narrowed(rows, _places(groups, keys, at), keys, True, leaf)
    order = Window.partitionBy(*keys, "p").orderBy("v", "w")
    steps = _ordered(rows, state, keys).select(
        *keys, "p", "at", "v", "w", (F.col("below") + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("c"), F.coalesce(F.lag("v").over(order), F.col("before")).alias("v0"), F.lead("v").over(order).isNull().alias("last")
    )
    met = steps.filter((F.col("c") >= F.col("at")) | F.col("last"))
    met = met.groupBy(*keys, "p").agg(F.min_by(F.struct("at", "v", "w", "c", "v0"), "c").alias("r")).select(*keys, "p", "r.*")
    part = (F.col("at") - (F.col("c") - F.col("w"))) / F.col("w")
    several = met.select(*keys, "p", F.when(F.col("v0").isNull() | (F.col("v0") == F.col("v")), F.col("v")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * part).alias("value"))
    alone = state.filter(F.col("least_v") >= F.col("most_v"))
    first = F.col("before").isNotNull() & (F.col("at") <= F.col("below") + F.col("least_w"))
    into = F.col("before") + (F.col("most_v") - F.col("before")) * (F.col("at") - F.col("below")) / F.col("least_w")
    return several.unionByName(alone.select(*keys, "p", F.when(first, into).otherwise(F.col("most_v")).alias("value")))
