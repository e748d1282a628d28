"""Bootstrap intervals of metrics of sums, and samples by strata.

One law at all sizes: a resample draws as many rows as a group has, each row as likely as any other. A group is dealt by
a hash to strata of about ``leaf`` rows, so that no task holds more; how many of a resample's draws fall in a stratum is
multinomial, and is found by halving: at each node of a tree over the strata the draws of both halves are split
binomially, by a generator that seed, group and node fix. Every stratum follows its own path down the tree, so nothing
is shared but the sizes on the path, and all strata agree. Then a stratum draws its rows, and the strata's sums add up.
A group of one stratum draws as ``random.Random`` of the seed does, position by position.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a stratum, about; it changes which numbers are drawn, not their law.
LEAF = 5000


@lru_cache(maxsize=4)
def positions(seed: int, n: int, k: int) -> np.ndarray:
    """n resamples of k positions, as ``random.Random(seed).randrange`` draws them one after another.

    Both libraries have the same generator; a draw is its next number's highest bits, again while they are k or more.
    """
    *key, at = random.Random(seed).getstate()[1]
    twister = np.random.MT19937()
    state = twister.state
    state["state"] = {"key": np.array(key, np.uint32), "pos": at}
    twister.state = state
    bits, drawn, got = k.bit_length(), [], 0
    while got < n * k:
        raw = twister.random_raw(int((n * k - got) * 2**bits / k) + 64) >> np.uint64(32 - bits)
        drawn.append(raw[raw < k])
        got += len(drawn[-1])
    return np.concatenate(drawn)[: n * k].astype(np.int32).reshape(n, k)


@lru_cache(maxsize=1)
def turns(seed: int, resamples: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of resamples that draw n of n rows and then m of m, in turn from one generator, as ``positions`` does."""
    key, at = (state := random.Random(seed).getstate()[1])[:-1], state[-1]
    twister = np.random.MT19937()
    inner = twister.state
    inner["state"] = {"key": np.array(key, np.uint32), "pos": at}
    twister.state = inner
    raw = np.empty(0, np.uint64)
    drawn: list[list[np.ndarray]] = [[], []]
    place = 0
    for _ in range(resamples):
        for side, k in enumerate((n, m)):
            need = int(2.5 * k) + 64
            while True:
                if place + need > len(raw):
                    raw, place = np.concatenate([raw[place:], twister.random_raw(max(1 << 20, need))]), 0
                some = raw[place : place + need] >> np.uint64(32 - k.bit_length())
                good = np.flatnonzero(some < k)
                if len(good) >= k:
                    break
                need *= 2
            drawn[side].append(some[good[:k]].astype(np.int32))
            place += int(good[k - 1]) + 1
    return np.stack(drawn[0]), np.stack(drawn[1])


def bounds(values: Column, alpha: float) -> tuple[Column, Column]:
    """The order statistics at both ends of a sorted array; null of an empty one."""
    n = F.size(values)
    low = F.greatest(F.lit(0), F.least(n - 1, F.floor(n * (alpha / 2)).cast("int")))
    high = F.greatest(F.lit(0), F.least(n - 1, F.floor(n * (1 - alpha / 2)).cast("int") - 1))
    return F.get(values, low), F.get(values, high)


def _generator(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *[p % (1 << 64) for p in place]])))


def draws_in_stratum(seed: int, group: int, stratum: int, sizes: list[int], siblings: list[int], total: int, resamples: int) -> np.ndarray:
    """How many draws of each resample fall in a stratum: down the tree from the root, half by half.

    sizes and siblings are the rows of the node on the path and of the one beside it, from the root's children down; bit
    by bit from the highest, the stratum's number says which child is on the path.
    """
    n = np.full(resamples, total, np.int64)
    depth = len(sizes)
    for level in range(depth):
        prefix = stratum >> (depth - level)  # the node whose children part here
        right = stratum >> (depth - level - 1) & 1
        left_rows = siblings[level] if right else sizes[level]
        both = sizes[level] + siblings[level]
        left = _generator(seed, group, level, prefix).binomial(n, left_rows / both) if both else np.zeros_like(n)
        n = n - left if right else left
    return n


def _resampled(values: np.ndarray, seed: int, group: int, stratum: int, draws: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Sums of the columns of values over each resample's draws from its rows."""
    rng, out, at = _generator(seed, group, 1 << 32, stratum), np.zeros((len(draws), values.shape[1])), 0
    while at < len(draws):
        upto = at + max(1, int(np.searchsorted(np.cumsum(draws[at:]), chunk, "right")))
        taken = rng.integers(0, len(values), int(draws[at:upto].sum()))
        owner = np.repeat(np.arange(upto - at), draws[at:upto])
        for c in range(values.shape[1]):
            out[at:upto, c] = np.bincount(owner, values[taken, c], minlength=upto - at)
        at = upto
    return out


def _strata(rows: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """rows with the number of their stratum, its group, the depth of the tree and the sizes on the path to it."""
    on = lambda a, b, names: [a[k].eqNullSafe(b[f"__{k}"]) for k in names]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    deep = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__total", F.greatest(F.lit(0), F.ceil(F.log2(F.col("__total") / leaf)).cast("int")).alias("__depth"))
    number = F.when(F.col("__depth") == 0, 0).otherwise(F.expr("shiftrightunsigned(xxhash64(__order, 11), 64 - __depth)"))
    dealt = rows.join(deep, on(rows, deep, keys)).select(*rows.columns, "__total", "__depth", number.cast("long").alias("__stratum"))
    held = dealt.filter("__depth > 0").groupBy(*keys, "__depth", "__stratum").agg(F.count(F.lit(1)).alias("m"))
    levels = held.select(*keys, "__depth", F.explode(F.sequence(F.lit(1), F.col("__depth"))).alias("level"), "__stratum", "m")
    levels = levels.withColumn("node", F.expr("shiftright(__stratum, __depth - level)"))
    nodes = levels.groupBy(*keys, "level", "node").agg(F.sum("m").alias("size"))
    pairs = nodes.groupBy(*keys, "level", F.expr("shiftright(node, 1)").alias("parent")).agg(*[F.coalesce(F.sum(F.when(F.col("node") % 2 == i, F.col("size"))), F.lit(0)).alias(f"s{i}") for i in (0, 1)])
    pairs = pairs.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("level").alias("__level"), F.col("parent").alias("__parent"), "s0", "s1")
    ends = levels.withColumn("parent", F.expr("shiftright(node, 1)"))
    ends = ends.join(pairs, on(ends, pairs, [*keys, "level", "parent"]))
    own = F.when(F.col("node") % 2 == 1, F.col("s1")).otherwise(F.col("s0"))
    paths = ends.groupBy(*keys, "__stratum").agg(F.sort_array(F.collect_list(F.struct("level", own.alias("own"), (F.col("s0") + F.col("s1") - own).alias("other")))).alias("__path"))
    paths = paths.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__stratum").alias("____stratum"), F.transform("__path", lambda x: x["own"]).alias("__sizes"), F.transform("__path", lambda x: x["other"]).alias("__siblings"))
    return dealt.join(paths, on(dealt, paths, [*keys, "__stratum"]), "left").select(*dealt.columns, "__sizes", "__siblings")


def bootstrap_metric(scores: DataFrame, keys: list[str], columns: list[str], metric: Column, order: str, resamples: int = 1000, seed: int = 7, alpha: float = 0.05, leaf: int = LEAF) -> DataFrame:
    """keys, estimate, low and high of a metric, an expression over the sums of columns, which keep their names.

    order names the rows of a group, so that draws don't depend on partitioning. Null statistics count as 0. Resamples
    whose metric is null are left out; a group without any other gets null bounds. The column ``one`` counts rows.
    """
    if not keys:  # one group
        return bootstrap_metric(scores.withColumn("__all", F.lit(0)), ["__all"], columns, metric, order, resamples, seed, alpha, leaf).drop("__all")
    names = list(dict.fromkeys([*columns, "one"]))
    rows = scores.withColumn("one", F.lit(1)).select(*keys, F.col(order).alias("__order"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    placed = _strata(rows, keys, leaf).withColumn("__group", F.xxhash64(*keys))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scores.select(*keys).schema.fields)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", *names])
        first, values = pdf.iloc[0], pdf[names].to_numpy(float)
        if first["__depth"]:
            place = int(first["__group"]), int(first["__stratum"])
            draws = draws_in_stratum(seed, *place, [int(x) for x in first["__sizes"]], [int(x) for x in first["__siblings"]], int(first["__total"]), resamples)
            sums = _resampled(values, seed, *place, draws)
        else:
            taken = positions(seed, resamples, len(pdf))
            sums = np.stack([values[:, c][taken].sum(1) for c in range(len(names))], 1)
        out = pd.DataFrame({"__resample": np.arange(resamples)} | {c: sums[:, i] for i, c in enumerate(names)} | {f"{c}__all": np.where(np.arange(resamples) == 0, values[:, i].sum(), 0.0) for i, c in enumerate(names)})
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    sums = ", ".join(f"`{c}` double" for c in [*names, *[f"{c}__all" for c in names]])
    drawn = placed.groupBy(*keys, "__stratum").applyInPandas(resample, f"{typed}, __resample int, {sums}")
    each = drawn.groupBy(*keys, "__resample").agg(*[F.sum(c).alias(c) for c in names], *[F.sum(f"{c}__all").alias(f"{c}__all") for c in names])
    each = each.select(*keys, metric.alias("m"), *[f"{c}__all" for c in names])
    low, high = bounds(F.col("v"), alpha)
    ends = each.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("v"), *[F.sum(f"{c}__all").alias(c) for c in names])
    return ends.select(*keys, metric.alias("estimate"), low.alias("low"), high.alias("high"))


def bootstrap_ci(scores: DataFrame, keys: list[str], top: str, bottom: str, order: str, resamples: int = 1000, seed: int = 7, alpha: float = 0.05, leaf: int = LEAF) -> DataFrame:
    """keys, estimate, low and high of sum(top) / sum(bottom)."""
    ratio = F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom))
    return bootstrap_metric(scores, keys, [top, bottom], ratio, order, resamples, seed, alpha, leaf)


def rogan_gladen(p: np.ndarray, tpr: np.ndarray, tnr: np.ndarray) -> np.ndarray:
    """Rates corrected for a judge's errors, kept in [0, 1]; not a number where the judge says nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(tpr + tnr > 1, np.clip((p + tnr - 1) / (tpr + tnr - 1), 0, 1), np.nan)


def corrected_rates(
    passed: DataFrame, keys: list[str], ok: str, order: str, holdout: DataFrame, label: str, said: str, by: str, resamples: int = 1000, seed: int = 7, alpha: float = 0.05, leaf: int = LEAF
) -> DataFrame:
    """keys, n, raw and corrected pass rate, low and high: both the judged rows and the judge's holdout are resampled.

    Rows matter by their outcome alone, so a resample's passes are binomial and the holdout's four outcomes multinomial.
    They are drawn as such where either side has more than leaf rows, and row by row in turn from one generator, which
    is the same law, where both fit a stratum.
    """
    cells = holdout.select(F.col(label).cast("int").alias("y"), F.col(said).cast("int").alias("s"), F.col(by).alias("o"))
    counted = {(r["y"], r["s"]): r["n"] for r in cells.groupBy("y", "s").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    tally = np.array([counted.get(c, 0) for c in ((1, 1), (1, 0), (0, 1), (0, 0))], float)
    held = np.array([(1 - r["y"]) * 2 + (1 - r["s"]) for r in cells.orderBy("o").collect()]) if tally.sum() <= leaf else None
    groups = passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok).cast("int")).alias("k"))
    few = groups.filter(F.col("n") <= (leaf if held is not None else 0)).select(*keys)
    lists = passed.join(few, keys, "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ok).cast("int").alias("p")))), lambda x: x["p"]).alias("rows"))

    @F.pandas_udf("array<double>")
    def interval(n: pd.Series, k: pd.Series, rows: pd.Series, group: pd.Series) -> pd.Series:
        out = []
        for a, b, c, g in zip(n, k, rows, group, strict=True):
            if not tally.sum() or not a:
                out.append([None] * 3)
                continue
            p, drawn = _by_rows(np.asarray(c), held, resamples, seed) if c is not None else _by_counts(int(a), int(b), tally, resamples, [seed, int(g) % (1 << 64)])
            out.append(corrected_interval(p, drawn, b / a, tally, alpha))
        return pd.Series(out)

    out = groups.join(lists, keys, "left").select(*keys, "n", (F.col("k") / F.col("n")).alias("raw"), interval("n", "k", "rows", F.xxhash64(*keys)).alias("i"))
    return out.select(*keys, "n", "raw", *[F.get("i", F.lit(j)).alias(c) for j, c in enumerate(("corrected", "low", "high"))])


def _by_rows(rows: np.ndarray, held: np.ndarray, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pass rate and the holdout's four counts of each resample, by rows."""
    first, second = turns(seed, resamples, len(rows), len(held))
    return rows[first].mean(1), np.stack([(held[second] == c).sum(1) for c in range(4)], 1).astype(float)


def _by_counts(n: int, k: int, tally: np.ndarray, resamples: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rng, m = np.random.default_rng(seed), int(tally.sum())
    return rng.binomial(n, k / n, resamples) / n, rng.multinomial(m, tally / m, resamples).astype(float)


def corrected_interval(p: np.ndarray, drawn: np.ndarray, rate: float, tally: np.ndarray, alpha: float) -> list[float | None]:
    """Corrected rate and its bounds, by resamples of the rate and of the holdout's counts of (label, judge): 11, 10, 01, 00."""
    with np.errstate(invalid="ignore", divide="ignore"):
        estimates = rogan_gladen(p, drawn[:, 0] / (drawn[:, 0] + drawn[:, 1]), drawn[:, 3] / (drawn[:, 2] + drawn[:, 3]))
        point = rogan_gladen(np.array([rate]), np.array([tally[0] / (tally[0] + tally[1])]), np.array([tally[3] / (tally[2] + tally[3])]))[0]
    good = np.sort(estimates[~np.isnan(estimates)])
    at = lambda q: float(good[min(max(q, 0), len(good) - 1)]) if len(good) else None
    return [None if np.isnan(point) else float(point), at(int(alpha / 2 * len(good))), at(int((1 - alpha / 2) * len(good)) - 1)]


def allocation(counts: DataFrame, key: str, n: int) -> DataFrame:
    """key, count and take: proportional parts of n, rounded half-even; what is over or short goes round the groups that can take it, largest first."""
    everything = Window.partitionBy()  # a row a group
    base = counts.withColumn("base", F.least("count", F.bround(F.col("count") * float(n) / F.sum("count").over(everything)).cast("long")))
    base = base.withColumn("diff", F.lit(n) - F.sum("base").over(everything))
    base = base.withColumn("able", F.when(F.col("diff") < 0, F.col("base") > 0).otherwise(F.col("base") < F.col("count")))
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("able").orderBy(F.desc("count"), key)))
    step = F.when(F.col("able") & (F.col("rank") <= F.abs("diff")), F.signum("diff").cast("long")).otherwise(F.lit(0))
    return ranked.select(key, "count", (F.col("base") + step).alias("take"))


#: Parts of the range of hashes by which a group's rows are counted before any are ranked.
SLICES = 4096


def stratified_sample(df: DataFrame, key: str, n: int, order: str, seed: int = 7) -> DataFrame:
    """Proportional sample of n rows by strata; within a stratum the rows with the least hashes of ``order``, ties by it.

    Rows are counted by slices of the hash first; whole slices are taken, and only the slice that the quota ends in is
    ranked, so that a stratum of any size is no single task.
    """
    counts = df.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if n <= 0 or not total:
        return df.limit(0)
    if n >= total:
        return df
    quota = allocation(counts, key, n).select(F.col(key).alias("__key"), F.col("take").alias("__take"))
    chance = F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(1 << 40))
    rows = df.withColumn("__chance", chance).withColumn("__slice", (F.col("__chance") / ((1 << 40) / SLICES)).cast("int"))
    sliced = rows.groupBy(F.col(key).alias("__key"), F.col("__slice").alias("__s")).agg(F.count(F.lit(1)).alias("__m"))
    sliced = sliced.join(quota, sliced["__key"].eqNullSafe(quota["__key"])).select(sliced["__key"], "__s", "__m", "__take")
    before = F.sum("__m").over(Window.partitionBy("__key").orderBy("__s")) - F.col("__m")
    sliced = sliced.withColumn("__left", F.col("__take") - before).filter("__left > 0")
    near = rows.join(sliced, rows[key].eqNullSafe(sliced["__key"]) & (rows["__slice"] == sliced["__s"]))
    whole = near.filter("__left >= __m").select(*df.columns)
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__chance", order))
    edge = near.filter("__left < __m").withColumn("__place", place).filter("__place <= __left").select(*df.columns)
    return whole.unionByName(edge)
