"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Everything here is DataFrame expressions and built-in aggregates.

Of each group (language and source, language, all) the estimate is sought that has the least determinant over three
quarters of the rows. Concentration begins at three places (medians and median deviations; all rows' moments; the moments of
the half nearest to the medians), goes two steps from each, keeps the one whose determinant is least, and goes on from there
until no group's determinant falls by a thousandth any more. The covariance is scaled by the factor that makes it
consistent for normal rows.

Defined results: a null or empty text has no words and fails the base rule; null lang or source form a group of
their own; repeated rows get equal verdicts; groups too small for an estimate use their language's, then the
corpus's; an empty table gives an empty result; extra columns are ignored by ``quality_verdicts`` and kept by
``quality_filter``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, read, staged

#: Dimensions of the statistic vector and the least standard deviation that an estimate may have in each.
FLOORS = {"len": 0.35, "mean": 0.12, "sym": 0.20, "dup": 0.10, "rep": 0.10}
DIMS = list(FLOORS)
#: Part of a group that the determinant is minimised over, steps from each start, steps in all at most, the fall of the
#: determinant's logarithm that counts, rows that an estimate needs.
SUBSET, STEPS, MOST_STEPS, FALL, LEAST_ROWS = 0.75, 2, 12, 1e-3, 60
#: Squared distance beyond which a document goes. Far beyond chi-square's tail at five degrees of freedom, since the
#: statistics of sound texts have heavier tails than a normal law; junk lies several times further out.
CUTOFF = 100.0


def chi_square(x: float, freedom: int) -> float:
    """Distribution of the chi-square law at x, for odd degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erf(math.sqrt(x / 2))
    for k in range(1, freedom, 2):
        total -= term
        term *= x / (k + 2)
    return total


def consistency(part: float, freedom: int) -> float:
    """What makes the covariance of the nearest part of normal rows that of all of them."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < part else (low, middle)
    return part / chi_square(low, freedom + 2)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once: an expression named inside a lambda would run for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(pairs: Column) -> Column:
    """Words under the repeated windows, of sorted (hash, place) pairs: equal neighbours are the repeats."""
    again = F.filter(
        pairs, lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | (F.get(pairs, i + 1)["h"] == p["h"])
    )
    return F.aggregate(
        F.array_sort(F.transform(again, lambda p: p["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text."""
    none = F.lit(0).cast("long")
    windows = _let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 8), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(8)])),
    )
    count = _let(
        windows,
        lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), none).otherwise(
            _let(F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered)
        ),
    )
    return F.when(F.size(words) < 9, none).otherwise(count)


def quality_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns (as struct ``__row``), lang, source and the statistics of each text."""
    t = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("__row"),
        docs["lang"].alias("lang"),
        docs["source"].alias("source"),
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    return base.select(
        "__row",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
    )


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "__len": F.log1p(F.col("n_words").cast("double")),
            "__mean": F.log(chars / n),
            "__sym": F.log1p(100 * F.col("n_symbols") / chars),
            "__dup": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "__rep": F.sqrt(F.col("n_repeat_words") / n),
            "__failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


LEVELS = 3


def _keys(df: DataFrame) -> Column:
    """A row's three groups: language and source, language, all."""
    lang, source = F.coalesce(F.col("lang"), F.lit("\u0000")), F.coalesce(F.col("source"), F.lit("\u0000"))
    return F.array(F.concat_ws("\u0001", F.lit("2"), lang, source), F.concat_ws("\u0001", F.lit("1"), lang), F.lit("0"))


def _cholesky(params: DataFrame) -> DataFrame:
    """Lower factor of the covariance, each variance no less than its floor."""
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            v = F.col(f"c_{b}_{a}") + (F.lit(FLOORS[a] ** 2) if i == j else F.lit(0.0))
            v = v - reduce(lambda s, k: s + F.col(f"f_{a}_{k}") * F.col(f"f_{b}_{k}"), DIMS[:j], F.lit(0.0))
            v = F.sqrt(F.greatest(v, F.lit(FLOORS[a] ** 2 / 4))) if i == j else v / F.col(f"f_{b}_{b}")
            params = params.withColumn(f"f_{a}_{b}", v)
    keep = ["__key", "__n", *[f"m_{d}" for d in DIMS], *[f"f_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]]
    return params.select(*keep)


def _distance(df: DataFrame, prefix: str = "") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i, a in enumerate(DIMS):
        v = F.col(f"__{a}") - F.col(f"m_{a}")
        v = reduce(lambda s, k: s - F.col(f"f_{a}_{k}") * F.col(f"__z_{k}"), DIMS[:i], v)
        df = df.withColumn(f"__z_{a}", v / F.col(f"f_{a}_{a}"))
    total = reduce(lambda s, d: s + F.col(f"__z_{d}") * F.col(f"__z_{d}"), DIMS, F.lit(0.0))
    return df.withColumn("__d2", total).drop(*[f"__z_{d}" for d in DIMS])


def _moments(scale: Column) -> list[Column]:
    """Centre and covariance; scale makes up for the tail that the subset lacks."""
    return [
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(f"__{d}").alias(f"m_{d}") for d in DIMS],
        *[(F.covar_pop(f"__{b}", f"__{a}") * scale).alias(f"c_{b}_{a}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]],
    ]


#: Groups up to which a table of estimates (some 200 bytes a group) is broadcast; salts that spread a group beyond it.
BROADCAST_GROUPS, SALTS = 20_000, 64


def _with(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """rows with their group's estimate. estimates is a written table, a row per group.

    The table is broadcast if it is small; otherwise both sides are salted, so that a group that holds most rows, as
    that of all rows does, is spread over many tasks.
    """
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), "__key", how)
    salted = estimates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(*[f"__{d}" for d in DIMS]), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", own).join(salted, ["__key", "__salt"], how).drop("__salt")


def _logdet(params: DataFrame) -> DataFrame:
    """With the logarithm of the covariance's determinant."""
    return params.withColumn("__logdet", reduce(lambda t, d: t + 2 * F.log(F.col(f"f_{d}_{d}")), DIMS, F.lit(0.0)))


def _concentrated(rows: DataFrame, params: DataFrame, part: float = SUBSET) -> DataFrame:
    """A step: the moments of each group's nearest part give the next estimate. Written before it is used."""
    far = _distance(_with(rows, params.drop("__logdet")))
    reach = staged(far.groupBy("__key").agg(F.percentile_approx("__d2", part, 1000).alias("__reach")), "mcd")
    near = _with(far.select("__key", "__d2", *[f"__{d}" for d in DIMS]), reach).filter("__d2 <= __reach")
    out = staged(_logdet(_cholesky(near.groupBy("__key").agg(*_moments(F.lit(consistency(part, len(DIMS))))))), "mcd")
    discard(reach)
    return out


STARTS = 3


def _at_start(df: DataFrame, start: int) -> DataFrame:
    return df.withColumn("__key", F.concat("__key", F.lit(f"\u0002{start}")))


def mcd_estimates(vectors: DataFrame) -> DataFrame:
    """One row per group: centre and covariance factor.

    Order statistics are mergeable sketches, moments are mergeable sums, so a group of any size is aggregated before the
    shuffle. Each step's result, a row per group and start, is written before the next; only the number of groups that
    still change comes to the driver.
    """
    rows = vectors.filter(~F.col("__failed")).select(F.explode(_keys(vectors)).alias("__key"), *[f"__{d}" for d in DIMS])
    medians = staged(rows.groupBy("__key").agg(*[F.percentile_approx(f"__{d}", 0.5, 1000).alias(f"m_{d}") for d in DIMS]), "mcd")
    spread = _with(rows, medians).groupBy("__key").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.percentile_approx(F.abs(F.col(f"__{d}") - F.col(f"m_{d}")), 0.5, 1000).alias(f"s_{d}") for d in DIMS],
    )
    robust = spread.join(medians, "__key").select(
        "__key",
        "__n",
        *[f"m_{d}" for d in DIMS],
        *[
            (F.pow(1.4826 * F.col(f"s_{a}"), F.lit(2.0)) if a == b else F.lit(0.0)).alias(f"c_{b}_{a}")
            for i, a in enumerate(DIMS)
            for b in DIMS[: i + 1]
        ],
    )
    first = staged(_logdet(_cholesky(robust)), "mcd")
    whole = staged(_logdet(_cholesky(rows.groupBy("__key").agg(*_moments(F.lit(1.0))))), "mcd")
    half = _concentrated(rows, first, 0.5)
    params = staged(reduce(DataFrame.unionByName, [_at_start(p, i) for i, p in enumerate((first, whole, half))]), "mcd")
    discard(medians, first, whole, half)
    three = rows.withColumn("__key", F.explode(F.array(*[F.concat("__key", F.lit(f"\u0002{i}")) for i in range(STARTS)])))
    for _ in range(STEPS):
        then = _concentrated(three, params)
        discard(params)
        params = then
    group = F.substring_index("__key", "\u0002", 1).alias("__key")
    columns = [c for c in params.columns if c not in ("__key", "__logdet")]
    best = params.groupBy(group).agg(F.min("__logdet").alias("__logdet"), F.min_by(F.struct(*columns), F.struct("__logdet", "__key")).alias("b"))
    best = staged(best.select("__key", "b.*", "__logdet"), "mcd")
    discard(params)
    for _ in range(MOST_STEPS - STEPS):
        then = _concentrated(rows, best)
        fell = then.join(best.select("__key", F.col("__logdet").alias("__was")), "__key").filter(F.col("__logdet") < F.col("__was") - FALL)
        done = fell.isEmpty()
        discard(best)
        best = then
        if done:
            break
    return best.drop("__logdet")


def quality_verdicts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Statistics, base rule and verdict of each row; the kept columns come as struct ``__row``."""
    stats = staged(quality_stats(docs, keep), "stats")
    return _judged(_vector(stats), mcd_estimates(_vector(stats)))


def _judged(vectors: DataFrame, params: DataFrame) -> DataFrame:
    params = params.filter(F.col("__n") >= int(LEAST_ROWS * SUBSET))
    named = vectors.withColumn("__keys", _keys(vectors))
    # The most specific group that has an estimate.
    fitted = params.select("__key", F.lit(True).alias("__has"))
    for level in range(LEVELS - 1):
        own = named.withColumn("__key", F.get("__keys", F.lit(level)))
        named = _with(own, fitted.withColumnRenamed("__has", f"__has{level}"), "left").drop("__key")
    named = named.withColumn(
        "__key",
        F.when(F.col("__has0"), F.get("__keys", F.lit(0))).when(F.col("__has1"), F.get("__keys", F.lit(1))).otherwise(F.get("__keys", F.lit(2))),
    )
    scored = _distance(_with(named, params, "left"))
    return scored.select(
        "__row",
        *STATS,
        F.col("__failed").alias("base_failed"),
        (~F.col("__failed") & (F.coalesce(F.col("__d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.col("__d2").alias("distance2"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, in their own columns.

    Texts are read twice, for the estimates and for the verdicts, which costs less than a copy of them would take.
    """
    stats = staged(quality_stats(docs, ["doc_id"]).drop("__row"), "stats")
    params = mcd_estimates(_vector(stats))
    discard(stats)
    return _judged(_vector(quality_stats(docs, docs.columns)), params).filter("kept").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(read(spark, sf_dir), ["doc_id"])
    return out.select(
        "__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )
