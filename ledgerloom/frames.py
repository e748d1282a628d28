"""Queries that are DataFrame code: streams, resampling, similarities, lenient parsing, learnt baselines, full gates."""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sql, storage
from .functions import fuzzy, parsing
from .operators.baseline import LabelBaseline, label_baseline
from .operators.resampling import bootstrap_metric, corrected_rates, stratified_sample
from .sources import rundir
from .streaming import budget, jobs

Tables = dict[str, DataFrame] | None


def _ratio(top: Column, bottom: Column, none: float | None) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(none).cast("double"))


def metric_of(task: str) -> Column:
    """The main metric of a task's kind over sums of outcomes."""
    a, b, c, d = (F.col(x) for x in "abcd")
    recall, precision = _ratio(a, b, 1.0), _ratio(c, d, 0.0)
    return {
        "classification": _ratio(a, F.col("one"), None),
        "entity_matching": _ratio(2 * a, 2 * a + b + c, 0.0),
        "extraction": _ratio(a, b, None),
        "pii_redaction": _ratio(5 * precision * recall, 4 * precision + recall, 0.0),
        "summarisation": _ratio(a, b, None),
    }[task]


def bootstrap(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Each model's main metric with its interval, by task and split."""
    scores = sql.run(spark, sf_dir, "SELECT model_id, task, split, seq, a, b, c, d, e FROM scored WHERE pass = 'A'", tables)
    kinds = ["classification", "entity_matching", "extraction", "pii_redaction", "summarisation"]
    whole = F.coalesce(*[F.when(F.col("task") == k, metric_of(k)) for k in kinds])
    return bootstrap_metric(scores, ["model_id", "task", "split"], ["a", "b", "c", "d", "e"], whole, "seq")


def corrected_rate(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Judged pass rates with intervals, corrected for the judge's two error rates; both sides are resampled."""
    passed = sql.run(spark, sf_dir, "SELECT model_id, split, item_id, passed FROM judge_passed WHERE judged", tables)
    holdout = sql.run(spark, sf_dir, "SELECT id, label_pass, predicted_pass FROM judged_holdout", tables)
    return corrected_rates(passed, ["model_id", "split"], "passed", "item_id", holdout, "label_pass", "predicted_pass", "id")


def tuned(scored: DataFrame, score: str, match: str) -> DataFrame:
    """One row: threshold of the best F1 (the lowest of equals; 0 and 1 are tried, too), F1, and the band where both classes lie."""
    rows = scored.select(F.col(score).alias("s"), F.col(match).cast("int").alias("m"))
    steps = rows.select(F.round("s", 6).alias("t"), F.col("m").alias("pos"), (1 - F.col("m")).alias("neg")).unionByName(scored.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "t double, pos int, neg int"))
    steps = steps.groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)  # a row a distinct score, of six places
    swept = steps.select("t", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), (F.sum("pos").over(Window.partitionBy()) - F.sum("pos").over(down)).alias("fn"))
    best = swept.select("t", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0).alias("f1")).orderBy(F.desc("f1"), "t").limit(1)
    ends = rows.agg(F.min(F.when(F.col("m") == 1, F.col("s"))).alias("lo"), F.max(F.when(F.col("m") == 0, F.col("s"))).alias("hi"))
    both = F.col("lo") <= F.col("hi")
    return best.crossJoin(ends).select(F.col("t").alias("threshold"), "f1", F.when(both, F.col("lo")).otherwise(F.col("t")).alias("band_low"), F.when(both, F.col("hi")).otherwise(F.col("t")).alias("band_high"))  # one row each


def _spaced(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")))


def grounded_fields(spark: SparkSession, sf_dir: str, tables: Tables = None, only_misses: bool = False) -> DataFrame:
    """Grounded fields with how close they come to a stretch of their source; what stands in it as it is has 100."""
    d = sql.run(spark, sf_dir, "SELECT f.seq, f.field, f.split, f.said, i.text, f.gold_value IS NOT DISTINCT FROM f.said_value AS correct FROM enquiry_fields f JOIN enquiry_items i ON i.item_id = f.item_id AND i.split = f.split WHERE f.ok AND f.grounded AND f.said IS NOT NULL", tables)
    d = d.select("seq", "field", "split", "correct", _spaced("said").alias("v"), _spaced("text").alias("s"))
    inside = (F.col("v") != "") & F.contains(F.col("s"), F.col("v"))
    ratio = F.when(F.col("v") == "", 0.0).when(inside, 100.0).otherwise(fuzzy.partial_ratio(F.when(~inside, F.col("v")), F.when(~inside, F.col("s"))))
    out = d.select("seq", "field", "split", "correct", inside.alias("inside"), ratio.alias("ratio"))
    return out.filter(~F.col("inside")) if only_misses else out


def partial_ratio(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    return grounded_fields(spark, sf_dir, tables).select("seq", "field", F.round("ratio", 6).alias("ratio"))


def grounding_ratio(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """The ratio that all but one in a hundred of the right values reach, kept between 80 and 100; 80 without any, 100 if no field is grounded."""
    fields = sql.run(spark, sf_dir, "SELECT count(*) FILTER (WHERE grounded) AS n_fields FROM fields", tables)
    counts = grounded_fields(spark, sf_dir, tables).filter("correct AND split = 'calib'").groupBy("ratio").count()
    up = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)  # a row a distinct ratio
    steps = counts.select("ratio", F.sum("count").over(up).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    low = steps.filter(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * 0.01))).agg(F.min("ratio").alias("low"))
    value = F.when(F.col("n_fields") == 0, 100.0).otherwise(F.greatest(F.lit(80.0), F.least(F.lit(100.0), F.coalesce("low", F.lit(80.0)))))
    return low.crossJoin(fields).select(value.alias("ratio"))  # one row each


def grounded(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Contained, or as close to a stretch of the source as the tuned ratio asks."""
    least = F.broadcast(grounding_ratio(spark, sf_dir, tables).withColumnRenamed("ratio", "least"))  # one row
    return grounded_fields(spark, sf_dir, tables).crossJoin(least).select("seq", "field", (F.col("inside") | (F.col("ratio") >= F.col("least"))).alias("grounded"))


def first_json(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    return sql.run(spark, sf_dir, "SELECT event_id, raw FROM raw_json", tables).select("event_id", parsing.first_json(F.col("raw")).alias("value"))


def wrapped(body: Column, by: Column) -> Column:
    """What a model may put around an answer."""
    return (
        F.when(by % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(by % 4 == 1, F.concat(F.lit("<think>{ maybe }</think> Sure: "), body, F.lit(" done {")))
        .when(by % 16 == 2, F.substring(body, 1, 12))
        .otherwise(body)
    )


def parse_extraction(raw: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, ok and exactly the declared fields, in order; missing ones null, others dropped. Not an object: not ok."""
    value = raw.select(key, parsing.first_json(F.col("raw")).alias("v"))
    got = F.from_json("v", "map<string,string>")
    ok = F.coalesce(F.col("v").startswith("{"), F.lit(False))
    return value.select(key, ok.alias("ok"), *[F.when(ok, got[f]).alias(f) for f in fields])


def extraction(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    said = sql.run(spark, sf_dir, "SELECT seq, field, said FROM enquiry_said WHERE ok", tables)
    bodies = said.groupBy("seq").agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct("field", "said"))), F.create_map(F.lit("more"), F.lit("x")))).alias("body"))
    fields = "company email phone country seats budget currency meeting urgency".split()
    return parse_extraction(bodies.select("seq", wrapped(F.col("body"), F.col("seq")).alias("raw")), "seq", fields)


def parse_pii_entries(raw: DataFrame, key: str) -> DataFrame:
    """key, ok and the entries (type, text) of an answered list whose text is a string that isn't blank."""
    value = raw.select(key, parsing.first_json(F.col("raw")).alias("v"))
    items = F.transform(F.from_json("v", "array<string>"), lambda x: F.from_json(x, "type string, text string"))
    strings = F.transform(F.from_json("v", "array<string>"), lambda x: F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), "$.text", "variant")) == "STRING")
    kept = F.transform(F.filter(F.arrays_zip(items.alias("e"), strings.alias("s")), lambda z: F.coalesce(z["s"] & (F.trim(z["e"]["text"]) != ""), F.lit(False))), lambda z: z["e"])
    ok = F.coalesce(F.col("v").startswith("["), F.lit(False))
    return value.select(key, ok.alias("ok"), F.when(ok, kept).alias("entries"))


def parse_pii(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    said = sql.run(spark, sf_dir, "SELECT seq, pos, type, text FROM letter_entries", tables)
    bodies = said.groupBy("seq").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "text"))), lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text")))).alias("body"))
    junk = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(', {"type": "PHONE", "text": " "}, 3, {"type": "NAME"}, {"text": 7}]'))
    parsed = parse_pii_entries(bodies.select("seq", wrapped(junk, F.col("seq")).alias("raw")), "seq")
    return parsed.select("seq", "ok", F.size("entries").alias("n"), F.get("entries", F.lit(0))["text"].alias("first_text"))


def judge_verdicts(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Verdicts that judge each of a summary's facts once, with the facts in order; others are null."""
    facts = sql.run(spark, sf_dir, "SELECT model_id, split, item_id, ix, present, right_one, claims FROM facts WHERE has_judge", tables)
    key = ["model_id", "split", "item_id"]
    said = facts.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("claims").alias("c"), F.collect_list(F.struct(F.when(F.col("item_id") % 7 == 3, F.lit(0)).otherwise(F.col("ix")).alias("index"), "present", F.col("right_one").alias("correct"))).alias("facts"))
    body = F.to_json(F.struct("facts", F.transform(F.sequence(F.lit(1), F.col("c") + 1), lambda x: F.concat(F.lit("claim "), x.cast("string"))).alias("unsupported_claims")))
    raw = said.select(*key, "n", wrapped(body, F.col("item_id")).alias("raw"))

    @F.pandas_udf("ok boolean, good int, claims int")
    def parse(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        got = [parsing.verdict(parsing.first_value(x), int(k)) for x, k in zip(s, n, strict=True)]
        return pd.DataFrame({"ok": [g is not None for g in got], "good": [sum(f[1] and f[2] for f in g[0]) if g else None for g in got], "claims": [len(g[1]) if g else None for g in got]})

    return raw.select(*key, parse(parsing.strip_wrappers(F.col("raw")), "n").alias("v")).select(*key, "v.ok", "v.good", "v.claims")


def tfidf(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Languages of the documents outside of the training split."""
    docs = sql.run(spark, sf_dir, "SELECT doc_id, lang, coalesce(text, '') AS text FROM documents", tables)
    predict = label_baseline(docs.filter("doc_id % 3 = 0"), "text", "lang")
    return predict(docs.filter("doc_id % 3 <> 0")).select("doc_id", F.col("lang").alias("label"), F.col("predicted").alias("prediction"))


def _version(spark: SparkSession, sf_dir: str, statement: str, tables: Tables) -> tuple[str, bool]:
    """Version of what a statement reads, and whether it lasts: by its files, or by the rows where one's own tables are read."""
    text = sql.statement(statement, {k: v for k, v in sql.RELATIONS.items() if k not in (tables or {})})
    if any(re.search(rf"\b{t}\b", text) for t in tables or {}):
        df = sql.run(spark, sf_dir, statement, tables)
        row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
        return hashlib.sha256(repr((statement, *row)).encode()).hexdigest()[:24], False
    state = storage.state(spark, [f"{sf_dir}/{t}.parquet" for t in sql.TABLES if re.search(rf"\b{t}\b", text)])
    return hashlib.sha256(f"{text} {state}".encode()).hexdigest()[:24], True


def topic_model(spark: SparkSession, sf_dir: str, tables: Tables = None) -> LabelBaseline:
    """The label baseline fitted on calib, from the shared folder if that was done for these rows."""
    rows = "SELECT text, gold FROM topic_items WHERE split = 'calib'"
    version, lasting = _version(spark, sf_dir, rows, tables)
    fit = lambda path: label_baseline(sql.run(spark, sf_dir, rows, tables), "text", "gold").save(path)
    return LabelBaseline.load(storage.published(spark, "topic_blocks", version, fit, lasting))


def gate_numbers(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """One row: threshold and band of pairs, and the grounding ratio; tuned on calib once for the state of its rows."""
    versions = [_version(spark, sf_dir, q, tables) for q in ("SELECT * FROM pair_scores", "SELECT * FROM enquiry_fields WHERE split = 'calib'", "SELECT * FROM enquiry_items WHERE split = 'calib'", "SELECT * FROM fields")]

    def tune() -> DataFrame:
        band = sql.run(spark, sf_dir, "SELECT threshold, band_low, band_high FROM match_band", tables)
        return band.crossJoin(grounding_ratio(spark, sf_dir, tables).withColumnRenamed("ratio", "grounding_ratio"))  # one row each

    return storage.kept(tune, spark, "gate_numbers", hashlib.sha256(repr(versions).encode()).hexdigest()[:24], all(x for _, x in versions))


def gate_tables(spark: SparkSession, sf_dir: str, tables: Tables = None) -> dict[str, DataFrame]:
    """What gates compare with beyond SQL, by models and numbers of calib: labels, the band, close matches."""
    tables = dict(tables or {})
    topics = sql.run(spark, sf_dir, "SELECT item_id, split, text, gold FROM topic_items", tables)
    topic = topic_model(spark, sf_dir, tables)(topics).select("item_id", "split", F.col("predicted").alias("base_label"))
    numbers = gate_numbers(spark, sf_dir, tables)
    least = F.broadcast(numbers.select(F.col("grounding_ratio").alias("least")))  # one row
    close = grounded_fields(spark, sf_dir, tables, only_misses=True).crossJoin(least).filter("ratio >= least").select("seq", "field")
    return {"topic_baseline": topic, "match_band": numbers.select("threshold", "band_low", "band_high"), "grounded_more": close}


def gates(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Evidence gates of all kinds with all evidence; ``plans.gates`` holds the rules."""
    full = gate_tables(spark, sf_dir, tables) | dict(tables or {})
    return sql.run(spark, sf_dir, "SELECT seq, model_id, task, passed, reason FROM gate_results", full)


def thresholds(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """All numbers that gates were tuned to."""
    topic_model(spark, sf_dir, tables)
    return gate_numbers(spark, sf_dir, tables).withColumn("labels_trained", F.lit(True))


def mixed_sample(spark: SparkSession, sf_dir: str, tables: Tables = None, n: int = 100, seed: int = 7) -> DataFrame:
    """n draws of a task by its weight; each takes the task's next item in the order of a seeded hash, from the first again when they run out."""
    mix = sorted((r["task"], r["weight"]) for r in sql.run(spark, sf_dir, "SELECT task, weight FROM mix", tables).collect())
    rng, cursor, drawn = random.Random(seed), {}, []
    for place, task in enumerate(rng.choices([t for t, _ in mix], weights=[w for _, w in mix], k=n)):
        drawn.append((place, task, cursor.get(task, 0)))
        cursor[task] = cursor.get(task, 0) + 1
    draws = spark.createDataFrame(drawn, "place int, task string, at int")
    items = sql.run(spark, sf_dir, "SELECT task, item_id FROM items WHERE split = 'test'", tables)
    sizes = items.groupBy("task").count()
    order = Window.partitionBy("task").orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id")
    first = items.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < n)
    taken = F.broadcast(draws).join(sizes, "task").withColumn("rank", F.col("at") % F.col("count"))
    return first.join(taken, ["task", "rank"]).select("place", "task", "item_id")


def sample(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """A hundred calls, in proportion to tasks."""
    return stratified_sample(sql.run(spark, sf_dir, "SELECT seq, task, model_id FROM calls", tables), "task", 100, "seq")


_OLD = """SELECT event_id AS key, '{"props": ' || props || ', "seen": {"type": "' || event_type || '", "by": [1, 2]}}' AS doc FROM events WHERE event_id % 3 < 2"""
_NEW = """SELECT event_id AS key, '{"props": {"k": -1, "more": {"v": ' || event_id || '}}, "seen": {"by": [3]}, "kind": {}}' AS doc FROM events WHERE event_id % 3 > 0"""


def merged_events(spark: SparkSession, sf_dir: str, tables: Tables = None) -> DataFrame:
    """Documents of events with later ones over them, as they read after the merge."""
    docs = rundir.merged_documents(sql.run(spark, sf_dir, _OLD, tables), sql.run(spark, sf_dir, _NEW, tables))
    return docs.select("key", *[F.get_json_object("doc", f"$.{path}").alias(name) for name, path in _PATHS.items()])


_PATHS = {"k": "props.k", "v": "props.more.v", "type": "seen.type", "by": "seen.by", "kind": "kind"}
QUERIES = {
    "deep_merge_documents": merged_events,
    "stratified_sample": sample,
    "bootstrap_ci": bootstrap,
    "corrected_pass_rate_ci": corrected_rate,
    "partial_ratio": partial_ratio,
    "grounded": grounded,
    "grounding_ratio": grounding_ratio,
    "parse_first_json": first_json,
    "parse_extraction": extraction,
    "parse_pii": parse_pii,
    "judge_verdict_parse": judge_verdicts,
    "tfidf_predict": tfidf,
    "gates": gates,
    "gate_context": thresholds,
    "mixed_sample": mixed_sample,
}
#: What some of these queries mean, in SQL of DuckDB's own.
TWINS = {
    "deep_merge_documents": f"""
SELECT key, {", ".join(f"json_extract_string(doc, '$.{path}') AS {name}" for name, path in _PATHS.items())}
FROM (SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN o.doc::JSON WHEN o.key IS NULL THEN n.doc::JSON ELSE json_merge_patch(o.doc::JSON, n.doc::JSON) END AS doc FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.key = o.key) x""",
}
#: Streams read files as they come; replacements of relations don't reach them.
STREAMS = {
    "stream_tumbling_minute": jobs.minute_counts,
    "stream_router_stats": jobs.running_totals,
    "stream_router_percentiles": jobs.running_percentiles,
    "stream_dedup": jobs.first_keys,
    "budget_guard": budget.budget_guard,
}
