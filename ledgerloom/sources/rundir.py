"""A run directory as tables: append-only JSON lines, JSON documents, Parquet copies; merges and exports.

Schemas are always given, never inferred. A missing log is an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

PREDICTIONS = (
    "model_id string, task string, split string, item_id string, pass string, raw string, content string, valid boolean, error string, latency_s double, "
    "t_start double, t_end double, prompt_tokens int, completion_tokens int, reasoning_tokens int, cached_tokens int, cost_usd double, provider string, "
    "model string, retries int, finish_reason string, temperature_sent boolean"
)
LEDGER = (
    "ts string, command string, model_id string, task string, item_id string, reserved_usd double, actual_usd double, cost_source string, prompt_tokens int, "
    "completion_tokens int, reasoning_tokens int, cached_tokens int, provider string"
)
JUDGE_SCORES = (
    "model_id string, split string, item_id string, judge_model string, verdict struct<facts:array<struct<index:int,present:boolean,correct:boolean>>,"
    "unsupported_claims:array<string>>, passed boolean, fact_recall double, within_limit boolean, key_token array<struct<index:int,check:boolean,judge:boolean,agree:boolean>>"
)
ITEMS = {
    "classification": "id string, text string, label string",
    "extraction": "id string, text string, reference_date string, gold map<string,string>",
    "pii_redaction": "id string, text string, spans array<struct<start:int,end:int,type:string>>",
    "summarisation": "id string, text string, max_words int, required_facts array<struct<index:int,kind:string,fact:string,key_tokens:map<string,string>>>",
    "entity_matching": "id string, left map<string,string>, right map<string,string>, match boolean",
}
LOGS = {"predictions": PREDICTIONS, "judge_scores": JUDGE_SCORES, "ledger": LEDGER}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON-lines files (plain or gzip, members concatenated or not); malformed and blank lines are left out."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = f"{schema}, _corrupt_record string"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("r")).filter("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def run_log(spark: SparkSession, run: str, name: str) -> DataFrame:
    """A log of a run: gzip if there is one, else plain; a missing one is empty."""
    for ending in (".jsonl.gz", ".jsonl"):
        if storage.exists(spark, f"{run}/{name}{ending}"):
            return json_lines(spark, f"{run}/{name}{ending}", LOGS[name])
    return spark.createDataFrame([], LOGS[name])


def predictions(spark: SparkSession, run: str, only_pass: str | None = "A") -> DataFrame:
    df = run_log(spark, run, "predictions").withColumn("pass", F.coalesce("pass", F.lit("A")))
    return df if only_pass is None else df.filter(F.col("pass") == only_pass)


def completed(predictions: DataFrame) -> DataFrame:
    """Distinct keys of calls that are done."""
    return predictions.select("model_id", "task", "split", "item_id", F.coalesce("pass", F.lit("A")).alias("pass")).dropDuplicates()


def to_do(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(completed(done), ["model_id", "task", "split", "item_id", "pass"], "left_anti")


def items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Items of a split in the file's order (``seq``)."""
    return json_lines(spark, path, ITEMS[kind]).withColumn("seq", F.monotonically_increasing_id())


def item_errors(items: DataFrame, kind: str, labels: list[str] = (), fields: list[str] = (), types: list[str] = ()) -> DataFrame:
    """id and the list of what is wrong with each item."""
    text = F.coalesce(F.trim("text") == "", F.lit(True)) if kind != "entity_matching" else F.lit(False)
    tests = [(F.col("id").isNull() | (F.col("id") == ""), "no id"), (text, "no text")]
    if kind == "classification":
        tests.append((F.coalesce(~F.col("label").isin(list(labels)), F.lit(True)), "unknown label"))
    elif kind == "extraction":
        tests.append((F.size(F.array_except(F.array(*map(F.lit, fields)), F.coalesce(F.map_keys("gold"), F.array()))) > 0, "missing field"))
    elif kind == "pii_redaction":
        wrong = lambda s: F.coalesce((s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length("text")), F.lit(True))
        tests += [(F.exists("spans", wrong), "span out of text"), (F.exists("spans", lambda s: F.coalesce(~s["type"].isin(list(types)), F.lit(True))), "unknown type")]
    elif kind == "entity_matching":
        tests += [(F.col("left").isNull() | F.col("right").isNull(), "no side"), (F.col("match").isNull(), "no match flag")]
    else:
        tests += [(F.coalesce(F.col("max_words") <= 0, F.lit(True)), "no word limit"), (F.exists("required_facts", lambda f: f["index"].isNull()), "fact without index")]
    return items.select("id", F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests])).alias("errors"))


def append(df: DataFrame, path: str) -> None:
    """Append as Parquet; the commit protocol stands for a lock."""
    df.write.mode("append").parquet(path)


def export_gzip(rows: list[dict], path: str) -> None:
    """Append a few records as one gzip member with sorted keys, the same bytes each time."""
    body = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows).encode()
    with open(path, "ab") as f:
        f.write(gzip.compress(body, mtime=0))


def merged(old: dict, new: dict) -> dict:
    """new over old; objects merge, other values are replaced."""
    return old | {k: merged(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def read_document(path: str, default=None):
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else default


def write_document(value, path: str, merge: bool = False) -> None:
    if merge:
        value = merged(read_document(path, {}), value)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n")


def append_ledger(df: DataFrame, run_path: str, common_path: str, batch: str | None = None) -> str:
    """Append paid calls to a run's ledger and to the one of all runs as one unit; the batch's name.

    Each ledger gets a folder of the batch, and one empty file in the common ledger's list makes the batch count in
    both. A writer that fails before has changed nothing that ``ledger`` reads, and one that repeats a batch by its name
    writes the same folders again, or nothing if it counts already.
    """
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    if storage.exists(spark, f"{common_path}/_batches/{batch}"):
        return batch
    df.write.mode("overwrite").parquet(f"{run_path}/batch={batch}")
    spark.read.schema(df.schema).parquet(f"{run_path}/batch={batch}").write.mode("overwrite").parquet(f"{common_path}/batch={batch}")
    storage.mark(spark, f"{common_path}/_batches/{batch}")
    return batch


def ledger(spark: SparkSession, path: str, common_path: str, schema: str = LEDGER) -> DataFrame:
    """Rows of a ledger, a run's or the common one, of the batches that count."""
    counted = {n for n, _ in storage.listed(spark, f"{common_path}/_batches")}
    folders = [f"{path}/{n}" for n, _ in storage.listed(spark, path) if n.startswith("batch=") and n.removeprefix("batch=") in counted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def leaves(docs: DataFrame, key: str = "key", doc: str = "doc") -> DataFrame:
    """key, path and text of each leaf of JSON objects: what isn't an object, or is an empty one. Malformed ones are left out.

    Level by level, an object's entries become rows; as many rounds as the deepest document has levels.
    """
    spark = docs.sparkSession
    level = docs.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(doc).cast("string")).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        inner = F.schema_of_variant("v")
        whole = F.coalesce(inner.startswith("OBJECT<") & (inner != "OBJECT<>"), F.lit(False))
        here = level.filter(~whole).select("key", "path", F.when(F.schema_of_variant("v") == "VOID", "null").otherwise(F.to_json("v")).alias("text"))
        out = here if out is None else out.unionByName(here)
        below = level.filter(whole)
        if not below.head(1):
            return out
        level = spark.sql("SELECT o.key, array_append(o.path, e.key) AS path, e.value AS v FROM {below} o, LATERAL variant_explode(o.v) e", below=below)


def assembled(rows: DataFrame) -> DataFrame:
    """key and doc of leaves (key, path, text), entries in order of their names; the other way round of ``leaves``."""
    rows = rows.withColumn("depth", F.size("path"))
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        deepest = rows.filter(F.col("depth") == depth)
        entry = F.struct(F.element_at("path", -1).alias("name"), F.col("text"))
        entries = deepest.groupBy("key", F.slice("path", 1, depth - 1).alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        quoted = lambda name: F.substring(F.to_json(F.array(name)), F.lit(2), F.length(F.to_json(F.array(name))) - 2)
        text = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(quoted(x["name"]), F.lit(":"), x["text"])), ","), F.lit("}"))
        rows = rows.filter(F.col("depth") < depth).unionByName(entries.select("key", "path", text.alias("text"), F.lit(depth - 1).alias("depth")))
    return rows.select("key", F.col("text").alias("doc"))


def merged_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """key and doc: new JSON objects (key, doc) over old ones, as ``merged`` does, for tables of any size.

    Both sides are rows of paths. An old leaf goes where new says something at its path or above it that isn't an
    object, or anything below it; an empty object says nothing where the other side has entries. All are joins by key
    and path, and what is left on both sides is put together again. Each key stands at most once on a side.
    """
    own, said = storage.scratch(leaves(old), "old"), storage.scratch(leaves(new), "new")
    above = lambda df: df.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    prefixes = own.select("key", F.col("path").alias("whole"), "text", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    replaced = prefixes.join(said.filter("text != '{}'").select("key", "path"), ["key", "path"], "left_semi").select("key", F.col("whole").alias("path"))
    opened = own.join(above(said).distinct(), ["key", "path"], "left_semi").select("key", "path")
    left = storage.scratch(own.join(replaced.unionByName(opened).distinct(), ["key", "path"], "left_anti"), "left")
    held = above(left).distinct()
    fresh = said.filter("text != '{}'").unionByName(said.filter("text = '{}'").join(held, ["key", "path"], "left_anti"))
    return assembled(storage.scratch(left.unionByName(fresh), "merged"))


def resolve_run(root: str, name: str | None = None) -> str:
    """A run's folder: a name under root, a path as it is, or the one whose name is last."""
    if name and name != "latest":
        found = next((p for p in (Path(root) / name, Path(name)) if p.is_dir()), None)
        if found is None:
            raise FileNotFoundError(name)
        return str(found)
    if not (found := latest(root)):
        raise FileNotFoundError(f"no run under {root}")
    return found


def latest(root: str) -> str | None:
    """The run whose name is last."""
    runs = sorted(p.name for p in Path(root).glob("*") if p.is_dir())
    return f"{root}/{runs[-1]}" if runs else None


def fingerprint(paths: list[str]) -> str:
    """Changes when a file's name, size or time does."""
    seen = [(p, s.st_size, s.st_mtime_ns) for p in sorted(paths) if Path(p).exists() for s in [Path(p).stat()]]
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def drift(spark: SparkSession, files: str, recorded: DataFrame) -> DataFrame:
    """Files (path, sha256) whose content isn't what was recorded."""
    now = spark.read.format("binaryFile").load(files).select("path", F.sha2("content", 256).alias("now"))
    return recorded.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now")))
