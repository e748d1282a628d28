"""Named relations in SQL that Spark and DuckDB both read, and the few places where the dialects part.

A relation may use tables and other relations; ``statement`` puts what it needs before it, in order. Catalyst gets one
statement per query and plans it as a whole: it pushes filters and columns to the scans, and reads a table once where
plans agree. Any relation can be replaced by a table of one's own (``tables``), so that all queries run over one's own
calls, items, models and settings.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import storage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RELATIONS: dict[str, str] = {}
_NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", re.I)


def relation(name: str, sql: str) -> str:
    RELATIONS[name] = sql.strip()
    return name


def either(ours: str, theirs: str) -> str:
    """An expression that the dialects write differently: Spark reads the second as a comment. Such can't be nested."""
    return f"/*<*/{ours}/*|{theirs}>*/"


#: Relations that Spark makes by DataFrame code; their SQL says what they mean, and DuckDB runs that.
COMPUTED: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}


def computed(name: str, sql: str, make: Callable[[Callable[[str], DataFrame]], DataFrame]) -> str:
    """make gets a function that runs SQL over relations, and returns the relation's DataFrame."""
    COMPUTED[name] = make
    return relation(name, sql)


def needed(sql: str, relations: dict[str, str] = RELATIONS) -> list[str]:
    """Relations that sql uses, each after those it uses itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in relations and name not in out:
                visit(relations[name])
                out.append(name)

    visit(sql)
    return out


def statement(sql: str, relations: dict[str, str] = RELATIONS) -> str:
    names = needed(sql, relations)
    return (f"WITH {', '.join(f'{n} AS ({relations[n]})' for n in names)} " if names else "") + sql.strip()


#: Names of the same functions in DuckDB.
_DUCK = {
    "percentile": "quantile_cont", "regexp_like": "regexp_matches", "bround": "round_even", "explode": "unnest", "sequence": "generate_series",
    "filter": "list_filter", "transform": "list_transform", "try_element_at": "list_extract", "size": "len", "split": "string_split_regex", "get_json_object": "json_extract_string",
    "array": "list_value", "char": "chr", "array_contains": "list_contains", "array_join": "array_to_string", "slice": "list_slice", "array_sort": "list_sort", "collect_list": "list", "array_distinct": "list_distinct", "startswith": "starts_with",
}


def duck(sql: str) -> str:
    """The same statement for DuckDB."""
    text = re.sub(r"/\*<\*/.*?/\*\|(.*?)>\*/", r"\1", statement(sql), flags=re.S)
    text = text.replace("\\\\p{", "\\p{").replace("\\\\b", "\\b").replace("'$0'", "'\\0'")
    text = text.replace("/*g*/", ", 'g'").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    for ours, theirs in _DUCK.items():
        text = re.sub(rf"\b{ours}\(", f"{theirs}(", text)
    text = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", text)
    text = re.sub(r"weekday\(([^()]+)\)", r"(isodow(\1) - 1)", text)
    text = re.sub(r"sha2\(([^()]+), 256\)", r"sha256(\1)", text)
    text = re.sub(r"timestampdiff\(SECOND, ", "date_diff('second', ", text)
    return text


#: Relations that planner, replay and reports read many times, the scores of calls and what is made of them: written to the
#: shared folder once for a state of the input files.
KEPT = ("topic_parsed", "match_parsed", "brief_parsed", "enquiry_said", "enquiry_fields", "letter_entries", "entry_texts", "letter_texts", "letter_found", "covered", "span_scores", "token_checks", "brief_facts", "summary_scores", "country_hits", "enquiry_evidence", "pair_similarity", "scored", "metrics", "candidates", "chain", "gate_results", "replayed", "replay_calls", "replay_tasks", "mixed_rows")


#: Bytes in memory for a byte of a file, where the planner asks whether a table is small enough to be broadcast. Repeated labels,
#: keys in order and columns that a query leaves out make files a hundred times smaller than their rows (measured: up to 205 MB
#: for an estimate below 10), and what is broadcast goes through the driver.
PACKED = 100.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: What the session's parser has learnt of long statements is dropped beyond so many states; it was half of what the driver held.
#: Descriptions of plans, one for each step of a query, end at so many characters.
LEAN = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "2000", "spark.sql.maxPlanStringLength": "50000"}


def _query(spark: SparkSession, sf_dir: str, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text) and t not in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, df in tables.items():
        if re.search(rf"\b{name}\b", text):
            df.createOrReplaceTempView(name)
    return spark.sql(text)


def run(spark: SparkSession, sf_dir: str, sql: str, tables: dict[str, DataFrame] | None = None, keep: tuple[str, ...] = KEPT, made: dict[str, str] | None = None) -> DataFrame:
    """Run sql over the folder's tables. tables: DataFrames that stand for relations, or tables, of their names.

    What is kept and depends on given tables is written for this run; made names the views of what this run has at hand, so
    that each is looked up once. Computed relations that are left are made before the statement is planned.
    """
    tables, made = tables or {}, {} if made is None else made
    if float(spark.conf.get(_FACTOR, "1.0")) < PACKED:
        spark.conf.set(_FACTOR, str(PACKED))
        for name, value in LEAN.items():
            spark.conf.set(name, value)
    relations = {k: v for k, v in RELATIONS.items() if k not in tables}
    for name in [n for n in keep if n in needed(sql, relations)]:
        if view := made.get(f"view {name}"):
            relations[name] = f"SELECT * FROM {view}"
            continue
        text = statement(relations[name], relations)
        own = tuple(k for k in keep if k != name)
        given = sorted(t for t in tables if re.search(rf"\b{t}\b", text))
        if not given:
            sources = [f"{sf_dir}/{t}.parquet" for t in TABLES if re.search(rf"\b{t}\b", text)]
            version = storage.state(spark, sources)
        else:
            version = made.setdefault(name, uuid.uuid4().hex)
        label = f"{name}-{hashlib.md5(text.encode()).hexdigest()[:12]}"
        within = lambda text, own=own: run(spark, sf_dir, text, tables, own, made)
        df = storage.kept(lambda name=name, within=within: COMPUTED[name](within) if name in COMPUTED else within(RELATIONS[name]), spark, label, version, not given)
        view = f"kept_{label}_{version}".replace("-", "_")
        df.createOrReplaceTempView(view)
        made[f"view {name}"] = view
        relations[name] = f"SELECT * FROM {view}"
    for name in reversed(needed(sql, relations)):
        if name in COMPUTED and relations[name] == RELATIONS[name] and name in needed(sql, relations):  # a kept table, or another, may have stood for it
            view = f"computed_{name}_{uuid.uuid4().hex}"
            COMPUTED[name](lambda text: run(spark, sf_dir, text, tables, keep, made)).createOrReplaceTempView(view)
            relations[name] = f"SELECT * FROM {view}"
    return _query(spark, sf_dir, statement(sql, relations), tables)
