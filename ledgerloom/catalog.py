"""Registry of the engine's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import frames, sql
from .functions import dates, text
from .operators import aggregates, scoring
from .plans import costs, gates, routing

Query = Callable[..., DataFrame]
STATEMENTS: dict[str, str] = scoring.QUERIES | aggregates.QUERIES | costs.QUERIES | routing.QUERIES | gates.QUERIES | text.QUERIES | dates.QUERIES


def _run(text: str, spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return sql.run(spark, sf_dir, text, tables)


def queries() -> dict[str, Query]:
    """Each takes (spark, sf_dir) and, but for streams, tables: one's own DataFrames by the names of relations."""
    return {name: partial(_run, text) for name, text in STATEMENTS.items()} | frames.QUERIES | frames.STREAMS


def over(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over one's own tables alone: all that it reads must be among them or be made from them."""
    return queries()[name](spark, "", tables)


def oracle_sql() -> dict[str, str]:
    return {name: sql.duck(text) for name, text in STATEMENTS.items()} | frames.TWINS
