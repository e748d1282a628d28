"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the five ASCII controls from tab on.
SPACE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, as in tests, a temporary one if all runs on this machine; on a cluster that is an error.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is read many times.

    The table goes with ``discard``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append((spark, path))
    df.write.parquet(path, compression=codec)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_scopes: list[list[tuple[SparkSession, str]]] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what make returns, and delete what it staged on the way."""
    _scopes.append(made := [])
    try:
        out = make()
    finally:
        _scopes.pop()
    result = staged(out, name)
    for spark, path in made:
        _drop(spark, path)
    return result


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no frame refers to any more, as what came of them is written."""
    for df in tables:
        _drop(df.sparkSession, df._staged_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own, made longer until no column of df has them, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def counted(schema: pa.Schema, column: str = "n_chars") -> int:
    """Place of a column that counts characters, an integral one; -1 where there is none."""
    at = schema.get_field_index(column)
    return at if at >= 0 and pa.types.is_integer(schema.field(at).type) else -1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def buckets(spark: SparkSession, each: int = 8) -> int:
    """Number of key ranges for a shuffle of packed blocks: several to a partition, so that they spread evenly."""
    return each * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(docs: DataFrame, column: str = "text"):
    return F.coalesce(docs[column].cast("string"), F.lit(""))
