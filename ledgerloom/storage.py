"""Derived tables in the folder that driver and executors share: written aside, published at once, evicted when old.

A table is written to a folder of its own name first. It is published by an empty file beside it whose name holds the
version of its inputs and the folder: one step, after the table is whole. Readers list these files and take the least of
a version, so writers at the same time don't disturb each other: both tables are whole, and all readers read one.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which versions that aren't current, and what was never published, go.
GRACE = 24 * 3600.0
_READY = ".ready"


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="derived-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a temporary folder if all runs on this machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _status(spark, path)
    return files.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file; one that is there already stays."""
    target, files = _status(spark, path)
    if not files.exists(target):
        files.create(target, True).close()


def listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of change in seconds) of what stands in a folder, in order of names; of none where there is no folder."""
    target, files = _status(spark, path)
    if not files.exists(target):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in files.listStatus(target))


def remove(spark: SparkSession, path: str) -> None:
    target, files = _status(spark, path)
    files.delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone by then
        pass


def state(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file under one of the paths, at any depth, is added, removed or written anew."""
    seen = []
    for path in sorted(paths):
        target, files = _status(spark, path)
        if not files.exists(target):
            seen.append((path, None))
            continue
        root, found = files.getFileStatus(target).getPath().toString(), files.listFiles(target, True)
        each = []
        while found.hasNext():
            s = found.next()
            each.append((s.getPath().toString().removeprefix(root) or s.getPath().getName(), s.getLen(), s.getModificationTime()))
        seen += sorted(each)
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


def published(spark: SparkSession, name: str, version: str, write: Callable[[str], None], lasting: bool = True) -> str:
    """The folder that write(folder) filled for a version of its inputs; made once, then found.

    What isn't lasting goes when the driver's process ends.
    """
    home = f"{shared_dir(spark)}/derived/{name}"

    def found() -> str | None:
        names = listed(spark, home)
        here = {n for n, _ in names}
        return next((f"{home}/{n[: -len(_READY)]}" for n, _ in names if n.startswith(f"{version}.") and n.endswith(_READY) and n[: -len(_READY)] in here), None)

    if at := found():
        return at
    own = f"{home}/{version}.{uuid.uuid4().hex}"
    write(own)
    mark(spark, own + _READY)
    spark.sparkContext._jvm.System.gc()  # plans and shuffles of what is written are garbage in the driver, which holds many in a row
    if not lasting:
        atexit.register(_remove_at_exit, spark, own)
        atexit.register(_remove_at_exit, spark, own + _READY)
    evict(spark, name, version)
    return found() or own


def evict(spark: SparkSession, name: str, current: str, grace: float | None = None) -> None:
    """Remove what is older than the time of grace: other versions of a name, and tables that were never published."""
    home, limit = f"{shared_dir(spark)}/derived/{name}", time.time() - (GRACE if grace is None else grace)
    names = dict(listed(spark, home))
    for n in sorted(names, key=lambda n: not n.endswith(_READY)):  # the marks first, so that nobody finds half a table
        known = n.endswith(_READY) or n + _READY in names
        if names[n] <= limit and (not n.startswith(f"{current}.") or not known):
            remove(spark, f"{home}/{n}")


def clear(spark: SparkSession) -> None:
    """Remove all that is published."""
    remove(spark, f"{shared_dir(spark)}/derived")


def kept(df_of: Callable[[], DataFrame], spark: SparkSession, name: str, version: str, lasting: bool = True) -> DataFrame:
    """The table that df_of() makes, written once for a version of its inputs and read from then on."""
    return spark.read.parquet(published(spark, name, version, lambda path: df_of().write.parquet(path), lasting))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written and read back, until the driver's process ends: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let shuffles and broadcasts go that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove what scratch wrote, and what led to it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)
    tidy(df.sparkSession)
