"""Cutting lineage through tables in the shared folder.

A table written there survives the loss of any executor, and later stages read it
instead of recomputing what led to it.  ``DataFrame.checkpoint`` would compute its
input twice (once to count, once to write); a written table is computed once.

``settle`` writes a result and deletes the tables that were written on the way to it;
what is left of an application's tables goes when its driver exits.  The shuffle files
of a table go as soon as it is written: Spark by itself keeps them until the driver
happens to collect its garbage, and by then those of many tables may lie on the disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class _Scopes(threading.local):
    """Paths written inside each ``settle`` that is under way in a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()
#: Where the tables that ``stash`` and ``settle`` returned lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    """A folder for one application on this machine, removed at exit."""
    local = tempfile.mkdtemp(prefix=f"cairn-{application}-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named and all runs on this machine."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{SETTING} must name a folder that all executors of {master} share")
    return _local_dir(spark.sparkContext.applicationId)


def _delete(conf: JavaObject, path: str) -> None:
    from pyspark import SparkContext

    where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _delete_at_exit(conf: JavaObject, path: str) -> None:
    try:
        _delete(conf, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the JVM has gone already


@lru_cache(maxsize=None)
def _folder(spark: SparkSession, shared: str, application: str) -> str:
    """The application's folder in the shared one, deleted when the driver exits."""
    path = f"{shared}/cairn-{application}"
    atexit.register(_delete_at_exit, spark._jsc.hadoopConfiguration(), path)
    return path


#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_inside: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries started inside remove their shuffle files when they end; after the last of a
    session's threads has left, the session's own setting comes back."""
    with _lock:
        depth, before = _inside.get(id(spark), (0, None))
        if not depth:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _inside[id(spark)] = depth + 1, before
    try:
        yield
    finally:
        with _lock:
            depth, before = _inside.pop(id(spark))
            if depth > 1:
                _inside[id(spark)] = depth - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{_folder(spark, shared_dir(spark), spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return path, table


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back."""
    path, table = _write(df)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return table


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written as by ``stash``; tables written on the way are deleted.

    Nothing that reads those tables may outlive ``make`` but its result.
    """
    _scopes.open.append([])
    try:
        path, table = _write(make())
    finally:
        for gone in _scopes.open.pop():
            _delete(spark._jsc.hadoopConfiguration(), gone)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``stash`` or ``settle`` returned, once nothing reads it any more."""
    path = _paths.pop(table, None)
    if path is not None:
        _delete(table.sparkSession._jsc.hadoopConfiguration(), path)
