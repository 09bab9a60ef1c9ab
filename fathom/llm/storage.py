"""Tables that cut lineage, and joins that choose their way by a checked size."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most rows of an id table that a join may broadcast: about 32 MB in each executor.
BROADCAST_ROWS = 1_000_000
#: Spark's own setting that drops the shuffle files of a query when it ends; what `save` wrote is read from the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the Arrow batches that a Python worker gets: an executor holds those of its tasks outside its heap. Spark's own limit is 64 MB.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; in a local session that doesn't set it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = _own_folder()
    return f"{base}/tables-{spark.sparkContext.applicationId}"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings of Spark for what runs inside; the ones before hold again at the end."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start there, and lost executors cost only their tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | BATCHES):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.saved_at = path
    if (scope := _scope.get()) is not None:
        scope.append(made)
    return made


_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch():
    """Deletes at its end the tables that were written inside, but for those given to what it yields."""
    outer, inner = _scope.get(), []
    kept: list[DataFrame] = []
    token = _scope.set(inner)
    try:
        yield kept.append
    finally:
        _scope.reset(token)
        paths = {df.saved_at for df in kept}
        forget(*(df for df in inner if df.saved_at not in paths))
        if outer is not None:
            outer.extend(kept)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df.saved_at)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application still has; results that were not read or written before are lost."""
    _delete(spark, shared_folder(spark))


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join df with the written table `ids` on `key`; broadcasts only up to BROADCAST_ROWS rows, else both sides are shuffled."""
    ids = ids.select(*([key] if isinstance(key, str) else key))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def small_join(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join df with the written table `other`, broadcast only up to BROADCAST_ROWS rows; beyond, Spark splits hot keys of the shuffled join."""
    return df.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, on, how)


def with_marks(df: DataFrame, marks: DataFrame, on: list[str], key: str) -> DataFrame:
    """Left join of df, which holds texts, with the written table `marks`: only rows whose `key` some mark has are shuffled."""
    marked = save(marks.select(key).distinct(), "marked")
    return by_ids(df, marked, key).join(marks, on, "left").unionByName(by_ids(df, marked, key, "left_anti"), allowMissingColumns=True)
