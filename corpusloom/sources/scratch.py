"""Scratch tables in the folder that a cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of scratch tables by owner.
_TABLES: dict[str, list[str]] = {}
_OWNER = threading.local()
#: Lets shuffle files go as soon as the table they were made for is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds what a task and its Python worker hold of wide rows at once.
_BATCH, _BATCH_BYTES, _RESULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m", "4m"


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and no other machine takes part."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(root)
    return root


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_path(spark: SparkSession, name: str) -> str:
    """A place for a table of the current owner."""
    path = f"{scratch_root(spark)}/corpusloom-scratch/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(getattr(_OWNER, "name", ""), []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    append(df, path)
    return spark.read.schema(schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches from now on, unless the session has its own bound: what a caller gets is carried out after the call."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, _RESULT_BYTES)


def append(df: DataFrame, path: str) -> None:
    """Add rows to the table in a place of ``new_path``."""
    with _set(df.sparkSession, {_CLEAN: "true", _BATCH: _BATCH_BYTES}):
        df.write.mode("append").option("compression", "zstd").parquet(path)


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables materialized inside belong to ``owner``; those that it had before are deleted first."""
    release(spark, owner)
    was = getattr(_OWNER, "name", "")
    _OWNER.name = owner
    try:
        yield
    finally:
        _OWNER.name = was


@contextmanager
def passing(spark: SparkSession) -> Iterator[str]:
    """An owner for tables that are needed for a while: they are deleted at the end."""
    owner = f"passing-{uuid.uuid4().hex}"
    try:
        yield owner
    finally:
        release(spark, owner)


def release(spark: SparkSession, owner: str = "") -> None:
    """Delete the scratch tables of an owner (of none, by default), once no live DataFrame reads them."""
    for path in _TABLES.pop(owner, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
