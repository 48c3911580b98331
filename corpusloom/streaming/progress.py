"""Long runs: remaining time from a progress log, steps that a later run takes up again, cancelling (P-23, R-14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: milliseconds of progress before a rate is trusted.
TRUSTED_MS = 15_000


def remaining(log: DataFrame) -> DataFrame:
    """log with ``remaining_ms`` at each report, or null: log has stage, at_ms, done, total.

    The rate counts from a stage's first report of something done, so that work served from a cache doesn't distort it.
    """
    so_far = Window.partitionBy("stage").orderBy("at_ms", "done").rowsBetween(Window.unboundedPreceding, 0)
    base = F.first(F.when(F.col("done") > 0, F.struct("at_ms", "done")), ignorenulls=True).over(so_far)
    rows = log.withColumn("_base", base)
    elapsed, made = F.col("at_ms") - F.col("_base.at_ms"), F.col("done") - F.col("_base.done")
    known = (elapsed >= TRUSTED_MS) & (made > 0) & (F.col("total") > F.col("done"))
    return rows.withColumn("remaining_ms", F.when(known, (F.col("total") - F.col("done")) * elapsed / made)).drop("_base")


def remaining_text(ms: Column) -> Column:
    """Remaining milliseconds in words."""
    minutes = F.floor(ms / 60_000 + 0.5)
    hours = F.concat(F.lit("about "), F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min left"))
    return F.when(minutes < 1, "less than a minute left").when(minutes < 60, F.concat(F.lit("about "), minutes.cast("string"), F.lit(" min left"))).otherwise(hours)


def step(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A named step's rows: read where an earlier run has finished it, else made and written.

    A step counts as finished by the marker that the commit of its files leaves, so a run that was cancelled or lost
    half way is taken up at its first unfinished step.
    """
    path = f"{folder}/{name}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs inside belong to a group that the yielded function, called from any thread, cancels."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
