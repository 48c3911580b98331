"""Stores as Parquet: embedding cache, history, queue and review state (S-04..S-12)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.review import Decisions
from corpusloom.plans.config import HISTORY_KEEP
from corpusloom.sources.scratch import delete


def save_cache(entries: DataFrame, path: str, shards: int = 16) -> None:
    """Write cached vectors by shard; only shards that have rows in ``entries`` are rewritten (S-06)."""
    sharded = entries.withColumn("shard", T.shard_of(F.col("note_id"), shards))
    sharded.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def load_cache(spark: SparkSession, path: str, model_id: str, model_version: str) -> DataFrame:
    """Vectors of this model; corrupt files are passed over (S-05)."""
    found = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    return found.where((F.col("model_id") == model_id) & (F.col("model_version") == model_version))


def cache_delta(notes: DataFrame, cache: DataFrame) -> DataFrame:
    """note_id, action: hit, upsert (new or changed) or remove (J-04..J-06)."""
    now = notes.select(F.col("note_id").alias("n"), F.col("content_hash").alias("h"))
    old = cache.select(F.col("note_id").alias("c"), F.col("content_hash").alias("g"))
    action = F.when(F.col("n").isNull(), "remove").when(F.col("h").eqNullSafe(F.col("g")), "hit").otherwise("upsert")
    return now.join(old, F.col("n") == F.col("c"), "full").select(F.coalesce("n", "c").alias("note_id"), action.alias("action"))


def needs_rebuild(indexed: int, changed: int, has_mean: bool, share: float = 0.2) -> bool:
    """Whether the vector index is built anew instead of updated (V-11)."""
    return indexed == 0 or not has_mean or changed / max(indexed, 1) > share


def keep_latest(history: DataFrame, keep: int = HISTORY_KEEP, order: str = "created_at") -> DataFrame:
    """The newest change sets (S-09, T-09)."""
    return history.orderBy(F.col(order).desc(), F.col("id").desc()).limit(keep)


def last_applied(history: DataFrame) -> DataFrame:
    """The newest change set that isn't undone."""
    return history.where(~F.coalesce("undone", F.lit(False))).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def latest_by_key(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of each key (keyed upsert, V-09, R-02)."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


STORE_VERSION = 1
_STATE = "version int, rows long, place string"


def save_store(df: DataFrame, path: str, version: int = STORE_VERSION) -> None:
    """Write a store: its rows to a place of their own, then a state that names the place, its version and row count.

    Readers see the old rows or the new ones, never parts (S-07, S-08, S-11).
    """
    spark, place = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    was = _read(spark, f"{path}/state", _STATE).collect()
    df.write.parquet(f"{path}/{place}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{place}").count()
    spark.createDataFrame([(version, rows, place)], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    for r in was:
        delete(spark, f"{path}/{r.place}")


def load_store(spark: SparkSession, path: str, schema: str, version: int = STORE_VERSION) -> DataFrame:
    """A store's rows; none where it can't be read, has another version or another number of rows than it was saved with."""
    state = _read(spark, f"{path}/state", _STATE).collect()
    if len(state) == 1 and state[0].version == version:
        found = _read(spark, f"{path}/{state[0].place}", schema)
        if found.count() == state[0].rows:
            return found
    return spark.createDataFrame([], schema)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path) if exists else spark.createDataFrame([], schema)


DECISIONS = "kind string, seq int, key string, value string"


def decisions_table(spark: SparkSession, decisions: Decisions) -> DataFrame:
    """A user's decisions as rows, in their order (S-10)."""
    rows = [(kind, n, *(d if isinstance(d, tuple) else (d, None))) for kind, each in vars(decisions).items() for n, d in enumerate(each)]
    return spark.createDataFrame(rows, DECISIONS)


def decisions_of(table: DataFrame) -> Decisions:
    """Decisions from their rows; kinds that are missing are empty.  They are a user's, and few."""
    found: dict[str, list] = {}
    for r in table.orderBy("kind", "seq").collect():
        found.setdefault(r.kind, []).append(r.key if r.kind in ("ignored", "splits") else (r.key, r.value))
    return Decisions(**{k: tuple(v) for k, v in found.items()})


def write_report(report: DataFrame, path: str) -> None:
    """A report, which is small, as one JSON file in a folder (S-15)."""
    report.coalesce(1).write.mode("overwrite").json(path)
