"""Shared plumbing of the training-data operators: scratch tables, columns, word and byte helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.notes import spread
from corpusloom.sources.scratch import bound_batches, delete, materialize, new_path, owned, release, scratch_root

__all__ = ["bound_batches", "delete", "materialize", "new_path", "owned", "release", "scratch_root"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under internal names: other columns, however named, are never read."""
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers (Steele, Lea and Flood 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded64(n: int, seed: int) -> np.ndarray:
    """n deterministic 64-bit values from a counter."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


#: Keys of so many rows, or of this share of them if that is more, are dealt over several tasks.
HEAVY_ROWS, HEAVY_SHARE = 1000, 20_000


def heavy(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """key, _parts: the keys with many rows and over how many tasks to deal them; at most HEAVY_SHARE rows.

    A row of null key, which equals none, keeps plans alike whether or not there are such keys.
    """
    limit = max(HEAVY_ROWS, -(-total // HEAVY_SHARE))
    hot = counts.where(F.col(n) >= limit).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / limit).cast("int").alias("_parts"))
    return hot.unionByName(counts.sparkSession.range(1).select(F.lit(None).cast(counts.schema[key].dataType).alias("_hot"), F.lit(1).alias("_parts")))


def dealt_join(rows: DataFrame, keyed: DataFrame, key: str, heavy_keys: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` with ``keyed``, which has one row a key; rows of heavy keys are dealt by a hash of ``spread``."""
    hot = F.broadcast(heavy_keys)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, rows[key] == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_hot", "_parts")
    right = keyed.join(hot, keyed[key] == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


#: Tables of at most so many narrow rows are broadcast.
BROADCAST_ROWS = 2_000_000


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """df, of a known number of narrow rows, marked for a broadcast if they are few; else it meets its partner in a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered; forgets all at a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(it: Iterable[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` rows: what is made of a batch is held for a slice alone."""
    for batch in it:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, so that output memory is bounded."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)
    del held
    give_back()


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
