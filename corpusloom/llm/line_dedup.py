"""Line deduplication with two Bloom filters.

Pass 1 reads every line once and fills, per task, a filter of hashes seen once and one of hashes seen
twice.  Task filters merge in a tree over fixed segments: a bit is "twice" if either side has it twice or
both sides have it once.  Pass 2 sends only lines whose hash may have been seen twice to a shuffle, where
128-bit hashes are counted exactly and the holder that keeps the line is chosen.  Filters get BITS_A_LINE bits for
each line that is long enough, up to 2 ** MOST_LOG2_BITS in all; beyond that more lines are suspected, and
the result stays the same.  A line of very many documents is counted map-side and its suspects are dealt over tasks.

Defined cases.  A null or empty text is one empty line.  Rows that share a doc_id are one document: they count
once, and if theirs is the largest id holding a line, all of them keep it.  A null doc_id is no document: it
doesn't count, and its rows lose the lines that go.  A very long text or line is read whole.  An empty table gives an
empty table.  Columns besides id and text are not read; ``replace_text`` carries them along, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, batches, dealt_join, fresh, give_back, heavy, materialize, slices, two

#: Bits of a filter that travel together, as a power of two.
SEGMENT = 16
HASHES = 3
BITS_A_LINE, LEAST_LOG2_BITS, MOST_LOG2_BITS = 10, 20, 30


def line_keys(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip()  # of bytes: exactly 0x20 and 0x09 to 0x0D
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z only


def line_hashes(text: bytes, min_chars: int) -> set[bytes]:
    keys = (line_keys(line, min_chars) for line in text.split(b"\n"))
    return {xxhash.xxh3_128_digest(k) for k in keys if k is not None}


def positions(digests: np.ndarray, log2_bits: int) -> np.ndarray:
    """(n, 2) unsigned halves of the digests -> (n, HASHES) bit positions."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return (digests[:, :1] + steps * (digests[:, 1:] | np.uint64(1))) >> np.uint64(64 - log2_bits)


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all of a row's positions are set."""
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))


FILTER_SCHEMA = pa.schema([("segment", pa.int64()), ("salt", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
FILTER_DDL = "segment long, salt long, once binary, twice binary"


def _fill(min_chars: int, log2_bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (log2_bits - 3), np.uint8) for _ in range(2))
        for batch in it:
            found = [h for text in as_bytes(batch.column(0)) for h in line_hashes(text, min_chars)]
            if not found:
                continue
            digests, n = np.unique(np.array(found, dtype="S16").view("V16"), return_counts=True)
            at = positions(digests.view("<u8").reshape(-1, 2), log2_bits)
            put(twice, at[(n > 1) | holds(once, at)])
            put(once, at)
        width, salt = 1 << (SEGMENT - 3), TaskContext.get().partitionId()
        used = np.flatnonzero(once.reshape(-1, width).any(axis=1))
        yield from batches(((int(s), salt, *(zlib.compress(x[s * width : (s + 1) * width].tobytes(), 1) for x in (once, twice))) for s in used), FILTER_SCHEMA, 512)

    return run


def _merge(salts: int):
    def run(group: pa.Table) -> pa.Table:
        once = twice = None
        for a, b in zip(group.column("once"), group.column("twice"), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        first = group.slice(0, 1)
        return pa.table({"segment": first.column("segment"), "salt": pa.array([first.column("salt")[0].as_py() // salts], pa.int64()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]}, schema=FILTER_SCHEMA)

    return run


def _twice_filter(docs: DataFrame, min_chars: int, log2_bits: int, fan_in: int = 64) -> bytes:
    """The merged filter of hashes seen at least twice; its size is 2 ** log2_bits bits, whatever the input."""
    tasks = docs.rdd.getNumPartitions()
    parts = docs.select("_text").mapInArrow(_fill(min_chars, log2_bits), FILTER_DDL)
    while True:
        parts = parts.withColumn("salt", F.expr(f"salt div {fan_in}"))
        tasks = -(-tasks // fan_in)
        parts = parts.groupBy("segment", "salt").applyInArrow(_merge(1), FILTER_DDL)
        if tasks <= 1:
            break
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    width = 1 << (SEGMENT - 3)
    for row in parts.select("segment", "twice").toLocalIterator():
        bits[row.segment * width : (row.segment + 1) * width] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def log2_bits_for(lines: int) -> int:
    return min(MOST_LOG2_BITS, max(LEAST_LOG2_BITS, (BITS_A_LINE * lines - 1).bit_length()))


def _long_lines(docs: DataFrame, min_chars: int) -> int:
    """How many lines are long enough before they are stripped."""
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(line) >= min_chars)
    return docs.where(F.length("_text") >= min_chars).agg(F.sum(F.size(lines))).first()[0] or 0


def _suspects(min_chars: int, log2_bits: int, packed):
    schema = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("_hash", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for batch in it:
            owner, found = [], []
            for n, text in enumerate(as_bytes(batch.column(1))):
                own = line_hashes(text, min_chars)
                found += own
                owner += [n] * len(own)
            if found:
                keep = np.flatnonzero(holds(bits, positions(halves(found), log2_bits)))
                rows = pa.array([owner[k] for k in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array([found[k] for k in keep], pa.binary())], schema=schema)

    return run


def cut_text(text: bytes, drops: list[bytes] | None, min_chars: int) -> tuple[int, str, int]:
    """Lines of a text, what stays when the lines of these hashes go, and how many went."""
    lines = text.split(b"\n")
    if not drops:
        return len(lines), text.decode(), 0
    gone, kept = set(drops), []
    for line in lines:
        key = line_keys(line, min_chars)
        if key is None or xxhash.xxh3_128_digest(key) not in gone:
            kept.append(line)
    return len(lines), b"\n".join(kept).decode(), len(lines) - len(kept)


def _cut(min_chars: int):
    schema = pa.schema([("_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def one(i, text: bytes, drops: list[bytes] | None) -> tuple:
        n, kept, dropped = cut_text(text, drops, min_chars)
        return i, n, dropped, kept

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches((one(*row) for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)), schema)

    return run


def _with_drops(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, log2_bits: int | None, drops_col: str) -> DataFrame:
    """``docs`` with the column ``drops_col``: hashes of the lines that go from a row, or null."""
    src = two(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    bits = log2_bits or log2_bits_for(_long_lines(src, min_chars))
    packed = docs.sparkSession.sparkContext.broadcast(_twice_filter(src, min_chars, bits))
    hashed = src.withColumn("_row", F.xxhash64("_text"))  # tells apart the texts of one id
    suspects = materialize(hashed.mapInArrow(_suspects(min_chars, bits, packed), "_id long, _row long, _hash binary"), "line-suspects")
    chosen = suspects.groupBy("_hash").agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keeper"), F.count("*").alias("_k")).where(F.col("_n") >= min_docs)
    chosen = materialize(chosen.drop("_n"), "line-keepers")
    dealt = dealt_join(suspects, chosen.drop("_k"), "_hash", heavy(chosen, "_hash", "_k", suspects.count()), ["_id", "_row"])
    gone = dealt.where(~F.col("_id").eqNullSafe(F.col("_keeper"))).groupBy("_id", "_row").agg(F.collect_set("_hash").alias("_drops"))
    key, row = fresh(docs, "_drop_id", "_drop_row")
    gone = gone.select(F.col("_id").alias(key), F.col("_row").alias(row), F.col("_drops").alias(drops_col))
    same = docs[id_col].cast("long").eqNullSafe(gone[key]) & (F.xxhash64(docs[text_col].cast("string")) == gone[row])
    return docs.join(gone, same, "left").drop(key, row)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, log2_bits: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_dropped and the kept text.

    Lines whose key has ``min_chars`` code points and occurs in ``min_docs`` documents go, except in the
    largest id holding them.
    """
    joined = _with_drops(two(docs, id_col, text_col), "_id", "_text", min_chars, min_docs, log2_bits, "_drops")
    return joined.select(F.col("_id").cast("long"), "_text", "_drops").mapInArrow(_cut(min_chars), "_id long, n_lines long, n_dropped long, kept string").withColumnRenamed("_id", id_col)


def replace_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", *, min_chars: int = 40, min_docs: int = 5, log2_bits: int | None = None) -> DataFrame:
    """``docs`` with the kept text in place of the text, and its length in ``chars_col`` where there is one.

    Rows that lose no line stay as they are, null texts included.
    """
    drops_col = fresh(docs, "_drops")[0]
    joined = _with_drops(docs, id_col, text_col, min_chars, min_docs, log2_bits, drops_col)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it):
            columns, texts = part.columns[:-1], part.column(at).to_pylist()
            kept = [cut_text(t.encode(), d, min_chars)[1] if d else t for t, d in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)]
            columns[at] = pa.array(kept, columns[at].type)
            if chars is not None:
                was = columns[chars].to_pylist()
                columns[chars] = pa.array([w if k is t else len(k) for w, k, t in zip(was, kept, texts, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])
        give_back()

    return joined.select(*docs.columns, drops_col).mapInArrow(run, docs.schema)
