"""Sharding in Hilbert-curve order, with DataFrame and SQL functions only.

Several metadata dimensions are quantised to a grid: numbers by approximate quantiles over all rows,
strings by exact quantiles of all rows in order of value; both keep the order of values.  A cell's place on the
Hilbert curve (Skilling 2004) orders the rows, and runs of that order become shards, so that each shard's
rows lie close together in every dimension and readers can skip files by minimum and maximum.

Law ``rows``: shard sizes differ by one row at most.  Ranks are exact: rows are range-partitioned and sorted
by (curve index, id, ...), numbered inside each partition, and the partitions' counts are added up.  Only
ids, sizes, checksums and curve indices are moved, never texts; ``write_shards`` alone moves whole rows, once.
A curve cell that holds most rows is split among partitions by the columns after it.

Defined cases.  Null text: no bytes, checksum of the empty string.  Very long texts weigh in ``size`` alone.  Null
dimensions are quantised below all values.  Rows of null or equal id, and whole repeated rows, are rows like any
other, ordered by checksum and size; between equal rows the order is open.  With fewer rows than shards some
shards are empty; an empty table gives an empty table.  Other columns aren't read, and may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize

OVERHEAD = 16
LAW = "rows"
DIMS = ["source", "lang", "n_chars"]


def curve_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell given by integer axes of ``bits`` bits each."""
    n = len(axes)
    start = F.array(*[a.cast("long") for a in axes])

    def undo(state: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p, first, own = q - 1, F.get(state, F.lit(0)), F.get(state, i)
        on = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        new_first = F.when(on, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(i == 0, new_first).when(on, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(state, lambda v, k: F.when(k == i, new_own).when(k == 0, new_first).otherwise(v))

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    undone = F.aggregate(start, start, lambda s, _: s) if bits < 2 else F.aggregate(steps, start, undo)
    # Gray code: each axis is combined with all before it.
    gray = F.transform(undone, lambda _, k: F.aggregate(F.slice(undone, F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def finish(state: Column) -> Column:
        last = F.get(state, F.lit(n - 1))
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
        t = F.aggregate(masks, F.lit(0).cast("long"), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(state, lambda v: v.bitwiseXOR(t))

    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    # One-element arrays bind the intermediate states, so that each is worked out once.
    bound = F.transform(F.transform(F.array(gray), finish), lambda s: F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a * 2 + F.get(s, p["i"]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p["b"])).cast("boolean").cast("long")))
    return F.get(bound, F.lit(0))


def quantiser(docs: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """For each dimension at most 2 ** bits - 1 ascending limits; a value's cell is the number of limits at most it.

    Only limits reach the driver.
    """
    kinds, cells = dict(docs.dtypes), 1 << bits
    numbers = [d for d in dims if kinds[d] != "string"]
    limits: dict[str, list] = {}
    if numbers:
        shares = [k / cells for k in range(1, cells)]
        row = docs.agg(*[F.percentile_approx(F.col(d), shares, 10_000).alias(f"q{n}") for n, d in enumerate(numbers)]).first()
        limits |= {d: sorted(set(row[f"q{n}"] or [])) for n, d in enumerate(numbers)}
    return limits | {d: string_limits(docs, d, cells) for d in dims if kinds[d] == "string"}


def string_limits(docs: DataFrame, dim: str, cells: int) -> list[str]:
    """Values at which the rows, in order of value, enter another of ``cells`` cells of equal numbers of rows."""
    counts = materialize(docs.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n")), "values")
    if counts.limit(cells + 1).count() <= cells:  # a cell for each value
        return sorted(r.v for r in counts.collect())[1:]
    sorted_ = materialize(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("_part", F.spark_partition_id()), "values")
    sums = sorted_.groupBy("_part").agg(F.sum("n").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    found = placed.select("v", F.expr(f"(_start + _before + n div 2) * {cells} div _total").alias("cell")).groupBy("cell").agg(F.min("v").alias("v"))
    return sorted(r.v for r in found.collect())[1:]


def cell(value: Column, limits: list) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(value >= F.lit(v), F.lit(False)).cast("int") for v in limits], F.lit(0))


PLACE = ["hilbert", "_id", "text_crc32", "size"]


def _keyed(docs: DataFrame, dims: list[str], id_col: str, text_col: str, bits: int) -> list[Column]:
    """The columns of PLACE for a row of ``docs``."""
    limits = quantiser(docs.select(*dict.fromkeys(dims)), dims, bits)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return [
        curve_index([cell(docs[d], limits[d]) for d in dims], bits).alias("hilbert"),
        docs[id_col].alias("_id"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
    ]


def _placed(rows: DataFrame, order: list[str], shards: int, names: tuple[str, str], name: str) -> DataFrame:
    """rows with their shard and slot, by exact ranks in ``order``; still in that order inside each partition of the files."""
    at, part, row, own, offset, total, rank = fresh(rows, "_at", "_part", "_row", "_p", "_offset", "_total", "_rank")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    kept = materialize(ordered.withColumn(part, F.shiftright(at, 33)).withColumn(row, F.col(at).bitwiseAND((1 << 33) - 1)).drop(at), name)
    # One row a partition, as many as there are tasks; a running sum over them gives where each begins.
    counts = kept.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(part).alias(own), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset), F.sum("n").over(Window.partitionBy()).alias(total))
    out = kept.join(F.broadcast(starts), kept[part] == starts[own]).withColumn(rank, F.col(offset) + F.col(row))
    # Shard s takes ranks from ceil(s * total / shards) on, which is where floor(rank * shards / total) turns s.
    shard, slot = names
    out = out.withColumn(shard, F.expr(f"({rank} * {shards}) div {total}"))
    out = out.withColumn(slot, F.col(rank) - F.expr(f"({shard} * {total} + {shards - 1}) div {shards}"))
    return out.withColumn(shard, F.col(shard).cast("int")).select(*rows.columns, shard, slot)


def hilbert_shards(docs: DataFrame, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, bits: int = 4) -> DataFrame:
    """Per row: id, size, text_crc32, hilbert, law, shard and slot (its place in the shard, from 0)."""
    keyed = materialize(docs.select(*_keyed(docs, dims or DIMS, id_col, text_col, bits)), "curve")
    out = _placed(keyed, PLACE, shards, ("shard", "slot"), "hilbert")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "hilbert", F.lit(LAW).alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, bits: int = 4) -> str:
    """Write every row of ``docs``, all columns as they are, as one folder a shard, in the order of the curve.

    Returns the name of the folders' column: ``shard``, with underscores after it where ``docs`` has such a column.
    """
    names = fresh(docs, "hilbert", "_id", "text_crc32", "size")
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_keyed(docs, dims or DIMS, id_col, text_col, bits), names, strict=True)))
    shard, slot = fresh(keyed, "shard", "slot")
    _placed(keyed, names, shards, (shard, slot), "shard-rows").sortWithinPartitions(shard, slot).drop(slot, *names).write.partitionBy(shard).parquet(path)
    return shard
