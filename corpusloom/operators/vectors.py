"""Vector operators: means, centroids, nearest neighbours exact and by inverted cells, recall, hubness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.sources.scratch import append, materialize, new_path, owned, passing

#: Beyond so many bytes of query vectors, none are broadcast.
BROADCAST_BYTES = 64 << 20


def dims_of(df: DataFrame, vector: str = "vector") -> int:
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    return first.d if first else 0


def mean_vector(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: the element-wise mean (A-09)."""
    return df.agg(V.mean_of(F.col(vector), dims_of(df, vector)).alias("mean"))


def centroids(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """group, size, centroid: unit length (A-10); partial sums are combined before the shuffle."""
    means = df.groupBy(group).agg(F.count("*").alias("size"), V.mean_of(F.col(vector), dims_of(df, vector)).alias("_m"))
    return means.select(group, "size", V.normalize(F.col("_m")).alias("centroid"))


def center(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df with the vector mean-centred and brought to unit length (V-03)."""
    return df.join(F.broadcast(mean_vector(df, vector))).withColumn(vector, V.centered(F.col(vector), F.col("mean"))).drop("mean")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, best first, ties to the smaller id; every tie at the edge is weighed."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k]
        return np.stack([_row(s, ids, e, k) for s, e in zip(scores, edge, strict=True)])
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)


def _row(scores: np.ndarray, ids: np.ndarray, edge: float, k: int) -> np.ndarray:
    near = np.flatnonzero(scores >= edge)
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _best(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("src", "rank", "dst", "score")


NEIGHBOURS = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])


#: Queries and rows that are scored at once, so that a task's scores take 32 MB whatever it is given.
QUERIES, ROWS = 1024, 4096


class _Nearest:
    """The k best rows of each query among all rows shown so far, ties to the smaller id, the query's own left out."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.found, self.near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(ids), ROWS):
            some, m = ids[start : start + ROWS], rows[start : start + ROWS].T
            for at in range(0, len(self.ids), QUERIES):
                part = slice(at, at + QUERIES)
                scores = self.queries[part] @ m
                scores[self.ids[part, None] == some[None, :]] = -np.inf
                self._merge(part, scores, some)

    def _merge(self, part: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = scores >= self.found[part, -1:]
        width = int(np.count_nonzero(hit, axis=1).max())
        if not width:
            return
        if width > 8 * self.k:
            best = top_k(scores, ids, self.k)
            new, who = np.take_along_axis(scores, best, axis=1), ids[best]
        else:
            at, column = np.nonzero(hit)
            place = np.arange(len(at)) - np.searchsorted(at, at)
            new, who = np.full((len(scores), width), -np.inf), np.zeros((len(scores), width), np.int64)
            new[at, place], who[at, place] = scores[at, column], ids[column]
        new, who = np.hstack([self.found[part], new]), np.hstack([self.near[part], who])
        order = np.lexsort((who, -new), axis=1)[:, : self.k]
        self.found[part], self.near[part] = np.take_along_axis(new, order, axis=1), np.take_along_axis(who, order, axis=1)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), ROWS):
            found = self.found[at : at + ROWS].ravel()
            ok = np.isfinite(found)
            src = np.repeat(self.ids[at : at + ROWS], self.k)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(self.near[at : at + ROWS].ravel()[ok]), pa.array(found[ok])], schema=NEIGHBOURS)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), V.as_double(F.col("vector")).alias("vector"))


def _shared(queries: DataFrame) -> Broadcast:
    """Ids and vectors of the queries, of a checked size, for all tasks."""
    held = _plain(queries).toArrow()
    if held.nbytes > BROADCAST_BYTES:
        raise ValueError("too many queries to broadcast; use knn or knn_blocks")
    return queries.sparkSession.sparkContext.broadcast((held.column("id").to_numpy(), matrix(held.column("vector"))))


def _scan(shared: Broadcast, vectors: DataFrame, k: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(*shared.value, k)
        for batch in it:
            best.add(batch.column(0).to_numpy(), matrix(batch.column(1)))
        yield from best.batches()

    return _best(_plain(vectors).mapInArrow(run, "src long, dst long, score double"), k)


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int = 15) -> DataFrame:
    """src, rank, dst, score: each query's k nearest by cosine of unit vectors, itself left out (J-07, W-01).

    The queries, of a checked size, are broadcast; each task keeps its rows' best for each query, so what is
    shuffled is k rows a query and task.
    """
    return _scan(_shared(queries), vectors, k)


def _scored(k: int):
    """The k best of one table's rows for each query of another."""

    def score(q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            return NEIGHBOURS.empty_table()
        best = _Nearest(q.column("id").to_numpy(), matrix(q.column("vector")), k)
        best.add(m.column("id").to_numpy(), matrix(m.column("vector")))
        return pa.Table.from_batches(best.batches(), NEIGHBOURS)

    return score


def train_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means over a bounded sample: the rows of the smallest hash of their id."""
    held = vectors.orderBy(F.xxhash64("id")).limit(sample).select(V.as_double(F.col("vector")).alias("vector")).toArrow()
    m = matrix(held.column("vector"))
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(m @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own := m[nearest == c]).size:
                centres[c] = own.mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int = 15, cells: int | None = None, probes: int | None = None, slice_rows: int = 20_000) -> DataFrame:
    """src, rank, dst, score by inverted cells (J-08): every row is indexed, a query looks into its nearest cells.

    A cell is split into slices of rows by a hash of the id, so that no task gathers a whole large cell.
    """
    n = vectors.count()
    cells = cells or max(1, int(n**0.5))
    probes = probes or max(1, int(cells * 0.4) + 1)
    shared = vectors.sparkSession.sparkContext.broadcast(train_cells(vectors, cells))
    slices = max(1, round(3 * n / cells / slice_rows))

    def assign(count: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                scores = matrix(batch.column(1)) @ shared.value.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :count]
                at = np.repeat(np.arange(len(near)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["id", "vector", "cell"])

        return run

    schema = "id long, vector array<double>, cell int"
    index = _plain(vectors).mapInArrow(assign(1), schema).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    asked = _plain(queries).mapInArrow(assign(probes), schema).withColumn("slice", F.explode(F.array(*[F.lit(s) for s in range(slices)])))

    pairs = asked.groupBy("cell", "slice").cogroup(index.groupBy("cell", "slice")).applyInArrow(_scored(k), "src long, dst long, score double")
    return _best(pairs, k)


def _groups(df: DataFrame, dims: int) -> int:
    """In how many groups of a quarter of BROADCAST_BYTES the vectors of df are."""
    return -(-df.count() * max(1, dims) * 8 // (BROADCAST_BYTES // 4))


def knn_blocks(queries: DataFrame, vectors: DataFrame, k: int = 15, groups: int = 16) -> DataFrame:
    """src, rank, dst, score as of knn_exact, without a broadcast: each group of queries meets each group of rows in a task.

    Both have at least ``groups`` groups, and as many as keep a group at its size: what travels is the rows once a group of
    queries and the queries once a group of rows.
    """
    dims = dims_of(vectors)
    asks, holds = max(groups, _groups(queries, dims)), max(groups, _groups(vectors, dims))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _plain(queries).select("id", "vector", own(asks).alias("asks"), each(holds).alias("holds"))
    held = _plain(vectors).select("id", "vector", own(holds).alias("holds"), each(asks).alias("asks"))
    pairs = asked.groupBy("asks", "holds").cogroup(held.groupBy("asks", "holds")).applyInArrow(_scored(k), "src long, dst long, score double")
    return _best(pairs, k)


def knn(vectors: DataFrame, k: int = 15, keep: bool = False) -> DataFrame:
    """Every row's exact neighbours at all sizes: by one broadcast while all rows may be one, in rounds beyond.

    Each round broadcasts the next rows as queries and adds their neighbours to a scratch table.  All rows lie dealt over
    the cores, a task's best are kept over all that it reads, and so what is shuffled is k rows a query and core.
    ``keep``: a scratch table whichever way.
    """
    spark, rounds = vectors.sparkSession, -(-_groups(vectors, dims_of(vectors)) // 2)
    if rounds <= 1:
        found = knn_exact(vectors, vectors, k)
        return materialize(found, "neighbours") if keep else found
    cores = spark.sparkContext.defaultParallelism
    path = new_path(spark, "neighbours")
    with passing(spark) as early:
        with owned(spark, early):
            rows = materialize(_plain(vectors).repartition(cores, "id"), "rows")
        for r in range(rounds):
            shared = _shared(rows.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r))
            append(_scan(shared, rows.coalesce(cores), k), path)
            shared.destroy()
    return spark.read.schema("src long, rank int, dst long, score double").parquet(path)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found (A-28)."""
    hits = exact.select("src", "dst").join(found.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("hits"))
    return exact.agg(F.count("*").alias("wanted")).join(hits).select((F.col("hits") / F.col("wanted")).alias("recall"), "hits", "wanted")


def hubness(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: label agreement of neighbours, largest in-degree, share of the top 1 % and nodes never named (A-27)."""
    a, b = labels.select(F.col("id").alias("_a"), F.col("label").alias("_la")), labels.select(F.col("id").alias("_b"), F.col("label").alias("_lb"))
    agreement = neighbours.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).agg(F.avg((F.col("_la") == F.col("_lb")).cast("double")).alias("label_agreement"))
    degrees = labels.select("id").join(neighbours.groupBy("dst").agg(F.count("*").alias("d")), F.col("id") == F.col("dst"), "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    n = degrees.count()
    top = degrees.orderBy(F.col("d").desc(), "id").limit(max(1, -(-n // 100))).agg(F.sum("d").alias("_top"))
    totals = degrees.agg(F.max("d").alias("max_in_degree"), F.sum("d").alias("_all"), F.count_if(F.col("d") == 0).alias("zero_in_degree"))
    return agreement.join(totals).join(top).select("label_agreement", "max_in_degree", (F.col("_top") / F.col("_all")).alias("top_share"), "zero_in_degree")


def seeded_accuracy(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: leave-one-out accuracy of the nearest label centroid, first and among three (A-29).

    A row's own vector is taken out of its label's sum.  The label sums are as many as labels and broadcast
    behind Catalyst's own size check.
    """
    dims = dims_of(df)
    sums = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), F.array(*[F.sum(F.get("vector", F.lit(k)).cast("double")) for k in range(dims)]).alias("_sum"))
    pairs = df.select("id", label, V.as_double(F.col("vector")).alias("vector")).join(sums)
    own = F.col(label) == F.col("_label")
    less = F.when(own, F.zip_with("_sum", "vector", lambda s, x: s - x)).otherwise(F.col("_sum"))
    scored = pairs.where(~own | (F.col("_n") > 1)).withColumn("score", V.dot(F.col("vector"), V.normalize(less)))
    best = Window.partitionBy("id").orderBy(F.round("score", 12).desc(), "_label")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    per_row = ranked.groupBy("id").agg(F.max((own & (F.col("rank") == 1)).cast("int")).alias("one"), F.max(own.cast("int")).alias("three"))
    return per_row.agg(F.count("*").alias("rows"), F.avg("one").alias("top1"), F.avg("three").alias("top3"))


def sync_plan(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """id, action: what an index update has to do, by content hash (J-05, V-11)."""
    a, b = now.select(F.col("id").alias("_a"), F.col("hash").alias("_ha")), indexed.select(F.col("id").alias("_b"), F.col("hash").alias("_hb"))
    action = F.when(F.col("_a").isNull(), "remove").when(F.col("_ha").eqNullSafe(F.col("_hb")), "keep").otherwise("upsert")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias("id"), action.alias("action"))


def apply_sync(vectors: DataFrame, indexed: DataFrame, plan: DataFrame) -> DataFrame:
    """The index after the plan: last write wins, no object to keep in memory (V-09, V-12)."""
    upserts = vectors.join(plan.where("action = 'upsert'").select("id"), "id", "left_semi")
    kept = indexed.join(plan.where("action = 'keep'").select("id"), "id", "left_semi")
    return materialize(kept.unionByName(upserts.select(*kept.columns)), "index")


def search_one(vector: list[float], vectors: DataFrame, k: int = 4, without: int | None = None) -> DataFrame:
    """dst, score: the nearest rows to one vector, perhaps without a row of the index (V-12)."""
    rows = vectors if without is None else vectors.where(F.col("id") != without)
    scored = rows.select(F.col("id").alias("dst"), V.dot(V.as_double(F.col("vector")), F.array(*[F.lit(float(x)) for x in vector])).alias("score"))
    return scored.orderBy(F.col("score").desc(), "dst").limit(k)


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """src, ids, scores: each row's neighbours as arrays, nearest first (V-13)."""
    best = F.array_sort(F.collect_list(F.struct("rank", "dst", "score")))
    return neighbours.groupBy("src").agg(best.alias("b")).select("src", F.transform("b", lambda x: x["dst"]).alias("ids"), F.transform("b", lambda x: x["score"]).alias("scores"))
