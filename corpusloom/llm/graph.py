"""Connected components by alternating stars (Kiveris et al. 2014), as joins and aggregations.

Defined cases.  Edges may repeat, point either way or at their own node; edges with a null end are left out.
An empty table has no components.  A node of very many edges is aggregated map-side, never gathered.  Other
columns than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt_join, heavy, materialize

#: Edges that a task takes together before it replaces them by a forest; they bound its memory.
FOREST_EDGES = 500_000


class Forest:
    """Union-find, roots being the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, n: int) -> int:
        up = self.up
        while (p := up.setdefault(n, n)) != n:
            up[n] = n = up[p]
        return n

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart; they no longer are."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _thin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that say the same as those read, at most one a node for every FOREST_EDGES edges."""
    forest, held = Forest(), 0

    def stars() -> pa.RecordBatch:
        found = [(n, r) for n in forest.up if (r := forest.root(n)) != n]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["u", "v"])

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        held += batch.num_rows
        if held >= FOREST_EDGES:
            yield stars()
            forest, held = Forest(), 0
    yield stars()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether all of them point at roots."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("k"))
    row = nodes.agg(F.sum("up"), F.max(F.when((F.col("up") > 1) | (F.col("up") == 1) & (F.col("k") > 1), 1))).first()
    return row[0] or 0, row[1] is None


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that is not its component's smallest.

    Each task first thins its edges to a forest.  Each round then hangs every node's larger neighbours, and after
    that its smaller ones, on the smallest node next to it, until all edges point at roots.  Nodes with
    many neighbours are aggregated map-side and their edges dealt over several tasks.
    """
    some = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("_a"), F.col(b).isNotNull().alias("_b"))
    some = some.where("_a and _b and u > v").select("u", "v")
    now = materialize(some.mapInArrow(_thin, "u long, v long").distinct(), "edges")
    while True:
        number, settled = _state(now)
        if settled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        least = near.select("u", F.least("u", "m").alias("m"))
        large = dealt_join(both.where("v > u"), least, "u", heavy(near, "u", "k", 2 * number), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
