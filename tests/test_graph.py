"""Vectors, graph, clustering, classification, review and write-back on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import applying, classify, cluster, evaluate, graph, review, vectors
from corpusloom.operators.collections import detect_collections, note_signatures
from corpusloom.operators.naming import choose_names
from corpusloom.operators.ranks import share_below, value_at
from corpusloom.sources.scratch import materialize, owned, release


@pytest.fixture(scope="module")
def synthetic(spark):
    return cluster.synthetic_vectors(spark, 400, 16, centres=8, noise=0.3).cache()


def test_centring(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    got = {r.id: r.vector for r in vectors.center(rows).collect()}
    assert got[1] == pytest.approx([0.7071068, -0.7071068])
    assert spark.range(1).select(V.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v == [0.0, 0.0]


def test_neighbours_by_cells_recall(synthetic):
    exact = vectors.knn_exact(synthetic, synthetic, 10)
    assert exact.where("rank = 1").count() == 400
    assert vectors.recall(exact, vectors.knn_cells(synthetic, synthetic, 10, slice_rows=40)).first().recall >= 0.95


def test_neighbours_are_exact_beyond_a_broadcast(spark, monkeypatch):
    rows = cluster.synthetic_vectors(spark, 1500, 16, centres=1500).cache()
    want = sorted(map(tuple, vectors.knn_exact(rows, rows, 10).select("src", "rank", "dst").collect()))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1 << 18)
    assert sorted(map(tuple, vectors.knn(rows, 10).select("src", "rank", "dst").collect())) == want


def test_neighbours_with_many_copies(spark, monkeypatch):
    import numpy as np

    m = np.random.default_rng(3).integers(-3, 4, (900, 6)).astype(float)
    m[100:400] = m[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, vector array<double>").repartition(5)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1 << 14)
    scores = m @ m.T
    np.fill_diagonal(scores, -np.inf)
    want = {(a, r + 1, int(b)) for a in range(900) for r, b in enumerate(np.lexsort((np.arange(900), -scores[a]))[:7])}
    assert {(r.src, r.rank, r.dst) for r in vectors.knn(rows, 7).collect()} == want
    assert {(r.src, r.rank, r.dst) for r in vectors.knn_blocks(rows, rows, 7, 2).collect()} == want


def test_scores_of_a_large_group_stay_small():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    table = lambda n: pa.table({"id": pa.array(range(n)), "vector": pa.array(np.random.default_rng(n).random((n, 4)).tolist(), pa.list_(pa.float64()))})
    asked, held = table(1024), table(40_000)
    tracemalloc.start()
    assert vectors._scored(5)(asked, held).num_rows == 1024 * 5
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all scores at once are 328 MB, twice that to partition them


def test_blocks_grow_in_number_not_in_size(spark, monkeypatch):
    import pyarrow as pa

    rows = cluster.synthetic_vectors(spark, 1500, 16, centres=1500).cache()
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1 << 16)
    monkeypatch.setattr(vectors, "_scored", lambda k: lambda q, m: pa.table({"src": pa.array([q.num_rows], pa.int64()), "dst": pa.array([m.num_rows], pa.int64()), "score": pa.array([1.0])}))
    seen = vectors.knn_blocks(rows.where("id % 50 = 0"), rows, 15, 3).collect()
    assert max(r.dst for r in seen) < 300  # 3 groups have 500 each


def test_quantiles_and_ranks(spark):
    rows = spark.createDataFrame([(float(x % 50),) for x in range(500)], "v double")
    ordered = sorted(x % 50 for x in range(500))
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert value_at(rows, "v", q) == ordered[min(499, int(q * 500))]
        assert value_at(rows, "v", q, of_last=True) == ordered[int(q * 499)]
    got = {r.v: r.s for r in share_below(rows, "v", "s").distinct().collect()}
    assert got[0.0] == 0 and got[25.0] == 0.5
    assert value_at(rows.limit(0), "v", 0.5) is None


@pytest.mark.parametrize("in_task", [10_000, 0])
def test_louvain_finds_cliques(spark, in_task):
    groups = [range(0, 6), range(6, 12), range(20, 25)]
    edges = [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(5, 6, 0.05)]
    df, nodes = spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([(n,) for g in groups for n in g] + [(99,)], "id long")
    found = cluster.louvain(df.repartition(3), nodes, in_task_edges=in_task)
    parts = {}
    for r in found.collect():
        parts.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, parts.values())) == sorted([*(list(g) for g in groups), [99]])
    assert cluster.modularity(df, found) > 0.5


def test_louvain_rounds_wait_for_every_turn(spark):
    turn = lambda r: F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
    late = [r.id for r in spark.range(100).where(~turn(0) & ~turn(1)).orderBy("id").limit(2).collect()]
    df, nodes = spark.createDataFrame([(*late, 1.0)], "a long, b long, weight double"), spark.createDataFrame([(n,) for n in late], "id long")
    assert cluster.louvain(df, nodes, in_task_edges=0).select("community").distinct().count() == 1


def test_refinement_and_split(spark):
    edges = [(a, b, 1.0) for k in range(4) for a in range(6 * k, 6 * k + 6) for b in range(a + 1, 6 * k + 6)] + [(6 * k, 6 * k + 6, 0.01) for k in range(3)]
    df, one = spark.createDataFrame(edges, "a long, b long, weight double"), spark.range(24).select("id", F.lit(0).cast("long").alias("community"))
    assert cluster.refine(df, one).select("community").distinct().count() == 4
    assert cluster.split_index(df, one.select("id")).select("community").distinct().count() >= 2
    assert cluster.cluster_notes(df, spark.range(25).select("id", (F.col("id") < 24).alias("included"))).where("community = -1").count() == 1


def test_hybrid_score_of_a_pair(spark):
    f = spark.createDataFrame([(1, ["a"], ["k"], "d"), (2, ["a"], ["l"], "d")], "id long, tags array<string>, keywords array<string>, folder string")
    near = spark.createDataFrame([(1, 1, 2, 0.5), (2, 1, 1, 0.5)], "src long, rank int, dst long, score double")
    links = spark.createDataFrame([(2, 1), (1, 1)], "src long, dst long")
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vector array<double>")
    assert graph.hybrid_edges(near, f, links, v).first().weight == pytest.approx(0.15 + 0.08 + 0.02)


def test_classifier_places_clusters(synthetic):
    near = vectors.knn_exact(synthetic, synthetic, 10)
    members = synthetic.select("id", F.when(F.col("id") == 3, -1).otherwise(F.col("cluster")).cast("long").alias("community"))
    found, topics, _ = classify.classify(synthetic, members, near)
    assert len(topics.communities) == 8
    home = found.where("is_primary").join(synthetic.select("id", "cluster"), "id").select(F.col("cluster").alias("label"), F.col("index").alias("cluster"))
    assert home.count() > 350 and evaluate.purity(home).first().purity > 0.95 and evaluate.nmi(home).first().nmi > 0.9
    assert found.where("id = 3 and via = 'centroid' and is_primary").count() + found.where("id = 3 and via = 'suggestion'").count() >= 1


def test_collections_take_turns(spark):
    notes = [(k, "x/a.md", ["film"], True, "Movie") for k in range(6)] + [(9, "y/b.md", ["film"], True, None)] + [(k, "small/c.md", [], True, None) for k in (20, 21, 22)]
    rows = spark.createDataFrame(notes, "note_id long, path string, tags array<string>, low_content boolean, kind string")
    got = detect_collections(note_signatures(rows, F.col("kind"))).collect()
    assert {r.note_id: r.signature for r in got} == {k: "type: movie" for k in range(6)}


def test_names_are_not_taken_twice():
    got = choose_names([("a", "Kafka", 0.9), ("a", "Queue", 0.6), ("b", "kafka", 0.8), ("b", "Topic", 0.4)], ["a", "b"])
    assert got["a"] == ("Kafka", ["Queue"], 0.9) and got["b"] == (None, ["Topic"], 0.4)


def test_decisions(spark):
    d = review.Decisions().merge("a", "b").merge("b", "a").rename("b", " New ").add("a", "n9").remove("b", "n2").set_primary("n1", "c").toggle_ignore("z")
    assert d.merged == (("a", "b"),) and d.count() == 6 and review.resolve("x", {"x": "y", "y": "x"}) in "xy"
    p = spark.createDataFrame([("a", "topic", "A"), ("b", "topic", "B"), ("c", "topic", "C")], "id string, kind string, name string")
    m = spark.createDataFrame([("a", "n1", 0.9, True), ("b", "n2", 0.5, True), ("b", "n3", 0.5, True), ("c", "n1", 0.1, False)], "proposal_id string, note_id string, score double, is_primary boolean")
    got = {(r.index_id, r.note_id): r.is_primary for r in review.effective_members(p, m, d).collect()}
    assert got == {("b", "n1"): False, ("b", "n3"): True, ("b", "n9"): True, ("c", "n1"): True}
    assert review.match_ids([("o", "x", 0.9), ("o", "y", 0.8)], ["x", "y", "o"]) == {"x": "o", "y": "y", "o": "o-n"}


def test_apply_and_undo(spark):
    files = spark.createDataFrame([("a.md", "text a"), ("b.md", "---\nzk-type: note\n---\nb"), ("Indexes/Old.md", "---\nzk-generated: true\n---\n"), ("Indexes/Own.md", "mine\r\n"), ("Indexes/Gone.md", "x")], "path string, text string")
    state = files.select("path", F.col("path").isin("Indexes/Old.md", "Indexes/Gone.md").alias("is_generated"), (F.col("path") == "b.md").alias("has_keys"))
    indexes = spark.createDataFrame([(1, "i1", "New", False), (2, "i2", "Own", False), (3, "i3", "new", False), (4, "i4", "Skip", True)], "seq long, id string, name string, ignored boolean")
    members = spark.createDataFrame([("i1", "1", True), ("i2", "1", False), ("i3", "7", True)], "index_id string, note_id string, is_primary boolean")
    notes = spark.createDataFrame([("1", "a.md"), ("2", "b.md")], "note_id string, path string")
    plan = applying.plan_apply(indexes, members, notes, state, spark.createDataFrame([("i1", "Indexes/Old.md")], "id string, path string"))
    assert {(r.id, r.path, r.action, r.user_note) for r in plan.indexes.collect()} == {("i1", "Indexes/New.md", "update", False), ("i2", "Indexes/Own.md", "update", True), ("i3", "Indexes/new (2).md", "create", False)}
    assert plan.skipped.count() == 1 and [r.path for r in plan.clear.collect()] == ["b.md"] and [r.path for r in plan.stale.collect()] == ["Indexes/Gone.md"]
    after, journal = applying.apply_plan(files, plan, visible=True)
    got = {r.path: r.text for r in after.collect()}
    assert got["b.md"] == "b" and got["a.md"].startswith('---\nzk-type: note\nzk-indexes:\n  - "[[New]]"\n  - "[[Own]]"\n---\ntext a') and "Indexes: [[New]] · [[Own]]" in got["a.md"]
    assert "Indexes/Gone.md" not in got and got["Indexes/Own.md"].endswith("%% corpusloom:end %%\r\n") and "- [[a]]" in got["Indexes/New.md"]
    assert tuple(applying.summary(journal).first()) == (1, 4, 1, 1)
    assert {tuple(r) for r in applying.undo(after, journal).collect()} == {tuple(r) for r in files.collect()}
    touched = after.withColumn("text", F.when(F.col("path") == "a.md", F.concat("text", F.lit("more"))).otherwise(F.col("text")))
    assert "text amore" in {r.text.replace("\n", "") for r in applying.undo(touched, journal).where("path = 'a.md'").collect()}


def test_undo_roundtrip_deals_and_writes_texts_few_times(spark):
    """What applying and undoing shuffle and write stays below 7 times the texts, which don't compress."""
    sc, key = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"
    files = materialize(spark.range(0, 400, 1, 4).select(F.concat(F.lit("n/"), "id", F.lit(".md")).alias("path"), F.concat_ws("", *[F.base64(F.unhex(F.sha2(F.concat("id", F.lit(f" {k}")), 512))) for k in range(100)]).alias("text")), "texts")
    size = files.agg(F.sum(F.length("text"))).first()[0]

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    state = files.select("path", F.lit(False).alias("is_generated"), F.lit(False).alias("has_keys"))
    members = files.select(F.lit("i").alias("index_id"), F.col("path").alias("note_id"), F.lit(True).alias("is_primary"))
    indexes = spark.createDataFrame([(1, "i", "All", False)], "seq long, id string, name string, ignored boolean")
    before, was = shuffled(), spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        with owned(spark, "roundtrip"):
            plan = applying.plan_apply(indexes, members, files.select(F.col("path").alias("note_id"), "path"), state, spark.createDataFrame([], "id string, path string"))
            after, journal = applying.apply_plan(files, plan, visible=True)
            assert after.count() == 401
            back = applying.undo(after, journal)
            assert back.join(files.withColumnRenamed("text", "was"), "path").where("text = was").count() == 400
            written = sum(os.path.getsize(f) for f in {f.removeprefix("file:").replace("//", "/") for df in (after, journal) for f in df.inputFiles()})
    finally:
        spark.conf.set(key, was)
        release(spark, "roundtrip")
    assert shuffled() - before + written < 7 * size
