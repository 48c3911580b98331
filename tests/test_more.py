"""Stores, decisions, single-note operators, progress, and the iterative ones against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import chunks, classify, evaluate, ranks, review, vectors
from corpusloom.operators.collections import any_signature, detect_collections
from corpusloom.plans.config import Settings
from corpusloom.sources import notes, scratch, stores
from corpusloom.streaming import incremental, progress


def test_stores_keep_versions_and_counts(spark, tmp_path):
    path, schema = f"{tmp_path}/store", "id long, name string"
    assert stores.load_store(spark, path, schema).count() == 0
    for n in (3, 5):
        stores.save_store(spark.range(n).select("id", F.lit("x").alias("name")), path)
        assert stores.load_store(spark, path, schema).count() == n
    assert stores.load_store(spark, path, schema, version=2).count() == 0
    place = next(p for p in tmp_path.glob("store/rows-*"))
    next(p for p in place.glob("*.parquet")).unlink()
    assert stores.load_store(spark, path, schema).count() == 0


def test_cache_and_history(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h1", "m", "1"), ("b", "h2", "m", "1"), ("c", "h3", "old", "1")], "note_id string, content_hash string, model_id string, model_version string")
    stores.save_cache(rows, f"{tmp_path}/cache")
    stores.save_cache(rows.where("note_id = 'a'").withColumn("content_hash", F.lit("h9")), f"{tmp_path}/cache")
    assert {(r.note_id, r.content_hash) for r in stores.load_cache(spark, f"{tmp_path}/cache", "m", "1").collect()} >= {("a", "h9")}
    history = spark.createDataFrame([(k, k, k == 4) for k in range(1, 5)], "id long, created_at long, undone boolean")
    assert [r.id for r in stores.keep_latest(history, 2).collect()] == [4, 3] and stores.last_applied(history).first().id == 3
    assert [stores.needs_rebuild(*a) for a in ((0, 1, True), (10, 1, False), (10, 3, True), (10, 2, True))] == [True, True, True, False]


def test_decisions_as_rows(spark):
    d = review.Decisions().merge("a", "b").rename("b", "New").add("a", "n9").remove("b", "n2").set_primary("n1", "c").toggle_ignore("z").toggle_ignore("y")
    assert stores.decisions_of(stores.decisions_table(spark, d)) == d
    assert stores.decisions_of(stores.decisions_table(spark, review.Decisions())) == review.Decisions()
    assert review.record_split(d, "z").ignored == ("y",) and review.record_split(d, "b").splits == ("b",)


def test_a_note_suggested_accepted_dismissed(spark):
    members = spark.createDataFrame([(k, [1.0, 0.1 * k], "x") for k in range(5)], "id long, vector array<double>, index_id string")
    new = spark.createDataFrame([(50, [1.0, 0.2], "f/a.md", ["Film"], False), (51, [1.0, 0.2], "g/b.md", ["film"], True)], "note_id long, vector array<double>, path string, tags array<string>, low_content boolean")
    sets = spark.createDataFrame([("c", "#film")], "index_id string, signature string")
    got = {(r.note_id, r.rank): (r.index_id, r.via) for r in incremental.suggest(new, members, sets).collect()}
    assert got == {(50, 1): ("c", "collection"), (50, 2): ("x", "document"), (51, 1): ("c", "collection")}
    queue = spark.createDataFrame([(50, "a", 1), (7, "b", 2)], "note_id long, path string, created_at long")
    decisions, left = incremental.accept(review.Decisions(), queue, "50", "x")
    assert decisions.added == (("x", "50"),) and [r.note_id for r in left.collect()] == [7]
    unit = lambda df, key: df.select(key, V.normalize(F.col("vector")).alias("vector"))
    items = incremental.attach_similar(queue.where("note_id = 50"), unit(new, "note_id"), unit(members, "id"), 2)
    assert items.first().similar[0] == 2 and len(items.first().similar) == 2
    outcomes = spark.createDataFrame([(1, "assigned", "x"), (2, "suggested", "y")], "note_id long, status string, best_index string")
    assert [tuple(r) for r in incremental.assigned(outcomes).collect()] == [("x", 1)]
    hits = new.select("note_id", any_signature(["#film", "folder: g", "type: t"], F.col("path"), F.col("tags"), F.lit(None).cast("string")).alias("s"))
    assert {r.note_id: r.s for r in hits.collect()} == {50: ["#film"], 51: ["#film", "folder: g"]}
    events = spark.createDataFrame([("p", "h"), ("q", "h")], "path string, content_hash string")
    assert [r.path for r in incremental.drop_own_writes(events, events.where("path = 'p'")).collect()] == ["q"]


def test_a_batch_with_collections(spark):
    members = spark.createDataFrame([(k, [1.0, 0.1 * k], "x") for k in range(5)], "id long, vector array<double>, index_id string")
    changed = spark.createDataFrame([(1, "f/a.md", 1, False, None, [1.0, 0.2], ["film"], True), (2, "f/b.md", 2, False, None, [-1.0, 0.0], [], False)], "note_id long, path string, created_at long, excluded boolean, before array<double>, vector array<double>, tags array<string>, low_content boolean")
    sets = spark.createDataFrame([("c", "#film")], "index_id string, signature string")
    none, queue = spark.createDataFrame([], "note_id long, index_id string"), spark.createDataFrame([], "note_id long, path string, created_at long")
    outcomes, _ = incremental.process_batch(changed, members, none, queue, ask=False, collections=sets)
    assert {r.note_id: (r.status, r.best_index) for r in outcomes.collect()} == {1: ("assigned", "c"), 2: ("no-new-indexes", None)}
    assert [tuple(r) for r in incremental.assigned(outcomes).collect()] == [("c", 1)]


def test_chunks_in_sql_and_stability(spark):
    chunks.register_udtf(spark)
    body = "\n".join(f"# Part {k}\n" + "words and more of them. " * 60 for k in range(3))
    spark.createDataFrame([(1, body, "T")], "id long, content string, title string").createOrReplaceTempView("notes_of_test")
    rows = spark.sql("SELECT id, c.* FROM notes_of_test, LATERAL chunk_note(content, title) c ORDER BY chunk_no").collect()
    assert [r.heading for r in rows] == ["Part 0", "Part 1", "Part 2"] and rows[0].start == 0
    parts = [spark.createDataFrame([(k, k % n) for k in range(12)], "id long, community long") for n in (3, 3, 2)]
    assert evaluate.seed_stability(parts[:2]) == pytest.approx(1) and evaluate.seed_stability(parts) < 1


def test_remaining_time_and_steps(spark, tmp_path):
    log = spark.createDataFrame([("s", 0, 0, 100), ("s", 1000, 40, 100), ("s", 11_000, 50, 100), ("s", 21_000, 60, 100), ("s", 61_000, 100, 100), ("t", 5, 3, 9)], "stage string, at_ms long, done long, total long")
    got = {(r.stage, r.done): r.remaining_ms for r in progress.remaining(log).collect()}
    assert got == {("s", 0): None, ("s", 40): None, ("s", 50): None, ("s", 60): 40 * 20_000 / 20, ("s", 100): None, ("t", 3): None}
    words = [r.w for r in spark.createDataFrame([(20_000.0,), (60_000.0,), (3_600_000.0 * 2 + 60_000,)], "ms double").select(progress.remaining_text(F.col("ms")).alias("w")).collect()]
    assert words == ["less than a minute left", "about 1 min left", "about 2 h 1 min left"]
    made = []
    for _ in range(2):
        assert progress.step(spark, str(tmp_path), "one", lambda: (made.append(1), spark.range(3))[1]).count() == 3
    assert made == [1]
    with progress.cancellable(spark, "g") as cancel:
        assert spark.range(2).count() == 2
        cancel()


def test_scanning_and_links(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("---\nzk-type: note\n---\n# Head\nsee [[d/b.md]] and [[b|B]] #tag\n")
    (tmp_path / "in" / "d" / "b.md").write_text("plain")
    read = notes.read_markdown(spark, str(tmp_path / "in"))
    a = read.where("title = 'a'").first()
    assert a.headings == ["Head"] and a.tags == ["tag"] and a.links == ["d/b.md", "b"] and a.frontmatter == {"zk-type": "note"}
    rows = spark.createDataFrame([("1", "a.md", [], ["d/b.md", "b", "none", "c"]), ("2", "d/b.md", [], []), ("3", "x/c.md", ["gone"], []), ("4", "y/c.md", [], [])], "id string, path string, tags array<string>, links array<string>")
    assert {tuple(r) for r in notes.resolve_links(rows).collect()} == {("1", "2")}
    settings = Settings(excluded_tags=("gone",))
    assert [notes.scan_one(rows, p, settings).count() for p in ("a.md", "x/c.md", "nowhere.md")] == [1, 0, 0]
    known = spark.createDataFrame([("1", "a.md"), ("9", "dead.md")], "id string, path string")
    ids = {r.path: r.id for r in notes.register_ids(rows.select("path"), known).collect()}
    assert ids["a.md"] == "1" and len(set(ids.values())) == 4
    moved = notes.rename_ids(known, spark.createDataFrame([("a.md", "dead.md")], "old string, new string"))
    assert [tuple(r) for r in moved.select("path", "id").collect()] == [("dead.md", "1")]


def test_index_updates(spark):
    row = lambda i, h, x: (i, h, [x])
    now = spark.createDataFrame([row(1, "a", 1.0), row(2, "b", 2.0), row(3, "c", 3.0)], "id long, hash string, vector array<double>")
    old = spark.createDataFrame([row(1, "a", 0.0), row(2, "x", 0.0), row(4, "d", 0.0)], "id long, hash string, vector array<double>")
    plan = vectors.sync_plan(now, old)
    assert {r.id: r.action for r in plan.collect()} == {1: "keep", 2: "upsert", 3: "upsert", 4: "remove"}
    assert {r.id: r.vector for r in vectors.apply_sync(now, old, plan).collect()} == {1: [0.0], 2: [2.0], 3: [3.0]}
    assert [r.dst for r in vectors.search_one([1.0], now, 2, without=3).collect()] == [2, 1]


def test_ranks_of_groups(spark):
    rng = random.Random(1)
    held = [("g" if k % 3 else "h", round(rng.random(), 1)) for k in range(200)]
    asked = [(k, rng.choice("ghx"), round(rng.random(), 1)) for k in range(100)]
    got = ranks.share_of_group_below(spark.createDataFrame(asked, "id long, g string, v double"), spark.createDataFrame(held, "g string, v double"), "g", "v", "s").collect()
    own = lambda g: [v for h, v in held if h == g]
    assert {r.id: r.s for r in got} == {i: pytest.approx(sum(x < v for x in own(g)) / len(own(g))) for i, g, v in asked if g != "x"}
    cuts = {r.g: (r.a, r.b) for r in ranks.values_of_groups_at(spark.createDataFrame(held, "g string, v double"), "g", "v", {"a": 0.25, "b": 0.9}).collect()}
    assert cuts == {g: tuple(sorted(own(g))[int(s * (len(own(g)) - 1))] for s in (0.25, 0.9)) for g in "gh"}
    assert [r.n for r in ranks.numbered(spark.range(50).repartition(3), [F.col("id").desc()], "n").orderBy("id").collect()] == list(range(49, -1, -1))
    assert [r.id for r in evaluate.every_nth(spark.range(50), "id", 5).orderBy("id").collect()] == [0, 10, 20, 30, 40]


def test_collections_against_one_at_a_time(spark):
    rng = random.Random(2)
    kinds = ["type: ", "#", "folder: "]
    for _ in range(3):
        rows = {(n, f"{rng.choice(kinds)}{rng.randint(0, 6)}") for n in range(60) for _ in range(rng.randint(0, 4))}
        df = spark.createDataFrame([(n, s, s[-1], True) for n, s in rows], "note_id long, signature string, label string, low_content boolean")
        sizes = {}
        for _, s in rows:
            sizes[s] = sizes.get(s, 0) + 1
        open_ = sorted((s for s, n in sizes.items() if n >= (5 if s[0] == "f" else 6)), key=lambda s: ([s.startswith(k) for k in kinds].index(True), -sizes[s], s))
        while True:
            taken = {}
            for s in open_:
                for n in {n for n, t in rows if t == s}:
                    taken.setdefault(n, s)
            short = [s for s in open_ if sum(t == s for t in taken.values()) < 6]
            if not short:
                break
            open_.remove(short[0])
        want = {n: s for n, s in taken.items()}
        df = df.where(~F.col("signature").startswith("folder:") | F.col("signature").isin([s for s, n in sizes.items() if n >= 6] or [""]))
        assert {r.note_id: r.signature for r in detect_collections(df, min_notes=6).collect()} == {n: s for n, s in want.items()}


def test_memberships_against_loops(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    x = np.array([centres[k % 4] + 0.9 * rng.normal(size=8) for k in range(120)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    community = [k % 4 if k % 11 else -1 for k in range(120)]
    members = spark.createDataFrame(list(enumerate(community)), "id long, community long")
    near = vectors.knn_exact(df, df, 10)
    o = classify.Options()
    found, topics, core = classify.classify(df, members, near, None, o)
    own = {r.id: (r.community, r.confidence) for r in core.collect()}
    groups = {c: [i for i, (g, _) in own.items() if g == c] for c in {g for g, _ in own.values()}}
    order = sorted(groups, key=lambda c: (-len(groups[c]), min(groups[c])))
    assert topics.communities == order
    means = [x[groups[c]].mean(axis=0) for c in order]
    means = np.array([m / np.linalg.norm(m) for m in means])
    scores = [sorted(float(x[i] @ m) for i in groups[c]) for c, m in zip(order, means, strict=True)]
    cut = lambda k, share: scores[k][int(share * (len(scores[k]) - 1))] - 1e-12
    listed = {}
    for r in near.collect():
        listed.setdefault(r.src, []).append(r.dst)
    placed = {}
    for r in found.collect():
        placed.setdefault(r.id, []).append(r)
    for i in range(120):
        s = x[i] @ means.T
        ranked = sorted(range(len(order)), key=lambda k: (-s[k], k))
        home = order.index(own[i][0]) if i in own else next((k for k in ranked if s[k] >= cut(k, o.rescue)), None)
        mine = sorted(placed.get(i, []), key=lambda r: (not r.is_primary, -r.score))
        if home is None:
            assert all(r.via == "suggestion" for r in mine) and len(mine) <= 3
            continue
        assert mine[0].is_primary and mine[0]["index"] == home
        backed = {own[d][0] for d in listed[i][: o.neighbours] if d in own}
        more = [k for k in ranked if k != home and s[k] >= cut(k, o.secondary) and order[k] in backed][: o.max_indexes - 1]
        assert {r["index"] for r in mine[1:]} == set(more), i
        for r in mine:
            if i not in own or not r.is_primary:
                k = r["index"]
                assert r.score == pytest.approx(sum(v < s[k] - 1e-12 for v in scores[k]) / len(scores[k]), abs=1e-9)


def test_scratch_tables_have_owners(spark):
    with scratch.owned(spark, "mine"):
        kept = scratch.materialize(spark.range(3), "x")
    other = scratch.materialize(spark.range(4), "y")
    with scratch.owned(spark, "mine"):
        pass
    assert other.count() == 4
    with pytest.raises(Exception):
        kept.count()


def test_analysis_leaves_no_passing_tables(spark):
    from corpusloom.plans import analysis
    from corpusloom.sources import scratch

    words = "kafka stream broker topic offset", "bread flour yeast oven dough"
    rows = [(str(k), f"a/{k}.md", f"Note {k}", f"Note {k}\n" + f"{words[k % 2]} {chr(97 + k) * 5} text " * 12, ["en"]) for k in range(12)]
    before = {p for paths in scratch._TABLES.values() for p in paths}
    out = analysis.group_notes(spark.createDataFrame(rows, "id string, path string, title string, content string, tags array<string>"))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for paths in scratch._TABLES.values() for p in paths if p not in before]
    assert not {"lines", "chunks", "hashes", "tokens"} & set(left), left
    assert left.count("chunk-vectors") == 1
    assert out.communities.count() == out.neighbours.select("src").distinct().count() == 12


def test_chunks_of_few_notes_are_held_at_once(spark, monkeypatch):
    from corpusloom.operators import chunks

    n = spark.range(300).coalesce(1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("T\n"), F.repeat(F.lit("some words. "), 150)).alias("content"), F.lit("T").alias("title"))
    seen = []
    monkeypatch.setattr(type(n), "mapInArrow", lambda self, run, schema: seen.append((self, run)) or self)
    chunks.chunks(n, spark.createDataFrame([], "norm string"))
    rows, run = seen[0]
    found = list(run(iter(rows.toArrow().combine_chunks().to_batches())))
    assert len(found) == 3 and len({i for b in found for i in b.column(0).to_pylist()}) == 300
