"""Streams against batches, and the single-note path."""

from pyspark.sql import functions as F

from corpusloom.streaming import incremental


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "create"), ("a", "2024-01-01 00:00:02", "change"), ("a", "2024-01-01 00:00:09", "change"), ("b", "2024-01-01 00:00:01", "change"), ("z", "2024-01-02 00:00:00", "change")]
    events = spark.createDataFrame(rows, "key string, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", "2024-02-01 00:00:00", "change")], "key string, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental.run_stream(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/checkpoint")
    assert query.awaitTermination(120)
    got = {(r.key, r.events, r.is_new) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.key, r.events, r.is_new) for r in incremental.debounce(events, "3 seconds").collect()}
    assert want == {("a", 2, True), ("a", 1, False), ("b", 1, False), ("z", 1, False)} and got == want


def test_suggestions(spark):
    members = spark.createDataFrame([(k, [1.0, 0.1 * k], "x") for k in range(5)] + [(9, [0.0, 1.0], "lone")], "id long, vector array<double>, index_id string")
    notes = spark.createDataFrame([(50, [1.0, 0.2]), (51, [-1.0, 0.0])], "id long, vector array<double>")
    chunks = spark.createDataFrame([(51, 0, [1.0, 0.2])], "note_id long, chunk_no long, vector array<double>")
    got = incremental.score_topics(notes, members, chunks).collect()
    assert [(r.note_id, r.index_id, r.via) for r in got if r.note_id == 50] == [(50, "x", "document")]
    fresh = incremental.fresh_suggestions(spark.createDataFrame([(50, "x"), (50, "y")], "note_id long, index_id string"), spark.createDataFrame([(50, "x")], "note_id long, index_id string"))
    assert [tuple(r) for r in fresh.collect()] == [(50, "y")]


def test_single_note_outcomes(spark):
    members = spark.createDataFrame([(k, [1.0, 0.1 * k], "x") for k in range(5)], "id long, vector array<double>, index_id string")
    changed = spark.createDataFrame([(1, "a", 1, False, None, [1.0, 0.2]), (2, "b", 2, False, [1.0, 0.2], [1.0, 0.2]), (3, "c", 3, True, None, [1.0, 0.2]), (4, "d", 4, False, None, [-1.0, 0.0])], "note_id long, path string, created_at long, excluded boolean, before array<double>, vector array<double>")
    owned = spark.createDataFrame([], "note_id long, index_id string")
    queue = spark.createDataFrame([(1, "old", 0)], "note_id long, path string, created_at long")
    outcomes, after = incremental.process_batch(changed, members, owned, queue)
    assert {r.note_id: r.status for r in outcomes.collect()} == {1: "suggested", 2: "unchanged", 3: "excluded", 4: "no-new-indexes"}
    assert [tuple(r) for r in after.select("note_id", "path", "created_at").collect()] == [(1, "a", 1)]
    silent, _ = incremental.process_batch(changed, members, owned, queue, ask=False)
    assert silent.where("note_id = 1").first().status == "assigned"
