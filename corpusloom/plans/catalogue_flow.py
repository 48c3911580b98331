"""Review, write-back, streaming and whole-analysis queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import applying, review
from corpusloom.plans import analysis
from corpusloom.sources.notes import from_documents, table
from corpusloom.streaming import incremental


def reconcile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bucketings of the embeddings as old and new proposals."""
    rows = table(spark, sf_dir, "embeddings")
    kind = F.lit("topic").alias("kind")
    old = rows.select(F.concat(F.lit("o"), F.col("label")).alias("id"), kind, F.col("vec_id").alias("note_id"))
    new = rows.select(F.concat(F.lit("n"), F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).alias("id"), kind, F.col("vec_id").alias("note_id"))
    return review.overlaps(old, new).select("old_id", "new_id", F.round("jaccard", 9).alias("jaccard"))


DECISIONS = review.Decisions(
    names=(("ix2", "Chosen"),), ignored=("ix9",), merged=(("ix1", "ix0"), ("ix0", "ix5")),
    added=(("ix1", "3"), ("ix3", "4")), removed=(("ix2", "12"), ("ix2", "22")), primary=(("7", "ix5"), ("8", "ix1")),
)


def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    proposals = rows.select(F.concat(F.lit("ix"), F.col("label")).alias("id"), F.lit("topic").alias("kind"), F.concat(F.lit("Topic "), F.col("label")).alias("name")).distinct()
    member = lambda label, primary, score: rows.select(F.concat(F.lit("ix"), label).alias("proposal_id"), F.col("vec_id").cast("string").alias("note_id"), score.alias("score"), F.lit(primary).alias("is_primary"))
    first = member(F.col("label"), True, (F.col("vec_id") % 7) / 10.0)
    second = member((F.col("label") + F.col("vec_id") % 3 + 1) % 10, False, (F.col("vec_id") % 5) / 10.0)
    return proposals, first.unionByName(second)


def effective_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, members = _proposals(spark, sf_dir)
    out = review.effective_members(proposals, members, DECISIONS)
    return out.where("is_primary and not ignored").select("note_id", "index_id", "manual")


def effective_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, members = _proposals(spark, sf_dir)
    out = review.effective_indexes(proposals, review.effective_members(proposals, members, DECISIONS), DECISIONS)
    return out.select("id", "name", "renamed", "ignored", "size")


def apply_plan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = from_documents(table(spark, sf_dir, "documents")).select(F.col("id").cast("long").alias("seq"), "id", F.col("title").alias("name"))
    return applying.unique_paths(notes, "Indexes").select("id", "path")


def _file_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = from_documents(table(spark, sf_dir, "documents")).select(F.col("id").cast("long").alias("n"), "path")
    return n.select("n", F.when(F.col("n") % 10 == 0, F.concat(F.lit("Indexes/"), "n", F.lit(".md"))).otherwise(F.col("path")).alias("path"), (F.col("n") % 10 == 0).alias("is_generated"), (F.col("n") % 3 == 0).alias("has_keys"))


def clear_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _file_state(spark, sf_dir)
    indexes = files.where("is_generated and n % 20 = 0").select(F.col("n").alias("seq"), F.concat(F.lit("ix"), "n").alias("id"), F.col("n").cast("string").alias("name"), F.lit(False).alias("ignored"))
    notes = files.where("not is_generated").select(F.col("n").cast("string").alias("note_id"), "path")
    members = files.where("n % 6 = 3").select(F.concat(F.lit("ix"), F.expr("(n div 20) * 20")).alias("index_id"), F.col("n").cast("string").alias("note_id"), F.lit(True).alias("is_primary"))
    plan = applying.plan_apply(indexes, members, notes, files, spark.createDataFrame([], "id string, path string"))
    return plan.clear.select("path", F.lit("clear").alias("kind")).unionByName(plan.stale.select("path", F.lit("stale").alias("kind")))


def undo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply one index a source to every document, then undo: rows are files that aren't what they were."""
    docs = table(spark, sf_dir, "documents")
    notes = from_documents(docs).select(F.col("id").alias("note_id"), "path", "content", F.regexp_extract("path", "^[^/]*", 0).alias("source"))
    files = notes.select("path", F.col("content").alias("text"))
    names = notes.select("source").distinct().select(F.xxhash64("source").alias("seq"), F.col("source").alias("id"), F.col("source").alias("name"), F.lit(False).alias("ignored"))
    state = files.select("path", F.lit(False).alias("is_generated"), F.lit(False).alias("has_keys"))
    plan = applying.plan_apply(names, notes.select(F.col("source").alias("index_id"), "note_id", F.lit(True).alias("is_primary")), notes.select("note_id", "path"), state, spark.createDataFrame([], "id string, path string"))
    after, journal = applying.apply_plan(files, plan, visible=True)
    back = applying.undo(after, journal)
    same = files.select("path", F.sha2("text", 256).alias("was")).join(back.select(F.col("path").alias("_p"), F.sha2("text", 256).alias("is")), F.col("path") == F.col("_p"), "full")
    digest = lambda df, name: df.select("path", F.sha2("text", 256).alias(name))  # noqa: E731  digests are dealt by path, not texts
    changed = digest(after, "new").join(digest(files, "old"), "path").where("new <> old").agg(F.count("*").alias("changed"))
    return same.agg(F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("differences"), F.count("*").alias("files")).join(changed)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "signup", "create").otherwise(F.col("event_type")).alias("op"), "value")


def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.debounce(_events(spark, sf_dir), "30 minutes")
    return out.groupBy("key").agg(F.count("*").alias("bursts"), F.sum("events").alias("events"), F.count_if("is_new").alias("new"), F.max("events").alias("largest"))


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest_job(_events(spark, sf_dir), "key", "ts", "event_id").select("key", "event_id", "op")


def event_queue_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir).select(F.col("key").alias("note_id"), F.col("event_id").cast("string").alias("path"), F.unix_timestamp("ts").alias("created_at"))
    return incremental.upsert_queue(items.limit(0), items).select("note_id", "created_at")


def stage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each event to the user's next one (W-11)."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    out = _events(spark, sf_dir).withColumn("seconds", F.unix_timestamp(F.lead("ts").over(order)) - F.unix_timestamp("ts"))
    return out.where("seconds is not null").select("event_id", "seconds")



def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of the whole analysis over the documents."""
    _, found = analysis.analyse(from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return found.proposals.select("id", "kind", "name", "confidence", F.col("primaries").alias("size"))


def analysis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole analysis against the documents' language."""
    from corpusloom.operators import evaluate

    out = analysis.group_notes(from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    pairs = out.communities.join(langs, "id").select(F.col("lang").alias("label"), F.col("community").alias("cluster"))
    return evaluate.partition_score(pairs)


QUERIES = {f.__name__: f for f in (reconcile_overlap, effective_primary, effective_sizes, apply_plan_names, clear_and_stale, undo_roundtrip, debounced_events, latest_event_per_user, event_queue_top200, stage_spans, full_analysis, analysis_quality)}

_EVENTS = "e AS (SELECT event_id, ts, user_id AS key, CASE WHEN event_type = 'signup' THEN 'create' ELSE event_type END AS op FROM events)"
_TITLE = f"substr(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {T.sql_trim('l')}), lambda l: l <> '')[1], ''), 1, 80)"
_EFFECTIVE = """p AS (SELECT DISTINCT 'ix' || label AS id FROM embeddings),
  t AS (SELECT id, CASE WHEN id IN ('ix0', 'ix1') THEN 'ix5' ELSE id END AS target FROM p),
  m AS (SELECT 'ix' || label AS pid, vec_id::VARCHAR AS note_id, (vec_id % 7) / 10.0::DOUBLE AS score, true AS prim FROM embeddings UNION ALL
        SELECT 'ix' || (label + vec_id % 3 + 1) % 10, vec_id::VARCHAR, (vec_id % 5) / 10.0::DOUBLE, false FROM embeddings),
  f AS (SELECT target AS index_id, note_id, bool_or(prim) AS prim, max(CASE WHEN pid = target THEN score END) AS own, max(score) AS top, any_value(score) AS any_score FROM m JOIN t ON pid = id GROUP BY 1, 2),
  b AS (SELECT index_id, note_id, prim, coalesce(own, top) AS score, false AS manual FROM f UNION ALL
        SELECT a.i, a.n, true, 1.0, true FROM (VALUES ('ix5', '3'), ('ix3', '4')) a(i, n) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.index_id = a.i AND f.note_id = a.n)),
  k AS (SELECT * FROM b WHERE NOT (index_id = 'ix2' AND note_id IN ('12', '22')))"""
ORACLES = {
    "reconcile_overlap": """WITH o AS (SELECT 'o' || label AS id, vec_id FROM embeddings), n AS (SELECT 'n' || CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS id, vec_id FROM embeddings),
      s AS (SELECT o.id AS old_id, n.id AS new_id, count(*) AS k FROM o JOIN n USING (vec_id) GROUP BY 1, 2), a AS (SELECT id, count(*) AS na FROM o GROUP BY 1), b AS (SELECT id, count(*) AS nb FROM n GROUP BY 1)
      SELECT old_id, new_id, round(k / (na + nb - k), 9) AS jaccard FROM s JOIN a ON a.id = old_id JOIN b ON b.id = new_id WHERE k / (na + nb - k) >= 0.4""",
    "effective_sizes": f"""WITH {_EFFECTIVE} SELECT t.id, CASE WHEN t.id = 'ix2' THEN 'Chosen' ELSE 'Topic ' || substr(t.id, 3) END AS name, t.id = 'ix2' AS renamed, t.id = 'ix9' AS ignored, count(k.note_id) AS size
      FROM t LEFT JOIN k ON k.index_id = t.id WHERE t.id = t.target GROUP BY ALL""",
    "clear_and_stale": """WITH s AS (SELECT doc_id AS n, CASE WHEN doc_id % 10 = 0 THEN 'Indexes/' || doc_id || '.md' ELSE concat_ws('/', source, lang, 'doc_' || doc_id || '.md') END AS path FROM documents)
      SELECT path, 'clear' AS kind FROM s WHERE n % 3 = 0 AND NOT (n % 10 <> 0 AND n % 6 = 3) AND NOT (n % 20 = 0) UNION ALL SELECT path, 'stale' FROM s WHERE n % 10 = 0 AND n % 20 <> 0""",
    "undo_roundtrip": "SELECT 0::BIGINT AS differences, count(*) AS files, count(*) AS changed FROM documents",
    "debounced_events": f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM e),
      b AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY ts, event_id) AS burst FROM g), s AS (SELECT key, burst, count(*) AS events, bool_or(op = 'create') AS is_new FROM b GROUP BY 1, 2)
      SELECT key, count(*) AS bursts, sum(events)::BIGINT AS events, count(*) FILTER (is_new) AS "new", max(events) AS largest FROM s GROUP BY key""",
    "latest_event_per_user": f"WITH {_EVENTS} SELECT key, event_id, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1",
    "event_queue_top200": f"WITH {_EVENTS}, l AS (SELECT key AS note_id, max(epoch(ts)::BIGINT) AS created_at FROM (SELECT key, date_trunc('second', ts) AS ts FROM e) GROUP BY key) SELECT note_id, created_at FROM l ORDER BY created_at DESC, note_id LIMIT 200",
    "stage_spans": f"WITH {_EVENTS}, s AS (SELECT event_id, epoch(date_trunc('second', lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id)))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS seconds FROM e) SELECT event_id, seconds FROM s WHERE seconds IS NOT NULL",
    "apply_plan_names": f"""WITH n AS (SELECT doc_id, {T.sql_file_name(_TITLE)} AS base FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY doc_id) AS k FROM n)
      SELECT doc_id::VARCHAR AS id, 'Indexes/' || base || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.md' AS path FROM r""",
}
