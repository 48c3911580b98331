"""Incremental processing: events, debounce, latest job, scoring of single notes, review queue (R-01..R-12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import vectors as V
from corpusloom.operators.collections import note_signatures
from corpusloom.operators.ranks import share_of_group_below
from corpusloom.operators.review import Decisions
from corpusloom.operators.vectors import centroids, knn_exact
from corpusloom.plans.config import CHUNK_DISCOUNT, INCREMENTAL_PERCENTILE, MIN_MEMBERS, QUEUE_CAP, SIGNIFICANT_COSINE


def debounce(events: DataFrame, delay: str = "3 seconds", key: str = "key", ts: str = "ts") -> DataFrame:
    """One row for each burst of a key's events: start, end, events, is_new, last_op (R-01, R-03).

    Events no further apart than the delay are one burst; it is new if any of them creates the note.
    On a stream the watermark decides when a burst is over; events later than it are dropped.
    """
    burst = F.session_window(ts, delay)
    found = events.groupBy(F.col(key), burst.alias("w")).agg(F.count("*").alias("events"), F.bool_or(F.col("op") == "create").alias("is_new"), F.max_by("op", F.struct(ts, "op")).alias("last_op"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "is_new", "last_op")


def watermarked(events: DataFrame, late: str = "1 minute", ts: str = "ts") -> DataFrame:
    """The event time as a TIMESTAMP with a watermark, as streams need it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def latest_job(events: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last event of each key (R-02): one row a key crosses the shuffle from each task."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, tie)).alias("_e")).select(key, *[F.col(f"_e.{c}").alias(c) for c in columns])


def apply_renames(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """A note's id follows its path (R-04)."""
    from corpusloom.sources.notes import rename_ids

    return rename_ids(paths, renames)


def drop_deleted(rows: DataFrame, deleted: DataFrame, key: str = "note_id") -> DataFrame:
    """Cache, vectors, queue or paths without deleted notes (R-05)."""
    return rows.join(deleted.select(key), key, "left_anti")


def drop_own_writes(events: DataFrame, written: DataFrame) -> DataFrame:
    """Events whose text hash isn't one that an apply has just written (F-11, R-12)."""
    return events.join(written.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def significant_change(before: Column, after: Column, threshold: float = SIGNIFICANT_COSINE) -> Column:
    """Whether a note's meaning moved enough to look again; a missing earlier vector always counts (F-10)."""
    return F.coalesce(V.cosine(before, after) < threshold, F.lit(True))


def score_topics(notes: DataFrame, members: DataFrame, chunks: DataFrame | None = None, limit: int = 3, least: float = INCREMENTAL_PERCENTILE, discount: float = CHUNK_DISCOUNT, min_members: int = MIN_MEMBERS) -> DataFrame:
    """note_id, rank, index_id, score, via: topics a note fits better than ``least`` of their members (R-07).

    notes: id, vector.  members: id, vector, index_id, primary members only.  A long note may fit by its best
    chunk (note_id, chunk_no, vector), at a discount; the document wins ties.  Topics are few and broadcast
    behind Catalyst's own check of their size.
    """
    centres = centroids(members, "index_id").where(F.col("size") >= min_members).select("index_id", "centroid")
    own = members.join(centres, "index_id").select("index_id", F.round(V.dot(F.col("vector"), F.col("centroid")), 9).alias("s"))
    parts = notes.select(F.col("id").alias("note_id"), F.lit(-1).cast("long").alias("chunk_no"), V.as_double(F.col("vector")).alias("vector"), F.lit(1.0).alias("factor"))
    if chunks is not None:
        parts = parts.unionByName(chunks.select("note_id", F.col("chunk_no").cast("long").alias("chunk_no"), V.as_double(F.col("vector")).alias("vector"), F.lit(discount).alias("factor")))
    scored = parts.join(centres).withColumn("s", F.round(F.col("factor") * V.dot(F.col("vector"), F.col("centroid")), 9))
    best = scored.groupBy("note_id", "index_id").agg(F.max("s").alias("s"), F.max_by("chunk_no", F.struct("s", -F.col("chunk_no"))).alias("chunk_no"))
    fit = share_of_group_below(best, own, "index_id", "s", "score").where(F.col("score") >= least)
    order = Window.partitionBy("note_id").orderBy(F.col("score").desc(), "index_id")
    return fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("note_id", "rank", "index_id", "score", F.when(F.col("chunk_no") < 0, "document").otherwise("chunk").alias("via"), "chunk_no")


def score_collections(notes: DataFrame, collections: DataFrame) -> DataFrame:
    """note_id, index_id, score 1, via: collections whose signature a note carries (F-09).

    notes: note_id, path, tags, low_content and perhaps kind.  collections: index_id, signature.
    """
    signed = note_signatures(notes, F.col("kind") if "kind" in notes.columns else None)
    return signed.join(collections, "signature").select("note_id", "index_id", F.lit(1.0).alias("score"), F.lit("collection").alias("via"), F.lit(-1).cast("long").alias("chunk_no"))


def suggest(notes: DataFrame, members: DataFrame, collections: DataFrame, chunks: DataFrame | None = None, limit: int = 3, least: float = INCREMENTAL_PERCENTILE) -> DataFrame:
    """note_id, rank, index_id, score, via, chunk_no: the best topics and collections of single notes (R-07).

    Notes of little text are looked up among collections alone.  notes: note_id, vector, path, tags, low_content.
    """
    full = notes.where("not low_content").select(F.col("note_id").alias("id"), "vector")
    topics = score_topics(full, members, chunks, limit, least).select("note_id", "index_id", F.round("score", 3).alias("score"), "via", "chunk_no")
    order = Window.partitionBy("note_id").orderBy(F.col("score").desc(), F.col("via") != "collection", "index_id")
    both = topics.unionByName(score_collections(notes, collections)).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= limit).select("note_id", "rank", "index_id", "score", "via", "chunk_no")


def attach_similar(items: DataFrame, notes: DataFrame, vectors: DataFrame, first: int = 4) -> DataFrame:
    """Queue items with ``similar``: the ids of the nearest other notes, nearest first (R-09).

    notes: note_id, vector of the items; vectors: id, vector of all notes.
    """
    asked = items.select("note_id").join(notes, "note_id").select(F.col("note_id").alias("id"), "vector")
    near = knn_exact(asked, vectors, first).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("similar"))
    return items.join(near, items["note_id"] == near["src"], "left").drop("src")


def assigned(outcomes: DataFrame) -> DataFrame:
    """index_id, note_id: what is added without asking, for notes that had no index (R-10)."""
    return outcomes.where("status = 'assigned'").select(F.col("best_index").alias("index_id"), "note_id")


def accept(decisions: Decisions, queue: DataFrame, note: str, index: str) -> tuple[Decisions, DataFrame]:
    """A suggestion taken: the note is added to the index and leaves the queue (R-11)."""
    return decisions.add(index, note), dismiss(queue, note)


def dismiss(queue: DataFrame, note: str) -> DataFrame:
    """The queue without a note's item."""
    return queue.where(~F.col("note_id").cast("string").eqNullSafe(F.lit(note)))


def fresh_suggestions(suggestions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Suggestions for indexes a note isn't in yet (J-13)."""
    return suggestions.join(memberships.select("note_id", "index_id"), ["note_id", "index_id"], "left_anti")


def upsert_queue(queue: DataFrame, items: DataFrame, removed: DataFrame | None = None, cap: int = QUEUE_CAP) -> DataFrame:
    """The review queue after new items: the latest of each note, newest first, at most ``cap`` (R-08, T-07)."""
    both = latest_job(queue.unionByName(items), "note_id", "created_at", "path")
    if removed is not None:
        both = drop_deleted(both, removed)
    return both.orderBy(F.col("created_at").desc(), "note_id").limit(cap)


def outcome(row_excluded: Column, unchanged: Column, suggested: Column, ask: bool, has_index: Column) -> Column:
    """What became of a single note (R-06, R-10)."""
    return F.when(row_excluded, "excluded").when(unchanged, "unchanged").when(suggested == 0, "no-new-indexes").when(F.lit(not ask) & ~has_index, "assigned").otherwise("suggested")


def process_batch(changed: DataFrame, members: DataFrame, memberships: DataFrame, queue: DataFrame, ask: bool = True, collections: DataFrame | None = None, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, queue) of one batch of changed notes (R-06, S12): stateless, so a replayed batch gives the same.

    changed: note_id, path, created_at, excluded, before (vector or null), vector; with ``collections`` (index_id,
    signature) also tags and low_content.  What is assigned without asking is ``assigned(outcomes)``.
    """
    alive = changed.where("not excluded")
    moved = alive.where(significant_change(F.col("before"), F.col("vector")))
    scored = score_topics(moved.select(F.col("note_id").alias("id"), "vector"), members, chunks) if collections is None else suggest(moved, members, collections, chunks)
    offers = fresh_suggestions(scored, memberships)
    each = offers.groupBy("note_id").agg(F.count("*").alias("offers"), F.array_sort(F.collect_list(F.struct("rank", "index_id", "score"))).alias("suggestions"))
    owned = memberships.select(F.col("note_id").alias("_m")).distinct()
    rows = changed.join(each, "note_id", "left").join(owned, F.col("note_id") == F.col("_m"), "left")
    status = outcome(F.col("excluded"), ~significant_change(F.col("before"), F.col("vector")), F.coalesce("offers", F.lit(0)), ask, F.col("_m").isNotNull())
    outcomes = rows.select("note_id", status.alias("status"), F.get("suggestions", F.lit(0))["index_id"].alias("best_index"))
    asked = rows.where(status == "suggested").select("note_id", "path", "created_at")
    return outcomes, upsert_queue(queue, asked)


def run_stream(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "3 seconds", late: str = "1 minute", available_now: bool = True) -> StreamingQuery:
    """Debounced bursts of a stream, a batch at a time.  ``handle`` must be idempotent for a batch id."""
    bursts = debounce(watermarked(events, late), delay)
    writer = bursts.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
