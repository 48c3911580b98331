"""Queries of display, splitting, progress, evaluation and single-note operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, keywords, review, templates, vectors
from corpusloom.plans.catalogue_flow import _EFFECTIVE, DECISIONS, _proposals
from corpusloom.plans.catalogue_graph import _CELLS, _CENTRES, _V, _knn, _neighbours, _nmi, _vectors
from corpusloom.plans.catalogue_text import _BODIES, _LINES, _NOTES, _TAGGED, _TF, _TOKENS, _notes, terms_by_lang
from corpusloom.sources.notes import resolve_links as resolve
from corpusloom.sources.notes import table
from corpusloom.streaming import incremental, progress


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest labels; the list's length is the operator's."""
    out = evaluate.largest_clusters(_vectors(spark, sf_dir), 5, "label")
    return out.select(F.col("place").cast("long").alias("place"), "size")


def sampled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator over all documents."""
    return evaluate.every_nth(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 60)


def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type as a stage whose events are its progress reports."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    log = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stage"), F.expr("1").alias("_"), F.floor(at / 1000).alias("at_ms"), (F.row_number().over(order) - 1).cast("long").alias("done"), F.count("*").over(Window.partitionBy("event_type")).alias("total"))
    out = progress.remaining(log.drop("_"))
    return out.select("event_id", F.round("remaining_ms", 3).alias("remaining_ms"))


def shown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, members = _proposals(spark, sf_dir)
    out = review.shown_members(review.effective_members(proposals, members, DECISIONS).where("not ignored"), 20)
    return out.select("index_id", F.col("place").cast("long").alias("place"), "note_id", "is_primary")


def live_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are still there, when every seventh note is gone."""
    proposals, members = _proposals(spark, sf_dir)
    live = members.where("cast(note_id as long) % 7 <> 0").select("note_id").distinct()
    return review.effective_members(proposals, members, DECISIONS, live).groupBy("index_id").agg(F.count("*").alias("members"))


def merged_index_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, _ = _proposals(spark, sf_dir)
    label = F.substring("id", 3, 9).cast("long")
    words = proposals.withColumn("keywords", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("w"), ((label + k * 2) % 11).cast("string"))))
    return review.merged_keywords(words, DECISIONS).select("id", F.array_join("keywords", ",").alias("keywords"))


def split_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index split in two parts, one of which has an id that is taken."""
    proposals, members = _proposals(spark, sf_dir)
    own = members.where("proposal_id = 'ix3' and is_primary and cast(note_id as long) % 5 <> 0")
    part = F.col("note_id").cast("long") % 2
    parts = own.select(F.when(part == 0, "ix4").otherwise("new").alias("id"), F.concat(F.lit("Part "), part).alias("name"), "note_id", "score")
    found, rows, lost = review.apply_split(proposals, members, "ix3", parts)
    sizes = rows.where("is_primary").groupBy(F.col("proposal_id").alias("id")).agg(F.count("*").alias("primaries"))
    return found.join(sizes, "id", "left").crossJoin(lost.agg(F.count("*").alias("lost"))).select("id", "name", F.coalesce("split_from", F.lit("")).alias("split_from"), F.coalesce("primaries", F.lit(0)).alias("primaries"), "lost")


def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.neighbour_lists(_neighbours(spark, sf_dir, 5))
    return out.select("src", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def seeded_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id ends in 0 lose their label and get the nearest ones."""
    rows = _vectors(spark, sf_dir).withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label")))
    return evaluate.seeded_suggestions(rows).select("id", "best", "second", F.round("margin", 6).alias("margin"))


def label_bank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty vectors as a bank of labels for the label centroids."""
    rows = _vectors(spark, sf_dir)
    bank = rows.where("id < 40").select(F.concat(F.lit("b"), "id").alias("label"), "vector")
    topics = vectors.centroids(rows, "label").select(F.col("label").alias("index"), "centroid")
    out = evaluate.label_names(topics, bank)
    return out.select("index", F.col("rank").cast("long").alias("rank"), "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


def best_chunk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors each as the chunks of a note, against the label centroids."""
    rows = _vectors(spark, sf_dir)
    topics = vectors.centroids(rows, "label").select(F.col("label").alias("index"), "centroid")
    chunks = rows.select(F.expr("id div 4").alias("note_id"), (F.col("id") % 4).alias("chunk_no"), "vector")
    return evaluate.best_chunks(chunks, topics).select("note_id", "index", F.round("score", 6).alias("score"), "chunk_no")


def collection_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir, labels=True).select(F.col("id").alias("note_id"), "path", "tags", F.lit(True).alias("low_content"))
    sets = spark.createDataFrame([("c1", "#fr"), ("c2", "#quality/1"), ("c3", "folder: src1/en")], "index_id string, signature string")
    return incremental.score_collections(notes, sets).select("note_id", "index_id", "score", "via")


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note links to one by path, one by base name, and one that isn't there."""
    notes = _notes(spark, sf_dir)
    later = lambda k: (F.col("id").cast("long") + k).cast("string")
    links = notes.select(F.col("path").alias("_p"), F.col("id").alias("_i"))
    linked = notes.join(links, later(1) == F.col("_i"), "left").select("id", "path", F.array_compact(F.array("_p", F.concat(F.lit("doc_"), later(2)), F.lit("nowhere"))).alias("links"))
    return resolve(linked)


def contrast_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, groups = terms_by_lang(_notes(spark, sf_dir))
    return keywords.contrast_keywords(tf, groups).select("group", F.col("rank").cast("long").alias("rank"), "stem", F.round("score", 9).alias("score"))


def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made from the documents' metadata, in every syntax by turns."""
    i, turn = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    target = F.concat_ws("/", "source", i)
    link = F.when(turn == 0, F.concat(F.lit("[["), target, F.lit("]]"))).when(turn == 1, F.concat(F.lit("![["), target, F.lit("#part|"), "lang", F.lit("]]"))).when(turn == 2, F.concat(F.lit("[["), target, F.lit("|"), F.lit("]]"))).otherwise(F.concat(F.lit("["), i, F.lit("]("), target, F.lit(")")))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.wikilink(link).alias("w"), T.gold_label(link).alias("gold"))
    return rows.select("doc_id", "w.embed", "w.target", "w.sub", "w.alias", "gold")


def proposals_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    placed = rows.where("id % 3 <> 0").select(F.col("id").alias("note_id"), (F.col("label") * 3 + F.col("id") % 2).alias("index_id"), F.lit(True).alias("is_primary"))
    return evaluate.proposals_score(placed, rows.select("id", "label")).select(F.round("coverage", 9).alias("coverage"), F.round("purity", 9).alias("purity"), F.round("nmi", 9).alias("nmi"))


def prepared_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.prepared_notes(_notes(spark, sf_dir), 1 << 30)
    return out.select("note_id", F.md5("text").alias("text_md5"), "body_chars")


QUERIES = {f.__name__: f for f in (cluster_sizes, sampled_notes, remaining_time, shown_members, live_members, merged_index_keywords, split_proposal, neighbour_lists, seeded_suggestions, label_bank_names, best_chunk_topics, collection_suggestions, resolved_links, contrast_keywords, link_parts, proposals_score, prepared_notes)}

_FIRST = """r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY index_id <> 'ix9' DESC, CASE WHEN note_id IN ('7', '8') THEN index_id = 'ix5' ELSE false END DESC, prim DESC, CASE WHEN prim THEN score END DESC NULLS LAST, index_id) AS k FROM k),
  eff AS (SELECT index_id, note_id, score, CASE WHEN index_id <> 'ix9' THEN k = 1 ELSE prim END AS is_primary, manual, index_id = 'ix9' AS ignored FROM r)"""

ORACLES = {
    "effective_primary": f"WITH {_EFFECTIVE}, {_FIRST} SELECT note_id, index_id, manual FROM eff WHERE is_primary AND NOT ignored",
    "shown_members": f"WITH {_EFFECTIVE}, {_FIRST}, s AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY is_primary DESC, score DESC, note_id) AS place FROM eff WHERE NOT ignored) SELECT index_id, place, note_id, is_primary FROM s WHERE place <= 20",
    "live_members": f"WITH {_EFFECTIVE} SELECT index_id, count(*) AS members FROM k WHERE note_id::BIGINT % 7 <> 0 GROUP BY index_id",
    "merged_index_keywords": """WITH p AS (SELECT DISTINCT label AS l, 'ix' || label AS id, CASE WHEN label IN (0, 1) THEN 'ix5' ELSE 'ix' || label END AS target FROM embeddings),
      w AS (SELECT target, id <> target AS merged, id, k, 'w' || (l + k * 2) % 11 AS word FROM p, range(6) t(k)), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY merged, id, k) AS pos FROM w),
      f AS (SELECT target, word, min(pos) AS pos FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS n FROM f)
      SELECT target AS id, string_agg(word, ',' ORDER BY pos) AS keywords FROM r WHERE n <= 10 GROUP BY target""",
    "split_proposal": """WITH m AS (SELECT label, vec_id FROM embeddings), p AS (SELECT DISTINCT 'ix' || label AS id, 'Topic ' || label AS name, '' AS split_from FROM m WHERE label <> 3),
      own AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'ix4-s' ELSE 'new' END AS id FROM m WHERE label = 3 AND vec_id % 5 <> 0),
      every AS (SELECT * FROM p UNION ALL SELECT DISTINCT id, CASE WHEN id = 'new' THEN 'Part 1' ELSE 'Part 0' END, 'ix3' FROM own),
      n AS (SELECT 'ix' || label AS id, count(*) AS k FROM m WHERE label <> 3 GROUP BY 1 UNION ALL SELECT id, count(*) FROM own GROUP BY 1)
      SELECT every.id, name, split_from, coalesce(k, 0) AS primaries, (SELECT count(*) FROM m WHERE label = 3 AND vec_id % 5 = 0) AS lost FROM every LEFT JOIN n ON n.id = every.id""",
    "cluster_sizes": "WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label) SELECT row_number() OVER (ORDER BY size DESC, label) AS place, size FROM s ORDER BY size DESC, label LIMIT 5",
    "sampled_notes": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, greatest(1, count(*) OVER () // 60) AS step FROM documents) SELECT doc_id FROM r WHERE n % step = 0 AND n < step * 60",
    "remaining_time": """WITH l AS (SELECT event_id, event_type AS stage, floor(epoch_us(ts) / 1000)::BIGINT AS at_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events),
      b AS (SELECT stage, min(at_ms) AS base FROM l WHERE done = 1 GROUP BY stage), r AS (SELECT *, at_ms - base AS elapsed FROM l JOIN b USING (stage))
      SELECT event_id, round(CASE WHEN elapsed >= 15000 AND done > 1 AND total > done THEN (total - done) * elapsed / (done - 1) END, 3) AS remaining_ms FROM r""",
    "neighbour_lists": f"WITH {_V}, {_knn(5)} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS ids FROM knn GROUP BY src",
    "seeded_suggestions": f"""WITH every AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::BIGINT AS label FROM embeddings), v AS (SELECT * FROM every WHERE id % 10 <> 0), {_CELLS}, {_CENTRES},
      s AS (SELECT id, centres.label AS l, list_inner_product(x, c) AS s FROM every, centres WHERE id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, l DESC) AS k FROM s)
      SELECT id, max(CASE WHEN k = 1 THEN l END) AS best, max(CASE WHEN k = 2 THEN l END) AS second, round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6) AS margin FROM r GROUP BY id""",
    "label_bank_names": f"""WITH {_V}, {_CELLS}, {_CENTRES}, s AS (SELECT centres.label AS "index", 'b' || id AS label, list_inner_product(x, c) AS score FROM v, centres WHERE id < 40),
      r AS (SELECT *, row_number() OVER (PARTITION BY "index" ORDER BY score DESC, label) AS rank FROM s), m AS (SELECT "index", max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS margin FROM r GROUP BY 1)
      SELECT "index", rank, label, round(score, 6) AS score, round(margin, 6) AS margin FROM r JOIN m USING ("index") WHERE rank <= 3""",
    "best_chunk_topics": f"""WITH {_V}, {_CELLS}, {_CENTRES}, s AS (SELECT id // 4 AS note_id, id % 4 AS chunk_no, centres.label AS "index", list_inner_product(x, c) AS score FROM v, centres),
      r AS (SELECT *, row_number() OVER (PARTITION BY note_id, "index" ORDER BY score DESC, chunk_no) AS k FROM s) SELECT note_id, "index", round(score, 6) AS score, chunk_no FROM r WHERE k = 1""",
    "collection_suggestions": f"""WITH {_NOTES}, {_TAGGED}, s AS (SELECT id AS note_id, '#' || lower(unnest(tags)) AS signature FROM tagged UNION SELECT id, 'folder: ' || regexp_extract(path, '^(.*)/[^/]*$', 1) FROM tagged)
      SELECT note_id, index_id, 1.0::DOUBLE AS score, 'collection' AS via FROM s JOIN (VALUES ('c1', '#fr'), ('c2', '#quality/1'), ('c3', 'folder: src1/en')) c(index_id, signature) USING (signature)""",
    "resolved_links": """WITH n AS (SELECT doc_id, concat_ws('/', source, lang, 'doc_' || doc_id || '.md') AS path FROM documents)
      SELECT a.doc_id::VARCHAR AS src, b.doc_id::VARCHAR AS dst FROM n a JOIN n b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2)""",
    "contrast_keywords": f"""WITH {_NOTES}, {_TOKENS}, {_TF}, inside AS (SELECT lang, stem, sum(tf) AS tf FROM tf JOIN notes ON id = note_id WHERE length(stem) >= 4 GROUP BY 1, 2), len AS (SELECT lang, sum(tf) AS length FROM inside GROUP BY 1),
      every AS (SELECT stem, sum(tf) AS whole FROM inside GROUP BY 1), s AS (SELECT lang, stem, tf / length * ln(1 + (SELECT avg(length) FROM len) / whole) AS score FROM inside JOIN len USING (lang) JOIN every USING (stem)),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, stem) AS rank FROM s) SELECT lang AS "group", rank, stem, round(score, 9) AS score FROM r WHERE rank <= 8""",
    "link_parts": """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 = 1 END AS embed, CASE WHEN doc_id % 4 < 3 THEN source || '/' || doc_id END AS target, CASE WHEN doc_id % 4 = 1 THEN '#part' WHEN doc_id % 4 < 3 THEN '' END AS sub,
      CASE WHEN doc_id % 4 = 1 THEN lang END AS alias, CASE WHEN doc_id % 4 < 3 THEN doc_id::VARCHAR END AS gold FROM documents""",
    "prepared_notes": f"WITH {_NOTES}, {_LINES}, {_BODIES} SELECT id AS note_id, md5(title || chr(10) || coalesce(array_to_string(body, chr(10)), '')) AS text_md5, length(coalesce(array_to_string(body, chr(10)), ''))::BIGINT AS body_chars FROM bodies",
    "proposals_score": f"""WITH {_V}, c AS (SELECT label, label * 3 + id % 2 AS cluster FROM v WHERE id % 3 <> 0), {_nmi('c', 'n1')}, b AS (SELECT cluster, max(n) AS top FROM (SELECT label, cluster, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
      SELECT round((SELECT count(*) FROM c) / (SELECT count(*) FROM v), 9) AS coverage, round((SELECT sum(top) FROM b) / (SELECT count(*) FROM c), 9) AS purity, (SELECT round(v, 9) FROM n1) AS nmi""",
}
