"""Vector, graph, clustering and classification queries and their SQL twins, over the embeddings table.

Labels stand in for communities and tags, ranges of vec_id for folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import classify, cluster, evaluate, graph, vectors
from corpusloom.operators.ranks import share_below, value_at
from corpusloom.sources.notes import table
from corpusloom.sources.scratch import materialize

K = 15


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def _neighbours(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return materialize(vectors.knn(rows, k).select("src", "rank", "dst", F.round("score", 6).alias("score")), "knn")


def _members(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("label").alias("community"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"))


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_vector(_vectors(spark, sf_dir)).select(F.posexplode("mean").alias("pos", "value")).select(F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


def centered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.center(_vectors(spark, sf_dir))
    return rows.select("id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.centroids(_vectors(spark, sf_dir), "label")
    return rows.select("label", "size", F.posexplode("centroid").alias("pos", "value")).select("label", "size", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query, against all rows."""
    rows = _vectors(spark, sf_dir)
    return vectors.knn_exact(rows.where("id % 50 = 0"), rows, K).select("src", F.col("rank").cast("long").alias("rank"), "dst", F.round("score", 6).alias("score"))


def knn_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query set without a broadcast, by pairs of row groups."""
    rows = _vectors(spark, sf_dir)
    return vectors.knn_blocks(rows.where("id % 50 = 0"), rows, K, 3).select("src", F.col("rank").cast("long").alias("rank"), "dst", F.round("score", 6).alias("score"))


def knn_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the cell index, every row indexed, against the exact neighbours of the query set."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0")
    return vectors.recall(vectors.knn_exact(asked, rows, 10), vectors.knn_cells(asked, rows, 10))


def hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.hubness(_neighbours(spark, sf_dir, 5), _vectors(spark, sf_dir))
    return out.select(F.round("label_agreement", 9).alias("label_agreement"), F.col("max_in_degree"), F.round("top_share", 9).alias("top_share"), "zero_in_degree")


def seeded_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.seeded_accuracy(_vectors(spark, sf_dir)).select("rows", F.round("top1", 9).alias("top1"), F.round("top3", 9).alias("top3"))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir)
    return spark.createDataFrame([(q, value_at(near, "score", q)) for q in (0.05, 0.95)], "share double, score double")


def _features(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.array(F.concat(F.lit("t"), F.col("label"))).alias("tags"), F.array(F.concat(F.lit("k"), F.col("id") % 7), F.concat(F.lit("k"), F.col("id") % 11)).alias("keywords"), (F.expr("id div 50")).cast("string").alias("folder"))


def hybrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    links = rows.where("id % 9 = 0").select(F.col("id").alias("src"), F.expr("id div 3").alias("dst"))
    out = graph.hybrid_edges(_neighbours(spark, sf_dir), _features(rows), links, rows)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("weight", 5).alias("weight"))


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.semantic_graph(_neighbours(spark, sf_dir))
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("weight", 6).alias("weight"))


def _mutual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = _neighbours(spark, sf_dir, 3).select("src", "dst")
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), _vectors(spark, sf_dir).select("id")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*_mutual(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(graph.semantic_graph(_neighbours(spark, sf_dir)).select("a", "b", "weight"), "edges")


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.renumber(cluster.louvain(_edges(spark, sf_dir), _vectors(spark, sf_dir).select("id")))


def refined_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.lit(True).alias("included"))
    return cluster.cluster_notes(_edges(spark, sf_dir), rows)


def community_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    out = graph.centrality(graph.semantic_graph(_neighbours(spark, sf_dir)).select("a", "b", "weight"), _members(rows))
    return out.select("id", F.round("centrality", 5).alias("centrality"))


def partition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    sign = lambda k: (F.get("vector", F.lit(k)) > 0).cast("int")
    pairs = rows.select("label", F.when(F.col("id") % 10 == 0, -1).otherwise(sign(0) * 4 + sign(1) * 2 + sign(2)).alias("cluster"))
    out = evaluate.partition_score(pairs)
    return out.select("clusters", "clusters_of_3", *[F.round(c, 9).alias(c) for c in ("largest_share", "noise_share", "nmi", "nmi_clustered", "purity")])


def member_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    scored = classify.with_similarity(rows, _members(rows)).select("id", "community", F.round("similarity", 9).alias("similarity"))
    ranked = share_below(scored, "similarity", "rank")
    agree = classify.agreement(_neighbours(spark, sf_dir), _members(rows))
    out = ranked.join(agree, "id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    return out.select("id", "community", F.round("rank", 6).alias("rank"), F.round("agreement", 6).alias("agreement"), F.round(0.5 * F.col("rank") + 0.5 * F.col("agreement"), 6).alias("confidence"))


def note_index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    out = classify.index_scores(rows, rows.select("id", F.col("label").alias("index")))
    return out.select("id", "index", F.round("similarity", 6).alias("similarity"), F.round("fit", 6).alias("fit"))


def topic_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole classifier over label communities."""
    rows = _vectors(spark, sf_dir)
    found, _, _ = classify.classify(rows, _members(rows), _neighbours(spark, sf_dir))
    return found.select("id", "index", F.round("score", 6).alias("score"), "is_primary", "via")


def related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.proposals import related_pairs

    centres = vectors.centroids(_vectors(spark, sf_dir), "label").select(F.col("label").alias("id"), "centroid")
    return related_pairs(centres).select("a", "b", F.round("similarity", 6).alias("similarity"))


def incremental_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id ends in 0 are new: they are scored against the label centres of all others."""
    from corpusloom.streaming.incremental import score_topics

    rows = _vectors(spark, sf_dir)
    known, new = rows.where("id % 10 <> 0"), rows.where("id % 10 = 0")
    out = score_topics(new, known.select("id", "vector", F.col("label").alias("index_id")), limit=3)
    return out.select("note_id", F.col("rank").cast("long").alias("rank"), "index_id", F.round("score", 3).alias("score"))


def significant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose first values were changed by rule, against what they were."""
    from corpusloom.streaming.incremental import significant_change

    rows = _vectors(spark, sf_dir)
    moved = F.transform(V.as_double(F.col("vector")), lambda x, k: F.when(k < F.col("id") % 4, -x).otherwise(x))
    return rows.select("id", significant_change(F.col("vector"), moved).alias("changed"))


def cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.sources.stores import cache_delta as delta

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    cached = docs.where("note_id % 5 <> 1").select(F.when(F.col("note_id") % 5 == 4, -1 - F.col("note_id")).otherwise(F.col("note_id")).alias("note_id"), F.when(F.col("note_id") % 5 == 2, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return delta(docs, cached)


QUERIES = {f.__name__: f for f in (vector_norms, mean_vector, centered_vectors, label_centroids, knn_exact, knn_block, knn_ivf_recall, hubness, seeded_loo, score_quantiles, hybrid_edges, semantic_edges, connected_components, louvain_communities, refined_communities, community_centrality, partition_quality, member_confidence, note_index_scores, topic_memberships, related_topics, incremental_suggestions, significant_changes, cache_delta)}

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::BIGINT AS label FROM embeddings)"
_CELLS = "cells AS (SELECT id, label, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS value FROM v)"
_CENTRES = "raw AS (SELECT label, pos, avg(value) AS value FROM cells GROUP BY label, pos), length AS (SELECT label, sqrt(sum(value * value)) AS n FROM raw GROUP BY label), centres AS (SELECT label, list(value / n ORDER BY pos) AS c FROM raw JOIN length USING (label) GROUP BY label)"
_DOT = "list_inner_product({}, {})"


def _knn(k: int, only: str = "true") -> str:
    return f"pairs AS (SELECT a.id AS src, b.id AS dst, list_inner_product(a.x, b.x) AS score FROM v a JOIN v b ON a.id <> b.id WHERE {only}), knn AS (SELECT src, rank, dst, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM pairs) WHERE rank <= {k})"


_NEAR = "near AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(score) AS similarity FROM knn GROUP BY 1, 2)"
_SEMANTIC = "semantic AS (SELECT a, b, similarity, greatest(1e-6, (similarity - f) / (1 - f)) AS weight FROM near, (SELECT min(score) AS f FROM knn))"


def _nmi(source: str, name: str) -> str:
    return f"""{name}_j AS (SELECT label, cluster, count(*) AS n FROM {source} GROUP BY 1, 2), {name}_t AS (SELECT sum(n) AS t FROM {name}_j),
      {name}_a AS (SELECT label, sum(n) AS na FROM {name}_j GROUP BY 1), {name}_b AS (SELECT cluster, sum(n) AS nb FROM {name}_j GROUP BY 1),
      {name} AS (SELECT 2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM {name}_j JOIN {name}_a USING (label) JOIN {name}_b USING (cluster), {name}_t)
        / ((SELECT sum(-na / t * ln(na / t)) FROM {name}_a, {name}_t) + (SELECT sum(-nb / t * ln(nb / t)) FROM {name}_b, {name}_t)) AS v)"""


ORACLES = {
    "vector_norms": f"WITH {_V} SELECT id, round(sqrt(list_inner_product(x, x)), 6) AS norm FROM v",
    "mean_vector": f"WITH {_V}, {_CELLS} SELECT pos, round(avg(value), 9) AS value FROM cells GROUP BY pos",
    "centered_vectors": f"""WITH {_V}, {_CELLS}, m AS (SELECT pos, avg(value) AS mean FROM cells GROUP BY pos), d AS (SELECT id, pos, value - mean AS value FROM cells JOIN m USING (pos)),
      l AS (SELECT id, sqrt(sum(value * value)) AS n, max(CASE WHEN pos = 0 THEN value END) AS f FROM d GROUP BY id) SELECT id, round(f / n, 6) AS "first", 1.0::DOUBLE AS norm FROM l""",
    "label_centroids": f"WITH {_V}, {_CELLS}, {_CENTRES} SELECT label, size, pos, round(value / n, 6) AS value FROM raw JOIN length USING (label) JOIN (SELECT label, count(*) AS size FROM v GROUP BY label) USING (label)",
    "knn_exact": f"WITH {_V}, {_knn(K, 'a.id % 50 = 0')} SELECT * FROM knn",
    "knn_block": f"WITH {_V}, {_knn(K, 'a.id % 50 = 0')} SELECT * FROM knn",
    "hubness": f"""WITH {_V}, {_knn(5)}, deg AS (SELECT id, count(dst) AS d FROM v LEFT JOIN knn ON dst = id GROUP BY id), top AS (SELECT sum(d) AS t FROM (SELECT d, row_number() OVER (ORDER BY d DESC, id) AS r FROM deg) WHERE r <= greatest(1, ceil((SELECT count(*) FROM v) / 100)))
      SELECT (SELECT round(avg((a.label = b.label)::INT), 9) FROM knn JOIN v a ON a.id = src JOIN v b ON b.id = dst) AS label_agreement, (SELECT max(d) FROM deg) AS max_in_degree,
             round((SELECT t FROM top) / (SELECT sum(d) FROM deg), 9) AS top_share, (SELECT count(*) FROM deg WHERE d = 0) AS zero_in_degree""",
    "seeded_loo": f"""WITH {_V}, {_CELLS}, sums AS (SELECT label, pos, sum(value) AS s FROM cells GROUP BY 1, 2),
      p AS (SELECT c.id, c.label, s.label AS other, sum(c.value * (s.s - CASE WHEN c.label = s.label THEN c.value ELSE 0 END)) / sqrt(sum((s.s - CASE WHEN c.label = s.label THEN c.value ELSE 0 END) ** 2)) AS score FROM cells c JOIN sums s USING (pos) GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, other) AS rank FROM p), e AS (SELECT id, max((label = other AND rank = 1)::INT) AS one, max((label = other AND rank <= 3)::INT) AS three FROM r GROUP BY id)
      SELECT count(*) AS rows, round(avg(one), 9) AS top1, round(avg(three), 9) AS top3 FROM e""",
    "score_quantiles": f"WITH {_V}, {_knn(K)}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM knn) SELECT q AS share, score FROM r, (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) t(q) WHERE i = floor(q * n)",
    "semantic_edges": f"WITH {_V}, {_knn(K)}, {_NEAR}, {_SEMANTIC} SELECT a, b, round(similarity, 6) AS similarity, round(weight, 6) AS weight FROM semantic",
    "hybrid_edges": f"""WITH {_V}, {_knn(K)}, {_NEAR}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM knn),
      q AS (SELECT max(CASE WHEN i = floor(0.05 * n) THEN score END) AS lo, max(CASE WHEN i = floor(0.95 * n) THEN score END) AS hi FROM r),
      link AS (SELECT DISTINCT id // 3 AS a, id AS b FROM v WHERE id % 9 = 0 AND id <> 0),
      every AS (SELECT n.a, n.b, similarity, l.a IS NOT NULL AS linked FROM near n LEFT JOIN link l ON l.a = n.a AND l.b = n.b
        UNION ALL SELECT l.a, l.b, list_inner_product(x.x, y.x), true FROM link l JOIN v x ON x.id = l.a JOIN v y ON y.id = l.b WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.a = l.a AND n.b = l.b)),
      f AS (SELECT id, label, list_distinct(['k' || id % 7, 'k' || id % 11]) AS k, id // 50 AS folder FROM v)
      SELECT a, b, round(similarity, 6) AS similarity, round(greatest(1e-6, 0.7 * greatest(0, least(1, (similarity - lo) / (hi - lo))) + 0.15 * linked::INT + 0.08 * (x.label = y.label)::INT
             + 0.05 * len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))) + 0.02 * (x.folder = y.folder)::INT), 5) AS weight
      FROM every JOIN f x ON x.id = a JOIN f y ON y.id = b, q""",
    "connected_components": f"""WITH RECURSIVE {_V}, {_knn(3)}, e AS (SELECT k.src AS a, k.dst AS b FROM knn k JOIN knn j ON k.src = j.dst AND k.dst = j.src),
      reach(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a) SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "community_centrality": f"""WITH {_V}, {_knn(K)}, {_NEAR}, {_SEMANTIC}, inside AS (SELECT a, b, weight FROM semantic JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE x.label = y.label),
      ends AS (SELECT a AS id, weight FROM inside UNION ALL SELECT b, weight FROM inside) SELECT v.id, round(coalesce(sum(weight), 0), 5) AS centrality FROM v LEFT JOIN ends ON ends.id = v.id GROUP BY v.id""",
    "partition_quality": f"""WITH {_V}, p AS (SELECT label, CASE WHEN id % 10 = 0 THEN -1 ELSE (x[1] > 0)::INT * 4 + (x[2] > 0)::INT * 2 + (x[3] > 0)::INT END AS cluster FROM v), c AS (SELECT * FROM p WHERE cluster >= 0),
      {_nmi('p', 'n1')}, {_nmi('c', 'n2')}, s AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), b AS (SELECT cluster, max(n) AS top FROM (SELECT label, cluster, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
      SELECT (SELECT count(*) FROM s) AS clusters, (SELECT count(*) FROM s WHERE n >= 3) AS clusters_of_3, round((SELECT max(n) FROM s) / (SELECT count(*) FROM p), 9) AS largest_share,
             round((SELECT count(*) FROM p WHERE cluster < 0) / (SELECT count(*) FROM p), 9) AS noise_share, (SELECT round(v, 9) FROM n1) AS nmi, (SELECT round(v, 9) FROM n2) AS nmi_clustered,
             round((SELECT sum(top) FROM b) / (SELECT count(*) FROM c), 9) AS purity""",
    "member_confidence": f"""WITH {_V}, {_CELLS}, {_CENTRES}, {_knn(K)}, s AS (SELECT id, v.label AS community, round(list_inner_product(x, c), 9) AS similarity FROM v JOIN centres USING (label)),
      r AS (SELECT *, (rank() OVER (ORDER BY similarity) - 1) / count(*) OVER () AS rank FROM s),
      g AS (SELECT src, avg((a.label = b.label)::INT) AS agreement FROM knn JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE rank <= 10 GROUP BY src)
      SELECT id, community, round(rank, 6) AS rank, round(coalesce(agreement, 0), 6) AS agreement, round(0.5 * rank + 0.5 * coalesce(agreement, 0), 6) AS confidence FROM r LEFT JOIN g ON src = id""",
    "note_index_scores": f"""WITH {_V}, {_CELLS}, {_CENTRES}, s AS (SELECT id, v.label AS own, centres.label AS "index", round(list_inner_product(x, c), 9) AS similarity FROM v, centres),
      m AS (SELECT "index", list(similarity) AS ms FROM s WHERE own = "index" GROUP BY "index")
      SELECT id, "index", round(similarity, 6) AS similarity, round(len(list_filter(ms, lambda y: y < similarity)) / len(ms), 6) AS fit FROM s JOIN m USING ("index")""",
    "related_topics": f"""WITH {_V}, {_CELLS}, {_CENTRES}, p AS (SELECT a.label AS a, b.label AS b, list_inner_product(a.c, b.c) AS s FROM centres a JOIN centres b ON a.label <> b.label),
      cut AS (SELECT s AS c FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM p WHERE a < b) WHERE i = floor(0.9 * (n - 1))),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p, cut WHERE s >= c AND s > 0) WHERE r <= 3)
      SELECT t.a, t.b, round(t.s, 6) AS similarity FROM t JOIN t u ON t.a = u.b AND t.b = u.a""",
    "incremental_suggestions": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::BIGINT AS label FROM embeddings), k AS (SELECT * FROM v WHERE id % 10 <> 0),
      cells AS (SELECT id, label, generate_subscripts(x, 1) AS pos, unnest(x) AS value FROM k), raw AS (SELECT label, pos, sum(value) AS value FROM cells GROUP BY 1, 2), length AS (SELECT label, sqrt(sum(value * value)) AS n FROM raw GROUP BY 1),
      centres AS (SELECT label, list(value / n ORDER BY pos) AS c FROM raw JOIN length USING (label) GROUP BY 1), m AS (SELECT k.label, list(round(list_inner_product(x, c), 9)) AS ms FROM k JOIN centres USING (label) GROUP BY 1),
      s AS (SELECT id AS note_id, centres.label AS index_id, len(list_filter(ms, lambda y: y < round(list_inner_product(x, c), 9))) / len(ms) AS score FROM v, centres JOIN m USING (label) WHERE id % 10 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, index_id) AS rank FROM s WHERE score >= 0.1) SELECT note_id, rank, index_id, round(score, 3) AS score FROM r WHERE rank <= 3""",
    "significant_changes": f"WITH {_V}, c AS (SELECT id, sum(value * value) AS n, sum(CASE WHEN pos < id % 4 THEN -value * value ELSE value * value END) AS d FROM (SELECT id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS value FROM v) GROUP BY id) SELECT id, d / n < 0.97 AS changed FROM c",
    "cache_delta": """WITH d AS (SELECT doc_id AS note_id, md5(coalesce(text, '')) AS h FROM documents), c AS (SELECT CASE WHEN note_id % 5 = 4 THEN -1 - note_id ELSE note_id END AS note_id, CASE WHEN note_id % 5 = 2 THEN 'old' ELSE h END AS h FROM d WHERE note_id % 5 <> 1)
      SELECT coalesce(d.note_id, c.note_id) AS note_id, CASE WHEN d.note_id IS NULL THEN 'remove' WHEN d.h IS NOT DISTINCT FROM c.h THEN 'hit' ELSE 'upsert' END AS action FROM d FULL JOIN c ON d.note_id = c.note_id""",
}
