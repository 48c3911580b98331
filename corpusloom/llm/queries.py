"""The registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, hilbert_shards, language_id, line_dedup, lm_score, media, near_dedup, pii, warc
from corpusloom.llm.common import id_remainder, table

#: SQL for the stripped and lower-cased form of a line.
_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", "kind", "outcome", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.col("status").cast("long").alias("status"), F.sha2(warc.header_lines(F.col("headers")), 256).alias("headers_sha256"), "payload_digest")


OP1_SQL = """
WITH pages2 AS (SELECT page_id AS p, url, coalesce(html, '') AS html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id // 1440) AS dated FROM pages),
records AS (
  SELECT p * 2 AS record_id, url, p * 60 AS ts, 'response' AS kind, 200 AS status, tag AS etag, dated AS last_modified, strlen(html) AS size, tag, p, sha256(html) AS digest FROM pages2
  UNION ALL
  SELECT p * 2 + 1, url || '#again', (p + 500) * 60, 'revisit', 304, CASE WHEN p % 10 = 3 THEN 'W/"other"' WHEN p % 10 IN (7, 9) THEN NULL ELSE 'W/' || tag END,
         CASE WHEN p % 10 = 9 THEN NULL ELSE dated END, 0, tag, p, NULL FROM pages2),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
          regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
          list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS q FROM bare),
keyed AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM parts),
paired AS (
  SELECT r.*, f.record_id AS was_id, f.tag AS was_tag, f.last_modified AS was_date, f.size AS was_size, f.digest AS was_digest,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS nth
  FROM keyed r LEFT JOIN keyed f ON r.kind = 'revisit' AND f.kind = 'response' AND f.url_key = r.url_key AND f.ts < r.ts),
judged AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN was_id IS NULL THEN 'orphan'
           WHEN coalesce(regexp_replace(etag, '^W/', '') = was_tag, last_modified = was_date) IS NULL THEN 'unverified'
           WHEN coalesce(regexp_replace(etag, '^W/', '') = was_tag, last_modified = was_date) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM paired WHERE nth = 1)
SELECT record_id, url_key, kind, outcome, CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN was_id ELSE -1 END AS source_id,
       CASE WHEN outcome = 'resolved' THEN 200 ELSE status END::BIGINT AS status,
       sha256(CASE WHEN outcome = 'full' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag
                   WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || was_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || was_tag
                   ELSE 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END) AS headers_sha256,
       CASE outcome WHEN 'full' THEN digest WHEN 'resolved' THEN was_digest END AS payload_digest
FROM judged
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT d.doc_id, pos, line, h.k IS NOT NULL AND d.doc_id IS DISTINCT FROM h.keeper AS gone FROM keyed d LEFT JOIN hot h ON d.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
shingles AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder(docs["doc_id"], 5) == 0, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(id_remainder(out["doc_id"], 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), masked=False).drop("masked")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    words = F.array_max(F.transform("passages", lambda p: p["words"]))
    first = F.get(F.filter("passages", lambda p: p["words"] == words), F.lit(0))
    longest = [first[c].alias(f"longest_{c}") for c in ("words", "item", "item_at", "at")]
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *longest)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"), media=False)
    feature = F.array_join(F.transform(F.arrays_zip("fp_times", "fp_codes"), lambda p: F.concat_ws(":", p["fp_times"], F.lower(F.hex(p["fp_codes"])))), ",")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = id_remainder(docs["doc_id"], 10)
    return lm_score.score_documents(docs, F.coalesce(rest != 0, F.lit(False)), F.coalesce(rest == 0, F.lit(False)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_bpe(table(spark, sf_dir, "documents"), bpe.default_tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2(F.col("token_ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_decontaminate": op6_decontaminate,
    "op7_media": op7_media,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_lm_score": op9_lm_score,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_near_dedup": OP3_SQL}
