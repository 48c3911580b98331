"""The corpus pipeline: language ID, line dedup, near-duplicate groups, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs.  All stages but the last return the columns of documents, whatever their names
besides doc_id, text, lang and n_chars.  A stage's scratch tables are deleted when the next one begins.

Defined cases, stage by stage; each operator's module states the rest.  Empty tables give empty tables.
language_id: null, empty and letterless texts are rejected and go; rows of null doc_id or lang are judged but not
learnt from; without anything to learn from all go.  line_dedup: null texts stay null; rows of one doc_id are one
document.  near_dedup: rows of null doc_id and texts without words stay; rows that share a kept doc_id all stay.
decontaminate: null texts stay; an empty benchmark removes nothing.  bpe: null is empty; a row for every row.
Very long texts are worked on whole by every stage; ties are settled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from corpusloom.llm.common import bound_batches, delete, fresh, id_remainder, new_path, owned, table

OWNER = "pipeline"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that are rejected go."""
    bound_batches(spark)
    with owned(spark, OWNER):
        learn = F.coalesce(id_remainder(docs["doc_id"], 5) != 0, F.lit(False))
        return language_id.filter_rejected(docs, language_id.fit(docs, learn))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kept text, and n_chars of that."""
    bound_batches(spark)
    with owned(spark, OWNER):
        return line_dedup.replace_text(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    bound_batches(spark)
    with owned(spark, OWNER):
        groups = near_dedup.near_duplicates(docs)
        gone_id = fresh(docs, "_gone")[0]
        gone = groups.where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
        return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bound_batches(spark)
    with owned(spark, OWNER):
        return decontaminate.filter_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    bound_batches(spark)
    with owned(spark, OWNER):
        out = bpe.encode_bpe(docs, bpe.default_tokenizer())
        return out.select("doc_id", "n_tokens", F.sha2(F.col("token_ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

#: Near-duplicate candidates, the language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written result of the one before, which then goes.

    The last result stays, since the returned DataFrame reads it, until the next run.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    with owned(spark, f"{OWNER}-run"):
        for name, stage in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                delete(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
