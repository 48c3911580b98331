"""Text cleaning, chunking and file edits."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunking, files
from corpusloom.functions import text as T
from corpusloom.plans.config import Settings, confidence_for_threshold, resolution_for_detail

NOTE = """---
type: x
---
# Kafka
Some [[Target|alias]] and [[Plain#part]] with ![[embed]] ![i](u) [text](http://a.b/c_(d)) http://x.y/z
%% hidden
more %% <!-- gone --> `code` <b>bold</b> #tag/sub word
key:: value
> [!note] Callout text
---
| a | b |
|---|---|
```py
# not a heading
```
a ** b
"""
CLEAN = ["Kafka", "Some alias and Plain with text", "bold word", "Callout text", "a b", "a b"]


def test_clean_lines(spark):
    row = spark.createDataFrame([(NOTE,)], "t string").select(T.clean_lines(F.col("t")).alias("l")).first()
    assert row.l == CLEAN
    assert chunking.clean_lines(NOTE) == CLEAN
    assert chunking.clean_lines(NOTE.replace("\n", "\r\n")) == CLEAN


def test_tokens_stems_names(spark):
    row = spark.range(1).select(
        T.tokenize(F.lit("Ёлка и ПЛАНИРОВАНИЕ API-2 the 3d about Kafka")).alias("t"), T.stem(F.lit("планирование")).alias("s"), T.acronyms(F.lit("ВВП Api API")).alias("a"),
        T.is_generic_name(F.lit("Notes")).alias("g1"), T.is_generic_name(F.lit("Kafka")).alias("g2"), T.is_generic_name(F.lit("scan-2026-09")).alias("g3"),
        T.tag_label(F.lit("area/deep_work")).alias("l"), T.index_file_name(F.lit(' a/b: "c"?  ... ')).alias("f"), T.index_file_name(F.lit("***")).alias("u"),
        T.content_hash(F.lit("abc")).alias("h"), T.folder_of(F.lit("a/b/c.md")).alias("d"), T.wikilink(F.lit("![[a#b|c]]")).alias("w"), T.wikilink(F.lit("[a](b)")).isNull().alias("n"),
    ).first()
    assert row.t == ["елка", "планирование", "api-2", "kafka"] and row.s == "планир" and row.a == ["ввп", "api"]
    assert (row.g1, row.g2, row.g3) == (True, False, True)
    assert (row.l, row.f, row.u, row.d) == ("Deep work", "a b c", "Untitled index", "a/b")
    assert row.h == "1a47e90b9a8086f6" and row.w.target == "a" and row.w.alias == "c" and row.w.embed and row.n


def test_content_hash_of_no_text(spark, tmp_path):
    import duckdb

    from corpusloom.plans import catalogue_text

    rows = [(1, None), (2, ""), (3, "abc"), (4, "\x00é𝄞e\u0301\r\n"), (5, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalogue_text.content_hash(spark, str(tmp_path)).collect()))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(base.sql(catalogue_text.ORACLES["content_hash"]).fetchall())
    assert got[0] == (1, "811c9dc55ad1e806") and got[1] != got[0]


def test_terms_are_counted_without_a_shuffle(spark, tmp_path):
    from corpusloom.operators import keywords

    texts = [("1", "Kafka streams kafka planning planned", "en"), ("2", None, "en"), ("3", "", None), ("4", "the the", "de"), ("5", "kafka Планирование планируем", "de"), ("6", "streams planning", "en")]
    n = spark.createDataFrame([(i, t, [g]) for i, t, g in texts], "id string, content string, tags array<string>")
    want = keywords.term_frequencies(keywords.tokens(n))
    got = keywords.note_terms(n, group=F.get("tags", F.lit(0)))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.note_id, r.stem, r.tf) for r in got.collect()) == sorted((r.note_id, r.stem, r.tf) for r in want.collect())
    assert {r.note_id: r.length for r in got.collect()} == {"1": 5, "5": 3, "6": 2}
    groups = n.select(F.col("id").alias("note_id"), F.get("tags", F.lit(0)).alias("group"))
    for f in (lambda tf: keywords.note_keywords(tf.drop("group"), 6), lambda tf: keywords.group_keywords(tf, groups, 6), lambda tf: keywords.contrast_keywords(tf, groups)):
        assert sorted(map(tuple, f(got).collect())) == sorted(map(tuple, f(want).collect()))
    assert keywords.one_row_each(n) and not keywords.one_row_each(n.union(n))


def test_frequent_stems_meet_a_broadcast(spark, monkeypatch):
    from corpusloom.operators import keywords

    notes = spark.range(60).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("mod"), F.col("id") % 3), F.concat(F.lit("few"), F.expr("id div 2")), F.concat(F.lit("one"), F.col("id"))).alias("content"))
    tf, found = keywords.note_terms(notes), []
    for share in (0.0, 0.1, 2.0):  # all frequent, some, none
        monkeypatch.setattr(keywords, "OFTEN", share)
        found.append(sorted(map(tuple, keywords.note_keywords(tf, 60).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 120


def test_title_phrases(spark):
    found = spark.range(1).select(T.title_phrases(F.lit("Apache Kafka the_streams")).alias("p")).first().p
    assert [(p.key, p.is_pair, p.at_start) for p in found] == [("apache", False, True), ("apache kafka", True, True), ("kafka", False, False), ("stream", False, False)]


def test_chunks_follow_headings():
    body = "x" * 280 + ". "
    content = "intro\n# One\n" + (body * 4 + "\n") + "## Sub\n" + (body * 4 + "\n") + "# Two\n```\n# fenced\n```\n" + body * 3
    got = chunking.chunk_note(content, "T")
    assert [c["heading"] for c in got] == ["One", "One › Sub", "Two"]
    assert got[1]["text"].startswith("Document: T\nSection: One › Sub\n\n") and content[got[2]["start"] :].startswith("# Two")
    assert chunking.chunk_note("short", "T") == []
    many = "".join(f"# h{k}\n{'y' * 400}\n" for k in range(60))
    assert len(chunking.chunk_note(many, "T")) == 20
    long = chunking.chunk_note("z" * 5000, "T")
    assert [len(c["content"]) for c in long] == [1500, 1500, 1500, 500]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab: -#\n\r\"'", max_size=60), st.booleans())
def test_keys_come_and_go_without_a_trace(body, marked):
    text = ("﻿" if marked else "") + "---\ntitle: a # c\nlist:\n  - x\n---\n" + body
    changed = files.set_keys(text, {"zk-type": "note", "zk-indexes": ["[[A]]", 'q"\\']})
    assert 'zk-type: note\nzk-indexes:\n  - "[[A]]"\n' in changed
    assert files.set_keys(changed, {"zk-type": None, "zk-indexes": None}) == text
    again = files.restore_key(files.set_keys(changed, {"zk-type": "index"}), "zk-type", files.read_key(changed, "zk-type"))
    assert files.read_key(again, "zk-type") == ["zk-type: note"]


def test_front_matter_edges():
    assert files.set_keys("body", {"zk-type": "note"}) == "---\nzk-type: note\n---\nbody"
    assert files.set_keys("---\nzk-type: note\n---\nbody", {"zk-type": None}) == "body"
    assert files.set_keys("---\n---\nb", {"zk-version": 1}) == "---\nzk-version: 1\n---\nb"
    crlf = "---\r\na: 1\r\n---\r\nb"
    assert files.set_keys(crlf, {"zk-generated": True}) == "---\r\na: 1\r\nzk-generated: true\r\n---\r\nb"
    assert files.set_keys("---\nzk-types: 1\n---\n", {"zk-type": "x y"}) == '---\nzk-types: 1\nzk-type: "x y"\n---\n'


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\n", "a\n\nb\n"])
def test_sections(text):
    once = files.set_section(text, "x\ny")
    assert files.read_section(once).replace("\r\n", "\n") == "x\ny" and files.set_section(once, "x\ny") == once
    assert files.set_section(files.set_section(once, "z"), None).rstrip("\r\n") == text.rstrip("\r\n")


def test_links_are_rewritten():
    assert files.rewrite_links("[[Old]] ![[Old#s]] [[Old|seen]] [[Older]]", "Old", "dir/New") == "[[dir/New|New]] ![[dir/New#s|New]] [[dir/New|seen]] [[Older]]"


def test_settings_are_repaired():
    s = Settings.from_raw({"debounce_ms": 1, "detail": 99.4, "top_k": "x", "excluded_tags": [" a ", "", 3, "a"], "weights": {"links": 7, "tags": "x"}, "move_notes": 1})
    assert (s.debounce_ms, s.detail, s.top_k, s.excluded_tags, s.weights.links, s.weights.tags, s.move_notes) == (500, 10, 15, ("a",), 1.0, 0.08, False)
    assert (resolution_for_detail(5), confidence_for_threshold(25)) == (3.0, 0.3)
