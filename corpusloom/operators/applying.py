"""Planning, applying and undoing write-backs over a snapshot of files (I-11..I-15, W-09, J-16..J-18, S-09, A-31).

Files are rows (path, text).  Applying gives a new snapshot and a journal; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import files as X
from corpusloom.functions import text as T
from corpusloom.sources.scratch import materialize


@dataclass(frozen=True)
class Plan:
    """indexes: id, name, path, action, rename_from, user_note.  notes: note_id, path, index_ids (primary first).

    clear: path.  stale: path.  moves: note_id, from_path, to_path.  skipped: note_id, reason.
    """

    indexes: DataFrame
    notes: DataFrame
    clear: DataFrame
    stale: DataFrame
    moves: DataFrame
    skipped: DataFrame


def unique_paths(names: DataFrame, folder: str) -> DataFrame:
    """names (seq, id, name) with a path each; equal names, whatever their case, are numbered in order (W-09).

    A numbered name that meets another one is numbered on; each round settles all but those.
    """
    base = names.select("seq", "id", T.index_file_name(F.col("name")).alias("base")).withColumn("_k", F.lit(1))
    prefix = f"{folder.rstrip('/')}/" if folder else ""
    done = None
    while True:
        path = F.concat(F.lit(prefix), "base", F.when(F.col("_k") > 1, F.concat(F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(""), F.lit(".md"))
        tried = base.withColumn("path", path)
        if done is not None:
            taken = done.select(F.lower("path").alias("_l"))
            tried = tried.join(taken, F.lower("path") == F.col("_l"), "left").withColumn("_taken", F.col("_l").isNotNull()).drop("_l")
        else:
            tried = tried.withColumn("_taken", F.lit(False))
        order = Window.partitionBy(F.lower("path")).orderBy("seq")
        tried = materialize(tried.withColumn("_n", F.row_number().over(order)), "names")
        good = tried.where("not _taken and _n = 1").select("seq", "id", "path")
        done = good if done is None else done.unionByName(good)
        # The n-th of a name tries the n-th number; one whose number is taken tries the next.
        base = tried.where("_taken or _n > 1").select("seq", "id", "base", (F.col("_k") + F.when(F.col("_taken"), 1).otherwise(F.col("_n") - 1)).alias("_k"))
        if base.isEmpty():
            return done


def plan_apply(indexes: DataFrame, members: DataFrame, notes: DataFrame, files: DataFrame, previous: DataFrame, folder: str = "Indexes", move_to: str = "") -> Plan:
    """indexes: seq, id, name, ignored.  members: index_id, note_id, is_primary.  notes: note_id, path (live ones).

    files: path, is_generated, has_keys.  previous: id, path of the last apply.
    """
    live = indexes.where("not ignored")
    paths = materialize(unique_paths(live, folder), "index-paths")
    seen = files.select(F.col("path").alias("_f"), "is_generated")
    old = previous.select(F.col("id").alias("_o"), F.col("path").alias("_old"))
    at = paths.join(live.select("id", "name"), "id").join(old, F.col("id") == F.col("_o"), "left").join(seen, F.col("path") == F.col("_f"), "left")
    was = files.select(F.col("path").alias("_w"), F.col("is_generated").alias("_was_generated"))
    at = at.join(was, F.col("_old") == F.col("_w"), "left")
    exists = F.col("_f").isNotNull()
    renames = (F.col("_old") != F.col("path")) & F.coalesce("_was_generated", F.lit(False)) & ~exists
    planned = materialize(at.select("seq", "id", "name", "path", F.when(exists | F.coalesce(renames, F.lit(False)), "update").otherwise("create").alias("action"), F.when(renames, F.col("_old")).alias("rename_from"), (exists & ~F.coalesce("is_generated", F.lit(False))).alias("user_note")), "planned")

    where = notes.select(F.col("note_id").alias("_n"), "path")
    placed = members.join(live.select(F.col("id").alias("index_id"), "seq"), "index_id").join(where, F.col("note_id") == F.col("_n"), "left")
    skipped = placed.where("path is null").select("note_id", F.lit("note no longer exists").alias("reason"))
    owned = placed.where("path is not null").groupBy("note_id", "path").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "seq", "index_id"))).alias("x")).select("note_id", "path", F.transform("x", lambda i: i["index_id"]).alias("index_ids"))
    owned = materialize(owned, "planned-notes")
    index_paths = planned.select("path").unionByName(planned.where("rename_from is not null").select(F.col("rename_from").alias("path")))
    clear = files.where("has_keys").select("path").join(owned.select("path"), "path", "left_anti").join(index_paths, "path", "left_anti")
    stale = files.where("is_generated").select("path").join(index_paths, "path", "left_anti")
    moves = owned.limit(0).select("note_id", F.col("path").alias("from_path"), F.col("path").alias("to_path"))
    if move_to:
        target = move_to.rstrip("/")
        outside = owned.where((T.folder_of(F.col("path")) != target) & ~F.col("path").startswith(target + "/"))
        wanted = outside.select("note_id", F.col("path").alias("from_path"), F.concat(F.lit(target + "/"), F.substring_index("path", "/", -1)).alias("to_path"))
        wanted = wanted.join(seen, F.col("to_path") == F.col("_f"), "left").withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("to_path")).orderBy("note_id")))
        free = F.col("_f").isNull() & (F.col("_k") == 1)
        moves = wanted.where(free).select("note_id", "from_path", "to_path")
        skipped = skipped.unionByName(wanted.where(~free).select("note_id", F.concat(F.lit("not moved: "), "to_path", F.lit(" already exists")).alias("reason")))
    return Plan(planned, owned, clear, stale, moves, skipped)


EDIT = "path string, text string, before string, after_hash string, type_before array<string>, indexes_before array<string>, section_before string, changed boolean, kind string"


def _edit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        rows = []
        for path, before, kind, links, frontmatter, visible, section in batch.itertuples(index=False):
            links = list(links) if links is not None else []
            if kind not in ("index", "user-index", "clear", "note"):
                rows.append((path, before, before if kind else None, None, None, None, None, False, kind))
                continue
            if kind == "index":
                after = X.set_section(before, section)
            elif kind == "user-index":
                after = X.set_section(X.set_keys(before, {"zk-type": "index"}), section)
            elif kind == "clear" or not frontmatter:
                after = X.set_keys(before, {"zk-type": None, "zk-indexes": None})
            else:
                after = X.set_keys(before, {"zk-type": "note", "zk-indexes": links})
            if kind in ("note", "clear"):
                after = X.set_section(after, X.note_section(links) if kind == "note" and visible and links else None)
            rows.append((path, after, before, None, X.read_key(before, "zk-type"), X.read_key(before, "zk-indexes"), X.read_section(before), after != before, kind))
        yield pd.DataFrame(rows, columns=["path", "text", "before", "after_hash", "type_before", "indexes_before", "section_before", "changed", "kind"])


def edit_files(edits: DataFrame) -> DataFrame:
    """The edits (path, text, kind, links, frontmatter, visible, section) carried out, with what a journal needs.

    Rows of null kind, which have no ``before``, and of kind ``delete`` keep their text.
    """
    out = edits.select("path", "text", "kind", "links", "frontmatter", "visible", "section").mapInPandas(_edit, EDIT)
    return out.withColumn("after_hash", F.sha2("text", 256))


def apply_plan(files: DataFrame, plan: Plan, frontmatter: bool = True, visible: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files after, journal).  journal: seq, op, path, from_path, before, after_hash, type_before, indexes_before, section_before.

    In order: index files are renamed or made, then written; notes; notes to clear; stale index files.
    Texts are dealt by path once and written once, beside what was there before; both results read that table.
    """
    links = plan.notes.select("note_id", "path", F.posexplode("index_ids").alias("pos", "id")).join(plan.indexes.select("id", F.concat(F.lit("[["), T.base_name(F.col("path")), F.lit("]]")).alias("link")), "id")
    noted = links.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("links"))
    listed = plan.notes.select("path", F.posexplode("index_ids").alias("pos", "id")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: F.concat(F.lit("[["), T.base_name(x["path"]), F.lit("]]"))).alias("notes"))
    content = plan.indexes.join(listed, "id", "left").withColumn("section", F.concat_ws("\n", F.lit("## Notes"), F.lit(""), F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("- "), n))))
    renamed = plan.indexes.where("rename_from is not null").select(F.col("rename_from").alias("_from"), F.col("path").alias("_to"))
    moved = files.join(F.broadcast(renamed), files["path"] == F.col("_from"), "left").select(F.coalesce("_to", "path").alias("path"), "text")
    head = X.set_keys("", {"zk-type": "index", "zk-generated": True, "zk-version": 1})
    made = materialize(content.where("action = 'create'").select("path", F.concat(F.lit(head + "\n# "), "name", F.lit(f"\n\n{X.START}\n"), "section", F.lit(f"\n{X.END}\n")).alias("text")), "made")
    targets = (
        noted.select("path", F.lit("note").alias("kind"), "links", F.lit(None).cast("string").alias("section"))
        .unionByName(plan.clear.select("path", F.lit("clear").alias("kind"), F.array().cast("array<string>").alias("links"), F.lit(None).cast("string").alias("section")))
        .unionByName(content.where("action = 'update'").select("path", F.when(F.col("user_note"), "user-index").otherwise("index").alias("kind"), F.array().cast("array<string>").alias("links"), "section"))
    )
    stale = plan.stale.select("path", F.lit("delete").alias("_stale")).distinct()
    edits = moved.join(targets, "path", "left").join(stale, "path", "left").withColumn("kind", F.coalesce("_stale", "kind"))
    edited = materialize(edit_files(edits.select("*", F.lit(frontmatter).alias("frontmatter"), F.lit(visible).alias("visible"))), "edited")
    after = edited.where("kind is null or kind <> 'delete'").select("path", "text").unionByName(made)
    none, lines = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    entry = lambda df, phase, op, path, source=none, before=none, after_hash=none, keys=lines, indexes=lines, section=none: df.select(F.lit(phase).alias("phase"), F.lit(op).alias("op"), path.alias("path"), source.alias("from_path"), before.alias("before"), after_hash.alias("after_hash"), keys.alias("type_before"), indexes.alias("indexes_before"), section.alias("section_before"))
    journal = (
        entry(renamed, 1, "rename", F.col("_to"), F.col("_from"))
        .unionByName(entry(made, 2, "create", F.col("path"), after_hash=F.sha2("text", 256)))
        .unionByName(entry(edited.where("changed"), 3, "modify", F.col("path"), before=F.col("before"), after_hash=F.col("after_hash"), keys=F.col("type_before"), indexes=F.col("indexes_before"), section=F.col("section_before")))
        .unionByName(entry(edited.where("kind = 'delete'"), 4, "delete", F.col("path"), before=F.col("before")))
    )
    return after, journal


def _undo(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        rows = []
        for path, text, touched, kept_type, kept_indexes, section in batch.itertuples(index=False):
            if not touched:
                rows.append((path, text))
                continue
            raw = lambda v: None if v is None else list(v)
            back = X.restore_key(X.restore_key(text, "zk-type", raw(kept_type)), "zk-indexes", raw(kept_indexes))
            rows.append((path, X.set_section(back, section)))
        yield pd.DataFrame(rows, columns=["path", "text"])


def undo(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files as before the apply (I-13).

    Files that nobody touched since get their exact text back; others lose only our keys and section.  Each
    path has one entry a phase, so phases are undone as joins, last first.
    """
    gone = journal.where("op = 'create'").select("path")
    back = journal.where("op = 'delete'").select("path", F.col("before").alias("text"))
    changes = journal.where("op = 'modify'").select(F.col("path").alias("_p"), "before", "after_hash", "type_before", "indexes_before", "section_before")
    kept = files.join(gone, "path", "left_anti")
    same = F.coalesce(F.sha2("text", 256) == F.col("after_hash"), F.lit(False))
    found = kept.join(changes, F.col("path") == F.col("_p"), "left").withColumn("_same", same)  # one join: texts are dealt by path once
    restored = found.select("path", F.when(F.col("_same"), F.col("before")).otherwise(F.col("text")).alias("text"), (F.col("_p").isNotNull() & ~F.col("_same")).alias("touched"), "type_before", "indexes_before", "section_before").mapInPandas(_undo, "path string, text string")
    all_ = restored.unionByName(back)
    renames = journal.where("op = 'rename'").select(F.col("path").alias("_p"), "from_path")
    return all_.join(F.broadcast(renames), F.col("path") == F.col("_p"), "left").select(F.coalesce("from_path", "path").alias("path"), "text")


def summary(journal: DataFrame) -> DataFrame:
    """One row: files created, modified, renamed and deleted (A-31)."""
    count = lambda op, name: F.count_if(F.col("op") == op).alias(name)
    return journal.agg(count("create", "created"), F.countDistinct(F.when(F.col("op") == "modify", F.col("path"))).alias("modified"), count("rename", "renamed"), count("delete", "deleted"))


def scoped(plan: Plan, note_ids: DataFrame) -> Plan:
    """The plan for some notes alone, as after single assignments (I-15)."""
    none = lambda df: df.limit(0)
    return Plan(plan.indexes, plan.notes.join(note_ids, "note_id", "left_semi"), none(plan.clear), none(plan.stale), none(plan.moves), plan.skipped)


def rename_links(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files with links to renamed notes rewritten (I-14, J-21).  renames: old, new (link texts)."""
    found = files.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), 1), F.trim))).alias("old")).join(renames, "old")
    wanted = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("swaps"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for path, text, swaps in batch.itertuples(index=False):
                for old, new in sorted((swaps or {}).items()):
                    text = X.rewrite_links(text, old, new)
                rows.append((path, text))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return files.join(wanted, "path", "left").select("path", "text", "swaps").mapInPandas(run, "path string, text string")
