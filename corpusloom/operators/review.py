"""User decisions over proposals, and carrying proposal ids over to a new analysis (I-08..I-10, J-12, J-20, W-04)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.config import RECONCILE_JACCARD


@dataclass(frozen=True)
class Decisions:
    """names: id -> name; merged: id -> target; added and removed: (id, note); primary: note -> id."""

    names: tuple[tuple[str, str], ...] = ()
    ignored: tuple[str, ...] = ()
    merged: tuple[tuple[str, str], ...] = ()
    added: tuple[tuple[str, str], ...] = ()
    removed: tuple[tuple[str, str], ...] = ()
    primary: tuple[tuple[str, str], ...] = ()
    splits: tuple[str, ...] = ()

    def count(self) -> int:
        return sum(map(len, (self.names, self.ignored, self.merged, self.added, self.removed, self.primary, self.splits)))

    def rename(self, index: str, name: str) -> Decisions:
        kept = tuple(n for n in self.names if n[0] != index)
        return replace(self, names=(*kept, (index, name.strip())) if name.strip() else kept)

    def toggle_ignore(self, index: str) -> Decisions:
        return replace(self, ignored=tuple(i for i in self.ignored if i != index) if index in self.ignored else (*self.ignored, index))

    def merge(self, index: str, into: str) -> Decisions:
        """Refused where it would close a ring."""
        if resolve(into, dict(self.merged)) == index or index == into:
            return self
        return replace(self, merged=(*(m for m in self.merged if m[0] != index), (index, into)))

    def add(self, index: str, note: str) -> Decisions:
        return replace(self, removed=tuple(x for x in self.removed if x != (index, note)), added=tuple(dict.fromkeys((*self.added, (index, note)))))

    def remove(self, index: str, note: str) -> Decisions:
        return replace(self, added=tuple(x for x in self.added if x != (index, note)), removed=tuple(dict.fromkeys((*self.removed, (index, note)))))

    def set_primary(self, note: str, index: str) -> Decisions:
        return replace(self, primary=(*(p for p in self.primary if p[0] != note), (note, index)))

    def reset(self, index: str) -> Decisions:
        return replace(self, names=tuple(x for x in self.names if x[0] != index), ignored=tuple(x for x in self.ignored if x != index), merged=tuple(x for x in self.merged if x[0] != index), added=tuple(x for x in self.added if x[0] != index), removed=tuple(x for x in self.removed if x[0] != index), primary=tuple(x for x in self.primary if x[1] != index), splits=tuple(x for x in self.splits if x != index))


def resolve(index: str, merged: dict[str, str]) -> str:
    """Where a chain of merges ends; a ring ends where it was entered again (J-20)."""
    seen: set[str] = set()
    while index in merged and index not in seen:
        seen.add(index)
        index = merged[index]
    return index


def targets(proposals: DataFrame, decisions: Decisions) -> DataFrame:
    """id, target: where each proposal's members go.  Decisions are a user's, and few."""
    merged = dict(decisions.merged)
    rows = [(i, resolve(i, merged)) for i in merged]
    table = proposals.sparkSession.createDataFrame(rows, "id string, _target string")
    live = proposals.select(F.col("id").alias("_live"))
    found = proposals.select("id").join(F.broadcast(table), "id", "left").join(live, F.col("_target") == F.col("_live"), "left")
    return found.select("id", F.coalesce("_live", "id").alias("target"))


def effective_members(proposals: DataFrame, members: DataFrame, decisions: Decisions, live: DataFrame | None = None) -> DataFrame:
    """index_id, note_id, score, is_primary, manual: memberships after every decision (U-03, U-04, W-04).

    One primary index a note: the user's choice, else the best primary membership, else the first.  With ``live``
    (note_id) only notes that still exist stay (J-15).
    """
    spark, merged = proposals.sparkSession, dict(decisions.merged)
    pairs = lambda rows: spark.createDataFrame([(resolve(i, merged), n) for i, n in rows], "index_id string, note_id string")
    where = targets(proposals, decisions)
    ids = where.where("id = target").select(F.col("id").alias("index_id"))
    ranked = members.join(where, members["proposal_id"] == where["id"])
    folded = ranked.groupBy(F.col("target").alias("index_id"), "note_id").agg(F.max_by("score", F.struct(F.col("proposal_id") == F.col("target"), "score")).alias("score"), F.bool_or("is_primary").alias("is_primary"))
    added = pairs(decisions.added).distinct().join(ids, "index_id", "left_semi").join(folded, ["index_id", "note_id"], "left_anti")
    both = folded.withColumn("manual", F.lit(False)).unionByName(added.select("index_id", "note_id", F.lit(1.0).alias("score"), F.lit(True).alias("is_primary"), F.lit(True).alias("manual")))
    both = both.join(pairs(decisions.removed).distinct(), ["index_id", "note_id"], "left_anti")
    ignored = spark.createDataFrame([(i,) for i in decisions.ignored], "index_id string")
    forced = spark.createDataFrame([(n, resolve(i, merged)) for n, i in decisions.primary], "note_id string, _forced string")
    rows = both.join(F.broadcast(ignored.withColumn("_ignored", F.lit(True))), "index_id", "left").join(F.broadcast(forced), "note_id", "left")
    shown = F.coalesce("_ignored", F.lit(False)) == F.lit(False)
    order = Window.partitionBy("note_id").orderBy(shown.desc(), F.coalesce(F.col("index_id") == F.col("_forced"), F.lit(False)).desc(), F.col("is_primary").desc(), F.when(F.col("is_primary"), F.col("score")).desc_nulls_last(), "index_id")
    first = rows.withColumn("_n", F.row_number().over(order))
    out = first.select("index_id", "note_id", "score", F.when(shown, F.col("_n") == 1).otherwise(F.col("is_primary")).alias("is_primary"), "manual", (~shown).alias("ignored"))
    return out if live is None else out.join(live.select("note_id"), "note_id", "left_semi").select(*out.columns)


def effective_indexes(proposals: DataFrame, effective: DataFrame, decisions: Decisions) -> DataFrame:
    """id, kind, name, renamed, unnamed, ignored, size in display order (T-04): ignored last, topics first, large first."""
    spark = proposals.sparkSession
    names = spark.createDataFrame(list(decisions.names), "id string, _own string")
    ignored = spark.createDataFrame([(i,) for i in decisions.ignored], "id string").withColumn("_ignored", F.lit(True))
    sizes = effective.groupBy(F.col("index_id").alias("id")).agg(F.count("*").alias("size"))
    rows = proposals.join(targets(proposals, decisions).where("id = target").select("id"), "id", "left_semi").join(F.broadcast(names), "id", "left").join(F.broadcast(ignored), "id", "left").join(sizes, "id", "left")
    name = F.coalesce("_own", "name")
    out = rows.select("id", "kind", F.coalesce(name, F.lit("Unnamed topic")).alias("name"), F.col("_own").isNotNull().alias("renamed"), name.isNull().alias("unnamed"), F.coalesce("_ignored", F.lit(False)).alias("ignored"), F.coalesce("size", F.lit(0)).alias("size"))
    return out.orderBy("ignored", F.col("kind") == "collection", F.col("size").desc(), "id")


#: How many rows of each kind are shown.
SHOWN_MEMBERS, SHOWN_UNCLASSIFIED, SHOWN_QUEUE, SHOWN_SAMPLES = 200, 300, 100, 4
#: Fixed value: keywords of a merged index.
MERGED_KEYWORDS = 10


def shown_members(effective: DataFrame, limit: int = SHOWN_MEMBERS) -> DataFrame:
    """index_id, place, note_id, score, is_primary: each index's first members in display order (T-05, T-08)."""
    order = Window.partitionBy("index_id").orderBy(F.col("is_primary").desc(), F.col("score").desc(), "note_id")
    return effective.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("index_id", "place", "note_id", "score", "is_primary")


def shown_unclassified(left: DataFrame, limit: int = SHOWN_UNCLASSIFIED) -> DataFrame:
    """The first notes without an index, by id (T-08)."""
    return left.orderBy("note_id").limit(limit)


def merged_keywords(proposals: DataFrame, decisions: Decisions, most: int = MERGED_KEYWORDS) -> DataFrame:
    """id, keywords: an index's own keywords, then those of what was merged into it, in order of id, each once (U-03)."""
    where = targets(proposals, decisions)
    own = F.struct((F.col("id") != F.col("target")).alias("merged"), "id", "keywords")
    each = proposals.select("id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")).join(where, "id").groupBy("target").agg(F.array_sort(F.collect_list(own)).alias("k"))
    return each.select(F.col("target").alias("id"), F.slice(F.array_distinct(F.flatten(F.transform("k", lambda x: x["keywords"]))), 1, most).alias("keywords"))


def apply_split(proposals: DataFrame, members: DataFrame, index: str, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, members, note_id of notes now without an index) with one proposal replaced by its parts (U-07, C-06).

    parts: id, name, note_id, score, the primary members of each part.  Parts remember the proposal in ``split_from``;
    an id that is taken gets ``-s``.
    """
    kept = proposals.where(F.col("id") != index)
    kept = kept if "split_from" in kept.columns else kept.withColumn("split_from", F.lit(None).cast("string"))
    taken = proposals.select(F.col("id").alias("_taken"))
    new = parts.join(taken, F.col("id") == F.col("_taken"), "left").withColumn("id", F.concat("id", F.when(F.col("_taken").isNotNull(), "-s").otherwise(""))).drop("_taken")
    kind = proposals.where(F.col("id") == index).select(F.col("kind").alias("_kind")).limit(1)
    heads = new.select("id", "name").distinct().join(F.broadcast(kind)).select("id", F.col("_kind").alias("kind"), "name", F.lit(index).alias("split_from"))
    rows = new.select(F.col("id").alias("proposal_id"), "note_id", "score", F.lit(True).alias("is_primary"))
    others = members.where(F.col("proposal_id") != index)
    lost = members.where((F.col("proposal_id") == index) & F.col("is_primary")).select("note_id").join(rows.select("note_id"), "note_id", "left_anti")
    lost = lost.join(others.where("is_primary").select("note_id"), "note_id", "left_anti")
    return kept.unionByName(heads, allowMissingColumns=True), others.unionByName(rows, allowMissingColumns=True), lost


def record_split(decisions: Decisions, index: str) -> Decisions:
    """Decisions about a split index have no target any more; that it was split is one."""
    return replace(decisions, names=tuple(n for n in decisions.names if n[0] != index), ignored=tuple(i for i in decisions.ignored if i != index), splits=tuple(dict.fromkeys((*decisions.splits, index))))


def unclassified(notes: DataFrame, effective: DataFrame) -> DataFrame:
    """Notes without an index that isn't ignored (U-05)."""
    return notes.select("note_id").join(effective.where("not ignored").select("note_id"), "note_id", "left_anti")


def overlaps(before: DataFrame, after: DataFrame, least: float = RECONCILE_JACCARD) -> DataFrame:
    """old_id, new_id, jaccard of proposals of one kind that share enough primary members (J-12).

    before, after: id, kind, note_id.  Notes meet their own proposals only, so no pair without a shared member is made.
    """
    size = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    old, new = before.select(F.col("id").alias("old_id"), "kind", "note_id"), after.select(F.col("id").alias("new_id"), "kind", "note_id")
    shared = old.join(new, ["kind", "note_id"]).groupBy("old_id", "new_id").agg(F.count("*").alias("n"))
    both = shared.join(size(before, "na").withColumnRenamed("id", "old_id"), "old_id").join(size(after, "nb").withColumnRenamed("id", "new_id"), "new_id")
    return both.select("old_id", "new_id", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard")).where(F.col("jaccard") >= least)


def match_ids(pairs: list[tuple[str, str, float]], new_ids: list[str]) -> dict[str, str]:
    """new id -> id to use: greedy by overlap, each old id once; a clash gets ``-n`` (I-09).  Proposals are few."""
    renamed: dict[str, str] = {}
    used: set[str] = set()
    for old, new, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if new not in renamed and old not in used:
            renamed[new] = old
            used.add(old)
    return {i: renamed.get(i, f"{i}-n" if i in used else i) for i in new_ids}


def reconcile(before: DataFrame, after: DataFrame, least: float = RECONCILE_JACCARD) -> DataFrame:
    """id, new_id: the id each new proposal takes.  Parts of a split count under ``split_from``, where there is one."""
    if "split_from" in before.columns:
        before = before.withColumn("id", F.coalesce("split_from", "id"))
    pairs = [(r.old_id, r.new_id, r.jaccard) for r in overlaps(before.select("id", "kind", "note_id").distinct(), after, least).collect()]
    new_ids = [r.id for r in after.select("id").distinct().collect()]
    return after.sparkSession.createDataFrame(list(match_ids(pairs, new_ids).items()), "id string, new_id string")
