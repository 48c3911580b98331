"""Notes: the corpus view every operator starts from, with exclusion rules (S-01..S-03, F-01..F-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.config import Settings


#: Files of less than this a core may hold fewer row groups, and so tasks, than there are cores; far smaller ones aren't worth a shuffle.
SPREAD_BYTES, LEAST_BYTES = 4 << 20, 1 << 18


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small scan dealt evenly over all cores; scans that are large enough stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if LEAST_BYTES < size < cores * SPREAD_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents as notes: the first non-empty line is the title, source and language are the folders."""
    rows = documents = spread(documents)
    tags = F.array("lang")
    if labels is not None:
        rows = documents.join(labels.select(F.col("doc_id").alias("_l"), "quality"), documents["doc_id"] == F.col("_l"), "left").drop("_l")
        tags = F.array_compact(F.array("lang", F.concat(F.lit("quality/"), F.col("quality").cast("string"))))
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.substring(T.first_line(F.col("text")), 1, 80).alias("title"),
        F.coalesce("text", F.lit("")).alias("content"),
        tags.alias("tags"),
    )


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files as notes, one row a file; front matter by key, headings, tags and links taken from the text."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"))
    matter = F.regexp_extract("value", r"\A---[ \t]*\r?\n((?s:.*?\r?\n)??)---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.regexp_extract_all(matter, F.lit(r"(?m)^([^\s#:][^:\n]*:[ \t]*[^\n]*)$"), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    frontmatter = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), 1)["v"])))
    links = F.transform(F.regexp_extract_all("value", F.lit(r"\[\[([^\]|#]+)"), 1), F.trim)
    return files.select(
        F.xxhash64("path").cast("string").alias("id"), "path", T.base_name(F.col("path")).alias("title"), F.col("value").alias("content"),
        F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*)$"), 1), F.trim).alias("headings"),
        F.array_distinct(F.regexp_extract_all("value", F.lit(r"(?m)(?:^|\s)#([\p{L}\w/-]+)"), 1)).alias("tags"),
        F.array_distinct(links).alias("links"), F.array().cast("array<string>").alias("aliases"), frontmatter.alias("frontmatter"), "modified_at",
    ).orderBy("path")


def resolve_links(notes: DataFrame) -> DataFrame:
    """src, dst: links to existing notes by exact path, else by a base name that one note alone has (S-03, J-01)."""
    wanted = notes.select(F.col("id").alias("src"), F.explode(F.array_distinct("links")).alias("link"))
    by_path = notes.select(F.col("path").alias("_p"), F.col("id").alias("_by_path"))
    by_name = notes.groupBy(T.base_name(F.col("path")).alias("_n")).agg(F.min("id").alias("_by_name"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    found = wanted.join(by_path, F.col("link") == F.col("_p"), "left").join(by_name, F.col("link") == F.col("_n"), "left")
    return found.select("src", F.coalesce("_by_path", "_by_name").alias("dst")).where("dst is not null").distinct()


def in_folder(path: Column, folder: str) -> Column:
    bare = folder.strip("/")
    return (path == bare) | path.startswith(bare + "/") if bare else F.lit(False)


def tag_matches(tags: Column, excluded: str) -> Column:
    e = excluded.lower()
    return F.exists(tags, lambda t: (F.lower(t) == e) | F.lower(t).startswith(e + "/"))


def exclusion_reason(settings: Settings, path: Column, tags: Column, frontmatter: Column | None = None) -> Column:
    """Why a note is left out, the first reason that holds, or null (F-01)."""
    any_of = lambda tests: F.array_contains(F.array(*tests), True) if tests else F.lit(False)
    key = (lambda k: F.element_at(frontmatter, k)) if frontmatter is not None else (lambda _: F.lit(None).cast("string"))
    return F.coalesce(
        F.when(in_folder(path, settings.config_dir), "config"),
        F.when(path.endswith(".excalidraw.md") | key("excalidraw-plugin").isNotNull(), "drawing"),
        F.when(any_of([in_folder(path, f) for f in settings.excluded_folders]), "folder"),
        F.when(key("zk-ignore") == "true", "frontmatter"),
        F.when(key("zk-type") == "index", "generated-index"),
        F.when(any_of([tag_matches(tags, t) for t in settings.excluded_tags]), "tag"),
    )


def scan_one(notes: DataFrame, path: str, settings: Settings) -> DataFrame:
    """The note at a path; no row where it is missing or left out (S-02)."""
    front = F.col("frontmatter") if "frontmatter" in notes.columns else None
    return notes.where((F.col("path") == path) & exclusion_reason(settings, F.col("path"), F.col("tags"), front).isNull())


def register_ids(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, id: known ids for live paths, new ones from the path otherwise; dead paths go (S-12)."""
    old = known.select(F.col("path").alias("_p"), F.col("id").alias("_id"))
    return paths.join(old, F.col("path") == F.col("_p"), "left").select("path", F.coalesce("_id", F.xxhash64("path").cast("string")).alias("id"))


def rename_ids(known: DataFrame, renames: DataFrame) -> DataFrame:
    """Ids follow their path through renames (old, new); a renamed path displaces another note of that path (R-04)."""
    moved = known.join(renames, known["path"] == renames["old"], "left").select("id", F.coalesce("new", "path").alias("path"), F.col("new").isNotNull().alias("_moved"))
    return moved.groupBy("path").agg(F.max_by("id", "_moved").alias("id"))
