"""Text functions: cleaning, lines, tokens, stems, names, hashes and paths, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def rewrite(text: Column, *steps: P.Rewrite) -> Column:
    for step in steps:
        text = F.regexp_replace(text, *step.java)
    return text


def rewrite_where_needed(text: Column, steps: Iterable[P.Rewrite]) -> Column:
    """The same, but a step's pattern is searched only where one of the strings it needs is there.

    Texts pass through one-element arrays, so that each step's result is worked out once and named.
    """
    held = F.array(text)
    for step in steps:
        held = F.transform(held, _where_needed(step))
    return F.get(held, F.lit(0))


def _where_needed(step: P.Rewrite):
    def one(text: Column) -> Column:
        if not step.needs:
            return rewrite(text, step)
        return F.when(reduce(or_, [F.contains(text, F.lit(n)) for n in step.needs]), rewrite(text, step)).otherwise(text)

    return one


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACES_ALONE))


def clean_lines(text: Column) -> Column:
    """Markdown as non-empty trimmed lines of prose (P-01)."""
    lines = F.split(rewrite_where_needed(F.coalesce(text, F.lit("")), P.CLEANING), "\n")
    return F.filter(F.transform(lines, trim), lambda l: l != "")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty without one."""
    return trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"\A{P.WS}*+([^\n]*+)", 1))


def normalize_lines(lines: Column) -> Column:
    """``normalize_line`` of trimmed non-empty lines, worked out over all of them at once."""
    inside = P.Rewrite(f"{P.WS[:-1]}&&[^\n]]+", by=" ")
    whole = rewrite(F.lower(F.array_join(lines, "\n")), P.DIGITS, inside)
    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))


def first_after_title(lines: Column, title: Column) -> Column:
    """Where the lines begin (from 1) without a first one that repeats the title."""
    same = (F.size(lines) > 0) & (F.lower(F.get(lines, F.lit(0))) == F.lower(title))
    return F.when(same, F.lit(2)).otherwise(F.lit(1))


def drop_title(lines: Column, title: Column) -> Column:
    """Lines without a first one that repeats the title (P-02)."""
    return F.slice(lines, first_after_title(lines, title), F.greatest(F.size(lines), F.lit(1)))


def body_lines(text: Column, title: Column) -> Column:
    return drop_title(clean_lines(text), title)


def normalize_line(line: Column) -> Column:
    """The form in which template lines are compared (P-08)."""
    return trim(rewrite(F.lower(line), P.DIGITS, P.SPACES))


def strip_html(html: Column) -> Column:
    return trim(rewrite(F.coalesce(html, F.lit("")), *P.HTML))


def tag_words(tag: Column) -> Column:
    """A tag as words (P-04)."""
    return rewrite(F.regexp_replace(tag, "^#", ""), P.TAG_SEPARATORS)


def semantic_chars(body: Column) -> Column:
    """Characters that aren't white space (P-05)."""
    return F.length(rewrite(F.replace(F.replace(body, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), P.NO_SPACE)).cast("long")


def header_text(title: Column, aliases: Column, headings: Column, tags: Column, max_headings: int = 10) -> Column:
    """Title, aliases, headings and tags, a line each; empty ones left out (P-03)."""
    other = lambda items: F.filter(items, lambda x: (x != "") & (F.lower(x) != F.lower(title)))
    parts = (
        title,
        F.array_join(other(aliases), ", "),
        F.array_join(F.slice(F.array_distinct(other(headings)), 1, max_headings), "; "),
        F.array_join(F.transform(tags, tag_words), ", "),
    )
    return join_nonempty(F.array(*parts))


def join_nonempty(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def tokenize(text: Column) -> Column:
    """Keyword tokens in order (P-09)."""
    folded = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.filter(F.regexp_extract_all(folded, F.lit(P.WORD), 1), lambda t: ~t.isin(*sorted(P.STOP_WORDS)))


def stem(token: Column) -> Column:
    """The first six characters of a longer token (P-10)."""
    return F.substring(token, 1, 6)


def acronyms(text: Column) -> Column:
    """Words in capitals, in lower case (P-11)."""
    found = F.regexp_extract_all(text, F.lit(P.ACRONYM), 1)
    return F.transform(found, lambda w: F.replace(F.lower(w), F.lit("ё"), F.lit("е")))


def title_phrases(title: Column) -> Column:
    """Uni- and bigrams of a title's meaningful words: key (stems), form, is_pair, at_start (P-12)."""
    words = F.filter(F.split(F.regexp_replace(title, "_+", " "), P.TITLE_BREAK), lambda w: w != "")
    meant = F.transform(words, lambda w: F.when(F.size(tokenize(w)) > 0, w))
    key = lambda w: stem(F.lower(w))

    def at(w: Column, i: Column) -> Column:
        n = F.get(meant, i + 1)
        one = F.struct(key(w).alias("key"), w.alias("form"), F.lit(False).alias("is_pair"), (i == 0).alias("at_start"))
        two = F.struct(F.concat_ws(" ", key(w), key(n)).alias("key"), F.concat_ws(" ", w, n).alias("form"), F.lit(True).alias("is_pair"), (i == 0).alias("at_start"))
        return F.when(w.isNull(), F.array().cast(_PHRASES)).when(n.isNull(), F.array(one)).otherwise(F.array(one, two))

    return F.flatten(F.transform(meant, at))


_PHRASES = "array<struct<key:string,form:string,is_pair:boolean,at_start:boolean>>"


def is_generic_name(name: Column) -> Column:
    """Names that are no topics: stock words, numbers, dates, very short ones (P-13)."""
    n = F.lower(trim(name))
    digits = F.length(F.regexp_replace(n, "[^0-9]", ""))
    return (n == "") | n.isin(*sorted(P.GENERIC_NAMES)) | n.rlike(r"^[0-9]+$") | (F.length(n) < 3) | (digits >= 4) | n.rlike(r"[0-9]{4}-[0-9]{2}")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def tag_label(tag: Column) -> Column:
    """The last part of a nested tag as a name (P-14)."""
    return capitalise(F.regexp_replace(F.substring_index(tag, "/", -1), "[-_]+", " "))


def index_file_name(name: Column, fallback: str = "Untitled index") -> Column:
    """A safe file name (P-16)."""
    clean = rewrite(F.substring(trim(rewrite(name, P.FILE_ILLEGAL, P.SPACES)), 1, 100), P.FILE_TAIL)
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def folder_of(path: Column) -> Column:
    """Everything before the last slash; empty at the root (P-17)."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def wikilink(link: Column) -> Column:
    """Parts of ``[[target#sub|alias]]``; null for other syntaxes (P-18)."""
    pattern = r"^(!?)\[\[([^\]|#]*)(#[^\]|]*)?(?:\|([^\]]*))?\]\]$"
    part = lambda k: F.regexp_extract(link, pattern, k)
    return F.when(link.rlike(pattern), F.struct((part(1) == "!").alias("embed"), part(2).alias("target"), part(3).alias("sub"), F.nullif(part(4), F.lit("")).alias("alias")))


def gold_label(link: Column) -> Column:
    """The last path part of a link's target, as an evaluation label (P-19)."""
    return F.nullif(F.substring_index(F.regexp_extract(link, r"\[\[([^\]|#]+)", 1), "/", -1), F.lit(""))


_MASK = 0xFFFFFFFF
_PRIME = 0x01000193
_LANE_SEEDS = (0x811C9DC5, 0x01000193 ^ 0x5BD1E995)


def content_hash(text: Column, empty: tuple[int, ...] = ()) -> Column:
    """Sixteen hex digits of two 32-bit FNV-1a lanes over characters (H-01); null for null.  ``empty``: what an empty text counts as."""
    codes = F.when(text == "", F.array(*[F.lit(c) for c in empty]).cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint")))
    mask = F.lit(_MASK).cast("bigint")

    def step(h: Column, c: Column) -> Column:
        return (h.bitwiseXOR(c) * F.lit(_PRIME).cast("bigint")).bitwiseAND(mask)

    one = F.aggregate(codes, F.lit(_LANE_SEEDS[0]).cast("bigint"), step)
    two = F.aggregate(codes, F.lit(_LANE_SEEDS[1]).cast("bigint"), lambda h, c: step(h, c).bitwiseXOR(F.shiftrightunsigned(h, 13)))
    return F.lower(F.concat(F.lpad(F.hex(one), 8, "0"), F.lpad(F.hex(two), 8, "0")))


def note_hash(head: Column, chunks: Column, version: str = "p2.2") -> Column:
    """Hash of everything that is embedded for a note (H-02)."""
    return content_hash(F.concat_ws("\u0001", F.lit(version), head, chunks))


def shard_of(key: Column, shards: int = 16) -> Column:
    """Cache shard of an id (H-03)."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def stable_id(prefix: str, ids: Column) -> Column:
    """An id from its contents: the first fifty ids in order, hashed (H-04)."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(content_hash(F.array_join(F.slice(F.array_sort(ids), 1, 50), "|")), 1, 10))


def sentence_units(line: Column) -> Column:
    """A line cut after sentence ends (front half of K-02)."""
    return F.split(F.regexp_replace(line, f"([.!?…]){P.WS}+", "$1\u0001"), "\u0001")


# The same functions as SQL text for the twins.


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rewrite(expression: str, steps: Iterable[P.Rewrite]) -> str:
    for step in steps:
        pattern, by = step.re2
        expression = f"regexp_replace({expression}, {literal(pattern)}, {literal(by)}, 'g')"
    return expression


def sql_trim(expression: str) -> str:
    return sql_rewrite(expression, [P.TRIM])


def sql_clean_lines(expression: str) -> str:
    cleaned = sql_rewrite(f"coalesce({expression}, '')", P.CLEANING)
    return f"list_filter(list_transform(string_split({cleaned}, chr(10)), lambda l: {sql_trim('l')}), lambda l: l <> '')"


def sql_normalize(expression: str) -> str:
    return sql_trim(sql_rewrite(f"lower({expression})", [P.DIGITS, P.SPACES]))


def sql_tokens(expression: str) -> str:
    stop = ", ".join(literal(w) for w in sorted(P.STOP_WORDS))
    return f"list_filter(regexp_extract_all(replace(lower({expression}), 'ё', 'е'), {literal(P.WORD)}, 1), lambda t: NOT list_contains([{stop}], t))"


def sql_file_name(expression: str) -> str:
    clean = sql_rewrite(f"substr({sql_trim(sql_rewrite(expression, [P.FILE_ILLEGAL, P.SPACES]))}, 1, 100)", [P.FILE_TAIL])
    return f"coalesce(nullif({clean}, ''), 'Untitled index')"
