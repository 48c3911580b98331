"""Benchmark decontamination with suffix arrays over the training documents.

The words of a shard of documents form one sequence, with a gap between documents.  Its suffix array
orders the positions by the words that follow.  Every suffix of every benchmark item is looked up by
binary search in every shard: the suffixes of the array on both sides give its longest verbatim match and where it
stands, and the range of suffixes that begin with the same window of words gives all documents that have it.
Each such place is extended in both directions to the whole passage that item and document share.  Words that no
item has cannot begin a match, so their positions are left out of the array and they count as a gap.

The benchmark is a stated query set.  It is searched in passes of at most PASS_BYTES of text (an item larger than
that is a pass), which are what is broadcast, each in blocks of a bounded number of distinct words.
Documents never leave their task; only found matches do.

Defined cases.  Null and empty texts have no words.  An item without words has no window; one of fewer
words than a window is one window.  Items of the same text or the same id all count once by item id.  A
null item id is the string ``null``.  An empty benchmark or table hits nothing.  Repeated documents are
treated alike, each by itself; rows of null or equal id are told apart by their texts.  Very long ones are spread
over shards with overlap, so nothing is cut but the lengths of passages across such a border.  Of equally long matches
the one of the smallest document id and place is named.  Further columns of the documents may have any names:
``filter_contaminated`` carries them along, the others don't read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, batches, materialize, slices, two

#: Bytes that separate words become blanks, A-Z become a-z.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: Words to a sort key, keys to a suffix: suffixes are ordered by KEYS * PER_KEY words, which covers a window.
PER_KEY, KEYS = 4, 3
DEPTH = PER_KEY * KEYS
WORD_LIMIT = (1 << 16) - 2
#: Text of the benchmark that is searched, and broadcast, at once.
PASS_BYTES = 32 << 20


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Block:
    """Items whose distinct words fit in 16 bits; 0 stands for any other word."""

    ids: dict[bytes, int]
    words: np.ndarray  # uint16, items one after another with DEPTH zeros after each
    starts: np.ndarray  # each test suffix's place in words
    left: np.ndarray  # words of its item from there on
    item: np.ndarray  # number of its item in names
    offset: np.ndarray  # its place in the item
    window: np.ndarray  # words of the window that begins there, 0: none
    names: list[str]


def make_blocks(items: list[tuple[str, bytes]], window: int, word_limit: int = WORD_LIMIT) -> list[Block]:
    """Split the items into blocks by their number of distinct words."""
    if window > DEPTH:
        raise ValueError(f"a window has at most {DEPTH} words")
    blocks: list[Block] = []
    held: list[tuple[str, int, list[bytes]]] = []
    seen: set[bytes] = set()
    for item, text in sorted(items):
        words = split_words(text)
        # An item of too many distinct words: runs that overlap by a window have the same windows.
        size = len(words) if len(set(words)) <= word_limit else word_limit
        for k in range(0, max(1, len(words) - window + 1), max(1, size - window)):
            part = words[k : k + size]
            if held and len(seen | set(part)) > word_limit:
                blocks.append(_block(held, window))
                held, seen = [], set()
            if part:
                held.append((item, k, part))
                seen |= set(part)
            if k + size >= len(words):
                break
    return [*blocks, _block(held, window)] if held else blocks


def _block(parts: list[tuple[str, int, list[bytes]]], window: int) -> Block:
    ids = {w: n for n, w in enumerate(sorted({w for _, _, words in parts for w in words}), 1)}
    names = sorted({item for item, _, _ in parts})
    number = {item: n for n, item in enumerate(names)}
    flat, starts, left, item_of, offset, sizes = [], [], [], [], [], []
    for item, first, words in parts:
        n, whole = len(words), min(window, len(words))
        starts += range(len(flat), len(flat) + n)
        left += range(n, 0, -1)
        item_of += [number[item]] * n
        offset += range(first, first + n)
        sizes += [whole if k + whole <= n and (first == 0 or n >= window) else 0 for k in range(n)]
        flat += [ids[w] for w in words] + [0] * DEPTH
    return Block(ids, np.array(flat + [0] * 4, np.uint16), *(np.array(v, np.int64) for v in (starts, left, item_of, offset, sizes)), names)


def keys_at(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first DEPTH words from each position, four to an unsigned 64-bit key."""
    w = words.astype(np.uint64)
    four = w[: len(w) - 3] << np.uint64(48) | w[1 : len(w) - 2] << np.uint64(32) | w[2 : len(w) - 1] << np.uint64(16) | w[3:]
    return [four[at + PER_KEY * k] for k in range(KEYS)]


def search(sorted_keys: list[np.ndarray], wanted: list[np.ndarray], equal: bool = False) -> np.ndarray:
    """How many suffixes are less than each wanted one, or equal to it if asked for, by binary search on all at once."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(sorted_keys[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) >> 1, 0)
        less, same = np.zeros(len(mid), bool), open_.copy()
        for have, want in zip(sorted_keys, wanted, strict=True):
            h = have[mid]
            less |= same & (h < want)
            same &= h == want
        less |= same & equal
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


class Shard:
    """The suffix array of a shard against one block."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.concatenate([words, np.zeros(DEPTH + 3, np.uint16)])
        at = np.flatnonzero(self.words)
        keys = keys_at(self.words, at)
        order = np.lexsort(keys[::-1])
        self.array, self.keys = at[order], [k[order] for k in keys]

    def look_up(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the range of the array's suffixes that begin with its window (empty without one)."""
        ranges, at = np.zeros((2, len(block.starts)), np.int64), np.flatnonzero(block.window)
        ranges[:, at] = self._range(block, at, block.window[at])
        return ranges[0], ranges[1]

    def _range(self, block: Block, which: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the array's suffixes that begin with so many words of the test suffixes begin and end."""
        words = block.words[block.starts[which, None] + np.arange(DEPTH)]
        inside, every = np.arange(DEPTH) < sizes[:, None], np.arange(len(which)) * DEPTH
        low, high = (search(self.keys, keys_at(np.append(np.where(inside, words, fill).astype(np.uint16), np.zeros(3, np.uint16)), every), equal=fill > 0) for fill in (0, 0xFFFF))
        return low, high

    def longest(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the length of its longest verbatim match and the first place of one (-1: none)."""
        best, where = np.zeros(len(block.starts), np.int64), np.full(len(block.starts), -1, np.int64)
        if not len(self.array):
            return best, where
        wanted = keys_at(block.words, block.starts)
        at = search(self.keys, wanted)
        for side in (at - 1, at):
            near = self.array[np.clip(side, 0, len(self.array) - 1)]
            size = self.common(block, np.arange(len(at)), near)
            size[(side < 0) | (side >= len(self.array))] = 0
            best = np.maximum(best, size)
        # Suffixes that share a match, up to DEPTH words of it, stand together; beyond DEPTH words in no further order.
        depth = np.minimum(best, DEPTH)
        low, high = self._range(block, np.arange(len(at)), depth)
        short = np.flatnonzero((best > 0) & (best < DEPTH))
        ranges, own = np.unique(np.stack([low[short], high[short]], axis=1), axis=0, return_inverse=True)
        if len(ranges):
            where[short] = np.minimum.reduceat(np.append(self.array, len(self.words)), ranges.ravel())[::2][own.ravel()]
        for some in _pieces(np.where(depth == DEPTH, high - low, 0)):
            which, place = _spread(low, high, some)
            size = self.common(block, which, self.array[place])
            order = np.lexsort((self.array[place], -size, which))
            head = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
            best[which[head]], where[which[head]] = size[head], self.array[place[head]]
        return best, where

    def common(self, block: Block, which: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Words that each test suffix and the place beside it share from there on."""
        starts, left = block.starts[which], block.left[which]
        size, live, n = np.zeros(len(near), np.int64), np.arange(len(near)), 0
        while len(live):
            live = live[(n < left[live]) & (near[live] + n < len(self.words))]
            a, b = block.words[starts[live] + n], self.words[near[live] + n]
            live = live[(a == b) & (b != 0)]
            size[live] += 1
            n += 1
        return size


def _pieces(n: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Numbers of suffixes in runs of about ``most`` places together."""
    at = np.flatnonzero(n)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[at]) // most)) + 1
    yield from (p for p in np.split(at, cuts) if len(p))


def _spread(low: np.ndarray, high: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = high[some] - low[some]
    return np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)


@dataclass
class Hits:
    """What a block has in a shard: hit words, and passages as rows of (document, item number, place in item, place, words)."""

    marks: np.ndarray
    passages: np.ndarray


def hits(shard: Shard, bounds: np.ndarray, block: Block) -> Hits:
    """bounds: the documents' starts and the end."""
    marks, found = np.zeros(len(shard.words) + 1, np.int32), []
    low, high = shard.look_up(block)
    for some in _pieces(high - low):
        which, place = _spread(low, high, some)
        at = shard.array[place]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + block.window[which], -1)
        # Passages: places where the words before differ, extended to the right.
        begins = block.starts[which]
        before = np.where(at > 0, shard.words[at - 1], 0)
        first = (before == 0) | (begins == 0) | (before != block.words[begins - 1])
        which, at = which[first], at[first]
        doc = np.searchsorted(bounds, at, side="right") - 1
        found.append(np.stack([doc, block.item[which], block.offset[which], at - bounds[doc], shard.common(block, which, at)], axis=1))
    return Hits(np.cumsum(marks)[: bounds[-1]] > 0, np.concatenate(found) if found else np.zeros((0, 5), np.int64))


PASSAGE = pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("words", pa.int64())])
RESULT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.int64())), ("passages", pa.list_(PASSAGE))])
RESULT_DDL = "_id long, n_words long, n_hit long, items array<string>, hit_spans array<long>, passages array<struct<item:string,item_at:long,at:long,words:long>>"


def _shards(texts: list[bytes], limit: int) -> Iterator[tuple[list[tuple[int, int, int]], list[list[bytes]]]]:
    """Documents, or overlapping parts of very long ones, in shards of at most about ``limit`` words.

    A part is (document, its first word's place, words of it that a later part repeats).
    """
    parts, words, total = [], [], 0
    for n, text in enumerate(texts):
        own = split_words(text)
        for at in range(0, max(1, len(own)), limit):
            piece = own[at : at + limit + DEPTH]
            if parts and total + len(piece) > limit:
                yield parts, words
                parts, words, total = [], [], 0
            parts.append((n, at, len(own)))
            words.append(piece)
            total += len(piece)
    if parts:
        yield parts, words


def _coded(words: list[list[bytes]], bounds: np.ndarray, block: Block) -> np.ndarray:
    code, flat = block.ids.get, np.zeros(bounds[-1], np.uint16)
    for k, own in enumerate(words):
        flat[bounds[k] : bounds[k] + len(own)] = [code(w, 0) for w in own]
    return flat


def _spans(marked: list[np.ndarray]) -> list[int]:
    """Start, end, start, ... of the runs among the marked places."""
    if not marked:
        return []
    own = np.unique(np.concatenate(marked))
    cuts = np.flatnonzero(np.diff(own) > 1)
    return np.stack([own[np.concatenate([[0], cuts + 1])], own[np.concatenate([cuts, [-1]])] + 1], axis=1).ravel().tolist()


def _scan(shared: list, limit: int, schema: pa.Schema = RESULT):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = [b.value for b in shared]
        for batch in slices(it):
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            counts, marks, passages = [0] * len(ids), {}, {}
            for parts, words in _shards(texts, limit):
                bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
                for n, _, size in parts:
                    counts[n] = size
                for block in blocks:
                    found = hits(Shard(_coded(words, bounds, block)), bounds, block)
                    if not len(found.passages):
                        continue
                    for k in np.unique(found.passages[:, 0]).tolist():
                        n, first, _ = parts[k]
                        marks.setdefault(n, []).append(np.flatnonzero(found.marks[bounds[k] : bounds[k + 1] - 1]) + first)
                        passages.setdefault(n, []).extend((block.names[i], o, p + first, w) for _, i, o, p, w in found.passages[found.passages[:, 0] == k].tolist())

            def rows(ids=ids, counts=counts, marks=marks, passages=passages):
                for n, i in enumerate(ids):
                    own, spans = sorted(set(passages.get(n, ())), key=lambda p: (p[2], -p[3], p[0], p[1])), _spans(marks.get(n, []))
                    yield i, counts[n], sum(spans[1::2]) - sum(spans[::2]), sorted({p[0] for p in own}), spans, [dict(zip(("item", "item_at", "at", "words"), p, strict=True)) for p in own]

            yield from batches(rows(), schema)

    return run


def passes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> Iterator[list]:
    """The stated items as lists of broadcast blocks, each list of a bounded size of text."""
    stated = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[item_text_col].cast("string").alias("t")).where("t is not null")
    sc = benchmark.sparkSession.sparkContext
    held, size, given = [], 0, False
    for r in stated.toLocalIterator():
        text = r.t.encode()
        if held and size + len(text) > PASS_BYTES:
            yield [sc.broadcast(b) for b in make_blocks(held, window)]
            held, size, given = [], 0, True
        held.append(("null" if r.i is None else r.i, text))
        size += len(text)
    if held or not given:
        yield [sc.broadcast(b) for b in make_blocks(held, window)]


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the results of all passes for a text."""
    for batch in it:
        def rows(batch=batch):
            for i, n, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                marks = [np.arange(a, b) for m in more or () for a, b in zip(m["hit_spans"][::2], m["hit_spans"][1::2], strict=True)]
                spans = _spans(marks)
                own = sorted((p for m in more or () for p in m["passages"]), key=lambda p: (p["at"], -p["words"], p["item"], p["item_at"]))
                yield i, n, sum(spans[1::2]) - sum(spans[::2]), sorted({p["item"] for p in own}), spans, own

        yield from batches(rows(), RESULT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, shard_words: int = 1_000_000) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted strings), hit_spans (word offsets: start, end, start, ...) and passages.

    A passage is what a document and an item share around a window: item, its word offset there and in the
    document, and its words, longest first among those of one place.
    """
    src = two(docs, id_col, text_col)
    src = src.select(src["_id"].cast("long").alias("_id"), "_text")
    every = list(passes(benchmark, item_col, item_text_col, window))
    if len(every) == 1:
        return src.mapInArrow(_scan(every[0], shard_words), RESULT_DDL).withColumnRenamed("_id", id_col)
    # One pass at a time: only texts with hits are kept of each, under the id and a hash of the text.
    key, keyed_ddl = F.concat_ws(":", "_id", F.md5("_text")), RESULT_DDL.replace("_id long", "_id string")
    keyed, found = src.select(key.alias("_id"), "_text"), None
    for blocks in every:
        hit = keyed.mapInArrow(_scan(blocks, shard_words, RESULT.set(0, pa.field("_id", pa.string()))), keyed_ddl).where("n_hit > 0")
        hit = materialize(hit.dropDuplicates(["_id"]), "passages")
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy(F.col("_id").alias("_key")).agg(F.collect_list(F.struct("hit_spans", "passages")).alias("_found"))  # a row for each pass at most
    counts = src.select("_id", "_text", key.alias("_key")).mapInArrow(_count, "_id long, _key string, n_words long")
    out = counts.join(found, "_key", "left").select("_id", "n_words", "_found").mapInArrow(_merge, RESULT_DDL)
    return out.withColumnRenamed("_id", id_col)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n = [len(split_words(t)) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["_id", "_key", "n_words"])


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, shard_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without a word in an occurrence of a window."""
    at = docs.columns.index(text_col)

    def clean(scan):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(it):
                places = pa.array(range(batch.num_rows), pa.int64())
                kept = [n for found in scan(iter([pa.RecordBatch.from_arrays([places, batch.column(at)], ["_id", "_text"])])) for n, hit in zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True) if not hit]
                yield batch.take(pa.array(kept, pa.int64()))

        return run

    every = list(passes(benchmark, item_col, item_text_col, window))
    for n, blocks in enumerate(every):
        docs = docs.mapInArrow(clean(_scan(blocks, shard_words)), docs.schema)
        docs = docs if n + 1 == len(every) else materialize(docs, "clean")
    return docs


LONGEST_DDL = "item string, item_at long, words long, _id long, at long"


def _longest(shared: list, limit: int):
    schema = pa.schema([("item", pa.string()), ("item_at", pa.int64()), ("words", pa.int64()), ("_id", pa.int64()), ("at", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = [b.value for b in shared]
        best = [[(0, None, 0)] * len(b.starts) for b in blocks]  # (words, document, place)
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            order = sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0))
            for parts, words in _shards([texts[n] for n in order], limit):
                bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
                for block, own in zip(blocks, best, strict=True):
                    size, where = Shard(_coded(words, bounds, block)).longest(block)
                    for k in np.flatnonzero(size).tolist():
                        doc = int(np.searchsorted(bounds, where[k], side="right")) - 1
                        n, first, _ = parts[doc]
                        now = (int(size[k]), ids[order[n]], int(where[k] - bounds[doc]) + first)
                        was = own[k]
                        if (-now[0], now[1] is None, now[1] or 0, now[2]) < (-was[0], was[1] is None, was[1] or 0, was[2]):
                            own[k] = now
        for block, own in zip(blocks, best, strict=True):
            yield from batches(((block.names[int(block.item[k])], int(block.offset[k]), *b) for k, b in enumerate(own)), schema)

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, shard_words: int = 1_000_000) -> DataFrame:
    """Per test suffix: item, item_at, words of its longest verbatim match in any document (0: none), and that document's id and the word offset there (``at``)."""
    src = two(docs, id_col, text_col)
    src = src.select(src["_id"].cast("long").alias("_id"), "_text")
    found = None
    for blocks in passes(benchmark, item_col, item_text_col, window):
        part = src.mapInArrow(_longest(blocks, shard_words), LONGEST_DDL)
        found = part if found is None else found.unionByName(part)
    first = F.min(F.struct((-F.col("words")).alias("w"), F.col("_id").isNull().alias("n"), "_id", "at"))
    best = found.groupBy("item", "item_at").agg(first.alias("b"))
    none = F.col("b.w") == 0
    return best.select("item", "item_at", (-F.col("b.w")).alias("words"), F.when(~none, F.col("b._id")).alias(id_col), F.when(~none, F.col("b.at")).alias("at"))
