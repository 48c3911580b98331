"""Language-model scores by a weighted backoff automaton.

Counts of single words cover all training documents and every word.  Every longer n-gram that occurs at least
MIN_COUNT times in the training documents enters the automaton, so it grows with the corpus and is never
gathered in one place.  N-grams are smoothed by absolute discounting, interpolated with the next shorter
context, so each state's probabilities sum to one.  States are the contexts of kept n-grams, a failure arc leads from a
context to the longest shorter one and carries its backoff weight.

Documents are encoded in blocks with a dictionary of their own.  Each block's distinct words and n-grams go, packed,
to buckets by a hash of the word or the context, where their counts are summed.  Every block gets back the counts and the contexts' weights of its own words and n-grams only: the part of
the automaton that its documents can reach.  All positions of a block walk it at once.  The contexts of the most
frequent words (at most HOT_WORDS of them, a matter of load only) are split over several buckets.  Words are told
apart by 64-bit hashes, n-grams by 64 bits made of the context and 40 or 48 bits of the last word.

Defined cases.  Null is empty; an empty text is the end token alone.  Rows of null id are scored, not learnt
from, and count as not held out.  Rows that share an id are documents each.  Without training tokens N = V = 0
and every token has the probability of an unknown word, 1.  Very long texts are one document of a block, whole.  Ties don't
arise: counts and hashes settle all orders.  An empty table gives an empty table.  Columns besides id and text are
not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, materialize, mix64

#: The end token; as white space it can't be a word.
END = b"\n"
ADD = 0.1
DISCOUNT = 0.75
BLOCK_TOKENS, BLOCK_WORDS = 2_000_000, 1_000_000
#: Training occurrences from which an n-gram is kept, at every size of the corpus.
MIN_COUNT = 2
BUCKET_TOKENS, HOT_WORDS = 1_000_000, 200


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    words.append(END)
    return words


class _Codes(dict):
    """word -> number in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack_codes(codes: np.ndarray) -> bytes:
    """24-bit numbers as a plane of 16 bits and one of 8."""
    return codes.astype(np.uint16).tobytes() + (codes >> 16).astype(np.uint8).tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, np.uint16, n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16


BLOCK = [("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("hashes", pa.binary())]
ENCODED = pa.schema([("block", pa.int64()), *BLOCK])
ENCODED_DDL = "block long, ids array<long>, held_out array<boolean>, learn array<boolean>, sizes array<long>, codes binary, hashes binary"


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents as codes of the block's dictionary, and the hashes of the dictionary's words."""
    part, chunk = TaskContext.get().partitionId(), 0

    def whole(codes: _Codes, docs: list[tuple]) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes)).tobytes()
        codes_of = pack_codes(np.concatenate([unpack_codes(d[3]) for d in docs]))
        own = [[d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], [len(d[3]) // 3 for d in docs], codes_of, hashes]
        return pa.RecordBatch.from_arrays([pa.array([part << 24 | chunk], pa.int64()), *(pa.array([v], f[1]) for v, f in zip(own, BLOCK, strict=True))], schema=ENCODED)

    codes, docs, held = _Codes(), [], 0
    for batch in it:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            rest = [piece.column(k).to_pylist() for k in (0, 2, 3)]
            for text, i, h, l in zip(as_bytes(piece.column(1)), *rest, strict=True):
                own = tokens_of(text)
                docs.append((i, h, l, pack_codes(np.fromiter(map(codes.__getitem__, own), np.int64, len(own)))))
                held += len(own)
                if held >= BLOCK_TOKENS or len(codes) >= BLOCK_WORDS:
                    yield whole(codes, docs)
                    codes, docs, held, chunk = _Codes(), [], 0, chunk + 1
    if docs:
        yield whole(codes, docs)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


class Hot:
    """The most frequent words' hashes and into how many parts their contexts are split."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int) -> None:
        by = np.argsort(words)
        self.words = words[by]
        self.parts = -(-counts[by] * HOT_WORDS // max(total, 1))

    def parts_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.parts[at], 1)

    def contexts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(part, context) of all contexts that are split, sorted by part."""
        parts, keys = self.parts, self.words
        if order == 3:
            keys = pair_hash(np.repeat(self.words, len(self.words)), np.tile(self.words, len(self.words)))
            parts = np.minimum(np.repeat(self.parts, len(self.parts)), np.tile(self.parts, len(self.parts)))
        keys, parts = keys[parts > 1], parts[parts > 1]
        which = np.repeat(keys, parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        part = part_hash(which, nth.astype(np.uint64))
        at = np.argsort(part)
        return part[at], which[at]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def part_hash(context: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(context + nth * np.uint64(0xD1B54A32D192ED03))


WIDTH = {2: 6, 3: 5}  # bytes of the last word's hash


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order of first appearance, and each key's number among them."""
    which, distinct = pd.factorize(keys)
    return distinct, which


class Grams:
    """The distinct n-grams of a block, ordered by the part of the context they are sent to."""

    def __init__(self, order: int, codes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, hot: Hot, buckets: int) -> None:
        first = np.cumsum(sizes) - sizes
        inside = np.arange(len(codes)) - np.repeat(first, sizes)
        self.at = np.flatnonzero(inside >= order - 1)  # positions of last words
        del inside
        key = codes[self.at - 1] << 24 | codes[self.at]
        if order == 3:
            pairs, which = numbered(codes[self.at - 2] << 24 | codes[self.at - 1])
            key = which << 24 | codes[self.at]
            del which
        distinct, which = numbered(key)
        del key
        before, last = distinct >> 24, hashes[distinct & 0xFFFFFF]
        if order == 3:
            a, b = hashes[pairs >> 24], hashes[pairs & 0xFFFFFF]
            context, parts = pair_hash(a, b)[before], np.minimum(hot.parts_of(a), hot.parts_of(b))[before]
        else:
            context, parts = hashes[before], hot.parts_of(hashes)[before]
        part = part_hash(context, last % parts.astype(np.uint64))
        by = np.argsort(part, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.which = place[which]  # of each position
        self.context, self.last, self.part = context[by], last[by] & np.uint64((1 << 8 * WIDTH[order]) - 1), part[by]
        bucket = (self.part >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.buckets, starts = np.unique(bucket.astype(np.int64), return_index=True)  # in order, as the parts are
        self.limits = np.append(starts, len(bucket))

    def of(self, bucket: int) -> slice:
        at = np.searchsorted(self.buckets, bucket)
        return slice(self.limits[at], self.limits[at + 1])


class Words:
    """The words of a block, ordered by the bucket they are sent to."""

    def __init__(self, hashes: np.ndarray, buckets: int) -> None:
        self.by = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.by]
        bucket = (self.sorted >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.buckets, starts = np.unique(bucket.astype(np.int64), return_index=True)
        self.limits = np.append(starts, len(bucket))

    def of(self, bucket: int) -> slice:
        at = np.searchsorted(self.buckets, bucket)
        return slice(self.limits[at], self.limits[at + 1])


WORDS_DDL = "block long, bucket int, words binary, n binary"


def _send_words(buckets: int):
    """Packed words of each block with their training counts, a row for each bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                codes, sizes, hashes = _block(row)
                words = Words(hashes, buckets)
                n = np.bincount(codes[np.repeat(np.array(row["learn"], bool), sizes)], minlength=len(hashes))[words.by]
                for b in words.buckets.tolist():
                    own = words.of(b)
                    values = [_planes(np.diff(words.sorted[own], prepend=np.uint64(0))), _planes(n[own], 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([b], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["block", "bucket", "words", "n"])

    return run


def _sum_words(total: int):
    """Per block: totals of its words.  With block -1: the bucket's most frequent words, their totals, and how many words were learnt."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, blocks = rows.column("bucket")[0].as_py(), rows.column("block").to_pylist()
        each = [np.cumsum(_from_planes(v)) for v in rows.column("words").to_pylist()]
        n = np.concatenate([_from_planes(v, 4) for v in rows.column("n").to_pylist()])
        words, which = numbered(np.concatenate(each))
        totals = np.bincount(which, weights=n).astype(np.int64)
        pack = lambda x: zlib.compress(_planes(x), 1)
        out, at = [], 0
        for block, own in zip(blocks, each, strict=True):
            out.append((block, 1, bucket, pack(totals[which[at : at + len(own)]]), None, None))
            at += len(own)
        hot = totals * HOT_WORDS > total
        out.append((-1, 1, bucket, pack(words[hot]), pack(totals[hot]), pack(np.array([(totals > 0).sum()]))))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(COUNTED)], schema=COUNTED)

    return run


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_codes(row["codes"]), np.array(row["sizes"], np.int64), np.frombuffer(row["hashes"], np.uint64)


GRAMS_DDL = "block long, bucket int, parts binary, runs binary, last binary, n binary"
COUNTED = pa.schema([("block", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("sums", pa.binary()), ("kinds", pa.binary())])
COUNTED_DDL = "block long, order int, bucket int, totals binary, sums binary, kinds binary"


def _runs(part: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [len(part)]])


def _send(order: int, hot, buckets: int):
    """Packed distinct n-grams of each block with their training counts, a row for each bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                codes, sizes, hashes = _block(row)
                g = Grams(order, codes, sizes, hashes, hot.value, buckets)
                learn = np.repeat(np.array(row["learn"], bool), sizes)[g.at]
                n = np.bincount(g.which[learn], minlength=len(g.part))
                for b in g.buckets.tolist():
                    own = g.of(b)
                    runs = _runs(g.part[own])
                    starts = g.part[own][runs[:-1]]
                    values = [_planes(np.diff(starts, prepend=np.uint64(0))), _planes(np.diff(runs), 4), _planes(g.last[own], WIDTH[order]), _planes(n[own], 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([b], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["block", "bucket", "parts", "runs", "last", "n"])

    return run


def _sum(order: int, least: float, split):
    """Per block: totals of kept n-grams (else 0) and, for each context, the sum and number of its kept n-grams.

    Split contexts are also given once for each part, with block -1, since other buckets hold the rest.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        blocks = rows.column("block").to_pylist()
        read = lambda name, width: [_from_planes(v, width) for v in rows.column(name).to_pylist()]
        lengths = [r.astype(np.int64) for r in read("runs", 4)]
        starts = np.concatenate([np.cumsum(d) for d in read("parts", 8)])
        every = np.concatenate(lengths)
        contexts, run = numbered(starts)  # of each run of n-grams with one context
        context = np.repeat(run, every)
        last, n = np.concatenate(read("last", WIDTH[order])), np.concatenate(read("n", 4)).astype(np.int64)
        which = numbered(pair_hash(np.repeat(starts, every), last))[1]
        total = np.bincount(which, weights=n).astype(np.int64)
        total[total < least] = 0
        own = np.empty(len(total), np.int64)
        own[which] = context  # of each distinct n-gram
        sums = np.bincount(own, weights=total, minlength=len(contexts)).astype(np.int64)
        kinds = np.bincount(own[total > 0], minlength=len(contexts))
        out, at, at_run = [], 0, 0
        pack = lambda x: zlib.compress(_planes(x), 1)
        for block, r in zip(blocks, lengths, strict=True):
            size, seen = int(r.sum()), run[at_run : at_run + len(r)]
            out.append((block, order, bucket, pack(total[which[at : at + size]]), pack(sums[seen]), pack(kinds[seen])))
            at, at_run = at + size, at_run + len(r)
        parts = split.value[0]
        if (seen := np.flatnonzero(np.isin(contexts, parts))).size:
            out.append((-1, order, bucket, pack(contexts[seen]), pack(sums[seen]), pack(kinds[seen])))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(COUNTED)], schema=COUNTED)

    return run


class Automaton:
    """States 0 (no context) and one for each kept context; arcs, failure arcs and backoff weights."""

    def __init__(self, words: dict[bytes, int], word_counts: np.ndarray, grams: list[dict[tuple[int, ...], int]], total: int, distinct: int) -> None:
        """grams: kept n-grams by length, from 2, with their training counts."""
        self.words = words
        self.total, self.distinct = total, distinct
        counts: dict[tuple[int, ...], int] = {(v,): int(word_counts[v]) for v in words.values()}
        for own in grams:
            counts |= own
        follow: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for own in grams:
            for gram, n in own.items():
                follow[gram[:-1]].append((gram[-1], n))
        states = {(): 0} | {c: k for k, c in enumerate(sorted(follow, key=lambda c: (len(c), c)), 1)}

        def state_of(context: tuple[int, ...]) -> int:
            while context not in states:
                context = context[1:]
            return states[context]

        self.size = len(words)
        self.fail, self.back = [0] * len(states), [0.0] * len(states)
        self.arcs: dict[int, tuple[float, int]] = {}
        unigram = {v: (int(word_counts[v]) + ADD) / (total + ADD * (distinct + 1)) for v in words.values()}
        for v, p in unigram.items():
            self.arcs[v] = float(np.log10(p)), state_of((v,))
        prob: dict[tuple[int, ...], float] = {(v,): p for v, p in unigram.items()}
        lam: dict[tuple[int, ...], float] = {}

        def p_of(context: tuple[int, ...], v: int) -> float:
            scale = 1.0
            while True:
                if (known := prob.get((*context, v))) is not None:
                    return scale * known
                scale *= lam.get(context, 1.0)
                context = context[1:]

        for context, s in states.items():
            if not context:
                continue
            whole = counts[context]
            lam[context] = 1 - sum(n - DISCOUNT for _, n in follow[context]) / whole
            self.fail[s], self.back[s] = state_of(context[1:]), float(np.log10(lam[context]))
            for v, n in follow[context]:
                prob[(*context, v)] = p = (n - DISCOUNT) / whole + lam[context] * p_of(context[1:], v)
                self.arcs[s * self.size + v] = float(np.log10(p)), state_of((*context, v))
        self.fall = [0.0] * len(states)  # all weights from a state down to no context
        for s in range(1, len(states)):
            self.fall[s] = self.back[s] + self.fall[self.fail[s]]

    def score(self, numbers: list[int], plain: list[float]) -> float:
        """log10 probability of a document: its words' numbers (-1: no state reads it) and single-word log-probabilities."""
        arcs, size, fail, back, fall = self.arcs, self.size, self.fail, self.back, self.fall
        total, s = 0.0, 0
        for v, p in zip(numbers, plain, strict=True):
            if v < 0:
                total += fall[s] + p
                s = 0
                continue
            arc = arcs.get(s * size + v)
            while arc is None:
                total += back[s]
                s = fail[s]
                arc = arcs.get(s * size + v)
            total += arc[0]
            s = arc[1]
        return total


SCORED = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _unpack(data: bytes) -> np.ndarray:
    return _from_planes(zlib.decompress(data)).astype(np.int64)


def _walk(codes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, word_counts: np.ndarray, plain: np.ndarray, order: int, found: dict[int, list[tuple]], hot: Hot, buckets: int, split: dict[int, tuple]) -> np.ndarray:
    """log10 probability of each position, by the arcs and failure arcs that the block's n-grams reach.

    found: by order, (bucket, totals, sums, kinds) as sent back.  split: by order, the contexts over several buckets with
    their sums and numbers.  A position whose context is no state, or has no arc for the word, goes on from the
    next shorter context with the backoff weight of the one it left.
    """
    out = plain[codes]  # so far: from the state without context
    prob = 10.0**out
    size_of = word_counts[codes].astype(np.float64)  # training count of the (n - 1)-gram that ends at a position
    for n in range(2, order + 1):
        g = Grams(n, codes, sizes, hashes, hot, buckets)
        totals, sums, kinds = (np.zeros(len(g.part), np.int64) for _ in range(3))
        for bucket, *data in found.get(n, ()):
            own = g.of(bucket)
            lengths = np.diff(_runs(g.part[own]))
            totals[own] = _unpack(data[0])
            sums[own], kinds[own] = (np.repeat(_unpack(d), lengths) for d in data[1:])
        keys, all_sums, all_kinds = split[n]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, g.context), len(keys) - 1)
            hit = keys[at] == g.context
            sums[hit], kinds[hit] = all_sums[at[hit]], all_kinds[at[hit]]
        at, which = g.at, g.which
        del g
        state = kinds[which] > 0
        at, which = at[state], which[state]
        whole, t = size_of[at - 1], totals[which]
        back = 1 - (sums[which] - DISCOUNT * kinds[which]) / whole
        arc = t > 0
        prob[at] = np.where(arc, (t - DISCOUNT) / whole, 0.0) + back * prob[at]
        out[at] = np.where(arc, np.log10(prob[at]), np.log10(back) + out[at])
        size_of = np.zeros(len(codes))
        size_of[at] = t
    return out


SCORED = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, distinct: int, order: int, hot, buckets: int, split):
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SCORED.empty_table()
        row = docs.to_pylist()[0]
        codes, sizes, hashes = _block(row)
        found: dict[int, list[tuple]] = defaultdict(list)
        for r in sent.select(["order", "bucket", "totals", "sums", "kinds"]).to_pylist():
            found[r["order"]].append((r["bucket"], r["totals"], r["sums"], r["kinds"]))
        counts, words = np.zeros(len(hashes), np.int64), Words(hashes, buckets)
        for bucket, totals, _, _ in found[1]:
            counts[words.by[words.of(bucket)]] = _unpack(totals)
        plain = np.log10((counts + ADD) / (total + ADD * (distinct + 1)))
        each = _walk(codes, sizes, hashes, counts, plain, order, found, hot.value, buckets, split.value)
        first = np.cumsum(sizes) - sizes  # every document has a token
        known, base, score = (np.add.reduceat(x, first) for x in ((counts[codes] > 0).astype(np.int64), plain[codes], each))
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(score)], schema=SCORED)

    return run


def score_documents(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = 3, gram_share: float = 0.0) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (single words) and score (the automaton's).

    N-grams of at least MIN_COUNT training occurrences are kept; ``gram_share`` asks for a least share of the
    training tokens besides.
    """
    if order > 3:
        raise ValueError("n-grams of at most three words are told apart")
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"), held_out.alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"))
    encoded = materialize(src.mapInArrow(_encode, ENCODED_DDL), "encoded")
    tokens = F.zip_with("sizes", "learn", lambda n, yes: F.when(yes, n).otherwise(0))
    total = int(encoded.agg(F.sum(F.aggregate(tokens, F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0)
    buckets = max(1, -(-total // BUCKET_TOKENS))
    blocks = encoded.select("block", "learn", "sizes", "codes", "hashes")
    counted = blocks.mapInArrow(_send_words(buckets), WORDS_DDL).groupBy("bucket").applyInArrow(_sum_words(total), COUNTED_DDL)
    sent = materialize(counted, "word-counts")
    about = sent.where("block < 0").select("totals", "sums", "kinds").collect()  # at most HOT_WORDS words, and a number for each bucket
    distinct = sum(int(_unpack(bytes(r.kinds))[0]) for r in about)
    frequent = [np.concatenate([np.zeros(0, np.int64), *(_unpack(bytes(r[c])) for r in about)]) for c in ("totals", "sums")]
    hot = sc.broadcast(Hot(frequent[0].astype(np.uint64), frequent[1], total))
    sent = sent.where("block >= 0")

    split = {}
    for n in range(2, order + 1):
        parts = sc.broadcast(hot.value.contexts(n))
        packed = blocks.mapInArrow(_send(n, hot, buckets), GRAMS_DDL)
        grams = materialize(packed.groupBy("bucket").applyInArrow(_sum(n, max(MIN_COUNT, gram_share * total), parts), COUNTED_DDL), f"grams-{n}")
        split[n] = _whole(parts.value, grams.where("block < 0").select("totals", "sums", "kinds").collect())
        sent = sent.unionByName(grams.where("block >= 0"))
    pairs = encoded.groupBy("block").cogroup(sent.groupBy("block"))
    return pairs.applyInArrow(_score(total, distinct, order, hot, buckets, sc.broadcast(split)), SCORED_DDL).withColumnRenamed("_id", id_col)


def _whole(parts: tuple[np.ndarray, np.ndarray], rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted split contexts with the sums and numbers of all their parts."""
    keys = np.unique(parts[1])
    sums, kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for r in rows:
        part = _from_planes(zlib.decompress(bytes(r.totals)))
        at = np.searchsorted(keys, parts[1][np.searchsorted(parts[0], part)])
        np.add.at(sums, at, _unpack(bytes(r.sums)))
        np.add.at(kinds, at, _unpack(bytes(r.kinds)))
    return keys, sums, kinds
