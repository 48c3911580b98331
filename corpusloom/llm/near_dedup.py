"""Near-duplicate groups by b-bit MinHash.

Each text's set of 5-word shingles gives 128 minima.  Rows of four minima make 32 band keys, which
generate candidates; of every minimum only the low four bits are kept, packed as bit planes into eight
64-bit integers.  The number of equal positions, found by bit counts and corrected for chance collisions,
estimates the similarity of a candidate pair, and pairs far below the threshold go.  The rest are confirmed
on their full shingle sets.  At similarity 0.75 a link escapes all bands with probability 5e-6, and the
estimates, cut 5.5 standard deviations below the threshold, with about 2e-8 each.

Texts of one shingle set are one class, found by a 128-bit digest, and only one text of it is compared.  First
every class is tried against the likeliest of its buckets' leaders.  After the components of these links, only
pairs of a bucket in different components matter.  They never become rows: a bucket's members, dealt into slices by
a hash where they are many, meet slice by slice in tasks that compare their signatures and pass on the members
with a likely partner; those meet once more with longer signatures and full sets, and each task passes
on no more of the confirmed links than a forest of them.

Defined cases.  Null and empty texts and texts without words have an empty set and are linked with nothing.
Fewer than five words: the whole sequence is the one shingle.  Rows that share a doc_id are one document,
linked if any of its texts links.  Rows of null id are kept and linked with nothing (component null).  Very long
texts are compared whole, and a slice holds fewer of them.  Ties are settled by hashes and ids, so results don't
depend on the order of rows.  An empty table gives an empty table.  Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, as_bytes, batches, broadcast_if_few, dealt_join, give_back, heavy, materialize, mix64, seeded64, two
from corpusloom.llm.graph import Forest, components

SHINGLE = 5
HASHES, ROWS, LOW_BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Fixed multipliers of the word positions and of the hash functions.
_PLACES = seeded64(SHINGLE, 1) | np.uint64(1)
_FACTORS = (seeded64(HASHES, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: A longer signature, made only of texts in pairs that the short one leaves open.
WIDE = 1024
_WIDE_FACTORS = (seeded64(WIDE, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Members of a bucket that meet in one task, first by signatures alone, then by so many bytes of their sets.
SLICE_ROWS, SLICE_BYTES = 16_384, 24 << 20
#: Rows or bytes gathered before the complete groups among them are worked on.
GATHER_ROWS, GATHER_BYTES = 8192, 16 << 20
_BAND_PLACES = seeded64(ROWS, 3) | np.uint64(1)
_BAND_SALTS = seeded64(BANDS, 4)
PACKED = [f"s{k}" for k in range(HASHES * LOW_BITS // 64)]


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix64((h * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
        total = h[: n - SHINGLE + 1] * _PLACES[0]
        for k in range(1, SHINGLE):
            total = total + h[k : n - SHINGLE + 1 + k] * _PLACES[k]
        return np.unique(mix64(total))


def minima(found: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """One minimum of the 32-bit hashes for each factor they are multiplied by."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    short = found.astype(np.uint32)
    for at in range(0, len(short), 2048):
        low = np.minimum(low, (factors[:, None] * short[at : at + 2048][None, :]).min(axis=1))
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, as bit planes of HASHES bits each."""
    planes = (low[None, :] >> np.arange(LOW_BITS, dtype=np.uint32)[:, None]).astype(np.uint8) & 1
    return np.packbits(planes, axis=1).view("<i8").ravel()


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_PLACES).sum(axis=1) + _BAND_SALTS).view(np.int64)


FEATURES = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *((s, pa.int64()) for s in PACKED), ("bands", pa.list_(pa.int64()))])
FEATURES_DDL = "_id long, n long, digest binary, " + ", ".join(f"{s} long" for s in PACKED) + ", bands array<long>"


def _featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def one(i, text: bytes) -> tuple:
        found = shingles(text, hashes)
        if not len(found) or i is None:
            return i, len(found), None, *[None] * len(PACKED), None
        low = minima(found)
        return i, len(found), xxhash.xxh3_128_digest(found.tobytes()), *pack(low).tolist(), band_keys(low)

    for batch in it:
        yield from batches((one(*row) for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)), FEATURES, 2048)


def matches(a: str, b: str) -> Column:
    """How many of the HASHES positions have equal low bits, by bit counts."""
    total = F.lit(HASHES)
    for half in range(HASHES // 64):
        differ = None
        for plane in range(LOW_BITS):
            s = PACKED[plane * (HASHES // 64) + half]
            x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
            differ = x if differ is None else differ.bitwiseOR(x)
        total = total - F.bit_count(differ)
    return total


def least_matches(percent: int, deviations: float = 5.5, size: int = HASHES) -> int:
    """The cut for matches: chance collisions included, so many standard deviations below the threshold's mean."""
    p = 2.0**-LOW_BITS + (1 - 2.0**-LOW_BITS) * percent / 100
    return max(0, floor(size * p - deviations * sqrt(size * p * (1 - p))))


def estimate(equal: Column) -> Column:
    """Collision-corrected similarity of a pair from its number of matches."""
    chance = 2.0**-LOW_BITS
    return (equal / HASHES - chance) / (1 - chance)


def _likely(a: str, b: str, percent: int) -> Column:
    """Whether a pair can reach the threshold, by its sizes and its estimate."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (matches(a, b) >= least_matches(percent))


SETS = pa.schema([("digest", pa.binary()), ("shingles", pa.binary()), ("wide", pa.binary())])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def one(text: bytes) -> tuple:
        found = shingles(text, hashes)
        return xxhash.xxh3_128_digest(found.tobytes()), found.tobytes(), pack(minima(found, _WIDE_FACTORS)).tobytes()

    for batch in it:
        yield from batches(map(one, as_bytes(batch.column(0))), SETS, 512)


def full_sets(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, shingles, wide: full sets and long signatures of the wanted (cls, rep, digest); rows that share id and text repeat theirs."""
    rows = wanted.count()
    ids = wanted.select(F.col("rep").alias("_want")).distinct()
    texts = src.join(broadcast_if_few(ids, rows), src["_id"] == ids["_want"], "left_semi").select("_text")
    found = texts.mapInArrow(_sets, "digest binary, shingles binary, wide binary")
    own = wanted.select("cls", F.col("digest").alias("_own"))
    found = found.join(broadcast_if_few(own, rows), F.col("digest") == F.col("_own"))
    return materialize(found.select("cls", "shingles", "wide"), "sets")


def one_each(sets: DataFrame, *columns: str) -> DataFrame:
    """The columns of one row for each class."""
    return sets.groupBy("cls").agg(F.first(F.struct(*columns)).alias("_s")).select("cls", "_s.*")


def common(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many members of the sorted set x each of the non-empty sets has."""
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
    sizes = np.array([len(s) for s in sets])
    return np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def _linked(x: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    both = common(x, sets)
    return 100 * both >= percent * (len(x) + np.array([len(s) for s in sets]) - both)


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (batch.column(k).to_pylist() for k in range(2))
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(k).to_pylist()] for k in (2, 3))
            ok = [n for n in range(len(a)) if _linked(x[n], [y[n]], percent)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([v[n] for n in ok], pa.int64()) for v in (a, b)], schema=schema)

    return run


def confirm(pairs: DataFrame, src: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: ids of those pairs (leader, cls), one a class, that reach the threshold on their full sets."""
    both = pairs.select(F.explode(F.array("leader", "cls")).alias("_want")).distinct()
    known = classes.select("cls", "rep", "digest")
    wanted = materialize(known.join(both, known["cls"] == both["_want"], "left_semi"), "wanted")
    sets = one_each(full_sets(src, wanted), "shingles").join(wanted.select("cls", "rep"), "cls")
    one = sets.select(F.col("cls").alias("leader"), F.col("rep").alias("a"), F.col("shingles").alias("_x"))
    other = sets.select("cls", F.col("rep").alias("b"), F.col("shingles").alias("_y"))
    counts = pairs.groupBy("leader").agg(F.count("*").alias("k"))
    joined = dealt_join(pairs, one, "leader", heavy(counts, "leader", "k", pairs.count()), ["cls"]).join(other, "cls")
    return materialize(joined.select("a", "b", "_x", "_y").mapInArrow(_verify(percent), "a long, b long"), "links")


def best_tries(buckets: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """leader, cls: for each class the likeliest of its buckets' leaders."""
    tries = materialize(buckets.where("leader <> cls").select("leader", "cls").distinct(), "tries")
    x = signed.select(F.col("cls").alias("leader"), F.struct(*signed.columns).alias("x"))
    y = signed.select("cls", F.struct(*signed.columns).alias("y"))
    counts = tries.groupBy("leader").agg(F.count("*").alias("k"))
    scored = dealt_join(tries, x, "leader", heavy(counts, "leader", "k", tries.count()), ["cls"]).join(y, "cls").where(_likely("x", "y", percent))
    found = scored.groupBy("cls").agg(F.max_by("leader", F.struct(matches("x", "y").alias("m"), (-F.col("x.rep")).alias("r"), "leader")).alias("leader"))
    return materialize(found.select("leader", "cls"), "first-pairs")


def apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, cls, rep, c, outside: members of buckets in several components; all but the largest are outside."""
    placed = buckets.select("bucket", "cls", "rep").join(found, F.col("rep") == F.col("node"), "left").select("bucket", "cls", "rep", F.coalesce("component", "rep").alias("c"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    sizes = parts.groupBy("bucket").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("_main"), F.count("*").alias("_parts_n"), F.sum("k").alias("_k")).where("_parts_n > 1").drop("_parts_n")
    joined = dealt_join(placed, sizes.drop("_k"), "bucket", heavy(sizes, "bucket", "_k", placed.count()), ["cls"])
    return joined.select("bucket", "cls", "rep", "c", (F.col("c") != F.col("_main")).alias("outside"))


def in_slices(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """members with ``i``, ``j`` and ``role``, a row for each meeting of slices they take part in.

    Outside members (role 1) of slice i meet all members (role 2) of slice j, for every i and j of their bucket;
    role 3 is both.  A slice weighs about ``most``, so that a bucket in one slice, as nearly all are, is one
    meeting of its members.
    """
    sizes = members.groupBy("bucket").agg(F.sum(weight).alias("_w"), F.sum(F.when(F.col("outside"), weight).otherwise(F.lit(0))).alias("_o"), F.count("*").alias("_k"))
    slices = sizes.select("bucket", "_k", *(F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(n) for c, n in (("_o", "_ni"), ("_w", "_nj"))))
    dealt = dealt_join(members, slices.drop("_k"), "bucket", heavy(slices, "bucket", "_k", members.count()), ["cls"])
    own = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")
    meeting = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    ni, nj = F.col("_ni"), F.col("_nj")
    as_left = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), nj - 1), lambda j: meeting(own(ni, 1), j, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    as_right = F.transform(F.sequence(F.lit(0), ni - 1), lambda i: meeting(i, own(nj, 2), 2))
    both = F.array(meeting(F.lit(0), F.lit(0), 3))
    meetings = F.when((ni == 1) & (nj == 1), F.when(F.col("outside"), both).otherwise(as_right)).otherwise(F.concat(as_left, as_right))
    return dealt.withColumn("_m", F.explode(meetings)).select(*members.columns, "_m.*")


def met(rows: DataFrame) -> DataFrame:
    """Rows of a meeting together, in order."""
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cls")


def complete_groups(it: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket", "i", "j")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the keys as tables of complete groups, with the groups' starts and the end."""
    held: list[pa.RecordBatch] = []
    size = load = 0

    def cut(table: pa.Table) -> np.ndarray:
        columns = [table.column(k).to_numpy() for k in keys]
        fresh = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in columns:
            fresh |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(fresh) + 1, [table.num_rows]])

    for batch in it:
        held.append(batch)
        size, load = size + batch.num_rows, load + batch.nbytes
        if size >= GATHER_ROWS or load >= GATHER_BYTES:
            table = pa.Table.from_batches(held)
            at = cut(table)
            if len(at) > 2:
                yield table.slice(0, int(at[-2])), at[:-1]
                table = table.slice(int(at[-2])).combine_chunks()
            held, size, load = table.to_batches(), 0, 0
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table, cut(table)


def _planes(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)


def _equal(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """How many of ``size`` positions of one signature, or of rows of them, equal those of rows of others."""
    words = size // 64
    differ = x ^ y
    folded = differ[..., :words].copy()
    for plane in range(1, LOW_BITS):
        folded |= differ[..., plane * words : (plane + 1) * words]
    return size - np.bitwise_count(folded).sum(axis=-1, dtype=np.int64)


def _bands(table: pa.Table) -> np.ndarray:
    return table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)


def _first_common(bands: np.ndarray, x: int, y: np.ndarray) -> np.ndarray:
    """The first bucket that x shares with each of y, where alone their pair is looked at."""
    return bands[x][(bands[y] == bands[x]).argmax(axis=1)]


def _flag(percent: int):
    """Members with a likely partner of another component whose first common bucket this is."""
    schema = pa.schema([("bucket", pa.int64()), ("cls", pa.int64()), ("c", pa.int64()), ("outside", pa.bool_())])
    least = least_matches(percent)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(it):
            cls, c, n, role = (table.column(k).to_numpy() for k in ("cls", "c", "n", "role"))
            planes, hit, bands = _planes(table, PACKED), np.zeros(table.num_rows, bool), _bands(table)
            buckets = table.column("bucket").to_numpy()
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                left, right = (lo + np.flatnonzero(role[lo:hi] & r) for r in (1, 2))
                for x in left.tolist():
                    y = right[(c[right] != c[x]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
                    if len(y) and len(y := y[_equal(planes[x], planes[y], HASHES) >= least]):
                        y = y[_first_common(bands, x, y) == buckets[x]]
                        hit[x] |= len(y) > 0
                        hit[y] = True
            keep = pa.array(hit)
            yield from pa.Table.from_arrays([table.column(k).filter(keep) for k in schema.names], schema=schema).to_batches()
        give_back()

    return run


def _link(percent: int):
    """a, b: a forest of the confirmed links between the components that meet."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least, least_wide = least_matches(percent), least_matches(percent, size=WIDE)

    def meet(rows: dict, lo: int, hi: int, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        cls, c, n, role, outside, bands, planes, wide = (rows[k] for k in ("cls", "c", "n", "role", "outside", "bands", "planes", "wide"))
        bucket, forest = rows["bucket"][lo], Forest()
        left, right = (lo + np.flatnonzero(role[lo:hi] & r) for r in (1, 2))
        for x in left.tolist():
            other = (c[right] != c[x]) & (~outside[right] | (cls[x] < cls[right]))
            y = right[other & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
            y = y[_equal(planes[x], planes[y], HASHES) >= least]
            sharp = _equal(wide[x], wide[y], WIDE)
            y, sharp = y[sharp >= least_wide], sharp[sharp >= least_wide]
            mine = _first_common(bands, x, y) == bucket
            y = y[mine][np.argsort(-sharp[mine], kind="stable")]
            step = 8
            while len(y):  # likeliest first; what is linked meanwhile needs no look
                y = y[[forest.root(int(v)) != forest.root(int(c[x])) for v in c[y]]]
                now, y = y[:step], y[step:]
                if len(now):
                    for k in now[_linked(sets[x], [sets[k] for k in now.tolist()], percent)].tolist():
                        if forest.join(int(c[x]), int(c[k])):
                            yield int(c[x]), int(c[k])
                step *= 8

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in complete_groups(it):
            rows = {k: table.column(k).to_numpy() for k in ("bucket", "cls", "c", "n", "role", "outside")}
            rows["planes"] = _planes(table, PACKED)
            rows["bands"] = _bands(table)
            rows["wide"] = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE * LOW_BITS // 64)
            sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
            found = [link for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for link in meet(rows, lo, hi, sets)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], schema=schema)
        give_back()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable) and kept (whether that is itself)."""
    src = two(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    feats = materialize(src.mapInArrow(_featurise, FEATURES_DDL), "features")
    classes = feats.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("n", *PACKED, "bands")).alias("_f"))
    classes = materialize(classes.select("digest", "rep", "copies", "_f.*").withColumn("cls", F.monotonically_increasing_id()), "classes")
    copies = heavy(classes, "digest", "copies", feats.count())
    members = materialize(dealt_join(feats.select("_id", "n", "digest"), classes.select("digest", "rep"), "digest", copies, ["_id"], "left").drop("digest"), "members")
    signed = classes.select("cls", "rep", "n", *PACKED)

    # Buckets of at least two classes, each with the class of the smallest hash as its leader.
    exploded = classes.select("cls", "rep", F.explode("bands").alias("bucket"))
    heads = exploded.groupBy("bucket").agg(F.count("*").alias("_k"), F.min_by("cls", F.struct(F.xxhash64("rep", "bucket"), "cls")).alias("leader")).where("_k > 1")
    heads = materialize(heads, "heads")
    buckets = materialize(dealt_join(exploded, heads.drop("_k"), "bucket", heavy(heads, "bucket", "_k", exploded.count()), ["cls"]), "buckets")

    # Links by definition: texts of one id.  Then every class against the likeliest of its buckets' leaders.
    several = members.where("rep is not null").groupBy("_id").agg(F.min("rep").alias("_low"), F.max("rep").alias("_high"), F.count("*").alias("_k")).where("_low < _high")
    several = materialize(several, "several")
    same = dealt_join(members.where("rep is not null"), several.drop("_high", "_k"), "_id", heavy(several, "_id", "_k", members.count()), ["rep"]).select(F.col("_low").alias("a"), F.col("rep").alias("b"))
    found = components(same.unionByName(confirm(best_tries(buckets, signed, percent), src, classes, percent)))

    # What is still apart: first by signatures, then on full sets.
    open_ = materialize(in_slices(apart(buckets, found).drop("rep"), F.lit(1), SLICE_ROWS), "apart")
    signs = classes.select("cls", "n", *PACKED, "bands")
    flagged = met(open_.join(signs, "cls")).mapInArrow(_flag(percent), "bucket long, cls long, c long, outside boolean")
    flagged = materialize(flagged.distinct(), "flagged")
    known = classes.select("cls", "rep", "digest", "n", *PACKED, "bands")
    wanted = materialize(known.join(flagged.select(F.col("cls").alias("_w")).distinct(), F.col("cls") == F.col("_w"), "left_semi"), "wanted")
    rich = one_each(full_sets(src, wanted.select("cls", "rep", "digest")), "shingles", "wide").join(wanted.drop("rep", "digest"), "cls")
    open_ = materialize(in_slices(flagged.join(wanted.select("cls", "n"), "cls"), F.col("n") * 8 + 1024, SLICE_BYTES).drop("n"), "flagged")
    links = met(open_.join(rich, "cls")).mapInArrow(_link(percent), "a long, b long")
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    out = members.join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == component)).alias("kept"))
