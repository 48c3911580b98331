"""Language identification by nearest centroid over hashed TF-IDF character n-grams.

A text's features are counts of the 1- to 3-grams of its lower-cased letters (runs of anything else are
one blank), hashed to a fixed number of dimensions, damped by log1p, weighted by inverse document
frequency and brought to unit length.  Each language's vectors are clustered by spherical k-means into a
few centroids; a text takes the language of the centroid of largest cosine.  Texts further from every
centroid than almost all labelled texts of its language that the centroids were not fitted on are marked as rejected.

The model is fitted on a bounded sample of labelled rows: of each language the ``sample`` training rows of
the smallest hash of their id, and the limits are set on the ``check`` rows that follow; where a language has fewer
rows, half of them each.  Prediction reads every whole text and nothing else.

Defined cases.  Null text and text without a letter: ``und``, score 0, rejected.  No training row: every
text is ``und`` with score 0 and rejected.  Ties go to the language that sorts first.  Repeated rows are
predicted alike; rows of null id or null language are predicted but never learnt from.  Very long texts
are read in slices of bounded memory and counted whole.  An empty table gives an empty table.  Columns besides id, text and
language are not read; ``filter_rejected`` carries them along, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, give_back, mix64, slices

UNKNOWN = "und"
DIMS = 1 << 13
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    centroids: np.ndarray  # (n, DIMS) float32, unit rows
    owner: np.ndarray  # (n,) index of the centroid's language
    idf: np.ndarray  # (DIMS,) float32
    floor: np.ndarray  # per language: the least cosine that isn't rejected


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point of the basic plane is a letter; beyond it all count as letters if Python says so."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams, or None for a text without a letter."""
    counts, any_letter, tail = np.zeros(DIMS, np.float64), False, np.array([32], np.uint32)
    for at in range(0, max(len(text), 1), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = _letters()[codes]
        any_letter = any_letter or bool(letters.any())
        codes = np.concatenate([tail, np.where(letters, codes, 32).astype(np.uint32)])
        fresh = np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])
        codes = codes[fresh].astype(np.uint64)
        # Grams that end inside this slice; up to two characters before it are carried over.
        t = len(tail)
        grams = [codes[t:], codes[t - 1 : -1] << np.uint64(21) | codes[t:]]
        grams.append(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
        for n, g in enumerate(grams):
            counts += np.bincount((mix64(g + np.uint64(n << 62 >> 1)) >> np.uint64(51)).astype(np.int64), minlength=DIMS)
        tail = codes[-2:].astype(np.uint32)
    return counts.astype(np.float32) if any_letter else None


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm == 0, 1, norm)).astype(np.float32)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starts: each next start is the vector least like those before."""
    starts = [int(np.argmax(v @ v.mean(axis=0)))]
    best = v @ v[starts[0]]
    for _ in range(min(k, len(v)) - 1):
        starts.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[starts[-1]])
    c = v[starts].copy()
    for _ in range(rounds):
        nearest = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own := v[nearest == j]).size:
                mean = own.mean(axis=0)
                c[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    sizes = np.bincount(np.argmax(v @ c.T, axis=1), minlength=len(c))
    return c[sizes > 0]


def _featurise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_lang", pa.string()), ("_order", pa.int64()), ("_counts", pa.binary())])
    for batch in it:
        def rows(batch=batch):
            for lang, order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (counts := gram_counts(text or "")) is not None:
                    yield lang, order, zlib.compress(counts.tobytes(), 1)

        yield from batches(rows(), schema, 256)


def _cosines(shared):
    schema = pa.schema([("_lang", pa.string()), ("_cos", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows(batch: pa.RecordBatch):
            for lang, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang in model.languages and (counts := gram_counts(text or "")) is not None:
                    own = model.centroids[model.owner == model.languages.index(lang)]
                    yield lang, float((vectors(counts[None], model.idf) @ own.T).max())

        for batch in it:
            yield from batches(rows(batch), schema)

    return run


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, sample: int = 400, check: int = 2000, clusters: int = 4, reject: float = 0.0025) -> Model:
    """Fit on at most ``sample`` rows of each language where ``learn`` holds; set its limit on at most ``check`` others.

    ``reject``: the share of a language's texts, none of them fitted on, that lies below its limit.
    """
    rows = docs.where(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull())
    rows = rows.select(docs[lang_col].alias("_lang"), F.xxhash64(docs[id_col].cast("string")).alias("_order"), docs[text_col].alias("_text"))
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    likely = (F.col("_order") / 2.0**64 + 0.5) * F.col("_n") <= 2 * (sample + check) + 64  # of the smallest hashes
    orders = rows.join(F.broadcast(sizes), "_lang").where(likely).groupBy("_lang").agg(F.sort_array(F.collect_list("_order")).alias("_o"))
    size = F.size("_o")
    limits = orders.select("_lang", F.get("_o", F.least(F.lit(sample), F.ceil(size / 2).cast("int")) - 1).alias("_fit"), F.get("_o", F.least(F.lit(sample + check), size) - 1).alias("_last"))
    chosen = rows.join(F.broadcast(limits), "_lang").where(F.col("_order") <= F.col("_last"))
    fitted, others = (chosen.where(c).select("_lang", "_order", "_text") for c in (F.col("_order") <= F.col("_fit"), F.col("_order") > F.col("_fit")))
    found = fitted.mapInArrow(_featurise, "_lang string, _order long, _counts binary").collect()
    model = train([(r._lang, r._order, np.frombuffer(zlib.decompress(bytes(r._counts)), np.float32)) for r in found], clusters)
    held = others.mapInArrow(_cosines(docs.sparkSession.sparkContext.broadcast(model)), "_lang string, _cos double").collect()
    floor = [limit([r._cos for r in held if r._lang == lang], reject, f) for lang, f in zip(model.languages, model.floor, strict=True)]
    return replace(model, floor=np.array(floor))


def limit(cosines: list[float], reject: float, other: float = 0.0) -> float:
    """The least cosine that isn't rejected: the quantile, or ``other`` without cosines.

    Fewer than 1 / reject cosines don't show the quantile: the limit is then a quarter of the way from
    their median to their least below the least.
    """
    if not cosines:
        return other
    low = float(np.quantile(cosines, reject))
    if len(cosines) * reject < 1:
        low -= 0.25 * (float(np.median(cosines)) - low)
    return low - 1e-4  # for rounding: equal texts stay


def train(rows: list[tuple[str, int, np.ndarray]], clusters: int = 4) -> Model:
    """A model whose limits are those of the rows themselves."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes()))
    languages = tuple(sorted({r[0] for r in rows}))
    if not rows:
        return Model((), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.ones(DIMS, np.float32), np.zeros(0))
    counts = np.stack([r[2] for r in rows])
    labels = np.array([languages.index(r[0]) for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(counts, idf)
    centroids = [cluster(v[labels == n], clusters) for n in range(len(languages))]
    owner = np.concatenate([np.full(len(c), n) for n, c in enumerate(centroids)])
    stacked = np.concatenate(centroids)
    cos = v @ stacked.T
    floor = np.array([cos[labels == n][:, owner == n].max(axis=1).min() for n in range(len(languages))])
    return Model(languages, stacked, owner, idf, floor)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, cosine clipped to 0..1, rejected) of each text."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    if not model.languages:
        return out
    for at in range(0, len(texts), 256):
        rows = [(k, c) for k, t in enumerate(texts[at : at + 256], at) if t and (c := gram_counts(t)) is not None]
        if rows:
            cos = vectors(np.stack([c for _, c in rows]), model.idf) @ model.centroids.T
            for (k, _), own, best in zip(rows, cos.argmax(axis=1), cos.max(axis=1), strict=True):
                n = model.owner[own]
                out[k] = model.languages[n], min(1.0, max(0.0, float(best))), bool(best < model.floor[n])
    return out


def _apply(shared):
    schema = pa.schema([("_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(it):
            found = predict(model, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[n] for f in found], schema.field(n + 1).type) for n in range(3))], schema=schema)
        give_back()

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score and rejected, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return src.mapInArrow(_apply(shared), "_id long, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)


def filter_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it):
            yield part.filter(pa.array([not r for _, _, r in predict(shared.value, part.column(at).to_pylist())], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
