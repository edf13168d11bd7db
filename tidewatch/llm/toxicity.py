"""Toxicity severity by cumulative-link ordinal regression on hashed words.

P(grade >= k) = sigmoid(w . x - b_k): one weight vector for all ordered thresholds b_1 < b_2 < ... The model
is fitted on a bounded sample of labelled documents; every document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mentioned, sampled, written
from .neardup import shingle_set

#: Upper bound, in expectation, of the labelled documents that are used.
TRAIN_DOCS = 20_000
#: A feature needs so many distinct documents and so large a chi-square value; at most so many features stay.
LEAST_DOCS, LEAST_CHI2, MOST_FEATURES = 4, 24.0, 4096
#: P(grade >= 1) from which a document counts as toxic.
CUT = 0.2
DIMENSIONS = 1 << 22
#: Lengths in bytes of the word beginnings that are features too.
PREFIXES = (4, 5, 6)
#: Letters are kept (A-Z lower-cased, all bytes of other letters), everything else separates words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8").translate(_LETTERS).split()) if text else set()


def features_of(word: bytes) -> tuple[int, ...]:
    """Buckets of the word itself and of its beginnings, which its inflected forms share."""
    parts = [word, *(word[:n] + b"-" for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh64_intdigest(p) & (DIMENSIONS - 1) for p in parts)


@dataclass(frozen=True)
class OrdinalModel:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def at_least(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= k), one row for each document, from the sums of its weights."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.cuts)[None, :] - found[:, None], -60, 60)))


def fit_ordinal(rows: list[list[int]], grades: list[int], features: list[int], l2: float = 0.05, steps: int = 800) -> OrdinalModel:
    """Maximum penalised likelihood by Adam on the full sample; thresholds are a first one plus positive gaps."""
    top = max(grades, default=0)
    column = {f: i for i, f in enumerate(features)}
    doc = np.array([i for i, r in enumerate(rows) for f in r if f in column], np.int64)
    col = np.array([column[f] for r in rows for f in r if f in column], np.int64)
    y, n = np.array(grades, np.int64), len(rows)
    if not top:  # no positive grade was seen: nothing is ever above grade 0
        return OrdinalModel((), (), (60.0,))
    w = np.zeros(len(features))
    share = [min(max((y >= k).mean(), 1e-6), 1 - 1e-6) for k in range(1, top + 1)]
    start = [math.log((1 - s) / s) for s in share]
    raw = np.array([start[0], *[math.log(max(b - a, 1e-3)) for a, b in zip(start, start[1:])]])
    m, v = [np.zeros(len(w)), np.zeros(top)], [np.zeros(len(w)), np.zeros(top)]
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
        score = np.bincount(doc, w[col], n)
        p = np.c_[np.ones(n), 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40))), np.zeros(n)]
        at = np.arange(n)
        hi, lo = p[at, y], p[at, y + 1]
        like = np.maximum(hi - lo, 1e-12)
        # d log(like) / d score, and / d cut for the cut above and the one below
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g_w = l2 * w - np.bincount(col, (d_hi - d_lo)[doc], len(w))
        g_cut = np.array([d_hi[y == k].sum() - d_lo[y == k - 1].sum() for k in range(1, top + 1)])
        g_raw = np.array([g_cut.sum(), *[g_cut[k:].sum() * math.exp(raw[k]) for k in range(1, top)]])
        for i, (x, g) in enumerate(((w, g_w), (raw, g_raw))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.1 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    cuts = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
    return OrdinalModel(tuple(features), tuple(w.tolist()), tuple(cuts.tolist()))


def train(docs: DataFrame, graded: DataFrame, train_docs: int = TRAIN_DOCS, most_features: int = MOST_FEATURES) -> OrdinalModel:
    """Fit on about ``train_docs`` documents at most of ``graded`` (doc_id, grade), taken by a hash of the id.

    Near copies are reduced to one by four minhashes, since copies of one document are no independent
    evidence. Features are the words that many distinct documents have and whose presence goes with grades
    above 0; their counts are made by Spark and at most ``most_features`` come to the driver.
    """
    graded = sampled(graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")), train_docs)
    graded = written(graded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            feats = [sorted({f for w in words(t) for f in features_of(w)}) for t in texts]
            sets = [shingle_set((t or "").encode("utf-8").translate(_LETTERS).split()) for t in texts]
            keys = [[int(((s * np.uint64(k)) >> np.uint64(2)).min()) if len(s) else -1 for k in (3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(feats, pa.list_(pa.int32())), *[pa.array([k[i] for k in keys], pa.int64()) for i in range(4)]],
                names=["doc_id", "f", "k0", "k1", "k2", "k3"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = mentioned(docs.select("doc_id", "text"), graded.select(F.col("doc_id").alias("id"))).mapInArrow(
        run, f"doc_id {kind}, f array<int>, k0 long, k1 long, k2 long, k3 long"
    )
    rows = found.join(graded, "doc_id").where("size(f) > 0")
    for k in ("k0", "k1", "k2", "k3"):
        rows = rows.groupBy(k).agg(F.min_by(F.struct(*[c for c in rows.columns if c != k]), "doc_id").alias("r")).select(k, "r.*")
    rows = written(rows.select("doc_id", "grade", "f"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0))).first()
    if not toxic or toxic == n:
        return OrdinalModel((), (), (60.0,) if not toxic else (-60.0,))
    rate = toxic / n
    excess = F.col("t") - F.col("n") * rate
    chosen = (
        rows.select(F.explode("f").alias("feature"), (F.col("grade") > 0).cast("long").alias("t"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"), F.sum("t").alias("t"))
        .where((F.col("t") >= LEAST_DOCS) & (excess > 0))
        .withColumn("chi2", excess * excess / (F.col("n") * rate * (1 - rate)))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "feature")
        .limit(most_features)
        .select("feature")
    )
    features = sorted(r.feature for r in chosen.collect())
    if not features:
        return OrdinalModel((), (), (60.0,))
    kept = F.array_intersect("f", F.lit(np.array(features, np.int32)))
    sample = rows.select("doc_id", "grade", kept.alias("f")).orderBy("doc_id").collect()
    return fit_ordinal([r.f for r in sample], [r.grade for r in sample], features)


def _scorer(model: OrdinalModel):
    """texts -> P(grade >= k), a row for each text; a word's features are looked up once for each task."""
    weight = dict(zip(model.features, model.weights))
    known: dict[bytes, tuple[int, ...]] = {}

    def score(texts: list[str | None]) -> np.ndarray:
        if len(known) > 300_000:
            known.clear()
        out = []
        for text in texts:
            own = words(text)
            for w in own.difference(known):
                known[w] = tuple(f for f in features_of(w) if f in weight)
            # a feature counts once for each document, as in training
            out.append(math.fsum(weight[f] for f in set().union(*filter(None, map(known.__getitem__, own)))))
        return model.at_least(np.array(out))

    return score


def severity(docs: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row of ``docs`` (doc_id, text, anything else).

    ``severity`` is the expected grade, ``grade`` the number of grades reached with probability one half,
    ``toxic`` that P(grade >= 1) reaches ``cut``. Null or empty texts have no features and get the base
    rate; null ids and repeated rows pass through, one row out for each row in. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            p = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 0] >= cut)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")


def clean(docs: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that ``severity`` does not call toxic, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text").to_pylist())[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 not toxic, 1 toxic in text of good quality, 2 toxic in text of bad quality."""
    bad = F.when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    return labels.where("toxic is not null").select("doc_id", F.when(F.col("toxic") > 0, bad).otherwise(0).alias("grade"))
