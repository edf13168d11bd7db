"""Importance resampling of documents towards a target distribution, with DataFrame functions only.

Each document becomes an array of hashed n-gram buckets. Buckets are counted over the corpus and over the target, and the
logarithm of their smoothed ratio is a bucket's gain. A document is scored where it lies, by adding up its buckets' gains
from a literal array; Gumbel noise from a hash of its id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import numbered
from .common import written

#: Hash buckets of all features; the counts of both tables that leave the executors have so many rows at most.
BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 1
SEED = "2024"
#: Words that a document needs to be drawn, and the share of such documents that is drawn, in percent.
MIN_WORDS, PERCENT = 20, 10
#: Java regular expression of a word of the lower-cased text: digits, a-z, everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: str = "text") -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def buckets(w: Column, longest: int = LONGEST, n: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``longest`` words of the array ``w``, repeats included."""

    def of(feature: Column) -> Column:
        return F.pmod(F.crc32(feature.cast("binary")), F.lit(n)).cast("int")

    def runs(k: int) -> Column:
        if k == 1:
            return F.transform(w, of)
        starts = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: of(F.array_join(F.slice(w, i + 1, k), " ")))

    return F.concat(*[runs(k) for k in range(1, longest + 1)]) if longest > 1 else runs(1)


def totals(docs: DataFrame, longest: int = LONGEST, n: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of ``docs`` (text) fall into each bucket. Only sums for each task and bucket are shuffled."""
    each = docs.select(F.explode(_let(words(), lambda w: buckets(w, longest, n))).alias("bucket")).groupBy("bucket").count()
    out = np.zeros(n, np.int64)
    for r in each.collect():  # a row for each bucket at most
        out[r["bucket"]] = r["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of both distributions, for every bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """Standard Gumbel noise in thousandths, from the first 32 bits of a hash of ``key``; null counts as an empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text): no shuffle, nothing exploded.

    ``weight`` is the floored mean gain of a document's features, 0 without any.
    """
    table = F.lit(gain)
    both = docs.select("doc_id", words().alias("w"))
    both = both.select("doc_id", F.size("w").cast("long").alias("n_words"), _let(F.col("w"), lambda w: buckets(w, longest, len(gain))).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    both = both.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return both.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("total")


def drawn(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, score, eligible, anything else) with ``rank``: 1, 2, ... of the ``n`` highest scores that are eligible, else null.

    Scores are whole numbers in a range that gains and noise bound (some 200,000 values), so their exact
    counts, one for each score, tell where the draw ends; only rows that reach this score are put in order.
    """
    levels = rows.where("eligible").groupBy("score").count().collect() if n else []
    left, cut = n, None
    for r in sorted(levels, key=lambda r: -r["score"]):
        left, cut = left - r["count"], r["score"]
        if left <= 0:
            break
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.select("*", none)
    inside = F.col("eligible") & (F.col("score") >= cut)
    place = numbered(rows.where(inside), [F.desc("score"), F.asc("doc_id")], "place")
    rank = F.when(F.col("place") < n, F.col("place") + 1).cast("long").alias("rank")
    return place.select(*rows.columns, rank).unionByName(rows.where(~inside).select("*", none))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, n: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), as longs.

    ``target`` (text) is what the draw should look like. Of the N documents with at least ``min_words`` words,
    the floor(percent * N / 100) of the highest scores are drawn, ties to the smaller doc_id (null is the
    smallest); rank is null for all others. Null and empty texts have no features, weight 0, and are never
    drawn. Rows with the same doc_id have the same noise, and repeated rows successive ranks. Without target
    texts, gains come from the smoothing alone; without documents there are no rows. Other columns are ignored.
    """
    gain = gains(totals(docs.select("text"), longest, n), totals(target.select("text"), longest, n))
    rows = written(scored(docs, gain, longest, seed).withColumn("eligible", F.col("n_words") >= min_words))
    many = rows.where("eligible").count()
    return drawn(rows, percent * many // 100).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
