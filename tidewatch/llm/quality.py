"""Quality rules, with DataFrame functions only: simple text statistics and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: one of trusted target documents, one of
the whole raw corpus. A document's score is the mean log ratio of its n-grams, and all documents meet the same
fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cascade, flagged, written

#: Hash buckets of each order of n-grams; the only table that leaves the executors has so many rows of each.
BUCKETS = 8192
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.2
#: Pseudo-count of each bucket.
SMOOTH = 1.0
SYMBOLS = r"[#*$%&|<>]"


def _let(value, body):
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _words(text: str = "text"):
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashed_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``h``, the hashes of its words in order."""
    return docs.withColumn("h", F.transform(_words(), lambda w: F.xxhash64(w)))


def _grams(h):
    """Buckets of all words and word pairs; pairs have the upper half."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(
        F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
        lambda x, i: (F.pmod(F.xxhash64(F.get(h, i), x), F.lit(BUCKETS)) + BUCKETS).cast("int"),
    )
    return F.concat(one, two)


def _trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, target) of all ``docs``: whether ``trusted`` has the doc_id, told without moving texts where it has few enough."""
    key = F.xxhash64("doc_id")
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    levels = cascade(docs.where("doc_id is not null").select(key.alias("k")), ids.select(key.alias("k")))
    if levels is None:
        found = docs.select("doc_id", "text").join(ids.withColumn("target", F.lit(True)), "doc_id", "left")
    else:
        found = flagged(docs.select("doc_id", "text"), key, levels, "target")
    return found.select("text", (F.coalesce("target", F.lit(False)) & F.col("doc_id").isNotNull()).cast("long").alias("target"))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log P_target - log P_raw of every bucket, in one pass over the texts.

    The raw counts cover all documents, the target's all documents of ``trusted`` (doc_id). Without trusted
    documents all ratios are 0. Each order of n-grams is a distribution.
    """
    grams = hashed_words(_trusted(docs, trusted)).select("target", F.explode(_let(F.col("h"), _grams)).alias("bucket"))
    table = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    n = np.zeros((2, 2 * BUCKETS))
    for r in table.collect():  # a row for each bucket at most
        n[0, r.bucket], n[1, r.bucket] = r.raw, r.target
    if not n[1].any():
        return np.zeros(2 * BUCKETS)
    p = (n + SMOOTH).reshape(2, 2, BUCKETS)
    p /= p.sum(axis=2, keepdims=True)
    return (np.log(p[1]) - np.log(p[0])).reshape(-1)


def _repeat_words(h):
    """Words inside 5-word windows that the text has twice or more, the first one included."""
    windows = F.transform(F.slice(h, 5, F.size(h)), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), x))

    def covered(at):
        """``at``: window starts in order. A window adds the words up to the next start, 5 at most."""
        steps = F.aggregate(F.slice(at, 2, F.size(at)), F.struct(F.lit(5).cast("long").alias("n"), at[0].alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(5))).alias("n"), p.alias("last")))
        return F.when(F.size(at) > 0, steps["n"]).otherwise(F.lit(0).cast("long"))

    def places(s):
        """``s``: windows as (hash, place), sorted."""
        twice = F.filter(s, lambda x, i: (x["w"] == F.get(s, i + 1)["w"]) | (x["w"] == F.get(s, i - 1)["w"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def heavy(w):
        return _let(_let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), places), covered)

    def count(w):
        return F.when(F.size(F.array_distinct(w)) < F.size(w), heavy(w)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(h) > 5, _let(windows, count)).otherwise(F.lit(0).cast("long"))


def quality(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, anything else), with base statistics, score and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.
    A null or empty text has no words: all counts are 0, it fails the base rules, and its score is 0. A null
    doc_id and repeated rows pass through. No shuffle.
    """
    base = _measured(docs.select("doc_id", "text"), ratios)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    return base.select(*columns).withColumn("kept", _verdict(threshold))


def keep(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, in one pass."""
    inner = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return _measured(inner, ratios).where(_verdict(threshold)).select("_row.*")


def _verdict(threshold: float):
    return ~F.col("base_failed") & (F.col("score") >= threshold)


def _measured(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` without its text, with the base statistics, ``base_failed`` and ``score``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    weights = F.lit(ratios)

    def score(g):
        total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(weights, b))
        return F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0))

    base = hashed_words(docs).select(
        *[c for c in docs.columns if c != "text"],
        F.size("h").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(F.col("h"), _repeat_words).alias("n_repeat_words"),
        _let(_let(F.col("h"), _grams), score).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.withColumn("base_failed", failed)
