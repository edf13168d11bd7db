"""Shared helpers: table access, batch size, tables written to the shared folder, small array helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, shared_dir, small_batches, written  # noqa: F401

#: Java regular expression of a word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark only, with batches small enough for whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str = "text"):
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words as ``WORD`` finds, A-Z lower-cased, as UTF-8: both byte methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bits of the bitmap of ``mentioned``: 1 MB, whatever the number of ids.
BITMAP_BITS = 23
#: Most keys that ``cascade`` takes, bits for each of them, and most bits of a bitmap: 16 MB.
CASCADE_KEYS, KEY_BITS, MOST_BITS = 1 << 23, 16, 27


def _bitmap(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """The bits of all hashed ``keys`` (k), in parts of 32,768."""
    at = keys.select(F.pmod(F.xxhash64("k", F.lit(level)), F.lit(1 << bits)).alias("_at"))
    parts = at.groupBy(F.shiftright("_at", 15).cast("int").alias("_part"))
    return parts.agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(32767))).alias("_bits"))


def _looked_up(rows: DataFrame, key, bitmap: DataFrame, level: int, bits: int, name: str) -> DataFrame:
    """``rows`` and whether the bit of ``key`` is set, from a broadcast bitmap of at most ``MOST_BITS``."""
    at = rows.withColumn("_at", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(1 << bits))).withColumn("_part", F.shiftright("_at", 15).cast("int"))
    byte = F.expr("conv(hex(substring(_bits, cast((_at & 32767) >> 3 as int) + 1, 1)), 16, 10)").cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at & 7 as int))")) != 0
    return at.join(F.broadcast(bitmap), "_part", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_part", "_bits")


def mentioned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` may be in ``ids`` (id): all that are, and few others.

    A bitmap of hashed ids is broadcast, never the ids; its size is fixed, so that with many more ids than
    bits it lets more rows through, and an exact semi join must follow in any case.
    """
    bitmap = _bitmap(ids.select(F.col("id").alias("k")), 0, BITMAP_BITS)
    return _looked_up(docs, F.col("doc_id"), bitmap, 0, BITMAP_BITS, "_hit").where("_hit").drop("_hit")


def cascade(universe: DataFrame, chosen: DataFrame, most: int = CASCADE_KEYS) -> list[tuple[DataFrame, int]] | None:
    """Bitmaps that tell ``chosen`` keys exactly from all others of ``universe`` (k, hashes), or None.

    The first holds the chosen keys, each next one the keys on the other side that the last one lets through
    wrongly; they shrink, and the last one lets none through. Only keys are shuffled. With more than
    ``most`` chosen keys, or keys that never come apart, there are none, and the caller joins.
    """
    inside = written(chosen.select("k").distinct())
    outside = written(universe.select("k").distinct().join(inside, "k", "left_anti"))
    levels: list[tuple[DataFrame, int]] = []
    while len(levels) < 8 and (n := inside.count()) <= most:
        level, bits = len(levels), max(15, min(MOST_BITS, (KEY_BITS * n).bit_length()))
        bitmap = written(_bitmap(inside, level, bits))
        levels.append((bitmap, bits))
        through = written(_looked_up(outside, F.col("k"), bitmap, level, bits, "_hit").where("_hit").select("k"))
        if through.isEmpty():
            return levels
        inside, outside = through, inside
    return None


def flagged(rows: DataFrame, key, levels: list[tuple[DataFrame, int]], name: str) -> DataFrame:
    """``rows`` of the cascade's universe and whether their ``key`` is chosen: in one bitmap, but not in the next, but ... No shuffle."""
    for i, (bitmap, bits) in enumerate(levels):
        rows = _looked_up(rows, key, bitmap, i, bits, f"_in{i}")
    inside = F.lit(False)
    for i in reversed(range(len(levels))):
        inside = F.col(f"_in{i}") & ~inside
    return rows.withColumn(name, inside).drop(*[f"_in{i}" for i in range(len(levels))])


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``doc_id``: all rows if there are no more than that."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def to_arrow(kind: str):
    """The Arrow type of a Spark type's simple name."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
