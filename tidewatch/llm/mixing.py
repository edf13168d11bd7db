"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each source takes whole passes over its documents and one more over those below a threshold of a document
hash. The threshold is found from histograms: tokens by source and the hash's leading digits, then, inside the
one bucket where the budget ends, by the next digits, and so on, until that bucket is one row. Only sums of a
fixed number of buckets for each source are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import numbered
from .common import n_words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Hexadecimal digits of a document's hash and of its place's, and how many of them one histogram resolves.
DIGITS, PLACE_DIGITS, STEP = 18, 15, 3


def doc_hash():
    """The first 18 hexadecimal digits of the MD5 of id and text, so that neither equal ids nor equal texts share them."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS)


def _placed_hash():
    """The hash, and that of the row's ``_place``, which tells equal rows apart."""
    return F.concat(doc_hash(), F.substring(F.md5(F.col("_place").cast("string").cast("binary")), 1, PLACE_DIGITS))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in code point order, null last, have the weights in turn. The shares of ``share`` times all
    sizes stop at ``most`` times the source's size, and what is cut is shared again by weight until none is
    above: each turn is one sum over the sources, however many there are.
    """
    ranked = numbered(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    level, cut = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        kept = F.sum(F.when(~over, F.col("weight")))
        total, capped, left, n = ranked.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), kept, F.count_if(over)).first()
        if n == cut or left is None:
            break
        level, cut = (share * total - capped) / left, n
    level = float("inf") if left is None else level
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _start(goal: DataFrame) -> DataFrame:
    """(s, passes, left, prefix, n, c): a source's whole passes, what is left of its budget, and the bucket, still all rows, where it ends."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = goal.withColumn("passes", passes)
    return at.select(F.col("source").alias("s"), "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"), F.lit(2).cast("long").alias("c"))


def _refine(table: DataFrame, at: DataFrame, start: int, digits: int) -> tuple[DataFrame, bool]:
    """``at`` with buckets of up to ``digits`` digits, and whether a bucket of several rows is left.

    ``table`` is (source, hash, size). A budget that takes everything has the bucket "g", above all digits.
    """
    for depth in range(start + STEP, digits + 1, STEP):
        open_ = at.where("c > 1")
        inside = F.col("source").eqNullSafe(F.col("s")) & F.startswith("hash", "prefix")
        sums = table.join(open_, inside).groupBy("s", "passes", "left", F.substring("hash", 1, depth).alias("bucket")).agg(F.sum("size").alias("k"), F.count("*").alias("rows"))
        upto = Window.partitionBy("s").orderBy("bucket")
        run = sums.withColumn("after", F.sum("k").over(upto)).withColumn("before", F.col("after") - F.col("k"))
        found = run.groupBy("s").agg(
            F.first("passes").alias("passes"), F.first("left").alias("left"), F.min(F.when(F.col("after") > F.col("left"), F.struct("bucket", "before", "k", "rows"))).alias("b")
        )
        found = found.select(
            "s", "passes", (F.col("left") - F.coalesce("b.before", F.lit(0))).alias("left"), F.coalesce("b.bucket", F.lit("g")).alias("prefix"),
            F.coalesce("b.k", F.lit(0)).cast("long").alias("n"), F.coalesce("b.rows", F.lit(0)).cast("long").alias("c"),
        )
        at = written(found.unionByName(at.where("c <= 1")))
        if at.where("c > 1").isEmpty():
            return at, False
    return at, True


def _cuts(at: DataFrame) -> DataFrame:
    """(s, passes, below): rows with a hash below are taken once more; the last row if that brings the sum nearer to the target."""
    nearer = (F.col("n") - F.col("left") <= F.col("left")) & (F.col("prefix") != "g")
    return at.select("s", "passes", F.when(nearer, F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix")).alias("below"))


def _goal(table: DataFrame, weights, share: float, most: int) -> DataFrame:
    return written(targets(table.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))


def _passes(hash_column, most: int):
    return F.least(F.col("passes") + (hash_column < F.col("below")).cast("long"), F.lit(most))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, source, text, anything else).

    ``size`` is the number of words, ``taken`` the words that the mix takes, a whole number of passes over
    the document; a source's sum is within half a document of its target. Null texts have size 0; null
    sources are a source of their own, after all others; null and equal ids are told apart by their texts,
    and rows equal in all of these by their place, which changes no result. A source without words has
    target 0. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", "text").withColumn("_place", F.monotonically_increasing_id())
    table = written(rows.select("doc_id", "source", n_words().alias("size"), _placed_hash().alias("hash")))
    goal = _goal(table, weights, share, most)
    at, _ = _refine(table, _start(goal), 0, DIGITS + PLACE_DIGITS)
    cut = written(_cuts(at).join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    return table.join(cut, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * _passes(F.col("hash"), most)).alias("taken")
    )


def repeat(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them (``taken`` / ``size`` times).

    Null and empty texts cost nothing and are taken by their hash like others. Only where equal rows must be
    told apart is the table written once more, with their places.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text")
    rows, own = packed, doc_hash()
    table = written(docs.select("source", n_words().alias("size"), doc_hash().alias("hash")))
    at, tied = _refine(table, _start(_goal(table, weights, share, most)), 0, DIGITS)
    if tied:
        rows, own = written(packed.withColumn("_place", F.monotonically_increasing_id())), _placed_hash()
        at, _ = _refine(rows.select("source", n_words().alias("size"), own.alias("hash")), at, DIGITS, DIGITS + PLACE_DIGITS)
    cut = written(_cuts(at))
    joined = rows.select("_row", "source", own.alias("_hash")).join(cut, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), _passes(F.col("_hash"), most).cast("int")))).select("_row.*")
