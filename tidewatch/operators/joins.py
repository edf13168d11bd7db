"""Joins by time: the last row before a time or the first one after it, and running counts, without a key's pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in microseconds: what of one key lies in one bucket is ordered in one task.
DAY = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], name: str, forward: bool = False, strict: bool = False, width: int = DAY) -> DataFrame:
    """``left`` with ``name``, a struct of ``values`` and ``at`` of the right row of the same keys that is the last at or before its
    time (``forward``: the first at or after it; ``strict``: not at it), or null.

    Both sides are one table, cut by keys and time bucket and ordered inside; what a bucket starts with comes from a
    table of one row for each key and bucket. A key with any share of the rows is spread over its buckets. Of right
    rows at one time, the one with the greatest values counts. Rows of the left without a key or time get null.
    """
    sign = -1 if forward else 1
    us = lambda c: F.unix_micros(c) * sign
    bucket = F.floor(F.col("_us") / F.lit(width)).alias("_bucket")
    kinds = right.select(*keys, F.struct(F.col(right_at).alias("at"), *values).alias("_r")).schema["_r"].dataType
    l = left.select(*keys, us(left_at).alias("_us"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    r = right.where(F.col(right_at).isNotNull()).dropna(subset=keys).select(*keys, us(right_at).alias("_us"), F.struct(F.col(right_at).alias("at"), *values).alias("_r"))
    both = l.withColumns({"_r": F.lit(None).cast(kinds), "_side": F.lit(0 if strict else 1)}).unionByName(r.withColumns({"_l": F.lit(None).cast(l.schema["_l"].dataType), "_side": F.lit(1 if strict else 0)}))
    both = both.withColumn("_bucket", bucket)
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_us", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_in", F.last("_r", ignorenulls=True).over(upto)).where("_l is not null")

    ends = r.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max(F.struct("_us", "_r")).alias("_e")).select(*keys, "_bucket", F.col("_e._r").alias("_end"))
    asked = l.withColumn("_bucket", bucket).select(*keys, "_bucket").distinct().withColumn("_end", F.lit(None).cast(kinds))
    marks = ends.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)))
    # rows of both kinds in one bucket: neither may see the bucket's own end
    before = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_asked").select(*keys, "_bucket", "_before")
    found = placed.join(carried, [*keys, "_bucket"], "left")
    return found.select("_l.*", F.coalesce("_in", "_before").alias(name))


def running_count(rows: DataFrame, keys: list[str], at: str, width: int = DAY) -> DataFrame:
    """(keys, at, n): for each different time of a key, how many of its rows are at or before it. ``at`` is in microseconds."""
    counts = rows.groupBy(*keys, at).agg(F.count("*").alias("_c")).withColumn("_bucket", F.floor(F.col(at) / F.lit(width)))
    whole = counts.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_in", inside).join(whole, [*keys, "_bucket"]).select(*keys, at, (F.col("_in") + F.col("_before")).alias("n"))


def each(column: str, values: list) -> Column:
    """A row for each of a few values."""
    return F.explode(F.array(*map(F.lit, values))).alias(column)
