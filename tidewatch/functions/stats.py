"""Small statistics as columns: the percentile rule, ramps, the Erlang tail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def upper_percentile(sorted_values: Column, p: float) -> Column:
    """``sorted[min(n - 1, floor(p n))]`` of an ascending array; null if it is empty. At p = 0.5, the upper median."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(F.lit(p) * n).cast("int")))


def percentile_agg(value, p: float) -> Column:
    """The same rule as an aggregate. It holds a group's values, so groups must be of bounded size."""
    return upper_percentile(F.sort_array(F.collect_list(value)), p)


def percentile_by(df: DataFrame, keys: list[str], value: str, p: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """The rule for groups of any size, exactly, without ordering a group.

    Two approximate percentiles on both sides of the wanted rank, which Spark merges from partial sketches,
    enclose it; only different values between them, a small share, are counted and ordered, and all smaller
    ones are one count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sides = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", sides, accuracy).alias("_ends"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = rows.join(ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_ends"), same).where(F.col("_v") <= F.col("_ends")[1])
    counts = placed.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_ends")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    rank = F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    return counts.withColumn("_upto", F.sum("_c").over(run)).where((F.col("_upto") > rank) & F.col("_v").isNotNull()).groupBy(*keys).agg(F.min("_v").alias(name))


def counted_until(points: DataFrame, at: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """(us, upto): for each time of ``at`` (us), the sum of ``points`` (us, c) up to it.

    Sums run inside days, and over the totals of days, so that no window holds all rows.
    """
    both = points.select("us", F.col("c").cast("long").alias("c"), F.lit(False).alias("asked")).unionByName(at.select("us", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")).distinct())
    both = both.withColumn("day", F.floor(F.col("us") / F.lit(width)))
    days = both.groupBy("day").agg(F.sum("c").alias("_d"))
    before = F.sum("_d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("day", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("c").over(Window.partitionBy("day").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_inside", inside).where("asked").join(days, "day").select("us", (F.col("_inside") + F.col("_before")).alias("upto"))


def numbered(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (0, 1, ...) in the order of ``by``, for tables of any size.

    Rows are dealt to ranges of the order, each range is numbered on its own, and only the sizes of the ranges,
    one row for each, are summed up. Equal keys lie in one range.
    """
    dealt = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return dealt.withColumn(name, own).join(sizes, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def poisson_tail3(mu: Column) -> Column:
    """P(three or more events) at a mean of ``mu``."""
    return F.greatest(F.lit(0.0), 1 - F.exp(-mu) * (1 + mu + mu * mu / 2))


def hours_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(3.6e9)


#: Neighbours from which a node counts as a hub; nodes of a block, and hubs whose links are multiplied at once.
HUB, NODES, HUBS = 64, 1024, 4096


def adamic_adar(edges: DataFrame) -> DataFrame:
    """(a, b, score) of all pairs a < b with common neighbours: the sum of 1 / ln(degree) over those of degree above 1.

    Pairs of a node's few neighbours are listed. A hub's would be too many, so links to hubs are products of
    blocks: a task adds up what two blocks of nodes have in common over many hubs, and gives each pair once.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    weight = both.groupBy("b").agg(F.count("*").alias("deg")).where("deg > 1").select("b", "deg", (1 / F.log("deg")).alias("w"))
    near = written(both.join(weight, "b"))
    few, kind = near.where(F.col("deg") < HUB), near.schema["a"].dataType.simpleString()
    listed = few.alias("x").join(few.alias("y"), (F.col("x.b") == F.col("y.b")) & (F.col("x.a") < F.col("y.a"))).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.w").alias("w"))

    many = near.where(F.col("deg") >= HUB)
    n_hubs, n_nodes = many.agg(F.approx_count_distinct("b"), F.approx_count_distinct("a")).first()
    parts, chunks = 1 + n_nodes // NODES, 1 + n_hubs // HUBS
    placed = many.select("a", "b", "w", F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part"), F.pmod(F.xxhash64("b", F.lit(1)), F.lit(chunks)).alias("chunk"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        names, node = np.unique(pdf["a"].to_numpy(), return_inverse=True)
        hubs, hub = np.unique(pdf["b"].to_numpy(), return_inverse=True)
        w = np.zeros(len(hubs))
        w[hub] = pdf["w"].to_numpy()
        part = np.zeros(len(names), np.int64)
        part[node] = pdf["part"].to_numpy()
        links = np.zeros((len(names), len(hubs)))
        links[node, hub] = 1.0
        rows, cols = np.flatnonzero(part == low), np.flatnonzero(part == high)
        common = (links[rows] * w) @ links[cols].T
        i, j = np.nonzero(common)
        a, b = names[rows[i]], names[cols[j]]
        # inside a block each pair is met from both sides
        keep = (a < b) if low == high else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "w": common[i, j][keep]})

    met = other.groupBy("chunk", "low", "high").applyInPandas(meet, f"a {kind}, b {kind}, w double")
    return listed.unionByName(met).groupBy("a", "b").agg(F.sum("w").alias("score"))
