"""Topic scores: hourly term counts, seasonal bursts, snapshots and the weighted sum of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp01, hours_between, numbered
from .items import _at

ACTIVE_HOURS = 72
# The weights of the score's components.
WEIGHTS = {"families": 25, "burst": 20, "hn": 15, "github": 10, "hf": 10, "official": 10, "social": 10}
PRESS = "G"


def term_hourly(terms: DataFrame, now, days: int = 7) -> DataFrame:
    """(term, hour, n) of (term, ts): the last ``days`` days and the six hours that the oldest baseline needs."""
    since = F.date_trunc("hour", _at(now)) - F.expr(f"INTERVAL {24 * days + 5} HOURS")
    return terms.where((F.col("ts") >= since) & (F.col("ts") <= _at(now))).groupBy("term", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


def term_burst(hourly: DataFrame, now) -> DataFrame:
    """(term, cur, mean, sd, z): the running hour and the five before against the same six hours of seven days.

    Days without the term count as 0; z = (cur - mean) / max(sd, sqrt(mean), 1) with the population's sd.
    """
    ago = (F.unix_timestamp(F.date_trunc("hour", _at(now))) - F.unix_timestamp("hour")) / 3600
    h = hourly.withColumn("ago", ago.cast("long")).where("ago >= 0 and ago % 24 < 6 and ago < 174")
    day = (F.col("ago") / 24).cast("int")
    sums = h.groupBy("term").agg(*[F.coalesce(F.sum(F.when(day == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(8)])
    base = [F.col(f"d{d}") for d in range(1, 8)]
    total, squares = sum(base[1:], base[0]), sum((b * b for b in base[1:]), base[0] * base[0])
    mean = total / F.lit(7.0)
    sd = F.sqrt((F.lit(7) * squares - total * total).cast("double")) / F.lit(7.0)
    out = sums.select("term", F.col("d0").alias("cur"), mean.alias("mean"), sd.alias("sd"))
    return out.withColumn("z", (F.col("cur") - F.col("mean")) / F.greatest(F.col("sd"), F.sqrt("mean"), F.lit(1.0)))


def topic_bursts(members: DataFrame, bursts: DataFrame, top: int = 8) -> DataFrame:
    """(cluster_id, burst_term, z): the strongest real burst among a topic's most frequent terms."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term")
    frequent = members.groupBy("cluster_id", "term").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    real = frequent.join(bursts, "term").where("cur >= 5 and cur >= 2 * mean")
    return real.groupBy("cluster_id").agg(F.max(F.struct("z", "term")).alias("b")).select("cluster_id", F.col("b.term").alias("burst_term"), F.col("b.z").alias("z"))


def star_deltas(snaps: DataFrame, now) -> DataFrame:
    """(key, stars_delta): the latest score less the first one of the last 24 hours, or the first of all."""
    recent = F.col("ts") >= _at(now) - F.expr("INTERVAL 24 HOURS")
    # the earliest recent snapshot, a later one if scores tie on time
    s = snaps.groupBy("key").agg(
        F.max(F.struct("ts", "score")).alias("last"),
        F.min(F.when(recent, F.struct("ts", "score"))).alias("near"),
        F.min(F.struct("ts", "score")).alias("first"),
    )
    return s.select("key", (F.col("last.score") - F.coalesce(F.col("near.score"), F.col("first.score"))).alias("stars_delta"))


def components(members: DataFrame, now) -> DataFrame:
    """One row for each topic of ``members`` (cluster_id and item columns), active in the last 72 hours."""
    now = _at(now)
    within = lambda c, h: F.col(c) >= now - F.expr(f"INTERVAL {h} HOURS")
    press = F.col("family") == PRESS
    age = F.least(F.greatest(hours_between(now, F.col("evt_at")), F.lit(0.5)), F.lit(24.0))
    out = members.where(F.col("evt_at") <= now).groupBy("cluster_id").agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_set(F.when((within("evt_at", 6) | within("last_seen_at", 6)) & ~press, F.col("family")))).alias("families_6h"),
        F.coalesce(F.max(F.when(F.col("family") == "A", F.coalesce("score_raw", F.lit(0)) / age)), F.lit(0.0)).alias("hn"),
        F.coalesce(F.max(F.when(F.col("kind") == "PAPER", F.col("score_raw"))), F.lit(0)).alias("upvotes"),
        F.bool_or(F.col("kind") == "TREND").alias("trending"),
        F.bool_or((F.col("family") == "F") & F.col("major") & within("evt_at", 24)).alias("official"),
        F.count_if((F.col("family") == "D") & within("evt_at", 6)).alias("social_6h"),
        F.max("evt_at").alias("last_at"),
        F.min(F.when(~press, F.col("evt_at"))).alias("first_other"),
        F.min(F.when(press, F.col("evt_at"))).alias("first_press"),
        F.count_if(press).alias("n_press"),
        F.count_if(within("evt_at", 3)).alias("last_3h"),
        F.count_if(within("evt_at", 6) & ~within("evt_at", 3)).alias("before_3h"),
    )
    return out.where(F.col("last_at") >= now - F.expr(f"INTERVAL {ACTIVE_HOURS} HOURS"))


def sparkline(members: DataFrame, now) -> DataFrame:
    """(cluster_id, hours): items in each of the last 24 clock hours, oldest first."""
    ago = ((F.unix_timestamp(F.date_trunc("hour", _at(now))) - F.unix_timestamp(F.date_trunc("hour", F.col("evt_at")))) / 3600).cast("int")
    h = members.withColumn("ago", ago).where("ago between 0 and 23")
    return h.groupBy("cluster_id").agg(F.array(*[F.count_if(F.col("ago") == 23 - i) for i in range(24)]).alias("hours"))


def score(parts: DataFrame, now) -> DataFrame:
    """Weighted sum of ramps, capped at 15 without evidence, times freshness, with the press status."""
    c, w = F.col, WEIGHTS
    fam, z, stars = F.size("families_6h"), F.coalesce("z", F.lit(0.0)), F.coalesce("stars_delta", F.lit(0))
    papers = F.greatest(clamp01(c("upvotes") / 20), F.when(c("trending"), 0.5).otherwise(0.0))
    raw = (
        w["families"] * clamp01((fam - 1) / 2) + w["burst"] * clamp01(z / 6) + w["hn"] * clamp01(c("hn") / 10) + w["github"] * clamp01(stars / 500)
        + w["hf"] * papers + F.when(c("official"), F.lit(float(w["official"]))).otherwise(0.0) + w["social"] * clamp01(c("social_6h") / 20)
    )
    evidence = c("official") | (c("hn") >= 3) | (stars >= 100) | (c("upvotes") >= 10) | (fam >= 2) | (z >= 3)
    capped = F.when((c("n_items") < 2) & ~evidence, F.least(raw, F.lit(15.0))).otherwise(raw)
    age = hours_between(_at(now), c("last_at"))
    fresh = F.when(age <= 6, F.lit(1.0)).otherwise(F.greatest(F.lit(0.4), 1 - 0.6 * (age - 6) / 42))
    status = (
        F.when(c("n_press") == c("n_items"), "PRESS_ONLY").when(c("n_press") >= 3, "CONFIRMED").when(c("n_press") >= 1, "LIGHT_PRESS").otherwise("ANTICIPATION")
    )
    return parts.withColumns({"score": capped * fresh, "status": status, "press_first": F.coalesce(c("first_press") < c("first_other"), F.lit(False))})


def ranked(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Topics by score, ties to the smaller id, with their rank."""
    if top is None:
        return numbered(scored, [F.desc("score"), F.col("cluster_id")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    best = scored.orderBy(F.desc("score"), "cluster_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "cluster_id")))
