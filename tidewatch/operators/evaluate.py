"""Detections, their evaluation against later press, publications and their outcomes, and the brief ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hours_between, numbered, percentile_by
from .items import _at
from .joins import as_of

HORIZONS = (24, 48, 72)


def record_detections(scores: DataFrame) -> DataFrame:
    """(cluster_id, first_seen_at, first_score, best_rank, best_score) from (cluster_id, computed_at, score): ranks within each pass."""
    # places over all passes, less the place at which the pass begins: no pass is ordered in one task
    placed = numbered(scores, [F.col("computed_at").asc(), F.desc("score"), F.col("cluster_id").asc()])
    begin = placed.groupBy("computed_at").agg(F.min("place").alias("begin"))
    r = placed.join(begin, "computed_at").withColumn("rank", (F.col("place") - F.col("begin") + 1).cast("int"))
    return r.groupBy("cluster_id").agg(
        F.min("computed_at").alias("first_seen_at"), F.min_by("score", "computed_at").alias("first_score"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score")
    )


def evaluate_due(detections: DataFrame, articles: DataFrame, done: DataFrame, now) -> DataFrame:
    """(cluster_id, horizon_h, before_24h, after_h, first_press_at, hit) of detections that reached a horizon.

    Candidates were among the first 20 or scored 30. A hit has three articles within the horizon and none in
    the 24 hours before. Articles are (cluster_id, url, published_at); an address counts once.
    """
    hours = F.explode(F.array(*[F.lit(h) for h in HORIZONS]))
    due = detections.where("best_rank <= 20 or best_score >= 30").withColumn("horizon_h", hours)
    due = due.where(hours_between(_at(now), F.col("first_seen_at")) >= F.col("horizon_h")).join(done.select("cluster_id", "horizon_h"), ["cluster_id", "horizon_h"], "left_anti")
    one = articles.groupBy("cluster_id", "url").agg(F.min("published_at").alias("published_at"))
    lag = hours_between(F.col("published_at"), F.col("first_seen_at"))
    j = due.join(one, "cluster_id", "left").withColumn("lag", lag)
    after = (F.col("lag") >= 0) & (F.col("lag") <= F.col("horizon_h"))
    out = j.groupBy("cluster_id", "horizon_h", "first_seen_at", "best_rank").agg(
        F.count_if((F.col("lag") >= -24) & (F.col("lag") < 0)).alias("before_24h"), F.count_if(after).alias("after_h"), F.min(F.when(after, F.col("published_at"))).alias("first_press_at")
    )
    return out.withColumn("hit", (F.col("after_h") >= 3) & (F.col("before_24h") == 0))


def daily_metrics(evaluations: DataFrame) -> DataFrame:
    """(day, n, precision_10, median_lead_h, already) at 48 hours, by day of detection; precision is null without candidates."""
    e = evaluations.where("horizon_h = 48").withColumn("day", F.to_date("first_seen_at"))
    top = F.col("best_rank") <= 10
    out = e.groupBy("day").agg(F.count("*").alias("n"), (F.count_if(top & F.col("hit")) / F.nullif(F.count_if(top), F.lit(0))).alias("precision_10"), F.count_if(F.col("before_24h") > 0).alias("already"))
    lead = e.where(top & F.col("hit")).withColumn("lead", hours_between(F.col("first_press_at"), F.col("first_seen_at")))
    return out.join(percentile_by(lead, ["day"], "lead", 0.5, "median_lead_h"), "day", "left")


def mark_published(publications: DataFrame, scores: DataFrame, topics: DataFrame | None = None, press: DataFrame | None = None) -> DataFrame:
    """(pub_id, cluster_id, published_at, score, status, families, label, first_seen_at, lead_vs_press_h): what held at publication, frozen.

    Score, status and families are the topic's latest at that time, null for a publication before its first
    score; the lead is from the topic's first item to its first article, in hours with one decimal, null
    without ``topics`` (cluster_id, label, first_seen_at) or ``press`` (cluster_id, first_at).
    """
    spark = publications.sparkSession
    topics = topics if topics is not None else spark.createDataFrame([], publications.select("cluster_id").schema.add("label", "string").add("first_seen_at", "timestamp"))
    press = press if press is not None else spark.createDataFrame([], publications.select("cluster_id").schema.add("first_at", "timestamp"))
    for c in ("status", "families"):
        scores = scores if c in scores.columns else scores.withColumn(c, F.lit(None).cast("string"))
    j = as_of(publications.select("pub_id", "cluster_id", "published_at"), scores, ["cluster_id"], "published_at", "computed_at", ["score", "status", "families"], "held")
    j = j.join(topics.select("cluster_id", "label", "first_seen_at"), "cluster_id", "left").join(press.select("cluster_id", "first_at"), "cluster_id", "left")
    lead = F.round(hours_between(F.col("first_at"), F.col("first_seen_at")), 1)
    return j.select("pub_id", "cluster_id", "published_at", "held.score", "held.status", "held.families", "label", "first_seen_at", lead.alias("lead_vs_press_h"))


def publication_report(publications: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """(dimension, value, n, median_impressions) of each post's latest measure, by status, language and platform, if there are ``least`` posts."""
    last = outcomes.groupBy("pub_id").agg(F.max_by("impressions", "measured_at").alias("impressions"))
    j = publications.join(last, "pub_id")
    dims = j.select("pub_id", "impressions", F.explode(F.create_map(*[x for d in ("status", "lang", "platform") for x in (F.lit(d), F.col(d))])).alias("dimension", "value"))
    n = dims.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    med = percentile_by(dims, ["dimension", "value"], "impressions", 0.5, "median_impressions")
    return n.join(med.where("value is not null"), ["dimension", "value"]).where(F.col("n") >= least)


def spent_today(calls: DataFrame, now) -> DataFrame:
    """Cost of the day's briefs, in dollars, and their number, from the call ledger."""
    return calls.where((F.col("purpose") == "brief") & (F.to_date("created_at") == F.to_date(_at(now)))).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"), F.count("*").alias("calls"))


def briefs_due(topics: DataFrame, briefs: DataFrame, now, stale_hours: int = 6, most: int = 30) -> DataFrame:
    """Topics to brief: without a brief, or whose set of items changed and whose brief is stale, best first.

    The set is known by the SHA-1 of its sorted item ids.
    """
    t = topics.withColumn("item_set", F.sha1(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",").cast("binary")))
    j = t.join(briefs.select("cluster_id", F.col("item_set").alias("old_set"), "created_at"), "cluster_id", "left")
    stale = hours_between(_at(now), F.col("created_at")) >= stale_hours
    return j.where(F.col("old_set").isNull() | ((F.col("old_set") != F.col("item_set")) & stale)).orderBy(F.desc("score"), "cluster_id").limit(most).select("cluster_id", "score", "item_set")
