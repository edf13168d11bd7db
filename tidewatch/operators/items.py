"""Upsert, retention and cadence of observed items. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hours_between, percentile_by
from ..functions.text import canonical_url

MAX_AGE_DAYS = 14
KEY = ["source_id", "external_id"]


def _at(now) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def accepted(batch: DataFrame, existing: DataFrame, now) -> DataFrame:
    """Rows of a batch that an upsert takes: with id and title, and, if new and not of families E or H, of the
    last 14 days. Of rows with one key, the last by ``batch_pos`` is taken."""
    now = _at(now)
    sound = batch.where((F.coalesce("external_id", F.lit("")) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    last = Window.partitionBy(*KEY).orderBy(F.desc("batch_pos"))
    one = sound.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    known = existing.select(*KEY, F.lit(True).alias("known")).distinct()
    old = F.col("published_at") < now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS")
    return one.join(known, KEY, "left").withColumn("known", F.coalesce("known", F.lit(False))).where(F.col("known") | F.col("family").isin("E", "H") | ~F.coalesce(old, F.lit(False)))


def upsert(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """``existing`` after a batch: one full join on the key.

    New rows are first and last seen now, with title and text cut at 500 and 2000 characters. Known rows
    keep their first sight and payload; score and comments change to non-null values, the title to a
    non-empty one.
    """
    new = accepted(batch, existing, now).select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("family", "kind", "url", "title", "text", "published_at", "score_raw", "comments")])
    now = _at(now)
    j = existing.join(new.withColumn("_new", F.lit(True)), KEY, "full_outer")
    fresh, seen = F.col("first_seen_at").isNull(), F.col("_new").isNotNull()
    keep = lambda c, cut=None: F.when(fresh, F.substring(f"n_{c}", 1, cut) if cut else F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        *KEY,
        keep("family"), keep("kind"), keep("url"),
        F.when(fresh, canonical_url("n_url")).otherwise(F.col("url_canon")).alias("url_canon"),
        F.when(fresh, F.substring("n_title", 1, 500)).otherwise(F.coalesce(F.nullif("n_title", F.lit("")), "title")).alias("title"),
        keep("text", 2000), keep("published_at"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.coalesce("n_score_raw", "score_raw").alias("score_raw"),
        F.coalesce("n_comments", "comments").alias("comments"),
    )


def snapshots(batch: DataFrame, taken: DataFrame, now) -> DataFrame:
    """New score snapshots of a batch: one for each key and time, only those not taken yet."""
    rows = batch.where(F.col("score_raw").isNotNull() | (F.coalesce(F.col("rank"), F.lit(0)) != 0))
    rows = rows.select(*KEY, _at(now).alias("ts"), "score_raw", "comments", "rank").dropDuplicates([*KEY, "ts"])
    return rows.join(taken.select(*KEY, "ts"), [*KEY, "ts"], "left_anti")


def median_latency(new_items: DataFrame, now) -> DataFrame:
    """(source_id, latency_min): upper median of the minutes from publication to first sight, halves rounded up."""
    minutes = new_items.where("published_at is not null").select("source_id", (hours_between(_at(now), F.col("published_at")) * 60).alias("m"))
    return percentile_by(minutes, ["source_id"], "m", 0.5, "m").select("source_id", F.floor(F.col("m") + 0.5).alias("latency_min"))


def due(sources: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Sources (source_id, every_min) whose last good run is at least every_min - 2 minutes ago, or missing."""
    last = runs.where("status = 'OK'").groupBy("source_id").agg(F.max("started_at").alias("last_ok"))
    since = hours_between(_at(now), F.col("last_ok")) * 60
    return sources.join(last, "source_id", "left").where(F.col("last_ok").isNull() | (since >= F.col("every_min") - 2))


def purge_items(items: DataFrame, now, days: int = 14) -> DataFrame:
    """Items of the last ``days`` days: by publication, for families E and H and undated ones by last sight."""
    seen = F.when(F.col("family").isin("E", "H") | F.col("published_at").isNull(), F.col("last_seen_at")).otherwise(F.col("published_at"))
    return items.where(seen >= _at(now) - F.expr(f"INTERVAL {days} DAYS"))


def purge_by_time(rows: DataFrame, column: str, now, days: int) -> DataFrame:
    return rows.where(F.col(column) >= _at(now) - F.expr(f"INTERVAL {days} DAYS"))


def purge_vectors(vectors: DataFrame, items: DataFrame, now, days: int = 4) -> DataFrame:
    """Vectors of items that still exist and were made within ``days`` days."""
    return purge_by_time(vectors, "created_at", now, days).join(items.select("item_id").distinct(), "item_id", "left_semi")


def purge_scores(scores: DataFrame, now, hours: int = 6) -> DataFrame:
    """Scores of the last hours, and each topic's latest whatever its age."""
    latest = Window.partitionBy("cluster_id").orderBy(F.desc("computed_at"))
    recent = F.col("computed_at") >= _at(now) - F.expr(f"INTERVAL {hours} HOURS")
    return scores.withColumn("_n", F.row_number().over(latest)).where(recent | (F.col("_n") == 1)).drop("_n")


def status(items: DataFrame, now) -> DataFrame:
    """Counts by family and source, over all time and the last day, with first and last sight."""
    day = F.col("first_seen_at") >= _at(now) - F.expr("INTERVAL 24 HOURS")
    return items.groupBy("family", "source_id").agg(
        F.count("*").alias("n"), F.count_if(day).alias("n_24h"), F.min("first_seen_at").alias("first_at"), F.max("first_seen_at").alias("last_at")
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source, by its id."""
    row = F.struct("started_at", "status", "error", "n_items", "latency_min")
    return runs.groupBy("source_id").agg(F.max_by(row, "run_id").alias("r")).select("source_id", "r.*")
