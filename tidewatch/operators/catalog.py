"""Catalog snapshots: what is new, the events it makes, and job postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hours_between
from ..functions.text import domain_of
from .items import _at

FIRST_PASS_HOURS = 48


def new_entries(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose (catalog_id, key) the previous snapshot doesn't have."""
    return current.join(previous.select("catalog_id", "key"), ["catalog_id", "key"], "left_anti")


def catalog_events(previous: DataFrame, current: DataFrame, signals: DataFrame, now) -> DataFrame:
    """Signals (catalog_id, key, title, event_at) of a pass.

    A catalog without a previous snapshot is seeded silently, except for entries dated within 48 hours;
    dates that come from a commit (``dated_by_commit``) don't count for that. Later, every new key is an
    event. Keys that are signals already are left out, so that a pass can be repeated.
    """
    now = _at(now)
    known = previous.select("catalog_id", F.lit(False).alias("first_pass")).distinct()
    fresh = new_entries(previous, current).join(known, "catalog_id", "left").withColumn("first_pass", F.coalesce("first_pass", F.lit(True)))
    recent = F.coalesce(hours_between(now, F.col("event_at")) <= FIRST_PASS_HOURS, F.lit(False)) & ~F.col("dated_by_commit")
    out = fresh.where(~F.col("first_pass") | recent).dropDuplicates(["catalog_id", "key"])
    return out.join(signals.select("catalog_id", "key"), ["catalog_id", "key"], "left_anti").select("catalog_id", "key", "title", F.coalesce("event_at", now).alias("event_at"))


def job_events(postings: DataFrame, jobs: DataFrame, now, shown: int = 6) -> DataFrame:
    """One event for each board with new postings: (board, key, n, titles). On a board's first pass only those of 48 hours count."""
    now = _at(now)
    known = postings.select("board", F.lit(False).alias("first_pass")).distinct()
    fresh = jobs.join(postings.select("board", "job_id"), ["board", "job_id"], "left_anti").dropDuplicates(["board", "job_id"])
    fresh = fresh.join(known, "board", "left").withColumn("first_pass", F.coalesce("first_pass", F.lit(True)))
    kept = fresh.where(~F.col("first_pass") | (hours_between(now, F.col("published_at")) <= FIRST_PASS_HOURS))
    from pyspark.sql import Window

    first = Window.partitionBy("board").orderBy("job_id")
    top = kept.withColumn("_r", F.row_number().over(first))
    titles = F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= shown, F.struct("_r", "title")))), lambda x: x["title"])
    return top.groupBy("board").agg(F.count("*").alias("n"), titles.alias("titles")).withColumn("key", F.concat(F.lit("jobs:"), F.date_format(now, "yyyy-MM-dd'T'HH:mm")))


def job_history(postings: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """Postings after a pass: first and last sight of each (board, job_id), the newest title."""
    new = jobs.select("board", "job_id", "title", _at(now).alias("first_seen_at"), _at(now).alias("last_seen_at"))
    both = postings.select("board", "job_id", "title", "first_seen_at", "last_seen_at").unionByName(new)
    return both.groupBy("board", "job_id").agg(F.max_by("title", "last_seen_at").alias("title"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def changed_states(states: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, versions): the ``states`` (catalog_id, body) whose body isn't the one of ``versions`` (catalog_id, digest), and the
    versions after this pass. Only changed bodies need parsing; a null body was not read and keeps its version."""
    read = states.where("body is not null").withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    changed = read.join(versions.select("catalog_id", "digest"), ["catalog_id", "digest"], "left_anti")
    kept = versions.select("catalog_id", "digest").join(changed.select("catalog_id"), "catalog_id", "left_anti")
    return changed, kept.unionByName(changed.select("catalog_id", "digest"))


def describe(kind: Column, title: Column, url: Column, event_at: Column, now) -> Column:
    """A readable reason for an event; entries older than 72 hours were made visible long after their creation."""
    age = F.floor(hours_between(_at(now), event_at) + 0.5)
    made = F.when(event_at.isNull(), F.lit("creation date unknown")).when(age > 72, F.concat(F.lit("created on "), F.date_format(event_at, "yyyy-MM-dd"), F.lit(", made visible long after its creation"))).otherwise(
        F.concat(F.lit("created "), age.cast("string"), F.lit(" h ago"))
    )
    host = F.coalesce(domain_of(url), F.lit("an unknown host"))
    lead = {
        "openrouter_stealth": "New stealth model", "litellm_prices": "New key in a price file", "hf_org": "New hub repository", "github_org": "New code repository",
        "inference_pulls": "Pull request that adds a model", "sirene": "New company in the register", "edgar_form_d": "New filing", "polymarket_events": "New prediction market",
        "discord_widget": "New visible channel", "ashby_jobs": "New team or postings", "greenhouse_jobs": "New team or postings",
    }
    out = F.when(kind == "sitemap", F.concat(F.lit("New address in the sitemap of "), host, F.lit(": "), title)).when(kind == "changelog_md", F.concat(F.lit("New changelog entry at "), host, F.lit(": "), title))
    out = out.when(kind == "status_components", F.concat(F.lit("New component on the status page "), host, F.lit(": "), title, F.lit(", "), made))
    out = out.when(kind == "discourse_categories", F.concat(F.lit("New category on the forum "), host, F.lit(": "), title))
    for k, text in lead.items():
        out = out.when(kind == k, F.concat(F.lit(f"{text}: "), title, F.lit(", "), made))
    return out.otherwise(F.concat(F.lit("New entry: "), title))
