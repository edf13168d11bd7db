"""The ``items`` view over ``documents``, and smaller views, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import event_time
from ..functions.text import canonical_url
from ..session import table

START = "2024-01-01 00:00:00"
#: Where views are looked at from: the end of the 30 days that they cover.
NOW = "2024-01-30 12:00:00"
KINDS = ["STORY", "PAPER", "REPO", "POST", "RELEASE"]

SQL_CANON = r"""
CASE WHEN regexp_matches(url, '(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$') THEN
  'https://' || regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '^(www\.|m\.)', '')
  || regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
       lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z0-9_]+|fbclid|gclid|ref|ref_src|source|mc_cid|mc_eid|igshid|_hsenc|_hsmi)(=|$)')), '&'), ''), '')
  ELSE url END
"""

#: ``items`` for DuckDB, as a list of common table expressions.
SQL_ITEMS = rf"""
n AS (SELECT count(*) AS docs, 2592000 // greatest(count(*), 1) AS k FROM documents),
pages_n AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, url, {SQL_CANON} AS url_canon, count(*) OVER () AS c FROM pages),
raw AS (
  SELECT d.doc_id AS item_id, CAST(d.doc_id AS VARCHAR) AS external_id, d.source AS source_id,
         chr(CAST(65 + CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INTEGER) % 8 AS INTEGER)) AS family,
         ['STORY', 'PAPER', 'REPO', 'POST', 'RELEASE'][CAST(d.doc_id % 5 + 1 AS INTEGER)] AS kind,
         string_split(d.text, chr(10))[1] AS title, d.text, d.lang,
         TIMESTAMP '{START}' + to_seconds(CAST(d.doc_id * n.k AS BIGINT)) AS published_at,
         TIMESTAMP '{START}' + to_seconds(CAST(d.doc_id * n.k + (d.doc_id % 90) * 60 AS BIGINT)) AS first_seen_at,
         d.n_chars % 500 AS score_raw, d.n_chars % 50 AS comments, p.url, p.url_canon
  FROM documents d CROSS JOIN n JOIN pages_n p ON p.pos = d.doc_id % p.c),
items AS (
  SELECT *, CASE WHEN family IN ('E', 'H') THEN first_seen_at ELSE published_at END AS evt_at FROM raw)
"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the numbers of documents and pages."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("docs")).join(table(spark, sf_dir, "pages").agg(F.count("*").alias("n_pages")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(table(spark, sf_dir, "documents"), sizes(spark, sf_dir), spark, sf_dir)


def as_items(docs: DataFrame, counts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, and pages lend their addresses in turn."""
    start = F.lit(START).cast("timestamp")
    at = F.col("doc_id") * F.expr("2592000 div greatest(docs, 1)")
    after = lambda s: F.timestamp_micros(F.unix_micros(start) + s * F.lit(1_000_000))
    raw = docs.join(F.broadcast(counts)).select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("source").alias("source_id"),
        F.expr("char(65 + cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 8)").alias("family"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "lang",
        after(at).alias("published_at"),
        after(at + (F.col("doc_id") % 90) * 60).alias("first_seen_at"),
        (F.col("n_chars") % 500).alias("score_raw"),
        (F.col("n_chars") % 50).alias("comments"),
        (F.col("doc_id") % F.col("n_pages")).alias("pos"),
    )
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url", canonical_url("url").alias("url_canon"))
    return raw.join(pages, "pos").drop("pos").withColumn("evt_at", event_time(F.col("family"), F.col("published_at"), F.col("first_seen_at")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a zoned time, as watermarks and windows need it."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def with_items(tail: str, more: str = "") -> str:
    return f"WITH {SQL_ITEMS}{',' + more if more else ''} {tail}"
