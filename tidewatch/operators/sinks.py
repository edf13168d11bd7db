"""What a page needs, as JSON rows, a feed's text, and a staged overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_json(topics: DataFrame, top: int = 60) -> DataFrame:
    """(cluster_id, json) of the best topics, each with all its columns nested as they are."""
    best = topics.orderBy(F.desc("score"), "cluster_id").limit(top)
    return best.select("cluster_id", F.to_json(F.struct(*topics.columns)).alias("json"))


def escape_xml(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def rss_items(topics: DataFrame, top: int = 25) -> DataFrame:
    """(cluster_id, xml) of the best topics (cluster_id, label, url, score, first_seen_at)."""
    best = topics.orderBy(F.desc("score"), "cluster_id").limit(top)
    xml = F.concat(
        F.lit("<item><title>"), escape_xml(F.coalesce("label", F.lit(""))), F.lit("</title><link>"), escape_xml(F.coalesce("url", F.lit(""))), F.lit("</link><guid>topic-"), F.col("cluster_id").cast("string"),
        F.lit("</guid><pubDate>"), F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>"),
    )
    return best.select("cluster_id", xml.alias("xml"))


def latest_items(items: DataFrame, now, hours: int = 24, top: int = 600) -> DataFrame:
    """The newest items of the last hours, newest first."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return items.where((F.col("first_seen_at") >= since) & (F.col("first_seen_at") <= F.lit(now).cast("timestamp"))).orderBy(F.desc("first_seen_at"), F.desc("item_id")).limit(top)


def write_staged(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``, so that ``df`` may read it: written beside it, then moved into its place.

    The old table is moved aside before and removed after, so that at no time less than one whole table is
    there: where a crash came between the two moves, it lies at ``<path>__old``, and ``read_staged`` finds it.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staging, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}__staging", path, f"{path}__old"))
    df.write.mode("overwrite").parquet(f"{path}__staging")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"can't move {target} to {old}")
    if not fs.rename(staging, target):
        raise OSError(f"can't move {staging} to {target}")
    fs.delete(old, True)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_staged`` keeps at ``path``, or the one before where a write was broken off between its moves."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else f"{path}__old")
