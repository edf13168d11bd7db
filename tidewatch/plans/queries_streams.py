"""Registered queries that run a stream to its end and return what it made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import passes, weak
from ..registry import register
from ..session import shared_dir, written
from ..streaming import streams
from . import fixture
from .fixture import NOW, with_items
from .queries_items import LEX, SQL_TERMS, sql_has


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, one in each batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    base, _, leaf = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", leaf).parquet(base)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def result(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has made by the time its input is used up; each batch is written to a folder of its own.

    ``append``: all rows. ``update``: the last row of each of ``keys``. ``complete``: the last batch.
    """
    spark, where = df.sparkSession, shared_dir(df.sparkSession)
    batches: list[int] = []

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")
        batches.append(batch_id)

    streams.run_available(df, f"{where}/cursor", merge, mode).awaitTermination()
    if not batches:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{where}/out/batch={max(batches)}")
    out = spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{where}/out").parquet(*[f"{where}/out/batch={b}" for b in batches])
    return streams.latest(out, keys) if mode == "update" else out.drop("batch")


@register("st_hourly_counts", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(spark, sf_dir):
    return result(streams.hourly_counts(_stream(spark, sf_dir, "events"), "event_type"), "update", ["event_type", "hour"])


@register(
    "st_sliding_counts",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) AS start, count(*) AS n FROM events, (SELECT unnest(range(0, 6)) AS i) GROUP BY 1, 2",
)
def sliding(spark, sf_dir):
    return result(streams.sliding_counts(_stream(spark, sf_dir, "events"), "event_type"), "update", ["event_type", "start"])


@register(
    "st_activity",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM g)
       SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 6 HOUR AS closed_at, count(*) AS n FROM s GROUP BY user_id, spell""",
)
def activity(spark, sf_dir):
    return result(streams.activity(_stream(spark, sf_dir, "events"), "user_id", gap="6 hours"), "complete")


@register("st_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen(spark, sf_dir):
    return result(streams.first_seen_once(_stream(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@register("st_leader_topics")
def leader_topics(spark, sf_dir):
    """Embeddings a minute apart, in buckets by label; 0.3 since no pair of them reaches 0.62."""
    e = _stream(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.unix_seconds(F.lit(fixture.START).cast("timestamp")) + F.col("vec_id") * 60)
    rows = e.select(F.col("label").alias("bucket"), F.col("vec_id").alias("item_id"), at.alias("ts"), F.col("embedding").cast("array<double>").alias("v"))
    return result(streams.leader_topics(rows, threshold=0.3), "append")


_SINCE = "2024-01-16 12:00:00"
_SQL_RELEVANT = f"starts_with(source_id, 'src1') OR {sql_has(chr(108) + 'ower(coalesce(title, {0}) || {1} || substr(coalesce(text, {0}), 1, 300))'.format(chr(39) * 2, chr(39) + ' ' + chr(39)), LEX.keywords)}"


@register(
    "w0_weak_pass",
    with_items(
        f"""SELECT term, CAST(first_seen_at AS DATE) AS day, count(*) AS n, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources, array_to_string(list_sort(list(DISTINCT family)), ',') AS families
            FROM terms JOIN (SELECT item_id FROM items WHERE ({_SQL_RELEVANT}) AND family <> 'G' AND first_seen_at > TIMESTAMP '{_SINCE}' AND first_seen_at <= TIMESTAMP '{NOW}') USING (item_id) GROUP BY 1, 2""",
        SQL_TERMS,
    ),
)
def weak_pass(spark, sf_dir):
    """The term state after passes over documents as they arrive: relevant, no press, of the first pass's 14 days."""
    where = shared_dir(spark)
    sizes = written(fixture.sizes(spark, sf_dir))

    def update(before, batch):
        # a batch is a file, so its rows are dealt to all cores
        batch = batch.repartition(spark.sparkContext.defaultParallelism, "doc_id")
        items = weak.pass_items(fixture.as_items(batch, sizes, spark, sf_dir), LEX, NOW, None)
        new = items.select("source_id", "family", F.col("first_seen_at").alias("ts"), F.explode(terms.terms(F.col("text"), LEX)).alias("term"))
        return weak.daily_counts(new) if before is None else weak.increment_daily(before, new)

    state = streams.run_weak_passes(_stream(spark, sf_dir, "documents"), f"{where}/cursor", f"{where}/state", update, weak.merge_daily)
    state = weak.empty_daily(spark) if state is None else state
    return state.withColumns({"sources": F.array_join("sources", ","), "families": F.array_join("families", ",")})


#: Times of the passes: the first one takes 14 days, the others what came since.
PASSES = ("2024-01-16 12:00:00", "2024-01-23 00:00:00", NOW)


@register("w0_pass_signals")
def pass_signals(spark, sf_dir):
    """Signals of three passes, each of which goes on from the states of the one before."""
    i = fixture.items(spark, sf_dir)
    i = i.withColumns({"cred": weak.prior_credibility(F.col("family"), F.col("source_id") == "src3"), "precocity": F.when(F.col("family") != "C", 0.25)})
    i = i.withColumns({"terms": terms.proper_nouns(F.col("title"), LEX), "entities": terms.entities(F.col("title"), LEX)})
    i = written(i.select("item_id", "source_id", "family", "title", "text", "first_seen_at", "cred", "precocity", "terms", "entities"))
    store = passes.Store(spark, shared_dir(spark), buckets=16, day_parts=1)
    for now in PASSES:
        last = passes.run_pass(store, i, LEX, now)
    return store.read(last, "signals").select("detector", "ns", "key", "item_id", "detected_at", "families", F.floor(F.col("bits") * 1e6 + 0.5).alias("bits_e6"), "passed_at")
