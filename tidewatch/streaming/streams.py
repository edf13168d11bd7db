"""Structured Streaming forms: watermarked counts, deduplication, stateful upserts, and stateful topics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "14 days"
#: States of batches that become one.
FOLD = 8


def timed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Event time with a zone, and late data up to the age limit of new items."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, LATE)


def hourly_counts(stream: DataFrame, key: str, column: str = "ts") -> DataFrame:
    """(key, hour, n) in tumbling hours."""
    return timed(stream, column).groupBy(key, F.window(column, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("hour"), "n")


def sliding_counts(stream: DataFrame, key: str, column: str = "ts") -> DataFrame:
    """(key, start, n) in six hours, every hour: the burst's sums."""
    return timed(stream, column).groupBy(key, F.window(column, "6 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def activity(stream: DataFrame, key: str, column: str = "ts", gap: str = "72 hours") -> DataFrame:
    """Spells of activity that a gap ends."""
    w = F.session_window(column, gap)
    return timed(stream, column).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "n")


def first_seen_once(stream: DataFrame, keys: list[str], column: str = "ts") -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(stream, column).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Everything that has arrived since the last call, by ``merge(batch, batch_id)``; the checkpoint is the cursor.

    A batch may come again after a failure, so ``merge`` writes by key or by batch id.
    """
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def _whole(spark, state_dir: str) -> list[int]:
    """The batches whose state was written to the end: their folders have a success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path)]
    return [int(f.getName()) for f in names if fs.exists(f.suffix("/_SUCCESS"))]


def weak_pass(items: DataFrame, checkpoint: str, state_dir: str, update: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """New items merged into a table of state: each batch's state is written beside the last one's, by batch id.

    ``update(previous or None, batch)`` gives the next state. A batch that is repeated writes the same folder.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        there = batch_id - 1 in _whole(spark, state_dir)
        before = spark.read.parquet(f"{state_dir}/{batch_id - 1}") if there else None
        update(before, batch).write.mode("overwrite").parquet(f"{state_dir}/{batch_id}")
        # a batch that comes again needs the state before it, and none older
        for old in _whole(spark, state_dir):
            if old < batch_id - 1:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/{old}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run_available(items, checkpoint, merge)


def run_weak_passes(items: DataFrame, checkpoint: str, state_dir: str, update: Callable[[DataFrame | None, DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """``weak_pass`` over all that has arrived, and the state after it, None if there never was a batch.

    The state is found by its folders and not by this run's progress, so a run without new items gives it too.
    With ``merge``, which makes one state of the rows of several, states are kept in parts (``parted_pass``).
    """
    spark = items.sparkSession
    (weak_pass(items, checkpoint, state_dir, update) if merge is None else parted_pass(items, checkpoint, state_dir, update, merge)).awaitTermination()
    whole = _whole(spark, state_dir)
    if merge is None or not whole:
        return spark.read.parquet(f"{state_dir}/{max(whole)}") if whole else None
    parts = _parts(whole, max(whole) + 1)
    return merge(spark.read.parquet(*[f"{state_dir}/{b}" for b in parts]))


def _span(batch_id: int) -> int:
    """How many batches the part of a batch holds: all of the last ones whose number is the highest power of ``FOLD`` in it."""
    n, span = batch_id + 1, 1
    while n % (span * FOLD) == 0:
        span *= FOLD
    return span


def _parts(whole: list[int], end: int, begin: int = 0) -> list[int]:
    """Parts that hold the batches from ``begin`` to before ``end``, the last first."""
    there, out = set(whole), []
    while end > begin:
        if end - 1 not in there:
            raise FileNotFoundError(f"no state of batch {end - 1}")
        out.append(end - 1)
        end -= _span(end - 1)
    return out


def parted_pass(items: DataFrame, checkpoint: str, state_dir: str, update: Callable[[DataFrame | None, DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New items as states of their own, ``update(None, batch)``, beside those of earlier batches.

    Every ``FOLD`` batches their states become one, and so do ``FOLD`` of these: a row is written again once for each
    power of ``FOLD``, not once for each batch. A batch that is repeated writes the same folder from the same ones.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, state, span = batch.sparkSession, update(None, batch), _span(batch_id)
        if span > 1:
            earlier = _parts([b for b in _whole(spark, state_dir) if b < batch_id], batch_id, batch_id + 1 - span)
            state = merge(spark.read.parquet(*[f"{state_dir}/{b}" for b in earlier]).select(*state.columns).unionByName(state))
        state.write.mode("overwrite").parquet(f"{state_dir}/{batch_id}")
        # a batch that comes again needs the parts that it was made of, and none that earlier ones were made of
        whole = [b for b in _whole(spark, state_dir) if b < batch_id]
        for old in set(whole) - set(_parts(whole, batch_id)):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return run_available(items, checkpoint, run)


def latest(out: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The last value of each key of what an ``update`` stream has emitted, batch after batch."""
    rest = [c for c in out.columns if c not in (*keys, batch)]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("_last")).select(*keys, "_last.*")


def leader_topics(stream: DataFrame, bucket: str = "bucket", threshold: float = 0.62, idle: str = "72 hours", late: str = "1 hour") -> DataFrame:
    """(item_id, cluster_id) of a stream of (bucket, item_id, ts, v), topics kept as state for each bucket.

    The stateful form of leader clustering: an item joins the nearest leader of its bucket or becomes one.
    A leader is forgotten when its topic has had no item for ``idle`` before the watermark, and by nothing
    else; a bucket without topics has no state. Buckets are the unit of memory, so choose them fine enough.
    """
    span = int(pd.Timedelta(idle).value // 1000)

    def step(key, batches, state: GroupState):
        import numpy as np

        mark = state.getCurrentWatermarkMs() * 1000
        ids, seen, leaders = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "item_id"], ignore_index=True)
            out = []
            table = np.array(leaders) if leaders else None
            for item, ts, v in zip(rows["item_id"], rows["ts"], rows["v"]):
                us, v = ts.value // 1000, np.asarray(v, float)
                cos = table @ v if table is not None else np.empty(0)
                cos[[us - s > span for s in seen]] = -2.0
                if len(cos) and cos.max() >= threshold:
                    k = int(cos.argmax())
                else:
                    k = len(ids)
                    ids.append(int(item))
                    seen.append(us)
                    leaders.append(v.tolist())
                    table = v[None, :] if table is None else np.vstack([table, v])
                seen[k] = max(seen[k], us)
                out.append((item, ids[k]))
            yield pd.DataFrame(out, columns=["item_id", "cluster_id"])
        live = [i for i, s in enumerate(seen) if s + span > mark]
        if not live:
            state.remove()
            return
        state.update(tuple([x[i] for i in live] for x in (ids, seen, leaders)))
        state.setTimeoutTimestamp(max(mark // 1000 + 1, (min(seen[i] for i in live) + span) // 1000 + 1))

    timed_ = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed_.select(bucket, "item_id", "ts", "v").groupBy(bucket).applyInPandasWithState(
        step, "item_id long, cluster_id long", "ids array<bigint>, seen array<bigint>, leaders array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout
    )
