"""What grows with the data stays bounded: expressions computed once, batches, blocks, shuffles."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import registry
from tidewatch.operators import weak
from tidewatch.sources import parsers
from tidewatch.streaming import streams

registry.load()


def test_feed_reads_its_body_once(spark):
    """What the whole body says (Atom or not) is told once for a body, not for each field of each entry."""
    rows = spark.createDataFrame([("<feed><entry><id>1</id></entry></feed>", "https://a.example.com/")], "body string, url string")
    plan = rows.select(parsers.feed(F.col("body"), F.col("url")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<rss") == 1


def test_new_vocabulary_takes_all_sources(spark, data):
    """First uses of every source that has been known for a week, not of three chosen ones."""
    from tidewatch.plans import fixture

    at = fixture.items(spark, data).select("source_id", "first_seen_at").groupBy("source_id").agg((F.unix_date(F.to_date(F.max("first_seen_at"))) - F.unix_date(F.to_date(F.min("first_seen_at")))).alias("d"))
    want = {r["source_id"] for r in at.where("d > 14").collect()}
    assert len(want) > 3 and {r["source_id"] for r in registry.QUERIES["w4_new_vocabulary"](spark, data).select("source_id").distinct().collect()} >= want


@pytest.mark.parametrize("query", ["t1_norm", "w11_term_daily", "w4_new_vocabulary"])
def test_texts_travel_in_small_batches(spark, data, query):
    """A query that hands whole texts to Python does so in batches of bounded size, whatever ran before it."""
    from tidewatch.session import BATCH_BYTES, BATCH_ROWS

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    registry.QUERIES[query](spark, data)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES


def test_nearest_before_in_many_sends(spark):
    """Blocks are sent a few at a time, none is joined with another; equal to brute force with equal times and short slots."""
    from tidewatch.operators import weak

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    us = np.sort(rng.integers(0, 25, 60)) * 3_600_000_000
    rows = spark.createDataFrame([(k, int(us[k]), v[k].tolist()) for k in range(60)], "item_id long, us long, v array<double>").select("item_id", F.timestamp_micros("us").alias("ts"), "v")
    out = weak.nearest_before(rows, block=4, slot_hours=6, sent_rows=9)
    got = {r["item_id"]: (r["best"], r["n_before"]) for r in out.collect()}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for k in range(60):
        before = us < us[k]
        assert got[k][1] == before.sum()
        assert got[k][0] == pytest.approx((v[before] @ v[k]).max()) if before.any() else got[k][0] == -np.inf


def test_press_match_by_products(spark):
    """Articles meet members as blocks; equal to brute force, nothing below the limit, no pair is a row."""
    from tidewatch.operators import press

    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(k, k % 7, "xy"[k % 2], v[k].tolist()) for k in range(80)]
    a = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], "article_id long, cluster_id long, label string, v array<double>").drop("cluster_id")
    m = spark.createDataFrame([r[1:] for r in rows] + [(9, None, v[0].tolist())], "cluster_id long, label string, v array<double>")
    got = {(r["article_id"], r["cluster_id"]): r["sim"] for r in press.best_match(a, m, ["label"], block=8).collect()}
    want: dict = {}
    for i in range(0, 80, 3):
        for j in range(80):
            if i % 2 == j % 2 and v[i] @ v[j] >= press.PRESS_MATCH:
                want[i, j % 7] = max(want.get((i, j % 7), -1), v[i] @ v[j])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_term_counts_shuffle_once(spark, data):
    """One shuffle by term holds counts and sources, besides those of the items' own join."""
    plan = registry.QUERIES["r3_terms"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(term" in line for line in plan.split("\n")) == 1


def _exchanges(df, key):
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({key}")


def test_new_terms_shuffle_mentions_once(spark):
    """First mentions and windows come from one shuffle of the mentions, and none is written in between."""
    rows = [("a b", k, datetime(2024, 1, 2) + timedelta(minutes=k), "AB"[k % 2], 0.5) for k in range(4)] + [("c d", 9, datetime(2024, 1, 3), "A", 0.5)]
    out = weak.new_terms(spark.createDataFrame(rows, "term string, item_id long, ts timestamp, family string, cred double"), "2024-01-01 00:00:00", "2024-01-30 00:00:00")
    assert _exchanges(out, "term#") == 1
    assert [(r.term, r.item_id, r.families) for r in out.collect()] == [("a b", 1, 2)]


def test_retention_shuffles_terms_once(spark, data):
    """Daily counts without a state before them are one aggregate, and no set that retention drops is made."""
    out = registry.QUERIES["w18_retention"](spark, data)
    assert _exchanges(out, "term#") == 1
    assert "collect_set" not in out._jdf.queryExecution().executedPlan().toString()


def test_passes_write_their_own_rows(spark, tmp_path, monkeypatch):
    """A batch's state holds what the batch brought, and earlier rows only where parts become one; repeats change nothing."""
    monkeypatch.setattr(streams, "FOLD", 2)
    src, cursor, state = (str(tmp_path / x) for x in ("in", "cursor", "state"))
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    sizes = []

    def update(before, batch):
        assert before is None
        return total(batch)

    for b in range(5):
        spark.range(10 * b, 10 * b + 10).selectExpr("id AS k", "id AS n").coalesce(1).write.mode("append").parquet(src)
        got = streams.run_weak_passes(spark.readStream.schema("k long, n long").parquet(src), cursor, state, update, total)
        assert {(r.k, r.n) for r in got.collect()} == {(k, k) for k in range(10 * b + 10)}
        sizes.append(spark.read.parquet(f"{state}/{b}").count())
    assert sizes == [10, 20, 10, 40, 10] and sorted(streams._whole(spark, state)) == [3, 4]
    assert streams._parts([3, 4], 5) == [4, 3]
    with pytest.raises(FileNotFoundError):
        streams._parts([4], 5)
