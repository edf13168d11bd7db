"""Weak-signal detectors. Each is a window over what came before, ordered by (first_seen_at, item_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import counted_until, hours_between, percentile_by, poisson_tail3
from ..functions.terms import relevant
from ..session import shared_dir, written
from .items import _at
from .joins import as_of, each, running_count

# Prior credibility by family, its strength, and what catalog events are worth in bits.
FAMILY_PRIOR = {"A": 0.3, "B": 0.35, "C": 0.35, "D": 0.4, "E": 0.5, "F": 0.3, "H": 0.4}
PRIOR_STRENGTH = 8
CATALOG_BITS = {
    "openrouter_stealth": 8, "sirene": 7, "litellm_prices": 6, "inference_pulls": 6, "status_components": 6, "edgar_form_d": 6, "hf_org": 5,
    "polymarket_events": 5, "sitemap": 4, "discourse_categories": 4, "discord_widget": 4, "github_org": 3, "changelog_md": 3, "ashby_jobs": 2, "greenhouse_jobs": 2,
}
ERLANG_P, DAILY_BUDGET, COOLDOWN_H, LABEL_AFTER_H = 1e-4, 20, 72, 72
DAY = 86_400_000_000
#: Days of a block of decayed counts, and blocks that its total is carried over: then e^-46 of it is left.
DECAY_BLOCK, DECAY_BLOCKS = 64, 3
#: Rows and columns of one product of vectors.
PRODUCT_ROWS, PRODUCT_COLUMNS = 512, 2048


def prior_credibility(family: Column, official: Column | None = None, aggregator: Column | None = None) -> Column:
    prior = F.lit(0.3)
    for f, p in FAMILY_PRIOR.items():
        prior = F.when(family == f, p).otherwise(prior)
    if aggregator is not None:
        prior = F.when(aggregator, 0.5).otherwise(prior)
    return prior if official is None else F.when(official, 0.7).otherwise(prior)


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(float(DAY))


def new_terms(mentions: DataFrame, observed_since, now) -> DataFrame:
    """D2 over ``mentions`` (term, item_id, ts, family, cred): terms whose first mention is at most 48 hours old.

    (term, first_day, detector_at, bits): either the last three mentions are too close for a Poisson rate of
    three over the observed days, or two families of mean credibility 0.5 mention it within a day. The first
    emission of a term counts. Only the last six mentions are looked at, so the window is a short frame.
    """
    order = Window.partitionBy("term").orderBy("ts", "item_id")
    days = F.greatest(F.lit(1.0), days_between(_at(now), _at(observed_since)))
    last6 = order.rowsBetween(-5, 0)
    # mentions later than 48 hours after a term's first one say nothing; an item has a term once, so that no term has a
    # large part of the rows, and one shuffle serves both windows
    first = F.min("ts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    young = mentions.select("term", "item_id", "ts", "family", "cred").withColumn("first", first).where((days_between(F.col("ts"), F.col("first")) <= 2) & (days >= 7))
    m = young.withColumns({"third": F.lag("ts", 2).over(order), "near": F.collect_list(F.struct("ts", "family", "cred")).over(last6)})
    span = F.greatest(F.lit(1 / 24), days_between(F.col("ts"), F.col("third")))
    p = poisson_tail3(3 * span / days)
    day = F.filter("near", lambda x: F.unix_micros(x["ts"]) >= F.unix_micros(F.col("ts")) - F.lit(DAY))
    families = F.size(F.array_distinct(F.transform(day, lambda x: x["family"])))
    cred = F.aggregate(day, F.lit(0.0), lambda a, x: a + x["cred"]) / F.size(day)
    burst = F.col("third").isNotNull() & (p < ERLANG_P)
    spread = (families >= 2) & (cred >= 0.5)
    bits = F.when(burst, F.least(F.lit(20.0), -F.log2(F.greatest(p, F.lit(1e-12))))).when(spread, F.lit(6.0))
    out = m.withColumns({"bits": bits, "families": families}).where("bits is not null")
    one = out.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return one.select("term", F.to_date("first").alias("first_day"), "item_id", F.col("ts").alias("detected_at"), "families", "bits")


def new_pairs(mentions: DataFrame, days_observed: float) -> DataFrame:
    """D3 over ``mentions`` (item_id, ts, entity): first common title of two entities that are known apart.

    Both have at least five mentions in 30 days including this one; surprise = log2(N^2 / (na nb)) >= 3 with
    all N mentions of these days; Adamic-Adar over the links so far below 1; bits = surprise / (1 + aa).
    Links of an earlier time only are counted, so every edge carries the time at which it was first seen.
    """
    m = written(mentions.select("item_id", "ts", "entity").dropDuplicates(["item_id", "entity"]).withColumn("us", F.unix_micros("ts")))
    span = 30 * DAY
    near = Window.partitionBy("entity").orderBy("us").rangeBetween(-span, 0)
    counts = m.withColumn("n", F.count("*").over(near))
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.entity") < F.col("b.entity"))).select(
        F.col("a.item_id").alias("item_id"), F.col("a.ts").alias("ts"), F.col("a.us").alias("us"), F.col("a.entity").alias("a"), F.col("b.entity").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")
    )
    order = Window.partitionBy("a", "b").orderBy("us", "item_id")
    first = written(pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"))
    # mentions of all entities in the 30 days, as the difference of two running sums
    total = first.where("na >= 5 and nb >= 5")
    spans = total.select("us").distinct()
    upto = counted_until(m.groupBy("us").agg(F.count("*").alias("c")), spans.unionByName(spans.select((F.col("us") - span - 1).alias("us"))))
    old = upto.select((F.col("us") + span + 1).alias("us"), F.col("upto").alias("old"))
    n_all = spans.join(upto, "us").join(old, "us").select("us", (F.col("upto") - F.col("old")).alias("n_all"))
    cand = total.join(n_all, "us")
    surprise = F.log2(F.col("n_all") * F.col("n_all") / (F.col("na") * F.col("nb")))
    cand = written(cand.withColumn("surprise", surprise).where("surprise >= 3"))
    common = common_before(cand.select("a", "b", "us"), first.select("a", "b", "us"))
    out = cand.join(common, ["a", "b"], "left").withColumn("aa", F.coalesce("aa", F.lit(0.0)))
    return out.where((F.col("aa") < 1) & F.lit(days_observed >= 7)).select("a", "b", "item_id", F.col("ts").alias("detected_at"), "na", "nb", "n_all", "surprise", "aa", (F.col("surprise") / (1 + F.col("aa"))).alias("bits"))


def common_before(cand: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, aa) of ``cand`` (a, b, us): the sum of 1 / ln(degree) over common neighbours, by ``links`` (a, b, us) older than us.

    Degrees are those at the candidate's time, and only degrees above 1 count.
    """
    sym = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "us"))
    degree = sym.groupBy("a").agg(F.count("*").alias("deg"))
    ends = cand.join(degree.withColumnRenamed("deg", "da"), "a", "left").join(degree.select(F.col("a").alias("b"), F.col("deg").alias("db")), "b", "left").where("da is not null and db is not null")
    # a pair's end with fewer links is expanded, and its neighbours are looked up at the other end
    light = F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b"))
    ends = ends.select("a", "b", "us", light.alias("light"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("heavy"))
    near = ends.join(sym.select(F.col("a").alias("light"), F.col("b").alias("mid"), F.col("us").alias("x_us")), "light").where("x_us < us")
    both = near.join(sym.select(F.col("a").alias("heavy"), F.col("b").alias("mid"), F.col("us").alias("y_us")), ["heavy", "mid"]).where("y_us < us")
    # links of the common neighbour older than the pair, by the last of its running counts
    at = lambda d: d.withColumn("at", F.timestamp_micros("us"))
    counts = running_count(sym.select(F.col("a").alias("mid"), "us"), ["mid"], "us")
    known = as_of(at(both.select("a", "b", "mid", "us")), at(counts), ["mid"], "at", "at", ["n"], "links", strict=True)
    return known.where("links.n > 1").groupBy("a", "b").agg(F.sum(1 / F.log("links.n")).alias("aa"))


def new_vocabulary(mentions: DataFrame) -> DataFrame:
    """D4 over ``mentions`` (source_id, term, item_id, ts, cred, source_days): a credible source's first use of a term."""
    first = first_uses(mentions).where("cred >= 0.6 and source_days >= 7")
    return first.select("source_id", "term", "item_id", F.col("ts").alias("detected_at"), F.log2(1 + F.col("source_days")).alias("bits"))


def first_uses(mentions: DataFrame) -> DataFrame:
    """The first row of each source and term of ``mentions`` (source_id, term, ts, item_id, and any others)."""
    order = Window.partitionBy("source_id", "term").orderBy("ts", "item_id")
    return mentions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def isolated_early(items: DataFrame) -> DataFrame:
    """D5 over ``items`` (item_id, source_id, ts, cred, precocity, topic_size): alone, from a source that tends to be early."""
    return items.where("precocity is not null and cred * precocity >= 0.6 and coalesce(topic_size, 0) <= 1").select(
        "item_id", "source_id", F.col("ts").alias("detected_at"), F.lit(4.0).alias("bits")
    )


def decayed_outliers(points: DataFrame, least: int = 200, p: float = 0.95) -> DataFrame:
    """D6 over ``points`` (grp, item_id, ts, age_h, points): points / (age + 2)^1.8 above the 95th percentile of earlier passes.

    Values are taken at ages of 0 to 2 hours with positive points; 200 earlier values and 10 points are needed.
    """
    v = points.where("points > 0 and age_h >= 0 and age_h <= 2").withColumn("v", F.col("points") / F.pow(F.col("age_h") + 2, F.lit(1.8)))
    out = _over_history(v, "v", least, p).where("points >= 10")
    return out.select("grp", "item_id", "ts", "points", "v", "cut", (4 + 4 * F.log2(F.col("v") / F.col("cut"))).alias("bits"))


def _over_history(v: DataFrame, value: str, least: int, p: float, days: int = 14, pass_hours: int = 24) -> DataFrame:
    """Rows of ``v`` (grp, item_id, ts, value) that reach the percentile of what the group's earlier passes have left.

    A pass takes the values of ``pass_hours`` hours and compares them with those of the passes before, as far
    as these are not older than ``days`` at its end: there is one threshold for a group and pass, over
    ``least`` values or more. Each value serves the passes of the following days, and percentiles are taken
    without ordering a group.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(pass_hours * 3_600_000_000))
    serves = F.sequence(F.col("_slot") + 1, F.col("_slot") + days * 24 // pass_hours - 1)
    v = v.withColumn("_slot", slot)
    wanted = v.select("grp", "_slot").distinct()
    past = v.select("grp", value, F.explode(serves).alias("_slot")).join(wanted, ["grp", "_slot"], "left_semi")
    enough = past.groupBy("grp", "_slot").agg(F.count("*").alias("_k")).where(F.col("_k") >= least).drop("_k")
    cut = percentile_by(past, ["grp", "_slot"], value, p, "cut").join(enough, ["grp", "_slot"])
    return v.join(cut, ["grp", "_slot"]).where(F.col(value) >= F.col("cut")).drop("_slot")


def growth_map(daily: DataFrame, today) -> DataFrame:
    """D8 over ``daily`` (term, day, n, sources): terms that are rare, recent and growing in mentions and sources.

    The days before today are halved; totals up to the upper median, three recent mentions, growth of three,
    growth in sources of two and two recent sources are needed.
    """
    past = daily.where(F.col("day") < F.lit(today).cast("date"))
    days = past.select("day").distinct()
    pos = days.withColumn("pos", F.row_number().over(Window.orderBy("day"))).join(days.agg(F.count("*").alias("k")))
    placed = past.join(F.broadcast(pos), "day").where("k >= 7").withColumn("old", F.col("pos") <= F.floor(F.col("k") / 2))
    n = lambda old: F.coalesce(F.sum(F.when(F.col("old") == old, F.col("n"))), F.lit(0))
    s = lambda old: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("old") == old, F.col("sources"))))))
    t = placed.groupBy("term").agg(F.sum("n").alias("total"), n(True).alias("n_old"), n(False).alias("n_new"), s(True).alias("s_old"), s(False).alias("s_new"))
    median = percentile_by(t.withColumn("one", F.lit(1)), ["one"], "total", 0.5, "median").drop("one")
    t = t.join(F.broadcast(median)).withColumns({"g": (F.col("n_new") + 1) / (F.col("n_old") + 1), "gs": (F.col("s_new") + 1) / (F.col("s_old") + 1)})
    out = t.where("total <= median and n_new >= 3 and g >= 3 and gs >= 2 and s_new >= 2").withColumn("bits", F.log2("g") + F.log2("gs"))
    return out.select("term", "total", "n_old", "n_new", "s_old", "s_new", "bits", (F.col("bits") * 0.25 * F.col("s_new")).alias("score"))


def popularity(daily: DataFrame, until) -> DataFrame:
    """(cluster_id, day, pop): counts decayed by exp(-0.24) a day; days without items still decay the past."""
    d = daily.where(F.col("day") <= F.lit(until).cast("date")).withColumn("_at", F.unix_date("day"))
    d = d.withColumns({"_block": F.floor(F.col("_at") / DECAY_BLOCK), "_in": F.pmod("_at", F.lit(DECAY_BLOCK))})
    # a linear recurrence: weights grow inside a block of days, and a block's total decays into the next ones
    grown = F.col("n") * F.exp(0.24 * F.col("_in"))
    upto = Window.partitionBy("cluster_id", "_block").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum(grown).over(upto))
    later = F.explode(F.array(*map(F.lit, range(1, DECAY_BLOCKS + 1)))).alias("_k")
    carried = d.groupBy("cluster_id", "_block").agg(F.max("_sum").alias("_t")).select("cluster_id", "_block", "_t", later)
    carried = carried.select("cluster_id", (F.col("_block") + F.col("_k")).alias("_block"), (F.col("_t") * F.exp(-0.24 * DECAY_BLOCK * F.col("_k"))).alias("_c")).groupBy("cluster_id", "_block").agg(F.sum("_c").alias("_c"))
    d = d.join(carried, ["cluster_id", "_block"], "left")
    return d.select("cluster_id", "day", ((F.col("_sum") + F.coalesce("_c", F.lit(0.0))) * F.exp(-0.24 * F.col("_in"))).alias("pop"))


def rising_from_below(pop: DataFrame, until, least: int = 30) -> DataFrame:
    """D9 over ``pop``: topics between the 10th and 50th percentile of popularity whose last three rows rise."""
    until = F.lit(until).cast("date")
    order = Window.partitionBy("cluster_id").orderBy("day")
    last = Window.partitionBy("cluster_id").orderBy(F.desc("day"))
    rows = pop.withColumns({"p1": F.lag("pop", 1).over(order), "p2": F.lag("pop", 2).over(order), "_n": F.row_number().over(last)})
    now = rows.where((F.col("_n") == 1) & (F.col("day") > F.date_sub(until, 3)) & (F.col("pop") > 0)).withColumn("one", F.lit(1))
    cuts = percentile_by(now, ["one"], "pop", 0.1, "p10").join(percentile_by(now, ["one"], "pop", 0.5, "p50"), "one").join(now.groupBy("one").agg(F.count("*").alias("k")), "one").drop("one")
    out = now.join(F.broadcast(cuts)).where(F.col("k") >= least).where("pop >= p10 and pop <= p50 and pop > p1 and p1 > p2")
    return out.select("cluster_id", "day", "pop", F.lit(3.0).alias("bits"), F.lit(0.75).alias("score"))


def catalog_score(catalog_type: Column) -> Column:
    """D7: bits by type, 4 for others, times 0.7 times 0.5."""
    bits = F.lit(4.0)
    for k, b in CATALOG_BITS.items():
        bits = F.when(catalog_type == k, float(b)).otherwise(bits)
    return bits * 0.7 * 0.5


def signal_score(bits: Column, cred: Column, precocity: Column, families: Column) -> Column:
    return bits * cred * (0.5 + F.coalesce(precocity, F.lit(0.0))) * F.greatest(F.lit(1), families)


def merge_signals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New signals (detector, ns, key, ...) that don't exist yet; of one key, the first emitted."""
    order = Window.partitionBy("detector", "ns", "key").orderBy("detected_at", "item_id")
    one = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return one.join(existing.select("detector", "ns", "key"), ["detector", "ns", "key"], "left_anti")


def pass_items(items: DataFrame, lex, now, last, backfill_days: int = 14, detect_hours: int = 6) -> DataFrame:
    """The items that a pass at ``now`` takes, with ``detect``: whether detectors may emit for them.

    Relevant items that are not press, first seen since the ``last`` pass; without one, of the last
    ``backfill_days`` days, of which only those of the last ``detect_hours`` hours may be detected: a first
    pass fills the state silently.
    """
    now = _at(now)
    since = _at(last) if last is not None else now - F.expr(f"INTERVAL {backfill_days} DAYS")
    detect = since if last is not None else now - F.expr(f"INTERVAL {detect_hours} HOURS")
    seen = F.col("first_seen_at")
    kept = relevant(F.col("source_id"), F.col("title"), F.col("text"), lex) & (F.col("family") != "G") & (seen > since) & (seen <= now)
    return items.where(kept).withColumn("detect", seen >= detect)


def empty_daily(spark) -> DataFrame:
    return spark.createDataFrame([], "term string, day date, n bigint, sources array<string>, families array<string>")


def increment_daily(state: DataFrame, mentions: DataFrame) -> DataFrame:
    """term x day counts with their sources and families: prior state and new mentions (term, ts, source_id, family)."""
    return merge_daily(state.select("term", "day", "n", "sources", "families").unionByName(daily_counts(mentions)))


def daily_counts(mentions: DataFrame) -> DataFrame:
    """The same of ``mentions`` alone, in one shuffle."""
    kept = lambda c: F.array_sort(F.collect_set(c))
    return mentions.groupBy("term", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), kept("source_id").alias("sources"), kept("family").alias("families"))


def merge_daily(states: DataFrame) -> DataFrame:
    """One state of the rows of several."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return states.groupBy("term", "day").agg(F.sum("n").alias("n"), merged("sources"), merged("families"))


def pair_edges(mentions: DataFrame) -> DataFrame:
    """(a, b, first_at, last_at, n) of entities a < b in one item."""
    m = mentions.select("item_id", "ts", "entity").dropDuplicates(["item_id", "entity"])
    return (
        m.alias("x").join(m.alias("y"), (F.col("x.item_id") == F.col("y.item_id")) & (F.col("x.entity") < F.col("y.entity")))
        .groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.min("x.ts").alias("first_at"), F.max("x.ts").alias("last_at"), F.count("*").alias("n"))
    )


def nearest_before(vectors: DataFrame, block: int = 4096, slot_hours: int = 24, sent_rows: int = 1 << 16) -> DataFrame:
    """(item_id, best, n_before): the highest cosine of each unit vector with strictly earlier ones.

    ``vectors`` is (item_id, ts, v). Vectors lie in packed blocks of bounded size by time. Blocks of at most
    ``sent_rows`` vectors (or one block) are sent to all tasks at a time, and each task compares its own blocks with them by matrix
    products; a block is neither shuffled nor stored more than once, and only maxima are shuffled. All pairs are
    compared, so work grows with the square of the number of vectors.
    """
    spark = vectors.sparkSession
    keyed = vectors.select("item_id", F.unix_micros("ts").alias("us"), F.col("v").cast("array<double>").alias("v")).withColumn("slot", F.floor(F.col("us") / F.lit(slot_hours * 3_600_000_000)))
    sizes = keyed.groupBy("slot").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = keyed.join(sizes, "slot").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    blocks = written(dealt.groupBy("slot", "part").applyInPandas(_vector_block, "slot long, part int, n long, first long, last long, ids binary, us binary, v binary"))
    known = [tuple(r) for r in blocks.select("slot", "part", "n", "first").orderBy("slot", "part").collect()]  # a row for each block
    numbers = spark.createDataFrame([(s, p, k) for k, (s, p, *_) in enumerate(known)], "slot long, part int, number long")
    blocks = written(blocks.join(numbers, ["slot", "part"]).repartition(1 + sum(k[2] for k in known) // block, "number"))
    path = f"{shared_dir(spark)}/maxima"
    end = 0
    while end < len(known):
        begin, rows = end, 0
        while end < len(known) and (end == begin or rows + known[end][2] <= sent_rows):
            rows, end = rows + known[end][2], end + 1
        sent = blocks.where(F.col("number").between(begin, end - 1)).orderBy("number").collect()
        held = spark.sparkContext.broadcast([r.asDict() for r in sent])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            few = [_unpacked_block(r) for r in held.value]
            x_us, x = np.concatenate([f[1] for f in few]), np.concatenate([f[2] for f in few])
            ends, last = np.cumsum([len(f[0]) for f in few]), np.array([r["last"] for r in held.value])
            for pdf in batches:
                for own in pdf.to_dict("records"):
                    ids, us, v = _unpacked_block(own)
                    best, n = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
                    # blocks lie in the order of time: the first ones are wholly earlier, the others are compared time by time
                    mixed = np.flatnonzero(last >= own["first"])
                    clear = (int(ends[mixed[0] - 1]) if mixed[0] else 0) if len(mixed) else len(x)
                    for at in range(0, len(ids), PRODUCT_ROWS):
                        rows = slice(at, at + PRODUCT_ROWS)
                        for k in range(0, len(x) if clear < len(x) and us[rows].max() > x_us[clear:].min() else clear, PRODUCT_COLUMNS):
                            sim = v[rows] @ x[k : k + PRODUCT_COLUMNS].T
                            if k + PRODUCT_COLUMNS > clear:
                                sim[x_us[None, k : k + PRODUCT_COLUMNS] >= us[rows, None]] = -np.inf
                            np.maximum(best[rows], sim.max(axis=1), out=best[rows])
                    n += np.searchsorted(np.sort(x_us), us, side="left")
                    yield pd.DataFrame({"item_id": ids, "best": best, "n": n})

        # those of the same slot may have any number
        met = blocks.where(F.col("last") > min(k[3] for k in known[begin:end]))
        met.mapInPandas(run, "item_id long, best double, n long").write.mode("append").parquet(path)
        held.unpersist()
    if not known:
        return vectors.select("item_id", F.lit(0.0).alias("best"), F.lit(0).cast("long").alias("n_before")).limit(0)
    # what has nothing before it may have met no block
    found = spark.read.schema("item_id long, best double, n long").parquet(path)
    found = found.unionByName(keyed.select("item_id", F.lit(float("-inf")).alias("best"), F.lit(0).cast("long").alias("n")))
    return found.groupBy("item_id").agg(F.max("best").alias("best"), F.sum("n").alias("n_before"))


def _vector_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of a block's ids, times and vectors."""
    v, us = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["us"].to_numpy(np.int64)
    one = {"slot": int(pdf["slot"].iloc[0]), "part": int(pdf["part"].iloc[0]), "n": len(pdf), "first": int(us.min()), "last": int(us.max())}
    return pd.DataFrame([{**one, "ids": pdf["item_id"].to_numpy(np.int64).tobytes(), "us": us.tobytes(), "v": v.tobytes()}])


def _unpacked_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["us"], np.int64), np.frombuffer(row["v"], np.float64).reshape(len(ids), -1)


def novelty(vectors: DataFrame, least: int = 200, p: float = 0.97, slot_hours: int = 24) -> DataFrame:
    """D1: 1 - the best cosine with 200 or more earlier vectors, at or above the 97th percentile of 200 values of earlier passes."""
    near = nearest_before(vectors, slot_hours=slot_hours).where(F.col("n_before") >= least)
    v = near.join(vectors.select("item_id", "ts"), "item_id").select(F.lit(1).alias("grp"), "item_id", "ts", (1 - F.col("best")).alias("nov"))
    out = _over_history(v, "nov", least, p)
    bits = 4 + 8 * (F.col("nov") - F.col("cut")) / F.greatest(F.lit(1e-6), 1 - F.col("cut"))
    return out.select("item_id", "ts", "nov", "cut", bits.alias("bits"))


def label_outcomes(signals: DataFrame, detections: DataFrame, members: DataFrame, press: DataFrame, term_days: DataFrame, now) -> DataFrame:
    """What became of signals detected 72 hours ago or earlier: (signal_id, outcome, lead_h).

    TOP20 (the topic was among the first 20 and not scored before the signal), else FAMILIES (two other than
    press in its topic within 72 hours), else PRESS (an article then), else FAMILIES_TERM (two families
    mention the entity on those days), else NOT_CONFIRMED. The lead to TOP20 is to the first scoring, which
    may be later than 72 hours; other leads are to the first item of another family, or the article.
    """
    s = signals.where(F.col("detected_at") <= _at(now) - F.expr(f"INTERVAL {LABEL_AFTER_H} HOURS"))
    end = F.col("detected_at") + F.expr(f"INTERVAL {LABEL_AFTER_H} HOURS")
    inside = lambda c: (F.col(c) > F.col("detected_at")) & (F.col(c) <= end)
    top = s.join(detections.where("best_rank <= 20"), "cluster_id").where("first_scored_at is null or first_scored_at >= detected_at")
    top = top.groupBy("signal_id").agg(F.min("first_scored_at").alias("top_at"), F.lit(True).alias("top"))
    # the next item of each family, and the next article, after the signal: a topic's rows are never multiplied
    placed = s.where("cluster_id is not null").select("signal_id", "cluster_id", "family", "detected_at")
    members = members.where("family <> 'G'").select("cluster_id", F.col("family").alias("m_family"), "evt_at")
    families = [r["m_family"] for r in members.select("m_family").distinct().collect()]  # one letter each
    fam = as_of(placed.select("*", each("m_family", families or [""])), members, ["cluster_id", "m_family"], "detected_at", "evt_at", [], "next", forward=True, strict=True)
    fam = fam.withColumn("evt_at", F.col("next.at")).where(inside("evt_at"))
    fam = fam.groupBy("signal_id").agg(F.count_distinct("m_family").alias("n_fam"), F.min(F.when(F.col("m_family") != F.col("family"), F.col("evt_at"))).alias("fam_at"))
    art = as_of(placed, press, ["cluster_id"], "detected_at", "first_press_at", [], "next", forward=True, strict=True)
    art = art.withColumn("press_at", F.col("next.at")).where(inside("press_at")).select("signal_id", "press_at")
    # term_days has a row for each term and day
    on = F.explode(F.sequence(F.to_date("detected_at"), F.to_date(end))).alias("day")
    words = s.where("entity is not null").select("signal_id", "entity", on).join(term_days.select(F.col("term").alias("entity"), "day", "families"), ["entity", "day"])
    words = words.select("signal_id", F.explode("families").alias("f")).groupBy("signal_id").agg(F.count_distinct("f").alias("n_term"))
    for part in (top, fam, art, words):
        s = s.join(part, "signal_id", "left")
    outcome = (
        F.when(F.col("top"), "TOP20").when(F.col("n_fam") >= 2, "FAMILIES").when(F.col("press_at").isNotNull(), "PRESS").when(F.col("n_term") >= 2, "FAMILIES_TERM").otherwise("NOT_CONFIRMED")
    )
    at = F.when(outcome == "TOP20", F.col("top_at")).when(outcome == "FAMILIES", F.col("fam_at")).when(outcome == "PRESS", F.col("press_at"))
    return s.select("signal_id", outcome.alias("outcome"), hours_between(at, F.col("detected_at")).alias("lead_h"))


def source_stats(labelled: DataFrame) -> DataFrame:
    """(source_id, flagged, confirmed, cred, precocity) from (source_id, prior, confirmed, lead_h) of detectors D1 to D6."""
    s = labelled.groupBy("source_id").agg(F.max("prior").alias("prior"), F.count("*").alias("flagged"), F.coalesce(F.sum(F.col("confirmed").cast("long")), F.lit(0)).alias("confirmed"))
    lead = percentile_by(labelled.where("lead_h is not null"), ["source_id"], "lead_h", 0.5, "lead")
    cred = (PRIOR_STRENGTH * F.col("prior") + F.col("confirmed")) / (PRIOR_STRENGTH + F.col("flagged"))
    prec = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("lead")) / 24)
    return s.join(lead, "source_id", "left").select("source_id", "flagged", "confirmed", cred.alias("cred"), F.when(F.col("lead").isNotNull(), prec).alias("precocity"))


def select_budget(signals: DataFrame, picked: DataFrame, now, budget: int = DAILY_BUDGET, cooldown_h: int = COOLDOWN_H, top: int = 400) -> DataFrame:
    """The day's picks among the best ``top`` signals of 24 hours, in order of score.

    A pick blocks its (ns, key), topic and entity, and so do picks of the last 72 hours. Each pick depends on
    the ones before, so the at most 400 rows go through one ordered group; nothing larger does.
    """
    now = _at(now)
    recent = picked.where(F.col("day") >= F.to_date(now - F.expr(f"INTERVAL {cooldown_h} HOURS")))
    today = recent.withColumn("today", F.col("day") == F.to_date(now))
    cand = signals.where((F.col("detected_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("detected_at") <= now) & F.col("score").isNotNull())
    cand = cand.join(picked.select("signal_id"), "signal_id", "left_anti").orderBy(F.desc("score"), "signal_id").limit(top)
    cols = ["signal_id", "ns", "key", "cluster_id", "entity", "score"]
    both = cand.select(*cols, F.lit(False).alias("old"), F.lit(False).alias("today")).unionByName(today.select(*cols, F.lit(True).alias("old"), "today"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        blocked, left, rank, out = set(), budget, 0, []
        pdf = pdf.sort_values(["old", "score", "signal_id"], ascending=[False, False, True])
        for r in pdf.itertuples():
            own = {("key", r.ns, r.key)}
            own |= {("topic", r.cluster_id)} if pd.notna(r.cluster_id) else set()
            own |= {("entity", r.entity.lower())} if isinstance(r.entity, str) else set()
            if r.old:
                blocked |= own
                left -= bool(r.today)
            elif left > 0 and not own & blocked:
                blocked |= own
                left, rank = left - 1, rank + 1
                out.append((r.signal_id, rank, r.score))
        return pd.DataFrame(out, columns=["signal_id", "pick", "score"])

    return both.groupBy(F.lit("all")).applyInPandas(greedy, "signal_id long, pick int, score double")


def metrics(labelled: DataFrame, now, days: int = 14) -> DataFrame:
    """(detector, flagged, confirmed, rate, median_lead) over the last days."""
    recent = labelled.where(F.col("detected_at") >= _at(now) - F.expr(f"INTERVAL {days} DAYS")).withColumn("ok", F.col("outcome") != "NOT_CONFIRMED")
    out = recent.groupBy("detector").agg(F.count("*").alias("flagged"), F.count_if("ok").alias("confirmed"))
    lead = percentile_by(recent.where("ok and lead_h is not null"), ["detector"], "lead_h", 0.5, "median_lead")
    return out.join(lead, "detector", "left").withColumn("rate", F.col("confirmed") / F.col("flagged"))


def metrics_by(labelled: DataFrame, now, days: int = 14, sources: int = 30) -> DataFrame:
    """(dimension, value, flagged, confirmed, rate, median_lead) of the last days by detector, and by source for those with most signals."""
    recent = labelled.where(F.col("detected_at") >= _at(now) - F.expr(f"INTERVAL {days} DAYS")).withColumn("ok", F.col("outcome") != "NOT_CONFIRMED")
    named = lambda d, c: (F.lit(d).alias("dimension"), F.col(c).alias("value"))
    sets = recent.groupingSets([["detector"], ["source_id"]], "detector", "source_id").agg(F.grouping("detector").alias("g"), F.count("*").alias("flagged"), F.count_if("ok").alias("confirmed"))
    out = sets.select(F.when(F.col("g") == 0, "detector").otherwise("source").alias("dimension"), F.when(F.col("g") == 0, F.col("detector")).otherwise(F.col("source_id")).alias("value"), "flagged", "confirmed")
    most = Window.partitionBy("dimension").orderBy(F.desc("flagged"), "value")
    out = out.withColumn("r", F.row_number().over(most)).where((F.col("dimension") == "detector") | (F.col("r") <= sources)).drop("r")
    good = recent.where("ok and lead_h is not null")
    leads = good.select(*named("detector", "detector"), "lead_h").unionByName(good.select(*named("source", "source_id"), "lead_h"))
    return out.join(percentile_by(leads, ["dimension", "value"], "lead_h", 0.5, "median_lead"), ["dimension", "value"], "left").withColumn("rate", F.col("confirmed") / F.col("flagged"))


def visible(selection: DataFrame, now, ghost_until) -> DataFrame:
    """Ghost mode: nothing is shown before a date."""
    return selection.where(_at(now) >= _at(ghost_until))


def retained(rows: DataFrame, day: str, today, days: int, single_days: int | None = None) -> DataFrame:
    """Rows of the last days; with ``single_days``, counts of one only live that long."""
    age = F.datediff(F.lit(today).cast("date"), F.col(day))
    keep = age <= days
    return rows.where(keep if single_days is None else keep & ((F.col("n") > 1) | (age <= single_days)))

