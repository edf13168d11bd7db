"""The weak-signal pass as one incremental step: keyed states behind a manifest, and the signals of new items.

A pass takes the items first seen since the one before, compares them with what the states knew and with the items
before them in the pass, and merges them into the states. States lie in buckets, by hash or by day and hash. A pass
reads and rewrites only the buckets that its items touch, as a new version; the manifest, written last, says which
version of each bucket holds. A pass that breaks off leaves no manifest and is simply run again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import counted_until, poisson_tail3
from ..session import written
from .items import _at
from .weak import DAY, ERLANG_P, common_before, days_between, pass_items, signal_score

#: Sub-folders of hashed states, and parts of a day, unless a store is made with others. Each should fit a task.
BUCKETS, DAY_PARTS = 64, 8
# Days that states remember, and least credibility and observed days of the detectors.
TERM_DAYS, SINGLE_DAYS, VOCAB_DAYS, MENTION_DAYS = 30, 14, 90, 30
MIN_CRED, MIN_DAYS, MIN_MENTIONS, MIN_SURPRISE = 0.6, 7, 5, 3

RECENT = "array<struct<at:timestamp,item_id:bigint,family:string,cred:double>>"


@dataclass(frozen=True)
class State:
    """A state's columns, its key, and how its rows and those of a pass become one."""

    columns: str
    key: tuple[str, ...]
    merge: dict[str, Column] = field(hash=False)
    by_day: bool = False

    def bucket(self, buckets: int, day_parts: int) -> Column:
        parts = F.pmod(F.xxhash64(*self.key), F.lit(day_parts if self.by_day else buckets)).cast("string")
        return F.concat_ws("_", F.col("day").cast("string"), parts) if self.by_day else parts


def _spans() -> dict[str, Column]:
    return {"first_at": F.min("first_at"), "last_at": F.max("last_at"), "n": F.sum("n")}


def _sets(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def states() -> dict[str, State]:
    latest = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("recent")))), 1, 6)
    spans = "first_at timestamp, last_at timestamp, n bigint"
    return {
        "term_daily": State("term string, day date, n bigint, sources array<string>, families array<string>", ("term",), {"n": F.sum("n"), "sources": _sets("sources"), "families": _sets("families")}, True),
        "term_last": State(f"term string, {spans}, recent {RECENT}", ("term",), {**_spans(), "recent": F.reverse(latest)}),
        "source_vocab": State(f"source_id string, term string, {spans}", ("source_id", "term"), _spans()),
        "entity_mentions": State("entity string, day date, n bigint", ("entity",), {"n": F.sum("n")}, True),
        "entity_pairs": State(f"a string, b string, {spans}", ("a", "b"), _spans()),
        "sources": State("source_id string, first_at timestamp", ("source_id",), {"first_at": F.min("first_at")}),
        "signals": State(
            "detector string, ns string, key string, item_id bigint, source_id string, detected_at timestamp, families int, bits double, cred double, score double, entity string, passed_at timestamp",
            ("detector", "ns", "key"), {c: F.min_by(c, F.struct("passed_at", "detected_at", "item_id")) for c in ("item_id", "source_id", "families", "bits", "cred", "score", "entity")} | {"detected_at": F.min_by("detected_at", F.struct("passed_at", "detected_at", "item_id")), "passed_at": F.min("passed_at")},
        ),
    }


class Store:
    """Versions of the states below one folder that driver and executors see."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, day_parts: int | None = None):
        self.spark, self.root, self.states = spark, root.rstrip("/"), states()
        self.parts = buckets or BUCKETS, day_parts or DAY_PARTS
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *map(str, parts))))

    def _names(self, *parts) -> list[str]:
        path = self._path(*parts)
        return [f.getPath().getName() for f in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def latest(self) -> dict:
        """The manifest of the last pass that ended; one without its success mark counts for nothing."""
        done = [int(n) for n in self._names("manifest") if self.fs.exists(self._path("manifest", n, "_SUCCESS"))]
        if not done:
            return {"pass": -1, "now": None, "start": None, "tables": {t: {} for t in self.states}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{max(done)}").first()["value"])

    def read(self, manifest: dict, table: str, buckets: set[str] | None = None) -> DataFrame:
        """A state's rows, of all or of some buckets."""
        held = {b: v for b, v in manifest["tables"][table].items() if buckets is None or b in buckets}
        if not held:
            return self.spark.createDataFrame([], self.states[table].columns)
        return self.spark.read.schema(self.states[table].columns).parquet(*[f"{self.root}/{table}/v={v}/bucket={b}" for b, v in sorted(held.items())])

    def touched(self, rows: dict[str, DataFrame]) -> dict[str, set[str]]:
        """The buckets of each state that some rows (with its key) touch; only names come to the driver, in one job."""
        named = [r.select(F.lit(t).alias("t"), self.states[t].bucket(*self.parts).alias("b")) for t, r in rows.items()]
        out: dict[str, set[str]] = {t: set() for t in rows}
        for r in reduce(DataFrame.unionByName, named).distinct().collect():
            out[r["t"]].add(r["b"])
        return out

    def merge(self, manifest: dict, number: int, table: str, rows: DataFrame, buckets: set[str], keep: Column | None = None) -> dict[str, int]:
        """Writes the touched ``buckets`` with ``rows`` merged in as version ``number``, and says which version each bucket has then."""
        state = self.states[table]
        key = [*state.key, "day"] if state.by_day else [*state.key]
        before = self.read(manifest, table, buckets)
        columns = before.columns
        both = before.unionByName(rows.select(*columns)) if keep is None else before.where(keep).unionByName(rows.select(*columns))
        after = both.groupBy(*key).agg(*[c.alias(n) for n, c in state.merge.items()]).select(*columns, state.bucket(*self.parts).alias("bucket"))
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/v={number}")
        wrote = {n.removeprefix("bucket=") for n in self._names(table, f"v={number}") if n.startswith("bucket=")}
        return {**manifest["tables"][table], **dict.fromkeys(sorted(wrote), number)}

    def commit(self, manifest: dict) -> None:
        """Writes the manifest, then removes versions that neither it nor the one before names."""
        before = self.latest()
        text = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{manifest['pass']}")
        for table in self.states:
            named = {(int(v), b) for m in (before, manifest) for b, v in m["tables"][table].items()}
            for version in self._names(table):
                number = int(version.removeprefix("v="))
                for bucket in self._names(table, version):
                    if bucket.startswith("bucket=") and number < manifest["pass"] and (number, bucket.removeprefix("bucket=")) not in named:
                        self.fs.delete(self._path(table, version, bucket), True)
        for n in self._names("manifest"):
            if int(n) < manifest["pass"] - 1:
                self.fs.delete(self._path("manifest", n), True)


def _counted(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy(*names).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


def term_signals(words: DataFrame, known: DataFrame, days: float) -> DataFrame:
    """D2 (term, first_at, item_id, at, families, bits) of new ``words``, given what is ``known`` of their terms (term, first_at, recent).

    A term is new for 48 hours after its first mention. Either its last three mentions are too close for a
    Poisson rate of three over the observed days, or two families of mean credibility 0.5 mention it within a day.
    """
    old = known.select("term", F.explode("recent").alias("r")).select("term", "r.*", F.lit(False).alias("may"))
    new = words.select("term", "at", "item_id", "family", "cred", (F.col("detect") & ~F.col("known")).alias("may"))
    both = old.unionByName(new)
    first = known.select("term", "first_at").unionByName(new.select("term", F.col("at").alias("first_at"))).groupBy("term").agg(F.min("first_at").alias("first_at"))
    # mentions later than 48 hours after the first one say nothing, so frequent terms are gone here
    young = both.join(first, "term").where(days_between(F.col("at"), F.col("first_at")) <= 2)
    order = Window.partitionBy("term").orderBy("at", "item_id")
    m = young.withColumns({"third": F.lag("at", 2).over(order), "near": F.collect_list(F.struct("at", "family", "cred")).over(order.rowsBetween(-5, 0))}).where("may")
    span = F.greatest(F.lit(1 / 24), days_between(F.col("at"), F.col("third")))
    p = poisson_tail3(3 * span / F.lit(days))
    day = F.filter("near", lambda x: F.unix_micros(x["at"]) >= F.unix_micros(F.col("at")) - F.lit(DAY))
    families = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda x: x["family"])))
    cred = F.aggregate(day, F.lit(0.0), lambda a, x: a + x["cred"]) / F.size(day)
    burst = F.col("third").isNotNull() & (p < ERLANG_P)
    bits = F.when(burst, F.least(F.lit(20.0), -F.log2(F.greatest(p, F.lit(1e-12))))).when((families(day) >= 2) & (cred >= 0.5), F.lit(6.0))
    out = m.select("term", "first_at", "item_id", "at", F.when(burst, families("near")).otherwise(families(day)).alias("families"), bits.alias("bits")).where("bits is not null")
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def vocabulary_signals(words: DataFrame, vocabulary: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """D4 (source_id, term, item_id, at, bits): a credible source's first use of a term, seven days after its first item."""
    order = Window.partitionBy("source_id", "term").orderBy("at", "item_id")
    first = words.where(F.col("cred") >= MIN_CRED).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    first = first.join(vocabulary.select("source_id", "term"), ["source_id", "term"], "left_anti").where("detect and not known")
    days = F.greatest(F.lit(0.0), days_between(now, F.col("first_at")))
    return first.join(sources.select("source_id", "first_at"), "source_id").withColumn("days", days).where(F.col("days") >= MIN_DAYS).select("source_id", "term", "item_id", "at", F.log2(1 + F.col("days")).alias("bits"))


def pair_signals(mentions: DataFrame, pairs: DataFrame, counts: DataFrame, seen: DataFrame) -> DataFrame:
    """D3 (a, b, item_id, at, na, nb, n_all, surprise, aa, bits) of the first common items of two known entities.

    ``mentions`` (entity, item_id, at) and ``pairs`` (a, b, item_id, at, detect) of the pass, ``counts``
    (entity, n) of the days before, ``seen`` (a, b, first_at) links before. Counts are those until the item's
    time; links count if they are older.
    """
    order = Window.partitionBy("a", "b").orderBy("at", "item_id")
    first = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").join(seen.select("a", "b"), ["a", "b"], "left_anti")
    first = written(first.withColumn("us", F.unix_micros("at")))
    cand = first.where("detect")
    none = cand.sparkSession.createDataFrame([], "a string, b string, item_id long, at timestamp, na long, nb long, n_all long, surprise double, aa double, bits double")
    if cand.isEmpty():  # most passes bring no new pair, and then nothing needs counting
        return none
    # mentions of both entities until the pair's time: each entity's few times of candidates cut its mentions into bins
    marks = cand.select(F.explode(F.array("a", "b")).alias("entity"), "us").groupBy("entity").agg(F.array_sort(F.collect_set("us")).alias("marks"))
    mine = mentions.join(marks, "entity").withColumn("bin", F.size(F.filter("marks", lambda x: x < F.unix_micros(F.col("at")))))
    binned = mine.groupBy("entity", "bin").agg(F.count("*").alias("c"), F.any_value("marks").alias("marks"))
    upto = F.sum("c").over(Window.partitionBy("entity").orderBy("bin"))
    ends = F.coalesce(F.lead("bin").over(Window.partitionBy("entity").orderBy("bin")), F.size("marks"))
    until = binned.withColumns({"own": upto, "end": ends}).where("bin < size(marks)")
    until = until.select("entity", "own", F.explode(F.slice("marks", F.col("bin") + 1, F.col("end") - F.col("bin"))).alias("us")).join(counts, "entity", "left")
    until = until.select("entity", "us", (F.col("own") + F.coalesce("n", F.lit(0))).alias("n"))
    side = lambda c: until.select(F.col("entity").alias(c), "us", F.col("n").alias(f"n{c}"))
    cand = cand.join(side("a"), ["a", "us"]).join(side("b"), ["b", "us"]).where((F.col("na") >= MIN_MENTIONS) & (F.col("nb") >= MIN_MENTIONS))
    times = cand.select("us").distinct()
    total = counted_until(mentions.groupBy(F.unix_micros("at").alias("us")).agg(F.count("*").alias("c")), times)
    old = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("old"))
    cand = cand.join(total, "us").join(F.broadcast(old)).withColumn("n_all", F.greatest(F.lit(1), F.col("upto") + F.col("old")))
    cand = cand.withColumn("surprise", F.log2(F.col("n_all") * F.col("n_all") / F.greatest(F.lit(1), F.col("na") * F.col("nb")))).where(F.col("surprise") >= MIN_SURPRISE)
    cand = written(cand)
    if cand.isEmpty():
        return none
    links = seen.select("a", "b", F.unix_micros("first_at").alias("us")).unionByName(first.select("a", "b", "us"))
    out = cand.join(common_before(cand.select("a", "b", "us"), links), ["a", "b"], "left").withColumn("aa", F.coalesce("aa", F.lit(0.0))).where("aa < 1")
    return out.select("a", "b", "item_id", "at", "na", "nb", "n_all", "surprise", "aa", (F.col("surprise") / (1 + F.col("aa"))).alias("bits"))


def run_pass(store: Store, items: DataFrame, lex, now, backfill_days: int = 14, detect_hours: int = 6) -> dict:
    """One pass at ``now`` over ``items`` (item_id, source_id, family, title, text, first_seen_at, cred, precocity, terms, entities).

    The items since the last pass are taken (the first pass takes ``backfill_days`` and detects in the last
    ``detect_hours``). Returns the manifest; ``store.read(manifest, "signals")`` has all signals so far. A pass
    at a time that isn't after the last one changes nothing. Null terms, entities and times are left out; an
    item that comes again is not known by its id and counts again, as its first_seen_at lies in one pass only.
    """
    before, now = store.latest(), str(now)
    if before["now"] is not None and before["now"] >= now:
        return before
    number, at_now = before["pass"] + 1, _at(now)
    last = before["now"]
    past = lambda n: (datetime.fromisoformat(now) - timedelta(days=n)).date()
    taken = pass_items(items, lex, now, last, backfill_days, detect_hours).where("first_seen_at is not null")
    taken = written(taken.select("item_id", "source_id", "family", F.col("first_seen_at").alias("at"), "cred", "precocity", "detect", "terms", F.array_sort(F.array_distinct(F.array_compact("entities"))).alias("entities")))
    start = items.agg(F.min("first_seen_at").cast("string").alias("s")).first()["s"] if before["start"] is None else before["start"]
    days = max(1.0, (datetime.fromisoformat(now) - datetime.fromisoformat(start or now)) / timedelta(days=1))

    word = F.explode(F.array_distinct(F.array_compact("terms"))).alias("term")
    words = taken.select("item_id", "source_id", "family", "at", "cred", "detect", "entities", word)
    words = written(words.withColumn("known", F.exists("entities", lambda e: F.contains(F.lower(F.col("term")), F.lower(e)))).drop("entities"))
    mentions = taken.select("item_id", "at", F.explode("entities").alias("entity"))
    pairs = taken.select("item_id", "at", "detect", "entities", F.posexplode("entities").alias("i", "a"))
    pairs = pairs.select("item_id", "at", "detect", "a", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("b"))

    # what the states remember was settled at the end of the last pass
    settled = _at(last) if last is not None else at_now
    older = lambda c, n: F.col(c) < settled - F.expr(f"INTERVAL {n} DAYS")
    live_term = ~(older("last_at", TERM_DAYS) | ((F.col("n") == 1) & older("last_at", SINGLE_DAYS)))
    live_word = ~older("last_at", VOCAB_DAYS)
    since = F.lit(past(MENTION_DAYS))
    day = F.to_date("at").alias("day")
    by_key = {
        "term_daily": words.select("term", day), "term_last": words.select("term"), "source_vocab": words.select("source_id", "term"),
        "entity_mentions": mentions.select("entity", day), "entity_pairs": pairs.select("a", "b"), "sources": taken.select("source_id"),
    }
    near = store.touched(by_key)
    source_first = store.read(before, "sources").unionByName(taken.groupBy("source_id").agg(F.min("at").alias("first_at"))).groupBy("source_id").agg(F.min("first_at").alias("first_at"))

    d4 = vocabulary_signals(words, store.read(before, "source_vocab", near["source_vocab"]).where(live_word), source_first, at_now)
    found = d4.select(F.lit("D4").alias("detector"), F.concat(F.lit("vocab:"), "source_id").alias("ns"), F.col("term").alias("key"), "item_id", "at", F.lit(1).alias("families"), "bits", F.col("term").alias("entity"))
    if days >= MIN_DAYS:
        terms_before = store.read(before, "term_last", near["term_last"]).where(live_term).join(words.select("term").distinct(), "term", "left_semi")
        d2 = term_signals(words, terms_before, days)
        d3 = pair_signals(mentions, pairs, store.read(before, "entity_mentions").where(F.col("day") >= since).groupBy("entity").agg(F.sum("n").alias("n")), store.read(before, "entity_pairs"))
        found = found.unionByName(d2.select(F.lit("D2").alias("detector"), F.lit("term").alias("ns"), F.concat_ws("|", "term", F.to_date("first_at").cast("string")).alias("key"), "item_id", "at", "families", "bits", F.col("term").alias("entity")))
        found = found.unionByName(d3.select(F.lit("D3").alias("detector"), F.lit("pair").alias("ns"), F.concat_ws("|", "a", "b").alias("key"), "item_id", "at", F.lit(1).alias("families"), "bits", F.concat_ws(" + ", "a", "b").alias("entity")))
    score = signal_score(F.col("bits"), F.col("cred"), F.col("precocity"), F.col("families"))
    signals = found.join(taken.select("item_id", "source_id", "cred", "precocity").dropDuplicates(["item_id"]), "item_id").withColumns({"score": score, "detected_at": F.col("at"), "passed_at": at_now})
    signals = written(signals.select(*store.read(before, "signals", set()).columns))

    recent = Window.partitionBy("term").orderBy(F.desc("at"), F.desc("item_id"))
    six = words.withColumn("_n", F.row_number().over(recent)).where("_n <= 6").groupBy("term").agg(F.collect_list(F.struct("at", "item_id", "family", "cred")).alias("recent"))
    daily = words.groupBy("term", day).agg(F.count("*").alias("n"), F.collect_set("source_id").alias("sources"), F.collect_set("family").alias("families"))
    new = {
        "term_daily": (daily, None),
        "term_last": (_counted(words, ["term"]).join(six, "term"), live_term),
        "source_vocab": (_counted(words.where(F.col("cred") >= MIN_CRED), ["source_id", "term"]), live_word),
        "entity_mentions": (mentions.groupBy("entity", day).agg(F.count("*").alias("n")), None),
        "entity_pairs": (_counted(pairs, ["a", "b"]), None),
        "sources": (taken.groupBy("source_id").agg(F.min("at").alias("first_at")), None),
        "signals": (signals, None),
    }
    near |= store.touched({"signals": signals})
    after = {"pass": number, "now": now, "start": start, "tables": {}}
    for table, (rows, keep) in new.items():
        after["tables"][table] = store.merge(before, number, table, rows, near[table], keep)
    # days beyond the window are forgotten by dropping their buckets
    edges = {"term_daily": TERM_DAYS, "entity_mentions": MENTION_DAYS}
    for table, n in edges.items():
        after["tables"][table] = {b: v for b, v in after["tables"][table].items() if b.split("_")[0] >= past(n).isoformat()}
    store.commit(after)
    return after
