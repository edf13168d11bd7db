"""The incremental weak pass against a sequential one that keeps its states in dictionaries."""

from __future__ import annotations

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from tidewatch.functions import terms
from tidewatch.operators import passes

LEX = terms.lexicon()
START = datetime(2024, 1, 1)
ITEMS = "item_id long, source_id string, family string, title string, text string, first_seen_at timestamp, cred double, precocity double, terms array<string>, entities array<string>, ns string"
CRED = {"s0": 0.7, "s1": 0.65, "s2": 0.4, "s3": 0.3, "s4": 0.62}


def make_items(seed: int, n: int = 700):
    rng = random.Random(seed)
    names = [f"Ent{i}" for i in range(24)]
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=round(i * 26 * 86400 / n) + rng.randrange(200), microseconds=i)
        source = rng.choice(list(CRED))
        # old terms at any time, and some that begin late and come in bursts
        words = {f"Old{rng.randrange(40)}" for _ in range(rng.randrange(3))}
        late = int((at - START).total_seconds() // 43200)
        if rng.random() < 0.5:
            words |= {f"New{late - rng.randrange(2)}"}
        if rng.random() < 0.1:
            words.add(f"Ent{rng.randrange(3)} Pro")
        close = rng.randrange(8) * 3
        ents = {names[close + rng.randrange(3)] for _ in range(rng.randrange(4))} if rng.random() < 0.94 else set(rng.sample(names, 2))
        rows.append((i, source, "G" if rng.random() < 0.05 else rng.choice("ABF"), LEX.keywords[0], None, at, CRED[source], None if source == "s2" else 0.25, sorted(words), sorted(ents, reverse=True), "x"))
    return rows


def sequential(rows, times, backfill=14, detect_hours=6):
    """Signals and states of one loop over the items of each pass, in order of time."""
    start, last, signals = min(r[5] for r in rows), None, {}
    daily, last_of, vocab, sources, ent_days, pairs = {}, {}, {}, {}, {}, {}
    hours = lambda a, b: (a - b).total_seconds() / 3600
    for now in times:
        since = last or now - timedelta(days=backfill)
        detect_since = last or now - timedelta(hours=detect_hours)
        days = max(1.0, hours(now, start) / 24)
        new = {}
        for i, source, family, _, _, at, cred, prec, words, ents, _ in sorted((r for r in rows if since < r[5] <= now and r[2] != "G"), key=lambda r: (r[5], r[0])):
            detect = at >= detect_since
            score = lambda bits, families: bits * cred * (0.5 + (prec or 0.0)) * max(1, families)  # noqa: E731, B023
            emit = lambda det, ns, key, bits, families: new.setdefault((det, ns, key), (i, bits, families, score(bits, families)))  # noqa: E731, B023
            sources.setdefault(source, at)
            for word in words:
                known = any(e.lower() in word.lower() for e in ents)
                d = daily.setdefault((word, at.date()), [0, set(), set()])
                d[0] += 1
                d[1].add(source)
                d[2].add(family)
                first, _, n, recent = last_of.get(word, (at, at, 0, []))
                was = word in last_of
                recent = [*recent, (at, family, cred)][-6:]
                last_of[word] = (first, at, n + 1, recent)
                if detect and not known and days >= 7 and (not was or hours(at, first) <= 48):
                    key = f"{word}|{first.date()}"
                    if len(recent) >= 3:
                        span = max(1 / 24, hours(recent[-1][0], recent[-3][0]) / 24)
                        mu = 3 / days * span
                        p = max(0.0, 1 - math.exp(-mu) * (1 + mu + mu * mu / 2))
                        if p < 1e-4:
                            emit("D2", "term", key, min(20, -math.log2(max(p, 1e-12))), len({x[1] for x in recent}))
                    near = [x for x in recent if hours(at, x[0]) <= 24]
                    if len({x[1] for x in near}) >= 2 and sum(x[2] for x in near) / len(near) >= 0.5:
                        emit("D2", "term", key, 6.0, len({x[1] for x in near}))
                old = hours(now, sources[source]) / 24
                if detect and cred >= 0.6 and old >= 7 and (source, word) not in vocab and not known:
                    emit("D4", f"vocab:{source}", word, math.log2(1 + old), 1)
                if cred >= 0.6:
                    a, _, n = vocab.get((source, word), (at, at, 0))
                    vocab[source, word] = (a, at, n + 1)
            for e in ents:
                ent_days[e, at.date()] = ent_days.get((e, at.date()), 0) + 1
            edge = (now - timedelta(days=30)).date()
            before = {k: v for k, v in pairs.items()}
            for a, b in itertools.combinations(sorted(ents), 2):
                if detect and (a, b) not in pairs and days >= 7:
                    count = lambda e: sum(n for (x, d), n in ent_days.items() if d >= edge and e in (None, x))  # noqa: E731, B023
                    na, nb, total = count(a), count(b), count(None)
                    if na >= 5 and nb >= 5:
                        nearby = lambda e: {x if y == e else y for x, y in before if e in (x, y)}  # noqa: E731, B023
                        aa = sum(1 / math.log(len(nearby(z))) for z in nearby(a) & nearby(b) if len(nearby(z)) > 1)
                        surprise = math.log2(total * total / (na * nb))
                        if aa < 1 and surprise >= 3:
                            emit("D3", "pair", f"{a}|{b}", surprise / (1 + aa), 1)
                f, _, n = pairs.get((a, b), (at, at, 0))
                pairs[a, b] = (f, at, n + 1)
        for k, v in new.items():
            signals.setdefault(k, v)
        ago = lambda d: now - timedelta(days=d)  # noqa: E731, B023
        daily = {k: v for k, v in daily.items() if k[1] >= ago(30).date()}
        last_of = {k: v for k, v in last_of.items() if not (v[1] < ago(30) or (v[2] == 1 and v[1] < ago(14)))}
        vocab = {k: v for k, v in vocab.items() if not v[1] < ago(90)}
        ent_days = {k: v for k, v in ent_days.items() if k[1] >= ago(30).date()}
        last = now
    return signals, {"term_daily": daily, "term_last": last_of, "source_vocab": vocab, "entity_mentions": ent_days, "entity_pairs": pairs, "sources": sources}


def kept(store, m):
    r = lambda t: store.read(m, t).collect()
    edge = datetime.fromisoformat(m["now"]) - timedelta(days=14)
    return {
        "term_daily": {(x.term, x.day): [x.n, set(x.sources), set(x.families)] for x in r("term_daily")},
        # what an untouched bucket still holds beyond its time is left out when it is read
        "term_last": {x.term: (x.first_at, x.last_at, x.n, [(y.at, y.family, y.cred) for y in x.recent]) for x in r("term_last") if not (x.n == 1 and x.last_at < edge)},
        "source_vocab": {(x.source_id, x.term): (x.first_at, x.last_at, x.n) for x in r("source_vocab")},
        "entity_mentions": {(x.entity, x.day): x.n for x in r("entity_mentions")},
        "entity_pairs": {(x.a, x.b): (x.first_at, x.last_at, x.n) for x in r("entity_pairs")},
        "sources": {x.source_id: x.first_at for x in r("sources")},
    }


@pytest.fixture()
def few_buckets(monkeypatch):
    monkeypatch.setattr(passes, "BUCKETS", 6)
    monkeypatch.setattr(passes, "DAY_PARTS", 2)


def test_passes_are_those_of_a_sequential_loop(spark, tmp_path, few_buckets):
    rows = make_items(1)
    items = spark.createDataFrame(rows, ITEMS)
    times = [START + timedelta(days=d) for d in (15, 15.5, 19, 25.25)]
    store = passes.Store(spark, str(tmp_path))
    for now in times:
        m = passes.run_pass(store, items, LEX, now)
        assert passes.run_pass(store, items, LEX, now) == m  # again: nothing changes
    signals, states = sequential(rows, times)
    got = {(r.detector, r.ns, r.key): (r.item_id, r.bits, r.families, r.score) for r in store.read(m, "signals").collect()}
    assert set(got) == set(signals)
    for k, (item, bits, families, score) in signals.items():
        assert got[k][0] == item and got[k][2] == families, (k, got[k], signals[k])
        assert abs(got[k][1] - bits) < 1e-9 and abs(got[k][3] - score) < 1e-9, k
    assert {d: sum(k[0] == d for k in got) > 2 for d in ("D2", "D3", "D4")} == {"D2": True, "D3": True, "D4": True}
    assert kept(store, m) == states
    # only what is named is left, and the last manifest but one with its versions
    assert len(list((tmp_path / "manifest").iterdir())) == 2
    named = {v for t in m["tables"]["entity_pairs"].values() for v in [t]}
    assert all(int(v.name[2:]) in named | {2, 3} for v in (tmp_path / "entity_pairs").iterdir() if any(v.glob("bucket=*")))


def test_a_broken_pass_is_run_again(spark, tmp_path, few_buckets, monkeypatch):
    rows = make_items(2, 200)
    items = spark.createDataFrame(rows, ITEMS)
    times = [START + timedelta(days=d) for d in (16, 20)]
    store = passes.Store(spark, str(tmp_path / "a"))
    passes.run_pass(store, items, LEX, times[0])
    with monkeypatch.context() as broken:
        broken.setattr(store, "commit", lambda m: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            passes.run_pass(store, items, LEX, times[1])
    (tmp_path / "a" / "manifest" / "9").mkdir()  # a manifest without its mark
    assert store.latest()["pass"] == 0
    m = passes.run_pass(store, items, LEX, times[1])
    assert kept(store, m) == sequential(rows, times)[1]


def test_passes_without_items(spark, tmp_path):
    items = spark.createDataFrame([(1, "s", "A", None, None, None, 0.7, None, None, [None], "x")], ITEMS)
    store = passes.Store(spark, str(tmp_path))
    for now in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        m = passes.run_pass(store, items, LEX, now)
    assert m["pass"] == 1 and store.read(m, "signals").count() == 0 and store.read(m, "term_last").count() == 0


def test_tables_between_stages_are_cleared(spark):
    from pathlib import Path

    from tidewatch import session

    others, session._MADE[:] = list(session._MADE), []
    df = session.written(spark.range(5))
    made = list(session._MADE)
    assert df.count() == 5 and len(made) == 1 and Path(made[0]).exists()
    assert session.clear(spark) == 1 and not Path(made[0]).exists() and session.clear(spark) == 0
    session._MADE[:] = others


def test_popularity_is_that_of_all_earlier_days(spark):
    from pyspark.sql import functions as F
    from tidewatch.operators import weak

    rng = random.Random(8)
    days = {(c, rng.randrange(700)): rng.randrange(1, 50) for c in range(6) for _ in range(60)}
    df = spark.createDataFrame([(c, START.date() + timedelta(days=d), n) for (c, d), n in days.items()], "cluster_id int, day date, n long")
    got = {(r.cluster_id, (r.day - START.date()).days): r.pop for r in weak.popularity(df, "2030-01-01").collect()}
    for (c, d), pop in got.items():
        want = sum(n * math.exp(-0.24 * (d - e)) for (x, e), n in days.items() if x == c and e <= d)
        assert abs(pop - want) < 1e-9 * want
    assert len(got) == len(days) and weak.popularity(df.where(F.lit(False)), "2030-01-01").count() == 0
