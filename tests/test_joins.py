"""Joins by time, hubs, dictionary matching and hashing against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from tidewatch.functions import stats, terms, vectors
from tidewatch.operators import evaluate, joins, weak

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_is_that_of_all_pairs(spark, forward, strict):
    rng = random.Random(3)
    at = lambda: START + timedelta(minutes=rng.randrange(4000))
    left = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), None if i % 40 == 0 else at(), "x") for i in range(400)]
    right = [(rng.choice(["hot", "hot", "b", None]), None if i % 50 == 0 else at(), rng.randrange(9)) for i in range(300)] * 2
    got = joins.as_of(
        spark.createDataFrame(left, "id int, k string, at timestamp, v string"), spark.createDataFrame(right, "k string, seen timestamp, v int"), ["k"], "at", "seen", ["v"], "r", forward, strict, width=6 * 3_600_000_000
    ).collect()
    assert len(got) == len(left)
    for r in got:
        ok = [(t, v) for k, t, v in right if k is not None and k == r.k and t is not None and r.at is not None and ((t > r.at or (t == r.at and not strict)) if forward else (t < r.at or (t == r.at and not strict)))]
        end = (min if forward else max)((t for t, _ in ok), default=None)
        want = (end, max(v for t, v in ok if t == end)) if ok else None
        assert (want is None and r.r is None) or (r.r.at, r.r.v) == want, (r, want)


def test_running_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(300)) for _ in range(500)]
    got = {(r.k, r.us): r.n for r in joins.running_count(spark.createDataFrame(rows, "k string, us long"), ["k"], "us", width=50).collect()}
    assert got == {(k, us): sum(x == k and t <= us for x, t in rows) for k, us in set(rows)}


def test_publications_keep_what_held_then(spark):
    t = lambda h: START + timedelta(hours=h)
    pubs = spark.createDataFrame([(1, 7, t(5)), (2, 7, t(-1)), (3, 8, t(5)), (4, 9, t(5))], "pub_id int, cluster_id int, published_at timestamp")
    scores = spark.createDataFrame([(7, t(0), 1.0, "ANTICIPATION", "A"), (7, t(5), 2.0, "LIGHT_PRESS", "AB"), (7, t(6), 3.0, "CONFIRMED", "ABC"), (8, t(9), 5.0, "CONFIRMED", "C")], "cluster_id int, computed_at timestamp, score double, status string, families string")
    topics = spark.createDataFrame([(7, "seven", t(-2)), (8, "eight", t(-2))], "cluster_id int, label string, first_seen_at timestamp")
    press = spark.createDataFrame([(7, t(1.25))], "cluster_id int, first_at timestamp")
    got = {r.pub_id: (r.score, r.status, r.families, r.label, r.lead_vs_press_h) for r in evaluate.mark_published(pubs, scores, topics, press).collect()}
    assert got == {1: (2.0, "LIGHT_PRESS", "AB", "seven", 3.3), 2: (None, None, None, "seven", 3.3), 3: (None, None, None, "eight", None), 4: (None,) * 5}
    assert {r.pub_id: r.score for r in evaluate.mark_published(pubs, scores).collect()} == {1: 2.0, 2: None, 3: None, 4: None}


def adamic_brute(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for z, ns in near.items():
        if len(ns) > 1:
            for a in ns:
                for b in ns:
                    if a < b:
                        out[a, b] = out.get((a, b), 0.0) + 1 / math.log(len(ns))
    return out


def test_hubs_are_products_of_blocks(spark, monkeypatch):
    for name, value in (("HUB", 8), ("NODES", 16), ("HUBS", 4)):
        monkeypatch.setattr(stats, name, value)
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(250)] + [(h, i) for h in range(6) for i in range(80)] + [(3, 3)]
    for frame, kind in ((edges, "long"), ([(f"n{a:02}", f"n{b:02}") for a, b in edges], "string")):
        got = {(r.a, r.b): r.score for r in stats.adamic_adar(spark.createDataFrame(frame, f"a {kind}, b {kind}")).collect()}
        want = adamic_brute(frame)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert stats.adamic_adar(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_neighbours_before_a_pair(spark):
    rng = random.Random(6)
    times = list(range(3000))
    rng.shuffle(times)
    links = {}
    for a, b in [(rng.randrange(40), rng.randrange(40)) for _ in range(300)] + [(0, i) for i in range(1, 40)]:
        if a != b:
            links.setdefault((min(a, b), max(a, b)), times.pop() * 10**9)
    cand = [(a, b, times.pop() * 10**9) for a in range(12) for b in range(a + 1, 40, 3)]
    got = {(r.a, r.b): r.aa for r in weak.common_before(spark.createDataFrame(cand, "a long, b long, us long"), spark.createDataFrame([(*k, v) for k, v in links.items()], "a long, b long, us long")).collect()}
    want = {}
    for a, b, us in cand:
        near = lambda n: {y if x == n else x for (x, y), t in links.items() if n in (x, y) and t < us}  # noqa: E731, B023
        s = sum(1 / math.log(len(near(z))) for z in near(a) & near(b) if len(near(z)) > 1)
        if s:
            want[a, b] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_one_automaton_finds_what_the_patterns_find(spark):
    rng = random.Random(7)
    syllables = ["al", "be", "ga", "del", "ta", "é", "ü", "日", "3", ".", "-", " ", "+"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).strip() or "x"
    ents = tuple((f"E{k}", "LAB", tuple({word(rng.randrange(1, 4)) for _ in range(3)})) for k in range(330))
    lex = SimpleNamespace(entities=ents, stop=("the",))
    texts = ["".join(rng.choice(syllables + [n for e in rng.choices(ents, k=2) for n in e[2]]) for _ in range(rng.randrange(60))) for _ in range(150)] + [None, "", "E1,e2 E3x xE4 (e5)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", terms.entities(F.col("t"), lex).alias("e")).collect()}
    patterns = [(n, re.compile("(^|[\\W_])(" + "|".join(re.escape(a.lower()) for a in sorted((n, *al), key=len, reverse=True)) + ")([\\W_]|$)")) for n, _, al in ents]
    for i, t in enumerate(texts):
        assert got[i] == [n for n, p in patterns if p.search((t or "").lower())], t
    one, many = terms.Matcher(ents[:5]), terms.Matcher(ents)

    def took(m):
        began = time.perf_counter()
        list(m.automaton.iter("qzqz " * 40000))
        return time.perf_counter() - began

    assert min(took(many) for _ in range(3)) < 5 * min(took(one) for _ in range(3)) + 0.05


def test_hashes_on_arrays_are_those_of_the_columns(spark):
    texts = ["a", "", "  two  words ", "one two three two one", "x" * 3000 + " y", "L'été à Zürich - 100'000 ½", None, "the end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    want = {r.id: sorted(r.h) for r in df.select("id", vectors.gram_hashes(F.col("t")).alias("h")).collect()}
    norm = [r.n for r in df.select(vectors.norm_name(F.col("t")).cast("binary").alias("n")).collect()]
    of, h = vectors.hashed_grams([None if n is None else bytes(n) for n in norm])
    got = {i: sorted(int(x) for x, o in zip(h, of) if o == i) for i in range(len(texts))}
    assert got == want
    assert vectors.hashed_cells([None, b""], 8).dtype == float and vectors.hashed_grams([])[0].size == 0 and vectors.hashed_cells([None, b""], 8).sum() == 0
