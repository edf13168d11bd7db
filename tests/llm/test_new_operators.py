"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_operators import ODD, odd
from tidewatch.llm import common, license_scan, resampling, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def docs(spark, data):
    return common.read(spark, data, "documents")


# 13 resampling towards a target


def runs(words, longest):
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def resample_brute(docs, target, longest=1, n=10_000, seed="2024", least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = np.zeros(n, int), np.zeros(n, int)
    for texts, out in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            for f in runs(terms(text), longest):
                out[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(float(b + 1) * float(s.sum() + n) / (float(a + 1) * float(t.sum() + n)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for i, text in docs:
        w = terms(text)
        f = runs(w, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts_of(df, key="doc_id"):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_draw_matches_brute_force(spark, data, docs):
    target = common.read(spark, data, "benchmark")
    want = resample_brute(texts_of(docs), [t for _, t in texts_of(target, "item_id")])
    assert resampled(resampling.resample(docs, target)) == want
    assert sum(r[4] is not None for r in want) > 10
    longer = resampling.resample(docs, target, longest=3, n=512, seed="x", min_words=5, percent=40)
    assert resampled(longer) == resample_brute(texts_of(docs), [t for _, t in texts_of(target, "item_id")], 3, 512, "x", 5, 40)


def test_draw_of_odd_rows(spark, docs):
    target = odd(spark)
    source = [(r[0], r[1]) for r in ODD]
    got = resampled(resampling.resample(odd(spark), target, min_words=1, percent=60))
    assert got == resample_brute(source, [t for _, t in source], least=1, percent=60)
    none = spark.createDataFrame([], "text string, doc_id long, rank int")
    assert resampling.resample(none, target).count() == 0
    assert resampled(resampling.resample(odd(spark), none)) == resample_brute(source, [])
    # many ties in score, which the id breaks, and a draw that ends among them
    same = spark.createDataFrame([(i // 2, "a b c", "x", 1) for i in range(60)], "doc_id long, text string, weight string, place int")
    got = resampling.resample(same, target, min_words=1, percent=35)
    assert resampled(got) == resample_brute([(i // 2, "a b c") for i in range(60)], [t for _, t in source], least=1, percent=35)


def test_scoring_explodes_nothing(docs):
    plan = resampling.scored(docs, np.zeros(10_000, np.int64))._jdf.queryExecution().toString()
    assert not re.search("Generate|Exchange|Python|Arrow", plan)


# 12 vector codes


def codes_brute(vectors, scale=1024, parts=4, entries=256, rounds=4):
    """Rows (id, label, code, error, label error) and the digest, with Python integers and every distance."""
    kept = [(i, lab, [math.floor(Fraction(x) * scale) for x in v]) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    kept = [(i, lab, v + [0] * (parts * width - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for *_, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for *_, v in kept]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (*_, v), a in zip(kept, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, lab, v), a in zip(kept, assign()):
        out.append((i, lab, bytes(a).hex(), min(sum(far(cut(v, p), books[p][a[p]]) for p in range(parts)), 2**63 - 1)))
    sums = {lab: min(sum(r[3] for r in out if r[1] == lab), 2**63 - 1) for _, lab, *_ in out}
    return sorted(((i, c, e, sums[lab]) for i, lab, c, e in out), key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def coded(df):
    rows = df.collect()
    assert len({r["codebooks_sha256"] for r in rows}) <= 1
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=str), rows[0]["codebooks_sha256"]


VECTORS = "vec_id long, embedding array<double>, label int, code int, v string"


@pytest.mark.parametrize("size", [1.0, 1e5, 1e160, 1e305])
def test_codes_match_brute_force(spark, size):
    rng = np.random.default_rng(12)
    vectors = [(i, (size * rng.normal(size=10)).tolist(), None if i % 7 == 0 else i % 3) for i in range(90)]
    vectors += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [-float("inf")] * 10, 1), (204, [0.5], 1), (205, [], 2), (None, [1.0] * 10, 2)]
    vectors += [(3, vectors[3][1], 0)] * 5 + [(300 + i, [0.25, -0.25] * 5, 2) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], VECTORS)
    got = vector_codes.compress(df.repartition(3), entries=16, rounds=3, bits=2)
    assert coded(got) == codes_brute(vectors, entries=16, rounds=3)


def test_codes_of_few_and_no_vectors(spark):
    few = [(1, [0.5, -0.5], 1), (2, [0.5, 0.75], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in few], VECTORS)
    assert coded(vector_codes.compress(df)) == codes_brute(few)
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.drop("label")).first()["label_error"] == sum(r[2] for r in codes_brute(few)[0])


def test_filter_spares_distances():
    rng = np.random.default_rng(5)
    entries, q = rng.integers(-200, 200, (256, 16)), rng.integers(-200, 200, (1000, 16))

    class Work:
        n = 0

        def add(self, x):
            self.n += x

    work, every = Work(), ((q[:, None] - entries[None]) ** 2).sum(2)
    book = vector_codes.Approximations(entries)
    lower, upper = book.bounds(q)
    assert (lower <= every).all() and (upper >= every).all()
    entry, error = book.nearest(q, work)
    assert (entry == every.argmin(1)).all() and (error == every.min(1)).all()
    assert work.n < 0.05 * every.size, work.n


def test_a_large_label_meets_its_sum_in_groups(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else 1, "00", 2**62) for i in range(50)], "vec_id long, label int, code string, error long")
    got = {(r["label"], r["label_error"]) for r in vector_codes.with_label_errors(rows).collect()}
    assert got == {(None, 2**63 - 1), (1, 2**63 - 1)} and vector_codes.with_label_errors(rows).count() == 50


# 11 license scans

RULES = license_scan.parse(license_scan.RULES)


def example(regex):
    """A shortest text of a rule: no optional part, the first alternative and letter."""
    regex = re.sub(r"\[(\w)\w*\]", r"\1", regex.replace("[^ ]+", "x"))
    while True:
        now = re.sub(r"\(\?:([^()]*)\)(\?|\{0,\d+\})", "", regex)
        now = re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)(?![?{])", r"\1", now)
        if now == regex:
            return re.sub(r"[a-z]\?", "", regex)
        regex = now


def scan_brute(text, rules=RULES, phrases=license_scan.PHRASES):
    """No gates, all pairs of detections compared, words found by another expression."""
    words = terms(text)
    joined = "".join(f" {w}" for w in words) + " "
    word_at = {m.start() + 1: i for i, m in enumerate(re.finditer(" ", joined))}
    places = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    hits = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", joined):
            hits.append((r.priority, word_at[m.start()], -word_at[m.end() + 1] + 1, k))
    kept = []
    for p, a, z, k in sorted(hits):
        if not any(b <= a and -y >= -z for _, b, y, _ in kept):
            kept.append((p, a, z, k))
    base = {label for _, label in places}
    score = max([license_scan.PHRASE_WEIGHT] * bool(places) + [license_scan.KINDS[rules[k].kind] for *_, k in kept], default=0.0)
    at = [i for i, _ in places]
    both = ",".join(sorted(base | {rules[k].label for *_, k in kept}))
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), both, score)


def scanned(df):
    return [tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in df.collect()]


def test_every_rule_is_alive_and_gated_by_what_it_needs():
    assert len(RULES) > 300 and len({r.label for r in RULES}) > 60
    scanner = license_scan.Scanner(RULES)
    for r in RULES:
        assert r.gate, r
        text = example(r.regex)
        assert re.fullmatch(r.regex, text), (r.regex, text)
        assert r.label in scanner.scan(f"foo {text} bar".encode())["labels"].split(","), r


def test_scan_matches_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    texts = [t for _, t in texts_of(docs)] + [r[1] for r in ODD]
    filler = "the of under license licensed version 2 0 3 gnu general public by nc cc mit apache or later rights free".split()
    for _ in range(400):  # expressions of several rules, cut, joined and mixed with their words
        parts = [example(RULES[rng.integers(len(RULES))].regex).split() for _ in range(rng.integers(1, 5))]
        parts = [p[rng.integers(0, 2) :] if rng.random() < 0.2 else p for p in parts]
        words = [w for p in parts for w in p + rng.choice(filler, rng.integers(0, 3)).tolist()]
        texts.append("".join(w.upper() * (k % 3 == 0) + w * (k % 3 > 0) + str(rng.choice([" ", "-", ", ", "\n", "_"])) for k, w in enumerate(words)))
    texts += ["cc by nc " * 3000, "Under the MIT License Apache License, Version 2 CC-BY-NC", "under the mit", "gnu lesser general public license version 2.1 " * 40, "\u00e9mit license mit licen\u00e7e"]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double")
    got = scanned(license_scan.scan(df).orderBy("doc_id"))
    for t, g in zip(texts, got):
        assert g == scan_brute(t), (t, g)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_weaker_and_inner_detections_are_suppressed():
    scan = license_scan.Scanner(RULES).scan
    assert scan(b"Licensed under the GNU Lesser General Public License, version 2.1 or later.")["labels"] == "lgpl-2.1"
    assert scan(b"SPDX-License-Identifier: GPL-3.0-or-later")["detections"] == [{"label": "gpl-3", "kind": "tag", "first_word": 0, "last_word": 7}]
    assert scan(b"CC BY-NC-SA 4.0")["labels"] == "cc-by-nc,cc-by-nc-sa"  # the phrase stays
    assert scan(b"GPLv2 and MIT License. All rights reserved.")["labels"] == "all-rights-reserved,gpl-2,mit"
    assert scan(b"an apache and a mit gnu version of public things")["labels"] == ""


def test_own_rules(spark, docs):
    df = spark.createDataFrame([(1, "Use it, Foo Bar 2!"), (None, None)], "doc_id long, text string")
    got = license_scan.scan(df, "foo name foo bar\nfoo-2 name foo bar <v>2", ()).collect()
    assert [(r["doc_id"], r["labels"], len(r["detections"])) for r in got] == [(1, "foo-2", 1), (None, "", 0)]
