"""License detection by ordered signature rules.

A text becomes its words, joined by single spaces. Every rule is a regular expression over them; the words that any match
of it must contain are its gate, so that an expression runs only on texts that have all of them. Overlapping detections
are resolved by priority: one that lies inside another of a stronger kind, or inside a longer one of the same kind, is
suppressed. Fixed phrases are located beside the rules and always count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import KINDS, MACROS, RULES

#: Phrases that always give their label, wherever their words stand one after another.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Confidence of a phrase.
PHRASE_WEIGHT = 0.9
#: A-Z in lower case, and a space for every other ASCII character that isn't a digit or a letter.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    regex: str
    gate: tuple[frozenset[str], ...]

    @property
    def priority(self) -> int:
        return list(KINDS).index(self.kind)


def gate(regex: str) -> tuple[frozenset[str], ...]:
    """What every match has: for each word of the expression that isn't optional, the forms of which one must be there.

    Optional groups of whole words are left out; of what stands between spaces then, plain words, words with a
    choice of letters, and groups of alternatives say something, the last ones by their first words.
    """
    optional = re.compile(r"\(\?:([^()]*)\)(?:\?|\{0,\d+\})")

    def whole(m: re.Match) -> str:
        parts = m.group(1).split("|")
        return "" if all(x[:1] == " " for x in parts) or all(x[-1:] == " " for x in parts) else m.group().translate(str.maketrans("(?:)", "<!!>"))

    while (plain := optional.sub(whole, regex)) != regex:
        regex = plain
    depth, parts = 0, [""]
    for c in regex:
        depth += (c in "([{<") - (c in ")]}>")
        if c == " " and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for p in parts:
        inner = re.fullmatch(r"\(\?:([^()]*)\)", p)
        # only the first word of an alternative surely stands after a space, and only a plain one says something
        words = [a.split(" ")[0] for a in inner.group(1).split("|")] if inner else [p]
        letters = [re.fullmatch(r"([a-z0-9]*)(?:\[([a-z0-9]+)\]([a-z0-9]*))?", w) for w in words]
        if all(m and m.group() for m in letters):
            out.append(frozenset(f"{m[1]}{c}{m[3] or ''}" for m in letters for c in m[2] or [""]))
    return tuple(out)


def parse(text: str) -> list[Rule]:
    """Rules from lines of label, kind and expression."""
    out = []
    for line in text.strip().splitlines():
        label, kind, regex = line.split(" ", 2)
        for name, form in MACROS.items():
            regex = regex.replace(name, form)
        out.append(Rule(label, kind, regex, gate(regex)))
    return out


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


def resolve(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The detections (first word, last word, priority, rule) that are inside no stronger one.

    In the order of priority, first word, longer one, rule: a detection is suppressed if a kept one before it
    contains it. A sweep with the running maximum of ends, so n log n whatever overlaps.
    """
    kept: list[tuple[int, int, int, int]] = []
    by_priority = defaultdict(list)
    for h in hits:
        by_priority[h[2]].append(h)
    starts: list[int] = []
    reach: list[int] = []
    for level in sorted(by_priority):
        new, far = [], -1
        for h in sorted(by_priority[level], key=lambda h: (h[0], -h[1], h[3])):
            i = bisect_right(starts, h[0])
            if h[1] <= far or (i and reach[i - 1] >= h[1]):
                continue
            far = h[1]
            new.append(h)
        kept = sorted(kept + new)
        starts, reach, far = [h[0] for h in kept], [], -1
        for h in kept:
            far = max(far, h[1])
            reach.append(far)
    return kept


class Scanner:
    """Compiled rules and phrases with their gates."""

    def __init__(self, rules: list[Rule], phrases=PHRASES):
        self.rules, self.phrases = rules, [(f" {p} ".encode(), frozenset(p.encode().split()), label) for p, label in phrases]
        self.gates = [[frozenset(w.encode() for w in forms) for forms in r.gate] for r in rules]
        # a rule is looked up by those of its words whose shortest form is the longest, which few texts have
        self.by_key: dict[bytes, list[int]] = defaultdict(list)
        for i, need in enumerate(self.gates):
            for w in max(need, key=lambda forms: min(map(len, forms))):
                self.by_key[w].append(i)
        self.known = frozenset().union(*[forms for need in self.gates for forms in need], *[p[1] for p in self.phrases])
        # borders don't consume a space, so that neighbours are found
        self.compiled = [re.compile(rb"(?<= )(?:" + r.regex.encode() + rb")(?= )") for r in rules]

    def gated(self, seen: set[bytes]) -> list[int]:
        some = {i for w in seen if w in self.by_key for i in self.by_key[w]}
        return sorted(i for i in some if not any(forms.isdisjoint(seen) for forms in self.gates[i]))

    def hits(self, joined: bytes, rules) -> list[tuple[int, int, int, int]]:
        """All matches of some rules, by word."""
        out = []
        for i in rules:
            at, word = 0, -1
            for m in self.compiled[i].finditer(joined):
                word += joined.count(b" ", at, m.start())
                at = m.start()
                out.append((word, word + m.group().count(b" "), self.rules[i].priority, i))
        return out

    def places(self, joined: bytes, seen: set[bytes]) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of every place of every phrase."""
        out = []
        for phrase, need, label in self.phrases:
            if need <= seen:
                at, found, word = 0, joined.find(phrase), 0
                while found >= 0:
                    word += joined.count(b" ", at, found)
                    out.append((word, word + phrase.count(b" ") - 2, label))
                    at, found = found, joined.find(phrase, found + 1)
        return out

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        seen = set(self.known.intersection(words))
        chosen = self.gated(seen)
        places, kept = [], []
        if chosen or any(need <= seen for _, need, _ in self.phrases):
            joined = b" " + b" ".join(words) + b" "
            places, kept = self.places(joined, seen), resolve(self.hits(joined, chosen))
        base = {p[2] for p in places}
        found = [{"label": r.label, "kind": r.kind, "first_word": a, "last_word": b} for a, b, _, i in kept for r in [self.rules[i]]]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((p[0] for p in places), default=None),
            "last_word": max((p[0] for p in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {f["label"] for f in found})),
            "score": max([PHRASE_WEIGHT] * bool(places) + [KINDS[f["kind"]] for f in found], default=0.0),
            "detections": found,
        }


@lru_cache(maxsize=1)
def _default() -> Scanner:
    return Scanner(parse(RULES))


KINDS_OF = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, rules: str | None = None, phrases=PHRASES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): what its whole text says about licenses. No shuffle.

    Columns: doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest
    start, words from 0; null without any), base_labels, labels (the rules' too), score (confidence of the
    strongest kind, 0 without labels) and detections, the spans that are left. A null or empty text has no
    words and no labels; a null doc_id and repeated rows pass through; other columns are ignored. ``rules`` are lines
    as in ``license_rules``, by default those.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<label:string,kind:string,first_word:bigint,last_word:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _default() if rules is None and phrases is PHRASES else Scanner(parse(RULES if rules is None else rules), phrases)
        ints, names = pa.int64(), ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        span = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", ints), ("last_word", ints)]))
        types = [ints, ints, ints, ints, pa.string(), pa.string(), pa.float64()]
        for b in batches:
            found = [scanner.scan(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([f[n] for f in found], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array([f["detections"] for f in found], span)], names=["doc_id", *names, "detections"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, {KINDS_OF}, detections {spans}")
