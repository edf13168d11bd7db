"""URL filter rules as one bit-parallel automaton.

Rules are globs over a host and a path. All rules are packed into multiword Shift-And masks: one bit for each
state of each rule, so one shift and two ands move all rules over one symbol, for a whole batch of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between host and path; no character of a URL is this symbol.
BORDER = 0x110000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A glob over ``.host`` and one over the path: ``*`` is any run of characters of its part, ``?`` any one."""

    name: str
    host: str
    path: str
    verdict: str


def prefix_rule(text: str, verdict: str) -> Rule:
    """``host/path``: this host and its subdomains, paths that begin with the rule's. ``*`` and ``?`` are globs here too."""
    host, slash, path = text.partition("/")
    return Rule(text, f"*.{host}", f"{slash}{path}*", verdict)


@dataclass(frozen=True)
class Automaton:
    classes: dict[int, int]
    step: np.ndarray  # (class, word): states that a symbol of the class enters
    loop: np.ndarray  # (class, word): states that a symbol of the class stays in
    start: np.ndarray  # (word,)
    final: tuple[tuple[int, int], ...]  # (word, bit) of each rule


def compile_rules(rules: list[Rule]) -> Automaton:
    """Bits in rule order: an initial state and one state for each symbol, the last one accepting."""
    parsed, symbols = [], {BORDER}
    for rule in rules:
        states = [[None, False, False]]  # symbol (None: any), loops before the border, loops anywhere
        for part, anywhere in ((rule.host, False), (rule.path, True)):
            if anywhere:
                states.append([BORDER, False, False])
            for c in part:
                if c == "*":
                    states[-1][1 + anywhere] = True
                else:
                    states.append([None if c == "?" else ord(c), False, False])
        parsed.append(states)
        symbols.update(s for s, *_ in states if s is not None)
    classes = {s: i + 1 for i, s in enumerate(sorted(symbols))}
    bits = sum(map(len, parsed))
    width = max(1, -(-bits // 64))
    step, loop = (np.zeros((len(classes) + 1, width), np.uint64) for _ in range(2))
    start, final, at = np.zeros(width, np.uint64), [], 0
    for states in parsed:
        for k, (symbol, inside, anywhere) in enumerate(states):
            word, bit = divmod(at, 64)
            one = np.uint64(1 << bit)
            if k == 0:
                start[word] |= one
            elif symbol is None:
                step[np.arange(len(step)) != classes[BORDER], word] |= one
            else:
                step[classes[symbol], word] |= one
            if anywhere:
                loop[:, word] |= one
            elif inside:
                loop[np.arange(len(loop)) != classes[BORDER], word] |= one
            at += 1
        final.append(divmod(at - 1, 64))
    return Automaton(classes, step, loop, start, tuple(final))


def match(automaton: Automaton, hosts: list[str], paths: list[str]) -> np.ndarray:
    """(url, rule) booleans. URLs run side by side, the longest first, so that a step only touches unfinished ones."""
    coded = [np.frombuffer(f".{h}".encode("utf-32-le"), np.uint32) for h in hosts], [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in paths]
    border = np.array([BORDER], np.uint32)
    flat = np.concatenate([x for h, p in zip(*coded) for x in (h, border, p)]) if hosts else np.empty(0, np.uint32)
    known = np.array(sorted(automaton.classes), np.uint32)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    flat = np.where(known[at] == flat, at + 1, 0)
    size = np.array([len(h) + 1 + len(p) for h, p in zip(*coded)], np.int64)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], begin[order]
    state = np.repeat(automaton.start[None, :], len(hosts), axis=0)
    one, top = np.uint64(1), np.uint64(63)
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        c, d = flat[begin[:n] + t], state[:n]
        moved = d << one
        moved[:, 1:] |= d[:, :-1] >> top
        state[:n] = (moved & automaton.step[c]) | (d & automaton.loop[c])
    hit = np.empty((len(hosts), len(automaton.final)), bool)
    for i, (word, bit) in enumerate(automaton.final):
        hit[order, i] = (state[:, word] >> np.uint64(bit)) & one != 0
    return hit


def split_url(url: str = "url"):
    """(host, path): A-Z of the host lower-cased, query and fragment gone; both empty without ``://`` or for null."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def filter_urls(pages: DataFrame, rules: list[Rule], fallback: list[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, hits) of every row of ``pages`` (page_id, url, anything else).

    Of the ``rules`` that match, the one with the longest name decides, the first of them in case of a tie,
    and is given as ``rule``. Without one, ``rule`` is null and the verdict is that of the first matching
    ``fallback`` rule, else ``default``. ``hits`` lists the names of all matching rules. A null url or one
    without ``://`` has an empty host and path, which globs may still match; null ids and repeated rows pass
    through. No shuffle.
    """
    automaton = compile_rules(rules + fallback)
    host, path = split_url()

    names = np.array([r.name for r in rules + fallback], object)
    said = np.array([r.verdict for r in rules + fallback] + [default], object)
    best = np.array(sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i)) + list(range(len(rules), len(names))), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = match(automaton, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            # the first match in this order decides; without one it is the default's number
            ordered = np.c_[hit[:, best], np.ones(len(hit), bool)]
            own = np.r_[best, len(names)][ordered.argmax(axis=1)]
            ruled = own < len(rules)
            rule = np.where(ruled, np.r_[names, None][own], None)
            ends = np.r_[0, hit.sum(axis=1).cumsum()].astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[np.nonzero(hit)[1]], pa.string()))
            columns = [batch.column(c) for c in ("page_id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(said[own], pa.string()), hits]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "hits"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, hits array<string>"
    )
