"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's letters name its script, which leaves only the languages that were seen in this script. Each of
them scores the word by its letter n-grams. The best path over the words of a text, where a change of
language costs a penalty, labels spans; a text's language is the one with most words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bound, in expectation, of the labelled documents that the n-gram counts are fitted on.
TRAIN_DOCS = 6000
SLOTS = 1 << 16
#: Cost of changing the language between two words, in nats; pseudo-count of an n-gram.
SWITCH, SMOOTH = 8.0, 0.5
#: A language is a candidate in a script that has at least this share of its training letters.
SCRIPT_SHARE = 1e-3
#: Letters that are scored at once.
WINDOW = 1 << 19
UNKNOWN = "und"

# First and last code points of scripts, from the Unicode block names.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, *_ in SCRIPTS)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its script's number."""
    letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, script


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased letters, each word followed by one 0, and the number of words of each text."""
    letter, _ = _tables()
    flat, counts = [], []
    for t in texts:
        c = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.r_[np.where(letter[c], c, 0).astype(np.uint32), np.uint32(0)]
        c = c[(c != 0) | (np.r_[np.uint32(0), c[:-1]] != 0)]
        flat.append(c)
        counts.append(int((c == 0).sum()))
    return (np.concatenate(flat) if flat else np.empty(0, np.uint32)), np.array(counts, np.int64)


def _grams(c: np.ndarray) -> list[np.ndarray]:
    """Slots of the n-grams of one to three symbols that end at each place; a word's end counts as a symbol."""
    c = c.astype(np.uint64)
    b = np.r_[np.uint64(0), c[:-1]]
    a = np.r_[np.uint64(0), b[:-1]]
    a = np.where(b == 0, np.uint64(0), a)
    out = []
    for n, parts in enumerate(((c,), (b, c), (a, b, c)), 1):
        h = np.full(len(c), n, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out.append((h & np.uint64(SLOTS - 1)).astype(np.int32))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logp: np.ndarray  # (slot, language)
    scripts: np.ndarray  # (script, language) booleans

    def words(self, c: np.ndarray) -> np.ndarray:
        """(word, language) scores of ``c``, whose words each end with a 0."""
        _, script = _tables()
        ends = np.flatnonzero(c == 0)
        out = np.empty((len(ends), len(self.languages)), np.float32)
        first, begin = 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, begin + WINDOW, side="right")))
            stop = int(ends[last - 1]) + 1
            part = c[begin:stop]
            score = sum(self.logp[g] for g in _grams(part))
            starts = np.r_[0, ends[first : last - 1] + 1 - begin]
            total = np.add.reduceat(score, starts, axis=0)
            allowed = self.scripts[script[part[starts]]]
            allowed |= ~allowed.any(axis=1, keepdims=True)
            out[first:last] = np.where(allowed, total, total.min(axis=1, keepdims=True) - np.float32(1e4))
            first, begin = last, stop
        return out


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word. Texts run side by side, the longest first; a step is one word of each."""
    order = np.argsort(-counts, kind="stable")
    size, begin = counts[order], (np.cumsum(counts) - counts)[order]
    states = score.shape[1]
    stay = np.empty(score.shape, np.bool_)
    came = np.zeros(len(score), np.int16)
    v = np.zeros((len(size), states), np.float32)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        n = int(alive[t])
        at, x = begin[:n] + t, v[:n]
        if t:
            x = x - x.max(axis=1, keepdims=True)
            came[at] = x.argmax(axis=1)
            stay[at] = x >= -switch
            x = np.maximum(x, -np.float32(switch))
        v[:n] = x + score[at]
    label = np.empty(len(score), np.int16)
    now = v.argmax(axis=1) if len(size) else np.empty(0, np.int64)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        at, state = begin[:n] + t, now[:n]
        label[at] = state
        if t:
            now[:n] = np.where(stay[at, state], state, came[at])
    return label


def train(docs: DataFrame, condition, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """N-gram and script counts of the rows of ``docs`` that meet ``condition``, have a lang and a text.

    With more rows than ``train_docs``, a sample of that expected size is taken by a hash of doc_id. Each task
    counts its own part of the sample and Spark sums the counts; the model has ``SLOTS`` rows for each
    language, and no more languages than the sample has documents, whatever the size of the table.
    """
    rows = docs.where(condition).where("lang is not null and text is not null and doc_id is not null")
    if (n := rows.count()) > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1e6 * train_docs / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, script = _tables()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                c, _ = _letters(texts)
                n = total.setdefault(lang, np.zeros(SLOTS + len(SCRIPT_NAMES), np.int64))
                for g in _grams(c):
                    n[:SLOTS] += np.bincount(g, minlength=SLOTS)
                n[SLOTS:] += np.bincount(script[c[c != 0]], minlength=len(SCRIPT_NAMES))
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    languages = tuple(sorted(got["lang"].unique(), key=lambda x: x.encode()))
    n = np.zeros((SLOTS + len(SCRIPT_NAMES), len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    n[got["slot"].to_numpy(), got["lang"].map(number).to_numpy(dtype=int)] = got["n"].to_numpy()
    grams = n[:SLOTS] + SMOOTH
    script = n[SLOTS:]
    return LanguageModel(
        languages,
        np.log(grams / grams.sum(axis=0)).astype(np.float32),
        (script > SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)) if len(languages) else script.astype(bool),
    )


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row of ``docs`` (doc_id, text, anything else).

    ``lang_pred`` is the language of most words on the best path, ties to the smaller name, ``score`` its
    share of the words. A null text or one without a letter is ``und`` with score 0, as is everything when
    nothing was learned. ``spans`` are (first word, number of words, language) in order; words are runs of
    letters. Null ids and repeated rows pass through. No shuffle.
    """
    logp = model.logp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(model.languages, logp, model.scripts)
        for batch in batches:
            c, counts = _letters(batch.column("text").to_pylist())
            k = len(m.languages)
            pred, score, spans = [UNKNOWN] * len(counts), np.zeros(len(counts)), [[] for _ in counts]
            if k and len(c):
                label = viterbi(m.words(c), counts, switch)
                doc = np.repeat(np.arange(len(counts)), counts)
                tally = np.bincount(doc * k + label, minlength=k * len(counts)).reshape(-1, k)
                best = tally.argmax(axis=1)
                for i in np.flatnonzero(counts):
                    pred[i], score[i] = m.languages[best[i]], tally[i, best[i]] / counts[i]
                if with_spans:
                    begin = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])
                    first = (np.cumsum(counts) - counts)[doc[begin]]
                    for b, e, f in zip(begin, np.r_[begin[1:], len(label)], first):
                        spans[doc[b]].append({"first": int(b - f), "words": int(e - b), "lang": m.languages[label[b]]})
            columns = [batch.column("doc_id"), pa.array(pred), pa.array(score)]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<first: bigint, words: bigint, lang: string>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))
