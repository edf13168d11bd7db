"""Relevance, entities, terms and proper nouns of titles, from a lexicon in a config file."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_name

CONFIG = Path(__file__).resolve().parents[1] / "config"
#: Letters and digits of the languages at hand, as a class that Java and RE2 read alike.
WORD_CHARS = "A-Za-z0-9_"
#: The same for names, in any script.
NAME_CHARS = r"\p{L}\p{N}"
# What a word of a title is; a number with a unit; what only names of models have.
TITLE_WORD = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SIZE = r"^[0-9]+\.?[0-9]*[A-Za-z]{0,2}$"
MODEL_LIKE = "[0-9-]|[a-z][A-Z]"
# Kinds whose titles are names, which join a topic only at a higher similarity.
CATALOG_KINDS = ["PAPER", "REPO", "MODEL", "DATASET", "SPACE", "MODEL_LISTED", "RELEASE", "MARKET", "TREND"]
JOIN, JOIN_CATALOG = 0.62, 0.74


@dataclass(frozen=True)
class Lexicon:
    entities: tuple[tuple[str, str, tuple[str, ...]], ...]
    stop: tuple[str, ...]
    generic: tuple[str, ...]
    keywords: tuple[str, ...]
    own_sources: tuple[str, ...]
    pull_words: tuple[str, ...]
    market_words: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [n for n, *_ in self.entities]


def lexicon(path: str | Path = CONFIG / "lexicon.json") -> Lexicon:
    raw = json.loads(Path(path).read_text())
    return Lexicon(
        tuple((e["name"], e["type"], tuple(e.get("aliases", []))) for e in raw["entities"]),
        tuple(raw["stop_words"]), tuple(raw["generic_words"]), tuple(raw["keywords"]), tuple(raw["own_source_prefixes"]),
        tuple(raw["pull_words"]), tuple(raw["market_words"]),
    )


def _escape(s: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in s)


def bounded(words, chars: str = WORD_CHARS) -> str:
    """A pattern for any of the words between characters that aren't ``chars``, longest first."""
    alternatives = "|".join(_escape(w.lower()) for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"(^|[^{chars}])({alternatives})([^{chars}]|$)"


def relevant(source: Column, title: Column, text: Column, lex: Lexicon) -> Column:
    """The source is dedicated to the subject, or a keyword stands in the title or the first 300 characters."""
    head = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 300)))
    own = F.lit(False)
    for p in lex.own_sources:
        own = own | source.startswith(p)
    return F.coalesce(own, F.lit(False)) | head.rlike(bounded(lex.keywords))


class Matcher:
    """One automaton of all aliases of all entities: its time depends on the text and the hits, not on their number."""

    def __init__(self, entities: tuple[tuple[str, str, tuple[str, ...]], ...]):
        self.names = [name for name, *_ in entities]
        of: dict[str, set[int]] = {}
        for k, (name, _, aliases) in enumerate(entities):
            for alias in (name, *aliases):
                of.setdefault(alias.lower(), set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for alias, which in of.items():
            if alias:
                self.automaton.add_word(alias, (len(alias), tuple(which)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[str]:
        """Names of the entities in a lower-case text, in the lexicon's order: an alias counts between characters that are neither
        letters nor digits."""
        if not text or not len(self.automaton):
            return []
        hits: set[int] = set()
        for end, (size, which) in self.automaton.iter(text):
            if hits.issuperset(which):
                continue
            begin = end + 1 - size
            if not (begin and text[begin - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                hits.update(which)
        return [self.names[k] for k in sorted(hits)]


@lru_cache(maxsize=8)
def matcher(entities: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Matcher:
    return Matcher(entities)


def entities(text: Column, lex: Lexicon) -> Column:
    """Names of the lexicon's entities in a text, in its order; none for null."""
    known = lex.entities

    @F.pandas_udf("array<string>")
    def of(low: pd.Series) -> pd.Series:
        return low.map(matcher(known).found)

    return of(F.lower(F.coalesce(text, F.lit(""))))


def entities_plain(text: Column, lex: Lexicon) -> Column:
    """The same by one pattern for each entity, for lambdas of array functions, where no Python can run."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(t.rlike(bounded((name, *aliases), NAME_CHARS)), F.lit(name)) for name, _, aliases in lex.entities]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def kept_words(norm: str, stop: frozenset[str]) -> list[str]:
    """Words of a normalised text that are longer than two characters, no stop words and no numbers."""
    return [w for w in norm.split() if len(w) > 2 and w not in stop and not w.isdigit()]


def terms(title: Column, lex: Lexicon) -> Column:
    """Entities with a leading @, then pairs of neighbouring kept words; each once."""
    known, stop = lex.entities, frozenset(lex.stop)

    @F.pandas_udf("array<string>")
    def of(norm: pd.Series, low: pd.Series) -> pd.Series:
        find = matcher(known).found

        def one(n: str, text: str) -> list[str]:
            words = kept_words(n, stop)
            return list(dict.fromkeys([*(f"@{e}" for e in find(text)), *map(" ".join, zip(words, words[1:]))]))

        return pd.Series(list(map(one, norm, low)), dtype=object)

    return of(norm_name(title), F.lower(F.coalesce(title, F.lit(""))))


def title_words(title: Column) -> Column:
    """Words of a title; a dash or a full stop belongs to a word that it doesn't begin."""
    return F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE_WORD), F.lit(0))


def is_name(word: Column) -> Column:
    """Three characters or more that begin with a capital, or that have capitals and no small letters."""
    return (F.length(word) >= 3) & (word.rlike("^[A-Z]") | (word.rlike("[A-Z]") & ~word.rlike("[a-z]")))


def proper_nouns(title: Column, lex: Lexicon) -> Column:
    """Capitalised words, and pairs of neighbouring ones, each once.

    In titles that capitalise every word (four words or more, 60 % of them capitalised) only words that look
    like names of models count: with a digit, an inner capital, all capitals or a dash. Numbers with a unit
    and the lexicon's stop words and generic words never count.
    """
    never = F.lit(sorted({*lex.stop, *lex.generic}))

    # each step is bound as a variable of the next one, so that it is computed once for a text and not for each word
    def bound(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def shouted(words: Column) -> Column:
        starts = F.filter(words, lambda w: w.rlike("^[A-Za-z]"))
        capital = F.filter(words, lambda w: w.rlike("^[A-Z]"))
        return (F.size(starts) >= 4) & (10 * F.size(capital) >= 6 * F.size(starts))

    def names(x: Column) -> Column:
        """Each word that is a name, and null where there is none, so that a pair with a gap is null too."""
        only = lambda w: is_name(w) & ~w.rlike(SIZE) & ~F.array_contains(never, F.lower(w)) & (~x["shouted"] | w.rlike(MODEL_LIKE) | ~w.rlike("[a-z]"))
        return F.transform(x["words"], lambda w: F.when(only(w), w))

    def runs(n: Column) -> Column:
        return F.array_distinct(F.array_compact(F.flatten(F.transform(n, lambda w, i: F.array(w, F.concat(F.get(n, i - 1), F.lit(" "), w))))))

    words = bound(title_words(title), lambda w: F.struct(w.alias("words"), shouted(w).alias("shouted")))
    return bound(bound(words, names), runs)


def event_time(family: Column, published: Column, first_seen: Column) -> Column:
    """First seen for families E and H, for undated items and for those published over 30 days before; else published."""
    late = family.isin("E", "H") | published.isNull() | (published < first_seen - F.expr("INTERVAL 30 DAYS"))
    return F.when(late, first_seen).otherwise(published)


def cluster_text(title: Column, text: Column) -> Column:
    """The title, and the text's first 200 characters unless they repeat the title's first 40."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 200)
    repeats = F.startswith(F.lower(head), F.lower(F.substring(title, 1, 40)))
    return F.trim(F.when((head == "") | repeats, title).otherwise(F.concat(title, F.lit(". "), head)))


def join_threshold(kind: Column) -> Column:
    return F.when(kind.isin(*CATALOG_KINDS), F.lit(JOIN_CATALOG)).otherwise(F.lit(JOIN))
