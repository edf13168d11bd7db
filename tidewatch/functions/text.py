"""Text, URL and hash columns. All but the two Unicode norms are built from JVM functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers see it; Java's ``\s`` leaves out most of these.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]+"
# Names of query parameters that only track visits.
TRACKING = r"utm_[a-z0-9_]+|fbclid|gclid|ref|ref_src|source|mc_cid|mc_eid|igshid|_hsenc|_hsmi"
QUOTES, QUOTES_PLAIN = "’‘`´–—‐", "''''---"
# Titles that are no part of a person's name.
TITLES = ("phd", "md", "msc", "prof", "dr", "pharmd", "mba")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789' -")


def _compatible() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and these forms; no signs of CJK."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0x80, 0x2E80), *range(0xFB00, 0xFFF0)) if not 0xFDD0 <= c < 0xFDF0]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _bare() -> tuple[str, str]:
    """Lower-case characters that decompose to one character of a name and accents, and these characters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if x in NAME_CHARS)) for c in range(0x80, 0x2000)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Tables made by rule from the Unicode data, for ``translate`` here and in SQL.
COMPATIBLE, COMPATIBLE_PLAIN = _compatible()
ACCENTED, PLAIN = _bare()
#: Compatibility forms of several characters that texts do have: three dots and ligatures.
EXPANDED = {c: unicodedata.normalize("NFKC", c) for c in "…ﬀﬁﬂﬃﬄ"}


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_text(c), SPACE, " "))


def _compatibility(c: Column) -> Column:
    many = c
    for char, form in EXPANDED.items():
        many = F.replace(many, F.lit(char), F.lit(form))
    return F.translate(F.when(c.rlike("[" + "".join(EXPANDED) + "]"), many).otherwise(c), COMPATIBLE, COMPATIBLE_PLAIN)


def norm_plain(c) -> Column:
    """``norm`` by tables alone, for lambdas of array functions, where no Python can run."""
    t = F.coalesce(_text(c), F.lit(""))
    low = F.lower(F.when(t.rlike(r"[^\x00-\x7F]"), _compatibility(t)).otherwise(t))
    return squeeze(F.translate(low, QUOTES, QUOTES_PLAIN))


def norm_name_plain(c) -> Column:
    """``norm_name`` by tables alone."""
    return squeeze(F.regexp_replace(F.translate(norm_plain(c), ACCENTED, PLAIN), r"[^a-z0-9' -]", ""))


#: Quotes, dashes and white space as ``norm`` leaves them; and the ASCII characters that no name keeps.
_PLAIN_SIGNS = str.maketrans(QUOTES, QUOTES_PLAIN) | {c: " " for c in (*range(9, 14), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)}
_NO_NAME = bytes(c for c in range(128) if chr(c) not in NAME_CHARS)


def _single_spaces(t: str) -> str:
    return " ".join(filter(None, t.split(" ")))


def norm_text(t: str | None) -> str:
    return _single_spaces(unicodedata.normalize("NFKC", t or "").lower().translate(_PLAIN_SIGNS))


def norm_name_text(t: str | None) -> str:
    bare = unicodedata.normalize("NFD", norm_text(t)).encode("ascii", "ignore").translate(None, _NO_NAME)
    return _single_spaces(bare.decode("ascii"))


def norm(c) -> Column:
    """Compatibility forms (NFKC), lower case, plain quotes and dashes, single spaces; null is empty.

    In Arrow batches: Spark has no such function, and the tables of ``norm_plain`` take many times as long.
    """
    return _norm(_text(c))


def norm_name(c) -> Column:
    """``norm`` without accents, and of what is left only letters, digits, quote, space and dash."""
    return _norm_name(_text(c))


@F.pandas_udf(StringType())
def _norm(s: pd.Series) -> pd.Series:
    return s.map(norm_text)


@F.pandas_udf(StringType())
def _norm_name(s: pd.Series) -> pd.Series:
    return s.map(norm_name_text)


def decode_entities(c) -> Column:
    """Named and numeric entities; an ampersand is decoded before the others, as browsers' feeds need it."""
    out = _text(c)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.transform(F.array(out), lambda t: F.when(F.contains(t, F.lit("&#")), _numeric(t)).otherwise(t))[0]


def _numeric(c: Column) -> Column:
    """Numeric entities by replacing each different one; an ampersand comes last, so that it makes no new ones."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
    point = lambda e: F.when(e.rlike("^[xX]"), F.conv(F.substring(e, 2, 6), 16, 10)).otherwise(e).cast("long")
    known = F.transform(found, lambda e: F.struct((point(e) == 38).alias("last"), e.alias("e"), point(e).alias("n")))
    sound = F.filter(known, lambda x: (x["n"] > 0) & (x["n"] < 0x110000) & ~x["n"].between(0xD800, 0xDFFF))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.aggregate(F.array_sort(sound), c, lambda t, x: F.replace(t, F.concat(F.lit("&#"), x["e"], F.lit(";")), char(x["n"])))


# Elements whose content is not for readers, elements at whose end a line ends, and types of feeds.
SILENT = "script style noscript svg template".split()
ENDS_LINE = "p div li h1 h2 h3 h4 h5 h6 tr section article header footer figcaption blockquote dd dt".split()
FEEDS = ("application/rss+xml", "application/atom+xml")
#: Patterns made from them, which Java and RE2 read alike.
TAG, COMMENT = "<[^>]+>", "(?s)<!--.*?-->"
LINE_END = "(?i)" + "|".join([f"</{t}>" for t in ENDS_LINE] + [r"<br\s*/?>"])
#: Attributes and content of an anchor, and attributes of a link element.
ANCHOR, LINK = r"(?is)<a(\s[^>]*)>(.*?)</a>", r"(?is)<link(\s[^>]*)>"
#: Scheme and host, path, and what follows it.
ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"


def whole_element(name: str) -> str:
    return rf"(?is)<{name}\b.*?</{name}>"


def attribute_value(name: str) -> str:
    """A quoted value of an attribute, in the first group or the second one."""
    return rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def attribute(attributes, name: str) -> Column:
    """An attribute's value, empty without one."""
    return F.concat(*[F.regexp_extract(_text(attributes), attribute_value(name), g) for g in (1, 2)])


def strip_tags(c) -> Column:
    return F.regexp_replace(_text(c), TAG, " ")


def html_to_text(c) -> Column:
    """Readable lines of a page: no scripts, styles or comments, a line for each block, no empty lines."""
    h = _text(c)
    for name in SILENT:
        h = F.regexp_replace(h, whole_element(name), " ")
    h = F.regexp_replace(F.regexp_replace(h, COMMENT, " "), LINE_END, "\n")
    lines = F.transform(F.split(decode_entities(strip_tags(h)), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def extract_links(c, base=None) -> Column:
    """array<struct<href, text, feed>> of a page's anchors in order, then of the feeds that it names; from ``base``, addresses are absolute.

    Attributes may come in any order. Anchors without an address, or with one that has a fragment, are no links.
    """
    at = (lambda h: h) if base is None else (lambda h: absolute_url(h, base))
    link = lambda h, t, feed: F.struct(at(h).alias("href"), t.alias("text"), F.lit(feed).alias("feed"))
    attributes, bodies = (F.regexp_extract_all(_text(c), F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    anchors = F.zip_with(attributes, bodies, lambda a, b: F.struct(attribute(a, "href").alias("h"), b.alias("b")))
    anchors = F.filter(anchors, lambda x: (x["h"] != "") & ~F.contains(x["h"], F.lit("#")))
    named = F.filter(F.regexp_extract_all(_text(c), F.lit(LINK), F.lit(1)), lambda a: F.lower(attribute(a, "type")).isin(*FEEDS) & (attribute(a, "href") != ""))
    return F.concat(F.transform(anchors, lambda x: link(x["h"], squeeze(decode_entities(strip_tags(x["b"]))), False)), F.transform(named, lambda a: link(attribute(a, "href"), F.lit("RSS"), True)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def without_dots(address) -> Column:
    """An address without ``.`` and ``..`` in its path, as browsers resolve them."""

    def resolved(u: Column, path: Column) -> Column:
        begin, rest = F.regexp_extract(u, ADDRESS, 1), F.regexp_extract(u, ADDRESS, 3)
        step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x))
        kept = F.array_join(F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), step), "/")
        # a path that ends in dots is a folder
        return F.concat(begin, F.lit("/"), kept, F.when(path.rlike(r"/\.\.?$") & (kept != ""), "/").otherwise(""), rest)

    def one(u: Column) -> Column:
        path = F.regexp_extract(u, ADDRESS, 2)
        return F.when(F.contains(u, F.lit("/.")) & path.rlike(r"/\.\.?(/|$)"), resolved(u, path)).otherwise(u)

    return let(_text(address), one)


def absolute_url(href, base) -> Column:
    """``href`` as seen from ``base``: with a scheme, from the scheme, from the host's root, or from the folder; dots are resolved."""
    base = _text(base)
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))

    def one(h: Column) -> Column:
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(host, h))
            .otherwise(F.concat(folder, h))
        )

    return without_dots(let(_text(href), one))


def canonical_url(c) -> Column:
    """One form for addresses of the same page: host in lower case without ``www.`` or ``m.``, https, neither
    fragment nor tracking parameters nor trailing slashes. Anything but http(s) is returned as it is."""
    u = _text(c)
    whole = r"(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(u, whole, 1)), r"^(www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_extract(u, whole, 2), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(u, whole, 3), "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^({TRACKING})(=|$)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(u.rlike(whole), F.concat(F.lit("https://"), host, path, query)).otherwise(u)


def domain_of(c) -> Column:
    """Host without ``www.``, null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(_text(c), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:@]+)", 1)), r"^www\.", ""), F.lit(""))


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the characters, as a long."""
    chars = F.filter(F.split(_text(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def person_key(name, org) -> Column:
    """Sorted words of a name without titles, and the organisation: one key for both orders of a name."""
    plain = F.regexp_replace(norm_name(name), r"(^|[^a-z0-9_])(" + "|".join(TITLES) + ")(?=[^a-z0-9_]|$)", "$1")
    words = F.array_sort(F.filter(F.split(plain, " "), lambda w: w != ""))
    return F.concat(F.array_join(words, " "), F.lit("|"), _text(org).cast("string"))


def proposal_verdict(name, role, quote, document) -> Column:
    """Mechanical check of a quoted person against a normalised document."""
    name, role, quote = (F.trim(F.coalesce(_text(x), F.lit(""))) for x in (name, role, quote))
    return (
        F.when((name == "") | (quote == ""), "REJECTED_EMPTY")
        .when(~F.contains(_text(document), norm(quote)), "REJECTED_QUOTE_NOT_IN_DOCUMENT")
        .when(~F.contains(norm(quote), norm(name)), "REJECTED_NAME_NOT_IN_QUOTE")
        .when(role == "", "REJECTED_NO_ROLE")
        .when(F.size(F.split(name, r"\s+")) < 2, "REJECTED_SINGLE_TOKEN_NAME")
        .otherwise("VERIFIED")
    )


def iso_time(c) -> Column:
    """A date in any of the usual notations of feeds and APIs as a timestamp, null if it is none."""
    bare = F.regexp_replace(F.trim(_text(c)), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000")
    kinds = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy")
    return let(bare, lambda b: F.coalesce(F.try_to_timestamp(b), *[F.try_to_timestamp(b, F.lit(k)) for k in kinds]))
