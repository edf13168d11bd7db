"""Registered queries: text, terms, upserts, retention, score parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, terms, text, vectors
from ..operators import items as ops
from ..operators import score, sinks
from ..registry import register
from ..session import table
from . import fixture
from .fixture import NOW, SQL_CANON, with_items

LEX = terms.lexicon()
SPACES = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'), ' ')"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def sql_norm(x: str) -> str:
    x = f"coalesce({x}, '')"
    for char, form in text.EXPANDED.items():
        x = f"replace({x}, '{char}', '{form}')"
    x = f"lower(translate({x}, '{text.COMPATIBLE}', '{_quoted(text.COMPATIBLE_PLAIN)}'))"
    return sql_squeeze(f"translate({x}, '{text.QUOTES}', '{_quoted(text.QUOTES_PLAIN)}')")


def sql_name(x: str) -> str:
    return sql_squeeze(f"regexp_replace(translate({sql_norm(x)}, '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9'' -]', '', 'g')")


def sql_has(x: str, words, chars: str = "A-Za-z0-9_") -> str:
    return f"regexp_matches({x}, '{terms.bounded(words, chars)}')"


SQL_ENTITIES = "list_filter([" + ", ".join(f"CASE WHEN {sql_has('lower(coalesce(text, {0}))'.format(chr(39) * 2), (n, *a), terms.NAME_CHARS)} THEN '{n}' END" for n, _, a in LEX.entities) + "], lambda e: e IS NOT NULL)"
SQL_STOP = "[" + ", ".join(f"'{w}'" for w in LEX.stop) + "]"
SQL_TOKENS = f"list_filter(string_split({sql_name('text')}, ' '), lambda w: length(w) > 2 AND NOT list_contains({SQL_STOP}, w) AND NOT regexp_matches(w, '^[0-9]+$'))"
#: One row for each distinct term of a text.
SQL_TERMS = rf"""
tok AS (SELECT *, {SQL_ENTITIES} AS ents, {SQL_TOKENS} AS toks FROM items),
terms AS (
  SELECT item_id, source_id, family, first_seen_at, unnest(list_distinct(list_concat(list_transform(ents, lambda e: '@' || e),
         CASE WHEN len(toks) > 1 THEN list_transform(list_zip(toks[:-2], toks[2:]), lambda p: p[1] || ' ' || p[2]) ELSE [] END))) AS term FROM tok)
"""
#: Prior credibility by family; four per cents as twentieths keep sums exact.
SQL_PRIOR = "CASE family WHEN 'A' THEN 0.3 WHEN 'B' THEN 0.35 WHEN 'C' THEN 0.35 WHEN 'D' THEN 0.4 WHEN 'E' THEN 0.5 WHEN 'F' THEN 0.3 WHEN 'H' THEN 0.4 ELSE 0.3 END::DOUBLE"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, source_id, family, ts, term) of all whole texts."""
    return fixture.items(spark, sf_dir).select("item_id", "source_id", "family", F.col("first_seen_at").alias("ts"), F.explode(terms.terms(F.col("text"), LEX)).alias("term"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, ts, entity) of whole titles: pairs of entities are those of one title."""
    return fixture.items(spark, sf_dir).select("item_id", F.col("first_seen_at").alias("ts"), F.explode(terms.entities(F.col("title"), LEX)).alias("entity"))


# text


@register("u1_canonical_url", f"SELECT page_id, {SQL_CANON} AS url_canon FROM pages")
def canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url("url").alias("url_canon"))


@register("u7_domain", r"SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1)), '^www\.', ''), '') AS domain FROM pages")
def domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain_of("url").alias("domain"))


@register("t1_norm", with_items(f"SELECT item_id, {sql_norm('text')} AS norm FROM items"))
def norm(spark, sf_dir):
    return fixture.items(spark, sf_dir).select("item_id", text.norm("text").alias("norm"))


@register("t2_norm_name", with_items(f"SELECT item_id, {sql_name('text')} AS name FROM items"))
def norm_name(spark, sf_dir):
    return fixture.items(spark, sf_dir).select("item_id", text.norm_name("text").alias("name"))


def _sql_html() -> str:
    h = "html"
    for t in text.SILENT:
        h = f"regexp_replace({h}, '{text.whole_element(t)}', ' ', 'g')"
    h = f"regexp_replace({h}, '{text.COMMENT}', ' ', 'g')"
    h = f"regexp_replace({h}, '{text.LINE_END}', chr(10), 'g')"
    h = f"regexp_replace({h}, '{text.TAG}', ' ', 'g')"
    return _sql_entities(h)


def _sql_entities(h: str) -> str:
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        h = f"replace({h}, '{a}', '{b}')"
    return h


@register("t3_html_to_text", f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_sql_html()}, chr(10)), lambda x: {sql_squeeze('x')}), lambda x: x <> ''), chr(10)) AS body FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("body"))


def _sql_attribute(x: str, name: str) -> str:
    return " || ".join(f"regexp_extract({x}, '{_quoted(text.attribute_value(name))}', {g})" for g in (1, 2))


_SCHEME, _HOST = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)", "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_SQL_ABSOLUTE = rf"""CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN {_SCHEME} || ':' || h WHEN starts_with(h, '/') THEN {_HOST} || h
    ELSE {_HOST} || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || h END"""
_DOTS = f"""CASE WHEN regexp_matches(regexp_extract(u, '{text.ADDRESS}', 2), '/\\.\\.?(/|$)') THEN regexp_extract(u, '{text.ADDRESS}', 1) || '/' || array_to_string(list_reduce(
    string_split(substr(regexp_extract(u, '{text.ADDRESS}', 2), 2), '/'), lambda o, x: CASE WHEN x = '.' THEN o WHEN x = '..' THEN o[:-2] ELSE list_append(o, x) END, []::VARCHAR[]), '/')
    || CASE WHEN regexp_matches(regexp_extract(u, '{text.ADDRESS}', 2), '/\\.\\.?$') THEN '/' ELSE '' END || regexp_extract(u, '{text.ADDRESS}', 3) ELSE u END"""


@register(
    "t4_extract_links",
    f"""WITH a AS (SELECT page_id, url, list_filter(list_transform(list_zip(regexp_extract_all(html, '{text.ANCHOR}', 1), regexp_extract_all(html, '{text.ANCHOR}', 2)), lambda z: [{_sql_attribute('z[1]', 'href')}, z[2]]), lambda z: z[1] <> '' AND NOT contains(z[1], '#')) AS hs,
                      list_filter(regexp_extract_all(html, '{text.LINK}', 1), lambda x: list_contains({list(text.FEEDS)}, lower({_sql_attribute('x', 'type')})) AND {_sql_attribute('x', 'href')} <> '') AS fs FROM pages),
        e AS (SELECT page_id, url, i - 1 AS pos, hs[i][1] AS h, {sql_squeeze(_sql_entities(f"regexp_replace(hs[i][2], '{text.TAG}', ' ', 'g')"))} AS label, false AS feed FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM a)
              UNION ALL SELECT page_id, url, len(hs) + i - 1, {_sql_attribute('fs[i]', 'href')}, 'RSS', true FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM a)),
        x AS (SELECT *, {_SQL_ABSOLUTE} AS u FROM e)
        SELECT page_id, CAST(pos AS INTEGER) AS pos, {_DOTS} AS href, label, feed FROM x""",
)
def links(spark, sf_dir):
    e = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.extract_links("html", "url")).alias("pos", "x"))
    return e.select("page_id", "pos", F.col("x.href").alias("href"), F.col("x.text").alias("label"), F.col("x.feed").alias("feed"))


_FIRST, _LAST = "['Anna', 'Zoé', 'Émile', 'Bob'][CAST(c_custkey % 4 + 1 AS INTEGER)]", "'Smith' || c_custkey % 50"


@register("t5_person_keys", f"SELECT c_custkey, array_to_string(list_sort([lower(strip_accents({_FIRST})), lower({_LAST})]), ' ') || '|' || c_nationkey AS person FROM customer")
def person_keys(spark, sf_dir):
    """Customers as persons, with titles and in both orders of their names."""
    first, last = F.element_at(F.array(*map(F.lit, ("Anna", "Zoé", "Émile", "Bob"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.concat(F.lit("Smith"), (F.col("c_custkey") % 50).cast("string"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Dr. "), first, F.lit(" "), last)).otherwise(F.concat(last, F.lit(", "), first, F.lit(" PhD")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.person_key(name, F.col("c_nationkey")).alias("person"))


@register(
    "t5_proposals",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'REJECTED_EMPTY' WHEN c_custkey % 7 = 1 THEN 'REJECTED_QUOTE_NOT_IN_DOCUMENT' WHEN c_custkey % 7 = 2 THEN 'REJECTED_NAME_NOT_IN_QUOTE' WHEN c_custkey % 7 = 3 THEN 'REJECTED_NO_ROLE' WHEN c_custkey % 7 = 4 THEN 'REJECTED_SINGLE_TOKEN_NAME' ELSE 'VERIFIED' END AS verdict FROM customer",
)
def proposals(spark, sf_dir):
    """Proposals about customers of every kind that is rejected, and sound ones."""
    k = F.col("c_custkey") % 7
    name = F.when(k == 4, F.lit("Smith")).otherwise(F.concat(F.lit("Anna Smith"), F.col("c_custkey").cast("string")))
    quote = F.when(k == 1, F.lit("never said")).when(k == 2, F.lit("heads the lab")).otherwise(F.concat(name, F.lit("  HEADS the lab")))
    document = text.norm(F.concat(F.lit("We hear that "), name, F.lit(" heads the lab, says "), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.proposal_verdict(name, F.when(k != 3, "head"), F.when(k != 0, quote), document).alias("verdict"))


@register("t6_item_set_hash", with_items("SELECT source_id, sha1(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS item_set FROM items GROUP BY source_id"))
def item_set(spark, sf_dir):
    ids = F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",")
    return fixture.items(spark, sf_dir).groupBy("source_id").agg(F.sha1(ids.cast("binary")).alias("item_set"))


@register("t7_fnv1a", with_items(f"SELECT item_id, list_reduce(string_split(n, ''), lambda h, c: (xor(h, ascii(c)::BIGINT) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM (SELECT item_id, {sql_name('title')} AS n FROM items) WHERE n <> ''"))
def fnv(spark, sf_dir):
    name = text.norm_name("title")
    return fixture.items(spark, sf_dir).where(name != "").select("item_id", text.fnv1a(name).alias("h"))


# terms


@register("r1_relevance", with_items(f"SELECT item_id, starts_with(source_id, 'src1') OR {sql_has(chr(108) + 'ower(coalesce(title, {0}) || {1} || substr(coalesce(text, {0}), 1, 300))'.format(chr(39) * 2, chr(39) + ' ' + chr(39)), LEX.keywords)} AS relevant FROM items"))
def relevance(spark, sf_dir):
    return fixture.items(spark, sf_dir).select("item_id", terms.relevant(F.col("source_id"), F.col("title"), F.col("text"), LEX).alias("relevant"))


@register("r2_entities", with_items(f"SELECT item_id, array_to_string({SQL_ENTITIES}, ',') AS entities FROM items"))
def entities(spark, sf_dir):
    return fixture.items(spark, sf_dir).select("item_id", F.array_join(terms.entities(F.col("text"), LEX), ",").alias("entities"))


@register("r3_terms", with_items("SELECT term, count(*) AS n, count(DISTINCT source_id) AS sources FROM terms GROUP BY term", SQL_TERMS))
def term_counts(spark, sf_dir):
    # sets of sources go with their terms: counting distinct ones would shuffle each source of each term, then each term
    return mentions(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n"), F.size(F.collect_set("source_id")).cast("long").alias("sources"))


_NEVER = "[" + ", ".join(f"'{w}'" for w in sorted({*LEX.stop, *LEX.generic})) + "]"


@register(
    "r4_proper_nouns",
    with_items(
        f"""SELECT noun, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(list_concat(names, list_filter(list_transform(list_zip(names[:-2], names[2:]), lambda p: p[1] || ' ' || p[2]), lambda x: x IS NOT NULL)))) AS noun
            FROM (SELECT item_id, list_transform(w, lambda x: CASE WHEN length(x) >= 3 AND (regexp_matches(x, '^[A-Z]') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AND NOT regexp_matches(x, '{terms.SIZE}')
                    AND NOT list_contains({_NEVER}, lower(x)) AND (NOT shouted OR regexp_matches(x, '{terms.MODEL_LIKE}') OR NOT regexp_matches(x, '[a-z]')) THEN x END) AS names
                  FROM (SELECT *, len(st) >= 4 AND 10 * len(list_filter(st, lambda x: regexp_matches(x, '^[A-Z]'))) >= 6 * len(st) AS shouted
                        FROM (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]')) AS st FROM (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{terms.TITLE_WORD}') AS w FROM items)))))
            WHERE noun IS NOT NULL GROUP BY noun"""
    ),
)
def proper(spark, sf_dir):
    return fixture.items(spark, sf_dir).select("item_id", F.explode(terms.proper_nouns(F.col("text"), LEX)).alias("noun")).groupBy("noun").agg(F.count("*").alias("n"))


@register(
    "r6_r8_item_columns",
    with_items(
        """SELECT item_id, evt_at, CASE WHEN kind IN ('PAPER', 'REPO', 'MODEL', 'DATASET', 'SPACE', 'MODEL_LISTED', 'RELEASE', 'MARKET', 'TREND') THEN 0.74 ELSE 0.62 END::DOUBLE AS thr,
           trim(CASE WHEN coalesce(substr(text, 1, 200), '') = '' OR starts_with(lower(substr(text, 1, 200)), lower(substr(title, 1, 40))) THEN title ELSE title || '. ' || substr(text, 1, 200) END, ' ') AS body FROM items"""
    ),
)
def item_columns(spark, sf_dir):
    i = fixture.items(spark, sf_dir)
    return i.select("item_id", "evt_at", terms.join_threshold(F.col("kind")).alias("thr"), terms.cluster_text(F.col("title"), F.col("text")).alias("body"))


# upserts and retention: half of the items are known since day 20, a third comes again on day 29

_OLD, _BATCH = "TIMESTAMP '2024-01-20 00:00:00'", "TIMESTAMP '2024-01-29 00:00:00'"


def _existing(i: DataFrame) -> DataFrame:
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return i.where("item_id % 2 = 0").select(
        "source_id", "external_id", "family", "kind", "url", "url_canon", "title", "text", "published_at", F.col("first_seen_at"), at.alias("last_seen_at"), "score_raw", "comments"
    )


def _batch(i: DataFrame) -> DataFrame:
    return i.where("item_id % 3 = 0").select(
        "source_id", "external_id", "family", "kind", "url", F.when(F.col("item_id") % 9 == 0, "").otherwise(F.concat(F.lit("new "), "title")).alias("title"), "text", "published_at",
        F.when(F.col("item_id") % 2 == 0, F.col("score_raw") + 1).alias("score_raw"), F.lit(None).cast("long").alias("comments"), F.col("item_id").alias("batch_pos"), (F.col("item_id") % 4).cast("int").alias("rank"),
    )


@register(
    "u2_upsert",
    with_items(
        f"""SELECT coalesce(e.source_id, b.source_id) AS source_id, coalesce(e.external_id, b.external_id) AS external_id,
               CASE WHEN e.item_id IS NULL THEN substr(b.t, 1, 500) ELSE coalesce(nullif(b.t, ''), e.title) END AS title, coalesce(e.first_seen_at, {_BATCH}) AS first_seen_at,
               CASE WHEN b.item_id IS NULL THEN {_OLD} ELSE {_BATCH} END AS last_seen_at, coalesce(b.s, e.score_raw) AS score_raw, e.comments AS comments, coalesce(e.url_canon, b.url_canon) AS url_canon
            FROM (SELECT * FROM items WHERE item_id % 2 = 0) e FULL JOIN
                 (SELECT *, 'new ' || title AS t, CASE WHEN item_id % 2 = 0 THEN score_raw + 1 END AS s FROM items
                  WHERE item_id % 3 = 0 AND item_id % 9 <> 0 AND title IS NOT NULL AND (item_id % 2 = 0 OR family IN ('E', 'H') OR published_at >= {_BATCH} - INTERVAL 14 DAY)) b ON e.item_id = b.item_id"""
    ),
)
def upsert(spark, sf_dir):
    i = fixture.items(spark, sf_dir)
    out = ops.upsert(_existing(i), _batch(i), "2024-01-29 00:00:00")
    return out.select("source_id", "external_id", "title", "first_seen_at", "last_seen_at", "score_raw", "comments", "url_canon")


@register(
    "u3_score_snapshots",
    with_items(
        f"""SELECT source_id, external_id, {_BATCH} AS ts, CASE WHEN item_id % 2 = 0 THEN score_raw + 1 END AS score_raw, CAST(item_id % 4 AS INTEGER) AS rank FROM items
            WHERE item_id % 3 = 0 AND (item_id % 2 = 0 OR item_id % 4 <> 0) AND item_id % 5 <> 0"""
    ),
)
def snapshots(spark, sf_dir):
    i = fixture.items(spark, sf_dir)
    b = _batch(i)
    taken = b.where("batch_pos % 5 = 0").select("source_id", "external_id", F.lit("2024-01-29 00:00:00").cast("timestamp").alias("ts"))
    return ops.snapshots(b, taken, "2024-01-29 00:00:00").drop("comments")


@register(
    "u4_median_latency",
    with_items(
        f"""SELECT source_id, CAST(floor(m[CAST(least(len(m) - 1, floor(0.5 * len(m))) AS INTEGER) + 1] + 0.5) AS BIGINT) AS latency_min
            FROM (SELECT source_id, list_sort(list((epoch_us(TIMESTAMP '{NOW}') - epoch_us(published_at)) / 3.6e9::DOUBLE * 60)) AS m FROM items GROUP BY source_id)"""
    ),
)
def latency(spark, sf_dir):
    return ops.median_latency(fixture.items(spark, sf_dir), NOW)


def _runs(spark, sf_dir):
    e = fixture.events(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
        F.col("event_type").alias("error"), F.lit(0).alias("n_items"), F.lit(0).alias("latency_min"),
    )


_SQL_RUNS = "runs AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS run_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, event_type AS error FROM events)"


@register(
    "u5_due_sources",
    f"""WITH {_SQL_RUNS}, s AS (SELECT DISTINCT source_id, 60 * (1 + CAST(source_id AS BIGINT) % 48) AS every_min FROM runs),
        l AS (SELECT source_id, max(started_at) AS last_ok FROM runs WHERE status = 'OK' GROUP BY 1)
        SELECT s.source_id, every_min, last_ok FROM s LEFT JOIN l USING (source_id) WHERE last_ok IS NULL OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_ok)) / 3.6e9::DOUBLE * 60 >= every_min - 2""",
)
def due(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    sources = runs.select("source_id", (60 * (1 + F.col("source_id").cast("long") % 48)).alias("every_min")).distinct()
    return ops.due(sources, runs, NOW)


@register("u6_last_runs", f"WITH {_SQL_RUNS} SELECT source_id, started_at, status, error FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS k FROM runs) WHERE k = 1")
def last_runs(spark, sf_dir):
    return ops.last_runs(_runs(spark, sf_dir)).select("source_id", "started_at", "status", "error")


@register(
    "u8_purge_items",
    with_items(f"SELECT item_id FROM items WHERE CASE WHEN family IN ('E', 'H') OR published_at IS NULL THEN first_seen_at ELSE published_at END >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY"),
)
def purge(spark, sf_dir):
    return ops.purge_items(fixture.items(spark, sf_dir).withColumn("last_seen_at", F.col("first_seen_at")), NOW).select("item_id")


@register(
    "u8_purge_scores",
    f"""SELECT user_id AS cluster_id, event_id, ts AS computed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
        WHERE k = 1 OR ts >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR""",
)
def purge_scores(spark, sf_dir):
    # one score for each topic and time, so that the latest is one row
    e = fixture.events(spark, sf_dir).select(F.col("user_id").alias("cluster_id"), "event_id", F.col("ts").alias("computed_at"))
    return ops.purge_scores(e, NOW)


@register(
    "u8_purge_vectors",
    with_items(f"SELECT item_id FROM items WHERE first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 4 DAY AND item_id % 7 <> 0"),
)
def purge_vectors(spark, sf_dir):
    i = fixture.items(spark, sf_dir)
    v = i.select("item_id", F.col("first_seen_at").alias("created_at"))
    return ops.purge_vectors(v, i.where("item_id % 7 <> 0"), NOW).select("item_id")


@register(
    "u12_latest_items",
    with_items(f"SELECT item_id, title, first_seen_at FROM items WHERE first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND first_seen_at <= TIMESTAMP '{NOW}' ORDER BY first_seen_at DESC, item_id DESC LIMIT 600"),
)
def latest(spark, sf_dir):
    return sinks.latest_items(fixture.items(spark, sf_dir), NOW).select("item_id", "title", "first_seen_at")


@register(
    "u13_status",
    with_items(
        f"""SELECT family, source_id, count(*) AS n, count(*) FILTER (first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS n_24h, min(first_seen_at) AS first_at, max(first_seen_at) AS last_at
            FROM items GROUP BY family, source_id"""
    ),
)
def status(spark, sf_dir):
    return ops.status(fixture.items(spark, sf_dir), NOW)


# bursts and score parts

BURST_NOW = "2024-01-23 12:00:00"
_SQL_HOURS = f"date_diff('hour', date_trunc('hour', ts), TIMESTAMP '{BURST_NOW}')"
_DAYS = ", ".join(f"coalesce(sum(n) FILTER (ago // 24 = {d}), 0) AS d{d}" for d in range(8))
_BASE = " + ".join(f"d{d}" for d in range(1, 8))
_SQUARES = " + ".join(f"d{d} * d{d}" for d in range(1, 8))


def sql_burst(key: str) -> str:
    return f"""h AS (SELECT {key} AS term, {_SQL_HOURS} AS ago, count(*)::BIGINT AS n FROM events WHERE ts <= TIMESTAMP '{BURST_NOW}' GROUP BY 1, 2),
        d AS (SELECT term, {_DAYS} FROM h WHERE ago >= 0 AND ago % 24 < 6 AND ago < 174 GROUP BY term),
        m AS (SELECT term, CAST(d0 AS BIGINT) AS cur, CAST({_BASE} AS BIGINT) / 7.0::DOUBLE AS mean, sqrt(CAST(7 * ({_SQUARES}) - ({_BASE}) * ({_BASE}) AS DOUBLE)) / 7.0::DOUBLE AS sd FROM d),
        burst AS (SELECT *, (cur - mean) / greatest(sd, sqrt(mean), 1.0::DOUBLE) AS z FROM m)"""


@register("b1_term_hourly", f"SELECT event_type AS term, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{BURST_NOW}' - INTERVAL 173 HOUR AND ts <= TIMESTAMP '{BURST_NOW}' GROUP BY 1, 2")
def hourly(spark, sf_dir):
    return score.term_hourly(fixture.events(spark, sf_dir).select(F.col("event_type").alias("term"), "ts"), BURST_NOW)


@register("b2_term_burst", f"WITH {sql_burst('event_type')} SELECT * FROM burst")
def burst(spark, sf_dir):
    return score.term_burst(score.term_hourly(fixture.events(spark, sf_dir).select(F.col("event_type").alias("term"), "ts"), BURST_NOW), BURST_NOW)


@register("b2_user_burst", f"WITH {sql_burst('user_id')} SELECT * FROM burst")
def user_burst(spark, sf_dir):
    return score.term_burst(score.term_hourly(fixture.events(spark, sf_dir).select(F.col("user_id").alias("term"), "ts"), BURST_NOW), BURST_NOW)


_SQL_LAST_DAY = "event_type || '/' || CAST(day(ts) // 23 AS VARCHAR)"


@register(
    "b3_topic_burst",
    f"""WITH {sql_burst(_SQL_LAST_DAY)},
        f AS (SELECT user_id AS cluster_id, {_SQL_LAST_DAY} AS term, count(*) AS n FROM events GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS k FROM f)
        SELECT cluster_id, term AS burst_term, z FROM (SELECT r.cluster_id, term, z, row_number() OVER (PARTITION BY r.cluster_id ORDER BY z DESC, term DESC) AS b FROM r JOIN burst USING (term) WHERE k <= 8 AND cur >= 5 AND cur >= 2 * mean) WHERE b = 1""",
)
def topic_burst(spark, sf_dir):
    """Terms that are new on the last day, so that they burst."""
    term = F.concat("event_type", F.lit("/"), F.expr("day(ts) div 23").cast("string"))
    e = fixture.events(spark, sf_dir).select(F.col("user_id").alias("cluster_id"), term.alias("term"), "ts")
    return score.topic_bursts(e, score.term_burst(score.term_hourly(e.select("term", "ts"), BURST_NOW), BURST_NOW))


def members(spark, sf_dir) -> DataFrame:
    """Items in topics of one in a hundred, each seen last an hour after its first sight."""
    i = fixture.items(spark, sf_dir)
    return i.withColumns({"cluster_id": F.col("item_id") % 100, "last_seen_at": F.col("first_seen_at") + F.expr("INTERVAL 1 HOUR"), "major": F.col("source_id").isin("src5", "src13")})


SQL_MEMBERS = "mem AS (SELECT *, item_id % 100 AS cluster_id, first_seen_at + INTERVAL 1 HOUR AS last_seen_at, source_id IN ('src5', 'src13') AS major FROM items)"
_T = f"TIMESTAMP '{NOW}'"
SQL_PARTS = f"""{SQL_MEMBERS},
parts AS (
  SELECT cluster_id, count(*) AS n_items,
    list_sort(list(DISTINCT family) FILTER (family <> 'G' AND (evt_at >= {_T} - INTERVAL 6 HOUR OR last_seen_at >= {_T} - INTERVAL 6 HOUR))) AS families_6h,
    coalesce(max(score_raw / least(greatest((epoch_us({_T}) - epoch_us(evt_at)) / 3.6e9::DOUBLE, 0.5), 24.0)) FILTER (family = 'A'), 0.0) AS hn,
    coalesce(max(score_raw) FILTER (kind = 'PAPER'), 0) AS upvotes, bool_or(kind = 'TREND') AS trending, bool_or(family = 'F' AND major AND evt_at >= {_T} - INTERVAL 24 HOUR) AS official,
    count(*) FILTER (family = 'D' AND evt_at >= {_T} - INTERVAL 6 HOUR) AS social_6h, max(evt_at) AS last_at, min(evt_at) FILTER (family <> 'G') AS first_other, min(evt_at) FILTER (family = 'G') AS first_press,
    count(*) FILTER (family = 'G') AS n_press, count(*) FILTER (evt_at >= {_T} - INTERVAL 3 HOUR) AS last_3h, count(*) FILTER (evt_at >= {_T} - INTERVAL 6 HOUR AND evt_at < {_T} - INTERVAL 3 HOUR) AS before_3h
  FROM mem WHERE evt_at <= {_T} GROUP BY cluster_id HAVING max(evt_at) >= {_T} - INTERVAL 72 HOUR)"""


@register("b4_b10_components", with_items("SELECT cluster_id, n_items, coalesce(array_to_string(families_6h, ','), '') AS families_6h, hn, upvotes, trending, official, social_6h, last_at, first_other, first_press, n_press, last_3h, before_3h FROM parts", SQL_PARTS))
def components(spark, sf_dir):
    return score.components(members(spark, sf_dir), NOW).withColumn("families_6h", F.array_join("families_6h", ","))


@register(
    "b6_star_deltas",
    f"""WITH s AS (SELECT user_id AS key, ts, event_id FROM events WHERE ts <= {_T}),
        l AS (SELECT key, arg_max(event_id, (ts, event_id)) AS last, arg_min(event_id, (ts, event_id)) FILTER (ts >= {_T} - INTERVAL 24 HOUR) AS near, arg_min(event_id, (ts, event_id)) AS first FROM s GROUP BY key)
        SELECT key, last - coalesce(near, first) AS stars_delta FROM l""",
)
def stars(spark, sf_dir):
    e = fixture.events(spark, sf_dir).where(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    return score.star_deltas(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("score")), NOW)


@register(
    "b10_sparkline",
    with_items(
        f"""SELECT cluster_id, array_to_string(list_transform(range(0, 24), lambda i: len(list_filter(a, lambda x: x = 23 - i))), ',') AS hours
            FROM (SELECT cluster_id, list(date_diff('hour', date_trunc('hour', evt_at), date_trunc('hour', {_T}))) AS a FROM mem GROUP BY 1) WHERE len(list_filter(a, lambda x: x BETWEEN 0 AND 23)) > 0""",
        SQL_MEMBERS,
    ),
)
def sparkline(spark, sf_dir):
    return score.sparkline(members(spark, sf_dir), NOW).select("cluster_id", F.array_join(F.transform("hours", lambda x: x.cast("string")), ",").alias("hours"))


def _c(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


#: Bursts and stars of topics from the events, for two thirds of them each.
SQL_SCORED = f"""{SQL_PARTS},
extra AS (SELECT user_id % 100 AS cluster_id, CASE WHEN user_id % 100 % 3 > 0 THEN max(event_id) % 90 / 10.0::DOUBLE END AS z, CASE WHEN user_id % 100 % 3 < 2 THEN max(event_id) % 700 END AS stars FROM events GROUP BY user_id % 100),
raw_score AS (
  SELECT *, 25 * {_c('(len(families_6h) - 1) / 2.0::DOUBLE')} + 20 * {_c('coalesce(z, 0.0) / 6.0::DOUBLE')} + 15 * {_c('hn / 10.0::DOUBLE')} + 10 * {_c('coalesce(stars, 0) / 500.0::DOUBLE')}
     + 10 * greatest({_c('upvotes / 20.0::DOUBLE')}, CASE WHEN trending THEN 0.5 ELSE 0.0 END::DOUBLE) + CASE WHEN official THEN 10.0 ELSE 0.0 END::DOUBLE + 10 * {_c('social_6h / 20.0::DOUBLE')} AS raw,
     (epoch_us({_T}) - epoch_us(last_at)) / 3.6e9::DOUBLE AS age FROM (SELECT * REPLACE (coalesce(families_6h, []) AS families_6h) FROM parts LEFT JOIN extra USING (cluster_id))),
scored AS (
  SELECT *, CASE WHEN n_items < 2 AND NOT (official OR hn >= 3 OR upvotes >= 10 OR len(families_6h) >= 2 OR coalesce(z, 0) >= 3 OR coalesce(stars, 0) >= 100) THEN least(raw, 15.0::DOUBLE) ELSE raw END
            * CASE WHEN age <= 6 THEN 1.0::DOUBLE ELSE greatest(0.4::DOUBLE, 1 - 0.6::DOUBLE * (age - 6) / 42) END AS score,
     CASE WHEN n_press = n_items THEN 'PRESS_ONLY' WHEN n_press >= 3 THEN 'CONFIRMED' WHEN n_press >= 1 THEN 'LIGHT_PRESS' ELSE 'ANTICIPATION' END AS status, coalesce(first_press < first_other, false) AS press_first FROM raw_score)"""


def scored(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("cluster_id")).agg(F.max("event_id").alias("m"))
    third = F.col("cluster_id") % 3
    extra = e.select("cluster_id", F.when(third > 0, F.col("m") % 90 / 10.0).alias("z"), F.when(third < 2, F.col("m") % 700).alias("stars_delta"))
    return score.score(score.components(members(spark, sf_dir), NOW).join(extra, "cluster_id", "left"), NOW)


@register("b8_b9_score", with_items("SELECT cluster_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_e6, status, press_first FROM scored", SQL_SCORED))
def topic_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("cluster_id", F.floor(F.col("score") * 1e6 + 0.5).alias("score_e6"), "status", "press_first")


@register("b11_ranked_topics", with_items("SELECT cluster_id, status, CAST(row_number() OVER (ORDER BY score DESC, cluster_id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, cluster_id LIMIT 20", SQL_SCORED))
def ranked(spark, sf_dir):
    return score.ranked(scored(spark, sf_dir), 20).select("cluster_id", "status", "rank")


@register(
    "u11_topic_json",
    with_items(
        """SELECT cluster_id, CAST(to_json({'cluster_id': cluster_id, 'score': score, 'status': status, 'press_first': press_first}) AS VARCHAR) AS json
           FROM (SELECT cluster_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score, status, press_first FROM scored) ORDER BY score DESC, cluster_id LIMIT 60""",
        SQL_SCORED,
    ),
)
def topic_json(spark, sf_dir):
    return sinks.topic_json(scored(spark, sf_dir).select("cluster_id", F.floor(F.col("score") * 1e6 + 0.5).alias("score"), "status", "press_first"))


def _sql_escaped(x: str) -> str:
    return f"replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@register(
    "u12_rss",
    with_items(
        f"""SELECT cluster_id, '<item><title>' || {_sql_escaped('label')} || '</title><link>' || {_sql_escaped('url')} || '</link><guid>topic-' || cluster_id || '</guid><pubDate>' || strftime(seen, '%Y-%m-%dT%H:%M:%SZ') || '</pubDate></item>' AS xml
            FROM (SELECT cluster_id, score FROM scored ORDER BY score DESC, cluster_id LIMIT 25)
            JOIN (SELECT item_id % 100 AS cluster_id, arg_min(title, item_id) AS label, arg_min(url, item_id) AS url, min(first_seen_at) AS seen FROM items GROUP BY 1) USING (cluster_id)""",
        SQL_SCORED,
    ),
)
def rss(spark, sf_dir):
    m = members(spark, sf_dir).groupBy("cluster_id").agg(F.min_by("title", "item_id").alias("label"), F.min_by("url", "item_id").alias("url"), F.min("first_seen_at").alias("first_seen_at"))
    return sinks.rss_items(scored(spark, sf_dir).select("cluster_id", "score").join(m, "cluster_id"))


# statistics


@register(
    "a4_percentile",
    "SELECT user_id, v[CAST(least(len(v) - 1, floor(0.95 * len(v))) AS INTEGER) + 1] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)",
)
def percentile(spark, sf_dir):
    return stats.percentile_by(table(spark, sf_dir, "events"), ["user_id"], "value", 0.95, "p95")


@register("a6_poisson_tail", "SELECT user_id, CAST(floor(greatest(0.0, 1 - exp(-mu) * (1 + mu + mu * mu / 2)) * 1e9 + 0.5) AS BIGINT) AS p_e9 FROM (SELECT user_id, count(*) / 50.0::DOUBLE AS mu FROM events GROUP BY 1)")
def poisson(spark, sf_dir):
    mu = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") / 50.0).alias("mu"))
    return mu.select("user_id", F.floor(stats.poisson_tail3(F.col("mu")) * 1e9 + 0.5).alias("p_e9"))


@register("c1_hash_vectors", with_items(
    f"""SELECT item_id, bucket, CAST(sum(x) AS BIGINT) AS x FROM (
          SELECT item_id, h % 512 AS bucket, CASE WHEN (h >> 31) = 1 THEN 1 ELSE -1 END AS x FROM (
            SELECT item_id, list_reduce(list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM (
              SELECT item_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || '_' || p[2]) ELSE [] END)) AS g FROM (
                SELECT item_id, list_filter(string_split({sql_name('text')}, ' '), lambda t: t <> '') AS w FROM items))))
        GROUP BY 1, 2 HAVING sum(x) <> 0"""))
def hash_vectors(spark, sf_dir):
    return vectors.sparse_vectors(fixture.items(spark, sf_dir), "item_id", F.col("text"))


@register("c2_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, CAST(floor(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) * 1e6 + 0.5) AS BIGINT) AS cos_e6 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    j = e.alias("x").join(e.alias("y"), F.col("y.vec_id") == F.col("x.vec_id") + 1)
    return j.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), F.floor(vectors.dot(F.col("x.embedding"), F.col("y.embedding")) * 1e6 + 0.5).alias("cos_e6"))


@register("c3_quantised", "SELECT vec_id, top / 127 AS scale, CAST(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE / (top / 127) + 0.5)::BIGINT)) AS BIGINT) AS q_sum FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS top FROM embeddings)")
def quantised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantise(F.col("embedding")).alias("p"))
    return e.select("vec_id", F.col("p.scale").alias("scale"), F.aggregate("p.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"))
