"""Registered queries: parsers over response bodies that are made from the events, and over pages and orders.

A body holds the records of ``PER_BODY`` events, as a service would send them: with fields that are missing now and
then, records that don't count, and texts with markup. The SQL says from the events themselves what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import weak
from ..registry import register
from ..session import table
from ..sources import catalogs, parsers

PER_BODY = 25
FEED_URL = "https://feed.example.com/x/feed.xml"
#: The events for both: times in whole seconds, and their ISO form.
BASE = dict(id="event_id", u="user_id", t="event_type", sec="unix_seconds(cast(ts as timestamp))", iso="date_format(timestamp_seconds(unix_seconds(cast(ts as timestamp))), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", batch="event_id div 25")
SQL_BASE = "e AS (SELECT event_id AS id, user_id AS u, event_type AS t, date_trunc('second', ts) AS tm, strftime(ts, '%Y-%m-%d') AS d, event_id // 25 AS batch FROM events)"

_TITLE = "concat(element_at(array('Show HN: ', 'Ask HN: ', 'Launch HN: ', ''), cast(id % 4 + 1 as int)), t, ' ', u)"
_SQL_TITLE = "['Show HN: ', 'Ask HN: ', 'Launch HN: ', ''][CAST(id % 4 + 1 AS INTEGER)] || t || ' ' || u"
_HUB = "named_struct('id', concat('org', u, '/m', id), 'author', if(id % 2 = 0, null, concat('a', u)), 'pipeline_tag', if(id % 4 = 0, null, t), 'tags', transform(sequence(1, cast(id % 15 + 1 as int)), i -> concat('t', i)), 'lastModified', if(id % 5 = 0, null, iso), 'createdAt', iso, 'trendingScore', if(id % 4 = 1, null, id % 50), 'likes', id % 90, 'downloads', id)"
_POST = "named_struct('uri', concat('at://d/p/', id), 'author', if(id % 8 = 0, null, named_struct('handle', concat('h', u))), 'record', named_struct('text', concat('hi  ', t, '\\n', u), 'createdAt', iso), 'likeCount', if(id % 3 = 0, null, id % 20), 'repostCount', id % 7, 'replyCount', if(id % 5 = 0, null, id % 4))"
_TREND = "named_struct('topic', if(id % 3 = 0, null, concat('x', id)), 'displayName', concat('X ', t, id), 'link', if(id % 4 = 0, null, concat('/t/', id)), 'category', if(id % 2 = 0, null, t), 'startedAt', iso, 'postCount', id % 60)"
_FEED_TITLE = "concat('<title>A &amp;amp; ', t, ' &#', id % 26 + 65, ';</title>')"
_FEED = f"""CASE batch % 3 WHEN 0 THEN concat('<item>', {_FEED_TITLE}, '<link>/p/', id, '</link><guid>g', id, '</guid><pubDate>', date_format(timestamp_seconds(sec), 'EEE, d MMM yyyy HH:mm:ss'), ' GMT</pubDate><description><![CDATA[<p>Some <b>', t, '</b></p>]]></description><dc:creator>c', u, '</dc:creator></item>')
    WHEN 1 THEN concat('<entry><id>tag:', id, '</id>', {_FEED_TITLE}, '<link rel="alternate" href="../q?', id, '"/><updated>', iso, '</updated><summary>S ', t, '</summary><author><name>N', u, '</name></author></entry>')
    ELSE concat('<item rdf:about="https://b.example.com/', id, '">', {_FEED_TITLE}, '<dc:date>', iso, '</dc:date><description>D</description></item>') END"""

#: By type of source: one event's record, and what stands before and after the records of a body; a fourth value says that no
#: commas stand between records.
RECORDS = {
    "hn_top": (f"to_json(named_struct('id', id, 'type', if(t = 'click', 'comment', 'story'), 'title', {_TITLE}, 'url', if(id % 3 = 0, null, concat('https://e.example.com/', id)), 'text', concat('<b>t</b> ', u), 'by', concat('u', u), 'time', sec, 'score', if(id % 5 = 0, null, id % 300), 'descendants', if(id % 7 = 0, null, id % 40), 'dead', if(id % 11 = 0, true, null), 'deleted', if(id % 13 = 0, true, null)))", "'['", "']'"),
    "hn_algolia": ("to_json(named_struct('objectID', cast(id as string), 'title', if(id % 6 = 0, null, t), 'url', if(id % 2 = 0, '', concat('https://e.example.com/', id)), 'story_text', concat('<i>', t, '</i>'), 'author', concat('u', u), 'created_at', iso, 'points', if(id % 5 = 0, null, id % 70), 'num_comments', id % 9))", "'{\"hits\": ['", "']}'"),
    "hf_models": (f"if(id % 3 = 0, to_json({_HUB}), null)", "'['", "']'"),
    "hf_datasets": (f"if(id % 3 = 1, to_json({_HUB}), null)", "'['", "']'"),
    "hf_spaces": (f"if(id % 3 = 2, to_json({_HUB}), null)", "'['", "']'"),
    "hf_papers": ("to_json(named_struct('paper', named_struct('id', concat('24.', id), 'title', if(id % 5 = 0, null, concat('P', id)), 'summary', t, 'authors', transform(sequence(1, 4), i -> named_struct('name', concat('A', i, u))), 'upvotes', if(id % 4 = 0, null, id % 30)), 'title', concat('Q', id), 'publishedAt', iso, 'upvotes', id % 3, 'numComments', if(id % 2 = 0, null, id % 6)))", "'['", "']'"),
    "openrouter": ("to_json(named_struct('id', concat('v', u, '/m', id), 'name', if(id % 3 = 0, null, concat('M', id)), 'description', if(id % 2 = 0, null, t), 'created', sec))", "'{\"data\": ['", "']}'"),
    "github_search": ("to_json(named_struct('id', id, 'html_url', concat('https://github.com/o/r', id), 'full_name', concat('o/r', id), 'description', if(id % 3 = 0, null, concat('d ', t)), 'topics', if(id % 4 = 0, array(), array(t, 'x')), 'owner', named_struct('login', concat('o', u)), 'created_at', iso, 'stargazers_count', if(id % 5 = 0, null, id % 500), 'forks_count', id % 8))", "'{\"items\": ['", "']}'"),
    "lobsters": ("if(id % 2 = 0, to_json(named_struct('short_id', concat('s', id), 'url', '', 'comments_url', concat('https://lobste.rs/s/', id), 'title', t, 'submitter_user', concat('me', u), 'created_at', iso, 'score', id % 40, 'comment_count', id % 5)), to_json(named_struct('short_id', concat('s', id), 'url', concat('https://e.example.com/', id), 'comments_url', 'c', 'title', t, 'description', concat('<p>', t, '</p>'), 'submitter_user', named_struct('username', concat('me', u)), 'created_at', iso, 'score', id % 40, 'comment_count', id % 5)))", "'['", "']'"),
    "mastodon_timeline": ("to_json(named_struct('uri', if(id % 9 = 0, null, concat('u', id)), 'id', concat('i', id), 'url', if(id % 2 = 0, null, concat('https://m.example.com/', id)), 'content', concat('<p>Hello  <b>', t, '</b></p> u', u), 'account', named_struct('acct', concat('x', u)), 'created_at', iso, 'reblogs_count', if(id % 3 = 0, null, id % 10), 'favourites_count', id % 20, 'replies_count', id % 3))", "'['", "']'"),
    "mastodon_links": ("to_json(named_struct('url', concat('https://l.example.com/', id), 'title', t, 'description', if(id % 2 = 0, null, concat('d', u)), 'provider_name', 'p', 'published_at', if(id % 3 = 0, null, iso), 'history', array(named_struct('uses', cast(id % 5 as string), 'accounts', cast(id % 4 as string)), named_struct('uses', if(id % 7 = 0, 'none', cast(id % 6 as string)), 'accounts', '1'), named_struct('uses', '100', 'accounts', '9'))))", "'['", "']'"),
    "bsky_search": (f"if(batch % 2 = 0, to_json({_POST}), concat('{{\"post\": ', to_json({_POST}), '}}'))", "if(batch % 2 = 0, '{\"posts\": [', '{\"feed\": [')", "']}'"),
    "bsky_trends": (f"to_json({_TREND})", "if(batch % 2 = 0, '{\"trends\": [', '{\"topics\": [')", "']}'"),
    "manifold": ("to_json(named_struct('id', concat('m', id), 'url', concat('https://m.example.com/', id), 'question', concat(t, '?'), 'probability', if(id % 10 = 0, null, id % 101 / 100d), 'volume24Hours', if(id % 6 = 0, null, id % 1000 / 4d), 'uniqueBettorCount', id % 12, 'creatorUsername', concat('c', u), 'lastUpdatedTime', if(id % 2 = 0, null, sec * 1000), 'createdTime', sec * 1000))", "'['", "']'"),
    "kalshi": ("to_json(named_struct('ticker', concat('KX-', id), 'event_ticker', if(id % 4 = 0, null, concat('KX', u)), 'title', if(id % 5 = 0, null, t), 'yes_bid', if(id % 3 = 0, null, id % 99), 'yes_ask', id % 98, 'volume_24h', if(id % 2 = 0, null, id % 77), 'status', 'open', 'open_time', iso))", "'{\"markets\": ['", "']}'"),
    "rss": (_FEED, "CASE batch % 3 WHEN 0 THEN '<rss version=\"2.0\"><channel>' WHEN 1 THEN '<feed xmlns=\"http://www.w3.org/2005/Atom\">' ELSE '<rdf:RDF>' END", "CASE batch % 3 WHEN 0 THEN '</channel></rss>' WHEN 1 THEN '</feed>' ELSE '</rdf:RDF>' END"),
}
#: What they give: external_id, url, title, text, author, published_at, score_raw, comments, kind, rank.
_HN, _SITE = "'https://news.ycombinator.com/item?id=' || id", "'https://e.example.com/' || id"
_SQL_HUB = "'org' || u || '/m' || id, 'https://huggingface.co/{0}org' || u || '/m' || id, 'org' || u || '/m' || id, array_to_string(list_concat(CASE WHEN id % 4 = 0 THEN [] ELSE [t] END, list_transform(range(1, least(12, id % 15 + 1) + 1), lambda i: 't' || i)), ', '), CASE WHEN id % 2 = 0 THEN 'org' || u ELSE 'a' || u END, tm, CASE WHEN id % 4 = 1 THEN id % 90 ELSE id % 50 END, id, '{1}', NULL FROM e WHERE id % 3 = {2}"
_SQL_FEED_TITLE = "'A & ' || t || ' ' || chr(CAST(id % 26 + 65 AS INTEGER))"
EXPECTED = {
    "hn_top": f"CAST(id AS VARCHAR), CASE WHEN id % 3 = 0 THEN {_HN} ELSE {_SITE} END, {_SQL_TITLE}, ' t  ' || u, 'u' || u, tm, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 300 END, CASE WHEN id % 7 = 0 THEN 0 ELSE id % 40 END, ['SHOW_HN', 'ASK_HN', 'LAUNCH_HN', 'STORY'][CAST(id % 4 + 1 AS INTEGER)], CAST(row_number() OVER (PARTITION BY batch ORDER BY id) AS INTEGER) FROM e WHERE t <> 'click' AND id % 11 > 0 AND id % 13 > 0",
    "hn_algolia": f"CAST(id AS VARCHAR), CASE WHEN id % 2 = 0 THEN {_HN} ELSE {_SITE} END, CASE WHEN id % 6 = 0 THEN '' ELSE t END, ' ' || t || ' ', 'u' || u, tm, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 70 END, id % 9, 'STORY', NULL FROM e",
    "hf_models": _SQL_HUB.format("", "MODEL", 0),
    "hf_datasets": _SQL_HUB.format("datasets/", "DATASET", 1),
    "hf_spaces": _SQL_HUB.format("spaces/", "SPACE", 2),
    "hf_papers": "'24.' || id, 'https://huggingface.co/papers/24.' || id, CASE WHEN id % 5 = 0 THEN 'Q' || id ELSE 'P' || id END, t, 'A1' || u || ', A2' || u || ', A3' || u, tm, CASE WHEN id % 4 = 0 THEN id % 3 ELSE id % 30 END, CASE WHEN id % 2 = 1 THEN id % 6 END, 'PAPER', NULL FROM e",
    "openrouter": "'v' || u || '/m' || id, 'https://openrouter.ai/v' || u || '/m' || id, CASE WHEN id % 3 = 0 THEN 'v' || u || '/m' || id ELSE 'M' || id END, CASE WHEN id % 2 = 0 THEN '' ELSE t END, 'v' || u, tm, NULL, NULL, 'MODEL_LISTED', NULL FROM e",
    "github_search": "CAST(id AS VARCHAR), 'https://github.com/o/r' || id, 'o/r' || id || ': ' || CASE WHEN id % 3 = 0 THEN '' ELSE 'd ' || t END, CASE WHEN id % 3 = 0 THEN '' ELSE 'd ' || t END || CASE WHEN id % 4 = 0 THEN '' ELSE ' [' || t || ', x]' END, 'o' || u, tm, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 500 END, id % 8, 'REPO', NULL FROM e",
    "lobsters": f"'s' || id, CASE WHEN id % 2 = 0 THEN 'https://lobste.rs/s/' || id ELSE {_SITE} END, t, CASE WHEN id % 2 = 0 THEN '' ELSE ' ' || t || ' ' END, 'me' || u, tm, id % 40, id % 5, 'STORY', NULL FROM e",
    "mastodon_timeline": "CASE WHEN id % 9 = 0 THEN 'i' || id ELSE 'u' || id END, CASE WHEN id % 2 = 1 THEN 'https://m.example.com/' || id WHEN id % 9 > 0 THEN 'u' || id END, 'Hello ' || t || ' u' || u, 'Hello ' || t || ' u' || u, 'x' || u || '@instance', tm, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 10 END + id % 20, id % 3, 'POST', NULL FROM e",
    "mastodon_links": "'https://l.example.com/' || id, 'https://l.example.com/' || id, t, CASE WHEN id % 2 = 0 THEN '' ELSE 'd' || u END, 'p', CASE WHEN id % 3 > 0 THEN tm END, id % 5 + CASE WHEN id % 7 = 0 THEN 0 ELSE id % 6 END, id % 4 + 1, 'TREND_LINK', NULL FROM e",
    "bsky_search": "'at://d/p/' || id, 'https://bsky.app/profile/' || CASE WHEN id % 8 = 0 THEN 'unknown' ELSE 'h' || u END || '/post/' || id, 'hi ' || t || ' ' || u, 'hi  ' || t || chr(10) || u, CASE WHEN id % 8 = 0 THEN 'unknown' ELSE 'h' || u END, tm, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 20 END + 2 * (id % 7), CASE WHEN id % 5 = 0 THEN 0 ELSE id % 4 END, 'POST', NULL FROM e",
    "bsky_trends": "'trend:' || CASE WHEN id % 3 = 0 THEN 'X ' || t || id ELSE 'x' || id END || ':' || d, 'https://bsky.app' || CASE WHEN id % 4 = 0 THEN '' ELSE '/t/' || id END, 'X ' || t || id, CASE WHEN id % 2 = 0 THEN '' ELSE 'category ' || t END, NULL, tm, id % 60, NULL, 'TREND', NULL FROM e",
    "manifold": "'m' || id, 'https://m.example.com/' || id, t || '?', 'p=' || printf('%.2f', CASE WHEN id % 10 = 0 THEN 0 ELSE id % 101 / 100.0::DOUBLE END) || ' volume24h=' || CAST(floor(CASE WHEN id % 6 = 0 THEN 0 ELSE id % 1000 / 4.0::DOUBLE END + 0.5) AS BIGINT) || ' bettors=' || id % 12, 'c' || u, tm, CASE WHEN id % 6 = 0 THEN 0 ELSE id % 1000 / 4.0::DOUBLE END, id % 12, 'MARKET', NULL FROM e",
    "kalshi": "'KX-' || id, 'https://kalshi.com/markets/kx' || CASE WHEN id % 4 = 0 THEN '-' || id ELSE CAST(u AS VARCHAR) END, CASE WHEN id % 5 = 0 THEN 'KX-' || id ELSE t END, 'yes=' || CASE WHEN id % 3 = 0 THEN '?' ELSE CAST(id % 99 AS VARCHAR) END || '/' || id % 98 || ' volume24h=' || CASE WHEN id % 2 = 0 THEN 0 ELSE id % 77 END || ' status=open', 'kalshi', tm, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 77 END, NULL, 'MARKET', NULL FROM e",
    "rss": f"CASE batch % 3 WHEN 0 THEN 'g' || id WHEN 1 THEN 'tag:' || id ELSE 'https://b.example.com/' || id END, CASE batch % 3 WHEN 0 THEN 'https://feed.example.com/p/' || id WHEN 1 THEN 'https://feed.example.com/q?' || id ELSE 'https://b.example.com/' || id END, {_SQL_FEED_TITLE}, CASE batch % 3 WHEN 0 THEN 'Some ' || t WHEN 1 THEN 'S ' || t ELSE 'D' END, CASE batch % 3 WHEN 0 THEN 'c' || u WHEN 1 THEN 'N' || u END, tm, NULL, NULL, 'POST', NULL FROM e",
}
_ITEM_COLUMNS = "external_id url title text author published_at score_raw comments kind rank".split()


def _base(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {n}" for n, x in BASE.items()])


def bodies(events: DataFrame, records: dict) -> DataFrame:
    """(type, batch, body): the records of ``PER_BODY`` events in order, for each type; all types in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.expr(r).alias("record")) for k, (r, *_) in records.items()]))
    rows = events.select("id", "batch", each.alias("x")).select("id", "batch", "x.*").where("record is not null")
    whole = rows.groupBy("type", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "record"))), lambda x: x["record"]).alias("all"))
    part = lambda i: F.coalesce(*[F.when(F.col("type") == k, F.expr(r[i])) for k, r in records.items()])
    bare = F.col("type").isin(*[k for k, r in records.items() if len(r) > 3])
    return whole.select("type", "batch", F.concat(part(1), F.when(bare, F.array_join("all", "")).otherwise(F.array_join("all", ",")), part(2)).alias("body"))


RECORDS["rss"] = (*RECORDS["rss"], "")


@register(
    "s1_s14_item_parsers",
    f"WITH {SQL_BASE}, x(source_id, {', '.join(_ITEM_COLUMNS)}) AS (" + " UNION ALL ".join(f"SELECT '{k}', {x}" for k, x in EXPECTED.items()) + ") SELECT * REPLACE (CAST(score_raw AS DOUBLE) AS score_raw, CAST(comments AS BIGINT) AS comments, CAST(rank AS INTEGER) AS rank) FROM x",
)
def item_parsers(spark, sf_dir):
    b = bodies(_base(spark, sf_dir), RECORDS)
    return parsers.parse(b.select(F.col("type").alias("source_id"), "type", F.lit(FEED_URL).alias("url"), "body")).select("source_id", *_ITEM_COLUMNS)


@register("s15_failed_sources", f"WITH {SQL_BASE} SELECT u % 97 AS source_id FROM e GROUP BY 1 HAVING bool_and(id % 3 > 0 OR u % 97 % 5 = 0)")
def failed(spark, sf_dir):
    """One response for each event: broken, of the wrong shape, or with an item, which a fifth of the sources never has."""
    body = "CASE if(u % 97 % 5 = 0, 1 + id % 2, id % 3) WHEN 0 THEN to_json(named_struct('data', array(named_struct('id', concat('v/', id))))) WHEN 1 THEN 'not json' ELSE '[]' END"
    r = _base(spark, sf_dir).select((F.col("u") % 97).alias("source_id"), F.lit("openrouter").alias("type"), F.lit("u").alias("url"), F.expr(body).alias("body"))
    return parsers.rejected(r)


@register("s2_feed_dates", f"WITH {SQL_BASE} SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 = 3 THEN tm - INTERVAL 2 HOUR WHEN id % 6 = 4 THEN date_trunc('day', tm) ELSE tm END AS published FROM e")
def dates(spark, sf_dir):
    f = lambda p: f"date_format(timestamp_seconds(sec), '{p}')"
    s = f"CASE id % 6 WHEN 0 THEN concat({f('EEE, d MMM yyyy HH:mm:ss')}, ' GMT') WHEN 1 THEN iso WHEN 2 THEN concat({f('dd MMM yyyy HH:mm:ss')}, ' +0000') WHEN 3 THEN concat(substr(iso, 1, 19), '+02:00') WHEN 4 THEN {f('d MMM yyyy')} ELSE 'soon' END"
    return _base(spark, sf_dir).select("id", parsers.iso_time(F.expr(s)).alias("published"))


@register(
    "s1_pages_as_feed",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""",
)
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsers.tag(F.col("html"), "title").alias("title"))


@register("s3_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register(
    "s17_http_class",
    f"WITH {SQL_BASE}, s AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE 200 + id * 7 % 350 END AS status FROM e) SELECT id, CASE WHEN status IS NULL OR status >= 500 OR status IN (408, 425, 429) THEN 'TEMPORARY' WHEN status IN (401, 403, 451) THEN 'RESTRICTED' WHEN status >= 400 THEN 'PERMANENT' END AS class FROM s",
)
def http_class(spark, sf_dir):
    return _base(spark, sf_dir).select("id", parsers.http_class(F.expr("if(id % 50 = 0, null, 200 + id * 7 % 350)")).alias("class"))


# catalogs

LEX = terms.lexicon()
_PULL = "CASE id % 5 WHEN 0 THEN concat('[Model] Add Foo-', id, ' model support') WHEN 1 THEN 'Fix typo' WHEN 2 THEN concat('Support Qux', u, ' and Zed', id, ' models') WHEN 3 THEN concat('Add Bar', id, ' model') ELSE concat('Add tests ', u) END"
_SQL_PULL = "CASE id % 5 WHEN 0 THEN '[Model] Add Foo-' || id || ' model support' WHEN 1 THEN 'Fix typo' WHEN 2 THEN 'Support Qux' || u || ' and Zed' || id || ' models' WHEN 3 THEN 'Add Bar' || id || ' model' ELSE 'Add tests ' || u END"
_SQL_NAMES = "CASE id % 5 WHEN 0 THEN 'Foo-' || id WHEN 2 THEN 'Qux' || u || ' Zed' || id WHEN 3 THEN 'Bar' || id END"
STATES = {
    "stealth": ("concat('<a href=\"/stealth/', if(id % 2 = 1, upper(t), t), '-', u % 9, '\"></a>')", "'<ul>'", "'</ul>'", ""),
    "prices": ("concat('\"', CASE WHEN id % 25 = 0 THEN 'sample_spec' WHEN id % 5 = 1 THEN concat('openrouter/', id) ELSE concat(t, '/', id) END, '\": {\"litellm_provider\": \"', t, '\", \"mode\": \"chat\"}')", "'{'", "'}'"),
    "hub": ("to_json(named_struct('id', if(id % 6 = 0, null, concat('o/m', id)), 'createdAt', iso, 'likes', id % 9))", "'['", "']'"),
    "code": ("to_json(named_struct('full_name', concat('o/r', id), 'fork', if(id % 4 = 0, true, null), 'description', if(id % 3 = 0, null, t), 'html_url', concat('https://c.example.com/', id), 'created_at', iso))", "'['", "']'"),
    "pulls": (f"to_json(named_struct('number', id, 'title', {_PULL}, 'html_url', concat('https://c.example.com/', id), 'created_at', iso, 'user', named_struct('login', if(id % 7 = 0, 'x[bot]', concat('u', u)))))", "'['", "']'"),
    "sitemap": ("if(id % 5 = 0, '<url></url>', concat('<url><loc> https://h.example.com/news/a-b_c%20', id, '/?x=1&amp;y=', u, ' </loc><lastmod>', iso, '</lastmod></url>'))", "'<urlset>'", "'</urlset>'", ""),
    "status": ("to_json(named_struct('id', concat('c', id), 'name', if(id % 5 = 0, null, concat('N ', t)), 'created_at', iso, 'status', 'ok'))", "'{\"page\": {\"url\": \"https://s.example.com\"}, \"components\": ['", "']}'"),
    "company": ("to_json(named_struct('siren', cast(id as string), 'nature_juridique', if(id % 3 = 0, '1000', '5710'), 'nom_complet', concat(if(id % 2 = 0, 'ACME ', 'OTHER '), upper(t)), 'date_creation', substr(iso, 1, 10)))", "'{\"results\": ['", "']}'"),
    "filing": ("to_json(named_struct('_source', named_struct('adsh', if(id % 8 = 0, null, concat('0-', u, '-', id)), 'ciks', array(concat('00', u)), 'display_names', if(id % 3 = 0, array(), array(concat('A ', t))), 'file_date', substr(iso, 1, 10))))", "'{\"hits\": {\"hits\": ['", "']}}'"),
    "market": ("to_json(named_struct('id', cast(id div 2 as string), 'title', if(id % 3 = 0, 'Rain?', concat('Will GPT be out? ', id)), 'slug', concat('s', id), 'createdAt', iso))", "'['", "']'"),
    "forum": ("to_json(named_struct('id', id, 'name', if(id % 4 = 0, null, t), 'slug', if(id % 3 = 0, null, concat('c', u)), 'topic_count', id % 5))", "'{\"category_list\": {\"categories\": ['", "']}}'"),
    "chat": ("to_json(named_struct('id', cast(id as string), 'name', if(id % 4 = 0, null, t)))", "'{\"name\": \"G\", \"channels\": ['", "']}'"),
}
ENTRIES = {
    "stealth": catalogs.stealth_page, "prices": catalogs.price_keys, "hub": catalogs.hub_org, "code": catalogs.code_org, "pulls": lambda b: catalogs.inference_pulls(b, "o/r", LEX), "sitemap": catalogs.sitemap,
    "status": catalogs.status_components, "company": lambda b: catalogs.company_register(b, "acme"), "filing": catalogs.filings, "market": lambda b: catalogs.market_events(b, LEX), "forum": lambda b: catalogs.forum_categories(b, "f.example.com"),
    "chat": lambda b: catalogs.chat_widget(b, "77"),
}
_DAY = "date_trunc('day', tm)"
#: key, title, url, event_at, entity
SQL_ENTRIES = {
    "stealth": "key, 'Stealth model: ' || substr(key, 9), 'https://openrouter.ai/' || key, NULL, NULL FROM (SELECT DISTINCT batch, 'stealth/' || lower(t) || '-' || u % 9 AS key FROM e)",
    "prices": "t || '/' || id, 'Price file: ' || t || '/' || id, NULL, NULL, NULL FROM e WHERE id % 25 > 0 AND id % 5 <> 1",
    "hub": "'o/m' || id, 'o/m' || id, 'https://huggingface.co/o/m' || id, tm, NULL FROM e WHERE id % 6 > 0",
    "code": "'o/r' || id, 'o/r' || id || CASE WHEN id % 3 = 0 THEN '' ELSE ': ' || t END, 'https://c.example.com/' || id, tm, NULL FROM e WHERE id % 4 > 0",
    "pulls": f"'o/r#' || id, 'o/r#' || id || ' ' || {_SQL_PULL}, 'https://c.example.com/' || id, tm, {_SQL_NAMES} FROM e WHERE id % 7 > 0 AND id % 5 IN (0, 2, 3)",
    "sitemap": "k, '?x=1&y=' || u, k, NULL, NULL FROM (SELECT *, 'https://h.example.com/news/a-b_c%20' || id || '/?x=1&y=' || u AS k FROM e) WHERE id % 5 > 0",
    "status": "'c' || id, 'N ' || t, 'https://s.example.com', tm, NULL FROM e WHERE id % 5 > 0",
    "company": f"CAST(id AS VARCHAR), 'ACME ' || upper(t) || ' (' || id || ')', NULL, {_DAY}, NULL FROM e WHERE id % 3 > 0 AND id % 2 = 0",
    "filing": f"'0-' || u || '-' || id, CASE WHEN id % 3 = 0 THEN '0-' || u || '-' || id ELSE 'A ' || t END, 'https://www.sec.gov/Archives/edgar/data/' || u || '/0' || u || id || '/0-' || u || '-' || id || '-index.htm', {_DAY}, NULL FROM e WHERE id % 8 > 0",
    "market": "'event:' || id // 2, 'Will GPT be out? ' || id, 'https://polymarket.com/event/s' || id, tm, NULL FROM e WHERE id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY batch, id // 2 ORDER BY id) = 1",
    "forum": "'cat:' || id, t, 'https://f.example.com/c/' || CASE WHEN id % 3 = 0 THEN '' ELSE 'c' || u END || '/' || id, NULL, NULL FROM e WHERE id % 4 > 0",
    "chat": "'channel:' || id, t, 'https://discord.com/channels/77/' || id, NULL, NULL FROM e WHERE id % 4 > 0",
}


@register(
    "k1_k14_catalog_parsers",
    f"WITH {SQL_BASE}, x(catalog, key, title, url, event_at, entity) AS (" + " UNION ALL ".join(f"SELECT '{k}', {x}" for k, x in SQL_ENTRIES.items()) + ") SELECT * FROM x",
)
def catalog_parsers(spark, sf_dir):
    found = None
    for k, parse in ENTRIES.items():
        found = F.when(F.col("type") == k, parse(F.col("body"))) if found is None else found.when(F.col("type") == k, parse(F.col("body")))
    return bodies(_base(spark, sf_dir), STATES).select(F.col("type").alias("catalog"), F.inline(found)).select("catalog", "key", "title", "url", "event_at", "entity")


@register("k5_model_in_title", f"WITH {SQL_BASE} SELECT id, {_SQL_NAMES} AS names FROM e")
def model_titles(spark, sf_dir):
    return _base(spark, sf_dir).select("id", F.array_join(F.slice(catalogs.model_in_title(F.expr(_PULL), LEX), 1, 2), " ").alias("names"))


#: A changelog for each body: entries under months, some too short, some in tags, and a part without a date.
_LINES = "CASE id % 6 WHEN 0 THEN concat('## Release of ', substr(iso, 1, 7), '\\n### ', t) WHEN 1 THEN concat('- Entry number ', id, ' of [', t, '](http://a.example.com/', u, ') is *long* enough') WHEN 2 THEN '- short' WHEN 3 THEN concat('A paragraph of event ', id, '\\nover two lines for ', t, '\\n') WHEN 4 THEN concat('<div>\\ninside a tag ', id, ' that is long enough\\n</div>') ELSE concat('* Another bullet with `code` ', id) END"


@register(
    "k8_changelog",
    f"""WITH {SQL_BASE}, h AS (SELECT *, max(CASE WHEN id % 6 = 0 THEN id END) OVER (PARTITION BY batch ORDER BY id) AS hid FROM e),
        l AS (SELECT h.batch, CASE h.id % 6 WHEN 1 THEN 'Entry number ' || h.id || ' of ' || h.t || ' is long enough' WHEN 3 THEN 'A paragraph of event ' || h.id || ' over two lines for ' || h.t ELSE 'Another bullet with code ' || h.id END AS text,
                     'Release of ' || substr(o.d, 1, 7) || ' › ' || o.t AS heading, h.id FROM h JOIN e o ON o.id = h.hid WHERE h.id % 6 IN (1, 3, 5)),
        x AS (SELECT batch, heading, text FROM l WHERE id % 6 <> 3
              UNION ALL SELECT batch, heading, CASE WHEN (id - 1) // 25 = batch THEN 'short ' ELSE '' END || text FROM l WHERE id % 6 = 3)
        SELECT batch AS catalog_id, substr(sha256(heading || '|' || lower(text)), 1, 20) AS key, heading || ': ' || substr(text, 1, 160) AS title, heading, text FROM x""",
)
def changelog(spark, sf_dir):
    b = bodies(_base(spark, sf_dir), {"md": (f"concat({_LINES}, '\\n')", "'---\\nx: y\\n---\\n# Changes\\nThis paragraph has no date above it at all.\\n\\n'", "''", "")})
    return catalogs.changelog(b.select(F.col("batch").alias("catalog_id"), F.col("body").alias("md"))).select("catalog_id", "key", "title", "heading", "text")


@register("k11_teams", "SELECT o_orderpriority AS board, 'team:' || o_orderstatus || ' / ' || CAST(o_custkey % 5 AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1, 2")
def teams(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("board"), F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderstatus").alias("department"), (F.col("o_custkey") % 5).cast("string").alias("team"))
    return catalogs.team_entries(o).select("board", "key", "n")


@register(
    "k11_job_boards",
    f"""WITH {SQL_BASE} SELECT 'ashby' AS board, 'j' || id AS job_id, 'T ' || t AS title, CASE WHEN id % 3 > 0 THEN t END AS department, 'm' || u % 4 AS team, 'L' AS location, tm AS published_at, 'https://j.example.com/' || id AS url FROM e WHERE id % 4 > 0 AND id % 9 > 0
        UNION ALL SELECT 'greenhouse', 'g' || id, 'T ' || t, 'D' || batch % 3, NULL, 'L' || u, tm, 'https://j.example.com/' || id FROM e WHERE id % 9 > 0""",
)
def job_boards(spark, sf_dir):
    """Both kinds of job boards: unlisted postings and those without a title are left out."""
    title = "if(id % 9 = 0, null, concat('T ', t))"
    records = {
        "ashby": (f"to_json(named_struct('id', concat('j', id), 'title', {title}, 'isListed', if(id % 4 = 0, false, null), 'department', if(id % 3 = 0, null, t), 'team', concat('m', u % 4), 'location', 'L', 'publishedAt', iso, 'jobUrl', concat('https://j.example.com/', id)))", "'{\"jobs\": ['", "']}'"),
        "greenhouse": (f"to_json(named_struct('id', concat('g', id), 'title', {title}, 'location', named_struct('name', concat('L', u)), 'first_published', if(id % 2 = 0, null, iso), 'updated_at', iso, 'absolute_url', concat('https://j.example.com/', id)))", "concat('{\"departments\": [{\"name\": \"D', batch % 3, '\", \"jobs\": [')", "']}]}'"),
    }
    found = F.when(F.col("type") == "ashby", catalogs.ashby_jobs(F.col("body"))).otherwise(catalogs.greenhouse_jobs(F.col("body")))
    return bodies(_base(spark, sf_dir), records).select(F.col("type").alias("board"), F.inline(found))


@register(
    "k15_lab_channels",
    "SELECT 's' || s_suppkey AS lab, type, target, type || '_' || lower(target) AS id FROM (SELECT s_suppkey, 'hf_org' AS type, 'Org' || s_nationkey AS target FROM supplier UNION ALL SELECT s_suppkey, 'github_org', unnest(['A' || s_suppkey, 'b']) FROM supplier WHERE s_suppkey % 3 > 0)",
)
def channels(spark, sf_dir):
    """Suppliers as labs: an organisation each, and two code hosts for two thirds of them."""
    own = "map('hf_org', array(concat('Org', s_nationkey)), 'github_org', if(s_suppkey % 3 > 0, array(concat('A', s_suppkey), 'b'), array()))"
    return catalogs.expand_labs(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.expr(own).alias("channels")))


_KINDS = [*weak.CATALOG_BITS, "other"]


@register(
    "w7_catalog_score",
    f"WITH {SQL_BASE}, b AS (SELECT * FROM (VALUES ('openrouter_stealth', 8), ('sirene', 7), ('litellm_prices', 6), ('inference_pulls', 6), ('status_components', 6), ('edgar_form_d', 6), ('hf_org', 5), ('polymarket_events', 5), ('sitemap', 4), ('discourse_categories', 4), ('discord_widget', 4), ('github_org', 3), ('changelog_md', 3), ('ashby_jobs', 2), ('greenhouse_jobs', 2), ('other', 4)) t(kind, bits)) SELECT id, kind, CAST(floor(bits * 0.35 * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM (SELECT id, {_KINDS}[CAST(id % {len(_KINDS)} + 1 AS INTEGER)] AS kind FROM e) JOIN b USING (kind)",
)
def catalog_score(spark, sf_dir):
    """Events as catalog events of all kinds."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % len(_KINDS) + 1).cast("int"))
    k = _base(spark, sf_dir).select("id", kind.alias("kind"))
    return k.select("id", "kind", F.floor(weak.catalog_score(F.col("kind")) * 1e6 + 0.5).alias("score_e6"))
