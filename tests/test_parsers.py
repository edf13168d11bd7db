"""Parsers over bodies written by hand: feeds of three kinds, odd records, broken bodies, a changelog."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F
from tidewatch.functions import terms
from tidewatch.sources import catalogs, parsers

RSS = """<rss version="2.0"><channel><item><title>First &amp;amp; best</title><link>https://a.example.com/1</link><guid>g1</guid><pubDate>Tue, 22 Sep 2026 10:00:00 GMT</pubDate><description><![CDATA[<p>Some <b>text</b></p>]]></description></item>
<item><title>It&#8217;s &amp;#x41; w&#38;#97;y &#1114112;</title><guid isPermaLink="true">https://a.example.com/2</guid><dc:creator>Someone</dc:creator></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>tag:1</id><title>Relative</title><link rel="alternate" href="/posts/1"/><updated>2026-09-22T08:00:00Z</updated><summary>S</summary><author><name>N</name></author></entry></feed>"""
RDF = """<rdf:RDF><item rdf:about="https://b.example.com/x"><title>Rdf</title><dc:date>2026-09-21T00:00:00+02:00</dc:date><description>D</description></item></rdf:RDF>"""
BODIES = [
    ("rss_a", "rss", "https://a.example.com/feed", RSS),
    ("atom_a", "rss", "https://c.example.com/blog/feed.xml", ATOM),
    ("rdf_a", "rss", "https://b.example.com/", RDF),
    ("hn", "hn_top", "u", '[{"id": 1, "type": "story", "title": "Show HN: x", "by": "a", "time": 1790000000, "score": 5, "descendants": 2}, {"id": 2, "type": "comment"}, null, {"id": 3, "type": "story", "title": "t", "dead": true}, {"id": 4, "type": "story", "title": "Plain", "time": 1790000100}]'),
    ("algolia", "hn_algolia", "u", '{"hits": [{"objectID": "9", "title": "T", "story_text": "<i>x</i>", "author": "a", "created_at": "2026-09-22T00:00:00Z", "points": 7, "num_comments": 1}]}'),
    ("models", "hf_models", "u", '[{"id": "org/m", "pipeline_tag": "text", "tags": ["a", "b"], "likes": 3, "downloads": 9, "lastModified": "2026-09-20T00:00:00.000Z"}]'),
    ("papers", "hf_papers", "u", '[{"paper": {"id": "2609.1", "title": "P", "summary": "S", "authors": [{"name": "A"}, {"name": "B"}], "upvotes": 4}, "publishedAt": "2026-09-22T00:00:00Z"}]'),
    ("list", "openrouter", "u", '{"data": [{"id": "v/m", "name": "M", "created": 1790000000}]}'),
    ("repos", "github_search", "u", '{"items": [{"id": 5, "html_url": "https://github.com/o/r", "full_name": "o/r", "description": "d", "topics": ["x"], "owner": {"login": "o"}, "created_at": "2026-09-01T00:00:00Z", "stargazers_count": 8, "forks_count": 1}]}'),
    ("lob", "lobsters", "u", '[{"short_id": "s1", "url": "", "comments_url": "https://lobste.rs/s/1", "title": "L", "submitter_user": "me", "created_at": "2026-09-22T00:00:00Z", "score": 3, "comment_count": 2}]'),
    ("masto", "mastodon_timeline", "u", '[{"uri": "u1", "content": "<p>Hello  <b>w</b></p>", "account": {"acct": "x"}, "created_at": "2026-09-22T00:00:00Z", "reblogs_count": 2, "favourites_count": 3, "replies_count": 1}]'),
    ("links", "mastodon_links", "u", '[{"url": "https://l/1", "title": "L", "history": [{"uses": "3", "accounts": "2"}, {"uses": "4", "accounts": "1"}, {"uses": "100", "accounts": "9"}]}]'),
    ("sky", "bsky_search", "u", '{"posts": [{"uri": "at://d/p/k1", "author": {"handle": "h"}, "record": {"text": "hi  there", "createdAt": "2026-09-22T00:00:00Z"}, "likeCount": 1, "repostCount": 2}]}'),
    ("trends", "bsky_trends", "u", '{"trends": [{"topic": "x", "displayName": "X", "link": "/t/x", "startedAt": "2026-09-22T00:00:00Z", "postCount": 12}]}'),
    ("mani", "manifold", "u", '[{"id": "m", "url": "https://m/1", "question": "Q?", "probability": 0.456, "volume24Hours": 10.5, "uniqueBettorCount": 3, "createdTime": 1790000000000}]'),
    ("kal", "kalshi", "u", '{"markets": [{"ticker": "KX-1", "event_ticker": "KX", "title": "K", "yes_bid": 40, "volume_24h": 6, "status": "open", "open_time": "2026-09-22T00:00:00Z"}]}'),
    ("broken", "kalshi", "u", "not json"),
]
_EXPECTED = """(VALUES ('rss_a', 'g1', 'https://a.example.com/1', 'First & best', 'Some text', NULL, NULL), ('rss_a', 'https://a.example.com/2', 'https://a.example.com/2', 'It’s A way &#1114112;', '', NULL, NULL),
 ('atom_a', 'tag:1', 'https://c.example.com/posts/1', 'Relative', 'S', NULL, NULL), ('rdf_a', 'https://b.example.com/x', 'https://b.example.com/x', 'Rdf', 'D', NULL, NULL),
 ('hn', '1', 'https://news.ycombinator.com/item?id=1', 'Show HN: x', '', 5.0, 2), ('hn', '4', 'https://news.ycombinator.com/item?id=4', 'Plain', '', 0.0, 0), ('algolia', '9', 'https://news.ycombinator.com/item?id=9', 'T', ' x ', 7.0, 1),
 ('models', 'org/m', 'https://huggingface.co/org/m', 'org/m', 'text, a, b', 3.0, 9), ('papers', '2609.1', 'https://huggingface.co/papers/2609.1', 'P', 'S', 4.0, NULL), ('list', 'v/m', 'https://openrouter.ai/v/m', 'M', '', NULL, NULL),
 ('repos', '5', 'https://github.com/o/r', 'o/r: d', 'd [x]', 8.0, 1), ('lob', 's1', 'https://lobste.rs/s/1', 'L', '', 3.0, 2), ('masto', 'u1', 'u1', 'Hello w', 'Hello w', 5.0, 1), ('links', 'https://l/1', 'https://l/1', 'L', '', 7.0, 3),
 ('sky', 'at://d/p/k1', 'https://bsky.app/profile/h/post/k1', 'hi there', 'hi  there', 5.0, 0), ('trends', 'trend:x:2026-09-22', 'https://bsky.app/t/x', 'X', '', 12.0, NULL),
 ('mani', 'm', 'https://m/1', 'Q?', 'p=0.46 volume24h=11 bettors=3', 10.5, 3), ('kal', 'KX-1', 'https://kalshi.com/markets/kx', 'K', 'yes=40/? volume24h=6 status=open', 6.0, NULL)) t(source_id, external_id, url, title, text, score_raw, comments)"""

STATES = {
    "stealth": ('<a href="/stealth/Alpha-1"></a><a href="/stealth/alpha-1"></a><a href="/stealth/b"></a>', lambda b: catalogs.stealth_page(b)),
    "prices": ('{"sample_spec": {}, "openrouter/x": {}, "p/m": {"litellm_provider": "p", "mode": "chat"}}', lambda b: catalogs.price_keys(b)),
    "hub": ('[{"id": "o/m", "createdAt": "2026-09-20T00:00:00Z", "likes": 2}, {"likes": 1}]', lambda b: catalogs.hub_org(b)),
    "code": ('[{"full_name": "o/r", "fork": false, "description": "d", "html_url": "h", "created_at": "2026-09-20T00:00:00Z"}, {"full_name": "o/f", "fork": true}]', lambda b: catalogs.code_org(b)),
    "pulls": ('[{"number": 7, "title": "[Model] Add Foo-9 model support", "html_url": "h", "user": {"login": "u"}}, {"number": 8, "title": "Add Bar model", "user": {"login": "x[bot]"}}, {"number": 9, "title": "Fix typo"}]', lambda b: catalogs.inference_pulls(b, "o/r", terms.lexicon())),
    "sitemap": ("<urlset><url><loc>https://h/news/a-b_c%20d/</loc><lastmod>2026-09-01</lastmod></url><url></url></urlset>", lambda b: catalogs.sitemap(b)),
    "status": ('{"page": {"url": "https://s"}, "components": [{"id": "c1", "name": "N", "created_at": "2026-09-20T00:00:00Z"}, {"id": "c2"}]}', lambda b: catalogs.status_components(b)),
    "company": ('{"results": [{"siren": "1", "nature_juridique": "5710", "nom_complet": "ACME FR"}, {"siren": "2", "nature_juridique": "1000", "nom_complet": "ACME X"}, {"siren": "3", "nature_juridique": "5710", "nom_complet": "OTHER"}]}', lambda b: catalogs.company_register(b, "acme")),
    "filing": ('{"hits": {"hits": [{"_source": {"adsh": "0-1-2", "ciks": ["0012"], "display_names": ["A SPV"], "file_date": "2026-09-20"}}]}}', lambda b: catalogs.filings(b)),
    "market": ('[{"id": "1", "title": "Will GPT be out?", "slug": "s"}, {"id": "2", "title": "Rain?"}, {"id": "1", "title": "Will GPT be out?", "slug": "twice"}]', lambda b: catalogs.market_events(b, terms.lexicon())),
    "forum": ('{"category_list": {"categories": [{"id": 4, "name": "C", "slug": "c", "topic_count": 2}]}}', lambda b: catalogs.forum_categories(b, "f.example.com")),
    "chat": ('{"name": "G", "channels": [{"id": "8", "name": "stage"}]}', lambda b: catalogs.chat_widget(b, "77")),
}


CHANGELOG = """---
x: y
---
# Changes
## September, 2026
### Sep 15
- A first bullet that is long enough [link](http://a)
- short
A paragraph of one
line or two that goes on.

<div>
inside a tag
</div>
## About
This paragraph has no date above it at all.
"""


def test_items_of_all_kinds_of_bodies(spark):
    got = parsers.parse(spark.createDataFrame(BODIES, "source_id string, type string, url string, body string"))
    columns = ["source_id", "external_id", "url", "title", "text", "score_raw", "comments"]
    want = duckdb.connect().execute(f"SELECT {', '.join(columns)} FROM {_EXPECTED}").fetchall()
    plain = lambda rows: sorted(tuple(float(x) if c == "score_raw" and x is not None else x for c, x in zip(columns, r)) for r in rows)
    assert sorted(map(str, plain(tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, plain(want)))
    assert [r.source_id for r in parsers.rejected(spark.createDataFrame(BODIES, "source_id string, type string, url string, body string")).collect()] == ["broken"]


def test_entries_of_all_kinds_of_states(spark):
    want = {
        ("stealth", "stealth/alpha-1", "https://openrouter.ai/stealth/alpha-1"), ("stealth", "stealth/b", "https://openrouter.ai/stealth/b"), ("prices", "p/m", None), ("hub", "o/m", "https://huggingface.co/o/m"), ("code", "o/r", "h"),
        ("pulls", "o/r#7", "h"), ("sitemap", "https://h/news/a-b_c%20d/", "https://h/news/a-b_c%20d/"), ("status", "c1", "https://s"), ("company", "1", None), ("filing", "0-1-2", "https://www.sec.gov/Archives/edgar/data/12/012/0-1-2-index.htm"),
        ("market", "event:1", "https://polymarket.com/event/s"), ("forum", "cat:4", "https://f.example.com/c/c/4"), ("chat", "channel:8", "https://discord.com/channels/77/8"),
    }
    got = set()
    for k, (b, parse) in STATES.items():
        got |= {(k, r.key, r.url) for r in spark.createDataFrame([(b,)], "body string").select(F.inline(parse(F.col("body")))).collect()}
    assert got == want


def test_changelog_by_hand(spark):
    got = catalogs.changelog(spark.createDataFrame([("c", CHANGELOG)], "catalog_id string, md string")).collect()
    assert {(r.heading, r.text) for r in got} == {("September, 2026 › Sep 15", "A first bullet that is long enough link"), ("September, 2026 › Sep 15", "short A paragraph of one line or two that goes on.")}


def test_names_in_titles_of_pulls(spark):
    titles = [("[Model] Add Foo-9 model support", "Foo-9"), ("Fix model docs", None), ("Add tests", None), ("Support Qux and Zed models", "Qux Zed")]
    got = spark.createDataFrame([(t,) for t, _ in titles], "title string").select("title", F.array_join(F.slice(catalogs.model_in_title(F.col("title"), terms.lexicon()), 1, 2), " ").alias("names")).collect()
    assert {r.title: r.names for r in got} == dict(titles)
