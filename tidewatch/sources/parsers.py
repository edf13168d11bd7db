"""Item parsers: a column with a response body becomes ``array<item>``, then rows.

All parsers give the same struct, so that sources of any kind can be united. Bodies that don't parse give no
items and can be found with ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, decode_entities, iso_time, let, squeeze, strip_tags

ITEM = "external_id string, url string, title string, text string, author string, published_at timestamp, score_raw double, comments bigint, kind string, rank int"
FIELDS = [f.strip().split(" ") for f in ITEM.split(",")]


def _item(**given) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS])


def _or(*cs) -> Column:
    return F.coalesce(*[c if isinstance(c, Column) else F.lit(c) for c in cs])


def _json(body: Column, schema: str) -> Column:
    return F.from_json(body, schema)


def _epoch(c: Column) -> Column:
    return F.timestamp_micros((c.cast("double") * 1e6).cast("long"))


def _plain(c: Column, n: int) -> Column:
    return F.substring(squeeze(strip_tags(_or(c, ""))), 1, n)


# feeds


def tag(xml: Column, name: str) -> Column:
    """Inner text of the first element of this name: CDATA opened, entities decoded twice, tags removed; empty if missing."""
    inner = F.regexp_extract(xml, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    inner = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return squeeze(strip_tags(decode_entities(decode_entities(inner))))


def _first(*texts: Column) -> Column:
    """The first text that isn't empty; empty if none. Each is computed once, and only if those before are empty."""
    full = lambda t: F.get(F.filter(F.array(t), lambda x: x != ""), F.lit(0))
    return F.coalesce(*[full(t) for t in texts], F.lit(""))


def feed(body: Column, feed_url: Column) -> Column:
    """RSS 2, Atom or RDF. Atom is told by a feed element without an rss element."""
    is_atom = body.rlike(r"(?i)<feed[\s>]") & ~body.rlike(r"(?i)<rss[\s>]")

    def blocks(atom: Column) -> Column:
        return F.when(atom, F.regexp_extract_all(body, F.lit(r"(?is)<entry[\s>].*?</entry>"), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(r"(?is)<item[\s>].*?</item>"), F.lit(0)))

    def address(b: Column, atom: Column) -> Column:
        alternate = F.regexp_extract(b, r"""(?i)<link[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)["']""", 1)
        href = _first(alternate, F.regexp_extract(b, r"""(?i)<link[^>]*href=["']([^"']+)["']""", 1))
        rss = _first(tag(b, "link"), F.regexp_extract(b, r"(?i)<guid[^>]*>(https?:[^<]+)</guid>", 1), F.regexp_extract(b, r"""(?i)rdf:about=["']([^"']+)["']""", 1))
        return let(F.trim(decode_entities(F.when(atom, href).otherwise(rss))), lambda x: F.when(x == "", "").otherwise(absolute_url(x, feed_url)))

    def one(b: Column, atom: Column, link: Column) -> Column:
        published = F.when(atom, _first(tag(b, "published"), tag(b, "updated"))).otherwise(_first(tag(b, "pubDate"), tag(b, "dc:date")))
        lead = F.when(atom, tag(b, "summary")).otherwise(tag(b, "description"))
        author = _first(F.when(atom, tag(b, "name")).otherwise(tag(b, "dc:creator")), tag(b, "author"), tag(b, "source"))
        return _item(
            external_id=_first(F.when(atom, tag(b, "id")).otherwise(tag(b, "guid")), link), url=link, title=tag(b, "title"),
            text=F.substring(_first(lead, tag(b, "content"), tag(b, "content:encoded")), 1, 1200), author=let(author, lambda a: F.when(a != "", a)), published_at=let(published, iso_time), kind=F.lit("POST"),
        )

    # what the whole body says is read once for a body, and an entry's address once for an entry
    return let(is_atom, lambda atom: F.transform(blocks(atom), lambda b: let(address(b, atom), lambda link: one(b, atom, link))))


# story lists

_HN = "array<struct<id: bigint, type: string, title: string, url: string, text: string, by: string, time: bigint, score: bigint, descendants: bigint, dead: boolean, deleted: boolean>>"


def hn_items(body: Column, ranked: bool = False) -> Column:
    """Living stories; the kind is told by the title's beginning, the rank by the place among those kept."""
    kept = F.filter(_json(body, _HN), lambda i: (i["type"] == "story") & ~_or(i["dead"], False) & ~_or(i["deleted"], False))

    def one(i, k):
        title = _or(i["title"], "")
        kind = F.when(title.rlike("(?i)^show hn"), "SHOW_HN").when(title.rlike("(?i)^launch hn"), "LAUNCH_HN").when(title.rlike("(?i)^ask hn"), "ASK_HN").otherwise("STORY")
        own = F.concat(F.lit("https://news.ycombinator.com/item?id="), i["id"].cast("string"))
        return _item(external_id=i["id"], url=F.coalesce(F.nullif(i["url"], F.lit("")), own), title=title, text=F.substring(strip_tags(_or(i["text"], "")), 1, 1200), author=i["by"],
                     published_at=_epoch(i["time"]), score_raw=_or(i["score"], 0), comments=_or(i["descendants"], 0), kind=kind, rank=k + 1 if ranked else F.lit(None))

    return F.transform(kept, one)


def hn_search(body: Column) -> Column:
    hits = _json(body, "hits array<struct<objectID: string, url: string, title: string, story_text: string, author: string, created_at: string, points: bigint, num_comments: bigint>>")["hits"]
    return F.transform(hits, lambda h: _item(
        external_id=h["objectID"], url=F.coalesce(F.nullif(h["url"], F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), h["objectID"])), title=_or(h["title"], ""),
        text=F.substring(strip_tags(_or(h["story_text"], "")), 1, 1200), author=h["author"], published_at=iso_time(h["created_at"]), score_raw=_or(h["points"], 0), comments=_or(h["num_comments"], 0), kind=F.lit("STORY")))


def lobsters(body: Column) -> Column:
    rows = _json(body, "array<struct<short_id: string, url: string, comments_url: string, title: string, description: string, submitter_user: string, created_at: string, score: bigint, comment_count: bigint>>")
    return F.transform(rows, lambda s: _item(
        external_id=s["short_id"], url=F.coalesce(F.nullif(s["url"], F.lit("")), s["comments_url"]), title=s["title"], text=F.substring(strip_tags(_or(s["description"], "")), 1, 600),
        author=F.coalesce(F.get_json_object(s["submitter_user"], "$.username"), s["submitter_user"]), published_at=iso_time(s["created_at"]), score_raw=_or(s["score"], 0), comments=_or(s["comment_count"], 0), kind=F.lit("STORY")))


# hubs and repositories


def hub(body: Column, kind: str) -> Column:
    """Models, datasets or spaces; the score is the trend, else the likes; the text the task and twelve tags."""
    rows = _json(body, "array<struct<id: string, author: string, pipeline_tag: string, tags: array<string>, lastModified: string, createdAt: string, trendingScore: double, likes: double, downloads: bigint>>")
    path = {"DATASET": "datasets/", "SPACE": "spaces/"}.get(kind, "")
    return F.transform(rows, lambda m: _item(
        external_id=m["id"], url=F.concat(F.lit(f"https://huggingface.co/{path}"), m["id"]), title=m["id"],
        text=F.array_join(F.filter(F.concat(F.array(m["pipeline_tag"]), F.slice(_or(m["tags"], F.array().cast("array<string>")), 1, 12)), lambda x: x.isNotNull() & (x != "")), ", "),
        author=F.coalesce(m["author"], F.split_part(m["id"], F.lit("/"), F.lit(1))), published_at=iso_time(F.coalesce(m["lastModified"], m["createdAt"])),
        score_raw=_or(m["trendingScore"], m["likes"], 0.0), comments=m["downloads"], kind=F.lit(kind)))


def hub_papers(body: Column) -> Column:
    rows = _json(body, "array<struct<paper: struct<id: string, title: string, summary: string, authors: array<struct<name: string>>, publishedAt: string, upvotes: bigint>, title: string, publishedAt: string, upvotes: bigint, numComments: bigint>>")
    return F.transform(rows, lambda p: _item(
        external_id=p["paper"]["id"], url=F.concat(F.lit("https://huggingface.co/papers/"), p["paper"]["id"]), title=_or(p["paper"]["title"], p["title"], ""), text=F.substring(_or(p["paper"]["summary"], ""), 1, 1200),
        author=F.nullif(F.array_join(F.transform(F.slice(p["paper"]["authors"], 1, 3), lambda a: a["name"]), ", "), F.lit("")), published_at=iso_time(F.coalesce(p["publishedAt"], p["paper"]["publishedAt"])),
        score_raw=_or(p["paper"]["upvotes"], p["upvotes"], 0), comments=p["numComments"], kind=F.lit("PAPER")))


def model_list(body: Column) -> Column:
    rows = _json(body, "data array<struct<id: string, name: string, description: string, created: bigint>>")["data"]
    return F.transform(rows, lambda m: _item(
        external_id=m["id"], url=F.concat(F.lit("https://openrouter.ai/"), m["id"]), title=_or(m["name"], m["id"]), text=F.substring(_or(m["description"], ""), 1, 600),
        author=F.split_part(m["id"], F.lit("/"), F.lit(1)), published_at=_epoch(_or(m["created"], 0)), kind=F.lit("MODEL_LISTED")))


def repositories(body: Column) -> Column:
    rows = _json(body, "items array<struct<id: bigint, html_url: string, full_name: string, description: string, topics: array<string>, owner: struct<login: string>, created_at: string, stargazers_count: bigint, forks_count: bigint>>")["items"]
    return F.transform(rows, lambda r: _item(
        external_id=r["id"], url=r["html_url"], title=F.substring(F.concat(r["full_name"], F.lit(": "), _or(r["description"], "")), 1, 300),
        text=F.concat(_or(r["description"], ""), F.when(F.size(_or(r["topics"], F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ["), F.array_join(r["topics"], ", "), F.lit("]"))).otherwise("")),
        author=r["owner"]["login"], published_at=iso_time(r["created_at"]), score_raw=_or(r["stargazers_count"], 0), comments=r["forks_count"], kind=F.lit("REPO")))


# social networks


def mastodon_statuses(body: Column, instance: str) -> Column:
    rows = _json(body, "array<struct<uri: string, id: string, url: string, content: string, account: struct<acct: string>, created_at: string, reblogs_count: bigint, favourites_count: bigint, replies_count: bigint>>")
    return F.transform(rows, lambda s: _item(
        external_id=_or(s["uri"], s["id"]), url=_or(s["url"], s["uri"]), title=_plain(s["content"], 200), text=_plain(s["content"], 1200), author=F.concat(s["account"]["acct"], F.lit(f"@{instance}")),
        published_at=iso_time(s["created_at"]), score_raw=_or(s["reblogs_count"], 0) + _or(s["favourites_count"], 0), comments=_or(s["replies_count"], 0), kind=F.lit("POST")))


def mastodon_links(body: Column) -> Column:
    """Trending links; score and comments are the uses and accounts of the last two days."""
    rows = _json(body, "array<struct<url: string, title: string, description: string, provider_name: string, published_at: string, history: array<struct<uses: string, accounts: string>>>>")
    last2 = lambda l, f: F.aggregate(F.slice(_or(l["history"], F.array().cast("array<struct<uses: string, accounts: string>>")), 1, 2), F.lit(0).cast("long"), lambda a, h: a + _or(h[f].try_cast("long"), 0))  # noqa: E731, E741
    return F.transform(rows, lambda x: _item(
        external_id=x["url"], url=x["url"], title=_or(x["title"], ""), text=F.substring(_or(x["description"], ""), 1, 600), author=x["provider_name"], published_at=iso_time(x["published_at"]),
        score_raw=last2(x, "uses"), comments=last2(x, "accounts"), kind=F.lit("TREND_LINK")))


_BSKY = "struct<uri: string, author: struct<handle: string>, record: struct<text: string, createdAt: string>, indexedAt: string, likeCount: bigint, repostCount: bigint, replyCount: bigint>"


def bsky_posts(body: Column) -> Column:
    """Posts of a search or a feed; the score is likes and twice the reposts."""
    j = _json(body, f"posts array<{_BSKY}>, feed array<struct<post: {_BSKY}>>")
    rows = F.filter(F.coalesce(j["posts"], F.transform(j["feed"], lambda f: f["post"])), lambda p: p.isNotNull())

    def one(p):
        handle = _or(p["author"]["handle"], "unknown")
        return _item(
            external_id=p["uri"], url=F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), F.substring_index(p["uri"], "/", -1)), title=F.substring(F.regexp_replace(_or(p["record"]["text"], ""), r"\s+", " "), 1, 200),
            text=F.substring(_or(p["record"]["text"], ""), 1, 1200), author=handle, published_at=iso_time(_or(p["record"]["createdAt"], p["indexedAt"])), score_raw=_or(p["likeCount"], 0) + 2 * _or(p["repostCount"], 0), comments=_or(p["replyCount"], 0), kind=F.lit("POST"))

    return F.transform(rows, one)


def bsky_trends(body: Column) -> Column:
    """Trends; a trend that starts on another day is another item."""
    t = "array<struct<topic: string, displayName: string, link: string, category: string, startedAt: string, postCount: bigint>>"
    j = _json(body, f"trends {t}, topics {t}")
    return F.transform(F.coalesce(j["trends"], j["topics"]), lambda x: _item(
        external_id=F.concat(F.lit("trend:"), _or(x["topic"], x["displayName"]), F.lit(":"), F.substring(_or(x["startedAt"], ""), 1, 10)), url=F.concat(F.lit("https://bsky.app"), _or(x["link"], "")),
        title=_or(x["displayName"], x["topic"], ""), text=F.when(_or(x["category"], "") != "", F.concat(F.lit("category "), x["category"])).otherwise(""), published_at=iso_time(x["startedAt"]), score_raw=x["postCount"], kind=F.lit("TREND")))


# prediction markets


def manifold(body: Column) -> Column:
    rows = _json(body, "array<struct<id: string, url: string, question: string, probability: double, volume24Hours: double, uniqueBettorCount: bigint, creatorUsername: string, lastUpdatedTime: bigint, createdTime: bigint>>")
    return F.transform(rows, lambda m: _item(
        external_id=m["id"], url=m["url"], title=m["question"],
        text=F.concat(F.lit("p="), F.format_string("%.2f", _or(m["probability"], 0.0)), F.lit(" volume24h="), F.floor(_or(m["volume24Hours"], 0.0) + 0.5).cast("string"), F.lit(" bettors="), _or(m["uniqueBettorCount"], 0).cast("string")),
        author=m["creatorUsername"], published_at=_epoch(F.coalesce(m["lastUpdatedTime"], m["createdTime"]) / 1000), score_raw=_or(m["volume24Hours"], 0.0), comments=m["uniqueBettorCount"], kind=F.lit("MARKET")))


def kalshi(body: Column) -> Column:
    rows = _json(body, "markets array<struct<ticker: string, event_ticker: string, title: string, yes_bid: bigint, yes_ask: bigint, volume_24h: bigint, status: string, open_time: string>>")["markets"]
    return F.transform(rows, lambda m: _item(
        external_id=m["ticker"], url=F.concat(F.lit("https://kalshi.com/markets/"), F.lower(_or(m["event_ticker"], m["ticker"]))), title=_or(m["title"], m["ticker"]),
        text=F.concat(F.lit("yes="), _or(m["yes_bid"].cast("string"), "?"), F.lit("/"), _or(m["yes_ask"].cast("string"), "?"), F.lit(" volume24h="), _or(m["volume_24h"], 0).cast("string"), F.lit(" status="), _or(m["status"], "")),
        author=F.lit("kalshi"), published_at=iso_time(m["open_time"]), score_raw=_or(m["volume_24h"], 0), kind=F.lit("MARKET")))


#: Parsers by source type; each takes the body and the row's address.
PARSERS = {
    "rss": feed, "hn_items": lambda b, u: hn_items(b), "hn_top": lambda b, u: hn_items(b, True), "hn_algolia": lambda b, u: hn_search(b), "hf_models": lambda b, u: hub(b, "MODEL"),
    "hf_datasets": lambda b, u: hub(b, "DATASET"), "hf_spaces": lambda b, u: hub(b, "SPACE"), "hf_papers": lambda b, u: hub_papers(b), "openrouter": lambda b, u: model_list(b),
    "github_search": lambda b, u: repositories(b), "lobsters": lambda b, u: lobsters(b), "mastodon_timeline": lambda b, u: mastodon_statuses(b, "instance"), "mastodon_links": lambda b, u: mastodon_links(b),
    "bsky_search": lambda b, u: bsky_posts(b), "bsky_trends": lambda b, u: bsky_trends(b), "manifold": lambda b, u: manifold(b), "kalshi": lambda b, u: kalshi(b),
}


def parse(responses: DataFrame) -> DataFrame:
    """Items of ``responses`` (source_id, type, url, body): each row by its type, in one pass; a source may have many rows.

    What has no id is no item: an object where a list should be reads as one empty record.
    """
    found = F.lit(None).cast(f"array<struct<{', '.join(f'{n}: {t}' for n, t in FIELDS)}>>")
    for kind, parser in PARSERS.items():
        found = F.when(F.col("type") == kind, parser(F.col("body"), F.col("url"))).otherwise(found)
    return responses.select("source_id", F.inline(found)).where("external_id is not null")


def rejected(responses: DataFrame) -> DataFrame:
    """Sources none of whose responses gave an item: one good address of several is enough."""
    good = parse(responses).select("source_id").distinct()
    return responses.select("source_id").distinct().join(good, "source_id", "left_anti")


def http_class(status: Column) -> Column:
    """TEMPORARY, RESTRICTED or PERMANENT for an error's status, null for success."""
    return F.when(status.isNull() | (status >= 500) | status.isin(408, 425, 429), "TEMPORARY").when(status.isin(401, 403, 451), "RESTRICTED").when(status >= 400, "PERMANENT")
