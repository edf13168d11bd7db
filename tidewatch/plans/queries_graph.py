"""Registered queries: catalogs, topics, press."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms, vectors
from ..operators import catalog, press, topics
from ..registry import register
from ..session import table
from . import fixture
from .fixture import NOW, SQL_ITEMS, with_items
from .queries_items import _T, LEX, SQL_ENTITIES, members, sql_name

# catalogs: keys are customers, catalogs their orders' status, states two dates of the orders

_BEFORE, _AFTER = "1998-06-01", "1998-06-15"
_SQL_STATES = f"""
prev AS (SELECT DISTINCT o_orderstatus AS catalog_id, o_custkey AS key FROM orders WHERE o_orderdate < DATE '{_BEFORE}' AND o_orderstatus <> 'P'),
cur AS (SELECT o_orderstatus AS catalog_id, o_custkey AS key, max(CAST(o_orderdate AS TIMESTAMP)) AS event_at FROM orders WHERE o_orderdate < DATE '{_AFTER}' GROUP BY 1, 2)"""


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("catalog_id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"))
    prev = o.where((F.col("at") < F.lit(_BEFORE).cast("timestamp")) & (F.col("catalog_id") != "P")).select("catalog_id", "key").distinct()
    cur = o.where(F.col("at") < F.lit(_AFTER).cast("timestamp")).groupBy("catalog_id", "key").agg(F.max("at").alias("event_at"))
    return prev, cur.withColumns({"title": F.col("key").cast("string"), "dated_by_commit": F.col("key") % 10 == 0})


@register("k17_new_entries", f"WITH {_SQL_STATES} SELECT catalog_id, key, event_at FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.catalog_id = cur.catalog_id AND prev.key = cur.key)")
def new_entries(spark, sf_dir):
    prev, cur = _states(spark, sf_dir)
    return catalog.new_entries(prev, cur).select("catalog_id", "key", "event_at")


@register(
    "k18_catalog_events",
    f"""WITH {_SQL_STATES}, f AS (SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.catalog_id = cur.catalog_id AND prev.key = cur.key))
        SELECT catalog_id, key, event_at FROM f WHERE key % 7 <> 0 AND (catalog_id IN (SELECT catalog_id FROM prev) OR (event_at >= TIMESTAMP '{_AFTER} 00:00:00' - INTERVAL 48 HOUR AND key % 10 <> 0))""",
)
def catalog_events(spark, sf_dir):
    prev, cur = _states(spark, sf_dir)
    return catalog.catalog_events(prev, cur, cur.where("key % 7 = 0"), f"{_AFTER} 00:00:00").select("catalog_id", "key", "event_at")


_SQL_JOBS = f"""
pj AS (SELECT o_orderpriority AS board, o_orderkey AS job_id FROM orders WHERE o_orderdate < DATE '{_BEFORE}' AND o_orderpriority <> '1-URGENT'),
cj AS (SELECT o_orderpriority AS board, o_orderkey AS job_id, CAST(o_orderdate AS TIMESTAMP) AS pub FROM orders WHERE o_orderdate < DATE '{_AFTER}')"""


def _jobs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("board"), F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    return o.where((F.col("published_at") < F.lit(_BEFORE).cast("timestamp")) & (F.col("board") != "1-URGENT")), o.where(F.col("published_at") < F.lit(_AFTER).cast("timestamp"))


@register(
    "k19_job_events",
    f"""WITH {_SQL_JOBS}, f AS (SELECT * FROM cj WHERE NOT EXISTS (SELECT 1 FROM pj WHERE pj.board = cj.board AND pj.job_id = cj.job_id) AND (board IN (SELECT board FROM pj) OR pub >= TIMESTAMP '{_AFTER} 00:00:00' - INTERVAL 48 HOUR)),
        r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY job_id) AS k FROM f)
        SELECT board, count(*) AS n, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) FILTER (k <= 6) AS titles, 'jobs:{_AFTER}T00:00' AS key FROM r GROUP BY board""",
)
def job_events(spark, sf_dir):
    before, now = _jobs(spark, sf_dir)
    return catalog.job_events(before, now, f"{_AFTER} 00:00:00").withColumn("titles", F.array_join("titles", ","))


@register(
    "k19_job_history",
    f"""WITH {_SQL_JOBS} SELECT coalesce(pj.board, cj.board) AS board, coalesce(pj.job_id, cj.job_id) AS job_id, CASE WHEN pj.job_id IS NULL THEN TIMESTAMP '{_AFTER}' ELSE TIMESTAMP '{_BEFORE}' END AS first_seen_at,
               CASE WHEN cj.job_id IS NULL THEN TIMESTAMP '{_BEFORE}' ELSE TIMESTAMP '{_AFTER}' END AS last_seen_at FROM pj FULL JOIN cj ON pj.board = cj.board AND pj.job_id = cj.job_id""",
)
def job_history(spark, sf_dir):
    before, now = _jobs(spark, sf_dir)
    at = F.lit(_BEFORE).cast("timestamp")
    return catalog.job_history(before.withColumns({"first_seen_at": at, "last_seen_at": at}), now, f"{_AFTER} 00:00:00").drop("title")


_KINDS = ["openrouter_stealth", "litellm_prices", "hf_org", "github_org", "inference_pulls", "sirene", "edgar_form_d", "polymarket_events", "discord_widget", "ashby_jobs", "greenhouse_jobs", "sitemap", "changelog_md", "status_components", "discourse_categories", "other"]


@register(
    "k20_describe",
    f"""WITH k AS (SELECT *, {_KINDS}[CAST(page_id % 16 + 1 AS INTEGER)] AS kind, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1)), '^www\\.', ''), ''), 'an unknown host') AS host,
               CASE WHEN page_id % 5 = 0 THEN 'creation date unknown' WHEN page_id % 100 > 72 THEN 'created on ' || strftime({_T} - to_hours(CAST(page_id % 100 AS INTEGER)), '%Y-%m-%d') || ', made visible long after its creation' ELSE 'created ' || CAST(page_id % 100 AS VARCHAR) || ' h ago' END AS made FROM pages)
        SELECT page_id, CASE kind WHEN 'sitemap' THEN 'New address in the sitemap of ' || host || ': t' WHEN 'changelog_md' THEN 'New changelog entry at ' || host || ': t' WHEN 'status_components' THEN 'New component on the status page ' || host || ': t, ' || made
          WHEN 'discourse_categories' THEN 'New category on the forum ' || host || ': t' WHEN 'openrouter_stealth' THEN 'New stealth model: t, ' || made WHEN 'litellm_prices' THEN 'New key in a price file: t, ' || made WHEN 'hf_org' THEN 'New hub repository: t, ' || made
          WHEN 'github_org' THEN 'New code repository: t, ' || made WHEN 'inference_pulls' THEN 'Pull request that adds a model: t, ' || made WHEN 'sirene' THEN 'New company in the register: t, ' || made WHEN 'edgar_form_d' THEN 'New filing: t, ' || made
          WHEN 'polymarket_events' THEN 'New prediction market: t, ' || made WHEN 'discord_widget' THEN 'New visible channel: t, ' || made WHEN 'other' THEN 'New entry: t' ELSE 'New team or postings: t, ' || made END AS reason FROM k""",
)
def describe(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % 16 + 1).cast("int"))
    at = F.when(F.col("page_id") % 5 != 0, F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - F.col("page_id") % 100 * 3_600_000_000))
    return table(spark, sf_dir, "pages").select("page_id", catalog.describe(kind, F.lit("t"), F.col("url"), at, NOW).alias("reason"))


@register(
    "k16_changed_states",
    """WITH b AS (SELECT page_id, sha256(html) AS old, sha256(CASE WHEN page_id % 7 = 0 THEN html || '<!-- new -->' ELSE html END) AS new FROM pages)
       SELECT page_id AS catalog_id, CASE WHEN page_id % 11 = 1 THEN old ELSE new END AS digest, page_id % 11 <> 1 AND (page_id % 13 = 2 OR new <> old) AS parsed FROM b WHERE NOT (page_id % 13 = 2 AND page_id % 11 = 1)""",
)
def changed_states(spark, sf_dir):
    """Pages read again: a seventh has changed, some can't be read, some are new; only changed and new ones are parsed."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("catalog_id"), "html")
    before = p.where("catalog_id % 13 <> 2").select("catalog_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    now = p.select("catalog_id", F.when(F.col("catalog_id") % 11 != 1, F.when(F.col("catalog_id") % 7 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html"))).alias("body"))
    changed, versions = catalog.changed_states(now, before)
    return versions.join(changed.select("catalog_id", F.lit(True).alias("parsed")), "catalog_id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))


# topics


@register("c9_pending", with_items("SELECT item_id FROM items WHERE item_id % 3 > 0 AND item_id % 4 <> 0"))
def pending(spark, sf_dir):
    i = fixture.items(spark, sf_dir).withColumn("relevant", F.col("item_id") % 3 > 0)
    return topics.pending(i, i.where("item_id % 4 = 0")).select("item_id")


@register(
    "c5_link_joins",
    with_items(
        f"""SELECT n.item_id, k.cluster_id, 1.0::DOUBLE AS sim FROM items n JOIN (SELECT url_canon, min(item_id % 100) AS cluster_id FROM items WHERE item_id % 3 = 0 AND url_canon IS NOT NULL AND NOT regexp_matches(url_canon, '{topics.HOME}') GROUP BY 1) k
            ON n.url_canon = k.url_canon WHERE n.item_id % 3 = 1"""
    ),
)
def link_joins(spark, sf_dir):
    m = members(spark, sf_dir)
    return topics.link_joins(m.where("item_id % 3 = 1").drop("cluster_id"), m.where("item_id % 3 = 0"))


def hashed(spark, sf_dir) -> DataFrame:
    i = fixture.items(spark, sf_dir)
    return vectors.with_hash_vectors(i.select("item_id", "evt_at", "kind", "url_canon", "source_id", "title", "text"), terms.cluster_text(F.col("title"), F.col("text"))).drop("text")


@register("c6_leader_clusters")
def leaders(spark, sf_dir):
    """All items in their order, with their addresses."""
    return topics.leader_clusters(hashed(spark, sf_dir)).select("item_id", "cluster_id")


#: (item_id, i, x): cells of the clustering texts' hashed vectors that aren't zero, before division by their length.
SQL_CELLS = rf"""
ct AS (SELECT item_id, trim(CASE WHEN head = '' OR starts_with(lower(head), lower(substr(title, 1, 40))) THEN title ELSE title || '. ' || head END, ' ') AS ct
       FROM (SELECT item_id, title, substr(coalesce(text, ''), 1, 200) AS head FROM items)),
gram AS (SELECT item_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || '_' || p[2]) ELSE [] END)) AS g
         FROM (SELECT item_id, list_filter(string_split({sql_name('ct')}, ' '), lambda t: t <> '') AS w FROM ct)),
hashes AS MATERIALIZED (SELECT g, list_reduce(list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM (SELECT DISTINCT g FROM gram)),
cells AS MATERIALIZED (SELECT item_id, h % 512 AS i, sum(CASE WHEN (h >> 31) = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM gram JOIN hashes USING (g) GROUP BY 1, 2 HAVING sum(CASE WHEN (h >> 31) = 1 THEN 1 ELSE -1 END) <> 0)"""


@register(
    "c6_threshold_topics",
    "WITH RECURSIVE " + SQL_ITEMS + "," + SQL_CELLS + f""",
    len AS (SELECT item_id, sum(x * x) AS n FROM cells GROUP BY 1),
    dots AS (SELECT a.item_id AS a, b.item_id AS b, sum(a.x * b.x) AS d FROM cells a JOIN cells b ON a.i = b.i AND a.item_id < b.item_id GROUP BY 1, 2),
    link AS MATERIALIZED (SELECT a, b FROM dots JOIN len x ON x.item_id = a JOIN len y ON y.item_id = b WHERE d / sqrt(x.n * y.n) >= {terms.JOIN}::DOUBLE),
    both_ways AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
    r AS (SELECT item_id AS id, item_id AS reached FROM items UNION SELECT r.id, b FROM r JOIN both_ways ON a = reached)
    SELECT id AS item_id, min(reached) AS cluster_id FROM r GROUP BY id""",
)
def threshold(spark, sf_dir):
    return topics.threshold_topics(hashed(spark, sf_dir))


@register(
    "c7_merge_topics",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_id AS a, event_id // 12 * 12 + (event_id * 5 + 3) % 12 AS b FROM events), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
        sy AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id AS reached FROM n UNION SELECT r.id, sy.b FROM r JOIN sy ON sy.a = r.reached),
        c AS (SELECT id, min(reached) AS comp FROM r GROUP BY 1), h AS (SELECT comp, arg_min(id, (-(id % 17), id)) AS merged_into FROM c GROUP BY 1)
        SELECT id AS cluster_id, merged_into FROM c JOIN h USING (comp)""",
)
def merge(spark, sf_dir):
    near = F.expr("event_id div 12 * 12 + (event_id * 5 + 3) % 12")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), near.alias("b")).distinct()
    t = e.select(F.col("a").alias("cluster_id")).union(e.select("b")).distinct().withColumn("n", F.col("cluster_id") % 17)
    return topics.merge_topics(t, e.withColumn("sim", F.lit(0.9)))


@register("c7_greedy_merge")
def greedy(spark, sf_dir):
    """Items as topics of different sizes, merged greedily: (cluster_id, merged_into, n)."""
    h = hashed(spark, sf_dir).select(F.col("item_id").alias("cluster_id"), (1 + F.col("item_id") % 17).alias("n"), "v")
    return topics.merge_greedy(h).select("cluster_id", "merged_into", "n")


@register(
    "c7_centroids",
    """WITH c AS (SELECT label AS cluster_id, i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), l AS (SELECT cluster_id, sqrt(sum(x * x)) AS l FROM c GROUP BY 1)
       SELECT cluster_id, CAST(i - 1 AS INTEGER) AS i, CAST(floor(x / l * 1e6 + 0.5) AS BIGINT) AS x_e6 FROM c JOIN l USING (cluster_id)""",
)
def centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.col("embedding").alias("v"))
    return topics.centroids(e).select("cluster_id", F.posexplode("v").alias("i", "x")).select("cluster_id", "i", F.floor(F.col("x") * 1e6 + 0.5).alias("x_e6"))


@register(
    "c8_topic_entities",
    with_items(
        f"""SELECT cluster_id, string_agg(entity, ',' ORDER BY k) AS entities FROM (SELECT cluster_id, entity, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS k FROM (
              SELECT item_id % 100 AS cluster_id, entity, count(*) AS n FROM (SELECT item_id, unnest({SQL_ENTITIES}) AS entity FROM items) GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1"""
    ),
)
def topic_entities(spark, sf_dir):
    m = members(spark, sf_dir).select("cluster_id", F.explode(terms.entities(F.col("text"), LEX)).alias("entity"))
    return topics.topic_entities(m).withColumn("entities", F.array_join("entities", ","))


@register(
    "c8_topic_labels",
    with_items("SELECT cluster_id, CASE WHEN cluster_id % 4 = 0 THEN 'kept' ELSE title END AS label FROM (SELECT item_id % 100 AS cluster_id, title, row_number() OVER (PARTITION BY item_id % 100 ORDER BY score_raw DESC, item_id) AS k FROM items WHERE family <> 'G') WHERE k = 1"),
)
def topic_labels(spark, sf_dir):
    m = members(spark, sf_dir)
    return topics.topic_labels(m, m.where("cluster_id % 4 = 0").select("cluster_id", F.lit("kept").alias("label")).distinct())


# press


@register(
    "c10_press_match",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
       SELECT a.vec_id AS article_id, m.vec_id % 20 AS cluster_id, CAST(floor(max(list_inner_product(a.v, m.v)) * 1e6 + 0.5) AS BIGINT) AS sim_e6 FROM v a JOIN v m USING (label) WHERE a.vec_id % 5 = 0 GROUP BY 1, 2 HAVING max(list_inner_product(a.v, m.v)) >= 0.60""",
)
def press_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    a = e.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "article_id")
    out = press.best_match(a, e.select((F.col("vec_id") % 20).alias("cluster_id"), "label", "v"), ["label"])
    return out.select("article_id", "cluster_id", F.floor(F.col("sim") * 1e6 + 0.5).alias("sim_e6"))


@register(
    "p1_coverage",
    f"""WITH a AS (SELECT user_id % 80 AS cluster_id, CAST(event_id % 500 AS VARCHAR) AS url, min(ts) AS pub FROM events WHERE ts >= {_T} - INTERVAL 7 DAY GROUP BY 1, 2),
        c AS (SELECT cluster_id, count(*) AS n_7d, count(*) FILTER (pub >= {_T} - INTERVAL 24 HOUR) AS n_24h, min(pub) AS first_at, max(pub) AS last_at, string_agg(url, ',' ORDER BY pub, url) FILTER (k <= 5) AS samples
              FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pub, url) AS k FROM a) GROUP BY 1),
        i AS (SELECT user_id % 90 AS cluster_id, count(*) // 100 AS n FROM events GROUP BY 1)
        SELECT cluster_id, n_7d, n_24h, first_at, last_at, samples, greatest(coalesce(n, 0), coalesce(n_7d, 0)) AS n, CASE WHEN greatest(coalesce(n, 0), coalesce(n_7d, 0)) >= 3 THEN 'CONFIRMED' WHEN greatest(coalesce(n, 0), coalesce(n_7d, 0)) >= 1 THEN 'LIGHT_PRESS' ELSE 'ANTICIPATION' END AS status
        FROM i FULL JOIN c USING (cluster_id)""",
)
def coverage(spark, sf_dir):
    e = fixture.events(spark, sf_dir)
    m = e.select((F.col("user_id") % 80).alias("cluster_id"), (F.col("event_id") % 500).cast("string").alias("url"), F.lit("t").alias("title"), F.col("ts").alias("published_at"))
    c = e.groupBy((F.col("user_id") % 90).alias("cluster_id")).agg(F.expr("count(*) div 100").alias("n"))
    return press.coverage(m, c, NOW).withColumn("samples", F.array_join("samples", ","))


_NAMES = str([n for n, kind, _ in LEX.entities if kind not in ("TOPIC", "REGULATION")])
_NEVER, _STOP = str(sorted({*LEX.stop, *LEX.generic})), str(list(LEX.stop))


@register(
    "r9_press_query",
    with_items(
        f"""SELECT cluster_id, array_to_string(list_concat(tm, list_filter(string_split({sql_name("coalesce(label, '')")}, ' '), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w) AND len(list_filter(tm, lambda x: contains(lower(x), w))) = 0))[1:2], ' ') AS query FROM q""",
        f"""mem AS (SELECT *, item_id % 100 AS cluster_id FROM items),
        wd AS (SELECT cluster_id, item_id, unnest(list_distinct(list_filter(regexp_extract_all(coalesce(title, ''), '{terms.TITLE_WORD}'),
                 lambda x: length(x) >= 3 AND (regexp_matches(x, '^[A-Z]') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AND NOT list_contains({_NEVER}, lower(x))))) AS w FROM mem),
        fr AS (SELECT cluster_id, lower(w) AS lw, arg_min(w, (item_id, w)) AS w, count(DISTINCT item_id) AS n FROM wd GROUP BY 1, 2),
        rk AS (SELECT fr.*, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, lw) AS r FROM fr JOIN (SELECT cluster_id, count(*) AS c FROM mem GROUP BY 1) USING (cluster_id) WHERE n >= CASE WHEN c >= 3 THEN 2 ELSE 1 END),
        pr AS (SELECT cluster_id, list(w ORDER BY r) AS proper FROM rk WHERE r <= 2 GROUP BY 1),
        en AS (SELECT cluster_id, list(entity ORDER BY k) AS ents FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS k FROM (
                 SELECT cluster_id, entity, count(*) AS n FROM (SELECT cluster_id, unnest({SQL_ENTITIES}) AS entity FROM mem) GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1),
        t AS (SELECT cluster_id, label, coalesce(proper, []) AS proper, coalesce(ents, []) AS ents FROM (SELECT cluster_id, arg_min(title, item_id) AS label FROM mem GROUP BY 1) LEFT JOIN pr USING (cluster_id) LEFT JOIN en USING (cluster_id)),
        q AS (SELECT cluster_id, label, list_concat(proper, list_transform(list_filter(ents, lambda e: list_contains({_NAMES}, e) AND len(list_filter(proper, lambda p: contains({sql_name('e')}, lower(p)))) = 0), lambda e: '"' || e || '"'))[1:2] AS tm FROM t)""",
    ),
)
def press_query(spark, sf_dir):
    m = members(spark, sf_dir)
    ents = topics.topic_entities(m.select("cluster_id", F.explode(terms.entities(F.col("text"), LEX)).alias("entity")))
    labels = m.groupBy("cluster_id").agg(F.min_by("title", "item_id").alias("label"))
    return press.press_query(m, labels.join(ents, "cluster_id", "left"), LEX)
