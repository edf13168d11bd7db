"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, license_scan, mixing, neardup, packing, quality, resampling, token_counts, topk, toxicity, url_filters, vector_codes, warc
from .common import read

QUERIES: dict = {}
ORACLES: dict = {}

#: DuckDB: the words of a text, null counting as none.
SQL_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op2_warc_revisits")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ratios = quality.log_ratios(docs, labels.where("quality = 1").select("doc_id"))
    return quality.quality(docs, ratios)


#: Rules of the contract, and globs that decide where none of them fits.
URL_RULES = [
    url_filters.prefix_rule("com/en/", "block"),
    url_filters.prefix_rule("example.com/en/7", "allow"),
    url_filters.prefix_rule("net/de/", "allow"),
    url_filters.prefix_rule("example.net/de/8", "block"),
    url_filters.prefix_rule("org/es/", "block"),
]
#: What the method itself blocks: words in hosts and at the beginning of a path's parts, kinds of files that are
#: no pages, hosts and folders of advertising and counting, and folders that lead nowhere.
BAD_WORDS = (
    "casino cheap-pills spam jackpot poker roulette slots betting sportsbook lottery sweepstake pharmacy-online no-prescription weight-loss-pill miracle-cure "
    "payday-loan fast-cash easy-money get-rich forex-signal crypto-giveaway double-your work-from-home-now replica-watch fake-id counterfeit essay-mill buy-followers "
    "buy-likes link-farm doorway warez keygen serial-crack nulled torrent free-movies-hd stream-free xxx porn escort hentai camgirl adult-dating hookup malware phishing "
    "ransom botnet exploit-kit stresser carding"
).split()
FILES = "exe msi dmg apk jar bin iso img zip rar 7z tar gz bz2 xz mp3 mp4 avi mov mkv wmv flac wav ogg webm jpg jpeg png gif bmp webp svg ico css js woff woff2 ttf eot".split()
COUNTERS = "ad ads adserver adclick banner beacon click counter pixel popunder track tracker telemetry".split()
DEAD_ENDS = "login signin signup register logout cart checkout wishlist print-version share-this comment-reply wp-admin wp-login cgi-bin calendar-view session-expired".split()
URL_GLOBS = [
    url_filters.Rule(f"{kind}: {word}", host, path, "block")
    for kind, words, shapes in (
        ("word in host", BAD_WORDS, [("*.*{}*", "*")]),
        ("word in path", BAD_WORDS, [("*", "*/{}*")]),
        ("file", FILES, [("*", "*.{}")]),
        ("counter", COUNTERS, [(".{}.*", "*"), (".{}?.*", "*"), ("*", "*/{}/*")]),
        ("dead end", DEAD_ENDS, [("*", "*/{}"), ("*", "*/{}/*"), ("*", "*/{}.*")]),
    )
    for host_form, path_form in shapes
    for word in words
    for host, path in [(host_form.format(word), path_form.format(word))]
]
SQL_GLOBS = ", ".join(f"('{r.host}', '{r.path}')" for r in URL_GLOBS)


@query(
    "op4_url_filters",
    rf"""
    WITH u AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
        FROM pages),
    r AS (
        SELECT * FROM (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                              ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')) t(rule, h, p, v)),
    m AS (
        SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
        FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY ALL),
    g AS (
        SELECT DISTINCT page_id FROM u, (VALUES {SQL_GLOBS}) t(h, p) WHERE ('.' || host) GLOB h AND path GLOB p)
    SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, CASE WHEN u.page_id IN (FROM g) THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN m USING (page_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS).drop("hits")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, langid.remainder() != 2)
    held_out = F.coalesce(langid.remainder() == 2, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.severity(docs, toxicity.train(docs, toxicity.label_grades(labels)))


@query(
    "op8_mixing",
    rf"""
    WITH d AS (
        SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size,
               substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 18) AS h
        FROM documents),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
        FROM d GROUP BY source),
    r AS (
        SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source)) AS k FROM s),
    l AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                  / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
    t AS (
        SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 'inf'::DOUBLE) * w) AS target FROM l),
    p AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
    g AS (
        SELECT *, row_number() OVER (PARTITION BY source, h) AS equal_row FROM d),
    c AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, equal_row) AS after FROM g),
    x AS (
        SELECT c.doc_id, c.source, c.size, p.source_size, p.target, p.passes,
               after <= target - passes * source_size
               OR (after - size <= target - passes * source_size AND after - (target - passes * source_size) <= target - passes * source_size - (after - size)) AS once_more
        FROM c JOIN p ON p.source IS NOT DISTINCT FROM c.source)
    SELECT doc_id, source, size, source_size, target, CAST(size * least(passes + CASE WHEN once_more THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken FROM x
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query(
    "op9_exact_top_k",
    r"""
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
    s AS (
        SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op10_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    e AS (SELECT doc_id, unnest(s) AS g FROM s),
    i AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (
        SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
        WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
    u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (
        SELECT doc_id AS id, doc_id AS reached FROM s
        UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached),
    m AS (SELECT id, min(reached) AS c FROM r GROUP BY id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
    FROM s JOIN m ON m.id = s.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query("op11_license_scans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("detections")


def _sql_codes(rounds: int) -> str:
    """DuckDB: codebooks round by round, with distances as |q|^2 - 2 qc + |c|^2 of whole doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    n{r} AS MATERIALIZED (
        SELECT k, part, any_value(q) AS q, arg_min(entry, (list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c), entry)) AS entry,
               min(list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c)) AS d
        FROM p JOIN c{r} USING (part) GROUP BY k, part)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM (
        SELECT part, entry, i, floor(sum(q[i]) / count(*)) AS x FROM n{r}, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(q) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (part, entry))""")
    return ",".join(steps)


@query(
    "op12_vector_codes",
    f"""
    WITH x AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
    p AS MATERIALIZED (SELECT k, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS q FROM x, range(4) t(part)),
    c0 AS MATERIALIZED (SELECT part, k - 1 AS entry, q AS c FROM p WHERE k <= {vector_codes.ENTRIES}),{_sql_codes(vector_codes.ROUNDS)},
    b AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
          FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM c{vector_codes.ROUNDS})),
    f AS (SELECT k, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{vector_codes.ROUNDS} GROUP BY k)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM x JOIN f USING (k), b
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


#: DuckDB: the words of a lower-cased text for operators 11 and 13.
SQL_TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
#: DuckDB: CRC-32 of a column ``w``, byte by byte, from a table that follows from its polynomial.
SQL_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
SQL_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, CAST(strlen(w) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)))"


@query(
    "op13_target_resampling",
    rf"""
    WITH {SQL_CRC_TABLE},
    d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, {SQL_TERMS} AS w FROM documents),
    b AS MATERIALIZED (SELECT {SQL_TERMS} AS w FROM benchmark),
    e AS MATERIALIZED (SELECT k, unnest(w) AS w FROM d),
    f AS MATERIALIZED (SELECT unnest(w) AS w FROM b),
    h AS MATERIALIZED (SELECT w, {SQL_CRC} % 10000 AS bucket FROM (SELECT w FROM e UNION SELECT w FROM f), crc),
    s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (w) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS t FROM f JOIN h USING (w) GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM e)::DOUBLE AS s_all, (SELECT count(*) FROM f)::DOUBLE AS t_all),
    g AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
        FROM s FULL JOIN t USING (bucket), n),
    m AS (SELECT k, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN h USING (w) JOIN g USING (bucket) GROUP BY k),
    x AS (
        SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
               CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM d LEFT JOIN m USING (k)),
    y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM r WHERE n_features >= 20) // 100 THEN place END AS rank FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
