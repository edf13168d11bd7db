"""Press coverage of topics, from a table of articles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import Lexicon, is_name, norm_name, title_words
from ..functions.text import norm_name_plain
from .items import _at

PRESS_MATCH = 0.60
#: Rows of one product.
PRODUCT_ROWS = 512


def best_match(articles: DataFrame, members: DataFrame, by: list[str], block: int = 2048) -> DataFrame:
    """(article_id, cluster_id, sim) of articles whose nearest member vector of the topic reaches ``PRESS_MATCH``.

    Articles and members of equal ``by`` lie in blocks of bounded size, and two blocks are one matrix product in a
    task: only the best of an article and topic in a pair of blocks is a row. All pairs of equal ``by`` are compared;
    null ids and vectors are left out.
    """
    a = _blocks(articles.select("article_id", *by, "v"), "article_id", by, block, "a")
    m = _blocks(members.select("cluster_id", *by, "v"), "cluster_id", by, block, "m")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                ids, clusters = (np.frombuffer(r[k], np.int64) for k in ("a_ids", "m_ids"))
                va, vm = (np.frombuffer(r[k], np.float64).reshape(len(x), -1) for k, x in (("a_v", ids), ("m_v", clusters)))
                # members lie in the order of their topics, so each topic is a range of columns
                topics, starts = np.unique(clusters, return_index=True)
                for begin in range(0, len(ids), PRODUCT_ROWS):
                    best = np.maximum.reduceat(va[begin : begin + PRODUCT_ROWS] @ vm.T, starts, axis=1)
                    i, j = np.nonzero(best >= PRESS_MATCH)
                    yield pd.DataFrame({"article_id": ids[begin + i], "cluster_id": topics[j], "sim": best[i, j]})

    # a block is some MB, so pairs of blocks go to Python a few at a time
    pairs = a.join(m, by).select("a_ids", "a_v", "m_ids", "m_v")
    found = pairs.mapInPandas(run, "article_id long, cluster_id long, sim double")
    return found.groupBy("article_id", "cluster_id").agg(F.max("sim").alias("sim")).where(F.col("sim") >= PRESS_MATCH)


def _blocks(rows: DataFrame, key: str, by: list[str], block: int, name: str) -> DataFrame:
    """(by, ids, v): at most about ``block`` keys and vectors of equal ``by``, packed in the order of the keys."""
    rows = rows.where(F.col("v").isNotNull()).withColumn("v", F.col("v").cast("array<double>")).dropna(subset=[key, *by])
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("_parts"))
    dealt = rows.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64(key, "v"), F.col("_parts")))

    def pack(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, f"{name}_ids": pdf[key].to_numpy(np.int64).tobytes(), f"{name}_v": v.tobytes()}])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return dealt.groupBy(*by, "_part").applyInPandas(pack, f"{kinds}, {name}_ids binary, {name}_v binary")


def coverage(matched: DataFrame, collected: DataFrame, now, samples: int = 5) -> DataFrame:
    """Per topic: articles of 7 days and 24 hours by distinct address, first and last, samples, and the status.

    ``matched`` is (cluster_id, url, title, published_at), ``collected`` (cluster_id, n) what items already
    hold; the count is the larger of both. Three make CONFIRMED, one LIGHT_PRESS, none ANTICIPATION.
    """
    now = _at(now)
    one = matched.where(F.col("published_at") >= now - F.expr("INTERVAL 7 DAYS")).groupBy("cluster_id", "url").agg(F.min("published_at").alias("published_at"), F.min("title").alias("title"))
    order = Window.partitionBy("cluster_id").orderBy("published_at", "url")
    first = one.withColumn("_r", F.row_number().over(order))
    out = first.groupBy("cluster_id").agg(
        F.count("*").alias("n_7d"),
        F.count_if(F.col("published_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("n_24h"),
        F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= samples, F.struct("_r", "url")))), lambda x: x["url"]).alias("samples"),
    )
    out = collected.join(out, "cluster_id", "full_outer").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("n_7d", F.lit(0))))
    return out.withColumn("status", F.when(F.col("n") >= 3, "CONFIRMED").when(F.col("n") >= 1, "LIGHT_PRESS").otherwise("ANTICIPATION"))


def press_query(members: DataFrame, topics: DataFrame, lex: Lexicon) -> DataFrame:
    """(cluster_id, query): at most two search terms for each topic.

    The most frequent capitalised words of its titles (in two titles at least, if there are three), then
    entities that are names, then words of the label.
    """
    never = F.lit(sorted({*lex.stop, *lex.generic}))
    good = F.filter(F.array_distinct(title_words(F.col("title"))), lambda w: is_name(w) & ~F.array_contains(never, F.lower(w)))
    n_items = members.groupBy("cluster_id").agg(F.count("*").alias("n_items"))
    w = members.select("cluster_id", "item_id", F.explode(good).alias("w")).dropDuplicates(["cluster_id", "item_id", "w"])
    freq = w.groupBy("cluster_id", F.lower("w").alias("lw")).agg(F.min_by("w", F.struct("item_id", "w")).alias("w"), F.count_distinct("item_id").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "lw")
    freq = freq.join(n_items, "cluster_id").where(F.col("n") >= F.when(F.col("n_items") >= 3, 2).otherwise(1)).withColumn("r", F.row_number().over(order)).where("r <= 2")
    proper = freq.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("proper"))
    names = F.lit([n for n, kind, _ in lex.entities if kind not in ("TOPIC", "REGULATION")])
    t = topics.join(proper, "cluster_id", "left").withColumn("proper", F.coalesce("proper", F.array().cast("array<string>")))

    def said(x: Column) -> Column:
        return F.exists("proper", lambda p: F.contains(norm_name_plain(x), F.lower(p)))

    named = F.transform(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.array_contains(names, e) & ~said(e)), lambda e: F.concat(F.lit('"'), e, F.lit('"')))
    terms = F.slice(F.concat("proper", named), 1, 2)
    stop = F.lit(list(lex.stop))
    label = F.filter(F.split(norm_name(F.coalesce("label", F.lit(""))), " "), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w) & ~F.exists(terms, lambda x: F.contains(F.lower(x), w)))
    return t.select("cluster_id", F.array_join(F.slice(F.concat(terms, label), 1, 2), " ").alias("query"))
