"""A training corpus from ``documents``: reject toxic and poor texts, drop near copies, mix sources, pack.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return rows with the columns they were
given; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidewatch.llm import mixing, neardup, packing, quality, toxicity
from tidewatch.llm.common import read, written
from tidewatch.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above 0 stays below the operator's cut.

    Null and empty texts have the base rate's probability and stay, unless that reaches the cut; null ids and
    repeated rows are judged by their texts, each row for itself; an empty table stays empty.
    """
    model = toxicity.train(docs, toxicity.label_grades(read(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, the trusted ones being those labelled as good.

    Null and empty texts have too few words and go; null ids and repeated rows are judged by their texts,
    each row for itself, and count as often in the statistics; an empty table stays empty.
    """
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.keep(docs, quality.log_ratios(docs, trusted))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component stays, and one of its rows if the id is repeated; rows without an id stay.

    Null and empty texts are copies of nothing and stay. Of rows with one id, the first in the order of all
    columns that have one (maps don't) stays.
    """
    kept = written(neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct())
    # whole rows as one column, so that no column of theirs can clash with one of ours
    known = docs.where("doc_id is not null").select("doc_id", F.struct(*docs.columns).alias("_row")).join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*[f"_row.`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    one = known.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("_row.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    Null and empty texts have no words and are taken by their hash like others; null sources are one source;
    equal rows are told apart by their place; an empty table stays empty.
    """
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences: each row, repeated or without an id, is packed for itself; null texts
    are empty documents of one token; an empty table gives no pieces."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("minhash near-dedup", drop_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The fitted models, minhashes and the search for a packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
