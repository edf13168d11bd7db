"""The pipeline's stages, one after the other, against brute force on what each was given."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from test_operators import DOCS, ODD, base_brute, check_packing, near_brute
from tidewatch.llm import common, quality, toxicity
from tidewatch.llm.common import written


@pytest.fixture(scope="module")
def kept(spark, data):
    """What each stage gives, the input first."""
    out = [common.read(spark, data, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], data)))
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "minhash near-dedup", "mixing sources", "best-fit packing"]


def test_columns_of_documents_stay(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])


def test_toxic_documents_go(spark, data, kept):
    model = toxicity.train(kept[0], toxicity.label_grades(common.read(spark, data, "labels")))
    toxic = {r.doc_id for r in toxicity.severity(kept[0], model).where("toxic").collect()}
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in kept[0].collect()} - toxic


def test_poor_documents_go(spark, data, kept):
    trusted = common.read(spark, data, "labels").where("quality = 1").select("doc_id")
    score = {r.doc_id: r.score for r in quality.quality(kept[1], quality.log_ratios(kept[1], trusted)).collect()}
    want = {r.doc_id for r in kept[1].collect() if not base_brute(r.text)[5] and score[r.doc_id] >= quality.THRESHOLD}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_one_of_each_group_stays(kept):
    docs = [(r.doc_id, r.text) for r in kept[2].collect()]
    want = [i for i, _ in docs if str((i, len(_shingles(dict(docs)[i])), i, True)) in set(near_brute(docs))]
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(want)


def _shingles(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_mix_repeats_whole_documents(kept):
    before = {r.doc_id for r in kept[3].collect()}
    after = collections.Counter(r.doc_id for r in kept[4].collect())
    assert set(after) <= before and max(after.values()) <= 2


def test_everything_is_packed(spark, data, kept):
    rows = [r.asDict() for r in kept[5].collect()]
    check_packing(rows, 4096)
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(r.doc_id for r in kept[4].collect())
    whole = [(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, data).collect()]
    assert sorted(whole) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)


def test_odd_and_empty_documents(spark, data):
    for rows in (ODD, []):
        docs, given = spark.createDataFrame(rows, DOCS), len(rows)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = written(stage(spark, docs, data))
            left = docs.count()
            if name == "best-fit packing":
                assert left == 0 if not given else left >= given
            else:
                assert docs.columns == columns and left <= (2 if name == "mixing sources" else 1) * given
                assert name != "quality rules" or not docs.where("text is null or text in ('', 'one')").count()
            given = left


def test_maps_and_repeated_ids_in_dedup(spark, data):
    docs = spark.sql("SELECT id % 2 AS doc_id, concat('a text of five words ', id) AS text, map('k', id) AS more FROM range(6)")
    kept = corpus_pipeline.drop_copies(spark, docs, data)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "a text of five words 0"), (1, "a text of five words 1")]


def test_repeated_rows_count_once_in_dedup(spark, data):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(2, text, 1), (2, text, 1), (3, text, 1), (None, text, 1)], "doc_id long, text string, kept int")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_copies(spark, docs, data).collect()) == ["2", "None"]
