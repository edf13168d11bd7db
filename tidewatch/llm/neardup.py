"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification, components.

1. One pass over the texts makes each document's set of 5-word shingles (64-bit hashes), a 128-bit
   fingerprint of the set and 128 minhashes. Documents with equal fingerprints form a class; only the class's
   smallest id goes on.
2. 32 bands of 4 minhashes give buckets. In each bucket all members are compared with one hub, the member
   with the most bucket mates overall, so that a group of n copies costs n pairs.
3. Pairs are compared in batches of minhashes; after each batch a pair is dropped when the posterior
   probability that its similarity reaches the threshold falls below ``miss``. Survivors are verified on
   their full sets, and links are joined to components.
4. Buckets whose members are still in more than one component are compared completely, in blocks, across
   components only, with the same test; the links found are verified and added. No bucket size is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mentioned, word_bytes, written
from .graph import components

WORDS = 5
THRESHOLD = 0.75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Minhashes compared between two decisions, and the accepted probability of dropping a pair that is a link.
STEP, MISS = 32, 1e-5
#: Bucket members in one block of the complete comparison.
BLOCK = 128

_P = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(32)
_rng = np.random.default_rng(20240101)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none an empty set."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < WORDS:
        x = np.array([n], np.uint64)
        for k in range(n):
            x = (x ^ h[k : k + 1]) * _P
            x ^= x >> _S
        return x
    x = h[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        x *= _P
        x ^= x >> _S
        x ^= h[k : n - WORDS + 1 + k]
    x *= _P
    x ^= x >> _S
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minhash: unequal ones agree by chance once in 65,536 times."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 1024):
        part = ((s[None, i : i + 1024] * _A[:, None] + _B[:, None]) >> _S).min(axis=1).astype(np.uint32)
        np.minimum(out, part, out=out)
    return out.astype(np.uint16)


@lru_cache(maxsize=16)
def keep_from(threshold: float, step: int, total: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared minhashes, a pair needs m equal ones.

    Under a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(step, total, step), total]:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _survive(a: np.ndarray, b: np.ndarray, rule) -> np.ndarray:
    """Row numbers of the pairs that pass every batch; each batch looks at what the last one left."""
    left, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in rule:
        equal = equal + (a[left, done:n] == b[left, done:n]).sum(axis=1, dtype=np.int32)
        ok = equal >= least
        left, equal, done = left[ok], equal[ok], n
    return left


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp, sig) of each row; fp and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sig, known = [], [], [], {}
            for text in batch.column("text").to_pylist():
                s = shingle_set(word_bytes(text))
                n.append(len(s))
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if key is not None and key not in known:
                    known[key] = signature(s).tobytes()
                fp.append(key)
                sig.append(known.get(key))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "fp", "sig"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, fp binary, sig binary")


def _column(batch: pa.RecordBatch, name: str, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)


def _prune(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures pass every Bayesian test."""
    rule = keep_from(threshold, STEP, HASHES, miss)
    sig = reps.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = _survive(_column(batch, "sig_a", np.uint16, HASHES), _column(batch, "sig_b", np.uint16, HASHES), rule)
                yield batch.select(["a", "b"]).take(pa.array(left))

    kind = reps.schema["id"].dataType.simpleString()
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def _sets(docs: DataFrame, ids: DataFrame, kind=np.uint64) -> DataFrame:
    """(id, items): the sorted shingle hashes, cut to ``kind``, of the documents in ``ids`` (id, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.unique(shingle_set(word_bytes(t)).astype(kind)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["id", "items"])

    some = mentioned(docs.select("doc_id", "text"), ids)
    return some.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, items binary").join(ids, "id", "left_semi")


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold, in whole per cents or thousandths."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y) or len(y) < threshold * len(x) - 1:
        return False
    at = np.searchsorted(x, y)
    common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
    return 1000 * common >= round(1000 * threshold) * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold, as (u, v)."""
    pairs = written(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("items_a"), batch.column("items_b"))
            keep = [i for i, (x, y) in enumerate(sets) if _alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["u", "v"])

    full = _sets(docs, ids)
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a").join(
        full.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b"
    )
    return both.select("a", "b", "items_a", "items_b").mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _crossing(members: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and look like links.

    Only buckets of three and more members that are in several components take part. Each is dealt into
    blocks of about ``BLOCK`` members and a task sees two blocks at a time. A pair is looked at in the first
    band that it shares; one that passes the Bayesian test is compared on its sets, with hashes cut to 32
    bits and a little slack, so that only pairs that are almost surely links become rows.
    """
    kind = reps.schema["id"].dataType.simpleString()
    ids = to_arrow_type(reps.schema["id"].dataType)
    rule = keep_from(threshold, STEP, HASHES, miss)
    placed = members.where("c > 2").join(comp, "id", "left").select("key", "band", "c", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    placed = written(placed.join(mixed, "key"))
    wanted = placed.select("id").distinct()
    full = _sets(docs, wanted, np.uint32).join(reps.select("id", "sig"), "id")
    rows = placed.join(full, "id").withColumn("n_blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    packed = written(
        rows.groupBy("key", "band", "n_blocks", F.pmod(F.xxhash64("id", F.lit(7)), "n_blocks").cast("int").alias("block")).agg(
            F.collect_list(F.struct("id", "comp", "sig", "items")).alias("m")
        ),
        "lz4",
    )
    left = packed.select("key", "band", "block", F.col("m").alias("x"), F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)).alias("other"))
    pairs = left.join(packed.select("key", F.col("block").alias("other"), F.col("m").alias("y")), ["key", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column("band")[i].as_py()
                sides = []
                for side in ("x", "y"):
                    v = batch.column(side)[i].values
                    sig = np.frombuffer(b"".join(v.field("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
                    sides.append((np.array(v.field("id").to_pylist()), np.array(v.field("comp").to_pylist()), sig, v.field("items")))
                (ix, cx, sx, fx), (iy, cy, sy, fy) = sides
                a, b = [], []
                p, q = np.nonzero(cx[:, None] != cy[None, :])
                for at in range(0, len(p), 8192):
                    s, t = p[at : at + 8192], q[at : at + 8192]
                    ok = _survive(sx[s], sy[t], rule)
                    s, t = s[ok], t[ok]
                    shared = (sx[s] == sy[t]).reshape(-1, BANDS, ROWS).all(axis=2)
                    ok = shared.argmax(axis=1) == band
                    for j, k in zip(s[ok].tolist(), t[ok].tolist()):
                        if _alike(np.frombuffer(fx[j].as_py(), np.uint32), np.frombuffer(fy[k].as_py(), np.uint32), threshold - 0.005):
                            a.append(min(ix[j], iy[k]).item())
                            b.append(max(ix[j], iy[k]).item())
                yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    return pairs.select("band", "x", "y").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, anything else).

    Two documents are linked when 100 * intersection >= 100 * threshold * union of their sets of 5-word
    shingles; ``component_id`` is the smallest doc_id that links reach, ``kept`` says that it is the row's own.

    Null or empty texts and texts without a word have no shingles, are linked with nothing and kept. Rows
    with a null doc_id are not linked, have a null component and are kept. Rows that share a doc_id count as
    one document that has all their links. Equal sets cost one comparison however many rows hold them. An
    empty table gives an empty result; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sketches = written(sketch(docs), "lz4")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    reps = written(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig")), "lz4")

    keys = F.array(*[F.xxhash64(F.substring("sig", 1 + 2 * ROWS * j, 2 * ROWS), F.lit(j)) for j in range(BANDS)])
    bands = reps.select("id", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = written(bands.join(buckets, "key"))
    mates = members.groupBy("id").agg(F.sum("c").alias("mates"))
    hubs = members.join(mates, "id").groupBy("key").agg(F.min(F.struct(-F.col("mates"), F.col("id"))).alias("h")).select("key", F.col("h.id").alias("hub"))
    pairs = members.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()

    links = written(_verify(_prune(pairs, reps, threshold, miss), docs, threshold))
    first = components(links)
    more = _verify(_crossing(members, first, reps, docs, threshold, miss), docs, threshold)
    final = written(components(links.unionByName(more)))

    classes = reps.select("fp", "id").join(final, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
