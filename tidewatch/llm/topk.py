"""Exact top-k by integer inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it; the rows of a pivot, sorted by distance, are
cut into annuli of about equal size, which are stored in blocks. For a query q and a vector x of an annulus
around pivot p, the triangle inequality gives |q - x| >= gap, the distance between d(q, p) and the annulus, and
so q.x <= (|q|^2 + |x|^2 - gap^2) / 2. The annuli of each block of queries are visited in the order of this bound,
in rounds that grow, and the search ends when no bound reaches the k-th best score known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
#: Rows of an annulus block and of a query block.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Pivots grow with the square root of the number of blocks, up to this many; they are a sample of rows.
MOST_PIVOTS = 1024
#: Cells of a pivot's histogram of distances, the finest annuli there are; larger ones are split by hash.
CELLS = 256
#: Annulus blocks that each query block visits in the first round, and how much the rounds grow.
FIRST, GROWTH = 2, 8
#: Relative error of a bound in floating point, with a wide margin; sums of squares are the scale.
SLACK = 1e-9
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) / scale, so that those of any finite size are exact doubles.

    ``scale`` is a power of two. Vectors that are null, or hold a null, NaN or infinity, are left out; so are
    vectors without an id, which can't be named.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    # from 2^40 on, scale * x is a whole number for scales up to 4,096
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**40, F.floor(c * F.lit(float(scale))).cast("double") / F.lit(float(scale))).otherwise(c))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine).select("vec_id", whole.alias("v"))


def _units(m: np.ndarray, scale: int) -> np.ndarray:
    """The whole numbers scale * v: as doubles, or as Python integers where these would be too large."""
    if np.abs(m).max(initial=0) < 2.0**1000:
        return m * scale
    return np.array([[int(c) * scale if abs(c) >= 2.0**40 else int(c * scale) for c in r] for r in m], object).reshape(m.shape)


def _matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Rows as doubles; shorter ones are filled with zeros, which leaves inner products as they are."""
    width = max((len(r) for r in rows), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pack(v: np.ndarray, scale: int) -> bytes:
    """A vector's bytes: a mark, and its whole numbers in 16 bits where they fit, else its components as doubles."""
    return b"\0" + (v * scale).astype(np.int16).tobytes() if not len(v) or np.abs(v).max() < 2**15 / scale else b"\1" + v.tobytes()


def _unpack(rows: list[bytes], scale: int) -> np.ndarray:
    if len({(r[0], len(r)) for r in rows}) == 1:
        flat = np.ascontiguousarray(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:])
        return flat.view(np.float64).astype(np.float64) if rows[0][0] else flat.view(np.int16) / float(scale)
    return _matrix([np.frombuffer(r, np.float64, offset=1) if r[0] else np.frombuffer(r, np.int16, offset=1) / float(scale) for r in rows])


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == n else np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (a, b))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where all sums stay below 2^53, in 64-bit integers
    below 2^63, else in Python integers; results that a long can't hold are its ends."""
    q, x = _even(q, x)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most <= LONG:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(exact(q).dot(exact(x).T), -LONG, LONG).astype(np.int64)


@dataclass(frozen=True)
class Measure:
    """How lengths, distances and bounds are taken: of whole numbers times 2^-shift, so that all squares are finite.

    Up to 2^400 nothing is shifted. Beyond, what small vectors lose to underflow is made up for by a bound that is too
    high, so fewer blocks are excluded, and never one that matters.
    """

    scale: int
    shift: int

    @staticmethod
    def of(table: DataFrame, scale: int) -> Measure:
        top = table.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()["top"] or 1.0
        return Measure(scale, max(0, math.frexp(top)[1] - 400))

    def taken(self, m: np.ndarray) -> np.ndarray:
        return np.ldexp(m, -self.shift) * self.scale

    def bound(self, q_norm, norm, gap, reach):
        """Above every product of a query and a vector with these squared lengths whose distance is ``gap`` or more."""
        part = (q_norm + norm - gap * gap) / 2 + SLACK * (q_norm + norm + reach * reach)
        return part + 1 if not self.shift else (part + 2.0**-900) * 2.0**self.shift * 2.0**self.shift + 1


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(row, pivot): by squares where their sums are exact, else by differences, which don't cancel."""
    m, p = _even(m, pivots)
    most = max(np.abs(m).max(initial=0), np.abs(p).max(initial=0))
    if 4 * most * most * max(m.shape[1], 1) < 2**53:
        return np.sqrt((m * m).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (m @ p.T))
    return np.stack([np.sqrt(((m - c) ** 2).sum(1)) for c in p], axis=1)


def _keyed(table: DataFrame, pivots: np.ndarray, measure: Measure) -> DataFrame:
    """(vec_id, v, pivot, r, norm): packed vector, nearest pivot, distance to it and squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = [np.array(x, np.float64) for x in batch.column("v").to_pylist()]
                m = measure.taken(_matrix(v))
                d = _distances(m, measure.taken(pivots))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array((_pack(x, measure.scale) for x in v), pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array((m * m).sum(1))],
                    names=["vec_id", "v", "pivot", "r", "norm"],
                )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, v binary, pivot int, r double, norm double")


def _blocks(keyed: DataFrame, rows: int, number: str) -> DataFrame:
    """The annuli of each pivot in blocks of about ``rows``, as (number, pivot, ids, vs, r_min, r_max, norm).

    A histogram of ``CELLS`` distances for each pivot, at most ``MOST_PIVOTS`` x ``CELLS`` counts, says where
    annuli end; an annulus that can't be narrower, such as equal vectors, is split by a hash of the id.
    """
    reach = keyed.groupBy("pivot").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / CELLS).otherwise(1.0)
    celled = keyed.join(F.broadcast(reach.select("pivot", "low", width.alias("width"))), "pivot")
    celled = celled.withColumn("cell", F.least(F.lit(CELLS - 1), F.floor((F.col("r") - F.col("low")) / F.col("width"))).cast("int")).drop("low", "width")
    upto = Window.partitionBy("pivot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    rings = celled.groupBy("pivot", "cell").agg(F.count("*").alias("n")).withColumn("ring", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / rows))
    parts = F.ceil(F.sum("n").over(Window.partitionBy("pivot", "ring")) / rows).cast("int")
    rings = rings.select("pivot", "cell", "ring", parts.alias("parts"))
    dealt = celled.join(F.broadcast(rings), ["pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")))
    grouped = dealt.groupBy("pivot", "ring", "part").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("rows"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.max("norm").alias("norm")
    )
    return grouped.select(F.monotonically_increasing_id().alias(number), "pivot", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vs"), "r_min", "r_max", "norm")


def _ids(column) -> np.ndarray:
    return np.array(column.values.to_pylist())


def _score(pairs: DataFrame, k: int, pivots: np.ndarray, kind: str, measure: Measure, work=None) -> DataFrame:
    """(query_id, vec_id, score): for each pair of blocks and query, its k best that reach the query's ``floor``."""

    def best(row: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The k best different ids among ``at``, ties to the smaller one."""
        n = k
        while True:
            some = at[row[at] >= np.partition(row[at], len(at) - n)[len(at) - n]] if len(at) > n else at
            some = some[np.lexsort((ids[some], -row[some]))]
            first = np.sort(np.unique(ids[some], return_index=True)[1])
            if len(first) >= k or len(some) == len(at):
                return some[first[:k]]
            n *= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]  # noqa: E731, B023
                floor = at("floor").values.to_numpy()
                q = _unpack(at("qs").values.to_pylist(), measure.scale)
                m = measure.taken(q)
                # the triangle inequality again, now for each query
                d, near_r, far_r = _distances(m, measure.taken(pivots[at("pivot").as_py()][None, :]))[:, 0], at("r_min").as_py(), at("r_max").as_py()
                gap = np.maximum(0, np.maximum(d - far_r, near_r - d))
                near = np.flatnonzero(measure.bound((m * m).sum(1), at("norm").as_py(), gap, d + far_r) >= floor)
                if not len(near):
                    continue
                qid, xid = _ids(at("qids")), _ids(at("ids"))
                if work is not None:
                    work.add(len(near) * len(xid))
                s = products(_units(q[near], measure.scale), _units(_unpack(at("vs").values.to_pylist(), measure.scale), measure.scale))
                out_q, out_x, out_s = [], [], []
                for row, j in zip(s, near):
                    found = best(row, xid, np.flatnonzero((row >= floor[j]) & (xid != qid[j])))
                    out_q += [qid[j].item()] * len(found)
                    out_x += xid[found].tolist()
                    out_s += row[found].tolist()
                types = at("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(out_q, types), pa.array(out_x, types), pa.array(out_s, pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _directory(asked: DataFrame, blocks: DataFrame, centres: np.ndarray, measure: Measure) -> DataFrame:
    """(qblock, block, bound, turn): the annulus blocks of each query block, the highest bound first.

    Only numbers about blocks are joined. The pivot is the key and a hot pivot has many blocks, so each
    pivot's query blocks are dealt to 16 keys.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = measure.taken(_unpack(batch.column("qs")[i].values.to_pylist(), measure.scale))
                d, n = _distances(m, measure.taken(centres)), len(centres)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("qblock")[i].as_py()] * n), pa.array(range(n), pa.int32()), pa.array(d.min(0)), pa.array(d.max(0)), pa.array([(m * m).sum(1).max()] * n)],
                    names=["qblock", "pivot", "d_min", "d_max", "q_norm"],
                )

    salts = 16
    near = asked.select("qblock", "qs").mapInArrow(ranges, "qblock long, pivot int, d_min double, d_max double, q_norm double")
    near = near.withColumn("salt", F.pmod(F.xxhash64("qblock"), F.lit(salts)))
    known = blocks.select("block", "pivot", "r_min", "r_max", "norm").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    gap = F.greatest(F.lit(0.0), F.col("d_min") - F.col("r_max"), F.col("r_min") - F.col("d_max"))
    bound = measure.bound(F.col("q_norm"), F.col("norm"), gap, F.col("d_max") + F.col("r_max"))
    turn = F.row_number().over(Window.partitionBy("qblock").orderBy(F.desc("bound"), "block"))
    return near.join(known, ["pivot", "salt"]).select("qblock", "block", bound.alias("bound")).withColumn("turn", turn)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, pivots: int | None = None, first: int = FIRST, work=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query, ties to the smaller id.

    ``vectors`` has vec_id and embedding, anything else is ignored; ``is_query`` is a condition on vec_id.
    Candidates are all other vectors. Null vectors and vectors with null or non-finite components take no
    part, nor do rows without an id; vectors of unequal length are filled with zeros; repeated rows count
    once, and an id with several vectors has the best of their scores. Components may have any finite size;
    a score that a long can't hold is the end of its range. With fewer than ``k`` candidates all are
    returned; without vectors there are no rows. The pivots are a bounded sample (``pivots`` rows, by hash;
    by default their number follows the rows); every row is indexed, and the result doesn't depend on them.
    ``work``, an accumulator, gets the number of products computed.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    table = quantised(vectors, scale)
    n = table.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    pivots = pivots or min(MOST_PIVOTS, math.ceil(2 * math.sqrt(n / BLOCK)))
    some = table.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    centres = _matrix([r.v for r in some])
    measure = Measure.of(table, scale)
    keyed = written(_keyed(table, centres, measure))
    blocks = written(_blocks(keyed, BLOCK, "block"))
    asked = _blocks(keyed.where(is_query), QUERY_BLOCK, "qblock").select("qblock", F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    asked = written(asked)
    directory = written(_directory(asked, blocks, centres, measure))

    ids = asked.select("qblock", F.posexplode("qids").alias("at", "query_id"))
    best = spark.createDataFrame([], f"query_id {kind}, vec_id {kind}, score long, rank int")
    done, turns = 0, first
    while True:
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        floors = ids.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-LONG - 1)))
        floors = floors.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("f"), F.min("floor").alias("least"))
        left = directory.where(F.col("turn") > done).join(floors, "qblock").where(F.col("bound") >= F.col("least"))
        if done and left.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")
        now = left.where(F.col("turn") <= done + turns).select("qblock", "block", F.col("f.floor").alias("floor"))
        # queries travel to annuli: each pair shuffles the smaller block only
        pairs = now.join(asked, "qblock").join(blocks, "block").select("qids", "qs", "floor", "ids", "vs", "pivot", "r_min", "r_max", "norm")
        best = written(_best(_score(pairs, k, centres, kind, measure, work).unionByName(best.drop("rank")), k))
        done, turns = done + turns, turns * GROWTH
