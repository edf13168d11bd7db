"""Vector compression to one byte a part, with nearest codebook entries found by a vector-approximation filter.

The parts of integer vectors are assigned to the entries of a codebook, whose entries are moved to the floored means of
their parts in a fixed number of rounds. Entries are filtered by approximations: each coordinate of the entries is cut
into a few cells; a part's lookup tables give the least and the largest squared distance to every cell of every
coordinate; their sums enclose its distance to each entry, and only entries whose lower bound doesn't exceed the least
upper bound are refined with exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a coordinate's cell, and parts that are compared at once.
BITS, AT_ONCE = 4, 512
#: Components below this are 64-bit work; larger ones are Python integers, as exact and slower.
SMALL = 1 << 24
#: Bits of a limb: sums travel in limbs, so that no sum of them leaves a long.
LIMB = 30
LONG = 2**63 - 1
#: Relative error of sums of squares in floating point, with a wide margin.
SLACK = 1e-9
#: Sub-groups that a label's rows are dealt to when they meet the label's sum.
SALTS = 32


def _pack(v: list[float], scale: int) -> bytes:
    """floor(scale * x) of all components: 32-bit integers after a 0, or decimal digits after a 1."""
    x = np.floor(np.array(v, np.float64) * scale) if not v or max(map(abs, v)) * scale < SMALL else None
    if x is not None:
        return b"\0" + x.astype(np.int32).tobytes()
    whole = ((lambda n, d: n * scale // d)(*float(c).as_integer_ratio()) for c in v)
    return b"\1" + ",".join(map(str, whole)).encode()


def _unpack(rows: list[bytes], width: int) -> np.ndarray:
    """(row, component) as 64-bit integers, or as Python integers where a component is large; short rows end in zeros."""
    if all(r[0] == 0 for r in rows):
        if all(len(r) == 4 * width + 1 for r in rows):
            flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:]
            return np.ascontiguousarray(flat).view(np.int32).astype(np.int64)
        out = np.zeros((len(rows), width), np.int64)
    else:
        out = np.zeros((len(rows), width), object)
    for i, r in enumerate(rows):
        v = list(map(int, r[1:].split(b","))) if r[0] else np.frombuffer(r, np.int32, offset=1)
        out[i, : len(v)] = v if out.dtype == np.int64 else list(map(int, v))
    return out


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, size) of the rows whose vector has finite components only; a missing label column is null."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.where(good).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("x").to_pylist()
            columns = [b.column("vec_id"), b.column("label"), pa.array([_pack(x, scale) for x in v], pa.binary()), pa.array(map(len, v), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "size"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, size int")


class Approximations:
    """A codebook part's entries (entry, component), and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, self.cells = entries, 1 << bits
        n, width = entries.shape
        # equally filled cells of each coordinate: an entry's cell follows from its place in the coordinate's order
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((n, width), np.int64)
        np.put_along_axis(self.cell, order, (np.arange(n) * self.cells // max(n, 1))[:, None].repeat(width, 1), axis=0)
        self.filled = np.unique(self.cell[:, 0]) if width else np.zeros(0, np.int64)
        inside = [[entries[self.cell[:, d] == c, d] for c in self.filled] for d in range(width)]
        kind = entries.dtype
        self.low = np.array([[x.min() for x in row] for row in inside], kind).reshape(width, -1)
        self.high = np.array([[x.max() for x in row] for row in inside], kind).reshape(width, -1)
        self.place = np.searchsorted(self.filled, self.cell)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (part, entry) of squared distances, from lookup tables (part, component, cell)."""
        low, high, pad = self.low, self.high, 0.0
        if q.dtype == object or low.dtype == object:
            top = max((abs(int(x)) for m in (q, low, high) for x in m.flat), default=0)
            shift = max(0, top.bit_length() - 100)
            scaled = lambda m: np.array([float(int(x) >> shift) for x in m.flat]).reshape(m.shape)
            # a shifted or rounded number is off by less than this
            low, high, q, pad = scaled(low), scaled(high), scaled(q), 1.0 + float(top >> shift) * 2.0**-50
        q, low, high = q.astype(np.float64)[:, :, None], low.astype(np.float64)[None], high.astype(np.float64)[None]
        least = np.maximum(0.0, np.maximum(low - q, q - high) - 2 * pad) ** 2
        most = (np.maximum(np.abs(q - low), np.abs(q - high)) + 2 * pad) ** 2
        lower, upper = np.zeros((len(q), len(self.entries))), np.zeros((len(q), len(self.entries)))
        for d in range(self.entries.shape[1]):
            lower += least[:, d, self.place[:, d]]
            upper += most[:, d, self.place[:, d]]
        return lower * (1 - SLACK), upper * (1 + SLACK)

    def nearest(self, q: np.ndarray, work=None) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``q``, ties to the smaller entry."""
        lower, upper = self.bounds(q)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        if work is not None:
            work.add(len(row))
        kind = object if object in (q.dtype, self.entries.dtype) else np.int64
        apart = q[row].astype(kind) - self.entries[entry].astype(kind)
        exact = (apart * apart).sum(axis=1) if apart.shape[1] else np.zeros(len(row), np.int64)
        # pairs are in order of row, then of entry: the first of the least ones is the result
        least = np.minimum.reduceat(exact, np.flatnonzero(np.diff(row, prepend=-1)))
        hit = np.flatnonzero(exact == least[row])
        hit = hit[np.unique(row[hit], return_index=True)[1]]
        return entry[hit], exact[hit]


def assigned(books: list[np.ndarray], x: np.ndarray, bits: int = BITS, work=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): the nearest entries of the parts of ``x``, and their squared distances."""
    entry, error = [], []
    for book, q in zip([Approximations(b, bits) for b in books], np.split(x, len(books), axis=1)):
        found = [book.nearest(q[i : i + AT_ONCE], work) for i in range(0, len(q), AT_ONCE)]
        entry.append(np.concatenate([e for e, _ in found]))
        error.append(np.concatenate([d for _, d in found]))
    return np.stack(entry, axis=1), np.stack(error, axis=1)


def _moved(table: DataFrame, books: list[np.ndarray], bits: int, work=None) -> list[np.ndarray]:
    """The codebooks with each entry at the floored mean of its parts. Each task sums up on its own; what is shuffled
    and what comes to the driver is a number for each entry and component at most, in a few limbs."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _unpack(b.column("v").to_pylist(), parts * width)
            code, _ = assigned(books, x, bits, work)
            if total is None or (x.dtype == object and total.dtype != object):
                total = np.zeros((parts, entries, width + 1), x.dtype) if total is None else total.astype(object)
            x = x.astype(total.dtype)  # Python integers as soon as one batch has them
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p * width : (p + 1) * width])
                total[p, :, width] += np.bincount(code[:, p], minlength=entries).astype(total.dtype)
        keys, limbs, sums = [], [], []
        for k, s in enumerate([] if total is None else total.reshape(-1).tolist()):
            limb = 0
            while s:
                own = s if abs(s) < 1 << LIMB else s & ((1 << LIMB) - 1)
                keys.append(k)
                limbs.append(limb)
                sums.append(own)
                s, limb = (s - own) >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(limbs, pa.int32()), pa.array(sums, pa.int64())], names=["k", "limb", "s"])

    total = [0] * (parts * entries * (width + 1))
    for r in table.select("v").mapInArrow(run, "k int, limb int, s long").groupBy("k", "limb").agg(F.sum("s").alias("s")).collect():
        total[r["k"]] += r["s"] << (LIMB * r["limb"])
    out = []
    for p, book in enumerate(books):
        now = book.astype(object)
        for e in range(entries):
            *sums, n = total[(p * entries + e) * (width + 1) : (p * entries + e + 1) * (width + 1)]
            if n:
                now[e] = [s // n for s in sums]
        out.append(_narrow(now))
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    return m.astype(np.int64) if all(abs(int(x)) < SMALL for x in m.flat) else m.astype(object)


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS, work=None) -> list[np.ndarray]:
    """The codebooks (entry, component) of the parts of ``table`` (from ``quantised``), after ``rounds`` rounds over all rows.

    They start as the parts of the ``entries`` smallest ids. The width is that of the longest vector, rounded up
    to whole parts.
    """
    longest = table.agg(F.max("size").alias("n")).first()["n"]
    if longest is None:
        return [np.zeros((0, 0), np.int64)] * parts
    width = -(-longest // parts)
    first = table.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = _unpack([bytes(r["v"]) for r in first], parts * width)
    books = [_narrow(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _moved(table, books, bits, work)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def coded(table: DataFrame, books: list[np.ndarray], bits: int = BITS, work=None) -> DataFrame:
    """(vec_id, label, code, error) of every row of ``table``; an error that a long can't hold is its end."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, error = assigned(books, _unpack(b.column("v").to_pylist(), parts * width), bits, work)
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            total = [min(sum(e), LONG) for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {c: table.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return table.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` of all rows with an equal label, nulls together.

    A label may have any share of the rows: sums are partial first, and a label's rows meet its sum in
    ``SALTS`` groups.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("label").agg(total.alias("label_error")).select(F.col("label").alias("_label"), "label_error", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt"))).drop("_label", "_salt", "_own")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS, work=None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null or has a null, NaN or infinite component are left out. Components may have any
    finite size; errors end at the largest long. Vectors of unequal length, or of one that ``parts`` doesn't
    divide, are filled with zeros; an empty vector is all zeros. Repeated rows count as often as they occur; a null
    id comes last. With fewer rows than ``entries`` (256 at most) there are fewer entries; without rows the
    result is empty. Other columns are ignored. ``work``, an accumulator, gets the number of refined pairs.
    """
    table = written(quantised(vectors, scale))
    books = train(table, parts, entries, rounds, bits, work)
    rows = written(coded(table, books, bits, work))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
