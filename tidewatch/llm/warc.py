"""WARC archives with revisit records: write pages once for each payload, read archives back and resolve revisits.

Headers only are shuffled by payload digest; each digest's smallest page id keeps the payload, every other
page with it becomes a revisit record that names the original. Payloads are written by the tasks that read
them. Reading parses records by their lengths and joins revisit records to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cascade, flagged, shared_dir, to_arrow, written

#: Records in one archive file; larger payloads are gathered by their size, so that a file has about ``FILE_BYTES`` before
#: compression at most, or one record.
FILE_RECORDS, LARGE_BYTES, FILE_BYTES = 1000, 1 << 18, 1 << 28
#: Bytes of payload and records that reading hands on at once.
READ_BYTES, READ_RECORDS = 4 << 20, 500
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def digest(payload):
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes: four times 40 bits as eight digits."""
    hexed = F.sha1(payload.cast("binary"))
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _key(payload):
    """A hash of a page's id and payload, by which tasks that read payloads know revisits."""
    return F.xxhash64("page_id", payload)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_digest, n, k) of every row of ``pages`` (page_id, url, html): k is a hash of id and payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", digest(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("n"), _key(payload).alias("k"))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The rows of ``heads`` that are revisits, with ``refers_to``.

    Pages with equal payloads of at least ``least_bytes`` bytes revisit the one with the smallest id. Pages
    without an id are never revisits or originals; rows that share the smallest id are all responses.
    """
    own = heads.where(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes))
    first = own.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last <> refers_to").drop("last")
    return own.join(first, "payload_digest").where("page_id <> refers_to")


def _safe(value):
    """A header value: line ends would end the header."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", "%0A")


def _record(kind: str, payload, refers_to=None):
    """A record's text, but for the blank lines at its end."""
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), c.cast("string"), F.lit(">"))
    again = [F.concat(F.lit("WARC-Refers-To: "), name(refers_to)), F.lit(f"WARC-Profile: {PROFILE}")] if refers_to is not None else []
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        *again,
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return F.concat(lines, F.lit("\r\n\r\n"), payload)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Write one WARC record for each row of ``pages`` (page_id, url, html, anything else) below ``path``.

    A null html counts as empty, a null url as an empty target. Which pages are revisits is told to the
    tasks that read payloads by bitmaps, so that payloads aren't shuffled; with more revisits than
    bitmaps of bounded size can hold, or with hashes that don't tell them apart, they are told by a join. Files are gzipped by Spark's text writer, a
    record's trailing blank lines being the writer's line end; every header is written anew.
    """
    pages = pages.select("page_id", "url", "html")
    heads = written(headers(pages))
    again = written(revisits(heads, least_bytes))
    payload = F.coalesce(F.col("html"), F.lit(""))
    # hashes that a revisit shares with another page would lose a record, so then pages are told by a join
    clear = heads.join(again.select("k").distinct(), "k", "left_semi").count() == again.count()
    levels = cascade(heads, again) if clear else None
    if levels is None:
        first = pages.withColumn("payload_digest", digest(payload)).join(again.select("page_id", "payload_digest").distinct(), ["page_id", "payload_digest"], "left_anti")
    else:
        first = flagged(pages, _key(payload), levels, "_again").where("not _again").withColumn("payload_digest", digest(payload))

    def save(records: DataFrame, most: int) -> None:
        out = records.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most)
        out.text(path)

    large = F.octet_length(payload) >= LARGE_BYTES
    responses = first.where(~large).select(_record("response", payload).alias("value"))
    save(responses.unionByName(again.select(_record("revisit", F.lit(""), F.col("refers_to")).alias("value"))), file_records)
    # one more reading for each power of two among the sizes of large payloads, few as they are
    size = lambda n: F.floor(F.log2(n)).cast("int")
    for r in heads.where(F.col("n") >= LARGE_BYTES).select(size(F.col("n")).alias("power")).distinct().collect():
        same = first.where(large & (size(F.octet_length(payload)) == r["power"]))
        save(same.select(_record("response", payload).alias("value")), max(1, FILE_BYTES >> (r["power"] + 1)))


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, piece by piece."""
    view = memoryview(data)
    while len(view):
        one, taken = zlib.decompressobj(47), 0
        while not one.eof and taken < len(view):
            yield one.decompress(view[taken : taken + (1 << 18)])
            taken += 1 << 18
        view = view[min(taken, len(view)) - len(one.unused_data) :]


def _records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record; no more than a record and a part is held."""
    data, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        del data[:at]
        at = 0
        part = next(parts, None)
        data.extend(part or b"")
        return part is not None

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(data) > at:
                    raise ValueError("an archive ends inside a header")
                return
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size, at = int(head["content-length"]), end + 4
        while len(data) - at < size + 4:
            if not more():
                raise ValueError(f"an archive ends inside {head.get('warc-record-id')}")
        if data[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')} ends wrongly")
        yield head, bytes(data[at : at + size])
        at += size + 4


def read_archives(spark, path: str, key: str = "bigint", with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record below ``path``.

    Responses have the length and digest of the payload that was read; a payload that doesn't have the
    digest of its header is an error. Revisits have their header's digest and no length yet. A file is
    inflated piece by piece, and its records are handed on in batches of bounded size.
    """
    types = {"payload_bytes": pa.int64(), "page_id": to_arrow(key), "refers_to": to_arrow(key)}
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    own = lambda x: x and x[len(RECORD) + 1 : -1]

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        columns = [pa.array(out[n], pa.int64() if n == "payload_bytes" else pa.string()).cast(types.get(n, pa.string())) for n in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, size = {n: [] for n in names}, 0
                for head, payload in _records(_inflated(content.as_py())):
                    kind, found = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != found:
                        raise ValueError(f"payload of {head.get('warc-record-id')} has another digest")
                    row = [own(head.get("warc-record-id")), head["warc-target-uri"], len(payload) if kind == "response" else None, found, kind, own(head.get("warc-refers-to"))]
                    for n, x in zip(names, row + [payload.decode("utf-8")] * with_payload):
                        out[n].append(x)
                    size += len(payload) * with_payload
                    if size > READ_BYTES or len(out["url"]) >= READ_RECORDS:
                        yield batch_of(out)
                        out, size = {n: [] for n in names}, 0
                yield batch_of(out)

    schema = f"page_id {key}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {key}" + ", payload string" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` whose revisits have the length (and payload, if there) of the response that they refer to."""
    more = [c for c in ("payload",) if c in records.columns]
    origin = records.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_bytes"), *[F.col(c).alias(f"_{c}") for c in more]
    ).dropDuplicates(["refers_to", "payload_digest"])
    revisits = records.where("record_type = 'revisit'").join(origin, ["refers_to", "payload_digest"])
    filled = revisits.withColumn("payload_bytes", F.col("_bytes"))
    for c in more:
        filled = filled.withColumn(c, F.col(f"_{c}"))
    return records.where("record_type = 'response'").unionByName(filled.select(*records.columns))


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as deduplicated archives and read them back: one row for each row of ``pages``.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload,
    a row without an id is a response that nothing refers to, repeated rows are repeated records, and an
    empty table gives archives without records.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc"
    write_archives(pages, path, least_bytes)
    key = pages.schema["page_id"].dataType.simpleString()
    return resolve_revisits(read_archives(spark, path, key)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
