"""WARC archives: writing with segments and chunked framing, and reading back by reassembly."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.functions.materialize import checkpoint_root, materialize
from heldout.llm.text import as_bytes, bound_batches, plain, row_udf

LEAST_REVISIT = 1000  # shorter payloads are always written
SEGMENT = 32 * 1024  # bytes of a record's block; longer ones continue in further records
CHUNK = 8 * 1024
BROADCAST_ROWS = 100_000  # repeated payloads that every task may hold; more are joined
RECORDS_PER_FILE = 2_000
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, url: str | None, payload_sha: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{payload_sha}')}"


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), CHUNK) for c in (payload[i : i + CHUNK],)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        at = end + 4 + size


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _line(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def records(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: str | None) -> list[bytes]:
    """The records of one page without their final blank lines: a revisit, or a response in one or more segments."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = record_id(page_id, url, sha)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _line(url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to:
        block = http + b"\r\n"
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Refers-To", f"<{refers_to}>"), profile, kind]
        return [_head([*fields, ("Content-Length", len(block))]) + block]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = []
    for n, part in enumerate(parts, 1):
        last = ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)
        if n == 1:
            number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, number, kind]
        else:
            own = uuid.uuid5(_SPACE, f"{name}|{n}")
            fields = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _line(url)),
                ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", n), last,
            ]
        out.append(_head([*fields, ("Content-Length", len(part))]) + part)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record, by the lengths that the records state."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        at += 4
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The payload of a whole HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archive(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` below ``path``, in files of a bounded number of records.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes, the one
    with the largest (page_id, url) is the response.  The texts are not
    shuffled: the table of repeated payloads is counted and goes to every task
    only if it is small; a larger one is joined.
    """
    bound_batches(pages.sparkSession)
    rows = plain(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")).cast("binary"))
    keyed = rows.withColumn("sha", F.sha2("html", 256))
    repeated = materialize(
        keyed.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("sha")
        .agg(F.max(F.struct("page_id", "url")).alias("chosen"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "chosen")
    )
    few = repeated.count() <= BROADCAST_ROWS
    marked = keyed.join(F.broadcast(repeated) if few else repeated, "sha", "left").select(
        "page_id", "url", "html", "sha", F.col("chosen").isNotNull().alias("repeated"), F.col("chosen.page_id").alias("to_id"), F.col("chosen.url").alias("to_url")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[bytes] = []
            htmls = as_bytes(batch.column(2))
            others = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)]
            for html, page, url, sha, again, to_page, to_url in zip(htmls, *others):
                revisits = again and (page, url) != (to_page, to_url)
                done += records(page, url, html, sha, record_id(to_page, to_url, sha) if revisits else None)
            yield pa.record_batch({"value": pa.array(done, pa.binary())})

    lines = marked.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_KIND = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers", pa.string()), ("stated", pa.string()),
    ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
_DDL = (
    "record_id string, type string, page_id bigint, refers string, stated string, number int, total bigint, block binary, "
    "payload_bytes bigint, payload_digest string"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = []
            for f, block in parse(data):
                strip = lambda k, f=f: f[k].strip("<>") if k in f else None
                kind = f["warc-type"]
                page = int(f["warc-page-id"]) if "warc-page-id" in f else None
                number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                stated = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in f else None
                total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                size = digest = None
                if kind == "response" and number is None:
                    payload = payload_of(block)
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if stated not in (None, digest):
                        raise ValueError(f"record {f['warc-record-id']} has another payload than it says")
                origin = strip("warc-segment-origin-id") if kind == "continuation" else strip("warc-record-id")
                rows.append((origin, kind, page, strip("warc-refers-to"), stated, number, total, block if number else None, size, digest))
            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_KIND), _KIND)], schema=_KIND)


def _decoded(blocks: list[bytes]) -> list[tuple[int, str]]:
    return [(len(p), hashlib.sha1(p).hexdigest()) for p in map(payload_of, blocks)]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every response and revisit.

    Records of one segment are decoded where they are read.  The segments of
    the others are grouped by their origin, ordered by number, held against the
    stated total length, and decoded; a group is one record, never more.  A
    missing segment or a wrong length or digest raises an error.
    """
    bound_batches(spark)
    found = materialize(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_read, _DDL)
    )
    whole = found.filter("type = 'response' AND number IS NULL").select("record_id", "page_id", "payload_bytes", "payload_digest")
    pieces = found.filter("number IS NOT NULL").groupBy("record_id", "number").agg(
        F.first("block").alias("block"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("stated").alias("stated"), F.count(F.lit(1)).alias("copies"),
    )
    joined = pieces.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("stated").alias("stated"), F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"),
    ).selectExpr("*", "aggregate(parts, X'', (a, x) -> concat(a, x.block)) AS block")
    sound = F.expr("element_at(parts, 1).number = 1 AND element_at(parts, -1).number = size(parts) AND length(block) = total")
    checked = joined.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "record_id"))))
    decoded = checked.withColumn("d", row_udf(lambda: _decoded, "struct<payload_bytes:bigint,payload_digest:string>")("block"))
    same = F.col("stated").isNull() | (F.col("stated") == F.col("d.payload_digest"))
    long = decoded.select(
        "record_id", "page_id", F.col("d.payload_bytes").alias("payload_bytes"),
        F.when(same, F.col("d.payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
    responses = whole.unionByName(long)
    origin = responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")
    )
    revisits = found.filter("type = 'revisit'").select("page_id", "refers").join(origin, "refers", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
        .unionByName(revisits.withColumn("record_type", F.lit("revisit")).select(*names))
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    Null html is an empty payload; a null page_id or url has no such field in
    its record; rows equal in page_id, url and html are written each and all of
    them are responses if one is; extra columns are ignored; an empty table
    gives no row.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/warc/{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path)
