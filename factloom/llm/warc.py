"""WARC archives: index first.

Every task writes one archive of gzip members (one per record) into the shared folder and returns index rows: file,
offset, length, url, digest.  The index is a Parquet table, made before anything is read.  Reading takes the selected
index rows, sorted by file and offset, joins neighbouring byte ranges into larger reads and parses the records.

Of records with equal payloads the one with the smallest id is the response; the others are revisits, which hold the
response's HTTP header but no payload.  Which record comes first is settled on (id, digest) rows alone.

A lost task writes again under a new name; an archive counts only if the index names it.

Defined results: a null payload is empty; payloads under ``least_bytes`` are all responses; repeated ids with equal
payloads are all responses if they have the smallest id; a row without an id is a response and keeps its empty id; an
empty table writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import durable, fresh

_EPOCH = "2024-01-01T00:00:00Z"
_INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
_RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])
#: One read takes at most this many bytes, and spans gaps of at most so many.
READ_BYTES, READ_GAP = 4 << 20, 64 << 10
#: A task reads about this many bytes of archives.
TASK_BYTES = 128 << 20
#: Rows of one payload meet its first record in so many tasks.
SALTS = 32


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value must not break its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    """The page id in a record's name; none if there is no name or no id in it."""
    return int(bare) if name and (bare := name[len("<urn:page:") : -1]) else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of refers_to without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is None:
        http += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""

    def headers(block: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, headers(http), body


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages as archives under target and return the index (a durable table)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    hashed = durable(rows.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("bytes")), "warc-digests")
    firsts = hashed.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") > 1).drop("copies")
    # only payloads that occur twice or more have revisits; copies of one payload are small rows here, spread over SALTS tasks
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = hashed.where(F.col("bytes") >= least_bytes).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "salt"]).where(F.col("page_id") > F.col("first_id")).select("page_id", "sha1", "first_id").distinct()
    chosen = rows.withColumn("sha1", F.sha1("payload")).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "first_id")
    folder = target.rstrip("/")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            made: list[tuple] = []
            for i in range(batch.num_rows):
                page, url, payload, first = (batch.column(j)[i].as_py() for j in range(4))
                digest = sha1_base32(payload)
                data = _member(record(page, url, payload, digest, first))
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                made.append((page, url, digest, "response" if first is None else "revisit", f"{folder}/{name}", at, len(data)))
                at += len(data)
            columns = list(zip(*made, strict=True)) if made else [()] * len(_INDEX.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=_INDEX.names)
        if out is not None:
            out.close()

    return durable(chosen.mapInArrow(run, _INDEX), "warc-index")


def _reads(entries: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, first byte, end, records) of joined reads; entries sorted by file and offset."""
    file, start, end, held = "", 0, 0, []
    for name, offset, length in entries:
        if held and (name != file or offset - end > READ_GAP or offset + length - start > READ_BYTES):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that index rows select: headers, and payloads if wanted (revisits have none)."""
    ranged = index.select("file", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("span"))
    # as many tasks as the archives' bytes ask for: index rows alone are so small that all would be put into one task
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    ordered = ranged.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def run(batches):
        opened: dict[str, tuple] = {}

        def entries():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        held = 0
        for file, start, end, records in _reads(entries()):
            if file not in opened:
                for _, (handle, _) in opened.items():
                    handle.close()
                fs, path = pafs.FileSystem.from_uri(file)
                opened = {file: (fs.open_input_file(path), path)}
            block = opened[file][0].read_at(end - start, start)
            for offset, length in records:
                raw = zlib.decompress(block[offset - start : offset - start + length], 31)
                warc, http, body = parse(raw)
                kind, refers = warc["WARC-Type"], warc.get("WARC-Refers-To")
                digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(body) != digest:
                    raise ValueError(f"damaged record at {file}:{offset}")
                out.append((
                    _id(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind,
                    _id(refers), body if with_payload and kind == "response" else None,
                ))
                held += len(raw)
            if held > READ_BYTES or len(out) >= 5000:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_RECORDS.names)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, then read all records back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, fresh(spark, "archives"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH base AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM base),
quints AS (
    SELECT page_id, hex, payload_bytes, first_id, k,
           list_reduce(list_transform(range(10), lambda j: (strpos('0123456789abcdef', substr(hex, 10 * k + j + 1, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b) AS n
    FROM hashed, range(4) t(k)
), spelled AS (
    SELECT page_id, payload_bytes, first_id,
           string_agg(list_aggregate(list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> (35 - 5 * j)) & 31)::INTEGER + 1, 1)), 'string_agg', ''), '' ORDER BY k) AS payload_digest
    FROM quints GROUP BY page_id, payload_bytes, first_id
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM spelled
"""
