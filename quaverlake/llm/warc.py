"""Legacy web archives: ARC files converted to WARC, written, and read back.

ARC files of version 1 (`URL IP DATE TYPE LENGTH`) and 2 (`URL IP DATE TYPE RESULT CHECKSUM
LOCATION OFFSET FILENAME LENGTH`) are cut into records by their version's header line and
the declared lengths. Each record becomes a WARC/1.0 record: identifier, timestamp, type
and SHA-256 digests are synthesised from what the ARC record says. HTTP headers and payloads
are bytes throughout, in any encoding or none. Archives are files in the shared folder of at
most `archive_bytes` and one record before compression; each record is a gzip member of its
own, so records can be read by offset. Spark's text sink writes them: it ends a file by a
zero byte, which gzip readers skip as padding.

Payloads are digested once and written to the shared folder with a row number; which of them
are revisits is found from keys and digests alone, and goes back to the payloads by the row
number, of which no value is frequent.

Defined cases: a null payload is empty, a null URL becomes `urn:record:KEY`, white space in
URLs is escaped, a header line that isn't UTF-8 is read as Latin-1, rows of equal key and
payload are all responses if their key is the smallest (as are rows of a null key only if no
other row has their payload), an empty table gives empty archives and no rows; a payload must
fit in a worker's memory. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read_table

#: Payloads under this many bytes are never revisits.
#: Parts that the rows of one payload are dealt into.
SALTS = 32
LEAST_BYTES = 100
ARCHIVE_BYTES = 16 << 20
#: Level 6 takes twice the time for 6 % less bytes (measured on pages).
GZIP_LEVEL = 1
#: ARC blobs in flight.
BLOB_BYTES = 4 << 20
DATE = "19990101000000"
# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- ARC

def arc_version_block(version: int, name: str = "quaverlake.arc", date: str = DATE) -> bytes:
    """The record that opens an ARC file and tells its version."""
    body = f"{version} 0 quaverlake\n{ARC_FIELDS[version]}\n".encode()
    rest = f" text/plain 200 - - 0 {name} {len(body)}\n" if version == 2 else f" text/plain {len(body)}\n"
    return f"filedesc://{name} 0.0.0.0 {date}".encode() + rest.encode() + body + b"\n"


def arc_record(version: int, url: str, content: bytes, offset: int, ip: str = "0.0.0.0", date: str = DATE, kind: str = "text/html", name: str = "quaverlake.arc") -> bytes:
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url)
    head = f"{url} {ip} {date} {kind} "
    if version == 2:
        head += f"200 {hashlib.sha1(content).hexdigest()} - {offset} {name} "
    return f"{head}{len(content)}\n".encode() + content + b"\n"


def decoded(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def read_arc(blob: bytes) -> Iterator[dict]:
    """Records of an ARC file, without the version block. Raises ValueError for what isn't ARC."""
    at, version = 0, None
    view = memoryview(blob)
    while at < len(blob):
        if blob[at : at + 1] == b"\n":
            at += 1
            continue
        end = blob.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        fields = decoded(blob[at:end]).split(" ")
        length = int(fields[-1])
        content = view[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + length
        if version is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with filedesc://")
            version = int(bytes(content).split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            continue
        if len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError("an ARC header line has a wrong number of fields")
        yield {"version": version, "url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "content": bytes(content)}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with their empty line, and the payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if content.startswith(b"HTTP/") and mark else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return decoded(v.strip())
    return None


_RECORD = "key string, url string, ip string, date string, head binary, payload binary"
_RECORD_ARROW = pa.schema([(n, pa.binary() if n in ("head", "payload") else pa.string()) for n in ("key", "url", "ip", "date", "head", "payload")])


def arc_blobs(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Rows packed into ARC files of at most BLOB_BYTES and one record, versions in turn: one column `arc`."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, out = 1, bytearray(arc_version_block(1))
        for batch in batches:
            for k, u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = p.as_buffer().to_pybytes()
                head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                head += b"" if k is None else f"X-Record-Key: {base64.b64encode(k.encode()).decode()}\r\n".encode()
                content = head + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
                out += arc_record(version, u if u else f"urn:record:{k}", content, len(out))
                if len(out) >= BLOB_BYTES:
                    yield pa.record_batch([pa.array([bytes(out)], pa.binary())], ["arc"])
                    version = 3 - version
                    out = bytearray(arc_version_block(version))
        yield pa.record_batch([pa.array([bytes(out)], pa.binary())], ["arc"])

    return rows.mapInArrow(pack, "arc binary")


def arc_files(spark: SparkSession, path: str) -> DataFrame:
    """Existing .arc and .arc.gz files as rows of `arc`; a file must fit in memory."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def unzip(batches):
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.record_batch([pa.array([gzip.decompress(c) if p.endswith(".gz") else c], pa.binary())], ["arc"])

    return raw.mapInArrow(unzip, "arc binary")


def arc_records(blobs: DataFrame) -> DataFrame:
    """ARC files to records: key, url, ip, date, head (HTTP) and payload as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = []
                for r in read_arc(blob):
                    head, payload = split_http(r["content"])
                    k = http_field(head, "X-Record-Key")
                    rows.append((None if k is None else base64.b64decode(k).decode(), r["url"], r["ip"], r["date"], head, payload))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _RECORD_ARROW.types)], schema=_RECORD_ARROW)

    return blobs.mapInArrow(cut, _RECORD)


# --- WARC

def to_warc(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One binary column `record` with a whole WARC record per row, without the empty lines that end it.

    Of equal payloads of `least` bytes or more, that with the smallest key (as a number) is
    the response and the others refer to it.
    """
    r = records.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "id": F.expr("try_cast(key as bigint)"), "row": F.monotonically_increasing_id()})
    r = materialize(r, "warc-records")  # numbered rows must not be made anew
    keys = r.where(F.col("bytes") >= least).select("row", "id", "digest", F.pmod("row", F.lit(SALTS)).alias("salt"))
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # a popular page is many keys
    again = keys.join(first, ["digest", "salt"]).where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("row", "first")
    r = r.join(materialize(again, "warc-revisits"), "row", "left")
    again = F.col("first").isNotNull()

    def urn(*parts):
        h = F.md5(F.concat_ws("|", *parts))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))

    stamp = F.regexp_replace(F.rpad("date", 14, "0"), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3T$4:$5:$6Z")
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    fields = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.coalesce("key", F.lit("")), F.col("url"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), stamp), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("X-Refers-To-Key: "), F.col("first").cast("string"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block, 256)),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return r.select(F.concat(F.concat_ws("\r\n", *fields, F.lit(""), F.lit("")).cast("binary"), block).alias("record"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = GZIP_LEVEL) -> None:
    """WARC files: each record, and the two empty lines that the format asks for, is a gzip member."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for record in batch.column(0):
                raw = record.as_buffer().to_pybytes()
                out.append(gzip.compress(raw + b"\r\n\r\n", level, mtime=0))
                held += len(raw)
                if held >= archive_bytes:
                    yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["archive"])
                    out, held = [], 0
        if out:
            yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["archive"])

    archives = records.mapInArrow(fill, "archive binary").select(F.col("archive").cast("string"))  # the same bytes
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_warc(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, cut by declared lengths."""
    at = 0
    while at < len(blob):
        end = blob.find(b"\r\n\r\n", at)
        if end < 0 or not blob.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in blob[at:end].decode("utf-8").split("\r\n")[1:])
        block = blob[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block)
        if blob[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is not as long as declared")
        at += 4
        yield head, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date. Digests are checked."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(head: dict[str, str], block: bytes) -> tuple:
        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError("a block does not have its digest")
        http, payload = split_http(block)
        digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            n, found = len(payload), hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError("a payload does not have its digest")
        key = http_field(http, "X-Record-Key")
        refers = head.get("X-Refers-To-Key")
        return (None if key is None else int(base64.b64decode(key)), n, digest, head["WARC-Type"], None if refers is None else int(refers), head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = batch.column(1)[i].as_py()
                if blob.startswith(b"\x1f\x8b"):
                    blob = gzip.GzipFile(fileobj=io.BytesIO(blob)).read()  # gzip.decompress copies the rest for each member
                rows = [one(*x) for x in read_warc(blob)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return raw.mapInArrow(cut, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string")


def convert(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages to ARC, ARC to WARC, WARC to files under path."""
    write_archives(to_warc(arc_records(arc_blobs(df, key, url, payload))), path, archive_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    convert(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d),
u AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN 'urn:record:' || page_id ELSE replace(url, ' ', '%20') END AS target FROM f),
m AS (SELECT *, md5(page_id::VARCHAR || '|' || target || '|' || payload_digest) AS i FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  '<urn:uuid:' || i[1:8] || '-' || i[9:12] || '-3' || i[14:16] || '-8' || i[18:20] || '-' || i[21:32] || '>' AS record_id,
  target AS url, '1999-01-01T00:00:00Z' AS warc_date
FROM m"""
