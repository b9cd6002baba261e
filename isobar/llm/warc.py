"""WARC archives of web pages: segmented records, revisits, and reassembly on reading.

Writing: every page is one record; of pages with equal payloads the one with the largest page_id is the
response and the others revisit it. A response is an HTTP message in chunked transfer framing; one that
is longer than SEGMENT_BYTES is cut into a first record and continuation records.

Reading: records are parsed by their length fields. Segments are grouped by the origin's identifier,
ordered by segment number and checked against the total length; then the HTTP head is split off and the
chunked framing decoded, and the payload's digest is computed again and compared.

Defined results: a null html is an empty payload; a null page_id never has a larger one beside it that
would be null, and is written as 'null' (a response unless an equal payload has a page_id); rows with the
same page_id and payload as the response are responses too; null urls are empty; extra columns are
ignored. A missing segment, a wrong or malformed total, a wrong digest, or a revisit that names no
response or digest gives ``intact`` false. Foreign records (another kind, no identifier, or a segment
number that isn't one) are left out. An archive holds at most RECORDS_PER_FILE records of SEGMENT_BYTES
and their heads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import map_chunks, shared_dir, table

#: Largest block of one record, size of transfer chunks, and records per archive file (so files are bounded).
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 1 << 14, 1 << 12, 2048
#: Equal payloads of at least this many bytes are written as revisits.
MIN_REVISIT_BYTES = 0
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The payload of chunked framing (extensions and trailers are skipped); None if it is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        try:
            size = int(framed[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(framed[at : at + size])
        at += size + 2


def record(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the blank lines after it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", _DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block


def page_records(page_id: int | None, url: str, payload: bytes, response_id: int | None, unique: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit if ``response_id`` is given, else a response in segments."""
    ident = f"urn:pages:{'null' if page_id is None else page_id}:{unique}"
    target = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if response_id is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record("revisit", ident, [*target, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:pages:{response_id}>"), ("Content-Type", "application/http; msgtype=response")], http)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(http) <= segment:
        return [record("response", ident, [*target, kind], http)]
    parts = [http[i : i + segment] for i in range(0, len(http), segment)]
    out = [record("response", ident, [*target, ("WARC-Segment-Number", "1"), kind], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(http)))] if n == len(parts) else []
        out.append(record("continuation", f"{ident}:{n}", [target[0], ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", str(n)), *total], part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write pages (page_id, url, html) as archives of at most RECORDS_PER_FILE records under ``path``.

    Files go through Spark's own writer, so they land in whatever store the path names. Rows of one very
    common payload are split by adaptive skew handling of the join on the digest.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    big = F.octet_length("html") >= min_revisit_bytes
    repeated = rows.filter(big).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(repeated, "sha1", "left")

    def make():
        part, made = TaskContext.get().partitionId(), 0

        def run(chunk):
            nonlocal made
            out = []
            for page_id, url, html, last in zip(chunk["page_id"], chunk["url"], chunk["html"], chunk["last"], strict=True):
                made += 1
                revisits = last if last is not None and (page_id is None or page_id < last) else None
                out += page_records(page_id, url, html.encode("utf-8", "surrogatepass"), revisits, f"{part}-{made}", segment)
            return {"record": out}

        return run

    records = map_chunks(rows, ["page_id", "url", "html", "last"], "record binary", make, text="html")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(content: bytes):
    """(fields, block) of every record of an archive, plain or gzip; a cut last record is left out."""
    while content[:2] == b"\x1f\x8b":
        out, rest = [], content
        while rest[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            out.append(z.decompress(rest))
            rest = z.unused_data
        content = b"".join(out)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.find(_END, at)
        if end < 0:
            return
        fields = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("ascii", "replace")] = v.strip().decode("utf-8", "surrogatepass")
        try:
            size = int(fields.get("content-length", ""))
        except ValueError:
            at = end
            continue
        block = content[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield fields, block
        at = end + 4 + size


def _page_of(ident: str) -> int | None:
    """The page_id in a record's identifier."""
    parts = ident.strip("<>").split(":")
    return int(parts[2]) if len(parts) > 2 and re.fullmatch(r"-?[0-9]{1,19}", parts[2]) else None


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch("[0-9]{1,18}", value) else None


def _result(fields: dict, block: bytes) -> dict:
    """What a complete response or revisit says."""
    head, _, body = block.partition(_END)
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page, refers = (_page_of(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    out = {"page_id": page, "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "refers_to": None}
    if fields["warc-type"] == "revisit":
        size = http.get(b"content-length", b"")
        return out | {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": said, "refers_to": refers, "payload": None, "intact": refers is not None and bool(said) and size.isdigit()}
    payload = dechunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    digest = base32_sha1(payload or b"")
    return out | {"payload_bytes": len(payload or b""), "payload_digest": digest, "payload": payload, "intact": payload is not None and digest == said}


_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
_NAMES = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per page record: identifiers, payload length and digest (and the payload on request).

    Complete records are decoded where they are read; only segments travel, each to its origin's group.
    """
    types = _FIELDS + (", payload binary" if payloads else "")
    schema = f"origin string, number int, total long, head string, block binary, {types}"
    names, parsed_type = _NAMES + (("payload",) if payloads else ()), _parse_datatype_string(schema)

    def run(batches):
        arrow = to_arrow_schema(parsed_type)
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse(content.as_buffer().to_pybytes()):
                    kind, number = fields.get("warc-type"), fields.get("warc-segment-number")
                    if "warc-record-id" not in fields or number is not None and not 0 < (_number(number) or 0) < 1 << 31:
                        continue
                    if kind in ("response", "revisit") and number is None:
                        done = _result(fields, block)
                        rows.append({"origin": fields["warc-record-id"]} | {k: done[k] for k in names})
                    elif kind in ("response", "continuation") and number is not None:
                        head = "\n".join(f"{k}: {v}" for k, v in fields.items()) if int(number) == 1 else None
                        rows.append({"origin": fields.get("warc-segment-origin-id") or fields["warc-record-id"], "number": int(number), "total": _number(fields.get("warc-segment-total-length")), "head": head, "block": block})
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(run, schema)
    whole = F.struct(*[F.when(F.col("number").isNull(), F.col(n)).alias(n) for n in names])
    grouped = found.groupBy("origin").agg(F.max(F.when(F.col("number").isNull(), whole)).alias("whole"), F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "head", "block"))).alias("segments"))

    def make():
        def join(chunk):
            out: dict[str, list] = {k: [] for k in names}
            for whole, segments in zip(chunk["whole"], chunk["segments"], strict=True):
                done = whole or assemble(segments)
                for k in names:
                    out[k].append(done[k])
            return out

        return join

    return map_chunks(grouped, ["whole", "segments"], types, make, text=None)


def assemble(segments: list[dict]) -> dict:
    """Order segments, verify that none is missing and that the total is right, and decode."""
    parts = sorted(segments, key=lambda s: s["number"])
    block = b"".join(s["block"] for s in parts)
    heads = [s["head"] for s in parts if s["head"]]
    fields = dict(line.split(": ", 1) for line in heads[0].split("\n")) if heads else {"warc-record-id": "", "warc-type": "response"}
    done = _result(fields, block)
    if [s["number"] for s in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
        done["intact"] = False
    return done


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read the archives back, and say what each record is."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


QUERIES = {"op6_warc": judge}

ORACLE_SQL = {
    "op6_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages
), g AS (
  SELECT x, max(page_id) AS last FROM p GROUP BY x
), b AS (
  SELECT page_id, n, last, CAST(unhex(p.x) AS BIT)::VARCHAR AS bits FROM p JOIN g USING (x)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id < last OR (page_id IS NULL AND last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last OR (page_id IS NULL AND last IS NOT NULL) THEN last END AS refers_to,
  TRUE AS intact
FROM b
"""
}
