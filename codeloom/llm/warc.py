"""WARC archives: writing captures as transactions, reading them back, and assembling one nested row for each capture.

Writing. Every capture becomes three records: a request, a response (or a revisit) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Of captures with equal payloads of at least min_bytes, the one with the
largest id keeps its payload as a response; the others become identical-payload-digest revisits that name it in
WARC-Refers-To and keep their HTTP header. Identifiers are digests of id, URL, payload and a number among equal captures,
so no two records share one and a task that runs again writes the same. Every record is a gzip member of its own. Spark's
text writer writes the files, so that any file system that Spark reaches will do; a file holds FILE_CHUNKS pieces of about
CHUNK_BYTES and the captures that reach over them.

Reading. Files come through the binaryFile source and are walked by Content-Length, so payloads may hold anything.

Assembly. Requests, responses and metadata are joined on the concurrent-to identifier.

Defined cases: a null payload is empty; a null URL is written as about:blank; line ends in URLs are percent-encoded;
captures of one id and payload are all responses, whether their URLs differ or not, and others refer to the one with the
largest URL; captures that are equal in all three come back as so many rows; a null id is never the one that others refer
to; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, new_path, slices, small

#: Compressed bytes after which a piece of an archive ends, and pieces in a file.
CHUNK_BYTES, FILE_CHUNKS = 4 << 20, 16
#: Payloads shorter than this are never stored as revisits.
MIN_REVISIT_BYTES = 0
#: The tables have no times, so all records carry this one.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def with_owners(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (SHA-256), turn, owner, owner_url: of a payload that several captures have, its response.

    turn numbers captures that are equal in all. Payloads do not move, but for one of each group of equal captures.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2(F.col("payload"), 256))
    # Ids and digests are counted before the shuffle, first by capture and then by payload.
    same = rows.groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size"))
    same = materialize(same, "warc-captures")
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.col("url").isNotNull().alias("named"), "url")))
    shared = same.filter(F.col("size") >= min_bytes).groupBy("digest").agg(first.alias("o"), F.sum("n").alias("all")).filter("`all` > 1")
    shared = materialize(shared.select(F.col("digest").alias("_d"), F.col("o.page_id").alias("owner"), F.col("o.url").alias("owner_url")), "warc-shared")
    again = same.filter("n > 1").select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), F.col("url").alias("_u"), "n")
    turn = F.lit(0).cast("long").alias("turn")
    if again.isEmpty():
        out = rows.select("page_id", "url", "payload", "digest", turn)
    else:
        # Equal captures are one row while they move and are given back as so many with numbers.
        again = small(materialize(again, "warc-again"))
        hit = (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u"))
        many = rows.join(again, hit).groupBy("page_id", "url", "digest", "n").agg(F.any_value("payload").alias("payload"))
        many = many.select("page_id", "url", "payload", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))
        out = rows.join(again, hit, "left_anti").select("page_id", "url", "payload", "digest", turn).unionByName(many)
    return out.join(small(shared), F.col("digest") == F.col("_d"), "left").drop("_d")


def urn(kind: str, page_id: int | None, url: str | None, digest: str, turn: int) -> str:
    h = hashlib.md5(repr((kind, page_id, url, digest, turn)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member. A header without a value is left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()), z.compress(block), z.compress(b"\r\n\r\n"), z.flush()])


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, turn: int, owner: int | None, owner_url: str | None) -> bytes:
    """The three records of a capture."""
    again = owner is not None and page_id != owner
    uri = "about:blank" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    own = (page_id, url, digest, turn)
    name = urn("response", *own)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    beside = lambda kind, media: [("WARC-Type", kind), ("WARC-Record-ID", urn(kind, *own)), ("WARC-Concurrent-To", name), *common, ("Content-Type", media)]
    response = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", sha1)]
    if again:
        response += [("WARC-Refers-To", urn("response", owner, owner_url, digest, 0)), ("WARC-Profile", PROFILE)]
    response.append(("Content-Type", "application/http; msgtype=response"))
    return (
        member(beside("request", "application/http; msgtype=request"), f"GET {uri} HTTP/1.1\r\n\r\n".encode())
        + member(response, http if again else http + payload)
        + member(beside("metadata", "application/warc-fields"), b"" if page_id is None else b"page-id: %d\r\n" % page_id)
    )


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives under path.

    The text writer adds a separator after each value. Here it is the zero byte in which a gzip member below 16 MB ends (the
    top byte of its length); the last member of a piece is the small metadata record, whose own zero byte is left off.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def piece() -> pa.RecordBatch:
            data = b"".join(held)
            data = data[:-1] if data.endswith(b"\0") else data + zlib.compress(b"", wbits=31)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for b in slices(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "turn", "owner", "owner_url"))):
                held.append(capture(*row))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield piece()
                    held, size = [], 0
        if held:
            yield piece()

    packed = with_owners(pages, min_bytes).mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


class _Stream(io.RawIOBase):
    """Bytes of a file, inflated piece by piece if it is gzip of one or more members."""

    def __init__(self, content: bytes | memoryview, piece: int = 1 << 18):
        self.left, self.piece, self.at = memoryview(content), piece, 0
        self.zip = zlib.decompressobj(31) if bytes(content[:2]) == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.zip is None:
                got = bytes(self.left[self.at : self.at + len(out)])
                self.at += len(got)
            else:
                if self.zip.eof:
                    if not self.zip.unused_data and self.at >= len(self.left):
                        return 0
                    data, self.zip = self.zip.unused_data, zlib.decompressobj(31)
                elif self.zip.unconsumed_tail:
                    data = self.zip.unconsumed_tail
                else:
                    data = bytes(self.left[self.at : self.at + self.piece])
                    self.at += len(data)
                if not data and not self.zip.unconsumed_tail:
                    if self.at >= len(self.left) and not data:
                        return 0
                got = self.zip.decompress(data, len(out))
                if not got:
                    continue
            out[: len(got)] = got
            return len(got)


def parse(content: bytes | memoryview) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    f = io.BufferedReader(_Stream(content), 1 << 18)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield headers, block


def _row(h: dict, block: bytes, with_payload: bool) -> tuple:
    kind, payload, size, page_id = h["warc-type"], None, None, None
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            size = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    elif kind == "metadata":
        page_id = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
    return kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page_id, size, digest, payload if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 500) -> DataFrame:
    """One row for each record of the archives under path."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = "record_type record_id concurrent_to refers_to target_uri page_id payload_bytes payload_digest payload".split()
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(memoryview(content.as_buffer())):
                    rows.append(_row(h, block, with_payload))
                    if len(rows) == rows_per_batch:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(walk, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: capture_id and the structs request, response and metadata.

    A capture whose request or metadata is missing has null there. Archives of other writers may repeat identifiers: each
    side is first brought to one row for each with the number of its records, so that they do not multiply in the joins.
    """
    body = F.struct(*(F.col(x) for x in found.columns))
    cap = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    rows = found.select(cap.alias("capture_id"), F.col("record_type").alias("_t"), body.alias("_b"))
    side = lambda name, *types: rows.filter(F.col("_t").isin(*types)).groupBy("capture_id").agg(F.first("_b").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    out = side("response", "response", "revisit").join(side("request", "request"), "capture_id", "full").join(side("metadata", "metadata"), "capture_id", "full")
    n = F.greatest(*(F.coalesce(f"n_{x}", F.lit(0)) for x in ("response", "request", "metadata")))
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("capture_id", "request", "response", "metadata")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = materialize(read_archives(spark, path, with_payload=False).drop("payload"), "warc-records")
    got = assemble(found).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("_to"),
    )
    # One row for each response that some revisit names, however many do.
    named = found.filter("refers_to is not null").select(F.col("refers_to").alias("_id")).distinct()
    ids = found.filter("record_type = 'metadata'").join(named, F.col("concurrent_to") == F.col("_id")).groupBy("_id").agg(F.first("page_id").alias("refers_to"))
    ids = materialize(ids, "warc-named")
    return got.join(small(ids), F.col("_to") == F.col("_id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS n, t, sha1(t) AS h FROM p),
o AS (SELECT t, max(page_id) AS top, count(*) AS c FROM h GROUP BY t)
SELECT h.page_id, h.n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(('0x' || substr(h.h, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN o.c > 1 AND o.top IS NOT NULL AND h.page_id IS DISTINCT FROM o.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.c > 1 AND h.page_id IS DISTINCT FROM o.top THEN o.top END AS refers_to
FROM h JOIN o ON h.t = o.t
"""
