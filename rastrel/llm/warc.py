"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar index.

Writers put whole archives into one gzip stream each. The normaliser inflates such a stream once, rewrites every
record as a gzip member of its own, and writes beside it an index of the members' offsets, by which readers seek.
Files go to the shared folder under names of their own for each attempt; only those that a finished task reports are
read, so lost executors and repeated tasks leave nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import fresh_path, least_count, mapped, materialise, remove_path, table

#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
#: Bytes of records after which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: So many repeated payloads (60 bytes each), the most frequent, are broadcast; pages meet the others by shuffle, in which no payload is hot then.
BROADCAST_REPEATS = 100_000
_RECORD = "urn:x-page:"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system of pyarrow and the path in it. Hadoop's names of schemes are given those of pyarrow."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record of an HTTP response, or of a revisit if refers_to is given, which holds no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_RECORD}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_RECORD}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """The fields of a header block, after its first line; names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream, one member or many, in pieces. A stream that breaks off is an error."""
    z = None
    while piece := stream.read(CHUNK):
        while piece:
            z = z or zlib.decompressobj(31)
            if out := z.decompress(piece):
                yield out
            piece = z.unused_data if z.eof else b""
            z = None if z.eof else z
    if z is not None:
        raise ValueError("the gzip stream breaks off")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and bytes of each WARC record; at most one record and one piece are in memory."""
    buffer, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            piece = next(pieces, None)
            ended = piece is None
            buffer.extend(piece or b"")
        return len(buffer) >= n

    while fill(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a record's header breaks off")
        fields = headers(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record breaks off")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def payload_of(raw: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and payload of a record's bytes."""
    block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers(http), payload


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def judged(pages: DataFrame, min_bytes: int = MIN_BYTES, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """page_id, url, html, refers_to: null for what is to be a response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    d = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    long_enough = pages.where(F.octet_length(payload) >= min_bytes).select("page_id", F.sha1(payload).alias("digest"))
    first = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = materialise(first, "warc-repeats")
    least = least_count(first, "n", broadcast_repeats)
    often = first.where(F.col("n") >= least) if least is not None else first.limit(0)
    d = d.join(F.broadcast(often.select("digest", F.col("first").alias("told"))), "digest", "left")
    if first.agg(F.min("n")).first()[0] != least:
        rest = first.where(F.col("n") < least) if least is not None else first
        near, far = d.where("told is not null"), d.where("told is null").drop("told").join(rest.select("digest", F.col("first").alias("told")), "digest", "left")
        d = near.unionByName(far)
    return d.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("told")), F.lit(None)).otherwise(F.col("told")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to) as archives of one gzip stream each. Returns their paths."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, z, held, path = None, None, 0, ""

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["archive"])

        for batch in it:
            payloads = batch.column("html").cast(pa.binary())
            for page_id, url, html, to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), payloads, batch.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    path, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, name = _open(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out, z = fs.open_output_stream(name, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = html.as_py() or b""
                raw = record(page_id, url, payload, digest_of(payload), to)
                out.write(z.compress(raw))
                held += len(raw)
                if held >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(mapped(rows, write, "archive string"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with one gzip member a record, and its index. Returns archive, index, records."""

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("archive").to_pylist():
                made = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, name = _open(path)
                to, new = _open(made)
                to.create_dir(new.rpartition("/")[0], recursive=True)
                at = n = 0
                with fs.open_input_stream(name, compression=None) as source, to.open_output_stream(new, compression=None) as out, to.open_output_stream(new + ".idx") as index:
                    for fields, raw in records(inflated(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([made + ".idx"]), pa.array([n], pa.int64())], names=["archive", "index", "records"])

    tasks = max(1, archives.count())
    return materialise(mapped(archives.repartition(tasks), rewrite, "archive string, index string, records long"), "warc-normalised")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, rows: int = 256) -> DataFrame:
    """One row for each record, found by the archives' indexes. Digests of responses are made anew from their payloads."""

    def page(ref: str | None):
        number = (ref or "").strip("<>").removeprefix(_RECORD)
        return int(number) if number else None

    def parse(fields: dict[str, str], raw: bytes) -> tuple:
        http, payload = payload_of(raw)
        revisit = fields["warc-type"] == "revisit"
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (digest_of(payload) != told or len(payload) != int(http["content-length"])):
            raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its record says")
        return page(fields["warc-record-id"]), int(http["content-length"]), told, fields["warc-type"], page(fields.get("warc-refers-to"))

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        for batch in it:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                (fs, name), (_, beside) = _open(archive), _open(index)
                with fs.open_input_stream(beside) as f:
                    members = [json.loads(x) for x in f.read().splitlines()]
                found = []
                with fs.open_input_file(name) as f:
                    for m in members:
                        f.seek(m["offset"])
                        found += [parse(*x) for x in records(iter([zlib.decompress(f.read(m["length"]), 31)]))]
                        if len(found) >= rows:
                            yield made(found)
                            found = []
                if found:
                    yield made(found)

    return mapped(archives.select("archive", "index").repartition(max(1, archives.count())), fetch, _READ)


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as WARC, normalises the archives, and returns archive, index, records of the results.

    pages: page_id, url, html, and whatever else (ignored). A null html is an empty payload, a null url has no
    WARC-Target-URI, control characters of a URL are escaped. Of equal payloads of at least min_bytes, the smallest
    page_id (and what repeats it) is the response; where all their ids are null, all are. A null id comes after all
    others. A very long payload is one record, held whole. An empty table gives no archive. The files stay in the shared
    folder until the caller removes them.
    """
    spark, folder = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    written = write_monolithic(judged(pages, min_bytes), f"{folder}/monolithic", archive_bytes)
    done = normalise(written, f"{folder}/members")
    remove_path(spark, f"{folder}/monolithic")
    return done


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are removed once their records are read."""
    archives = archive(table(spark, sf_dir, "pages"))
    rows = materialise(read(archives), "warc-records")
    for r in archives.select(F.regexp_extract("archive", "^(.*)/members/[^/]*$", 1).alias("folder")).distinct().collect():
        remove_path(spark, r["folder"])
    return rows


#: Upper-case base32 of SHA-1 (32 characters, no padding), from its hexadecimal digits, 5 digits to 4 characters.
OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x),
b AS (SELECT DISTINCT x, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * i + 1)::BIGINT, 5))::BIGINT >> ((3 - j) * 5)::INTEGER) & 31) + 1)::BIGINT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (x) JOIN b USING (x)
"""
