"""WARC archives, index first.

Every partition writes one archive (gzip, a member for each record) and one index
row per record: file, offset, length, URL, digest, type. The index decides what is
read: selected rows are sorted by file and offset, and neighbours with a gap of at
most GAP bytes are read in one range request of at most READ bytes.

Of records with equal payloads (by SHA-1) of at least min_revisit bytes, that with
the largest page_id is a response; the others are revisit records without payload
that refer to it. The payloads' groups are formed by a partial aggregation and an
equi-join on the digest, which adaptive execution splits where a payload is hot.

A retried task writes a file of another name; only the rows of the attempt that
Spark commits reach the index, so that files of lost attempts are never read.

Defined results: a null payload is empty; null URLs are written as the empty
string; rows that share their group's largest page_id are all responses; a null
page_id never refers to anything but its group's largest id, and is a response
where there is none; a damaged record raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GAP, READ, ROLL, TASK = 64 << 10, 8 << 20, 512 << 20, 64 << 20
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record in plain form. The HTTP header of a revisit holds the length of the payload that it leaves out."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes) -> dict:
    """The record's headers, its payload (None for a revisit) and the payload's length."""
    head, mark, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n:
        raise ValueError("the record is cut off")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http).group(1))
    revisit = headers["warc-type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("the payload is cut off")
    return {"headers": headers, "payload": None if revisit else payload, "length": length, "type": headers["warc-type"]}


def _stream(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write archives below folder; returns the index, one row a record, kept as a table there."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.sha1(F.encode("payload", "UTF-8")))
    # groups of one need no join partner: they stay out of the second side
    groups = rows.where(F.octet_length("payload") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    rows = rows.join(groups, "key", "left").select("page_id", "url", "payload", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))
    fs, path = _stream(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _stream(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                made: list[tuple] = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    raw = payload.encode("utf-8", "surrogatepass")
                    digest = payload_digest(raw)
                    c = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = c.compress(record(page_id, url, raw, digest, refers_to, refers_to is not None, date)) + c.flush()
                    out.write(member)
                    made.append((name, at, len(member), url, digest, "response" if refers_to is None else "revisit", page_id, refers_to))
                    at += len(member)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), _KINDS)], names=_NAMES)
        finally:
            if out is not None:
                out.close()

    index = common.map_batches(rows, run, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def ranges(entries: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int]]:
    """(first entry, start, end) of the reads for sorted (offset, length) entries."""
    out: list[tuple[int, int, int]] = []
    for k, (a, n) in enumerate(entries):
        if out and a - out[-1][2] <= gap and a + n - out[-1][1] <= most:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], a + n))
        else:
            out.append((k, a, a + n))
    return out


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the index rows select: page_id, url, payload (null for revisits, or unless wanted), payload_bytes, payload_digest, record_type, refers_to. Digests of responses are computed anew and checked."""
    # by bytes of the archives, which the index's own size says nothing of: TASK a task, and less while that leaves cores idle
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, total // TASK, min(total >> 20, 2 * index.sparkSession.sparkContext.defaultParallelism))
    chosen = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def flush(fs, path: str, name: str, entries: list[tuple[int, int]]) -> Iterator[tuple]:
        reads = ranges(entries)
        with fs.open_input_file(f"{path}/{name}") as f:
            for k, (first, a, b) in enumerate(reads):
                data = f.read_at(b - a, a)
                for offset, n in entries[first : reads[k + 1][0] if k + 1 < len(reads) else None]:
                    r = parse(zlib.decompress(data[offset - a : offset - a + n], 31))
                    h, payload = r["headers"], r["payload"]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and payload_digest(payload) != digest:
                        raise ValueError(f"the digest at {name}:{offset} differs")
                    page, to = (re.search(r"x-page:(-?\d*)", h.get(x, "")) for x in ("warc-record-id", "warc-refers-to"))
                    yield int(page.group(1)) if page and page.group(1) else None, h["warc-target-uri"], payload if payloads else None, r["length"], digest, r["type"], int(to.group(1)) if to and to.group(1) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _stream(folder)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                by_file.setdefault(name, []).append((offset, length))
            for name, entries in by_file.items():
                got: list[tuple] = []
                for row in flush(fs, path, name, entries):
                    got.append(row)
                    if len(got) >= 256:
                        yield _records(got)
                        got = []
                if got:
                    yield _records(got)

    return common.map_batches(chosen, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
