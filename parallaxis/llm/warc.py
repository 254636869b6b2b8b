"""WARC archives with a two-level capture index.

Records are written as gzip members. The index sorts captures by reversed-host
URL key into compressed blocks; a sparse directory has the first key of each
block. A look-up goes by binary search from shard to block to line, reads only
the blocks that it hits, and ends in a range read of the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import _work

#: Bytes at which an archive file is closed, and lines of an index block.
ARCHIVE, BLOCK = 64 << 20, 1024
#: Ranges of an archive, or of a shard of the index, that one task reads.
SPAN = 8 << 20
#: Payloads that are broadcast at most.
HOT = 1000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host form of a URL: com,example,www)/path?query. A null or hostless URL keeps its text."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    if not host:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as WARC payload digests have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit of the record of page refers_to."""
    revisit = refers_to is not None
    http = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        head.append("Content-Type: application/http;msgtype=response")
    return ("\r\n".join([*head, f"Content-Length: {len(http)}"]) + "\r\n\r\n").encode() + http + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload of a response (of a revisit: none)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def duplicates_of(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload and refers_to: the largest page_id of an equal payload of so many bytes, where that is another page.

    Payloads of more than a HOT-th of all rows, HOT at most, are broadcast, so
    that pages of one payload needn't meet in a task.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    counts = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    counts = _work.stored(counts, "payloads")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HOT > total).select("same", F.col("largest").alias("hot"))  # HOT rows at most
    rows = rows.join(F.broadcast(hot), "same", "left")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # settled already: meets nothing
    cold = counts.filter(F.col("n") * HOT <= total).select(F.col("same").alias("met"), "largest")
    out = rows.withColumn("met", F.when(F.col("hot").isNull(), F.col("same")).otherwise(alone)).join(cold, "met", "left")
    largest = F.coalesce("hot", "largest")
    return out.select("page_id", "url", "payload", F.when(largest != F.col("page_id"), largest).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) below path; returns key, page_id, file, start, length of each record.

    A null html is an empty payload. Of equal payloads the record of the
    largest page_id is a response and the others revisit it; rows of a null
    page_id, and all rows of the largest, are responses. The returned table is
    written once and names only files of tasks that ended well, so a retried
    task's leavings are never read. Columns besides the three are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = _gzip(record(page_id, url, payload, refers_to))
                    out.write(data)
                    rows.append((url_key(url), page_id, name, at, len(data)))
                    at += len(data)
                    if at >= ARCHIVE:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())], names=["key", "page_id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    rows = duplicates_of(pages, least_bytes).mapInArrow(run, "key string, page_id long, file string, start long, length long")
    return _work.stored(rows, "captures")


LINES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
CAPTURES = "key string, page_id long, file string, start long, length long"
DIRECTORY = "shard string, first_key string, last_key string, lines int, start long, length long"


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """shard, first_key, last_key, lines, start, length: the sparse directory of an index below path.

    Captures are sorted by key and written, so many to a compressed block, one
    block after the other into shard files of about ARCHIVE bytes; the
    directory has a row a block. It is written once, and names only shards of
    tasks that ended well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, at, kept = None, "", 0, None
        names = [x.split()[0] for x in DIRECTORY.split(", ")]

        def blocks(table: pa.Table) -> pa.RecordBatch:
            nonlocal out, name, at
            rows = []
            for k in range(0, table.num_rows, BLOCK):
                part = table.slice(k, BLOCK)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                data = sink.getvalue().to_pybytes()
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.index", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                rows.append((name, part["key"][0].as_py(), part["key"][-1].as_py(), part.num_rows, at, len(data)))
                at += len(data)
                if at >= ARCHIVE:
                    out.close()
                    out = None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=names)

        try:
            for batch in batches:
                kept = pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches([batch])])
                whole = kept.num_rows - kept.num_rows % BLOCK
                if whole:
                    yield blocks(kept.slice(0, whole))
                    kept = kept.slice(whole)
            if kept and kept.num_rows:
                yield blocks(kept)
        finally:
            if out is not None:
                out.close()

    rows = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "start")
    return _work.stored(rows.mapInArrow(run, DIRECTORY), "directory")


def look_up(directory: DataFrame, path: str, keys: DataFrame) -> DataFrame:
    """Captures (key, page_id, file, start, length) of every key of keys; a key without captures has no row.

    A key goes by binary search to its shards, whose bounds come to the driver
    (one row for each ARCHIVE bytes of index or task that wrote it), there to
    its blocks by the directory, and into the blocks, of which only those hit
    are read. Repeated and null keys of keys count once and not.
    """
    bounds = sorted((r.a, r.b, r.shard) for r in directory.groupBy("shard").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).collect())
    firsts, lasts = [x[0] for x in bounds], [x[1] for x in bounds]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, bounds[i][2]) for k in batch.column(0).to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.string()) for n in (0, 1)], names=["key", "shard"])

    def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("start")
        starts, ends = right["first_key"].to_pylist(), right["last_key"].to_pylist()
        found = [(k, i) for k in left["key"].to_pylist() for i in range(bisect.bisect_left(ends, k), bisect.bisect_right(starts, k))]
        hit = right.take(pa.array([i for _, i in found], pa.int64()))
        return pa.table({"key": pa.array([k for k, _ in found], pa.string()), "shard": hit["shard"], "start": hit["start"], "length": hit["length"]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        file, now, lines, block = None, (None, None), [], None
        for batch in batches:
            out = []
            for key, shard, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, start) != now:
                    if shard != now[0]:
                        file = store.open_input_file(f"{root}/{shard}")
                    with pa.ipc.open_stream(file.read_at(length, start)) as reader:
                        block = reader.read_all().combine_chunks()
                    now, lines = (shard, start), block["key"].to_pylist()
                out.append(block.slice(a := bisect.bisect_left(lines, key), bisect.bisect_right(lines, key) - a))
            yield from (pa.concat_tables(out) if out else LINES.empty_table()).cast(LINES).to_batches()

    wanted = keys.select("key").filter("key is not null").distinct().mapInArrow(place, "key string, shard string")
    hit = wanted.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(blocks, "key string, shard string, start long, length long")
    hit = hit.withColumn("span", F.floor(F.col("start") / SPAN)).repartition("shard", "span").sortWithinPartitions("shard", "start", "key")
    return hit.select("key", "shard", "start", "length").mapInArrow(search, CAPTURES)


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_ranges(captures: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records at the captures' places, by range reads of the archives below path, with the digest of a response's payload checked."""

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        name, file = None, None
        for batch in batches:
            rows = []
            for f, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if f != name:
                    name, file = f, store.open_input_file(f"{root}/{f}")
                headers, payload = parse(zlib.decompress(file.read_at(length, start), 31))
                own = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and digest(payload) != own:
                    raise ValueError(f"{f} is damaged at {start}")
                rows.append((number(headers["warc-record-id"]), int(headers["warc-payload-length"]), own, headers["warc-type"], number(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload if with_payload else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=[x.split()[0] for x in PAGES.split(", ")])

    spans = captures.withColumn("span", F.floor(F.col("start") / SPAN)).repartition("file", "span").sortWithinPartitions("file", "start")
    return spans.select("file", "start", "length").mapInArrow(run, PAGES)
