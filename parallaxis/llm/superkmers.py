"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words. Consecutive windows of a document that share
a minimiser (the least hash of the word pairs in a window) travel as one
string to the minimiser's bucket, so a word isn't sent once for each of its k
windows. In a bucket, sorting brings equal windows together, byte for byte,
and gives each the smallest document it starts in.

A bucket of far more than its share, as that of a very common word pair, is
split: its windows travel one by one to buckets told by a hash of the window,
where equal windows still meet.

Documents are kept in chunks of some MB, written once. A chunk sends each
different super-k-mer once, with its smallest and largest document, and gets
back the smallest documents of its windows; so a passage that very many
documents share costs a bucket one string a chunk, not one a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import _text, _work

WINDOW = 13
#: Words of a minimiser.
GRAM = 2
#: Bytes of text of a chunk.
CHUNK = 4 << 20
#: Bytes of super-k-mers that a bucket holds on average; the number of buckets follows the input.
BUCKET = 6 << 20
#: Times its share at which a bucket is split.
SPLIT = 4

_C = _text.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
NOBODY = np.iinfo(np.int64).max


def _chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive hashes."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _C[k]
    return _text.mix(out)


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each run of n consecutive values."""
    m, width = x, 1
    while 2 * width <= n:
        m, width = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0], 2 * width
    rest = n - width
    return np.minimum(m[:-rest], m[rest:]) if rest and len(m) > rest else m if not rest else m[:0]


@dataclass
class Buckets:
    """Numbers of buckets: by minimiser, then those for the single windows of split ones, which are listed in order (no more than a SPLIT-th of all)."""

    number: int
    split: np.ndarray
    single: int = 0


class Runs:
    """The runs of windows of a chunk that share a minimiser: where each begins and stops, and its bucket."""

    def __init__(self, w: _text.Words, usable: np.ndarray, window: int, gram: int, buckets: int):
        n = len(w.start) - window + 1
        self.hashes = w.hashes()
        self.begin = self.stop = self.bucket = np.zeros(0, np.int64)
        if n > 0:
            least = _sliding_least(_chained(self.hashes, gram), window - gram + 1)[:n]
            valid = (w.row[:n] == w.row[window - 1 :]) & usable[w.row[:n]]
            turn = np.ones(n, bool)
            turn[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
            self.begin = np.flatnonzero(valid & turn)
            self.stop = np.flatnonzero(valid & np.append(turn[1:] | ~valid[1:], True)) + 1
            self.bucket = (least[self.begin] % np.uint64(buckets)).astype(np.int64)


class Pieces:
    """The super-k-mers of a chunk: different texts in the order of buckets, and where each stands."""

    def __init__(self, w: _text.Words, usable: np.ndarray, window: int, gram: int, buckets: Buckets):
        runs = Runs(w, usable, window, gram, buckets.number)
        begin, count, bucket = runs.begin, runs.stop - runs.begin, runs.bucket
        if not len(begin):
            self.texts, self.ids, self.first, self.count, self.bucket_of = [], begin, begin, begin, begin
            return
        if (hot := np.isin(bucket, buckets.split)).any():
            n = count[hot]
            single = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[hot], n)
            place = buckets.number + (_chained(runs.hashes, window)[single] % np.uint64(buckets.single)).astype(np.int64)
            begin, count, bucket = np.append(begin[~hot], single), np.append(count[~hot], np.ones(len(single), np.int64)), np.append(bucket[~hot], place)
        order = np.argsort(bucket, kind="stable")
        self.first, self.count = begin[order], count[order]
        text = w.data.tobytes()
        seen: dict[bytes, int] = {}
        spans = zip(w.start[self.first].tolist(), w.end[self.first + self.count + window - 2].tolist())
        self.ids = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in spans])
        self.texts = list(seen)
        self.bucket_of = np.empty(len(seen), np.int64)
        self.bucket_of[self.ids] = bucket[order]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x, np.int64).tobytes() for x in arrays]
    return zstandard.compress(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts), 6)


def _unpack(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(data, np.int64, n, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _open(chunk: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(chunk) as reader:
        return reader.read_next_batch()


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, _text.Words]:
    ids = batch.column("doc_id").cast(pa.int64())
    return ids.fill_null(NOBODY).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), _text.words(*_text.buffers(batch.column("text")))


def to_chunks(documents: DataFrame, buckets: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """chunk_id, chunk, bucket, bytes: the rows of documents, some MB of text at a time, and the bytes of super-k-mers of each bucket (a task's in rows without a chunk); written to the shared folder."""
    names = ["chunk_id", "chunk", "bucket", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(0, np.int64)
        for batch in batches:
            _, offsets = _text.buffers(batch.column("text"))
            for a, b in _text.slices(offsets, CHUNK):
                part = batch.slice(a, b - a)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                _, known, w = _documents(part)
                runs = Runs(w, known, window, gram, buckets)
                if len(runs.begin):
                    sizes = sizes if len(sizes) else np.zeros(buckets, np.int64)
                    np.add.at(sizes, runs.bucket, w.end[runs.stop + window - 2] - w.start[runs.begin])
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names=names)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(sizes[some])], names=names)

    return _work.stored(documents.mapInArrow(run, "chunk_id string, chunk binary, bucket int, bytes long"), "chunks")


def split_buckets(chunks: DataFrame, number: int, window: int = WINDOW, least: int = BUCKET) -> Buckets:
    """The buckets to split: those of SPLIT times their share, and of `least` bytes; their single windows get buckets of about that size."""
    sizes = chunks.filter("chunk is null").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    hot = sizes.filter(F.col("bytes") > max(least, SPLIT * total / number)).collect()  # number / SPLIT rows at most
    bytes_ = sum(r.bytes for r in hot)
    return Buckets(number, np.array(sorted(r.bucket for r in hot), np.int64), max(1, bytes_ * window // 2 // BUCKET) if hot else 0)


def send(chunks: DataFrame, buckets: Buckets, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """chunk_id, bucket, packed: the different super-k-mers of each chunk by bucket, with smallest and largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, chunk in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc, known, w = _documents(_open(chunk.as_py()))
                p = Pieces(w, known, window, gram, buckets)
                if not p.texts:
                    continue
                low, high = np.full(len(p.texts), NOBODY), np.full(len(p.texts), -NOBODY)
                np.minimum.at(low, p.ids, doc[w.row[p.first]])
                np.maximum.at(high, p.ids, doc[w.row[p.first]])
                cuts = np.flatnonzero(np.diff(p.bucket_of, prepend=-1, append=-1))
                packed = [_pack(b"\n".join(p.texts[a:b]), np.diff(low[a:b], prepend=0), high[a:b] - low[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([chunk_id] * len(packed)), pa.array(p.bucket_of[cuts[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["chunk_id", "bucket", "packed"])

    return chunks.filter("chunk is not null").select("chunk_id", "chunk").mapInArrow(run, "chunk_id string, bucket int, packed binary")


def smallest(texts: list[bytes], low: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For different super-k-mers and their smallest documents: the smallest document of every window, and where each text's windows begin."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    w = _text.spans(data, np.append(0, np.minimum(ends, len(data))))  # words stand one space apart already
    n = len(w.start) - window + 1
    at = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    hashes = _chained(w.hashes(), window)[at]
    text = data.tobytes()
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    begin, finish = w.start[at], w.end[at + window - 1]
    again = np.flatnonzero(~new)
    ends = (z.tolist() for k in (order[again], order[again - 1]) for z in (begin[k], finish[k]))
    if any(text[a:b] != text[c:d] for a, b, c, d in zip(*ends)):  # hashes met by chance: order by the words themselves
        spans = [text[a:b] for a, b in zip(begin.tolist(), finish.tolist())]
        order = np.array(sorted(range(len(spans)), key=spans.__getitem__))
        new[1:] = [spans[x] != spans[y] for x, y in zip(order[1:], order[:-1])]
    group = np.flatnonzero(new)
    least = np.minimum.reduceat(low[w.row[at]][order], group)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(group, len(at))))
    return out, np.searchsorted(w.row[at], np.arange(len(texts) + 1))


def settle(sent: DataFrame, window: int = WINDOW) -> DataFrame:
    """chunk_id, bucket, verdict: for a chunk's super-k-mers with a window that starts in a smaller document, the smallest documents of their windows."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        own, lows, highs = [], [], []
        for packed in table["packed"]:
            texts, low, high = _unpack(packed.as_py())
            own.append(np.array([seen.setdefault(t, len(seen)) for t in texts.split(b"\n")]))
            lows.append(np.cumsum(_ints(low)))
            highs.append(lows[-1] + _ints(high))
        low = np.full(len(seen), NOBODY)
        for i, x in zip(own, lows):
            np.minimum.at(low, i, x)
        least, begin = smallest(list(seen), low, window)
        first = np.minimum.reduceat(least, begin[:-1])
        rows = []
        for chunk_id, i, high in zip(table["chunk_id"].to_pylist(), own, highs):
            hit = np.flatnonzero(first[i] < high)
            if len(hit):
                count = np.diff(begin)[i[hit]]
                at = np.arange(count.sum()) + np.repeat(begin[i[hit]] - (np.cumsum(count) - count), count)
                rows.append((chunk_id, table["bucket"][0].as_py(), _pack(hit, count, least[at])))
        return pa.table({k: pa.array([r[n] for r in rows], t) for n, (k, t) in enumerate((("chunk_id", pa.string()), ("bucket", pa.int32()), ("verdict", pa.binary())))})

    return sent.groupBy("bucket").applyInArrow(run, "chunk_id string, bucket int, verdict binary")


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """documents with n_words, n_removed and kept: the words, one space apart, that no repeated window covers.

    Words are runs outside ASCII white space, unchanged. A word goes if a
    window of its document covers it whose words also start in a document of
    smaller doc_id; all windows are judged on the input. A null text has no
    words; a text shorter than a window loses none; a row of null doc_id loses
    none and takes none from others. Rows of one doc_id don't repeat each
    other. Columns named n_words, n_removed or kept are replaced.
    """
    docs = documents.drop("n_words", "n_removed", "kept")
    size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = max(8, size * 3 // BUCKET)
    chunks = to_chunks(docs, number, window, gram)
    buckets = split_buckets(chunks, number, window)
    chunks = chunks.filter("chunk is not null").select("chunk_id", "chunk")
    verdicts = settle(send(chunks, buckets, window, gram), window)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for chunk in left["chunk"]:
            batch = _open(chunk.as_py())
            doc, known, w = _documents(batch)
            covered = np.zeros(len(w.start) + 1, np.int64)
            if right.num_rows:
                p = Pieces(w, known, window, gram, buckets)
                base = dict(zip(*(x.tolist() for x in np.unique(p.bucket_of, return_index=True))))
                place, length, least = np.full(len(p.texts), -1), np.zeros(len(p.texts), np.int64), []
                total = 0
                for bucket, verdict in zip(right["bucket"].to_pylist(), right["verdict"]):
                    hit, count, mins = map(_ints, _unpack(verdict.as_py()))
                    place[base[bucket] + hit] = total + np.cumsum(count) - count
                    total += len(mins)
                    least.append(mins)
                least = np.concatenate(least)
                o = np.flatnonzero(place[p.ids] >= 0)
                n = p.count[o]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(p.first[o], n) + k
                start = start[least[np.repeat(place[p.ids[o]], n) + k] < doc[w.row[start]]]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + window, -1)
            gone = np.cumsum(covered[:-1]) > 0
            first = w.firsts()
            removed = np.diff(np.append(0, np.cumsum(gone))[first])
            keep = np.repeat(~gone, w.end - w.start + 1)
            text = w.data[keep]
            size = np.bincount(w.row[~gone], (w.end - w.start + 1)[~gone], w.rows).astype(np.int64)
            # without the space after each text's last word
            stop = np.cumsum(size)
            text = np.delete(text, stop[size > 0] - 1)
            offsets = np.append(0, np.cumsum(np.maximum(size - 1, 0)))
            kept = pa.LargeStringArray.from_buffers(w.rows, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes()))
            out.append(pa.Table.from_arrays([*batch.columns, pa.array(np.diff(first)), pa.array(removed), kept.cast(pa.string())], names=[*batch.schema.names, "n_words", "n_removed", "kept"]))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk_id").cogroup(verdicts.groupBy("chunk_id")).applyInArrow(apply, schema)
