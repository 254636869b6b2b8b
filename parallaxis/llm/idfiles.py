"""Token ids in compressed files: canonical length-limited Huffman codes, blocks that decode by themselves, and checkpoints of bit offsets.

A folder holds `code` (the length of each id's code; canonical codes follow
from the lengths) and one file a range of documents in ascending order. A file
is a run of blocks, each of BLOCK ids at most, and ends in a directory with
the place and the first id of each block. A block has the documents that start
in it, its segments (a document, or BLOCK ids of one), the bits that each STEP
ids take, and the codes. Because every STEP-th id's bit offset is known, all
runs of a block are decoded side by side, one table look-up an id. A segment
begins at a whole word, so that it is coded where its document is and then
moved and joined to others as it is.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.llm import _text, _work

#: The longest code in bits (more only for more than so many powers of two of ids), ids of a block and ids between two checkpoints.
LIMIT, BLOCK, STEP = 18, 1 << 18, 128
#: Ids of a file, about, and the most files there are before files grow.
FILE, FILES = 1 << 22, 20_000
#: Different pieces of text whose ids a task remembers.
KNOWN = 1 << 21
END = 0
#: Bytes of text encoded at once.
CHUNK = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True


def _pieces(data: np.ndarray, offsets: np.ndarray) -> _text.Words:
    """Texts cut where a byte-level tokenizer with the usual pattern always cuts: before white space after anything else, and before a mark after a letter.

    No piece of that pattern holds white space after another character, or a
    letter and a mark; so the ids of the parts are the ids of the whole. A cut
    is made only after printable ASCII or a two-byte letter: some longer
    characters are white space themselves.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        solid = _PLAIN[before]
        solid[1:] |= (before[1:] >= 0x80) & (before[1:] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
        cut[1:-1] = (_WHITE[here] & solid) | (_LETTER[before] & _MARK[here])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    row = np.searchsorted(offsets, start, "right") - 1
    return _text.Words(data, start, end, row, len(offsets) - 1)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] places, then from start[1], and so on."""
    to = np.cumsum(length)
    return np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - length), length)


class Encoder:
    """Ids of texts by a tokenizer file; ids of pieces met before are remembered, KNOWN at most."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.by_pieces = '"use_regex":true' in self.tokenizer.to_str() and self.tokenizer.normalizer is None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of the pieces in order, and their numbers
        self.bytes, self.begins = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        upto = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(upto[-1])), upto

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of pieces not met before."""
        ids, upto = self._whole([data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist())])
        numbers = np.arange(len(start)) + len(self.starts) - 1
        self.bytes = np.concatenate([self.bytes, data[_runs(start, end - start)]])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(end - start)])
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + upto[1:]])
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin, with their number last."""
        if self.by_pieces:
            found = self._by_pieces(_pieces(data, offsets), offsets)
            if found:
                return found
        return self._whole([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])])

    def _by_pieces(self, p: _text.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same, by the ids of pieces; None where two pieces have one hash."""
        if not len(p.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.keys) > KNOWN:
            self._forget()
        keys, first, kind = np.unique(p.hashes(), return_index=True, return_inverse=True)
        length, one = p.end - p.start, first[kind]
        if (length != length[one]).any() or (p.data[_runs(p.start, length)] != p.data[_runs(p.start[one], length)]).any():
            return None
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        own = self.slots[at[known]]
        long, here = self.begins[own + 1] - self.begins[own], first[known]
        if (long != length[here]).any() or (self.bytes[_runs(self.begins[own], long)] != p.data[_runs(p.start[here], long)]).any():
            return None
        slot = np.empty(len(keys), np.int64)
        slot[known] = own
        if not known.all():
            slot[~known] = self._learn(p.data, p.start[first[~known]], p.end[first[~known]])
            self.keys = np.insert(self.keys, at[~known], keys[~known])
            self.slots = np.insert(self.slots, at[~known], slot[~known])
        slot = slot[kind]
        sizes = self.starts[slot + 1] - self.starts[slot]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[_runs(self.starts[slot], sizes)], upto[np.searchsorted(p.start, offsets)]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, size of every document: the ids of its whole text (null: none), then END, as little-endian unsigned integers of size bytes (2 where the vocabulary allows it, else 4). Long texts are encoded in pieces that can't change their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        size = 2 if encoder.size <= 1 << 16 else 4
        for batch in batches:
            for a, b, data, offsets in _text.chunks(batch.column(1), CHUNK):
                ids, at = encoder.encode(data, offsets)
                out = np.insert(ids, at[1:], END).astype(f"<u{size}")
                ends = (at + np.arange(len(at))) * size
                column = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column, pa.array(np.full(b - a, size, np.int32))], names=["doc_id", "ids", "size"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, size int")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch (columns ids, size first), and how many each row has."""
    if not batch.num_rows:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    column, size = batch.column(0).cast(pa.large_binary()), batch.column(1)[0].as_py()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(f"<u{size}"), np.diff(at) // size


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all documents; each task sends a row for each different id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_ids(batch)[0], minlength=len(total))
            n[: len(total)] += total
            total = n
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["id", "n"])

    return ids.select("ids", "size").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code, 0 for ids that don't occur: the least total for codes of limit bits at most, by merging packages.

    Ids of the lowest counts come first, ties by id. In each of limit rounds,
    pairs of the last round's list are packages that are sorted in among the
    ids; the cheapest of the last list tell, list by list, how many ids get
    another bit.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    packed, lists = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([weights, packed])
        by = np.argsort(both, kind="stable")
        lists.append(by < len(weights))
        even = both[by][: len(by) // 2 * 2]
        packed = even[::2] + even[1::2]
    bits, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for own in reversed(lists):
        ids = int(own[:take].sum())
        bits[:ids] += 1
        take = 2 * (take - ids)
    out[order] = bits
    return out


@dataclass
class Code:
    """Canonical codes of given lengths: by length, then by id."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.width = int(self.lengths.max(initial=1))
        order = np.flatnonzero(self.lengths)
        self.order = order[np.argsort(self.lengths[order], kind="stable")]
        self.spans = np.int64(1) << (self.width - self.lengths[self.order].astype(np.int64))
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.order] = ((np.cumsum(self.spans) - self.spans) // self.spans).astype(np.uint64)

    def table(self) -> np.ndarray:
        """For each of the next width bits, the id that they begin with (times 64) and the length of its code."""
        entries = self.order.astype(np.int64) << 6 | self.lengths[self.order]
        out = np.zeros(1 << self.width, np.int64)
        out[: int(self.spans.sum())] = np.repeat(entries, self.spans)
        return out

    def write(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments of so many ids (one at least) each: the 32-bit words of their codes, the words of each, and the bits that each STEP ids of each take."""
        length = self.lengths[ids].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        bits = np.add.reduceat(length, first)
        words = (bits + 31) >> 5
        begin = (np.cumsum(words) - words) << 5
        start = np.cumsum(length) - length
        start += np.repeat(begin - start[first], sizes)
        word = start >> 5
        code = self.codes[ids] << (64 - length - (start & 31)).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        out[word[new]] = np.bitwise_or.reduceat(code >> np.uint64(32), new)
        out[word[new] + 1] |= np.bitwise_or.reduceat(code & np.uint64(0xFFFFFFFF), new)
        runs = -(-sizes // STEP)
        marks = _runs(np.zeros(len(sizes), np.int64), runs) * STEP + np.repeat(first, runs)
        return out[:-1].astype("<u4"), words, np.add.reduceat(length, marks).astype("<u2")


def read_block(table: np.ndarray, width: int, words: np.ndarray, bits: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The ids of segments of so many ids that hold so many words, all runs between checkpoints side by side."""
    whole = np.concatenate([words.astype(np.uint64), np.zeros(STEP * width // 32 + 3, np.uint64)])
    pairs = whole[:-1] << np.uint64(32) | whole[1:]
    runs = -(-sizes // STEP)
    at = np.cumsum(bits, dtype=np.int64) - bits
    at += np.repeat(((np.cumsum(held) - held) << 5) - at[np.cumsum(runs) - runs], runs)
    out = np.empty((STEP, len(at)), np.uint32)
    mask, shift = np.uint64((1 << width) - 1), 64 - width
    for k in range(STEP):
        entry = table[(pairs[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask]
        out[k] = entry >> 6
        at += entry & 63
    left = np.repeat(sizes, runs) - _runs(np.zeros(len(sizes), np.int64), runs) * STEP
    return out.T[np.arange(STEP) < left[:, None]]


_HEAD, _TAIL = struct.Struct("<IIII"), struct.Struct("<QQ8s")
_MAGIC = b"idfile01"
#: Of each block in the directory: its place in the file, its first id's number in the file, and its ids.
_ENTRY = np.dtype([("at", "<u8"), ("first", "<u8"), ("n", "<u8")])
#: Of each document in the block that it starts in: doc_id, its first id's number in the file, its ids, and whether doc_id is null.
_DOC = np.dtype([("doc_id", "<i8"), ("first", "<u8"), ("n", "<u8"), ("null", "u1")])


class _Writer:
    """One file: segments go in, blocks come out as they fill."""

    def __init__(self, out):
        self.out = out
        self.at = self.ids = self.held = self.n_docs = 0
        self.docs: list[tuple[int, int, int, int]] = []
        self.segments: list[tuple[int, bytes, bytes]] = []
        self.directory: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, number: int, all_ids: int, n: int, bits: bytes, words: bytes) -> None:
        if self.held + n > BLOCK and self.held:
            self._flush()
        if not number:
            self.docs.append((doc_id or 0, self.ids + self.held, all_ids, doc_id is None))
            self.n_docs += 1
        self.segments.append((n, bits, words))
        self.held += n

    def _flush(self) -> None:
        bits, words = (b"".join(x[k] for x in self.segments) for k in (1, 2))
        body = _HEAD.pack(len(self.docs), len(self.segments), len(bits), len(words)) + np.array(self.docs, _DOC).tobytes()
        body += np.array([(n, len(w) // 4) for n, _, w in self.segments], "<u4").tobytes() + bits + words
        self.out.write(body)
        self.directory.append((self.at, self.ids, self.held))
        self.at += len(body)
        self.ids += self.held
        self.held, self.segments, self.docs = 0, [], []

    def close(self) -> None:
        if self.held:
            self._flush()
        self.out.write(np.array(self.directory, _ENTRY).tobytes() + _TAIL.pack(self.at, len(self.directory), _MAGIC))


def _segments(ids: DataFrame, code: Code) -> DataFrame:
    """doc_id, tie, row, number, all_ids, n, bits, words: every document coded, in segments of BLOCK ids at most."""
    names = ["doc_id", "tie", "row", "number", "all_ids", "n", "bits", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, sizes = _ids(batch)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in _text.slices(upto, 4 * BLOCK):
                own = sizes[a:b]
                pieces = -(-own // BLOCK)
                number = _runs(np.zeros(b - a, np.int64), pieces)
                all_ids = np.repeat(own, pieces)
                n = np.minimum(BLOCK, all_ids - number * BLOCK)
                words, held, bits = code.write(every[upto[a] : upto[b]], n)
                column = lambda data, size: pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                take = pa.array(np.repeat(np.arange(a, b), pieces))
                columns = [*(batch.column(k).take(take) for k in (2, 3, 4)), *(pa.array(x) for x in (number, all_ids, n)), column(bits, -(-n // STEP) * 2), column(words, held * 4)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = ids.select("ids", "size", "doc_id", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, tie long, row long, number long, all_ids long, n long, bits binary, words binary")


def write_ids(documents: DataFrame, tokenizer: str, path: str, limit: int = LIMIT) -> DataFrame:
    """Files of the ids of documents (doc_id, text) below path; returns file, part, first (number of the file's first id), n_ids, n_docs, n_bytes of each.

    Documents go in ascending order of doc_id: null first, ties by a hash of
    their ids, and rows alike in both in any order, which can't be told. Every
    document has its END at least, so a null or empty text is one id. The ids'
    counts over all documents make the code; they reach the driver, a number
    for each id of the vocabulary. No documents give no files. The table that
    comes back is written once and names only files of tasks that ended well.
    Columns besides the two are ignored.
    """
    with _work.passing(token_ids(documents, tokenizer), "ids", "zstd") as ids:
        found = id_counts(ids).collect()
        counts = np.zeros(max((r.id for r in found), default=0) + 1, np.int64)
        for r in found:
            counts[r.id] = r.n
        lengths = code_lengths(counts, limit)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/code", compression=None) as out:
            out.write(zlib.compress(lengths.tobytes()))
        total = int(counts.sum())
        each = max(FILE, total // FILES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = fs.FileSystem.from_uri(path)
            name, writer = f"{uuid.uuid4().hex}.ids", None
            try:
                for batch in batches:
                    for *row, bits, words in zip(*(c.to_pylist() for c in batch.columns)):
                        writer = writer or _Writer(store.open_output_stream(f"{root}/{name}", compression=None))
                        writer.add(*row, bits, words)
                if writer is not None:
                    writer.close()
                    row = (name, TaskContext.get().partitionId(), writer.ids, writer.n_docs, writer.at)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "part", "n_ids", "n_docs", "n_bytes"])
            finally:
                if writer is not None:
                    writer.out.close()

        order = ("doc_id", "tie", "row")  # a document's segments stay together
        ranged = _segments(ids, Code(lengths)).repartitionByRange(max(1, -(-total // each)), *order).sortWithinPartitions(*order, "number")
        ranged = ranged.select("doc_id", "number", "all_ids", "n", "bits", "words")
        files = _work.stored(ranged.mapInArrow(run, "file string, part long, n_ids long, n_docs long, n_bytes long"), "files")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file, FILES about at most
    return files.withColumn("first", F.coalesce(before, F.lit(0))).select("file", "part", "first", "n_ids", "n_docs", "n_bytes")


def _open(path: str):
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/code", compression=None) as f:
        code = Code(np.frombuffer(zlib.decompress(f.read()), np.uint8))
    return store, root, code.table(), code.width


def _blocks(f, table: np.ndarray, width: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first id's number, documents that start there, ids) of the blocks of an open file that hold ids of numbers low to high (exclusive)."""
    size = f.size()
    f.seek(size - _TAIL.size)
    end, n, magic = _TAIL.unpack(f.read(_TAIL.size))
    if magic != _MAGIC:
        raise ValueError("not a file of ids")
    f.seek(end)
    directory = np.frombuffer(f.read(n * _ENTRY.itemsize), _ENTRY)
    first = directory["first"].astype(np.int64)
    a = max(0, int(np.searchsorted(first, low, "right")) - 1)
    b = n if high is None else int(np.searchsorted(first, high, "left"))
    places = np.append(directory["at"].astype(np.int64), end)
    for k in range(a, b):
        f.seek(int(places[k]))
        body = f.read(int(places[k + 1] - places[k]))
        n_docs, n_segments, n_bits, _ = _HEAD.unpack_from(body)
        docs = np.frombuffer(body, _DOC, n_docs, _HEAD.size)
        at = _HEAD.size + docs.nbytes
        sizes, held = np.frombuffer(body, "<u4", 2 * n_segments, at).reshape(-1, 2).astype(np.int64).T
        at += 8 * n_segments
        bits, words = np.frombuffer(body, "<u2", n_bits // 2, at), np.frombuffer(body, "<u4", -1, at + n_bits)
        yield int(first[k]), docs, read_block(table, width, words, bits, sizes, held)


def read_documents(files: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files; a task holds one block at a time (and, with ids, one document)."""
    n = max(1, files.count())
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, root, table, width = opened = opened or _open(path)
                with store.open_input_file(f"{root}/{name}") as f:
                    doc, left, crc, own = None, 0, 0, []
                    for first, docs, ids in _blocks(f, table, width):
                        rows, upto = [], 0
                        starts = iter(docs.tolist())
                        while True:
                            if doc is not None:
                                part = ids[upto : upto + left]
                                crc = zlib.crc32(part.astype("<u4", copy=False).tobytes(), crc)
                                upto, left = upto + len(part), left - len(part)
                                if with_ids:
                                    own.append(part)
                                if left:
                                    break
                                rows.append((None if doc[3] else doc[0], begin + doc[1], doc[2], crc, *([np.concatenate(own)] if with_ids else [])))
                            doc = next(starts, None)
                            if doc is None:
                                break
                            left, crc, own = doc[2], 0, []
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.select("file", "first").repartition(n).mapInArrow(run, schema)


def read_span(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """start, ids of the numbers first to last (exclusive) of all ids, a row for each block: only blocks that hold some of them are read."""
    hit = files.filter((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first)).select("file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, root, table, width = opened = opened or _open(path)
                low, high = max(0, first - begin), last - begin
                with store.open_input_file(f"{root}/{name}") as f:
                    for at, _, ids in _blocks(f, table, width, low, high):
                        a, b = max(0, low - at), min(len(ids), high - at)
                        if a < b:
                            yield pa.RecordBatch.from_arrays([pa.array([begin + at + a]), pa.array([ids[a:b]], pa.list_(pa.int64()))], names=["start", "ids"])

    return hit.mapInArrow(run, "start long, ids array<long>")
