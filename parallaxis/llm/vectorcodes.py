"""Vectors of integers as short codes: a codebook for each part of the vector, distances read from dictionaries of the values that occur.

In a batch of vectors each dimension takes few different integers. Their
squared differences to all entries of the codebook are tabulated once, and the
distances of a part are gathered from those tables by the places of its values
in their dictionaries, and added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import _work

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are kept within this, so that sums stay within 64 bits.
MOST = 1 << 24
#: Vectors handled at once in a task.
ROWS = 8192
#: Widest range of a dimension's values that is marked in a table instead of sorted.
RANGE = 1 << 18

_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: floor(SCALE * x) of each component x.

    Rows whose vector is null or holds null or non-finite components are left
    out. Integers beyond MOST are MOST. Repeated rows stay, each by itself.
    """
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(F.greatest(F.least(e, F.lit(float(MOST))), F.lit(-float(MOST))) * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return embeddings.filter(sound).select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one array; shorter ones end in zeros."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    size = np.diff(at)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in ascending order, and each one's place there."""
    low, high = int(values.min()), int(values.max())
    if high - low >= RANGE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part of each vector, ties to the lower index, and the squared distances summed over parts. books: part, entry, place in the part."""
    parts, _, width = books.shape
    codes, errors = np.zeros((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
    if not len(vectors):
        return codes, errors
    for p in range(parts if width else 0):
        far = None
        for j in range(width):
            values, place = _dictionary(vectors[:, p * width + j])
            table = (values[:, None].astype(np.int64) - books[p, :, j]) ** 2
            if int(table.max(initial=0)) * width < 1 << 31:
                table = table.astype(np.int32)
            far = table[place] if far is None else far + table[place]
        codes[:, p] = far.argmin(1)
        errors += far[np.arange(len(far)), codes[:, p]]
    return codes, errors


def first_books(vectors: DataFrame) -> np.ndarray:
    """The parts of the ENTRIES vectors of smallest vec_id (ties by the vectors, null last): fewer entries where there are fewer vectors. Parts are equal; vectors shorter than the longest, or of a length that PARTS doesn't divide, count as ending in zeros."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS)
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()
    first = np.zeros((len(rows), PARTS * width), np.int64)
    for k, r in enumerate(rows):
        first[k, : len(r.v)] = r.v
    return np.ascontiguousarray(first.reshape(len(rows), PARTS, width).transpose(1, 0, 2))


def moved_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the mean, rounded down, of the parts that it is nearest to; unused ones stay. A task sends one sum for each component of each entry, and so many reach the driver."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column(0).slice(at, ROWS), parts * width)
                codes, _ = nearest(rows, books)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    for j in range(width):
                        total[p, :, j] += np.bincount(codes[:, p], rows[:, p * width + j], entries).astype(np.int64)  # sums below 2^53
        p, e, j = np.nonzero(np.broadcast_to(n[:, :, None] > 0, books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (p, e, j, total[p, e, j], n[p, e])], names=["p", "e", "j", "total", "n"])

    sums = vectors.select("v").mapInArrow(run, "p long, e long, j long, total long, n long").groupBy("p", "e", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():
        out[r.p, r.e, r.j] = r.total // r.n
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of vectors (vec_id, label, v)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                codes, errors = nearest(_matrix(part.column(2), parts * width), books)
                text = pa.py_buffer(np.ascontiguousarray(_HEX[codes]))
                ends = pa.py_buffer(np.arange(part.num_rows + 1, dtype=np.int32) * 2 * parts)
                code = pa.Array.from_buffers(pa.string(), part.num_rows, [None, ends, text])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), code, pa.array(errors)], names=["vec_id", "label", "code", "error"])

    kinds = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "v").mapInArrow(run, kinds)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, v: the vectors that codes stand for."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, parts)
            rows = books[np.arange(parts), index].reshape(len(index), parts * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.int64()))], names=["vec_id", "v"])

    kinds = T.StructType([codes.schema["vec_id"], T.StructField("v", T.ArrayType(T.LongType()))])
    return codes.select("vec_id", "code").mapInArrow(run, kinds)


def compress(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error of every vector kept; the codebooks after ROUNDS rounds). label_error is the error summed over all vectors of a label, null for one. No vectors give none."""
    vectors = _work.stored(integers(embeddings), "integers")
    books = first_books(vectors)
    for _ in range(ROUNDS):
        books = moved_books(vectors, books)
    coded = _work.stored(encode(vectors, books), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
