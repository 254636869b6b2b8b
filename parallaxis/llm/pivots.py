"""Embedding near duplicates through a pivot-permutation index.

A vector is described by its nearest reference points, in order. The index is
the inverted lists: for each label and pivot, the vectors that have it among
their nearest. Vectors that share enough pivots are verified by cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import _work
from parallaxis.llm.components import Forest, connected_components

#: Reference points: PIVOTS_PER_ROOT times the root of the number of vectors, at least so many, and of so many bytes at most, for every task has them. They are a sample; the index has every vector.
PIVOTS_PER_ROOT, LEAST_PIVOTS, PIVOT_BYTES = 1.5, 32, 64 << 20
#: Nearest pivots that describe a vector, and how many two vectors must share to be compared.
NEAREST, SHARED = 8, 2
#: Vectors of a list that meet in one task; longer lists are dealt out as pairs of blocks.
BLOCK = 1024


def describe(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, key, unit: the unit vector in double precision, and a digest by which equal vectors meet.

    key and unit are null where the label is null or the vector is null, zero,
    or has null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = unit = None
                if label is not None and values and None not in values:
                    v = np.array(values, np.float64)
                    with np.errstate(all="ignore"):
                        top = np.abs(v).max()
                        if np.isfinite(v).all() and top > 0:
                            key = hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).hexdigest()
                            v = v / top
                            unit = v / np.sqrt(v @ v)
                keys.append(key)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "key", "unit"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label string, key string, unit array<double>")


def fit_pivots(distinct: DataFrame) -> list[np.ndarray]:
    """Reference points for each vector length: a sample of the distinct vectors by hash, PIVOT_BYTES at most."""
    n, size = distinct.agg(F.count("*"), F.max(F.size("unit"))).first()
    most = int(min(PIVOT_BYTES // (8 * max(size or 1, 1)), max(LEAST_PIVOTS, PIVOTS_PER_ROOT * n**0.5)))
    rows = distinct.select("unit").orderBy(F.xxhash64("label", "key")).limit(most).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(r[0])
    return [np.array(x) for x in by_size.values()]


def inverted_lists(distinct: DataFrame, pivots: list[np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """label, pivot, node, copies, unit, near: each vector once for each of its nearest pivots, which near lists from the nearest on.

    A vector of a length that no pivot has is in the one list -length.
    """
    by_size = {p.shape[1]: p for p in pivots}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.array(x) for x in batch.column(3).to_pylist()]
            near: list[list[int]] = [[-len(u)] for u in units]
            sizes = np.array([len(u) for u in units])
            for size, p in by_size.items():
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, max(1, -(-len(at) // 256))):
                    if len(part):
                        closest = np.argsort(-(np.stack([units[k] for k in part]) @ p.T), axis=1, kind="stable")[:, :nearest]
                        for k, x in zip(part.tolist(), closest.tolist()):
                            near[k] = x
            n = [len(x) for x in near]
            k = np.repeat(np.arange(len(near)), n)
            flat = pa.array([y for x in near for y in x], pa.int32())
            lists = pa.array(near, pa.list_(pa.int32()))
            for at in range(0, len(k), 8192):
                part = pa.array(k[at : at + 8192])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part), flat.slice(at, 8192), batch.column(1).take(part), batch.column(2).take(part), batch.column(3).take(part), lists.take(part)], names=["label", "pivot", "node", "copies", "unit", "near"])

    return distinct.select("label", "node", "copies", "unit").mapInArrow(run, "label string, pivot int, node long, copies long, unit array<double>, near array<int>")


def verified(lists: DataFrame, least: float, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """src, dst, links: for each vector the number of its verified partners (dst null), and the links of a spanning forest (links 0).

    A pair is compared in the list of the first pivot that both have, if they
    share enough. Long lists are cut into blocks by hash and dealt as pairs of
    blocks; pairs stay inside the tasks.
    """
    sizes = lists.groupBy("label", "pivot").count().select("label", "pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = lists.join(sizes, ["label", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node", "unit"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "unit", "near")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "block"))
        size = pc.list_value_length(table["unit"]).to_numpy()
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            if len(at) < 2:
                continue
            part = table.take(pa.array(at))
            unit = pc.list_flatten(part["unit"]).to_numpy().reshape(len(at), int(length))
            near = part["near"].to_pylist()
            need = min(shared, min(map(len, near)))
            known = {q: k for k, q in enumerate(sorted({q for x in near for q in x}))}
            bits = np.zeros((len(at), len(known) // 64 + 1), np.uint64)
            for r, x in enumerate(near):
                for q in x:
                    bits[r, known[q] // 64] |= np.uint64(1) << np.uint64(known[q] % 64)
            lower = np.zeros(bits.shape[1], np.uint64)
            for q in (k for v, k in known.items() if v < pivot):
                lower[q // 64] |= np.uint64(1) << np.uint64(q % 64)
            left = np.flatnonzero(side[at] == low)
            right = left if low == high else np.flatnonzero(side[at] == high)
            for rows in np.array_split(left, max(1, len(left) // 256)):
                count = np.zeros((len(rows), len(right)), np.uint16)
                early = np.zeros((len(rows), len(right)), bool)
                for k in range(bits.shape[1]):
                    both = bits[rows, k][:, None] & bits[right, k][None, :]
                    count += np.bitwise_count(both)
                    if lower[k]:
                        early |= (both & lower[k]) != 0
                i, j = np.nonzero((count >= need) & ~early)
                i, j = rows[i], right[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                for at2 in range(0, len(i), 65536):
                    x, y = i[at2 : at2 + 65536], j[at2 : at2 + 65536]
                    good = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                    x, y = at[x[good]], at[y[good]]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    forest.add(x, y)
        ends = np.array(forest.links, np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        return pa.table(
            {
                "src": np.concatenate([node[some], node[ends[:, 0]]]),
                "dst": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[ends[:, 1]], pa.int64())]),
                "links": np.concatenate([links[some], np.zeros(len(ends), np.int64)]),
            }
        )

    return dealt.groupBy("label", "pivot", "low", "high").applyInArrow(compare, "src long, dst long, links long")


def near_duplicates(embeddings: DataFrame, least: float = 0.93, nearest: int = NEAREST, shared: int = SHARED, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings.

    Vectors of equal, non-null labels and lengths are linked at a cosine of
    `least` or more, if they share enough of their nearest pivots, as nearly
    all of them do; if exact, whether they do or not: then all vectors of a
    label are one list, dealt out as pairs of blocks. Equal vectors are one point of the index, with a count.
    A vector that is null, zero, or has null or non-finite components links
    with nothing, nor does one of null vec_id. Rows that share a vec_id are
    one node, with the links of all of them. Other columns are ignored.
    """
    rows = _work.stored(describe(embeddings), "vectors")
    usable = rows.filter("key is not null and vec_id is not null")
    distinct = _work.stored(usable.groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "points")
    found = _work.stored(verified(inverted_lists(distinct, [] if exact else fit_pivots(distinct), nearest), least, shared), "links")
    again = usable.groupBy("vec_id").agg(F.min_by("key", "key").alias("k"), F.max("key").alias("l")).filter("k <> l").select("vec_id")
    same = usable.join(again, "vec_id").join(distinct, ["label", "key"]).select(F.col("vec_id").alias("src"), F.col("node").alias("dst"))
    components = connected_components(found.filter("dst is not null").select("src", "dst").union(same))
    counts = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    points = distinct.drop("unit").join(counts, "node", "left").join(components, "node", "left")
    points = points.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.drop("unit").join(points, ["label", "key"], "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
