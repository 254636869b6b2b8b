"""Global numbering and nearest neighbours without a task or a key that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parallaxis.functions import vec as v
from parallaxis.scratch import cut

#: A block has two to this power rows at most, and so many points meet one in a task.
BLOCK_BITS, SHARE = 11, 16384


def numbered(df: DataFrame, *order: str, name: str = "place", ranges: tuple[str, int] | None = None) -> DataFrame:
    """df with its rows' numbers, from 1, in an order that tells all rows apart.

    Rows are sorted in ranges and numbered inside them; the sizes of the
    ranges, a row for each, tell where each begins. Ranges are sampled, for
    which df is computed twice, unless a column holds them, numbers from 0 to
    below so many, which don't fall in this order.
    """
    dealt = df.repartitionById(ranges[1], ranges[0]).drop(ranges[0]) if ranges else df.repartitionByRange(*order)
    rows = cut(dealt.sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id()))
    part = F.shiftright("_number", 33)
    sizes = rows.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = rows.withColumn("_range", part).join(F.broadcast(begins), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_number", "_before")


def _z_order(low: str, extent: Column) -> Column:
    """The bits of x, y and z between low and low + extent, in turn, in 63 bits: what is near in this order is near in space."""
    steps = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
    out = F.lit(0).cast("long")
    for k, c in enumerate("xyz"):
        bits = F.floor(v.clamp((F.col(c) - F.col(low + c)) / extent, 0, 1) * float((1 << 21) - 1)).cast("long")
        for shift, mask in steps:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(bits, k))
    return out


def in_z_order(df: DataFrame, *order: str) -> DataFrame:
    """df (x, y, z, l* and extent: the corner and width of its group) with its `number`, kept: its place in ranges sorted by order, then space. number >> BLOCK_BITS tells blocks of rows that lie together."""
    placed = df.withColumn("_z", _z_order("l", F.col("extent")))
    return cut(placed.repartitionByRange(*order, "_z", "x", "y", "z").sortWithinPartitions(*order, "_z").drop("_z", "lx", "ly", "lz", "extent").withColumn("number", F.monotonically_increasing_id()))


def extents(points: DataFrame, *keys: str) -> DataFrame:
    """keys, l* and extent of each group."""
    sides = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"), F.lit(1e-6))
    return points.groupBy(*keys).agg(*(F.min(c).alias("l" + c) for c in "xyz"), sides.alias("extent"))


def finite(points: DataFrame) -> DataFrame:
    for c in "xyz":
        points = points.filter(F.abs(F.col(c)) < float("inf"))  # null and NaN go as well
    return points


def _coordinates(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(t[c], float) for c in "xyz"], 1)


def _boxes(t: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Blocks, low and high corners and rows of blocks, by group."""
    group = np.asarray(t["group"])
    columns = np.asarray(t["block"]), *(np.stack([np.asarray(t[m + c], float) for c in "xyz"], 1) for m in ("min", "max")), np.asarray(t["n"])
    return {int(g): tuple(c[group == g] for c in columns) for g in np.unique(group)}


def _steps(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows such that each meets m others within a million pairs."""
    step = max(1, 1_000_000 // max(m, 1))
    return (slice(k, k + step) for k in range(0, n, step))


def _first_block(at: np.ndarray, boxes: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """For each point the block, of k rows or more if any has, whose far corner is nearest."""
    block, low, high, n = boxes
    if (n >= k).any():
        block, low, high = (x[n >= k] for x in (block, low, high))
    out = np.empty(len(at), np.int64)
    for s in _steps(len(at), len(block)):
        far = np.maximum(np.abs(at[s, None] - low), np.abs(at[s, None] - high))
        out[s] = block[(far * far).sum(2).argmin(1)]
    return out


def _met_blocks(at: np.ndarray, reach: np.ndarray, boxes: tuple[np.ndarray, ...], own: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, blocks): blocks but their own that points reach."""
    block, low, high, _ = boxes
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s in _steps(len(at), len(block)):
        gap = np.maximum(np.maximum(low - at[s, None], at[s, None] - high), 0.0)
        p, b = np.nonzero((np.sqrt((gap * gap).sum(2)) <= reach[s, None] * (1 + 1e-9) + 1e-9) & (block != own))
        out.append((p + s.start, block[b]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _nearest(at: np.ndarray, reach: np.ndarray, targets: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(points, targets, distances) in order: the k nearest targets of each point that it reaches; ties by the targets' rank."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for s in _steps(len(at), len(targets)):
        d = at[s, None] - targets
        d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
        d = np.where(d < 4096.0, np.round(d, 12), d)
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
        p, t = np.nonzero(d <= np.minimum(most, reach[s])[:, None])
        order = np.lexsort((rank[t], d[p, t], p))
        p, t = p[order], t[order]
        kept = np.arange(len(p)) - np.searchsorted(p, p) < k
        out.append((p[kept] + s.start, t[kept], d[p, t][kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists(n: int, rows: np.ndarray, values: pa.Array) -> pa.ListArray:
    """One list a row, of the values whose row it is; rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def nearest_lists(points: DataFrame, targets: DataFrame, k: int, *within: str) -> DataFrame:
    """within, point_id, near: the k targets nearest to each point of its group as an array of (distance, target_id), in order; fewer where the group has fewer.

    points: within, point_id, x, y, z; targets: within, target_id, x, y, z;
    rows without a place don't count. Of equal targets k are enough. Targets
    are sorted in space and cut into blocks, whose boxes, a row each, all tasks
    know. Each point meets one block, then those that its k-th distance so far
    reaches; a block that many points meet is given to several tasks.
    """
    keys, xyz = list(within), ("x", "y", "z")
    bits, share = BLOCK_BITS, SHARE
    copies = Window.partitionBy(*keys, *xyz).orderBy("target_id")
    targets = finite(targets.select(*keys, "target_id", *(F.col(c).cast("double").alias(c) for c in xyz)))
    targets = cut(targets.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy"))
    groups = cut(extents(targets, *keys).withColumn("group", F.monotonically_increasing_id()))
    grouped = lambda df, g: df.join(g, keys) if keys else df.crossJoin(F.broadcast(g))
    blocks = in_z_order(grouped(targets, groups).drop(*keys), "group").withColumn("block", F.shiftright("number", bits)).drop("number")
    ends = (f(c).alias(f"{m}{c}") for m, f in (("min", F.min), ("max", F.max)) for c in xyz)
    boxes = cut(blocks.groupBy("group", "block").agg(*ends, F.count("*").alias("n")).withColumn("of", F.count("*").over(Window.partitionBy("group"))))
    several = _boxes(boxes.filter("of > 1").toArrow())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, group = _coordinates(b), np.asarray(b["group"])
            block = np.asarray(b["block"].fill_null(-1)).copy()
            for g in np.unique(group[block < 0]):
                if g in several:
                    own = (group == g) & (block < 0)
                    block[own] = _first_block(at[own], several[g], k)
            b = b.set_column(b.schema.get_field_index("block"), "block", pa.array(block))
            yield b.filter(pa.array(block >= 0))

    points = finite(points.select(*keys, "point_id", *(F.col(c).cast("double").alias(c) for c in xyz)))
    only = groups.select(*keys, "group").join(boxes.filter("of = 1").select("group", "block"), "group", "left")
    points = grouped(points, only).select("group", "point_id", *xyz, "block", F.lit(float("inf")).alias("reach"))
    target = targets.schema["target_id"].dataType
    made = points.select("group", "point_id", *xyz).schema.add("near", T.ArrayType(T.StructType().add("distance", "double").add("target_id", target))).add("others", T.ArrayType(T.LongType()))
    empty = to_arrow_schema(made).empty_table()

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        at, group, reach = _coordinates(left), np.asarray(left["group"]), np.asarray(left["reach"], float)
        there, of, own = _coordinates(right), np.asarray(right["group"]), key[0].as_py()
        ids = right["target_id"].combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        found, others = [], []
        for g in np.unique(group):
            mine, its = np.flatnonzero(group == g), np.flatnonzero(of == g)
            p, t, d = _nearest(at[mine], reach[mine], there[its], rank[its], k)
            found.append((mine[p], its[t], d))
            if g in several and np.isinf(reach[mine]).all():
                last = np.full(len(mine), np.inf)
                full = np.bincount(p, minlength=len(mine)) >= k
                ends = np.searchsorted(p, np.arange(len(mine)), side="right") - 1
                last[full] = d[ends[full]]
                p, b = _met_blocks(at[mine], last, several[g], own)
                others.append((mine[p], b))
        p, t, d = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(p, kind="stable")
        p, t, d = p[order], t[order], d[order]
        near = pa.StructArray.from_arrays([pa.array(d), ids.take(pa.array(t))], ["distance", "target_id"])
        q, b = (np.concatenate(x) for x in zip(*others)) if others else (np.zeros(0, np.int64),) * 2
        order = np.argsort(q, kind="stable")
        own = left.select(["group", "point_id", *xyz])
        return own.append_column("near", _lists(len(at), p, near)).append_column("others", _lists(len(at), q[order], pa.array(b[order])))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(key, left, right) if left.num_rows and right.num_rows else empty

    def met(some: DataFrame) -> DataFrame:
        """some with the nearest in their block; a block and its points are dealt in shares."""
        shares = F.broadcast(some.groupBy("block").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")))
        dealt = some.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("point_id", "x", "y"), F.col("shares")).cast("int")).drop("shares")
        given = blocks.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        return dealt.groupBy("block", "share").cogroup(given.groupBy("block", "share")).applyInArrow(run, made)

    first = cut(met(cut(points.mapInArrow(choose, points.schema))))
    open_ = first.filter(F.size("others") > 0)
    reach = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(F.lit(1e308))
    more = met(open_.select("group", "point_id", *xyz, F.explode("others").alias("block"), reach.alias("reach"))).filter(F.size("near") > 0)
    both = open_.select("group", "point_id", "near").union(more.select("group", "point_id", "near")).groupBy("group", "point_id")
    both = cut(both.agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")))
    out = first.filter(F.size("others") == 0).select("group", "point_id", "near").union(both)
    return out.join(groups.select(*keys, "group"), "group").select(*keys, "point_id", "near") if keys else out.select("point_id", "near")


def k_nearest(points: DataFrame, targets: DataFrame, k: int, *within: str) -> DataFrame:
    """within, point_id, target_id, distance, rank of nearest_lists, a row each."""
    out = nearest_lists(points, targets, k, *within).select(*within, "point_id", F.posexplode("near").alias("rank", "t"))
    return out.select(*within, "point_id", "t.target_id", "t.distance", (F.col("rank") + 1).alias("rank"))


def median(df: DataFrame, value: str, *keys: str, accuracy: int = 10_000) -> DataFrame:
    """keys, value: the exact median of each group, its mean where two are in the middle.

    A sketch tells between which values it lies, a few in a thousand of all;
    only those are ordered.
    """
    margin = 10.0 / accuracy
    about = df.groupBy(*keys).agg(F.percentile_approx(value, [0.5 - margin, 0.5 + margin], accuracy).alias("_ends"), F.count(value).alias("_n"))
    about = cut(about)
    met = df.join(F.broadcast(about), list(keys)).filter(F.col(value) <= F.col("_ends")[1])
    counts = met.groupBy(*keys, F.greatest(F.col(value), F.col("_ends")[0]).alias(value)).agg(F.count("*").alias("_here"), F.first("_n").alias("_n"))
    upto = F.sum("_here").over(Window.partitionBy(*keys).orderBy(value))
    middle = lambda f: F.min(F.when(F.col("_upto") > f((F.col("_n") - 1) / 2), F.col(value)))
    return counts.withColumn("_upto", upto).groupBy(*keys).agg(((middle(F.floor) + middle(F.ceil)) / 2).alias(value))
