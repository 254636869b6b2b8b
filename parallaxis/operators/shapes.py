"""Hulls, simplification, contours and samples of polygons and masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import poly


def hull_of(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost (lowest) point, collinear points left out; fewer than three different points as they are."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hulls(points: DataFrame, *keys: str, salts: int = 16) -> DataFrame:
    """keys, place, x, y: the hull of each group's points, in order. Parts of a group are hulled apart first, so a large group is no single task's."""
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "place int, x double, y double"])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = hull_of(np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]))
        columns = {k: pa.array([v.as_py()] * len(h), v.type) for k, v in zip(keys, key)}
        return pa.table({**columns, "place": pa.array(range(len(h)), pa.int32()), "x": h[:, 0], "y": h[:, 1]})

    rows = points.select(*keys, F.col("x").cast("double"), F.col("y").cast("double")).filter("x is not null and y is not null")
    part = rows.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy(*keys, "salt").applyInArrow(run, schema).drop("place")
    return part.groupBy(*keys).applyInArrow(run, schema)


def hull_or_box(points: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, polygon: the hull of foreground points where it has three corners, else the box (left, top, right, bottom)."""
    h = hulls(points, *keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: poly.point(p["x"], p["y"])).alias("hull"))
    box = poly.box_polygon(*(F.col(c).cast("double") for c in ("left", "top", "right", "bottom")))
    return boxes.join(h, list(keys), "left").select(*keys, F.when(F.size("hull") >= 3, F.col("hull")).otherwise(box).alias("polygon"))


def polygon_arrays(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each polygon's points begin, how many they are (none where it is null), and x and y of all points."""
    if isinstance(polygons, pa.ChunkedArray):
        polygons = pa.concat_arrays(polygons.chunks)
    at = polygons.offsets.to_numpy().astype(np.int64)
    n = np.where(polygons.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
    return at[:-1], n, np.stack([polygons.values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], 1)


def polygon_lists(n: np.ndarray, points: np.ndarray) -> pa.ListArray:
    """Polygons of n points each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"]))


def _firsts_of_most(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each group of n (one or more) and its first place."""
    begin = np.cumsum(n) - n
    most, group = np.maximum.reduceat(values, begin), np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(values == most[group])
    return most, np.append(at, 0)[np.searchsorted(group[at], np.arange(len(n)))]  # where none is, most isn't a number


def simplified(begin: np.ndarray, n: np.ndarray, points: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """How many points are left of each ring (from begin, n of them), and those points: all rings are split at once, a level after the other."""
    row, k = counted(n + 1)
    at = begin[row] + np.where(k < n[row], k, 0)  # each ring closed by its first point
    p = np.append(points, [[np.nan, np.nan]], 0)[np.where(n[row] > 0, at, len(points))]
    first = np.cumsum(n + 1) - n - 1
    kept = np.ones(len(p), bool)
    some = np.flatnonzero(n >= 4)
    if len(some):
        inner, own = np.flatnonzero((n[row] >= 4) & (k < n[row])), n[some]
        q, lo = p[inner], np.cumsum(own) - own
        far = np.full(len(n), np.nan)
        far[some] = tolerance * np.hypot(*(np.maximum.reduceat(q, lo) - np.minimum.reduceat(q, lo)).T)
        _, split = _firsts_of_most(((q - np.repeat(p[first[some]], own, 0)) ** 2).sum(1), own)
        split = inner[split]
        kept[inner] = False
        kept[first[some]] = kept[split] = True
        a, b = np.concatenate([first[some], split]), np.concatenate([split, first[some] + own])
        while True:
            a, b = a[b - a > 1], b[b - a > 1]
            if not len(a):
                break
            seg, j = counted(b - a - 1)
            d, s = (p[b] - p[a])[seg], p[a[seg] + 1 + j] - p[a][seg]
            long = np.hypot(d[:, 0], d[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                away = np.where(long > 0, np.abs(d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / long, np.hypot(s[:, 0], s[:, 1]))
            most, place = _firsts_of_most(away, b - a - 1)
            more = most > far[row[a]]
            a, b, at = a[more], b[more], (a[seg[place]] + 1 + j[place])[more]
            kept[at] = True
            a, b = np.concatenate([a, at]), np.concatenate([at, b])
    kept &= k < n[row]
    left = np.bincount(row[kept], minlength=len(n))
    kept |= (left < 3)[row] & (k < n[row])
    return np.bincount(row[kept], minlength=len(n)), p[kept]


def simplify(polygons: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """polygons with polygon simplified by Douglas and Peucker's rule; the tolerance is a share of the box's diagonal. Rings stay rings: the farthest two vertices split them."""
    own = polygons.withColumn("polygon", F.col("polygon").cast("array<struct<x:double,y:double>>"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("polygon")
            made = polygon_lists(*simplified(*polygon_arrays(batch.column(at)), tolerance))
            nulls = batch.column(at).is_null()
            yield batch.set_column(at, "polygon", pc.if_else(nulls, pa.scalar(None, made.type), made))

    return own.mapInArrow(run, own.schema)


def boundary(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, y, x, label) of which some neighbour, up, down, left or right, has another label or none."""
    inner = cells
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        moved = cells.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "label")
        inner = inner.join(moved, [*keys, "y", "x", "label"], "left_semi")
    return cells.join(inner, [*keys, "y", "x", "label"], "left_anti")


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place n times, and the numbers from 0 of those times."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def outlines(owner: np.ndarray, y: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owners, corners of each, points, cells of the part and of all parts: the outline of the largest 4-connected part (of equal ones the first) of each owner's runs of cells (y, x, n).

    The sides of runs are the nodes of the outlines, up on the left and down on
    the right; at a pinch an outline stays with its cell. Those of all owners
    are followed at once, from one turn to the next.
    """
    order = np.lexsort((x, y, owner))
    owner, y, a = (c[order] for c in (owner, y, x))
    b = a + n[order]
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(y, prepend=0) != 0) | (a != np.append(0, b[:-1])) | (np.arange(len(a)) == 0))
    owner, y, a, b = owner[new], y[new], a[new], b[np.append(new[1:], len(a)) - 1]  # runs that meet are one
    runs = np.arange(len(a))
    line = np.cumsum((np.diff(owner, prepend=-1) != 0) | (np.diff(y, prepend=0) != 0) | (runs == 0)) - 1
    head = np.flatnonzero(np.diff(line, prepend=-1))
    follows = np.append((owner[head][1:] == owner[head][:-1]) & (y[head][1:] == y[head][:-1] + 1), False)
    above, below = np.where(np.append(False, follows[:-1]), np.arange(len(head)) - 1, -1)[line], np.where(follows, np.arange(len(head)) + 1, -1)[line]
    low, wide = a.min(), b.max() - a.min() + 1
    key, line_ = line * wide + a - low, np.append(line, -2)

    def last(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The last run that begins at x or before it in the given lines, or the one before that line's first."""
        return np.searchsorted(key, of * wide + x - low, side="right") - 1

    # parts: runs of neighbouring lines that share a column
    begin, end = last(above, a), last(above, b - 1)
    begin = np.where((begin >= 0) & (line_[begin] == above) & (b[begin] > a), begin, begin + 1)
    i, k = counted(np.where(above >= 0, np.maximum(end - begin + 1, 0), 0))
    j, part = begin[i] + k, runs.copy()
    while len(i):
        one, two = part[i], part[j]
        i, j = i[one != two], j[one != two]
        np.minimum.at(part, np.maximum(one, two), np.minimum(one, two))
        while (part[part] != part).any():
            part = part[part]
    cells = np.bincount(part, weights=b - a, minlength=len(a)).astype(np.int64)
    of = np.flatnonzero(np.diff(owner, prepend=-1))
    size, start = _firsts_of_most(cells.astype(float), np.diff(of, append=len(a)))
    # where each side leads: node 2 k is the left of run k, 2 k + 1 its right
    j = last(above, a)
    up, next_up = (above >= 0) & (line_[j] == above), (above >= 0) & (line_[j + 1] == above)
    covers, before = up & (b[j] > a), np.where(np.append(True, line[1:] != line[:-1]), low - 1, np.append(0, b[:-1]))
    right_on = np.where(next_up & (np.append(a, 0)[j + 1] < b), 2 * (j + 1), 2 * runs + 1)
    left = np.where(covers, np.where((a[j] < a) & (before > a[j]), 2 * runs - 1, 2 * j), right_on)
    left_straight = covers & (a[j] == a)
    j = last(below, b - 1)
    down = (below >= 0) & (line_[j] == below)
    covers, after = down & (b[j] >= b), np.where(np.append(line[1:] != line[:-1], True), low + wide, np.append(a[1:], 0))
    right = np.where(covers, np.where((b[j] > b) & (after < b[j]), 2 * runs + 2, 2 * j + 1), np.where(down & (b[j] > a), 2 * j + 1, 2 * runs))
    right_straight = covers & (b[j] == b)
    to, straight, at = (np.stack(c, 1).ravel() for c in ((left, right), (left_straight, right_straight), (a, b)))
    turn = np.where(straight, to, np.arange(len(to)))
    while straight[turn].any():
        turn = turn[turn]
    to = turn[to]
    ring, node, found = np.arange(len(of)), 2 * start, []
    while len(ring):
        found.append((ring, node))
        node = to[node]
        ring, node = (c[node != 2 * start[ring]] for c in (ring, node))
    ring, node = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(ring, kind="stable")
    node, corners = node[order], 2 * np.bincount(ring, minlength=len(of))
    high = y[node // 2] + node % 2
    points = np.stack([np.stack([at[node], at[to[node]]], 1).ravel(), np.repeat(high, 2)], 1).astype(float)
    return owner[of], corners, points, size.astype(np.int64), np.add.reduceat(b - a, of)


def largest_contours(cells: DataFrame, key: str) -> DataFrame:
    """key, label, polygon, area, pixels: the outline of the largest 4-connected part of each label, by corners of its cells in order, that part's cells and all of the label's. A task holds the labels of an image."""

    def run(table: pa.Table) -> pa.Table:
        place = np.unique(np.stack([table[c].to_numpy().astype(np.int64) for c in ("label", "y", "x")], 1), axis=0)
        labels, owner = np.unique(place[:, 0], return_inverse=True)
        _, corners, points, area, pixels = outlines(owner, place[:, 1], place[:, 2], np.ones(len(place), np.int64))
        columns = {"label": pa.array(labels, pa.int64()), "polygon": polygon_lists(corners, points), "area": pa.array(area, pa.int64()), "pixels": pa.array(pixels, pa.int64())}
        return pa.table({key: pa.array([table[key][0].as_py()] * len(labels), table.schema.field(key).type), **columns})

    kind = dict(cells.dtypes)[key]
    rows = cells.select(key, F.col("label").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"))
    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, label long, polygon array<struct<x:double,y:double>>, area long, pixels long")


def run_contours(runs: DataFrame, key: str) -> DataFrame:
    """The same for labels given by their runs (key, label, runs of y, x, n), those of a batch at once."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            y, x, n = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            if len(batch):
                _, corners, points, area, pixels = outlines(owner, y, x, n)
                columns = [batch.column(0), batch.column(1), polygon_lists(corners, points), pa.array(area, pa.int64()), pa.array(pixels, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "label", "polygon", "area", "pixels"])

    kind = dict(runs.dtypes)[key]
    rows = runs.select(key, F.col("label").cast("long"), "runs").filter("size(runs) > 0")
    return rows.mapInArrow(run, f"{key} {kind}, label long, polygon array<struct<x:double,y:double>>, area long, pixels long")


def samples(polygons: DataFrame, *keys: str, most: int = 20, tries: int = 100) -> DataFrame:
    """keys, place, x, y: up to `most` whole points inside each polygon, its centre first if that lies inside; drawn by hash, so reruns agree."""
    b = poly.bounds(F.col("polygon"))
    box = {k: F.floor(c).alias(k) for k, c in b.items()}
    rows = polygons.select(*keys, "polygon", *box.values(), poly.centre(F.col("polygon")).alias("c")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most * tries))))
    draw = lambda salt, low, high: F.col(low) + F.pmod(F.xxhash64(*keys, "k", F.lit(salt)), F.greatest(F.col(high) - F.col(low), F.lit(0)) + 1)
    rows = rows.withColumn("x", F.when(F.col("k") == 0, F.col("c.x")).otherwise(draw(1, "left", "right"))).withColumn("y", F.when(F.col("k") == 0, F.col("c.y")).otherwise(draw(2, "top", "bottom")))
    inside = rows.filter(poly.contains(F.col("polygon"), F.col("x"), F.col("y"))).groupBy(*keys, "x", "y").agg(F.min("k").alias("k"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("k"))
    return inside.withColumn("place", place).filter(F.col("place") <= most).select(*keys, "place", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def _inside(p: np.ndarray, polygon: np.ndarray) -> bool:
    """Whether a point lies in a convex counter-clockwise polygon or on its border."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    return bool(((b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0]) >= -1e-9).all())


def _crossings(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Where the edges of two polygons cross."""
    out = []
    for p, q in zip(a, np.roll(a, -1, axis=0)):
        for r, s in zip(b, np.roll(b, -1, axis=0)):
            u, w, d = q - p, s - r, r - p
            den = u[0] * w[1] - u[1] * w[0]
            if abs(den) > 1e-12:
                t, k = (d[0] * w[1] - d[1] * w[0]) / den, (d[0] * u[1] - d[1] * u[0]) / den
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= k <= 1 + 1e-9:
                    out.append(p + t * u)
    return out


def covered_hull(polygons: list[np.ndarray], share: float = 0.3) -> np.ndarray:
    """Hull of the area that at least this share of the outlines (hulled, one at least) covers; of all of them where that area has no three corners."""
    outlines = [h for h in map(hull_of, polygons) if len(h) > 2]
    need = max(1, int(np.ceil(share * len(outlines) - 1e-9)))
    corners = [p for h in outlines for p in h] + [p for k, a in enumerate(outlines) for b in outlines[k + 1 :] for p in _crossings(a, b)]
    kept = [p for p in corners if sum(_inside(p, h) for h in outlines) >= need]
    hull = hull_of(np.round(np.array(kept), 9)) if len(kept) > 2 else np.zeros((0, 2))
    return hull if len(hull) > 2 else hull_of(np.concatenate(polygons)) if polygons else np.zeros((0, 2))


def coverage_hulls(outlines: DataFrame, *keys: str, share: float = 0.3) -> DataFrame:
    """keys, place, x, y: the corners, in order, of the area that `share` of each group's outlines (column polygon) covers. A group is a zone with the few projections that it keeps."""
    fields = {f.name: f.dataType.simpleString() for f in outlines.schema.fields}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = covered_hull([np.array([(p["x"], p["y"]) for p in x], float) for x in table["polygon"].to_pylist() if x], share)
        columns = {k: pa.array([v.as_py()] * len(h), v.type) for k, v in zip(keys, key)}
        return pa.table({**columns, "place": pa.array(range(len(h)), pa.int32()), "x": h[:, 0], "y": h[:, 1]})

    return outlines.select(*keys, "polygon").groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} {fields[k]}" for k in keys), "place int, x double, y double"]))
