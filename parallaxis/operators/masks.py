"""Label masks painted from boxes or polygons inside tasks: shapes are shuffled by image, cells never are, and boxes are painted as rectangles between the lines at which some box begins or ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.operators.frames import whole_groups
from parallaxis.operators.shapes import counted, outlines, polygon_lists

#: Bits of a tile's side, tiles painted at once, and cells that rows are cut at: an image's boxes may be many and large, a task holds few of them.
BITS, TILES, CELLS = 8, 32, 1 << 20
SIDE = 1 << BITS


class Parts(NamedTuple):
    """Rectangles of masks (y, x, h, w) in the order of bands of lines, and the row that owns each in each layer, -1 for none."""

    own: np.ndarray
    y: np.ndarray
    x: np.ndarray
    h: np.ndarray
    w: np.ndarray

    def of(self, layer: int) -> tuple[np.ndarray, Parts]:
        """The rows that own rectangles in a layer, and those rectangles by row."""
        order = np.argsort(self.own[layer], kind="stable")
        order = order[np.searchsorted(self.own[layer][order], 0) :]
        return self.own[layer][order], Parts(self.own[:, order], *(c[order] for c in self[1:]))


Emit = Callable[[pa.Table, Parts], pa.Table]


def _shapes(shapes: DataFrame, *keys: str, layer: int = 0) -> DataFrame:
    """keys, ty, tx, layer, det, x0, y0, x1, y1 (inclusive), polygon if there is one: the part of each shape's extent in each tile that it touches."""
    drawn = "polygon" in shapes.columns
    b = poly.bounds(F.col("polygon")) if drawn else poly.box_columns()
    low = {"x0": F.ceil(b["left"]).cast("int"), "y0": F.ceil(b["top"]).cast("int")}
    high = {"x1": F.floor(b["right"]).cast("int"), "y1": F.floor(b["bottom"]).cast("int")}
    if not drawn:
        high = {"x1": F.greatest(low["x0"], (F.ceil(b["right"]) - 1).cast("int")), "y1": F.greatest(low["y0"], (F.ceil(b["bottom"]) - 1).cast("int"))}
    own = [F.col("polygon").cast("array<struct<x:double,y:double>>").alias("polygon")] if drawn else []
    rows = shapes.select(*keys, F.lit(layer).alias("layer"), "det", *(c.alias(k) for k, c in {**low, **high}.items()), *own).filter("x0 <= x1 and y0 <= y1")
    for c in "yx":
        rows = rows.withColumn("t" + c, F.explode(F.sequence(F.shiftright(c + "0", BITS), F.shiftright(c + "1", BITS))))
    return rows.withColumns({**{c + "0": F.greatest(F.col(c + "0"), F.shiftleft("t" + c, BITS)) for c in "xy"}, **{c + "1": F.least(F.col(c + "1"), F.shiftleft("t" + c, BITS) + SIDE - 1) for c in "xy"}})


def _sizes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows[c + "1"].to_numpy().astype(np.int64) - rows[c + "0"].to_numpy() + 1 for c in "xy")


def _inside(polygons: pa.ChunkedArray, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """poly.contains for cells x, y and the polygons of their rows."""
    lists = polygons.combine_chunks()
    lists = pa.concat_arrays([lists]) if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    start, n = lists.offsets.to_numpy()[:-1].astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    px, py = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    on, odd = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for e in range(int(n.max(initial=0))):
        some = n > e
        at, to = np.where(some, start + e, 0), np.where(some, start + (e + 1) % np.maximum(n, 1), 0)
        ax, ay, bx, by = (v[row] for v in (px[at], py[at], px[to], py[to]))
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        here = some[row]
        on |= here & (turn == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= here & ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return (n >= 3)[row] & (on | odd)


def _lines(rows: pa.Table, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, band, and x from and to of the parts of rows that lie in bands of lines, rows in order; and tile, y and height of the bands, between which no row begins or ends."""
    x0, y0 = (rows[c + "0"].to_numpy().astype(np.int64) for c in "xy")
    w, h = _sizes(rows)
    drawn = "polygon" in rows.column_names
    cut = np.full((tile[-1] + 1, SIDE + 1), drawn)
    for y in (y0 & (SIDE - 1), (y0 & (SIDE - 1)) + h):
        cut[tile, y] = True
    at, rank = np.flatnonzero(cut), np.cumsum(cut.ravel(), dtype=np.int32).astype(np.int64) - 1
    place = tile * (SIDE + 1) + (y0 & (SIDE - 1))
    if drawn:
        row, k = counted(w * h)
        dy = k // w[row]
        x, y = x0[row] + k - dy * w[row], y0[row] + dy
        kept = _inside(rows["polygon"], row, x, y)
        row, x, dy = row[kept], x[kept] & (SIDE - 1), dy[kept]
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(dy, prepend=-1) != 0) | (np.diff(x, prepend=-1) != 1))
        n = np.diff(start, append=len(row))
        row, x, band = row[start], x[start], rank[(place[row] + dy)[start]]
    else:
        row, k = counted(rank[place + h] - rank[place])
        x, n, band = (x0 & (SIDE - 1))[row], w[row], rank[place][row] + k
    return row, band, x, x + n, at // (SIDE + 1), at % (SIDE + 1), np.diff(at, append=at[-1:])


def _owned(rows: pa.Table, tile: np.ndarray, layers: int) -> Parts:
    """Rectangles of the rows' tiles, line by line, and in each layer the row that keeps them: later rows paint over earlier ones."""
    row, band, begin, end, of, top, high = _lines(rows, tile)
    cut = np.zeros((len(of), SIDE + 1), bool)
    for x in (begin, end):
        cut[band, x] = True
    at, rank = np.flatnonzero(cut), np.cumsum(cut.ravel(), dtype=np.int32).astype(np.int64) - 1
    first = rank[band * (SIDE + 1) + begin]
    which, k = counted(rank[band * (SIDE + 1) + end] - first)
    own = np.full((layers, len(at)), -1, np.int64)
    own[rows["layer"].to_numpy()[row][which], first[which] + k] = row[which]
    some = np.flatnonzero((own >= 0).any(0))
    band, wide = at[some] // (SIDE + 1), np.diff(at, append=at[-1:])[some]
    corner = [rows["t" + c].to_numpy().astype(np.int64)[np.unique(tile, return_index=True)[1]][of[band]] << BITS for c in "yx"]
    return Parts(own[:, some], corner[0] + top[band], corner[1] + at[some] % (SIDE + 1), high[band], wide)


def starts(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where rows differ from the one before in one of the columns."""
    new = np.zeros(len(rows) - 1, bool)
    for c in columns:
        a, b = rows[c].slice(1), rows[c].slice(0, len(rows) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new |= ~same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else ~same.to_numpy()
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _painter(groups: tuple[str, ...], layers: int, emit: Emit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes, of sorted rows, what emit makes of the rows and parts of each image's tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def painted(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(first) - 1, TILES):
                bounds = first[k : k + TILES + 1]
                some = rows.slice(bounds[0], bounds[-1] - bounds[0])
                yield from emit(some, _owned(some, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), layers)).to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            w, h = _sizes(table)
            part = np.cumsum(w * h) // CELLS
            ends = np.concatenate([np.flatnonzero(np.diff(part)) + 1, [len(table)]])
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
                rows = table.slice(a, b - a) if held is None else pa.concat_tables([held, table.slice(a, b - a)]).combine_chunks()
                if len(rows):
                    first = starts(rows, groups)
                    held = rows.slice(first[-1])
                    yield from painted(rows, first)
                    w, h = _sizes(held)
                    if (w * h).sum() > CELLS:  # one tile with very many boxes goes on as the rectangles that they leave
                        left = [_owned(held, np.zeros(len(held), np.int64), layers).of(n) for n in range(layers)]
                        row = np.concatenate([r for r, _ in left])
                        order = np.argsort(row, kind="stable")
                        held = held.take(pa.array(row[order]))
                        for c, to in (("x0", lambda p: p.x), ("x1", lambda p: p.x + p.w - 1), ("y0", lambda p: p.y), ("y1", lambda p: p.y + p.h - 1)):
                            held = held.set_column(held.column_names.index(c), held.schema.field(c), pa.array(np.concatenate([to(p) for _, p in left])[order].astype(np.int32)))
        if held is not None:
            yield from painted(held, np.array([0, len(held)]))

    return run


def _paint(shapes: DataFrame, keys: tuple[str, ...], layers: int, emit: Emit, schema: str, whole: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """What emit makes of the rows and parts of each image's tiles, or what whole makes of that, where a task has all tiles of an image, one after the other."""
    groups = (*keys, "ty", "tx")
    run = _painter(groups, layers, emit)
    ordered = shapes.repartition(*(keys if whole else groups)).sortWithinPartitions(*groups, "det")
    return ordered.mapInArrow((lambda batches: whole(run(batches))) if whole else run, schema)


def _types(shapes: DataFrame, *names: str) -> dict[str, str]:
    kinds = dict(shapes.dtypes)
    return {n: kinds[n] for n in names}


def _named(rows: pa.Table, keys: tuple[str, ...], row: np.ndarray) -> dict[str, pa.ChunkedArray]:
    return {k: rows[k].take(pa.array(row)) for k in keys}


def cells(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, label: cells inside shapes (det, and left, top, right, bottom or a polygon); where they overlap the larger det wins."""
    kinds = _types(shapes, *keys, "det")

    def emit(rows, parts):
        row, p = parts.of(0)
        at, k = counted(p.h * p.w)
        row, y, x = row[at], p.y[at] + k // p.w[at], p.x[at] + k % p.w[at]
        return pa.table({**_named(rows, keys, row), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "label": rows["det"].take(pa.array(row))})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y int, x int", f"label {kinds['det']}"])
    return _paint(_shapes(shapes, *keys), keys, 1, emit, schema)


def label_boxes(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, label, left, top, right, bottom (inclusive), area of what is seen of each shape."""
    kinds = _types(shapes, *keys, "det")

    def emit(rows, parts):
        row, p = parts.of(0)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        of = lambda f, c: f.reduceat(c, first) if len(first) else c
        own = {"left": of(np.minimum, p.x), "top": of(np.minimum, p.y), "right": of(np.maximum, p.x + p.w - 1), "bottom": of(np.maximum, p.y + p.h - 1)}
        area = of(np.add, p.h * p.w)
        return pa.table({**_named(rows, keys, row[first]), "label": rows["det"].take(pa.array(row[first])), **{k: pa.array(c, pa.int32()) for k, c in own.items()}, "area": pa.array(area, pa.int64())})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"label {kinds['det']}", "left int, top int, right int, bottom int, area long"])
    pieces = _paint(_shapes(shapes, *keys), keys, 1, emit, schema)
    return pieces.groupBy(*keys, "label").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum("area").alias("area"))


def _runs(keys: tuple[str, ...]) -> Emit:
    """An emit of keys, label, runs (y, x, n)."""

    def emit(rows: pa.Table, parts: Parts) -> pa.Table:
        row, p = parts.of(0)
        at, k = counted(p.h)
        row, y, x, n = row[at], p.y[at] + k, p.x[at], p.w[at]
        order = np.lexsort((x, y, row))
        row, y, x, n = (c[order] for c in (row, y, x, n))
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0) | (x != np.append(-1, (x + n)[:-1])))
        n = np.add.reduceat(n, start) if len(start) else n
        first = np.flatnonzero(np.diff(row[start], prepend=-1))
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (y[start], x[start], n)], names=["y", "x", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)), pa.int32()), runs)
        return pa.table({**_named(rows, keys, row[start][first]), "label": rows["det"].take(pa.array(row[start][first])), "runs": lists})

    return emit


def label_runs(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, label, runs (y, x, n: cells from x on): what is seen of each shape, a row for each label."""
    kinds = _types(shapes, *keys, "det")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"label {kinds['det']}", "runs array<struct<y:int,x:int,n:int>>"])
    return _paint(_shapes(shapes, *keys), keys, 1, _runs(keys), schema).groupBy(*keys, "label").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def label_outlines(shapes: DataFrame, *keys: str) -> DataFrame:
    """keys, label, polygon, area, pixels: the outline of the largest 4-connected part of what is seen of each shape, as shapes.run_contours has it, followed where it was painted: a task holds the runs of an image."""
    kinds = _types(shapes, *keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, len(keys)):
            label, runs = table["label"].to_numpy(), pa.concat_arrays(table["runs"].chunks)
            image = np.zeros(len(table), np.int64)
            image[starts(table, keys)[1:]] = 1
            image = np.cumsum(image)
            order = np.lexsort((label, image))
            new = (np.diff(image[order], prepend=-1) != 0) | (np.diff(label[order], prepend=0) != 0)
            owner = np.empty(len(table), np.int64)
            owner[order] = np.cumsum(new) - 1
            y, x, n = (c.to_numpy().astype(np.int64) for c in runs.flatten().flatten())
            _, corners, points, area, pixels = outlines(owner[np.repeat(np.arange(len(table)), pc.list_value_length(runs).to_numpy())], y, x, n)
            own = {c: table[c].take(pa.array(order[new])) for c in (*keys, "label")}
            yield from pa.table({**own, "polygon": polygon_lists(corners, points), "area": pa.array(area, pa.int64()), "pixels": pa.array(pixels, pa.int64())}).to_batches()

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "label long, polygon array<struct<x:double,y:double>>, area long, pixels long"])
    drawn = _shapes(shapes.withColumn("det", F.col("det").cast("long")).filter("det is not null"), *keys)
    return _paint(drawn, keys, 1, _runs(keys), schema, whole)


def _pairs(keys: tuple[str, ...]) -> Emit:
    """An emit of keys, t, p, pixels: cells by their label in two layers."""

    def emit(rows: pa.Table, parts: Parts) -> pa.Table:
        pairs, to = np.unique((parts.own[0] + 1) * (len(rows) + 1) + parts.own[1] + 1, return_inverse=True)
        pixels = np.bincount(to, weights=parts.h * parts.w, minlength=len(pairs)).astype(np.int64)
        t, p = pairs // (len(rows) + 1) - 1, pairs % (len(rows) + 1) - 1
        ends = {k: rows["det"].take(pa.array(c, pa.int64(), mask=c < 0)) for k, c in (("t", t), ("p", p))}
        return pa.table({**_named(rows, keys, np.maximum(t, p)), **ends, "pixels": pa.array(pixels)})

    return emit


def overlaps(truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """keys, t, p, pixels: cells by their label in the mask of the true and in that of the predicted shapes; null where a mask has none. Rows of an image are in one partition."""
    kinds = _types(truth, *keys, "det")
    both = _shapes(truth, *keys).unionByName(_shapes(predicted, *keys, layer=1)).filter("det is not null")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"t {kinds['det']}, p {kinds['det']}, pixels long"])
    return _paint(both, keys, 2, _pairs(keys), schema).repartition(*keys).groupBy(*keys, "t", "p").agg(F.sum("pixels").alias("pixels"))


def overlaps_of(image: np.ndarray, layer: np.ndarray, det: np.ndarray, box: np.ndarray) -> pa.Table:
    """image, t, p, pixels: the same for the boxes (left, top, right, bottom, whole numbers) of some images in arrays, in order of image and det."""
    x0, y0 = box[:, 0].astype(np.int64), box[:, 1].astype(np.int64)
    x1, y1 = (np.maximum(a, box[:, c].astype(np.int64) - 1) for a, c in ((x0, 2), (y0, 3)))
    wide = (x1 >> BITS) - (x0 >> BITS) + 1
    row, k = counted(((y1 >> BITS) - (y0 >> BITS) + 1) * wide)
    ty, tx = (y0 >> BITS)[row] + k // wide[row], (x0 >> BITS)[row] + k % wide[row]
    order = np.lexsort((row, tx, ty, image[row]))
    row, ty, tx = row[order], ty[order], tx[order]
    part = {"x0": np.maximum(x0[row], tx << BITS), "y0": np.maximum(y0[row], ty << BITS), "x1": np.minimum(x1[row], (tx << BITS) + SIDE - 1), "y1": np.minimum(y1[row], (ty << BITS) + SIDE - 1), "ty": ty, "tx": tx}
    rows = pa.table({"image": pa.array(image[row]), "layer": pa.array(layer[row]), "det": pa.array(det[row]), **{c: pa.array(x, pa.int32()) for c, x in part.items()}})
    met = pa.Table.from_batches(_painter(("image", "ty", "tx"), 2, _pairs(("image",)))(rows.to_batches()), pa.schema([(c, pa.int64()) for c in ("image", "t", "p", "pixels")]))
    return met.group_by(["image", "t", "p"], use_threads=False).aggregate([("pixels", "sum")]).rename_columns(["image", "t", "p", "pixels"])
