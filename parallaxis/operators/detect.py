"""Detection post-processing: tensor rows, thresholds, suppression, masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.functions import poly
from parallaxis.operators import masks

MOST = 10_000


def top_candidates(boxes: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """The best `most` of each image by score, ties by det, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "det"))
    return boxes.withColumn("rank", rank).filter(F.col("rank") <= most)


def overlapping(ranked: DataFrame, *keys: str, above: float = 0.5, cell: float = 128.0) -> DataFrame:
    """keys, winner, loser (ranks): boxes of an image whose overlap over union is above the threshold. Cells bound what is compared."""
    size = [F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)) for a, b in (("left", "right"), ("top", "bottom"))]
    cells = ranked.withColumn("cx", F.explode(size[0])).withColumn("cy", F.explode(size[1]))
    names = ("left", "top", "right", "bottom", "rank")
    a = cells.select(*keys, "cx", "cy", *(F.col(c).alias("a_" + c) for c in names))
    b = cells.select(*keys, "cx", "cy", *(F.col(c).alias("b_" + c) for c in names))
    met = a.join(b, [*keys, "cx", "cy"]).filter("a_rank < b_rank").filter(poly.box_iou(poly.box_columns("a_"), poly.box_columns("b_")) > above)
    return met.select(*keys, F.col("a_rank").alias("winner"), F.col("b_rank").alias("loser")).distinct()


def _clipped_area(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> float:
    """Area of a polygon inside a convex one whose vertices run counter-clockwise."""
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        now = []
        for k, (p, s) in enumerate(zip(out, side)):
            q, r = out[k - 1], side[k - 1]
            if (s >= 0) != (r >= 0):
                t = r / (r - s)
                now.append((q[0] + (p[0] - q[0]) * t, q[1] + (p[1] - q[1]) * t))
            if s >= 0:
                now.append(p)
        out = now
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1]))) / 2


#: Pairs of boxes of an image that are compared at once.
PAIRS = 1 << 20


def _clashes(table: pa.Table, least: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, later places, shared areas, united areas) of each box, in order of place, that shares more than `least` of what they unite with later boxes of its image."""
    left, top, right, bottom = (table[c].to_numpy().astype(float) for c in ("left", "top", "right", "bottom"))
    area, n = (right - left) * (bottom - top), len(left)
    step, out = max(1, PAIRS // max(n, 1)), []
    for first in range(0, n, step):
        own, later = slice(first, first + step), slice(first, None)
        w = np.maximum(np.minimum(right[own, None], right[later]) - np.maximum(left[own, None], left[later]), 0)
        shared = w * np.maximum(np.minimum(bottom[own, None], bottom[later]) - np.maximum(top[own, None], top[later]), 0)
        i, j = np.nonzero(shared > 0)
        i, j, shared = i[i < j], j[i < j], shared[i[i < j], j[i < j]]
        union = area[i + first] + area[j + first] - shared
        more = shared > least * union
        i, j, shared, union = (x[more] for x in (i + first, j + first, shared, union))
        at = np.flatnonzero(np.diff(i, prepend=-1))
        out += [(int(i[a]), j[a:b], shared[a:b], union[a:b]) for a, b in zip(at, np.append(at[1:], len(i)))]
    return out


def _kept_polygons(polygons: list[list[tuple[float, float]]], above: float) -> list[int]:
    """Places of the polygons that stay."""
    kept: list[int] = []
    box = np.array([[f(p[k] for p in x) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))] if x else [0.0] * 4 for x in polygons], float).reshape(-1, 4)
    sizes = np.array([_clipped_area(x, x) if len(x) > 2 else 0.0 for x in polygons])
    for k in range(len(box)):
        a = box[kept]
        w, h = (np.maximum(np.minimum(a[:, n + 2], box[k, n + 2]) - np.maximum(a[:, n], box[k, n]), 0) for n in (0, 1))
        if not any(min(sizes[k], sizes[kept[m]]) > 0 and _clipped_area(polygons[k], polygons[kept[m]]) > above * min(sizes[k], sizes[kept[m]]) for m in np.flatnonzero(w * h > 0)):
            kept.append(k)
    return kept


def suppress(boxes: DataFrame, *keys: str, above: float = 0.5, most: int = MOST, shape: str = "box") -> DataFrame:
    """Greedy non-maximum suppression of each image's boxes, or polygons.

    From the best on, one stays unless it overlaps one that stays by more than
    the threshold: boxes (left, top, right, bottom) by intersection over union,
    polygons (column polygon, convex, counter-clockwise) by intersection over
    the smaller area. An image's `most` best are looked at, in one task, which
    gets and gives back whole rows: boxes are compared by arrays, polygons with
    those that stay only.
    """
    ranked = top_candidates(boxes, *keys, most=most)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        if shape == "polygon":
            return table.take(pa.array(_kept_polygons([[(p["x"], p["y"]) for p in x] for x in table["polygon"].to_pylist()], above), pa.int64()))
        stays = np.ones(len(table), bool)
        for k, later, _, _ in _clashes(table, above):
            if stays[k]:
                stays[later] = False
        return table.filter(pa.array(stays))

    return ranked.groupBy(*keys).applyInArrow(run, ranked.schema)


def suppress_at_all(boxes: DataFrame, thresholds: list[float], *keys: str, most: int = MOST) -> DataFrame:
    """keys, rank, det, score, stays of each box that stays at one of the thresholds at least: stays tells for each of them whether suppress would keep it.

    One pass over an image's boxes from the best on: its overlaps with all
    later ones are computed once for all thresholds. Scores below a threshold
    never suppress those above, so what stays among higher scores alone is
    the same with a filter.
    """
    ranked = top_candidates(boxes, *keys, most=most)
    ranked = ranked.select(*keys, "rank", *(c for c in boxes.columns if c not in keys))
    limits = np.array(thresholds)[:, None]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        alive = np.ones((len(limits), len(table)), bool)
        for k, later, shared, union in _clashes(table, float(limits.min())):
            alive[:, later] &= ~((shared > limits * union) & alive[:, k : k + 1])
        kept = np.flatnonzero(alive.any(0))
        return table.take(pa.array(kept)).append_column("stays", pa.array(alive[:, kept].T.tolist(), pa.list_(pa.bool_())))

    schema = T.StructType([*ranked.schema, T.StructField("stays", T.ArrayType(T.BooleanType()))])
    return ranked.groupBy(*keys).applyInArrow(run, schema)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def denormalised(x: Column, size: Column | int) -> Column:
    """Coordinates up to 1.5 in size are shares of it."""
    return F.when(F.abs(x) <= 1.5, x * size).otherwise(x)


def decode_rows(rows: DataFrame, classes: int = 1, objectness: bool = False, threshold: float = 0.25, width: int = 640, height: int = 640) -> DataFrame:
    """image_id, det, score, left, top, right, bottom, coefficients of tensor rows (values: centre, size, [objectness], classes, coefficients) at or above the threshold."""
    first = 6 if objectness else 5
    value = lambda i: F.element_at("values", i).cast("double")
    score = F.array_max(F.slice("values", first, classes)).cast("double") * (value(5) if objectness else 1.0)
    cx, cy, w, h = denormalised(value(1), width), denormalised(value(2), height), denormalised(F.abs(value(3)), width), denormalised(F.abs(value(4)), height)
    clip = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(float(most))))
    out = rows.select("image_id", "det", score.alias("score"), clip(cx - w / 2, width).alias("left"), clip(cy - h / 2, height).alias("top"), clip(cx + w / 2, width).alias("right"), clip(cy + h / 2, height).alias("bottom"), F.slice("values", first + classes, 1000).alias("coefficients"))
    return out.filter(F.col("score") >= threshold)


def row_layout(attributes: int, coefficients: int, classes: int = 1) -> tuple[bool, int]:
    """Whether rows of so many values have an objectness, and their number of classes: the expected ones, with or without it, else what is left of box and coefficients."""
    rest = attributes - 4
    if rest <= coefficients:
        raise ValueError(f"rows of {attributes} values hold no class beside {coefficients} coefficients")
    if rest == 1 + classes + coefficients:
        return True, classes
    return False, classes if rest == classes + coefficients else rest - coefficients


def rescaled(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes of a model's input in the pixels of their images (image_width, image_height), clipped."""
    kx, ky = F.col("image_width") / float(width), F.col("image_height") / float(height)
    scale = {"left": kx, "right": kx, "top": ky, "bottom": ky}
    most = {"left": "image_width", "right": "image_width", "top": "image_height", "bottom": "image_height"}
    return boxes.withColumns({c: F.greatest(F.lit(0.0), F.least(F.col(c) * k, F.col(most[c]).cast("double"))) for c, k in scale.items()})


def output_layout(shape: tuple[int, ...], fallback: str = "NCHW") -> str:
    """NCHW or NHWC of a tensor of four dimensions: channels are fewer than either side; where both ends could be, the fallback."""
    if len(shape) != 4:
        raise ValueError(f"{shape} has not four dimensions")
    first, last = shape[1] < min(shape[2:]), shape[3] < min(shape[1:3])
    return fallback if first == last else "NCHW" if first else "NHWC"


def detection_rows(tensors: DataFrame) -> DataFrame:
    """image_id, det, values: rows of flat detection tensors (image_id, d1, d2, values), of which the larger dimension counts detections; those stored by attribute are turned."""
    t = tensors.select("image_id", F.least("d1", "d2").alias("attributes"), F.greatest("d1", "d2").alias("n"), (F.col("d1") >= F.col("d2")).alias("by_row"), "values")
    at = lambda k, i: F.when(F.col("by_row"), k * F.col("attributes") + i).otherwise(i * F.col("n") + k)
    row = lambda k: F.struct(k.cast("long").alias("det"), F.transform(F.sequence(F.lit(0), F.col("attributes") - 1), lambda i: F.get("values", at(k, i).cast("int"))).alias("values"))
    rows = t.select("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), row)).alias("r"))
    return rows.select("image_id", "r.det", "r.values")


def tensor_cells(tensors: DataFrame, layout: str = "NCHW") -> DataFrame:
    """image_id, c, y, x, value of flat tensors with channels, height and width."""
    t = tensors.select("image_id", "channels", "height", "width", F.posexplode("values").alias("p", "value"))
    if layout == "NCHW":
        plane = F.col("height") * F.col("width")
        c, y, x = F.floor(F.col("p") / plane), F.floor(F.col("p") % plane / F.col("width")), F.col("p") % F.col("width")
    else:
        row = F.col("width") * F.col("channels")
        c, y, x = F.col("p") % F.col("channels"), F.floor(F.col("p") / row), F.floor(F.col("p") % row / F.col("channels"))
    return t.select("image_id", c.cast("int").alias("c"), y.cast("int").alias("y"), x.cast("int").alias("x"), "value")


def mix_masks(detections: DataFrame, prototypes: DataFrame, least: float = 0.5) -> DataFrame:
    """image_id, det, y, x of the foreground: prototype cells (image_id, y, x, proto) inside a detection's box (in cells) whose mixed value is at or above `least` after the sigmoid."""
    met = detections.join(prototypes, "image_id").filter("x >= left and x <= right and y >= top and y <= bottom")
    value = F.aggregate(F.zip_with("coefficients", "proto", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return met.filter(sigmoid(value) >= least).select("image_id", "det", "y", "x")


def dense_candidates(scores: DataFrame, least: float, border: int = 2) -> DataFrame:
    """Cells (image_id, height, width, y, x, score) at or above `least` and outside the border."""
    inside = F.col("x").between(border, F.col("width") - border - 1) & F.col("y").between(border, F.col("height") - border - 1)
    return scores.filter((F.col("score") >= least) & inside)


def rasterise(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, label: cells inside boxes; where they overlap the larger det wins."""
    return masks.cells(boxes.drop("polygon"), *keys)


def rasterise_polygons(polygons: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x, label: cells whose whole coordinates lie in a polygon or on its border; where polygons overlap the larger det wins."""
    return masks.cells(polygons, *keys)


def instances(cells: DataFrame, *keys: str) -> DataFrame:
    """Different labels of each mask; zero and null are none."""
    return cells.groupBy(*keys).agg(F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("instances"))


def label_overlaps(truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """keys, t, p, pixels: cells that a label of each of two masks share."""
    met = truth.select(*keys, "y", "x", F.col("label").alias("t")).join(predicted.select(*keys, "y", "x", F.col("label").alias("p")), [*keys, "y", "x"])
    return met.groupBy(*keys, "t", "p").agg(F.count("*").alias("pixels"))


def star_outputs(tensors: DataFrame) -> DataFrame:
    """image_id, height, width, y, x, score, distances of dense outputs (image_id, channels, height, width, values in NCHW).

    An image has a tensor of one channel, the probability, and one of several,
    the ray distances; or one tensor with the probability first.
    """
    own = tensors.groupBy("image_id").agg(F.min("channels").alias("least"), F.max("channels").alias("most"), F.first("height").alias("height"), F.first("width").alias("width"))
    t = tensors.select("image_id", "channels", F.posexplode("values").alias("p", "value"), (F.col("height") * F.col("width")).alias("plane"), "width")
    cells = t.select("image_id", "channels", F.floor(F.col("p") / F.col("plane")).cast("int").alias("c"), F.floor(F.col("p") % F.col("plane") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    cells = cells.join(own, "image_id")
    alone = F.col("least") == 1
    is_score = F.when(alone, F.col("channels") == 1).otherwise(F.col("c") == 0)
    out = cells.groupBy("image_id", "height", "width", "y", "x").agg(F.max(F.when(is_score, F.col("value"))).alias("score"), F.transform(F.array_sort(F.collect_list(F.when(~is_score, F.struct("c", "value")))), lambda v: v["value"]).alias("distances"))
    return out.filter("score is not null")


def star_detections(outputs: DataFrame, least: float = 0.5, above: float = 0.4, grid: int = 1, border: int = 2) -> DataFrame:
    """image_id, det, score, left, top, right, bottom, polygon (whole) of dense outputs: cells at or above the least score and inside the border become star polygons, of which overlapping ones are suppressed."""
    cells = dense_candidates(outputs, least, border).filter(F.size("distances") >= 3)
    det = (F.col("y") * F.col("width") + F.col("x")).cast("long")
    stars = cells.select("image_id", det.alias("det"), "score", poly.star_polygon(F.col("x") * float(grid), F.col("y") * float(grid), F.col("distances")).alias("polygon"))
    kept = suppress(stars, "image_id", above=above, shape="polygon")
    b = poly.bounds(F.col("polygon"))
    return kept.select("image_id", "det", "score", *(c.alias(k) for k, c in b.items()), poly.integer_polygon(F.col("polygon")).alias("polygon"))


def row_detections(rows: DataFrame, prototypes: DataFrame, threshold: float = 0.25, above: float = 0.5, width: int = 640, height: int = 640, stride: int = 4) -> DataFrame:
    """image_id, det, score, left, top, right, bottom, pixels of tensor rows: decoded, overlapping boxes suppressed, and the foreground of each one's mixed mask counted, in prototype cells of `stride` pixels."""
    kept = suppress(decode_rows(rows, threshold=threshold, width=width, height=height), "image_id", above=above)
    cells = {c: F.col(c) / stride for c in ("left", "top", "right", "bottom")}
    masks = mix_masks(kept.withColumns(cells), prototypes).groupBy("image_id", "det").agg(F.count("*").alias("pixels"))
    return kept.drop("rank", "coefficients").join(masks, ["image_id", "det"], "left").fillna(0, ["pixels"])
