"""Annotation data engineering: scans, filters, merges, splits, ids and label lines."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.functions import poly
from parallaxis.functions import vec as v
from parallaxis.operators import shapes
from parallaxis.operators.order import numbered

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def stem(name: Column) -> Column:
    """A file name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")


def name_variants(name: Column) -> Column:
    """The name, its base name and its stem, lower case, each once."""
    base = F.regexp_extract(F.lower(F.trim(name)), r"([^/]*)$", 1)
    return F.array_distinct(F.array(F.lower(F.trim(name)), base, F.regexp_replace(base, r"\.[^.]*$", "")))


def dataset_name(subset: Column, path: Column) -> Column:
    """subset__folder__stem.ext, with spaces as underscores."""
    return F.translate(F.concat_ws("__", subset, F.replace(path, F.lit("/"), F.lit("__"))), " ", "_")


def usable(annotations: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Annotations of allowed categories that are no crowd and whose ring has three points or more."""
    kept = annotations.filter((F.col("iscrowd") == 0) & (F.size("ring") >= 6))
    return kept if labels is None else kept.filter(F.col("category").isin(labels))


def images_with_polygons(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with its number of polygons and their rings in order of annotation."""
    polygons = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann", "ring"))).alias("p"))
    out = images.join(polygons, images["id"] == polygons["image_id"], "left")
    return out.select("id", "width", "height", "file_name", F.coalesce(F.size("p"), F.lit(0)).alias("polygons"), F.transform("p", lambda x: x["ring"]).alias("rings"))


def keep_named(images: DataFrame, names: DataFrame) -> DataFrame:
    """Images whose name, in any variant, is one of names (column name): two equi-joins by variant."""
    wanted = names.select(F.explode(name_variants(F.col("name"))).alias("key")).distinct()
    keyed = images.withColumn("key", F.explode(name_variants(F.col("file_name"))))
    return images.join(keyed.join(wanted, "key", "left_semi").select("id").distinct(), "id", "left_semi")


def replace_annotations(base_images: DataFrame, base: DataFrame, new_images: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations of base, with those of images that new_images names (by name, else by stem; the first base image of a key) replaced by new ones.

    New annotations get ids after the largest of base, in order of image and
    annotation. Optional columns of either side are null in the other's rows.
    """

    def first(key: Column) -> DataFrame:
        return base_images.select(F.lower("file_name").alias("name"), F.lower(stem(F.col("file_name"))).alias("stem"), "id").groupBy(key.alias("key")).agg(F.min("id").alias("to"))

    asked = new_images.select(F.col("id").alias("from"), F.lower("file_name").alias("name"), F.lower(stem(F.col("file_name"))).alias("stem"))
    by_name = asked.join(first(F.col("name")).withColumnRenamed("key", "name").withColumnRenamed("to", "named"), "name", "left")
    matched = by_name.join(first(F.col("stem")).withColumnRenamed("key", "stem").withColumnRenamed("to", "stemmed"), "stem", "left")
    matched = matched.select("from", F.coalesce("named", "stemmed").alias("to")).filter("to is not null")
    kept = base.join(matched.select(F.col("to").alias("image_id")).distinct(), "image_id", "left_anti")
    last = base.agg(F.coalesce(F.max("ann"), F.lit(0)).alias("last"))
    added = new.join(matched, new["image_id"] == matched["from"]).drop("image_id", "from").withColumnRenamed("to", "image_id")
    fresh = numbered(added, "image_id", "ann").crossJoin(F.broadcast(last))
    fresh = fresh.withColumn("ann", F.col("last") + F.col("place")).drop("last", "place")
    return kept.unionByName(fresh, allowMissingColumns=True)


def missing_stems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Stems of expected names that no actual name has."""
    return expected.select(stem(F.col("name")).alias("stem")).distinct().join(actual.select(stem(F.col("name")).alias("stem")), "stem", "left_anti")


def assembled(items: DataFrame, listing: DataFrame) -> DataFrame:
    """Items (subset, path) whose file is listed, with target name; of a target that several subsets make, the first subset's."""
    found = items.join(listing.select("path").distinct(), "path", "left_semi").withColumn("target", dataset_name(F.col("subset"), F.col("path")))
    first = F.row_number().over(Window.partitionBy("target").orderBy("subset", "path"))
    return found.withColumn("place", first).select("subset", "path", "target", (F.col("place") == 1).alias("kept"))


def split(items: DataFrame, key: str, val: int, test: int, seed: int = 42) -> DataFrame:
    """Items with split: val and test rows of a seeded order by hash, the rest train; with too few rows, test then val shrink so that one trains."""
    n = items.count()
    test = min(test, max(0, n - 1))
    val = min(val, max(0, n - 1 - test))
    place = F.col("place")
    keyed = items.select(key).distinct().withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    return numbered(keyed, "draw", key).select(key, F.when(place <= test, "test").when(place <= test + val, "val").otherwise("train").alias("split"))


def label_line(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """`0 cx cy w h`, normalised, eight decimals; right and bottom are inclusive."""
    w, h = right - left + 1.0, bottom - top + 1.0
    return F.format_string("0 %.8f %.8f %.8f %.8f", (left + w / 2.0) / width, (top + h / 2.0) / height, w / width, h / height)


def ring_line(polygon: Column, width: Column, height: Column) -> Column:
    """`0 x1 y1 x2 y2 ...`, normalised, eight decimals."""
    return F.concat(F.lit("0 "), F.array_join(F.transform(polygon, lambda p: F.format_string("%.8f %.8f", p["x"] / width, p["y"] / height)), " "))


def mask_boxes(cells: DataFrame, *keys: str) -> DataFrame:
    """Box (inclusive) and area of each label of a mask given as cells y, x, label."""
    return cells.groupBy(*keys, "label").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count("*").alias("area"))


def export_ok(least_area: int = 8) -> Column:
    return (F.col("area") >= least_area) & (F.size("ring") >= 6)


def assembly_counts(items: DataFrame, listing: DataFrame, least: tuple[int, int]) -> DataFrame:
    """One row: items whose file is missing, files copied and masks generated (one for each target), of which enlarged to the least width and height, and targets that were taken already."""
    made = assembled(items.select("subset", "path"), listing)
    sizes = items.groupBy("subset", "path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    n = made.join(sizes, ["subset", "path"]).agg(F.count("*").alias("found"), F.count_if("kept").alias("copied"), F.count_if(F.col("kept") & ((F.col("width") < least[0]) | (F.col("height") < least[1]))).alias("resized"))
    return items.agg(F.count("*").alias("items")).crossJoin(n).select((F.col("items") - F.col("found")).alias("missing"), "copied", F.col("copied").alias("generated"), "resized", (F.col("found") - F.col("copied")).alias("collisions"))


def split_layout(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a split with their file names in it: the split and a number of five digits, from 0 in the order of the key."""
    places = numbered(rows.select("split", key), "split", key)
    first = places.groupBy("split").agg(F.min("place").alias("first"))
    number = (F.col("place") - F.col("first")).cast("string")
    return places.join(F.broadcast(first), "split").select(key, "split", F.concat_ws("_", "split", F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("name"))


def class_manifest(names: list[str]) -> str:
    """The manifest of a dataset of these splits' folders and classes, as YAML."""
    return "\n".join(["train: train", "val: val", "test: test", f"nc: {len(names)}", "names: [" + ", ".join(names) + "]", ""])


def _numbered_by_folder(rows: DataFrame, *order: str, ranges: tuple[str, int] | None = None) -> DataFrame:
    """rows with ann: their numbers in their folder, from 1, in this order."""
    places = numbered(rows, "folder", *order, ranges=ranges)
    first = places.groupBy("folder").agg(F.min("place").alias("first"))
    return places.join(F.broadcast(first), "folder").withColumn("ann", F.col("place") - F.col("first") + 1).drop("place", "first")


def exported(images: DataFrame, detections: DataFrame, most_points: int = 200, least_area: int = 8) -> DataFrame:
    """folder, image_id, ann, ring, area, left, top, width, height, score: the annotations of predicted polygons, numbered from 1 in each folder, whose document they go to.

    images: folder, image_id, width, height; detections: image_id, det, score,
    polygon, and pixels where the instance's pixels are known; else the area
    inside the ring stands for them. Polygons are decimated, clamped to the
    image and flattened; small areas and short rings are left out.
    """
    size = [F.col("image_width"), F.col("image_height")]
    own = images.select("folder", "image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    rows = v.settled(detections.join(own, "image_id"), {"thin": poly.decimate(F.col("polygon"), most_points)})
    rows = v.settled(rows, {"ring": poly.flat_ring(F.col("thin"), *size)})
    rows = v.settled(rows, {"corners": poly.ring_points(F.col("ring"))})
    rows = rows.withColumn("area", F.col("pixels").cast("double") if "pixels" in detections.columns else poly.area(F.col("corners")))
    box = poly.bounding_box(F.col("corners"))
    rows = rows.filter(export_ok(least_area)).select("folder", "image_id", "det", "ring", "area", *(box[c].alias(c) for c in ("left", "top", "width", "height")), "score")
    return _numbered_by_folder(rows, "image_id", "det").drop("det")


def exported_masks(images: DataFrame, cells: DataFrame, tolerance: float = 0.01, most_points: int = 200, least_area: int = 8) -> DataFrame:
    """The annotations of predicted label masks, as exported has them: outline of each label's largest part, simplified, and the pixels of all its parts as area.

    images: folder, image_id, width, height; cells: image_id, y, x, label of
    predicted masks (zero is no label), or a row for each label with the runs
    of its cells, as masks.label_runs has them, or their outlines (masks.label_outlines).
    Score is null. What comes back goes to records.write_annotations, a document for
    each folder. Labels are numbered in ranges of images, so that outlines are followed
    once, and the rings of a batch are made at once.
    """
    outlines = cells.filter("label > 0")
    if "polygon" not in cells.columns:
        outlines = (shapes.run_contours if "runs" in cells.columns else shapes.largest_contours)(outlines, "image_id")
    places, ranges = numbered(images.select("folder", "image_id", "width", "height"), "folder", "image_id"), int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.floor((F.col("place") - 1) * ranges / places.count()).cast("int")
    size = [F.col(c).cast("double").alias("image_" + c) for c in ("width", "height")]
    rows = outlines.filter(F.col("pixels") >= least_area).join(places.select("folder", "image_id", *size, share.alias("_range")), "image_id")
    rows = rows.select("folder", "image_id", F.col("label").alias("det"), F.col("pixels").cast("double").alias("area"), "_range", "polygon", "image_width", "image_height")
    names = ("left", "top", "width", "height")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, points = shapes.simplified(*shapes.polygon_arrays(batch.column(5)), tolerance)
            row, k = shapes.counted(n)
            kept = (n[row] >= 3) & (k % np.maximum(-(-n // most_points), 1)[row] == 0)
            row, points = row[kept], points[kept]
            most = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (6, 7)], 1) - 1
            points = np.fmax(np.fmin(points, most[row]), 0)
            part = np.flatnonzero(points.ravel() % 1)
            points.ravel()[part] = [float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for x in points.ravel()[part].tolist()]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            long = np.flatnonzero(np.diff(first, append=len(row)) >= 3)
            if len(long):
                low, high = (f.reduceat(points, first)[long] for f in (np.minimum, np.maximum))
                rings = pa.ListArray.from_arrays(pa.array(np.append(2 * first, 2 * len(row)), pa.int32()), pa.array(points.ravel())).take(pa.array(long))
                own = [batch.column(c).take(pa.array(row[first][long])) for c in range(5)]
                box = [pa.array(np.ascontiguousarray(c)) for c in (*low.T, *(high - low).T)]
                yield pa.RecordBatch.from_arrays([*own, rings, *box], names=["folder", "image_id", "det", "area", "_range", "ring", *names])

    schema = T.StructType([*rows.schema.fields[:5], T.StructField("ring", T.ArrayType(T.DoubleType())), *(T.StructField(c, T.DoubleType()) for c in names)])
    found = rows.mapInArrow(run, schema).select("folder", "image_id", "det", "ring", "area", *names, F.lit(None).cast("double").alias("score"), "_range")
    return _numbered_by_folder(found, "image_id", "det", ranges=("_range", ranges)).drop("det")
