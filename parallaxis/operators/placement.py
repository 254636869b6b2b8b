"""Placing, picking and comparing zones: capture angles, plane coordinates, screen coverage, view similarity, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.functions import vec as v

#: Angle and normalised shift that make views different by one, pick radii in pixels, and pose changes up to which fallbacks count.
DIFFERENT_DEGREES, DIFFERENT_SHIFT, ZONE_PICK, POINT_PICK, FALLBACK_MOVE, FALLBACK_TURN = 15.0, 0.1, 96.0, 72.0, 0.05, 5.0
#: Plane angle and share of changed area up to which a merge changes nothing that matters; projections that a merged zone keeps.
SAME_ANGLE, SAME_AREA, PROJECTIONS = 25.0, 0.5, 10


def capture_angle(normal: v.Vec, centre: v.Vec, camera: v.Vec) -> dict[str, Column]:
    """angle (degrees) and dot of a plane's normal with the direction to the camera, and that direction inside the plane, along its axes (null straight above)."""
    n, to = v.normalise(normal), v.normalise(v.sub(camera, centre))
    dot = v.clamp(v.dot(n, to), -1, 1)
    flat = v.sub(to, v.scale(n, dot))
    across = v.normalise(v.cross((F.lit(0.0), F.lit(1.0), F.lit(0.0)), n))
    along = v.normalise(v.cross(n, across))
    size = v.length(flat)
    inside = lambda axis: F.when(size > 1e-12, v.dot(flat, axis) / F.greatest(size, F.lit(1e-12)))
    return {"angle": F.degrees(F.acos(dot)), "dot": dot, "planar_x": inside(across), "planar_y": inside(along)}


def plane_axes(normal: v.Vec) -> tuple[v.Vec, v.Vec]:
    """Two unit vectors in a plane, at right angles."""
    n = v.normalise(normal)
    steep = F.abs(n[1]) >= 0.99
    helper = F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0)
    x = v.normalise(v.cross(n, helper))
    return x, v.normalise(v.cross(n, x))


def to_plane(p: v.Vec, centre: v.Vec, axes: tuple[v.Vec, v.Vec]) -> tuple[Column, Column]:
    d = v.sub(p, centre)
    return v.dot(d, axes[0]), v.dot(d, axes[1])


def from_plane(x: Column, y: Column, centre: v.Vec, axes: tuple[v.Vec, v.Vec]) -> v.Vec:
    return v.add(centre, v.add(v.scale(axes[0], x), v.scale(axes[1], y)))


def turned_coordinates(x: Column, y: Column, width: Column, height: Column, variant: str) -> tuple[Column, Column]:
    """Whole detector coordinates of an image held as portrait, landscape or landscape_reversed, clamped, with truncating division; (0, 0) for empty images."""
    x, y = F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))
    size_x, size_y = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    if variant == "portrait":
        out = F.floor(y * width / size_y), F.floor((width - 1 - x) * height / size_x)
    elif variant == "landscape_reversed":
        out = width - 1 - x, height - 1 - y
    elif variant == "landscape":
        out = x, y
    else:
        raise ValueError(variant)
    some = (width > 0) & (height > 0)
    return tuple(F.when(some, c).otherwise(0).cast("long") for c in out)


def to_view(p: Column, width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """Vertices in the coordinates of a view; none if any size is not positive."""
    some = (width > 0) & (height > 0) & (view_width > 0) & (view_height > 0)
    return F.when(some, F.transform(p, lambda q: poly.point(q["x"] / width * view_width, q["y"] / height * view_height))).otherwise(F.slice(F.transform(p, lambda q: poly.point(q["x"] * 1.0, q["y"] * 1.0)), 1, 0))


def upscaled(width: Column, height: Column, least_width: int = 128, least_height: int = 128) -> tuple[Column, Column]:
    """Size of an image enlarged, in proportion, to a least width and height; larger ones stay."""
    k = F.greatest(F.lit(1.0), least_height / height, least_width / width)
    return F.ceil(F.round(width * k, 9)), F.ceil(F.round(height * k, 9))


def grid_step(size: Column, out: Column) -> Column:
    """Input pixels for each cell of a dense output, one at least."""
    return F.greatest(F.lit(1), F.when(out > 0, F.floor(size / out)).otherwise(1)).cast("long")


def merge_is_insignificant(angle: Column, difference: Column) -> Column:
    """Whether a merge changed a zone little: its plane's angle, and the share of area that only one of its outlines covers."""
    return (angle < SAME_ANGLE) & (difference <= SAME_AREA)


def screen_coverage(polygon: Column, width: float, height: float) -> dict[str, Column]:
    """projected_area, visible_area (inside the screen), fully_inside and coverage (of the screen) of a convex projected polygon; zeros for fewer than three vertices or null."""
    screen = F.array(*(poly.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (width, 0), (width, height), (0, height))))
    fine = F.coalesce(F.size(polygon) >= 3, F.lit(False))
    projected = F.when(fine, poly.area(polygon)).otherwise(0.0)
    visible = F.when(fine, poly.shared_area(polygon, screen)).otherwise(0.0)
    inside = fine & F.forall(polygon, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    return {"projected_area": projected, "visible_area": visible, "fully_inside": inside, "coverage": visible / float(width * height)}


def picked(taps: DataFrame, shapes: DataFrame, *keys: str, radius: float = ZONE_PICK) -> DataFrame:
    """keys, tap_id, shape_id, how: the smallest shape that holds a tap, else the nearest centre within the radius; taps that pick nothing have no row.

    taps: keys, tap_id, x, y; shapes: keys, shape_id, polygon, cx, cy. Taps and
    shapes meet in cells of the radius' size that the shape's extent, widened
    by the radius around its centre, touches; only shapes whose keys have taps
    are cut into cells.
    """
    b = poly.bounds(F.col("polygon"))
    low = {"x": F.least(b["left"], F.col("cx") - radius), "y": F.least(b["top"], F.col("cy") - radius)}
    high = {"x": F.greatest(b["right"], F.col("cx") + radius), "y": F.greatest(b["bottom"], F.col("cy") + radius)}
    cells = shapes.join(taps.select(*keys).distinct(), list(keys), "left_semi")
    for c in "xy":
        cells = cells.withColumn("g" + c, F.explode(F.sequence(F.floor(low[c] / radius), F.floor(high[c] / radius))))
    met = taps.withColumns({"g" + c: F.floor(F.col(c) / radius) for c in "xy"}).join(cells, [*keys, "gx", "gy"])
    inside = poly.contains(F.col("polygon"), F.col("x"), F.col("y"))
    far = F.round(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2), 9)
    met = met.withColumn("how", F.when(inside, "inside").when(far <= radius * radius, "near")).filter("how is not null")
    order = F.struct(F.col("how") != "inside", F.when(F.col("how") == "inside", poly.area(F.col("polygon"))).otherwise(far), "shape_id")
    return met.groupBy(*keys, "tap_id").agg(F.min_by(F.struct("shape_id", "how"), order).alias("p")).select(*keys, "tap_id", "p.shape_id", "p.how")


def similar_views(views: DataFrame, *keys: str) -> DataFrame:
    """keys, first, second, delta of views that are alike: angle between their directions, and shift in the plane over their mean distance, add up to one at most.

    views: keys, view_id, d* (direction from the zone to the camera), px, py
    (the camera in the plane), distance. Views of other zones are not compared.
    """
    own = ("view_id", "dx", "dy", "dz", "px", "py", "distance")
    a, b = (views.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in own)) for side in "ab")
    met = a.join(b, list(keys)).filter("a_view_id < b_view_id")
    shift = F.sqrt(F.pow(F.col("a_px") - F.col("b_px"), 2) + F.pow(F.col("a_py") - F.col("b_py"), 2))
    mean = F.greatest((F.col("a_distance") + F.col("b_distance")) / 2, F.lit(1e-3))
    delta = F.round(v.angle_degrees(v.vec("a_d"), v.vec("b_d")) / DIFFERENT_DEGREES + shift / mean / DIFFERENT_SHIFT, 6)
    return met.withColumn("delta", delta).filter("delta <= 1").select(*keys, F.col("a_view_id").alias("first"), F.col("b_view_id").alias("second"), "delta")


def placed_points(samples: DataFrame) -> DataFrame:
    """samples with place and method: by depth, else, if the camera hardly moved since, by a hit on a plane, else by a feature; null where nothing serves.

    samples: depth, hit, feature (structs x, y, z or null), moved, turned.
    """
    allowed = (F.col("moved") <= FALLBACK_MOVE) & (F.col("turned") <= FALLBACK_TURN)
    place = F.coalesce("depth", F.when(allowed, F.col("hit")), F.when(allowed, F.col("feature")))
    method = F.when(F.col("depth").isNotNull(), "depth").when(allowed & F.col("hit").isNotNull(), "hit").when(allowed & F.col("feature").isNotNull(), "feature")
    return samples.withColumn("place", place).withColumn("method", method)


def best_projections(inputs: DataFrame, *keys: str, most: int = PROJECTIONS) -> DataFrame:
    """The surest projections of each zone (confidence; ties by input_id), in order, as an array."""
    first = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "input_id")))
    return inputs.groupBy(*keys).agg(F.transform(F.slice(first, 1, most), lambda x: x["input_id"]).alias("inputs"))


def meeting_hull(inputs: DataFrame, polygon: str = "polygon", hull: str = "hull") -> DataFrame:
    """Projections whose convex outline shares area with the merged zone's."""
    return inputs.filter(poly.shared_area(F.col(polygon), F.col(hull)) > 0)


def first_records(records: DataFrame, *keys: str) -> DataFrame:
    """The first record of each zone by arrival (seq); it defines the zone."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter("place = 1").drop("place")


def view_inventory(zones: DataFrame, removed: DataFrame) -> DataFrame:
    """zone_id, view: a row for each stored view of zones (zone_id, views) that were not removed."""
    return zones.join(removed.select("zone_id").distinct(), "zone_id", "left_anti").select("zone_id", F.explode("views").alias("view"))


def tracked(frames: DataFrame, settings: DataFrame, flag: str) -> DataFrame:
    """Frames of sessions whose tracking works and whose settings (session_id, flags) turn the mode on."""
    return frames.filter("tracking = 'TRACKING'").join(settings.filter(F.col(flag)).select("session_id"), "session_id", "left_semi")


def apply_texts(zones: DataFrame, texts: DataFrame) -> DataFrame:
    """Zones with the text that a map of keys to values (zone_id, value) gives them, else their own; and whether it changed."""
    out = zones.join(texts.groupBy("zone_id").agg(F.max("value").alias("value")), "zone_id", "left")
    return out.withColumn("changed", F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("text"))).withColumn("text", F.coalesce("value", "text")).drop("value")


def latency(jobs: DataFrame, *keys: str) -> DataFrame:
    """Mean and median of ms."""
    return jobs.groupBy(*keys).agg(F.count("*").alias("jobs"), F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"))


def metrics_text(quiet: Column) -> Column:
    """One text of a zone's view: angle, dot, planar direction, coverage, whether it is fully inside, merges and points."""
    fully = F.when(F.col("fully_inside"), "Y").otherwise("N")
    state = F.when(quiet >= 3, "placed").otherwise(F.format_string("%d quiet merges", quiet))
    return F.concat(F.format_string("zone %d: angle %.1f, dot %.2f, direction (%.2f, %.2f), coverage %.1f%%, inside ", "zone_id", "angle", "dot", "planar_x", "planar_y", F.col("coverage") * 100.0), fully, F.lit(", "), state, F.format_string(", %d points", "points"))
