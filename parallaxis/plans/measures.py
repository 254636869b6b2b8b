"""Queries over placing, picking, views and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.functions import vec as v
from parallaxis.operators import annotations, detect, masks, placement, zones
from parallaxis.plans.fixtures import view, with_views


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Each zone from each camera: normal n*, centre c*, camera t*, direction d*."""
    z = view(spark, d, "zones").select("zone_id", "cx", "cy", "cz").withColumns({"nx": 0.1 * (F.col("zone_id") % 3), "ny": F.lit(0.2), "nz": F.lit(1.0)})
    met = z.crossJoin(F.broadcast(view(spark, d, "cams").select("frame_id", "tx", "ty", "tz")))  # 25 cameras, whatever the input
    met = met.withColumns({"tx": F.col("tx") + F.col("cx"), "ty": F.col("ty") + F.col("cy")})
    return v.settled(met, {"d" + c: x for c, x in zip("xyz", v.normalise(v.sub(v.vec("t"), v.vec("c"))))})


def capture_angles(spark: SparkSession, d: str) -> DataFrame:
    w = _views(spark, d)
    first = w.filter("frame_id = 0").select("zone_id", *(F.col("d" + c).alias("f" + c) for c in "xyz"))
    out = v.settled(w.join(first, "zone_id"), {**placement.capture_angle(v.vec("n"), v.vec("c"), v.vec("t")), "from_first": v.angle_degrees(v.vec("d"), v.vec("f"))})
    return _r(out.select("zone_id", "frame_id", "angle", "dot", "planar_x", "planar_y", "from_first"), "angle", "dot", "planar_x", "planar_y").withColumn("from_first", F.round("from_first", 4) + 0.0)


def plane_coordinates(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "bars").withColumns({"cx": F.lit(1.0), "cy": F.lit(0.5), "cz": F.lit(0.25), "nx": 0.1 * (F.col("zone_id") % 2), "ny": F.lit(0.3), "nz": F.lit(1.0)})
    axes = placement.plane_axes(v.vec("n"))
    x, y = placement.to_plane(v.vec(""), v.vec("c"), axes)
    p = v.settled(p, {"u": x, "w": y, **{k: c for k, c in zip(("ax", "ay", "az"), axes[0])}, **{k: c for k, c in zip(("bx", "by", "bz"), axes[1])}})
    back = placement.from_plane(F.col("u"), F.col("w"), v.vec("c"), (v.vec("a"), v.vec("b")))
    return _r(p.select("bar_id", "u", "w", *(c.alias("p" + n) for c, n in zip(back, "xyz"))), "u", "w", "px", "py", "pz")


def posed_points(spark: SparkSession, d: str) -> DataFrame:
    """Rays of turned cameras, where they meet a plane, and points at a depth."""
    f = view(spark, d, "frames").select("frame_id", *(F.col(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")), ((F.col("frame_id") % 21 - 10) / 20.0).alias("u"), ((F.col("frame_id") % 13 - 6) / 15.0).alias("w"))
    q = tuple(F.col("q" + c) for c in "xyzw")
    f = v.settled(f, {"e" + c: x for c, x in zip("xyz", v.pixel_ray(F.col("u"), F.col("w")))})
    f = v.settled(f, {"d" + c: x for c, x in zip("xyz", v.rotate(q, v.vec("e")))})
    plane = v.plane_hit(v.vec("t"), v.vec("d"), (F.lit(0.0), F.lit(0.0), F.lit(-2.0)), (F.lit(0.0), F.lit(0.2), F.lit(1.0)))
    deep = v.unproject(F.col("u"), F.col("w"), F.lit(1.5), v.vec("t"), q)
    f = v.settled(f, {"plane": plane, **{"p" + c: x for c, x in zip("xyz", deep)}})
    return _r(f.select("frame_id", "dx", "dy", "dz", *(F.col("plane")[c].alias("h" + c) for c in "xyz"), "px", "py", "pz"), *(p + c for p in "dhp" for c in "xyz"), digits=9)


def image_coordinates(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") * 13 % 700 - 20).cast("long").alias("x"), (F.col("p_partkey") * 7 % 500 - 5).cast("long").alias("y"), (F.col("p_size") * 13).cast("long").alias("w"), (F.col("p_size") * 9).cast("long").alias("h"))
    turned = {}
    for name in ("portrait", "landscape", "landscape_reversed"):
        turned[name + "_x"], turned[name + "_y"] = placement.turned_coordinates(F.col("x"), F.col("y"), F.col("w"), F.col("h"), name)
    seen = placement.to_view(F.array(poly.point(F.col("x"), F.col("y"))), F.col("w"), F.col("h"), F.lit(1080), F.lit(1920))
    wide, high = placement.upscaled(F.col("w"), F.col("h"))
    return _r(p.select("id", *(c.alias(k) for k, c in turned.items()), seen[0]["x"].alias("view_x"), seen[0]["y"].alias("view_y"), wide.alias("wide"), high.alias("high"), placement.grid_step(F.col("w"), F.lit(64)).alias("step")), "view_x", "view_y")


def zone_checks(spark: SparkSession, d: str) -> DataFrame:
    """Plausible area, enough quiet merges, and whether a merge changed little."""
    b = view(spark, d, "boxes").withColumn("area", (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) / 1000.0)
    p = poly.box_polygon(*(F.col(c) for c in ("left", "top", "right", "bottom")))
    q = poly.box_polygon(F.col("left") + F.col("det") % 9, F.col("top"), F.col("right") + F.col("det") % 9, F.col("bottom"))
    b = v.settled(b, {"p": p, "q": q})
    b = b.withColumns({"shared": poly.shared_area(F.col("p"), F.col("q")), "p_area": poly.own_area(F.col("p")), "q_area": poly.own_area(F.col("q"))})
    difference = poly.symmetric_difference(F.col("p"), F.col("q"), F.col("shared"), (F.col("p_area"), F.col("q_area")))
    b = v.settled(b, {"difference": difference, "turn": v.plane_angle_degrees((F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.col("det") % 7 / 10.0, F.lit(-1.0)))})
    out = b.select("image_id", "det", zones.area_in_range(F.col("area")).alias("area_reason"), zones.is_placed(F.col("det") % 6).alias("placed"), "difference", "turn", placement.merge_is_insignificant(F.col("turn"), F.col("difference")).alias("insignificant"))
    return _r(out, "difference", "turn")


def tracked_frames(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "frames").select("session_id", "frame_id", F.when(F.col("event_type") == "error", "PAUSED").otherwise("TRACKING").alias("tracking"))
    settings = f.select("session_id").distinct().withColumn("detecting", F.col("session_id") % 3 != 0)
    return placement.tracked(f, settings, "detecting").select("session_id", "frame_id")


def first_zone_records(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").select("session_id", "zone_id", F.col("request_id").alias("seq"), "state")
    return placement.first_records(r, "session_id", "zone_id")


def view_inventory(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").groupBy("zone_id").agg(F.collect_set("session_id").alias("views"))
    return placement.view_inventory(r, r.filter("zone_id % 3 = 1")).groupBy("zone_id").agg(F.count("*").alias("views"), F.sum("view").alias("checksum"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "frames").select("session_id", F.round("luma_std", 6).alias("ms"))
    return _r(placement.latency(jobs, "session_id"), "mean_ms", "median_ms")


def applied_texts(spark: SparkSession, d: str) -> DataFrame:
    z = view(spark, d, "zones").select("zone_id", F.concat(F.lit("zone "), F.col("zone_id").cast("string")).alias("text"))
    t = z.filter("zone_id % 2 = 0").select("zone_id", F.when(F.col("zone_id") % 4 == 0, F.col("text")).otherwise("new").alias("value"))
    return placement.apply_texts(z, t)


def zone_picks(spark: SparkSession, d: str) -> DataFrame:
    taps = view(spark, d, "part").select((F.col("p_partkey") % 40).cast("long").alias("image_id"), F.col("p_partkey").cast("long").alias("tap_id"), (F.col("p_partkey") * 17 % 640).cast("double").alias("x"), (F.col("p_partkey") * 29 % 480).cast("double").alias("y"))
    b = view(spark, d, "boxes").select("image_id", F.col("det").alias("shape_id"), poly.box_polygon(*(F.col(c) for c in ("left", "top", "right", "bottom"))).alias("polygon"), ((F.col("left") + F.col("right")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    return placement.picked(taps, b, "image_id").select("image_id", "tap_id", "shape_id", "how")


def point_picks(spark: SparkSession, d: str) -> DataFrame:
    """The point that each tap on an image picks: the nearest one within the radius of points, which have no outline."""
    taps = view(spark, d, "part").select((F.col("p_partkey") % 40).cast("long").alias("image_id"), F.col("p_partkey").cast("long").alias("tap_id"), (F.col("p_partkey") * 17 % 640).cast("double").alias("x"), (F.col("p_partkey") * 29 % 480).cast("double").alias("y"))
    at = {k: F.col(a) for k, a in (("cx", "left"), ("cy", "top"))}
    points = view(spark, d, "boxes").select("image_id", F.col("det").alias("shape_id"), *(c.alias(k) for k, c in at.items()), F.array(*[poly.point(at["cx"], at["cy"])] * 3).alias("polygon"))
    return placement.picked(taps, points, "image_id", radius=placement.POINT_PICK).select("image_id", "tap_id", "shape_id")


def similar_views(spark: SparkSession, d: str) -> DataFrame:
    w = _views(spark, d).select("zone_id", F.col("frame_id").alias("view_id"), *("d" + c for c in "xyz"), (F.col("tx") * 0.05).alias("px"), (F.col("ty") * 0.05).alias("py"), v.length(v.sub(v.vec("t"), v.vec("c"))).alias("distance"))
    return placement.similar_views(w, "zone_id")


def screen_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "boxes").withColumn("p", poly.box_polygon(F.col("left") - 20, F.col("top") - 20, F.col("right") + 20, F.col("bottom") + 20))
    out = b.select("image_id", "det", *(c.alias(k) for k, c in placement.screen_coverage(F.col("p"), 400, 300).items()))
    return _r(out, "projected_area", "visible_area", "coverage", digits=8)


def best_projections(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("zone_id", (F.col("det_id") * 100 + F.col("frame_id")).alias("input_id"), F.round("conf", 6).alias("confidence"))
    return placement.best_projections(o, "zone_id").select("zone_id", F.array_join(F.transform("inputs", lambda x: x.cast("string")), ",").alias("inputs"))


def kept_projections(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "boxes").withColumns({"polygon": poly.box_polygon(*(F.col(c) for c in ("left", "top", "right", "bottom"))), "hull": F.array(*(poly.point(F.lit(x), F.lit(y)) for x, y in ((100.0, 100.0), (400.0, 100.0), (400.0, 300.0), (100.0, 300.0))))})
    return placement.meeting_hull(b).select("image_id", "det")


def fallback_points(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "points").select("point_id", F.struct("x", "y", "z").alias("s"))
    k = F.col("point_id")
    s = p.select("point_id", F.when(k % 3 == 0, F.col("s")).alias("depth"), F.when(k % 2 == 0, F.col("s")).alias("hit"), F.when(k % 5 != 0, F.col("s")).alias("feature"), (k % 7 / 100.0).alias("moved"), (k % 11 * 1.0).alias("turned"))
    return placement.placed_points(s).select("point_id", "method", F.col("place").isNotNull().alias("placed"))


def polygon_masks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes given as polygons, drawn into label masks, and what is seen of each."""
    quarter = [F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")]
    p = view(spark, d, "boxes").select("image_id", "det", poly.box_polygon(*quarter).alias("polygon"))
    return masks.label_boxes(p, "image_id")


def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    quarter = {c: F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")}
    return detect.instances(masks.label_boxes(view(spark, d, "boxes").withColumns(quarter), "image_id"), "image_id")


def mask_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that labels of two masks of whole images share."""
    met = masks.overlaps(*(view(spark, d, n) for n in ("truth", "boxes")), "image_id").filter("t is not null and p is not null")
    return met.groupBy("image_id").agg(F.count("*").alias("pairs"), F.sum("pixels").alias("pixels"), F.max("pixels").alias("most"))


def assembly_counts(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "images")
    items = images.select(F.concat(F.lit("s "), (F.col("id") % 2).cast("string")).alias("subset"), F.concat(F.lit("a/"), F.when(F.col("id") % 11 == 0, F.lit("same.png")).otherwise(F.col("file_name"))).alias("path"), "width", "height")
    listing = images.filter("id % 7 <> 0").select(F.concat(F.lit("a/"), F.col("file_name")).alias("path")).union(images.limit(1).select(F.lit("a/same.png")))
    return annotations.assembly_counts(items, listing, least=(500, 400))


def split_names(spark: SparkSession, d: str) -> DataFrame:
    s = annotations.split(view(spark, d, "images"), "id", 30, 30)
    return annotations.split_layout(s, "id")


def exported_annotations(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "boxes").select("image_id").distinct().select((F.col("image_id") % 3).alias("folder"), "image_id", F.lit(600).alias("width"), F.lit(400).alias("height"))
    b = view(spark, d, "boxes").filter("det % 5 <> 0").select("image_id", "det", "score", poly.box_polygon(F.col("left"), F.col("top"), F.when(F.col("det") % 4 == 0, F.col("left") + 0.5).otherwise(F.col("right")), F.col("bottom")).alias("polygon"))
    out = annotations.exported(images, b)
    return out.select("folder", "image_id", "ann", F.array_join(F.transform("ring", lambda x: x.cast("decimal(10,2)").cast("string")), " ").alias("ring"), F.round("area", 4).alias("area"), "left", "top", "width", "height")


def exported_masks(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of label masks: their numbers in their folder's document and their pixels."""
    quarter = {c: F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")}
    outlines = masks.label_outlines(view(spark, d, "boxes").withColumns(quarter), "image_id")
    images = view(spark, d, "boxes").select("image_id").distinct().select((F.col("image_id") % 3).alias("folder"), "image_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    out = annotations.exported_masks(images, outlines)
    return out.select("folder", "image_id", "ann", "area")


def dense_cells(spark: SparkSession, d: str) -> DataFrame:
    """Dense outputs, as one tensor or two, as cells with a score and ray distances."""
    e = view(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 6)).alias("v"))
    merged = e.filter("image_id % 2 = 0").select("image_id", F.lit(4).alias("channels"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.col("v").alias("values"))
    two = e.filter("image_id % 2 = 1").select("image_id", F.explode(F.array(F.struct(F.lit(1).alias("channels"), F.slice("v", 1, 16).alias("values")), F.struct(F.lit(3).alias("channels"), F.slice("v", 17, 48).alias("values")))).alias("t")).select("image_id", "t.channels", F.lit(4).alias("height"), F.lit(4).alias("width"), "t.values")
    out = detect.dense_candidates(detect.star_outputs(merged.union(two)), 0.1, border=1)
    return out.select("image_id", "y", "x", "score", F.round(poly.total(F.col("distances")), 6).alias("reach"))


def cleaned_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Vertices clamped to the image, rounded, thinned, and the boxes and centre that they have."""
    b = view(spark, d, "boxes").withColumn("p", poly.box_polygon(*(F.col(c).cast("long") for c in ("left", "top", "right", "bottom"))))
    b = b.withColumn("c", poly.clamped(F.col("p"), F.lit(500), F.lit(300)))
    half = F.transform("p", lambda q: poly.point(q["x"] / 4 + 0.5, q["y"] / 4))
    pixel, least = (poly.bounding_box(F.col("p"), n) for n in ("pixel", "least1"))
    middle = poly.centre(F.col("p"))
    text = lambda p: F.array_join(F.transform(p, lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ",")
    return b.select("image_id", "det", text(F.col("c")).alias("clamped"), text(poly.rounded_polygon(half)).alias("rounded"), text(poly.decimate(F.col("p"), 2)).alias("thinned"), pixel["width"].alias("pixel_width"), least["height"].alias("least_height"), middle["x"].alias("cx"), middle["y"].alias("cy"), annotations.ring_line(F.col("p"), F.lit(1000.0), F.lit(800.0)).alias("line"))


QUERIES = {f.__name__: f for f in (cleaned_polygons, exported_annotations, exported_masks, dense_cells, capture_angles, plane_coordinates, posed_points, image_coordinates, zone_checks, tracked_frames, first_zone_records, view_inventory, latency_summary, applied_texts, zone_picks, point_picks, similar_views, screen_coverage, best_projections, kept_projections, fallback_points, polygon_masks, mask_counts, mask_overlaps, assembly_counts, split_names)}

_VIEWS = """v0 AS (SELECT z.zone_id, c.frame_id, z.cx, z.cy, z.cz, 0.1e0 * (z.zone_id % 3) AS mx, 0.2e0 AS my, 1.0e0 AS mz, c.tx + z.cx AS tx, c.ty + z.cy AS ty, c.tz AS tz FROM zones z CROSS JOIN cams c),
v1 AS (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS ml, sqrt((tx-cx)*(tx-cx)+(ty-cy)*(ty-cy)+(tz-cz)*(tz-cz)) AS dl FROM v0),
v2 AS (SELECT *, mx/ml AS nx, my/ml AS ny, mz/ml AS nz, (tx-cx)/dl AS dx, (ty-cy)/dl AS dy, (tz-cz)/dl AS dz FROM v1)"""
_QUARTER = "q AS (SELECT image_id, det, floor(\"left\" / 4)::BIGINT AS l, floor(top / 4)::BIGINT AS t, floor(\"right\" / 4)::BIGINT AS r, floor(bottom / 4)::BIGINT AS b FROM {0})"
_CELLS = "c{1} AS (SELECT image_id, det, x, unnest(range(t, b)) AS y FROM (SELECT image_id, det, t, b, unnest(range(l, r)) AS x FROM (SELECT image_id, det, floor(\"left\" / 4)::BIGINT AS l, floor(top / 4)::BIGINT AS t, floor(\"right\" / 4)::BIGINT AS r, floor(bottom / 4)::BIGINT AS b FROM {0}))), m{1} AS (SELECT image_id, x, y, max(det) AS label FROM c{1} GROUP BY ALL)"
_PIXELS = "c{1} AS (SELECT image_id, det, x, unnest(range(t, b)) AS y FROM (SELECT image_id, det, t, b, unnest(range(l, r)) AS x FROM (SELECT image_id, det, floor(\"left\")::BIGINT AS l, floor(top)::BIGINT AS t, floor(\"right\")::BIGINT AS r, floor(bottom)::BIGINT AS b FROM {0}))), m{1} AS (SELECT image_id, x, y, max(det) AS label FROM c{1} GROUP BY ALL)"

ORACLE = {
    "cleaned_polygons": with_views(
        "boxes",
        """b AS (SELECT image_id, det, "left"::BIGINT AS l, top::BIGINT AS t, "right"::BIGINT AS r, bottom::BIGINT AS b FROM boxes),
p AS (SELECT *, [{'x': l, 'y': t}, {'x': r, 'y': t}, {'x': r, 'y': b}, {'x': l, 'y': b}] AS p FROM b),
c AS (SELECT *, [least(499, v.x) || ' ' || least(299, v.y) for v in p] AS k, [round_even(v.x / 4.0::DOUBLE + 0.5::DOUBLE, 0)::INT || ' ' || round_even(v.y / 4.0::DOUBLE, 0)::INT for v in p] AS h FROM p)
SELECT image_id, det, CASE WHEN len(list_distinct(k)) >= 3 THEN array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i), ',') END AS clamped, array_to_string(list_filter(h, lambda v, i: i = 1 OR v <> h[i - 1]), ',') AS rounded, l || ' ' || t || ',' || r || ' ' || b AS thinned,
  r - l + 1 AS pixel_width, greatest(b - t, 1) AS least_height, (l + r) // 2 AS cx, (t + b) // 2 AS cy, printf('0 %.8f %.8f %.8f %.8f %.8f %.8f %.8f %.8f', l / 1000.0::DOUBLE, t / 800.0::DOUBLE, r / 1000.0::DOUBLE, t / 800.0::DOUBLE, r / 1000.0::DOUBLE, b / 800.0::DOUBLE, l / 1000.0::DOUBLE, b / 800.0::DOUBLE) AS line FROM c""",
    ),
    "exported_annotations": with_views(
        "boxes",
        """k AS (SELECT image_id % 3 AS folder, image_id, det, least("left", 599) AS l, least(top, 399) AS t, least(CASE WHEN det % 4 = 0 THEN "left" + 0.5e0 ELSE "right" END, 599) AS r, least(bottom, 399) AS b FROM boxes WHERE det % 5 <> 0),
a AS (SELECT *, (r - l) * (b - t) AS area FROM k WHERE (r - l) * (b - t) >= 8)
SELECT folder, image_id, row_number() OVER (PARTITION BY folder ORDER BY image_id, det) AS ann, printf('%.2f %.2f %.2f %.2f %.2f %.2f %.2f %.2f', l, t, r, t, r, b, l, b) AS ring, round(area, 4) AS area, l AS "left", t AS top, r - l AS width, b - t AS height FROM a""",
    ),
    "exported_masks": with_views(
        "boxes",
        """c AS (SELECT image_id, det, x, unnest(range(t, b)) AS y FROM (SELECT image_id, det, t, b, unnest(range(l, r)) AS x FROM (SELECT image_id, det, floor("left" / 4)::BIGINT AS l, floor(top / 4)::BIGINT AS t, floor("right" / 4)::BIGINT AS r, floor(bottom / 4)::BIGINT AS b FROM boxes))),
m AS (SELECT image_id, x, y, max(det) AS label FROM c GROUP BY ALL),
n AS (SELECT image_id % 3 AS folder, image_id, label, count(*)::DOUBLE AS area FROM m GROUP BY ALL HAVING count(*) >= 8)
SELECT folder, image_id, row_number() OVER (PARTITION BY folder ORDER BY image_id, label) AS ann, area FROM n""",
    ),
    "dense_cells": "WITH c AS (SELECT vec_id::BIGINT AS image_id, unnest(range(0, 64)) AS p, unnest(embedding) AS e FROM embeddings), n AS (SELECT image_id, p // 16 AS c, p % 16 // 4 AS y, p % 4 AS x, round(abs(e::DOUBLE), 6) AS v FROM c), g AS (SELECT image_id, y, x, max(v) FILTER (c = 0) AS score, sum(v) FILTER (c > 0) AS reach FROM n GROUP BY ALL) SELECT image_id, y, x, score, round(reach, 6) AS reach FROM g WHERE score >= 0.1 AND x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2",
    "capture_angles": with_views(
        "zones cams",
        _VIEWS
        + """, v3 AS (SELECT *, greatest(-1.0, least(1.0, nx*dx+ny*dy+nz*dz)) AS dot, sqrt(nz*nz+nx*nx) AS al FROM v2),
v4 AS (SELECT *, nz/al AS ax, 0.0e0 AS ay, -nx/al AS az, dx-nx*dot AS px, dy-ny*dot AS py, dz-nz*dot AS pz FROM v3),
v5 AS (SELECT *, ny*az-nz*ay AS bx, nz*ax-nx*az AS "by", nx*ay-ny*ax AS bz, sqrt(px*px+py*py+pz*pz) AS pl FROM v4),
v6 AS (SELECT *, sqrt(bx*bx+"by"*"by"+bz*bz) AS bl FROM v5)
SELECT a.zone_id, a.frame_id, round(degrees(acos(a.dot)), 6) + 0.0e0 AS angle, round(a.dot, 6) + 0.0e0 AS dot,
  CASE WHEN a.pl > 1e-12 THEN round((a.px*a.ax+a.py*a.ay+a.pz*a.az)/a.pl, 6) + 0.0e0 END AS planar_x, CASE WHEN a.pl > 1e-12 THEN round((a.px*a.bx+a.py*a."by"+a.pz*a.bz)/a.bl/a.pl, 6) + 0.0e0 END AS planar_y,
  round(degrees(acos(greatest(-1.0, least(1.0, a.dx*f.dx+a.dy*f.dy+a.dz*f.dz)))), 4) + 0.0e0 AS from_first FROM v6 a JOIN v6 f ON f.zone_id = a.zone_id AND f.frame_id = 0""",
    ),
    "plane_coordinates": with_views(
        "bars",
        """p0 AS (SELECT bar_id, x - 1.0e0 AS x, y - 0.5e0 AS y, z - 0.25e0 AS z, 0.1e0 * (zone_id % 2) AS mx, 0.3e0 AS my, 1.0e0 AS mz FROM bars),
p1 AS (SELECT *, mx/sqrt(mx*mx+my*my+mz*mz) AS nx, my/sqrt(mx*mx+my*my+mz*mz) AS ny, mz/sqrt(mx*mx+my*my+mz*mz) AS nz FROM p0),
p2 AS (SELECT *, -nz/sqrt(nz*nz+nx*nx) AS ax, 0.0e0 AS ay, nx/sqrt(nz*nz+nx*nx) AS az FROM p1),
p3 AS (SELECT *, ny*az-nz*ay AS bx, nz*ax-nx*az AS "by", nx*ay-ny*ax AS bz FROM p2),
p4 AS (SELECT *, x*ax+y*ay+z*az AS u, x*bx+y*"by"+z*bz AS w FROM p3)
SELECT bar_id, round(u, 6) + 0.0e0 AS u, round(w, 6) + 0.0e0 AS w, round(1.0e0+ax*u+bx*w, 6) + 0.0e0 AS px, round(0.5e0+ay*u+"by"*w, 6) + 0.0e0 AS py, round(0.25e0+az*u+bz*w, 6) + 0.0e0 AS pz FROM p4""",
    ),
    "posed_points": with_views(
        "frames",
        """f0 AS (SELECT frame_id, tx, ty, tz, radians(CAST(frame_id % 12 AS DOUBLE)) AS yaw, (frame_id % 21 - 10) / 20.0e0 AS u, (frame_id % 13 - 6) / 15.0e0 AS w FROM frames),
f1 AS (SELECT *, -u / sqrt(u*u+w*w+1) AS ex, -w / sqrt(u*u+w*w+1) AS ey, -1 / sqrt(u*u+w*w+1) AS ez FROM f0),
f2 AS (SELECT *, ex*cos(yaw)+ez*sin(yaw) AS dx, ey AS dy, ez*cos(yaw)-ex*sin(yaw) AS dz, 1.5e0*u AS gx, -1.5e0*w AS gy, -1.5e0 AS gz FROM f1),
f3 AS (SELECT *, dy*0.2e0+dz AS den, (-ty*0.2e0 + (-2.0e0-tz)) / (dy*0.2e0+dz) AS t FROM f2)
SELECT frame_id, round(dx, 9) + 0.0e0 AS dx, round(dy, 9) + 0.0e0 AS dy, round(dz, 9) + 0.0e0 AS dz,
  CASE WHEN abs(den) > 1e-6 AND t > 0 THEN round(tx+dx*t, 9) + 0.0e0 END AS hx, CASE WHEN abs(den) > 1e-6 AND t > 0 THEN round(ty+dy*t, 9) + 0.0e0 END AS hy, CASE WHEN abs(den) > 1e-6 AND t > 0 THEN round(tz+dz*t, 9) + 0.0e0 END AS hz,
  round(tx+gx*cos(yaw)+gz*sin(yaw), 9) + 0.0e0 AS px, round(ty+gy, 9) + 0.0e0 AS py, round(tz+gz*cos(yaw)-gx*sin(yaw), 9) + 0.0e0 AS pz FROM f3""",
    ),
    "image_coordinates": """WITH p AS (SELECT p_partkey::BIGINT AS id, (p_partkey * 13 % 700 - 20)::BIGINT AS x, (p_partkey * 7 % 500 - 5)::BIGINT AS y, (p_size * 13)::BIGINT AS w, (p_size * 9)::BIGINT AS h FROM part),
c AS (SELECT *, greatest(0, least(x, w - 1)) AS sx, greatest(0, least(y, h - 1)) AS sy, greatest(1.0::DOUBLE, 128.0::DOUBLE / h, 128.0::DOUBLE / w) AS k FROM p)
SELECT id, sy * w // h AS portrait_x, (w - 1 - sx) * h // w AS portrait_y, sx AS landscape_x, sy AS landscape_y, w - 1 - sx AS landscape_reversed_x, h - 1 - sy AS landscape_reversed_y,
  round(x / w::DOUBLE * 1080, 6) + 0.0e0 AS view_x, round(y / h::DOUBLE * 1920, 6) + 0.0e0 AS view_y, ceil(round(w * k, 9))::BIGINT AS wide, ceil(round(h * k, 9))::BIGINT AS high, greatest(1, w // 64) AS step FROM c""",
    "zone_checks": with_views("boxes", "b AS (SELECT *, (\"right\" - \"left\") * (bottom - top) / 1000.0e0 AS area, least(det % 9, \"right\" - \"left\") / (\"right\" - \"left\") * 2 AS difference, degrees(atan((det % 7) / 10.0e0)) AS turn FROM boxes) SELECT image_id, det, CASE WHEN area < 0.001 THEN 'too small' WHEN area > 2 THEN 'too large' END AS area_reason, det % 6 >= 3 AS placed, round(difference, 6) + 0.0e0 AS difference, round(turn, 6) + 0.0e0 AS turn, turn < 25 AND difference <= 0.5 AS insignificant FROM b"),
    "tracked_frames": with_views("frames", "SELECT session_id, frame_id FROM frames WHERE event_type <> 'error' AND session_id % 3 <> 0"),
    "first_zone_records": with_views("requests", "SELECT session_id, zone_id, min(request_id) AS seq, arg_min(state, request_id) AS state FROM requests GROUP BY session_id, zone_id"),
    "view_inventory": with_views("requests", "SELECT zone_id, count(DISTINCT session_id) AS views, sum(DISTINCT session_id)::BIGINT AS checksum FROM requests WHERE zone_id % 3 <> 1 GROUP BY zone_id"),
    "latency_summary": with_views("frames", "SELECT session_id, count(*) AS jobs, round(avg(round(luma_std, 6)), 6) AS mean_ms, round(median(round(luma_std, 6)), 6) AS median_ms FROM frames GROUP BY session_id"),
    "applied_texts": with_views("zones", "SELECT zone_id, CASE WHEN zone_id % 4 = 2 THEN 'new' ELSE 'zone ' || zone_id END AS text, zone_id % 4 = 2 AS changed FROM zones"),
    "zone_picks": with_views(
        "boxes",
        """t AS (SELECT (p_partkey % 40)::BIGINT AS image_id, p_partkey::BIGINT AS tap_id, (p_partkey * 17 % 640)::DOUBLE AS x, (p_partkey * 29 % 480)::DOUBLE AS y FROM part),
m AS (SELECT t.image_id, tap_id, det AS shape_id, x BETWEEN "left" AND "right" AND y BETWEEN top AND bottom AS inside, ("right" - "left") * (bottom - top) AS area, round(pow(x - ("left" + "right") / 2, 2) + pow(y - (top + bottom) / 2, 2), 9) AS far FROM t JOIN boxes b ON b.image_id = t.image_id),
k AS (SELECT *, row_number() OVER (PARTITION BY tap_id ORDER BY NOT inside, CASE WHEN inside THEN area ELSE far END, shape_id) AS place FROM m WHERE inside OR far <= 9216)
SELECT image_id, tap_id, shape_id, CASE WHEN inside THEN 'inside' ELSE 'near' END AS how FROM k WHERE place = 1""",
    ),
    "point_picks": with_views(
        "boxes",
        """t AS (SELECT (p_partkey % 40)::BIGINT AS image_id, p_partkey::BIGINT AS tap_id, (p_partkey * 17 % 640)::DOUBLE AS x, (p_partkey * 29 % 480)::DOUBLE AS y FROM part),
m AS (SELECT t.image_id, tap_id, det AS shape_id, round(pow(x - "left", 2) + pow(y - top, 2), 9) AS far FROM t JOIN boxes b ON b.image_id = t.image_id),
k AS (SELECT *, row_number() OVER (PARTITION BY tap_id ORDER BY far, shape_id) AS place FROM m WHERE far <= 5184)
SELECT image_id, tap_id, shape_id FROM k WHERE place = 1""",
    ),
    "similar_views": with_views(
        "zones cams",
        _VIEWS
        + """, s AS (SELECT a.zone_id, a.frame_id AS first, b.frame_id AS second, round(degrees(acos(greatest(-1.0, least(1.0, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)))) / 15.0e0 + 0.05e0 * sqrt(pow(a.tx-b.tx, 2)+pow(a.ty-b.ty, 2)) / ((a.dl+b.dl) / 2) / 0.1e0, 6) AS delta FROM v2 a JOIN v2 b ON a.zone_id = b.zone_id AND a.frame_id < b.frame_id)
SELECT * FROM s WHERE delta <= 1""",
    ),
    "screen_coverage": with_views("boxes", "b AS (SELECT image_id, det, \"left\" - 20 AS l, top - 20 AS t, \"right\" + 20 AS r, bottom + 20 AS b FROM boxes), c AS (SELECT *, (r - l) * (b - t) AS projected_area, greatest(least(r, 400) - greatest(l, 0), 0) * greatest(least(b, 300) - greatest(t, 0), 0) AS visible_area FROM b) SELECT image_id, det, round(projected_area, 8) AS projected_area, round(visible_area, 8) AS visible_area, l >= 0 AND t >= 0 AND r <= 400 AND b <= 300 AS fully_inside, round(visible_area / 120000.0e0, 8) AS coverage FROM c"),
    "best_projections": with_views("obs", "k AS (SELECT zone_id, det_id * 100 + frame_id AS input_id, row_number() OVER (PARTITION BY zone_id ORDER BY round(conf, 6) DESC, det_id * 100 + frame_id) AS place FROM obs) SELECT zone_id, string_agg(input_id::VARCHAR, ',' ORDER BY place) AS inputs FROM k WHERE place <= 10 GROUP BY zone_id"),
    "kept_projections": with_views("boxes", "SELECT image_id, det FROM boxes WHERE least(\"right\", 400) > greatest(\"left\", 100) AND least(bottom, 300) > greatest(top, 100)"),
    "fallback_points": with_views("points", "m AS (SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'depth' WHEN point_id % 7 <= 5 AND point_id % 11 <= 5 AND point_id % 2 = 0 THEN 'hit' WHEN point_id % 7 <= 5 AND point_id % 11 <= 5 AND point_id % 5 <> 0 THEN 'feature' END AS method FROM points) SELECT point_id, method, method IS NOT NULL AS placed FROM m"),
    "polygon_masks": with_views("boxes", _QUARTER.format("boxes") + ", x AS (SELECT image_id, det, t, b, unnest(range(l, r + 1)) AS x FROM q), c AS (SELECT image_id, det, x, unnest(range(t, b + 1)) AS y FROM x), m AS (SELECT image_id, x, y, max(det) AS label FROM c GROUP BY ALL) SELECT image_id, label, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS area FROM m GROUP BY image_id, label"),
    "mask_counts": with_views("boxes", _CELLS.format("boxes", "") + " SELECT image_id, count(DISTINCT label) AS instances FROM m GROUP BY image_id"),
    "mask_overlaps": with_views("boxes truth", _PIXELS.format("truth", "t") + ", " + _PIXELS.format("boxes", "p") + ", o AS (SELECT image_id, mt.label AS t, mp.label AS p, count(*) AS pixels FROM mt JOIN mp USING (image_id, x, y) GROUP BY ALL) SELECT image_id, count(*) AS pairs, sum(pixels)::BIGINT AS pixels, max(pixels) AS most FROM o GROUP BY image_id"),
    "assembly_counts": with_views("images", "i AS (SELECT id % 2 AS subset, CASE WHEN id % 11 = 0 THEN 'same.png' ELSE file_name END AS name, id FROM images), f AS (SELECT * FROM i WHERE name = 'same.png' OR id % 7 <> 0), n AS (SELECT count(DISTINCT (subset, name)) AS kept FROM f) SELECT (SELECT count(*) FROM i) - (SELECT count(*) FROM f) AS missing, (SELECT kept FROM n) AS copied, (SELECT kept FROM n) AS generated, (SELECT kept FROM n) * 0 AS resized, (SELECT count(*) FROM f) - (SELECT kept FROM n) AS collisions"),
    "split_names": with_views("images", "k AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id::VARCHAR), id) AS place FROM images), s AS (SELECT id, CASE WHEN place <= 30 THEN 'test' WHEN place <= 60 THEN 'val' ELSE 'train' END AS split FROM k) SELECT id, split, split || '_' || printf('%05d', row_number() OVER (PARTITION BY split ORDER BY id) - 1) AS name FROM s"),
}
