"""Queries over frames, detections, annotations, requests and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.functions import vec as v
from parallaxis.operators import annotations, corrections, detect, evaluate, frames, masks, placement, zones
from parallaxis.plans.fixtures import view, with_views
from parallaxis.scratch import cut


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def frame_motion(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames.motion(view(spark, d, "frames")).select("session_id", "frame_id", "move", "turn"), "move").withColumn("turn", F.round("turn", 4) + 0.0)


def frame_reasons(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "frames").withColumns({"move": F.lit(0.0), "turn": F.lit(0.0)})
    return f.select("frame_id", F.array_join(frames.reasons(), ",").alias("reasons"))


def frame_gate(spark: SparkSession, d: str) -> DataFrame:
    return frames.gate(frames.motion(view(spark, d, "frames")), guard_seconds=86_400.0)


def frame_cadence(spark: SparkSession, d: str) -> DataFrame:
    return frames.cadence(view(spark, d, "frames"), 604_800).select("session_id", F.unix_seconds("start").alias("start"), "frame_id")


def image_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _r(frames.image_statistics(view(spark, d, "pixels")), "mean", "deviation", "dark", "bright").withColumn("sharpness", F.round("sharpness", 3))


def percentile_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = frames.percentile_normalised(view(spark, d, "pixels"))
    return _r(p.groupBy("image_id").agg(F.sum("value").alias("total"), F.max("value").alias("most")), "total", "most")


def image_tiles(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "part").select(F.col("p_partkey").cast("long").alias("image_id"), (F.col("p_size") * 100).cast("long").alias("width"), (F.col("p_size") * 60).cast("long").alias("height"))
    return frames.tiles(images).groupBy("image_id").agg(F.count("*").alias("tiles"), F.max("tx").alias("tx"), F.max("ty").alias("ty"))


def tile_stitching(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pixels").withColumn("x0", F.explode(F.array(F.lit(0), F.lit(8)))).withColumn("y0", F.lit(0)).withColumn("value", F.col("luma") + F.col("x0"))
    return _r(frames.stitched(p.select("image_id", "x0", "y0", "x", "y", "value")), "value")


def depth_decode(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("frame_id"), F.lit(8).alias("width"), F.transform("embedding", lambda x: (F.floor(F.abs(x) * 1e6) % 65536).cast("int")).alias("values"))
    c = frames.decode_depth(e)
    return c.groupBy("frame_id").agg(F.sum("mm").alias("mm"), F.sum("confidence").alias("confidence"), F.sum(F.col("mm") * (F.col("x") + 8 * F.col("y"))).alias("moment"))


def depth_sampling(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "pixels", dealt={"part": "p_partkey"}).select(F.col("image_id").alias("frame_id"), "x", "y", F.when(F.col("luma") % 3 > 0, F.col("luma") * 10).otherwise(0).alias("mm"), (F.col("luma") % 8).alias("confidence"))
    s = view(spark, d, "part", dealt={"part": "p_partkey"}).select(F.col("p_partkey").cast("long").alias("frame_id"), F.lit(1).alias("sample_id"), (F.col("p_partkey") % 16).cast("int").alias("sx"), (F.col("p_partkey") * 7 % 16).cast("int").alias("sy"))
    return frames.depth_samples(s, c)


def pixel_channels(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part").select(F.col("p_partkey").cast("long").alias("image_id"), (F.col("p_partkey") * 7919 % 16777216).cast("int").alias("packed"))
    return p.select("image_id", *(F.round(c, 6).alias(k) for k, c in frames.channels(F.col("packed")).items()))


def zone_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _r(zones.bounds(view(spark, d, "bars"), "zone_id"), "cx", "cy", "cz", *(m + n for m in ("min", "max") for n in "xyz"))


def zone_planes(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "points").withColumn("z", F.col("z") + 0.3 * F.col("x") - 0.1 * F.col("y"))
    cameras = p.select("label").distinct().withColumns({"tx": F.lit(0.0), "ty": F.lit(0.0), "tz": F.when(F.col("label") % 2 == 0, 9.0).otherwise(-9.0)})
    own = zones.plane_pose(zones.fit_plane(p, "label"), cameras, "label").select("label", "n", *"abc", "mx", "my", "mz", "nx", "ny", "nz", "reason")
    return own.withColumns({c: F.round(c, 4) + 0.0 for c in (*"abc", "mx", "my", "mz", "nx", "ny", "nz")})


def view_choice(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "boxes").select(F.col("image_id").alias("frame_id"), F.col("det").alias("zone_id"), "left", "top", "right", "bottom", (F.col("det") % 5).cast("double").alias("distance"), (F.col("score") + 0.05 * (F.col("det") % 7)).alias("coverage"))
    return _r(zones.target_zone(b.withColumn("angle", (F.col("zone_id") * 13 % 90).cast("double"))), "coverage")


def outline_choice(spark: SparkSession, d: str) -> DataFrame:
    """The same choice with the boxes given as outlines."""
    b = view(spark, d, "boxes").select(F.col("image_id").alias("frame_id"), F.col("det").alias("zone_id"), poly.box_polygon(*(F.col(c) for c in ("left", "top", "right", "bottom"))).alias("polygon"), (F.col("det") % 5).cast("double").alias("distance"), (F.col("score") + 0.05 * (F.col("det") % 7)).alias("coverage"), (F.col("det") * 13 % 90).cast("double").alias("angle"))
    return _r(zones.target_zone(b), "coverage")


def guidance_radius(spark: SparkSession, d: str) -> DataFrame:
    cameras = view(spark, d, "zones").select("zone_id", "cx", "cy").crossJoin(F.broadcast(view(spark, d, "cams"))).select("zone_id", (F.col("tx") + F.col("cx")).alias("tx"), (F.col("ty") + F.col("cy")).alias("ty"), "tz")
    return _r(zones.guidance(view(spark, d, "bars"), cameras), "gx", "gy", "gz", "radius")


def suggested_views(spark: SparkSession, d: str) -> DataFrame:
    """Views suggested around every zone, given those that its cameras have taken."""
    z, cams = view(spark, d, "zones"), view(spark, d, "cams")
    met = z.select("zone_id", "cx", "cy").crossJoin(F.broadcast(cams)).select("zone_id", "frame_id", (F.col("tx") + F.col("cx")).alias("tx"), (F.col("ty") + F.col("cy")).alias("ty"), "tz", "cx", "cy")
    around = zones.guidance(view(spark, d, "bars"), met).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    axes = placement.plane_axes((F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    g = met.filter("(frame_id + zone_id) % 6 = 0").join(around.select("zone_id", "gx", "gy", "gz"), "zone_id")
    to = v.sub(v.vec("t"), v.vec("g"))
    px, py = placement.to_plane(v.vec("t"), v.vec("g"), axes)
    taken = g.select("zone_id", F.col("frame_id").alias("view_id"), F.lit(0.0).alias("angle"), *(c.alias("d" + k) for c, k in zip(to, "xyz")), px.alias("px"), py.alias("py"), v.length(to).alias("distance"))
    return _r(zones.diverse_views(zones.hemisphere(around), taken), "score")


def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    return detect.suppress(view(spark, d, "boxes"), "image_id", above=0.3).select("image_id", "det", "score")


def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    return detect.overlapping(detect.top_candidates(view(spark, d, "boxes"), "image_id"), "image_id", above=0.3)


def tensor_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "embeddings").select((F.col("vec_id") % 50).cast("long").alias("image_id"), F.col("vec_id").cast("long").alias("det"), F.slice("embedding", 1, 37).alias("values"))
    return _r(detect.decode_rows(rows, threshold=0.05).select("image_id", "det", "score", "left", "top", "right", "bottom"), "score", "left", "top", "right", "bottom").withColumns({c: F.round(c, 3) for c in ("left", "top", "right", "bottom")})


def mask_mixing(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "embeddings")
    det = e.select((F.col("vec_id") % 50).cast("long").alias("image_id"), F.col("vec_id").cast("long").alias("det"), F.slice("embedding", 6, 32).alias("coefficients"), (F.col("vec_id") % 3).alias("left"), (F.col("vec_id") % 3 + 3).alias("right"), (F.col("vec_id") % 2).alias("top"), (F.col("vec_id") % 2 + 4).alias("bottom"))
    proto = e.select((F.col("vec_id") % 50).cast("long").alias("image_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("x"), (F.col("vec_id") % 7).cast("int").alias("y"), F.slice("embedding", 30, 32).alias("proto"))
    return detect.mix_masks(det, proto)


def rasterised(spark: SparkSession, d: str) -> DataFrame:
    quarter = {c: F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")}
    return masks.label_boxes(view(spark, d, "boxes").withColumns(quarter), "image_id")


def instance_counts(spark: SparkSession, d: str) -> DataFrame:
    t, p = view(spark, d, "truth"), view(spark, d, "boxes").filter("score >= 0.5")
    both = t.groupBy("image_id").agg(F.count("*").alias("t")).join(p.groupBy("image_id").agg(F.count("*").alias("p")), "image_id", "full").fillna(0)
    return _r(evaluate.count_errors(both), "rmse", "mae", "relative", "signed", "mean_true", "mean_predicted")


def instance_overlaps(spark: SparkSession, d: str) -> DataFrame:
    met = evaluate.overlaps(view(spark, d, "truth"), view(spark, d, "boxes"), "image_id")
    return _r(met.groupBy("image_id").agg(F.count("*").alias("pairs"), F.sum("iou").alias("iou"), F.max("iou").alias("best")), "iou", "best")


def matching_scores(spark: SparkSession, d: str) -> DataFrame:
    t, p = view(spark, d, "truth"), view(spark, d, "boxes").filter("score >= 0.3")
    met = evaluate.overlaps(t, p, "image_id")
    return _r(evaluate.scores(evaluate.match_once(met, "image_id"), t, p), "mean_iou", "precision", "recall", "f1", "accuracy", "dice", "panoptic")


#: Overlaps at which a sweep matches anew.
SWEPT = [k / 20 for k in range(2, 19)]


def _masks(spark: SparkSession, d: str) -> list[DataFrame]:
    """The label masks themselves, as cells."""
    quarter = {c: F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")}
    return [detect.rasterise(view(spark, d, n).withColumns(quarter), "image_id") for n in ("truth", "boxes")]


def _by_mask(spark: SparkSession, d: str, thresholds: list[float]) -> DataFrame:
    """The sweep of the label masks that boxes make in quarter size."""
    quarter = {c: F.floor(F.col(c) / 4) for c in ("left", "top", "right", "bottom")}
    shared = cut(masks.overlaps(*(view(spark, d, n).withColumns(quarter) for n in ("truth", "boxes")), "image_id"))
    labels = [shared.filter(F.col(c).isNotNull()).select("image_id", c).distinct() for c in "tp"]
    return evaluate.sweep(evaluate.mask_ious(shared, "image_id"), *labels, thresholds, "image_id")


def matching_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Matching of boxes, and of the label masks that they make, at every threshold."""
    boxes = [view(spark, d, n) for n in ("truth", "boxes")]
    return _r(evaluate.sweep_both(*boxes, SWEPT, "image_id", shrink=4), "threshold", "f1", "mask_f1")


def mask_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Matching of label masks from half on, where a label has one partner at most."""
    return _r(_by_mask(spark, d, SWEPT[9:]), "threshold", "f1")


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid of nine score and nine suppression thresholds."""
    return _r(evaluate.grid_search(view(spark, d, "boxes"), view(spark, d, "truth")), "f1", "panoptic")


def foreground_scores(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pixels")
    cells = p.select(F.when(F.col("luma") > 128, 1).otherwise(0).alias("t"), F.when(F.col("luma") > 100, 1).otherwise(0).alias("p"))
    return _r(evaluate.foreground(cells), "iou", "dice")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "annotations")
    x, y, w, h = (F.col(c) for c in "xywh")
    ring = F.when(F.col("l_linenumber") == 1, F.array(x, y, x + w, y)).otherwise(F.array(x, y, x + w, y, x + w, y + h, x, y + h))
    return a.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("ann")).cast("long").alias("ann"), "category", "iscrowd", ring.alias("ring"))


def image_polygons(spark: SparkSession, d: str) -> DataFrame:
    a = annotations.usable(_annotations(spark, d), ["A", "N"])
    return annotations.images_with_polygons(view(spark, d, "images"), a).select("id", "file_name", "polygons", F.coalesce(F.size(F.flatten("rings")), F.lit(0)).alias("numbers"))


def named_images(spark: SparkSession, d: str) -> DataFrame:
    names = view(spark, d, "images").filter("id % 5 < 2").select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("/a/"), F.upper("file_name"))).otherwise(F.regexp_replace("file_name", ".png", "")).alias("name"))
    return annotations.keep_named(view(spark, d, "images"), names).select("id", "file_name")


def replaced_annotations(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "images")
    a = _annotations(spark, d).select("image_id", "ann", "category")
    new_images = images.filter("id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), F.regexp_replace("file_name", "png", "jpg").alias("file_name"))
    new = a.filter("image_id % 4 = 0 and ann <= 2").select((F.col("image_id") + 1_000_000).alias("image_id"), "ann", F.lit("new").alias("category"), F.lit(1.0).alias("score"))
    return annotations.replace_annotations(images, a, new_images, new).select("image_id", "ann", "category", "score")


def absent_stems(spark: SparkSession, d: str) -> DataFrame:
    images = view(spark, d, "images").select(F.concat(F.lit("x/"), F.col("file_name")).alias("name"))
    return annotations.missing_stems(images, view(spark, d, "images").filter("id % 3 <> 0").select(F.regexp_replace("file_name", "png", "tif").alias("name")))


def dataset_assembly(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "images").select(F.concat(F.lit("s "), (F.col("id") % 2).cast("string")).alias("subset"), F.concat(F.lit("a/"), F.col("file_name")).alias("path"))
    listing = view(spark, d, "images").filter("id % 7 <> 0").select(F.concat(F.lit("a/"), F.col("file_name")).alias("path"))
    return annotations.assembled(items, listing)


def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    return annotations.split(view(spark, d, "images"), "id", 30, 30)


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "boxes")
    return b.select("image_id", "det", annotations.label_line(*(F.col(c) for c in ("left", "top", "right", "bottom")), F.lit(1000.0), F.lit(800.0)).alias("line"))


def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area, containment, clipping and overlap of each box as a polygon with a star around its corner."""
    b = view(spark, d, "boxes")
    b = b.withColumn("p", poly.box_polygon(*(F.col(c) for c in ("left", "top", "right", "bottom"))))
    b = b.withColumn("q", poly.box_polygon(F.col("left") + 5, F.col("top") - 3, F.col("right") + 5, F.col("bottom") - 3)).withColumn("star", poly.star_polygon(F.col("left"), F.col("top"), F.array(F.lit(4.0), F.lit(4.0), F.lit(4.0), F.lit(4.0))))
    b = b.withColumns({"i": poly.shared_area(F.col("p"), F.col("q")), "area": poly.own_area(F.col("p")), "moved": poly.own_area(F.col("q")), "star_area": poly.own_area(F.col("star"))})
    own = F.col("p"), F.col("q"), F.col("i"), (F.col("area"), F.col("moved"))
    out = b.select("image_id", "det", "area", poly.contains(F.col("p"), F.lit(320.0), F.col("top") + 1).alias("inside"), F.col("i").alias("clipped"), poly.overlap_by_smaller(*own).alias("overlap"), poly.symmetric_difference(*own).alias("difference"), F.col("star_area").alias("star"))
    return _r(out, "area", "clipped", "overlap", "difference", "star")


def request_states(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests")
    return corrections.status_counts(r.filter("state <> 'DELETE'")).withColumn("text", corrections.status_text())


def request_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").select("session_id", (F.col("request_id") % 40).alias("request_id"), F.col("request_id").alias("seq"), "ts", "state")
    return corrections.lifecycle(r)


def correction_replay(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "frames")
    ops = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "rotate").when(F.col("event_type") == "purchase", F.when(F.col("frame_id") % 11 == 0, "reset").otherwise("delete_zone")).otherwise("add")
    events = e.select("session_id", F.col("frame_id").alias("seq"), ops.alias("op"), (F.col("frame_id") % 23).alias("point_id"), F.when(ops.isin("delete_zone", "add"), F.col("frame_id") % 4).alias("zone_id"))
    events = events.withColumn("point_id", F.when(F.col("op").isin("add", "delete", "rotate"), F.col("point_id"))).withColumn("zone_id", F.when((F.col("op") == "add") & (F.col("seq") % 3 == 0), None).otherwise(F.col("zone_id")))
    nearest = e.select((F.col("frame_id") % 23).alias("point_id")).distinct().withColumn("zones", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("point_id") + k * 3) % 4))
    return corrections.replay(events, nearest)


def point_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "points").select((F.col("point_id") % 9).alias("session_id"), "point_id", F.col("label").alias("zone_id"))
    manual = p.filter("point_id % 50 = 0").select("session_id", (F.col("point_id") + 1_000_000).alias("point_id"), "zone_id")
    return corrections.overlay(p, p.filter("point_id % 7 = 0").select("session_id", "point_id", (F.col("zone_id") + 1).alias("zone_id")), p.filter("point_id % 13 = 0"), manual)


def point_validation(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "points").select("point_id", F.when(F.col("point_id") % 17 == 0, float("nan")).otherwise(F.col("x")).alias("x"), "y", "z", (F.col("conf") + F.when(F.col("point_id") % 5 == 0, 0.5).otherwise(0.0)).alias("conf"), F.when(F.col("point_id") % 3 == 0, F.col("label") + 5).alias("zone_id"))
    return corrections.valid_points(p, view(spark, d, "point_zones")).select("point_id", "reason")


def changed_counts(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").filter("state <> 'DELETE'")
    half = r.agg(F.max("request_id")).select((F.col("max(request_id)") / 2).alias("half"))
    now = r.groupBy("session_id", "zone_id").agg(F.count_if(F.col("state") == "FAILED").alias("n"))
    before = r.crossJoin(F.broadcast(half)).filter("request_id <= half").groupBy("session_id", "zone_id").agg(F.count_if(F.col("state") == "FAILED").alias("n"))
    return corrections.changed(before, now, "n", "session_id", "zone_id")


def preserved_counts(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").select("session_id", "zone_id", "ts", F.col("request_id").alias("seq"), F.when(F.col("request_id") % 3 == 0, F.col("request_id")).alias("count"))
    return corrections.first_known(r).select("seq", "preserved")


def session_progress(spark: SparkSession, d: str) -> DataFrame:
    return corrections.progress(view(spark, d, "requests"), view(spark, d, "frames").filter("event_type = 'click'"))


def session_texts(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "requests").groupBy("session_id", "zone_id").agg(F.count("*").alias("points"))
    return corrections.session_text(r.withColumn("local", F.when(F.col("zone_id") == 3, F.col("points") + 1)))


QUERIES = {
    f.__name__: f
    for f in (
        frame_motion, frame_reasons, frame_gate, frame_cadence, image_statistics, percentile_pixels, image_tiles, tile_stitching, depth_decode, depth_sampling, pixel_channels, zone_bounds, zone_planes, view_choice, outline_choice, guidance_radius, suggested_views,
        box_suppression, box_pairs, tensor_decode, mask_mixing, rasterised, instance_counts, instance_overlaps, matching_scores, matching_sweep, mask_sweep, threshold_grid, foreground_scores, image_polygons, named_images, replaced_annotations, absent_stems, dataset_assembly,
        seeded_split, label_lines, polygon_measures, request_states, request_lifecycle, correction_replay, point_overlay, point_validation, changed_counts, preserved_counts, session_progress, session_texts,
    )
}

_IOU = "greatest(least(a.\"right\", b.\"right\") - greatest(a.\"left\", b.\"left\"), 0) * greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0)"
_SIZE = '({0}."right" - {0}."left") * ({0}.bottom - {0}.top)'
_A, _B = _SIZE.format("a"), _SIZE.format("b")
_ANN = "ann AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ann) AS ann, category, iscrowd, CASE WHEN l_linenumber = 1 THEN 4 ELSE 8 END AS numbers FROM annotations)"


def _fit(k: int, rows: str) -> str:
    """CTEs of the k-th plane fit of each label's rows."""
    det = "xx*yy-xy*xy"
    return f"""f{k} AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {rows} GROUP BY label),
s{k} AS (SELECT p.label, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy, sum((y-my)*(y-my)) AS yy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(z-mz)) AS yz FROM {rows} p JOIN f{k} f ON f.label = p.label GROUP BY p.label),
a{k} AS (SELECT label, n, mx, my, mz, CASE WHEN n >= 3 AND abs({det}) > 1e-12 THEN (xz*yy-yz*xy)/({det}) END AS a, CASE WHEN n >= 3 AND abs({det}) > 1e-12 THEN (yz*xx-xz*xy)/({det}) END AS b FROM s{k}),
c{k} AS (SELECT label, n, mx, my, mz, a, b, mz - a*mx - b*my AS c FROM a{k})"""


def _trim(k: int, rows: str) -> str:
    """CTEs of the rows nearest to the k-th fit."""
    return f"""r{k} AS (SELECT p.*, c.n, row_number() OVER (PARTITION BY p.label ORDER BY round(abs(z - a*x - b*y - c), 12), point_id) AS place FROM {rows} p JOIN c{k} c ON c.label = p.label),
t{k} AS (SELECT * EXCLUDE (n, place) FROM r{k} WHERE place <= greatest(3, floor(n * 0.7e0)))"""


_PLANES = ",\n".join(["t AS (SELECT * REPLACE (z + 0.3e0 * x - 0.1e0 * y AS z) FROM points)", _fit(0, "t"), _trim(0, "t"), _fit(1, "t0"), _trim(1, "t0"), _fit(2, "t1"), _trim(2, "t1"), _fit(3, "t2")])
_SCALED = "CASE WHEN abs({0}) <= 1.5 THEN {0} * 640 ELSE {0} END"
_MOTION = "l AS (SELECT session_id, frame_id, ts, dark, bright, luma_std, lap, tx, ty, tz, qx, qy, qz, qw, lag(tx) OVER w AS ltx, lag(ty) OVER w AS lty, lag(tz) OVER w AS ltz, lag(qx) OVER w AS lqx, lag(qy) OVER w AS lqy, lag(qz) OVER w AS lqz, lag(qw) OVER w AS lqw FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY ts, frame_id)), o AS (SELECT session_id, frame_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS n, NOT (dark > 0.35e0 OR bright > 0.35e0) AND luma_std >= 18 AND lap >= 120 AND coalesce(sqrt((tx-ltx)*(tx-ltx)+(ty-lty)*(ty-lty)+(tz-ltz)*(tz-ltz)), 0) <= 0.03e0 AND coalesce(degrees(2 * acos(greatest(0.0, least(1.0, abs(qx*lqx+qy*lqy+qz*lqz+qw*lqw))))), 0) <= 8 AS ok FROM l)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {
    "frame_motion": with_views("frames", "l AS (SELECT session_id, frame_id, tx, ty, tz, qx, qy, qz, qw, lag(tx) OVER w AS ltx, lag(ty) OVER w AS lty, lag(tz) OVER w AS ltz, lag(qx) OVER w AS lqx, lag(qy) OVER w AS lqy, lag(qz) OVER w AS lqz, lag(qw) OVER w AS lqw FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY ts, frame_id)) SELECT session_id, frame_id, round(coalesce(sqrt((tx-ltx)*(tx-ltx)+(ty-lty)*(ty-lty)+(tz-ltz)*(tz-ltz)), 0), 6) + 0.0e0 AS move, round(coalesce(degrees(2 * acos(greatest(0.0, least(1.0, abs(qx*lqx+qy*lqy+qz*lqz+qw*lqw))))), 0), 4) + 0.0e0 AS turn FROM l"),
    "frame_reasons": with_views("frames", "SELECT frame_id, array_to_string(list_filter([CASE WHEN dark > 0.35e0 OR bright > 0.35e0 THEN 'exposure' END, CASE WHEN luma_std < 18 THEN 'contrast' END, CASE WHEN lap < 120 THEN 'blur' END], lambda x: x IS NOT NULL), ',') AS reasons FROM frames"),
    "frame_cadence": with_views("frames", "s AS (SELECT session_id, frame_id, ts, CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS start FROM frames) SELECT session_id, start, arg_min(frame_id, (ts, frame_id)) AS frame_id FROM s GROUP BY ALL"),
    "image_statistics": with_views("pixels", "l AS (SELECT *, lag(luma) OVER r AS w, lead(luma) OVER r AS e, lag(luma) OVER c AS n, lead(luma) OVER c AS s FROM pixels WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)), p AS (SELECT image_id, luma, coalesce(w, e) + coalesce(e, w) + coalesce(n, s) + coalesce(s, n) - 4 * luma AS lap FROM l) SELECT image_id, round(avg(luma), 6) AS mean, round(stddev_pop(luma), 6) AS deviation, round(avg(CASE WHEN luma <= 24 THEN 1.0 ELSE 0.0 END), 6) AS dark, round(avg(CASE WHEN luma >= 231 THEN 1.0 ELSE 0.0 END), 6) AS bright, round(var_pop(lap), 3) AS sharpness FROM p GROUP BY image_id"),
    "percentile_pixels": with_views("pixels", "q AS (SELECT image_id, quantile_cont(luma, 0.01) AS a, quantile_cont(luma, 0.998) AS b FROM pixels GROUP BY image_id), w AS (SELECT p.image_id, greatest(0.0, least(1.0, (luma - a) / greatest(b - a, 1e-6))) AS value FROM pixels p JOIN q USING (image_id)) SELECT image_id, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM w GROUP BY image_id"),
    "image_tiles": "SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(ceil(p_size * 100 / 1024.0) * ceil(p_size * 60 / 1024.0) AS BIGINT) AS tiles, CAST(ceil(p_size * 100 / 1024.0) - 1 AS BIGINT) AS tx, CAST(ceil(p_size * 60 / 1024.0) - 1 AS BIGINT) AS ty FROM part",
    "tile_stitching": with_views("pixels", "t AS (SELECT image_id, x, y, luma AS value FROM pixels UNION ALL SELECT image_id, x + 8, y, luma + 8 FROM pixels) SELECT image_id, x, y, round(avg(value), 6) AS value FROM t GROUP BY ALL"),
    "depth_decode": "WITH c AS (SELECT CAST(vec_id AS BIGINT) AS frame_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings), v AS (SELECT frame_id, pos, CAST(floor(abs(CAST(e AS FLOAT)) * 1e6::DOUBLE) AS BIGINT) % 65536 AS v FROM c) SELECT frame_id, sum(v & 8191)::BIGINT AS mm, sum(v >> 13)::BIGINT AS confidence, sum((v & 8191) * pos)::BIGINT AS moment FROM v GROUP BY frame_id",
    "depth_sampling": with_views("pixels", "c AS (SELECT image_id AS frame_id, x, y, CASE WHEN luma % 3 > 0 THEN luma * 10 ELSE 0 END AS mm, luma % 8 AS confidence FROM pixels), s AS (SELECT CAST(p_partkey AS BIGINT) AS frame_id, 1 AS sample_id, p_partkey % 16 AS sx, p_partkey * 7 % 16 AS sy FROM part), m AS (SELECT s.frame_id, sample_id, x, y, mm, confidence, max(confidence) OVER (PARTITION BY s.frame_id, sample_id) AS top FROM s JOIN c ON c.frame_id = s.frame_id AND mm > 0 AND x BETWEEN sx - 4 AND sx + 4 AND y BETWEEN sy - 4 AND sy + 4), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sample_id ORDER BY mm, x, y) AS place, count(*) OVER (PARTITION BY frame_id, sample_id) AS n FROM m WHERE confidence = top) SELECT frame_id, sample_id, x, y, mm, confidence FROM k WHERE place = floor(n / 2) + 1"),
    "pixel_channels": "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(p_partkey * 7919 % 16777216 AS BIGINT) AS k FROM part), c AS (SELECT image_id, (k >> 16) & 255 AS r, (k >> 8) & 255 AS g, k & 255 AS b FROM p) SELECT image_id, round(r / 255.0::DOUBLE, 6) AS red, round(g / 255.0::DOUBLE, 6) AS green, round(b / 255.0::DOUBLE, 6) AS blue, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luma FROM c",
    "zone_bounds": with_views("bars", "b AS (SELECT zone_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS \"by\", min(z) AS az, max(z) AS bz FROM bars GROUP BY zone_id), p AS (SELECT *, greatest(0.05, 0.1e0 * greatest(bx-ax, \"by\"-ay, bz-az)) AS pad FROM b) SELECT zone_id, round((ax+bx)/2, 6) AS cx, round((ay+\"by\")/2, 6) AS cy, round((az+bz)/2, 6) + 0.0e0 AS cz, round(ax-pad, 6) AS minx, round(ay-pad, 6) AS miny, round(az-pad, 6) AS minz, round(bx+pad, 6) AS maxx, round(\"by\"+pad, 6) AS maxy, round(bz+pad, 6) AS maxz FROM p"),
    "view_choice": with_views("boxes", f"v AS (SELECT image_id AS frame_id, det AS zone_id, \"left\", top, \"right\", bottom, det % 5 AS distance, score + 0.05e0 * (det % 7) AS coverage FROM boxes), k AS (SELECT a.* FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.frame_id = a.frame_id AND b.distance < a.distance AND {_IOU} > 0.2 * {_A})) SELECT frame_id, arg_max(zone_id, (coverage, -zone_id)) AS zone_id, round(max(coverage), 6) AS coverage FROM k WHERE zone_id * 13 % 90 < 75 AND coverage > 0.3 GROUP BY frame_id"),
    "outline_choice": with_views("boxes", f"v AS (SELECT image_id AS frame_id, det AS zone_id, \"left\", top, \"right\", bottom, det % 5 AS distance, score + 0.05e0 * (det % 7) AS coverage FROM boxes), k AS (SELECT a.* FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.frame_id = a.frame_id AND b.distance < a.distance AND {_IOU} > 0.2 * {_A})) SELECT frame_id, arg_max(zone_id, (coverage, -zone_id)) AS zone_id, round(max(coverage), 6) AS coverage FROM k WHERE zone_id * 13 % 90 < 75 AND coverage > 0.3 GROUP BY frame_id"),
    "guidance_radius": with_views("bars cams zones", "t AS (SELECT zone_id, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM bars GROUP BY zone_id), f AS (SELECT t.zone_id, round(sqrt((c.tx+s.cx-gx)*(c.tx+s.cx-gx)+(c.ty+s.cy-gy)*(c.ty+s.cy-gy)+(c.tz-gz)*(c.tz-gz)), 12) AS d FROM t JOIN zones s USING (zone_id) CROSS JOIN cams c), k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY d) AS place, count(*) OVER (PARTITION BY zone_id) AS n FROM f) SELECT t.zone_id, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz, round(greatest(0.6, least(3.5, d)), 6) AS radius FROM t JOIN k ON k.zone_id = t.zone_id AND place = floor(n / 2) + 1"),
    "box_pairs": with_views(
        "boxes",
        """r AS (SELECT image_id, "left" AS l, top AS t, "right" AS r, bottom AS b, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det) AS rank FROM boxes),
x AS (SELECT *, unnest(range(floor(l / 64)::BIGINT, floor(r / 64)::BIGINT + 1)) AS gx FROM r WHERE rank <= 10000),
g AS MATERIALIZED (SELECT *, unnest(range(floor(t / 64)::BIGINT, floor(b / 64)::BIGINT + 1)) AS gy FROM x),
j AS MATERIALIZED (SELECT a.image_id, a.rank AS winner, b.rank AS loser, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS sizes, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS meet FROM g a JOIN g b ON a.image_id = b.image_id AND a.gx = b.gx AND a.gy = b.gy)
SELECT DISTINCT image_id, winner, loser FROM j WHERE winner < loser AND meet / (sizes - meet) > 0.3""",
    ),
    "instance_counts": with_views("boxes truth", "t AS (SELECT image_id, count(*) AS t FROM truth GROUP BY ALL), p AS (SELECT image_id, count(*) AS p FROM boxes WHERE score >= 0.5 GROUP BY ALL), c AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM t FULL JOIN p USING (image_id)) SELECT round(sqrt(avg((p-t)*(p-t))), 6) AS rmse, round(avg(abs(p-t)), 6) AS mae, round(avg(abs(p-t) / greatest(t, 1)), 6) AS relative, round(avg(p-t), 6) + 0.0e0 AS signed, round(avg(t), 6) AS mean_true, round(avg(p), 6) AS mean_predicted FROM c"),
    "instance_overlaps": with_views("boxes truth", f"m AS (SELECT a.image_id, round({_IOU} / nullif({_A} + {_B} - {_IOU}, 0), 9) AS iou FROM truth a JOIN boxes b ON a.image_id = b.image_id) SELECT image_id, count(*) AS pairs, round(sum(iou), 6) AS iou, round(max(iou), 6) AS best FROM m WHERE iou > 0 GROUP BY image_id"),
    "mask_sweep": with_views("boxes truth", "ct AS (SELECT image_id, det, x, unnest(range(t, b)) AS y FROM (SELECT image_id, det, t, b, unnest(range(l, r)) AS x FROM (SELECT image_id, det, floor(\"left\" / 4)::BIGINT AS l, floor(top / 4)::BIGINT AS t, floor(\"right\" / 4)::BIGINT AS r, floor(bottom / 4)::BIGINT AS b FROM truth))), mt AS (SELECT image_id, x, y, max(det) AS label FROM ct GROUP BY ALL), nt AS (SELECT image_id, label, count(*) AS n FROM mt GROUP BY ALL), cp AS (SELECT image_id, det, x, unnest(range(t, b)) AS y FROM (SELECT image_id, det, t, b, unnest(range(l, r)) AS x FROM (SELECT image_id, det, floor(\"left\" / 4)::BIGINT AS l, floor(top / 4)::BIGINT AS t, floor(\"right\" / 4)::BIGINT AS r, floor(bottom / 4)::BIGINT AS b FROM boxes))), mp AS (SELECT image_id, x, y, max(det) AS label FROM cp GROUP BY ALL), np AS (SELECT image_id, label, count(*) AS n FROM mp GROUP BY ALL), o AS (SELECT image_id, mt.label AS t, mp.label AS p, count(*) AS pixels FROM mt JOIN mp USING (image_id, x, y) GROUP BY ALL), i AS (SELECT round(pixels / (nt.n + np.n - pixels), 9) AS iou FROM o JOIN nt ON nt.image_id = o.image_id AND nt.label = o.t JOIN np ON np.image_id = o.image_id AND np.label = o.p), g AS (SELECT unnest(range(11, 19)) / 20.0::DOUBLE AS threshold), f AS (SELECT threshold, count(*) FILTER (iou >= threshold) AS tp FROM g CROSS JOIN i GROUP BY threshold), r AS (SELECT threshold, tp, 2.0::DOUBLE * tp / ((SELECT count(*) FROM nt) + (SELECT count(*) FROM np)) AS f1 FROM f) SELECT round(threshold, 6) AS threshold, tp, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM r"),
    "foreground_scores": with_views("pixels", "SELECT round(count(*) FILTER (luma > 128) / count(*) FILTER (luma > 100), 6) AS iou, round(2.0 * count(*) FILTER (luma > 128) / (count(*) FILTER (luma > 128) + count(*) FILTER (luma > 100)), 6) AS dice FROM pixels"),
    "image_polygons": with_views("images annotations", _ANN + ", p AS (SELECT image_id, count(*) AS polygons, sum(numbers) AS numbers FROM ann WHERE iscrowd = 0 AND numbers >= 6 AND category IN ('A', 'N') GROUP BY ALL) SELECT id, file_name, coalesce(polygons, 0) AS polygons, coalesce(numbers, 0)::BIGINT AS numbers FROM images LEFT JOIN p ON id = image_id"),
    "named_images": with_views("images", "SELECT id, file_name FROM images WHERE id % 5 < 2"),
    "replaced_annotations": with_views("images annotations", _ANN + ", n AS (SELECT image_id, row_number() OVER (ORDER BY image_id, ann) + (SELECT max(ann) FROM ann) AS ann FROM ann WHERE image_id % 4 = 0 AND ann <= 2) SELECT image_id, ann, category, NULL::DOUBLE AS score FROM ann WHERE image_id % 4 <> 0 UNION ALL SELECT image_id, ann, 'new', 1.0::DOUBLE FROM n"),
    "absent_stems": with_views("images", "SELECT replace(file_name, '.png', '') AS stem FROM images WHERE id % 3 = 0"),
    "dataset_assembly": with_views("images", "SELECT 's ' || (id % 2)::VARCHAR AS subset, 'a/' || file_name AS path, 's_' || (id % 2)::VARCHAR || '__a__' || file_name AS target, true AS kept FROM images WHERE id % 7 <> 0"),
    "seeded_split": with_views("images", "k AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id::VARCHAR), id) AS place FROM images) SELECT id, CASE WHEN place <= 30 THEN 'test' WHEN place <= 60 THEN 'val' ELSE 'train' END AS split FROM k"),
    "label_lines": with_views("boxes", "SELECT image_id, det, printf('0 %.8f %.8f %.8f %.8f', (\"left\" + (\"right\" - \"left\" + 1) / 2) / 1000, (top + (bottom - top + 1) / 2) / 800, (\"right\" - \"left\" + 1) / 1000, (bottom - top + 1) / 800) AS line FROM boxes"),
    "polygon_measures": with_views("boxes", "w AS (SELECT *, \"right\" - \"left\" AS dx, bottom - top AS dy FROM boxes), c AS (SELECT *, greatest(dx - 5, 0) * greatest(dy - 3, 0) AS i FROM w) SELECT image_id, det, round(dx * dy, 6) AS area, 320 BETWEEN \"left\" AND \"right\" AS inside, round(i, 6) AS clipped, round(i / (dx * dy), 6) AS overlap, round(2 * (dx * dy - i) / (dx * dy), 6) AS difference, 32.0::DOUBLE AS star FROM c"),
    "request_states": with_views("requests", "c AS (SELECT session_id, zone_id, count(*) AS total, count(*) FILTER (state = 'QUEUED') AS queued, count(*) FILTER (state = 'PROCESSING') AS processing, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed FROM requests WHERE state <> 'DELETE' GROUP BY ALL) SELECT *, total || ' total: ' || queued || ' queued, ' || processing || ' processing, ' || completed || ' completed, ' || failed || ' failed' AS text FROM c"),
    "request_lifecycle": with_views("requests", "e AS (SELECT session_id, request_id % 40 AS request_id, request_id AS seq, ts, state FROM requests), g AS (SELECT session_id, request_id, min((ts, seq)) FILTER (state = 'DELETE') AS d, min((ts, seq)) FILTER (state IN ('PROCESSING', 'COMPLETED', 'FAILED')) AS b, arg_max(state, (ts, seq)) FILTER (state <> 'DELETE') AS working FROM e GROUP BY ALL) SELECT session_id, request_id, CASE WHEN d IS NOT NULL AND (b IS NULL OR d < b) THEN 'DELETED' ELSE working END AS state FROM g"),
    "point_overlay": with_views("points", "p AS (SELECT point_id % 9 AS session_id, point_id, label AS zone_id FROM points) SELECT session_id, point_id, CASE WHEN point_id % 7 = 0 THEN zone_id + 1 ELSE zone_id END AS zone_id FROM p WHERE point_id % 13 <> 0 UNION ALL SELECT session_id, point_id + 1000000, zone_id FROM p WHERE point_id % 50 = 0"),
    "point_validation": with_views("points point_zones", "SELECT point_id, CASE WHEN point_id % 17 = 0 THEN 'position' WHEN conf + CASE WHEN point_id % 5 = 0 THEN 0.5e0 ELSE 0 END > 1 THEN 'confidence' WHEN point_id % 3 = 0 AND label + 5 NOT IN (SELECT zone_id FROM point_zones) THEN 'zone' END AS reason FROM points"),
    "changed_counts": with_views("requests", "r AS (SELECT * FROM requests WHERE state <> 'DELETE'), n AS (SELECT session_id, zone_id, count(*) FILTER (state = 'FAILED') AS now FROM r GROUP BY ALL), b AS (SELECT session_id, zone_id, count(*) FILTER (state = 'FAILED') AS was FROM r WHERE request_id <= (SELECT max(request_id) / 2 FROM r) GROUP BY ALL) SELECT session_id, zone_id, was, now FROM b FULL JOIN n USING (session_id, zone_id) WHERE was IS DISTINCT FROM now"),
    "preserved_counts": with_views("requests", "SELECT request_id AS seq, first_value(CASE WHEN request_id % 3 = 0 THEN request_id END IGNORE NULLS) OVER (PARTITION BY session_id, zone_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS preserved FROM requests"),
    "session_progress": with_views("requests frames", "d AS (SELECT session_id, count(*) FILTER (state IN ('COMPLETED', 'FAILED')) AS finished FROM requests GROUP BY ALL), n AS (SELECT session_id, count(*) AS saved FROM frames WHERE event_type = 'click' GROUP BY ALL) SELECT session_id, saved, coalesce(finished, 0) AS finished, coalesce(finished, 0) >= saved AS complete FROM n LEFT JOIN d USING (session_id)"),
    "session_texts": with_views("requests", "r AS (SELECT session_id, zone_id, count(*) AS points FROM requests GROUP BY ALL) SELECT session_id, string_agg('zone ' || zone_id || ': ' || points || ' points' || CASE WHEN zone_id = 3 THEN ' (local ' || (points + 1) || ')' ELSE '' END, chr(10) ORDER BY zone_id) AS text FROM r GROUP BY session_id"),
    "frame_gate": _recursive(
        with_views(
            "frames",
            _MOTION
            + """, g AS (SELECT session_id, n, frame_id, us AS last, true AS accepted, NOT ok AS forced FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.frame_id, CASE WHEN o.ok OR o.us - g.last >= 86400000000 THEN o.us ELSE g.last END, o.ok OR o.us - g.last >= 86400000000, NOT o.ok AND o.us - g.last >= 86400000000 FROM g JOIN o ON o.session_id = g.session_id AND o.n = g.n + 1)
SELECT session_id, frame_id, accepted, forced FROM g""",
        )
    ),
    "zone_planes": with_views("points", _PLANES + ", w AS (SELECT *, sqrt(a*a+b*b+1) AS s, CASE WHEN label % 2 = 0 THEN 9.0e0 ELSE -9.0e0 END AS tz FROM c3), f AS (SELECT *, CASE WHEN (a*mx + b*my + tz - mz) < 0 THEN -1 ELSE 1 END AS side FROM w)\nSELECT label, n, round(a, 4) + 0.0e0 AS a, round(b, 4) + 0.0e0 AS b, round(c, 4) + 0.0e0 AS c, round(mx, 4) + 0.0e0 AS mx, round(my, 4) + 0.0e0 AS my, round(mz, 4) + 0.0e0 AS mz, round(-a/s*side, 4) + 0.0e0 AS nx, round(-b/s*side, 4) + 0.0e0 AS ny, round(side/s, 4) + 0.0e0 AS nz, CASE WHEN n < 3 THEN 'too few points' WHEN a IS NULL THEN 'singular' END AS reason FROM f"),
    "box_suppression": _recursive(
        with_views(
            "boxes",
            """r AS (SELECT image_id, det, score, "left" AS l, top AS t, "right" AS r, bottom AS b, ("right" - "left") * (bottom - top) AS size, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det) AS rank FROM boxes),
g AS (SELECT image_id, rank, det, score, [{'l': l, 't': t, 'r': r, 'b': b, 'size': size}] AS kept, true AS stays FROM r WHERE rank = 1
  UNION ALL SELECT image_id, rank, det, score, CASE WHEN hit THEN kept ELSE list_append(kept, {'l': l, 't': t, 'r': r, 'b': b, 'size': size}) END, NOT hit
  FROM (SELECT r.*, g.kept, len(list_filter(g.kept, lambda k: greatest(least(k.r, r.r) - greatest(k.l, r.l), 0) * greatest(least(k.b, r.b) - greatest(k.t, r.t), 0) > 0.3e0 * (k.size + r.size - greatest(least(k.r, r.r) - greatest(k.l, r.l), 0) * greatest(least(k.b, r.b) - greatest(k.t, r.t), 0)))) > 0 AS hit FROM g JOIN r ON r.image_id = g.image_id AND r.rank = g.rank + 1))
SELECT image_id, det, score FROM g WHERE stays""",
        )
    ),
    "tensor_decode": "WITH e AS (SELECT (vec_id % 50)::BIGINT AS image_id, vec_id::BIGINT AS det, embedding[5]::DOUBLE AS score, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) AS w, abs(embedding[4]::DOUBLE) AS h FROM embeddings), d AS (SELECT image_id, det, score, " + ", ".join(_SCALED.format(c) + f" AS {c}" for c in "xywh") + " FROM e WHERE score >= 0.05e0) SELECT image_id, det, round(score, 6) + 0.0e0 AS score, round(greatest(0, least(x - w / 2, 640)), 3) AS \"left\", round(greatest(0, least(y - h / 2, 640)), 3) AS top, round(greatest(0, least(x + w / 2, 640)), 3) AS \"right\", round(greatest(0, least(y + h / 2, 640)), 3) AS bottom FROM d",
    "mask_mixing": "WITH d AS (SELECT (vec_id % 50)::BIGINT AS image_id, vec_id::BIGINT AS det, embedding[6:37] AS c, vec_id % 3 AS l, vec_id % 2 AS t FROM embeddings), p AS (SELECT (vec_id % 50)::BIGINT AS image_id, (vec_id // 50)::INT AS x, (vec_id % 7)::INT AS y, embedding[30:61] AS p FROM embeddings) SELECT d.image_id, det, y, x FROM d JOIN p ON p.image_id = d.image_id AND x BETWEEN l AND l + 3 AND y BETWEEN t AND t + 4 WHERE list_sum(list_transform(list_zip(c, p), lambda v: (v[1] * v[2])::DOUBLE)) >= 0",
    "correction_replay": with_views(
        "frames",
        """e AS (SELECT session_id, frame_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rotate' WHEN 'purchase' THEN CASE WHEN frame_id % 11 = 0 THEN 'reset' ELSE 'delete_zone' END ELSE 'add' END AS op, frame_id % 23 AS k, frame_id % 4 AS q FROM frames),
v AS (SELECT session_id, seq, op, CASE WHEN op IN ('add', 'delete', 'rotate') THEN k END AS point_id, CASE WHEN op = 'delete_zone' OR op = 'add' AND seq % 3 <> 0 THEN q END AS zone_id FROM e),
a AS (SELECT v.* FROM v LEFT JOIN (SELECT session_id, max(seq) AS reset FROM v WHERE op = 'reset' GROUP BY session_id) r USING (session_id) WHERE reset IS NULL OR seq > reset),
p AS (SELECT session_id, point_id, max(seq) FILTER (op = 'delete') AS deleted, max(seq) FILTER (op = 'add') AS added FROM a WHERE point_id IS NOT NULL GROUP BY ALL),
l AS (SELECT p.*, a.zone_id AS asked, [(p.point_id + n * 3) % 4 for n in range(0, 4)] AS zones,
  [0] || coalesce((SELECT list(t.seq ORDER BY t.seq) FROM a t WHERE t.session_id = p.session_id AND t.point_id = p.point_id AND t.op = 'rotate' AND t.seq > p.added), []) AS turns FROM p JOIN a ON a.session_id = p.session_id AND a.seq = p.added WHERE deleted IS NULL OR added > deleted),
m AS (SELECT *, coalesce(asked, zones[1]) AS start, coalesce(list_position(zones, coalesce(asked, zones[1])), 0) AS place FROM l),
k AS (SELECT *, unnest(range(0, len(turns))) AS k FROM m),
o AS (SELECT session_id, point_id, CASE WHEN k = 0 THEN start WHEN place = 0 THEN zones[(k - 1) % 4 + 1] ELSE zones[(place - 1 + k) % 4 + 1] END AS zone_id, CASE WHEN k = 0 THEN added ELSE turns[k + 1] END AS since, CASE WHEN k + 1 < len(turns) THEN turns[k + 2] END AS until FROM k),
g AS (SELECT DISTINCT o.session_id, o.point_id FROM o JOIN a ON a.session_id = o.session_id AND a.op = 'delete_zone' AND a.zone_id = o.zone_id AND a.seq > since AND (until IS NULL OR a.seq < until))
SELECT session_id, point_id, zone_id FROM o WHERE until IS NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.session_id = o.session_id AND g.point_id = o.point_id)""",
    ),
    "rasterised": with_views("boxes", "r AS (SELECT image_id, det, unnest(range(floor(\"left\" / 4)::BIGINT, floor(\"right\" / 4)::BIGINT)) AS x, floor(top / 4)::BIGINT AS top, floor(bottom / 4)::BIGINT AS bottom FROM boxes), c AS (SELECT image_id, det, x, unnest(range(top, bottom)) AS y FROM r), m AS (SELECT image_id, x, y, max(det) AS label FROM c GROUP BY ALL) SELECT image_id, label, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS area FROM m GROUP BY image_id, label"),
}
