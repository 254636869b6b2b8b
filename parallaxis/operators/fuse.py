"""Multi-view fusion: rays of observations, their pairs over frames, and support edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import vec as v

SIDE = ("frame_id", "det_id", "conf", "ox", "oy", "oz", "dx", "dy", "dz")


def trim_weak(observations: DataFrame, least: float = 0.15, share: int = 10) -> DataFrame:
    """Observations without, in each frame, the floor(n / share) weakest of them that are below least; ties by det_id. Small frames stay whole."""
    frame = Window.partitionBy("zone_id", "frame_id")
    ranked = observations.withColumn("weak_rank", F.row_number().over(frame.orderBy("conf", "det_id"))).withColumn("n", F.count("*").over(frame))
    return ranked.filter((F.col("conf") >= least) | (F.col("weak_rank") > F.floor(F.col("n") / share))).drop("weak_rank", "n")


def with_rays(observations: DataFrame, focal: float = 800.0, cx: float = 320.0, cy: float = 240.0) -> DataFrame:
    """Observations (px, py) of unrotated cameras with the direction dx, dy, dz of their rays."""
    d = v.pixel_ray((F.col("px") - cx) / focal, (F.col("py") - cy) / focal)
    return v.settled(observations, {"d" + n: c for c, n in zip(d, "xyz")})


#: Ranks below these are compared always, and by a draw of one half; later ones by one of a quarter.
ALWAYS, HALF = 10, 20


def is_compared(rank: int, first: int, second: int, always: int = ALWAYS, half: int = HALF) -> bool:
    """frame_pairs' choice for one pair of frames."""
    draw = (first * 7919 + second * 104729) % 1009 / 1009.0
    return rank < always or draw < (0.5 if rank < half else 0.25)


def frame_pairs(frames: DataFrame, always: int = ALWAYS, half: int = HALF, within: str = "session_id") -> DataFrame:
    """first_frame, second_frame, quality: each frame with the earlier ones (by seq) that it is compared with.

    Earlier frames are ranked by difference; the best are always taken, later
    ranks by a hash of the two, so that reruns agree. frames: session_id,
    frame_id, seq, tx, ty, tz, fx, fy, fz (translation and viewing direction);
    frames of different sessions are not compared.
    """
    a = frames.select(*(F.col(c).alias("a_" + c) for c in frames.columns))
    b = frames.select(*(F.col(c).alias("b_" + c) for c in frames.columns))
    quality = v.frame_difference(v.vec("a_t"), v.vec("a_f"), v.vec("b_t"), v.vec("b_f"))
    pairs = a.join(b, (F.col("a_" + within) == F.col("b_" + within)) & (F.col("a_seq") < F.col("b_seq"))).withColumn("quality", F.round(quality, 9))
    rank = F.row_number().over(Window.partitionBy("b_" + within, "b_frame_id").orderBy(F.desc("quality"), "a_seq")) - 1
    draw = F.pmod(F.col("a_frame_id") * 7919 + F.col("b_frame_id") * 104729, F.lit(1009)) / 1009.0
    kept = pairs.withColumn("rank", rank).filter((F.col("rank") < always) | ((F.col("rank") < half) & (draw < 0.5)) | ((F.col("rank") >= half) & (draw < 0.25)))
    return kept.select(F.col("a_frame_id").alias("first_frame"), F.col("b_frame_id").alias("second_frame"), "quality", "rank")


def with_sizes(rays: DataFrame) -> DataFrame:
    """Rays with n, the observations of their frame in the zone, and frames, those of the zone: ray_candidates hands them on, so that candidates need no join for them."""
    frames = rays.groupBy("zone_id").agg(F.count_distinct("frame_id").alias("frames"))
    return rays.withColumn("n", F.count("*").over(Window.partitionBy("zone_id", "frame_id"))).join(frames, "zone_id")


def ray_candidates(rays: DataFrame, pairs: DataFrame, epsilon: float = 0.05, most: float = 0.1) -> DataFrame:
    """Pairs of observations of compared frames of a zone whose rays pass within `most`.

    Columns: zone_id, a_*, b_* of the sides, distance, x, y, z (mid-point),
    distance_conf, angle_conf; with_sizes' rays add a_n, b_n and frames. The
    zone is the join key; the frame pairs are a second equi-condition, so no
    side meets all of the other.
    """
    sized = {"n", "frames"} <= set(rays.columns)
    side = (*SIDE, "n") if sized else SIDE
    a = rays.select("zone_id", *(F.col(c).alias("a_" + c) for c in side), *(["frames"] if sized else []))
    b = rays.select("zone_id", *(F.col(c).alias("b_" + c) for c in side))
    near = pairs.select(F.col("first_frame").alias("a_frame_id"), F.col("second_frame").alias("b_frame_id"))
    met = a.join(near, "a_frame_id").join(b, ["zone_id", "b_frame_id"])
    o1, d1, o2, d2 = (v.vec(p) for p in ("a_o", "a_d", "b_o", "b_d"))
    met = v.closest_approach(met)
    met = v.settled(met, {side + n: c for side, o, d, t in (("p", o1, d1, "t1"), ("q", o2, d2, "t2")) for n, c in zip("xyz", v.add(o, v.scale(d, F.col(t))))})
    p, q = v.vec("p"), v.vec("q")
    met = v.settled(met, {"distance": v.length(v.sub(p, q))}).filter(F.col("distance") <= most)
    met = v.settled(met, {**{n: c for n, c in zip("xyz", v.scale(v.add(p, q), 0.5))}, "distance_conf": v.distance_confidence(F.col("distance"), epsilon), "angle_conf": v.angle_confidence(d1, d2)})
    return met.drop("t1", "t2", *(s + n for s in "pq" for n in "xyz"))


def mark_ambiguous(candidates: DataFrame, observations: DataFrame, epsilon: float | Column = 0.05) -> DataFrame:
    """Candidates with a_ignored, b_ignored: in a frame pair, an observation with more supporting partners than the root of the other frame's observations, rounded up.

    The candidates of sized rays (fuse.with_sizes) bring the observations of frames; those of others are joined to them.
    """
    sizes = observations.groupBy("zone_id", "frame_id").agg(F.count("*").alias("n"))
    support = F.count_if(F.col("distance") <= epsilon)
    pair = ("zone_id", "a_frame_id", "b_frame_id")
    c = candidates.withColumn("a_support", support.over(Window.partitionBy(*pair, "a_det_id"))).withColumn("b_support", support.over(Window.partitionBy(*pair, "b_det_id")))
    if "a_n" not in c.columns:
        c = c.join(sizes.select("zone_id", F.col("frame_id").alias("b_frame_id"), F.col("n").alias("b_n")), ["zone_id", "b_frame_id"])
        c = c.join(sizes.select("zone_id", F.col("frame_id").alias("a_frame_id"), F.col("n").alias("a_n")), ["zone_id", "a_frame_id"])
    return c.withColumn("a_ignored", F.col("a_support") > F.ceil(F.sqrt("b_n"))).withColumn("b_ignored", F.col("b_support") > F.ceil(F.sqrt("a_n"))).drop("a_support", "b_support", "a_n", "b_n")


def support_edges(marked: DataFrame, boxes: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """Edges of unambiguous candidates within epsilon whose mid-point lies in the zone's box, with confidence."""
    kept = marked.filter(~F.col("a_ignored") & ~F.col("b_ignored") & (F.col("distance") <= epsilon)).join(boxes, "zone_id")
    kept = kept.filter(v.inside(v.vec(""), v.box()))
    conf = F.col("a_conf") * F.col("b_conf") * F.col("distance_conf") * F.col("angle_conf")
    return kept.select("zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id", "distance", "x", "y", "z", conf.alias("conf"))


def forbidden_edges(rays: DataFrame, pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs of observations that were compared, are no candidates, and of which neither was ignored as ambiguous for the other's frame."""
    a = rays.select("zone_id", F.col("frame_id").alias("a_frame_id"), F.col("det_id").alias("a_det_id"))
    b = rays.select("zone_id", F.col("frame_id").alias("b_frame_id"), F.col("det_id").alias("b_det_id"))
    near = pairs.select(F.col("first_frame").alias("a_frame_id"), F.col("second_frame").alias("b_frame_id"))
    compared = a.join(near, "a_frame_id").join(b, ["zone_id", "b_frame_id"])
    frames = ["zone_id", "a_frame_id", "b_frame_id"]
    out = compared.join(marked.select(*frames, "a_det_id", "b_det_id"), [*frames, "a_det_id", "b_det_id"], "left_anti")
    for side in "ab":
        out = out.join(marked.filter(f"{side}_ignored").select(*frames, f"{side}_det_id").distinct(), [*frames, f"{side}_det_id"], "left_anti")
    return out


def frame_consistency(edges: DataFrame, observations: DataFrame, warm_up: int = 3) -> DataFrame:
    """For each frame of a zone: observations, those with an edge to an earlier frame, and whether more than three tenths have none, after warm_up frames."""
    n = observations.groupBy("zone_id", "frame_id").agg(F.count("*").alias("n"))
    with_edge = edges.groupBy("zone_id", F.col("b_frame_id").alias("frame_id")).agg(F.count_distinct("b_det_id").alias("supported"))
    out = n.join(with_edge, ["zone_id", "frame_id"], "left").fillna(0, ["supported"])
    order = F.row_number().over(Window.partitionBy("zone_id").orderBy("frame_id")) - 1
    rejected = (order >= warm_up) & ((F.col("n") - F.col("supported")) * 10 > F.col("n") * 3)
    return out.withColumn("rejected", rejected)


def components_on_rays(rays: DataFrame, components: DataFrame, members: DataFrame, radius: float = 0.03) -> DataFrame:
    """For each observation the components within radius of its ray that don't have its frame, nearest first.

    components: zone_id, component_id, x, y, z; members: component_id, frame_id.
    """
    near = rays.join(components, "zone_id").join(members.select("component_id", "frame_id"), ["component_id", "frame_id"], "left_anti")
    near = near.withColumns({"v" + n: c for n, c in zip("xyz", v.sub(v.vec(""), v.vec("o")))})
    near = near.withColumn("t", v.dot(v.vec("v"), v.vec("d")))
    near = near.withColumn("distance", F.when(F.col("t") <= 0, v.length(v.vec("v"))).otherwise(v.length(v.sub(v.vec("v"), v.scale(v.vec("d"), F.col("t")))))).filter(F.col("distance") <= radius)
    rank = F.row_number().over(Window.partitionBy("zone_id", "frame_id", "det_id").orderBy("distance", "component_id"))
    return near.select("zone_id", "frame_id", "det_id", "component_id", "distance", rank.alias("rank"))
