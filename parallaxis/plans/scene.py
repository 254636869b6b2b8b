"""Queries over the scene of objects in zones: rays to points to zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis.functions import vec as v
from parallaxis.operators import assign, fuse, resolve, rounds, triangulate, zones
from parallaxis.plans.fixtures import view, with_views

BOX = ("minx", "maxx", "miny", "maxy", "minz", "maxz")


def _rays(spark: SparkSession, d: str) -> DataFrame:
    return fuse.with_rays(fuse.trim_weak(view(spark, d, "obs")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return fuse.frame_pairs(view(spark, d, "cams").withColumn("session_id", F.lit(0)))  # one session, whose frames see all zones


def _marked(spark: SparkSession, d: str) -> DataFrame:
    rays = _rays(spark, d)
    return fuse.mark_ambiguous(fuse.ray_candidates(rays, _pairs(spark, d)), rays)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return fuse.support_edges(_marked(spark, d), view(spark, d, "zones").select("zone_id", *BOX))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def rays(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rays(spark, d).select("zone_id", "frame_id", "det_id", "dx", "dy", "dz"), "dx", "dy", "dz")


def weak_trim(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").withColumn("conf", F.when((F.col("det_id") + F.col("frame_id")) % 9 == 0, F.col("conf") - 0.6).otherwise(F.col("conf")))
    return _rounded(fuse.trim_weak(o).select("zone_id", "frame_id", "det_id", "conf"), "conf")


def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_pairs(spark, d), "quality")


def ray_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = fuse.ray_candidates(_rays(spark, d), _pairs(spark, d))
    return _rounded(c.groupBy("zone_id", "a_frame_id", "b_frame_id").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"), F.sum("distance_conf").alias("distance_conf"), F.sum("angle_conf").alias("angle_conf"), F.sum("x").alias("x")), "distance", "distance_conf", "angle_conf", "x")


def support_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_edges(spark, d), "distance", "x", "y", "z", "conf")


def ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).groupBy("zone_id").agg(F.count_if("a_ignored").alias("a_ignored"), F.count_if("b_ignored").alias("b_ignored"), F.count("*").alias("n"))


def forbidden(spark: SparkSession, d: str) -> DataFrame:
    return fuse.forbidden_edges(_rays(spark, d), _pairs(spark, d), _marked(spark, d)).groupBy("zone_id").agg(F.count("*").alias("n"), F.sum(F.col("a_det_id") * 31 + F.col("b_det_id")).alias("checksum"))


def frame_consistency(spark: SparkSession, d: str) -> DataFrame:
    return fuse.frame_consistency(_edges(spark, d), _rays(spark, d))


def dynamic_thresholds(spark: SparkSession, d: str) -> DataFrame:
    frames = view(spark, d, "frames")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "frame_id"))
    t = v.thresholds(F.col("accepted"))
    out = frames.select("session_id", "frame_id", n.alias("accepted"))
    return out.select("session_id", "frame_id", "accepted", *(F.round(c, 6).alias(k) for k, c in t.items()))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Members of components, zone by zone and frame by frame."""
    rays, pairs = _rays(spark, d), _pairs(spark, d)
    return triangulate.count_objects(rays, pairs, fuse.ray_candidates(rays, pairs), view(spark, d, "zones").select("zone_id", *BOX))


def _by_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Members of components, all zones at once."""
    rays, pairs = fuse.with_sizes(_rays(spark, d)), _pairs(spark, d)
    return rounds.count_objects(rays, pairs, fuse.ray_candidates(rays, pairs), view(spark, d, "zones").select("zone_id", *BOX))


def resolved_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of each zone, how many of them have observations of one object alone, and how many objects they are of."""
    return _purity(_components(spark, d))


def rounds_components(spark: SparkSession, d: str) -> DataFrame:
    """The same of the components that rounds of joins find."""
    return _purity(_by_rounds(spark, d))


def _purity(components: DataFrame) -> DataFrame:
    c = components.groupBy("zone_id", "component_id").agg(F.min("det_id").alias("low"), F.max("det_id").alias("high"), F.count("*").alias("members"), F.count_distinct("frame_id").alias("frames"))
    return c.groupBy("zone_id").agg(F.count("*").alias("components"), F.count_if((F.col("low") == F.col("high")) & (F.col("members") == F.col("frames"))).alias("pure"), F.count_distinct("low").alias("objects"))


def points_per_zone(spark: SparkSession, d: str) -> DataFrame:
    """Objects counted in each zone, with zones without points as zero."""
    points = _by_rounds(spark, d).groupBy("zone_id", "component_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    points = points.withColumn("point_id", F.concat_ws(":", "zone_id", "component_id")).drop("zone_id")
    zones = view(spark, d, "zones")
    counted = assign.nearest_zone(points, zones).groupBy("zone_id").agg(F.count("*").alias("points"))
    return zones.select("zone_id").join(counted, "zone_id", "left").fillna(0, ["points"])


def components_on_rays(spark: SparkSession, d: str) -> DataFrame:
    bars = view(spark, d, "bars").filter("bar_id % 2 = 0").select("zone_id", F.col("bar_id").alias("component_id"), "x", "y", "z")
    members = view(spark, d, "bars").join(view(spark, d, "cams").select("frame_id").filter("frame_id < 5")).select(F.col("bar_id").alias("component_id"), "frame_id")
    return _rounded(fuse.components_on_rays(_rays(spark, d), bars, members).groupBy("zone_id", "frame_id").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"), F.max("rank").alias("most")), "distance")


def true_components(spark: SparkSession, d: str) -> DataFrame:
    """Centre, confidence and validity of the edges of one object each."""
    e = _edges(spark, d).filter("a_det_id = b_det_id")
    c = resolve.component_summary(e, "zone_id", "a_det_id").withColumn("valid", resolve.is_valid())
    return _rounded(c, "x", "y", "z", "confidence", "confidence_norm")


def near_components(spark: SparkSession, d: str) -> DataFrame:
    points = view(spark, d, "bars").withColumn("x", F.col("x") - F.col("zone_id") * 4.0)
    return _rounded(resolve.near_pairs(points, "bar_id", 0.1), "distance")


def largest_frames(spark: SparkSession, d: str) -> DataFrame:
    return resolve.largest_frame(view(spark, d, "obs"), "zone_id")


def free_edge_pool(spark: SparkSession, d: str) -> DataFrame:
    e = _rounded(_edges(spark, d), "conf").withColumn("generation", F.col("b_frame_id")).withColumn("edge_id", F.struct("a_frame_id", "a_det_id", "b_frame_id", "b_det_id"))
    return _rounded(resolve.retained(e, "zone_id", most=200).select("zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id", "priority"), "priority")


def unused_edges(spark: SparkSession, d: str) -> DataFrame:
    used = view(spark, d, "obs").filter("det_id % 3 = 0")
    out = resolve.free_edges(_edges(spark, d), used)
    return out.select("zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id")


def zone_overlaps(spark: SparkSession, d: str) -> DataFrame:
    z = view(spark, d, "zones").select("zone_id", *BOX)
    moved = z.withColumns({"minx": F.col("minx") - 2.0, "maxx": F.col("maxx") - 2.0})
    return _rounded(zones.overlapping_zones(z, moved, least=0.1).filter("zone_id < other_id"), "overlap")


def surplus_components(spark: SparkSession, d: str) -> DataFrame:
    """The weakest of each zone's components beyond the most observations of a frame."""
    c = view(spark, d, "bars").select("zone_id", F.col("bar_id").alias("component_id"), (F.col("bar_id") * 7 % 10 / 10.0).alias("confidence"))
    return resolve.surplus(c, resolve.largest_frame(view(spark, d, "obs"), "zone_id"), "zone_id").select("zone_id", "component_id", "confidence")


def released_edges(spark: SparkSession, d: str) -> DataFrame:
    """New edges and those that dissolved components release, each once."""
    e = _edges(spark, d).select("zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id")
    return resolve.with_released(e.filter("a_det_id % 2 = 0"), e.filter("b_det_id % 3 = 0"))


def zone_of_point(spark: SparkSession, d: str) -> DataFrame:
    return assign.nearest_zone(view(spark, d, "points"), view(spark, d, "point_zones"))


def four_nearest_zones(spark: SparkSession, d: str) -> DataFrame:
    return assign.four_nearest(view(spark, d, "points"), view(spark, d, "point_zones")).select("point_id", "zone_id", "rank")


def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "points").withColumnRenamed("label", "scene")
    return _rounded(assign.kernel_edges(assign.nearest_neighbours(p, "scene"), p, "scene"), "distance", "weight")


def zones_by_propagation(spark: SparkSession, d: str) -> DataFrame:
    return assign.propagate(view(spark, d, "points").withColumn("scene", F.lit(1)), view(spark, d, "point_zones"), "scene")


def frame_views(spark: SparkSession, d: str) -> DataFrame:
    """Angle and distance of each camera to each zone's plane, whether the view is good, and how similar it is to the one before."""
    z, c = view(spark, d, "zones"), view(spark, d, "cams").select("frame_id", "tx", "ty", "tz")
    met = z.crossJoin(F.broadcast(c))
    to = v.sub((F.col("tx") + F.col("cx"), F.col("ty") + F.col("cy"), F.col("tz")), v.vec("c"))
    met = met.withColumn("angle", F.round(v.angle_degrees(to, (F.lit(0.0), F.lit(0.0), F.lit(1.0))), 6)).withColumn("distance", F.round(v.length(to), 6))
    w = Window.partitionBy("zone_id").orderBy("frame_id")
    shift = F.sqrt(F.pow(F.col("tx") - F.lag("tx").over(w), 2) + F.pow(F.col("ty") - F.lag("ty").over(w), 2))
    delta = F.abs(F.col("angle") - F.lag("angle").over(w)) / 15.0 + shift / ((F.col("distance") + F.lag("distance").over(w)) / 2) / 0.1
    return met.select("zone_id", "frame_id", "angle", "distance", (F.col("angle") < 75).alias("good"), F.round(delta, 6).alias("delta"))


QUERIES = {f.__name__: f for f in (rays, weak_trim, frame_pairs, ray_candidates, support_edges, ambiguous, forbidden, frame_consistency, dynamic_thresholds, resolved_components, rounds_components, points_per_zone, components_on_rays, true_components, near_components, largest_frames, free_edge_pool, unused_edges, surplus_components, released_edges, zone_overlaps, zone_of_point, four_nearest_zones, neighbour_graph, zones_by_propagation, frame_views)}

_RAYS = """rays AS (SELECT zone_id, frame_id, det_id, conf, ox, oy, oz, ux / n AS dx, uy / n AS dy, -1.0e0 / n AS dz FROM
  (SELECT *, sqrt(ux * ux + uy * uy + 1.0e0) AS n FROM (SELECT *, -((px - 320.0e0) / 800.0e0) AS ux, -((py - 240.0e0) / 800.0e0) AS uy FROM obs)))"""
_PAIRS = """ranked AS (SELECT a.frame_id AS a_id, b.frame_id AS b_id, a.seq AS a_seq, round(sqrt((a.tx-b.tx)*(a.tx-b.tx)+(a.ty-b.ty)*(a.ty-b.ty)+(a.tz-b.tz)*(a.tz-b.tz)), 9) AS quality FROM cams a JOIN cams b ON a.seq < b.seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY quality DESC, a_seq) - 1 AS rank, ((a_id * 7919 + b_id * 104729) % 1009) / 1009.0e0 AS draw FROM ranked),
pairs AS (SELECT a_id AS first_frame, b_id AS second_frame, quality, rank FROM placed WHERE rank < 10 OR (rank < 20 AND draw < 0.5) OR (rank >= 20 AND draw < 0.25))"""
_CAND = """met AS (SELECT a.zone_id, a.frame_id AS a_frame_id, b.frame_id AS b_frame_id, a.det_id AS a_det_id, b.det_id AS b_det_id, a.conf AS a_conf, b.conf AS b_conf,
  a.ox AS o1x, a.oy AS o1y, a.oz AS o1z, b.ox AS o2x, b.oy AS o2y, b.oz AS o2z, a.dx AS d1x, a.dy AS d1y, a.dz AS d1z, b.dx AS d2x, b.dy AS d2y, b.dz AS d2z,
  a.dx*a.dx+a.dy*a.dy+a.dz*a.dz AS qa, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz AS qb, b.dx*b.dx+b.dy*b.dy+b.dz*b.dz AS qc,
  a.dx*(a.ox-b.ox)+a.dy*(a.oy-b.oy)+a.dz*(a.oz-b.oz) AS qd, b.dx*(a.ox-b.ox)+b.dy*(a.oy-b.oy)+b.dz*(a.oz-b.oz) AS qe
  FROM rays a JOIN pairs p ON a.frame_id = p.first_frame JOIN rays b ON b.zone_id = a.zone_id AND b.frame_id = p.second_frame),
solved AS (SELECT *, (qb*qe - qc*qd) / (qa*qc - qb*qb) AS t1, (qa*qe - qb*qd) / (qa*qc - qb*qb) AS t2 FROM met WHERE abs(qa*qc - qb*qb) > 1e-6),
ends AS (SELECT *, o1x+d1x*t1 AS p1x, o1y+d1y*t1 AS p1y, o1z+d1z*t1 AS p1z, o2x+d2x*t2 AS p2x, o2y+d2y*t2 AS p2y, o2z+d2z*t2 AS p2z FROM solved WHERE t1 > 0.1 AND t1 < 10 AND t2 > 0.1 AND t2 < 10),
cand0 AS (SELECT *, sqrt((p1x-p2x)*(p1x-p2x)+(p1y-p2y)*(p1y-p2y)+(p1z-p2z)*(p1z-p2z)) AS distance, (p1x+p2x)*0.5 AS x, (p1y+p2y)*0.5 AS y, (p1z+p2z)*0.5 AS z,
  greatest(0.0, least(1.0, 2.0 * sqrt((d1y*d2z-d1z*d2y)*(d1y*d2z-d1z*d2y)+(d1z*d2x-d1x*d2z)*(d1z*d2x-d1x*d2z)+(d1x*d2y-d1y*d2x)*(d1x*d2y-d1y*d2x)))) AS angle_conf FROM ends),
cand AS (SELECT *, greatest(0.0, least(1.0, (1.0 - distance / 0.05) * 2.5)) AS distance_conf FROM cand0 WHERE distance <= 0.1)"""
_MARK = """sizes AS (SELECT zone_id, frame_id, count(*) AS n FROM obs GROUP BY ALL),
counted AS (SELECT *, count(*) FILTER (distance <= 0.05) OVER (PARTITION BY zone_id, a_frame_id, b_frame_id, a_det_id) AS a_support, count(*) FILTER (distance <= 0.05) OVER (PARTITION BY zone_id, a_frame_id, b_frame_id, b_det_id) AS b_support FROM cand),
marked AS (SELECT c.*, a_support > ceil(sqrt(sb.n)) AS a_ignored, b_support > ceil(sqrt(sa.n)) AS b_ignored FROM counted c JOIN sizes sa ON sa.zone_id = c.zone_id AND sa.frame_id = c.a_frame_id JOIN sizes sb ON sb.zone_id = c.zone_id AND sb.frame_id = c.b_frame_id)"""
_EDGES = """edges AS (SELECT m.zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id, distance, x, y, z, a_conf * b_conf * distance_conf * angle_conf AS conf
  FROM marked m JOIN zones s ON m.zone_id = s.zone_id WHERE NOT a_ignored AND NOT b_ignored AND distance <= 0.05 AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy AND z BETWEEN minz AND maxz)"""
_TO_EDGES = ",\n".join((_RAYS, _PAIRS, _CAND, _MARK, _EDGES))
_NEAR = """far AS (SELECT p.point_id, s.zone_id, round((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), 12) AS d2 FROM points p CROSS JOIN point_zones s),
near AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, zone_id) AS rank FROM far)"""

ORACLE = {
    "rays": with_views("obs", _RAYS + " SELECT zone_id, frame_id, det_id, round(dx, 6) + 0.0e0 AS dx, round(dy, 6) + 0.0e0 AS dy, round(dz, 6) + 0.0e0 AS dz FROM rays"),
    "weak_trim": with_views(
        "obs",
        """w AS (SELECT zone_id, frame_id, det_id, CASE WHEN (det_id + frame_id) % 9 = 0 THEN conf - 0.6e0 ELSE conf END AS conf FROM obs),
r AS (SELECT *, row_number() OVER (PARTITION BY zone_id, frame_id ORDER BY conf, det_id) AS k, count(*) OVER (PARTITION BY zone_id, frame_id) AS n FROM w)
SELECT zone_id, frame_id, det_id, round(conf, 6) AS conf FROM r WHERE conf >= 0.15 OR k > floor(n / 10)""",
    ),
    "frame_pairs": with_views("cams", _PAIRS + " SELECT first_frame, second_frame, round(quality, 6) AS quality, rank FROM pairs"),
    "ray_candidates": with_views("obs", ",\n".join((_RAYS, _PAIRS, _CAND)) + " SELECT zone_id, a_frame_id, b_frame_id, count(*) AS n, round(sum(distance), 6) AS distance, round(sum(distance_conf), 6) AS distance_conf, round(sum(angle_conf), 6) AS angle_conf, round(sum(x), 6) AS x FROM cand GROUP BY ALL"),
    "support_edges": with_views("obs zones", _TO_EDGES + " SELECT zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id, round(distance, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(conf, 6) AS conf FROM edges"),
    "ambiguous": with_views("obs", ",\n".join((_RAYS, _PAIRS, _CAND, _MARK)) + " SELECT zone_id, count(*) FILTER (a_ignored) AS a_ignored, count(*) FILTER (b_ignored) AS b_ignored, count(*) AS n FROM marked GROUP BY zone_id"),
    "forbidden": with_views(
        "obs",
        ",\n".join((_RAYS, _PAIRS, _CAND, _MARK))
        + """, c AS (SELECT a.zone_id, a.frame_id AS a_frame_id, b.frame_id AS b_frame_id, a.det_id AS a_det_id, b.det_id AS b_det_id FROM rays a JOIN pairs p ON a.frame_id = p.first_frame JOIN rays b ON b.zone_id = a.zone_id AND b.frame_id = p.second_frame)
SELECT zone_id, count(*) AS n, sum(a_det_id * 31 + b_det_id)::BIGINT AS checksum FROM c
WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.zone_id = c.zone_id AND m.a_frame_id = c.a_frame_id AND m.b_frame_id = c.b_frame_id AND m.a_det_id = c.a_det_id AND m.b_det_id = c.b_det_id)
AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.a_ignored AND m.zone_id = c.zone_id AND m.a_frame_id = c.a_frame_id AND m.b_frame_id = c.b_frame_id AND m.a_det_id = c.a_det_id)
AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.b_ignored AND m.zone_id = c.zone_id AND m.a_frame_id = c.a_frame_id AND m.b_frame_id = c.b_frame_id AND m.b_det_id = c.b_det_id)
GROUP BY zone_id""",
    ),
    "frame_consistency": with_views(
        "obs zones",
        _TO_EDGES
        + """, s AS (SELECT zone_id, b_frame_id AS frame_id, count(DISTINCT b_det_id) AS supported FROM edges GROUP BY ALL),
j AS (SELECT z.zone_id, z.frame_id, z.n, coalesce(s.supported, 0) AS supported, row_number() OVER (PARTITION BY z.zone_id ORDER BY z.frame_id) - 1 AS k FROM sizes z LEFT JOIN s USING (zone_id, frame_id))
SELECT zone_id, frame_id, n, supported, k >= 3 AND (n - supported) * 10 > n * 3 AS rejected FROM j""",
    ),
    "dynamic_thresholds": with_views(
        "frames",
        """n AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS accepted FROM frames),
p AS (SELECT *, greatest(0.0e0, least(1.0e0, (accepted - 5) / 25.0e0)) AS p FROM n)
SELECT session_id, frame_id, accepted, round(0.05e0 * (1 - 0.5e0 * p), 6) AS epsilon, round(0.1e0 * (1 - 0.5e0 * p), 6) AS forbidden, round(0.1e0 * p, 6) AS min_confidence, round(0.03e0 * (1 - 0.5e0 * p), 6) AS radius,
round(0.7e0 + 0.15e0 * p, 6) AS conflict_confidence, round(0.5e0 + 0.25e0 * p, 6) AS addition_confidence, round(1.5e0 * (1 + 0.2e0 * p), 6) AS component_confidence FROM p""",
    ),
    "resolved_components": with_views("bars", "SELECT zone_id, count(*) AS components, count(*) AS pure, count(*) AS objects FROM bars GROUP BY zone_id"),
    "rounds_components": with_views("bars", "SELECT zone_id, count(*) AS components, count(*) AS pure, count(*) AS objects FROM bars GROUP BY zone_id"),
    "points_per_zone": with_views("bars", "SELECT zone_id, count(*) AS points FROM bars GROUP BY zone_id"),
    "components_on_rays": with_views(
        "obs",
        _RAYS
        + """, t AS (SELECT r.zone_id, r.frame_id, r.det_id, b.bar_id, b.x - r.ox AS vx, b.y - r.oy AS vy, b.z - r.oz AS vz, (b.x-r.ox)*r.dx+(b.y-r.oy)*r.dy+(b.z-r.oz)*r.dz AS t, r.dx, r.dy, r.dz
  FROM rays r JOIN bars b ON r.zone_id = b.zone_id WHERE b.bar_id % 2 = 0 AND r.frame_id >= 5),
d AS (SELECT *, CASE WHEN t <= 0 THEN sqrt(vx*vx+vy*vy+vz*vz) ELSE sqrt((vx-dx*t)*(vx-dx*t)+(vy-dy*t)*(vy-dy*t)+(vz-dz*t)*(vz-dz*t)) END AS distance FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY zone_id, frame_id, det_id ORDER BY distance, bar_id) AS rank FROM d WHERE distance <= 0.03)
SELECT zone_id, frame_id, count(*) AS n, round(sum(distance), 6) AS distance, max(rank) AS most FROM k GROUP BY ALL""",
    ),
    "true_components": with_views("obs zones", _TO_EDGES + " SELECT zone_id, a_det_id, round(sum(x*conf)/sum(conf), 6) AS x, round(sum(y*conf)/sum(conf), 6) AS y, round(sum(z*conf)/sum(conf), 6) AS z, round(avg(conf)*sqrt(count(*)), 6) AS confidence, count(*) AS edges, round(least(1.0, avg(conf)), 6) AS confidence_norm, avg(conf)*sqrt(count(*)) >= 1.5 AND count(*) >= 4 AS valid FROM edges WHERE a_det_id = b_det_id GROUP BY zone_id, a_det_id"),
    "near_components": with_views("bars", "p AS (SELECT bar_id, x - zone_id * 4.0e0 AS x, y, z FROM bars) SELECT a.bar_id AS first, b.bar_id AS second, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS distance FROM p a JOIN p b ON a.bar_id < b.bar_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.1"),
    "largest_frames": with_views("obs", "n AS (SELECT zone_id, frame_id, count(*) AS n FROM obs GROUP BY ALL) SELECT zone_id, max(n) AS largest FROM n GROUP BY zone_id"),
    "free_edge_pool": with_views(
        "obs zones",
        _TO_EDGES
        + """, g AS (SELECT zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id, round(conf, 6) AS conf FROM edges),
p AS (SELECT *, conf + 0.15e0 / (max(b_frame_id) OVER (PARTITION BY zone_id) - b_frame_id + 1) AS priority FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY priority DESC, b_frame_id DESC, conf DESC, a_frame_id, a_det_id, b_frame_id, b_det_id) AS place FROM p)
SELECT zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id, round(priority, 6) AS priority FROM k WHERE place <= 200""",
    ),
    "unused_edges": with_views("obs zones", _TO_EDGES + " SELECT zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id FROM edges WHERE a_det_id % 3 <> 0 AND b_det_id % 3 <> 0"),
    "surplus_components": with_views("bars obs", "n AS (SELECT zone_id, frame_id, count(*) AS n FROM obs GROUP BY ALL), m AS (SELECT zone_id, max(n) AS most FROM n GROUP BY zone_id), k AS (SELECT b.zone_id, bar_id AS component_id, bar_id * 7 % 10 / 10.0e0 AS confidence, most, row_number() OVER (PARTITION BY b.zone_id ORDER BY bar_id * 7 % 10 DESC, bar_id) AS place FROM bars b JOIN m ON m.zone_id = b.zone_id) SELECT zone_id, component_id, confidence FROM k WHERE place > most"),
    "released_edges": with_views("obs zones", _TO_EDGES + " SELECT zone_id, a_frame_id, a_det_id, b_frame_id, b_det_id FROM edges WHERE a_det_id % 2 = 0 OR b_det_id % 3 = 0"),
    "zone_overlaps": with_views(
        "zones",
        """o AS (SELECT a.zone_id, b.zone_id AS other_id, greatest(least(a.maxx, b.maxx - 2) - greatest(a.minx, b.minx - 2), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0) * greatest(least(a.maxz, b.maxz) - greatest(a.minz, b.minz), 0) AS i,
  least((a.maxx-a.minx)*(a.maxy-a.miny)*(a.maxz-a.minz), (b.maxx-b.minx)*(b.maxy-b.miny)*(b.maxz-b.minz)) AS s FROM zones a JOIN zones b ON a.zone_id < b.zone_id)
SELECT zone_id, other_id, round(i / greatest(s, 1e-8), 6) AS overlap FROM o WHERE round(i / greatest(s, 1e-8), 6) >= 0.1""",
    ),
    "zone_of_point": with_views("points point_zones", _NEAR + " SELECT a.point_id, a.zone_id, coalesce(a.d2 * 4 < b.d2, true) AS is_anchor FROM near a LEFT JOIN near b ON a.point_id = b.point_id AND b.rank = 2 WHERE a.rank = 1"),
    "four_nearest_zones": with_views("points point_zones", _NEAR + " SELECT point_id, zone_id, rank FROM near WHERE rank <= 4"),
    "neighbour_graph": with_views(
        "points",
        """d AS (SELECT a.label AS scene, a.point_id AS a, b.point_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 12) AS distance FROM points a JOIN points b ON a.label = b.label AND a.point_id <> b.point_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, a ORDER BY distance, b) AS rank FROM d),
n AS (SELECT * FROM k WHERE rank <= 8),
s AS (SELECT scene, greatest(quantile_cont(distance, 0.5), 0.05) AS sigma FROM n GROUP BY scene),
u AS (SELECT DISTINCT scene, least(a, b) AS a, greatest(a, b) AS b, distance FROM n)
SELECT u.scene, u.a, u.b, round(u.distance, 6) AS distance, round(exp(-(u.distance*u.distance)/(sigma*sigma)) * p.conf * q.conf, 6) AS weight FROM u JOIN s USING (scene) JOIN points p ON p.point_id = u.a JOIN points q ON q.point_id = u.b""",
    ),
    "frame_views": with_views(
        "zones cams",
        """m AS (SELECT zone_id, frame_id, tx, ty, round(degrees(acos(greatest(-1.0, least(1.0, tz / sqrt((tx+cx-cx)*(tx+cx-cx)+(ty+cy-cy)*(ty+cy-cy)+tz*tz))))), 6) AS angle, round(sqrt((tx+cx-cx)*(tx+cx-cx)+(ty+cy-cy)*(ty+cy-cy)+tz*tz), 6) AS distance FROM zones CROSS JOIN cams)
SELECT zone_id, frame_id, angle, distance, angle < 75 AS good, round(abs(angle - lag(angle) OVER w) / 15.0 + sqrt(pow(tx - lag(tx) OVER w, 2) + pow(ty - lag(ty) OVER w, 2)) / ((distance + lag(distance) OVER w) / 2) / 0.1, 6) AS delta FROM m WINDOW w AS (PARTITION BY zone_id ORDER BY frame_id)""",
    ),
}
