import pytest
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.functions import vec as v
from parallaxis.operators import fuse, resolve


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def polygon(*points):
    return F.array(*(poly.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def pixel_rays(spark, cameras, coefficients=None):
    """cameras: (frame, det, tx, px, py)."""
    df = spark.createDataFrame(cameras, "frame_id long, det_id long, ox double, px int, py int").withColumns({"zone_id": F.lit(1), "conf": F.lit(1.0), "oy": F.lit(0.0), "oz": F.lit(0.0)})
    at = v.undistort((F.col("px") - 320) / 800.0, (F.col("py") - 240) / 800.0, F.array(*map(F.lit, coefficients or [0.0])))
    df = df.withColumn("at", at)
    return df.select("*", *(c.alias("d" + n) for c, n in zip(v.pixel_ray(F.col("at.x"), F.col("at.y")), "xyz")))


def pairs(spark):
    return spark.createDataFrame([(0, 1)], "first_frame long, second_frame long")


def test_matched_rays_meet_and_decoys_do_not(spark):
    # target (0, 0.08, -3.2) seen from x = -0.45 and 0.45 without distortion
    def pixel(tx):
        return round(320 - 800 * (0 - tx) / 3.2), round(240 - 800 * 0.08 / 3.2)

    (ax, ay), (bx, by) = pixel(-0.45), pixel(0.45)
    rays = pixel_rays(spark, [(0, 0, -0.45, ax, ay), (0, 1, -0.45, 50, 50), (1, 0, 0.45, bx, by), (1, 1, 0.45, 600, 430)])
    found = fuse.ray_candidates(rays, pairs(spark), 0.05, 0.05).collect()
    assert [(r.a_det_id, r.b_det_id) for r in found] == [(0, 0)]
    assert found[0].distance_conf > 0.9 and 0 < found[0].angle_conf < 1
    assert found[0].z == pytest.approx(-3.2, abs=0.05)


def test_undistortion_inverts_the_lens(spark):
    k1, k2, p1, p2, k3 = k = [0.14, -0.03, 0.002, -0.001, 0.008]
    x, y = 0.2, -0.1
    r = x * x + y * y
    radial = 1 + k1 * r + k2 * r * r + k3 * r**3
    dx, dy = x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y
    got = one(spark, p=v.undistort(F.lit(dx), F.lit(dy), F.array(*map(F.lit, k)))).p
    assert (got.x, got.y) == (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6))
    same = one(spark, p=v.undistort(F.lit(dx), F.lit(dy), F.array().cast("array<double>"))).p
    assert (same.x, same.y) == (dx, dy)


def test_narrow_baseline_is_less_sure(spark):
    def angle(base):
        a, b = round(320 + 800 * -base / 2 / 5), round(320 + 800 * base / 2 / 5)
        rays = pixel_rays(spark, [(0, 0, -base / 2, a, 240), (1, 0, base / 2, b, 240)])
        return fuse.ray_candidates(rays, pairs(spark), 0.05, 0.2).first().angle_conf

    assert angle(0.2) < angle(1.0)


def test_point_behind_a_ray_is_measured_from_its_origin(spark):
    zero, ahead = (F.lit(0.0),) * 3, (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    got = one(spark, side=v.ray_distance(zero, ahead, (F.lit(0.2), F.lit(0.0), F.lit(-5.0))), behind=v.ray_distance(zero, ahead, (F.lit(0.0), F.lit(0.0), F.lit(2.0))))
    assert (got.side, got.behind) == (pytest.approx(0.2), pytest.approx(2.0))


def test_component_summary(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1.0)] * 4 + [(2, 0.0, 0.0, 0.0, c) for c in (0.2, 0.4, 0.6, 0.8)] + [(3, 0.0, 0.0, 0.0, 0.7)] * 4 + [(4, 0.0, 0.0, 0.0, 0.8)] * 4
    edges = spark.createDataFrame(rows, "k long, x double, y double, z double, conf double")
    got = {r.k: r for r in resolve.component_summary(edges, "k").withColumn("valid", resolve.is_valid()).collect()}
    assert got[1].confidence == pytest.approx(2.0) and got[2].confidence == pytest.approx(1.0)
    assert not got[3].valid and got[4].valid


def test_polygons(spark):
    square, shifted, triangle = polygon((0, 0), (4, 0), (4, 4), (0, 4)), polygon((2, 2), (6, 2), (6, 6), (2, 6)), polygon((0, 0), (10, 0), (0, 10))
    got = one(
        spark, area=poly.area(square), clip=poly.area(poly.clip(square, shifted)), overlap=poly.overlap_by_smaller(square, shifted), difference=poly.symmetric_difference(square, shifted),
        inside=poly.contains(triangle, F.lit(3.0), F.lit(3.0)), border=poly.contains(triangle, F.lit(5.0), F.lit(5.0)), outside=poly.contains(triangle, F.lit(6.0), F.lit(6.0)), none=poly.area(poly.clip(square, polygon((9, 9), (10, 9), (10, 10)))),
        line=poly.area(polygon((0, 0), (1, 1))), two=poly.star_polygon(F.lit(0.0), F.lit(0.0), F.array(F.lit(1.0), F.lit(1.0))), whole=F.size(poly.integer_polygon(polygon((0.2, 0.1), (0.4, 0.3), (3.0, 0.2)))),
    )
    assert (got.area, got.clip, got.overlap, got.difference) == (16, 4, 0.25, 1.5)
    assert got.inside and got.border and not got.outside
    assert got.none == 0 and got.line == 0 and got.two is None and got.whole == 4


def test_thresholds_tighten(spark):
    for n, epsilon, component in ((0, 0.05, 1.5), (5, 0.05, 1.5), (30, 0.025, 1.8), (99, 0.025, 1.8)):
        t = v.thresholds(F.lit(n))
        got = one(spark, e=t["epsilon"], c=t["component_confidence"])
        assert (got.e, got.c) == (pytest.approx(epsilon), pytest.approx(component))
