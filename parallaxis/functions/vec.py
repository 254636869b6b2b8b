"""Rays, poses, planes and boxes as column expressions.

Vectors are triples of columns, quaternions quadruples (x, y, z, w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]

PARALLEL, MIN_DEPTH, MAX_DEPTH = 1e-6, 0.1, 10.0


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row where they stand, and not again in every expression that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def vec(prefix: str, names: str = "xyz") -> tuple[Column, ...]:
    """Columns <prefix>x, <prefix>y, ..."""
    return tuple(F.col(prefix + n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def scale(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec) -> Vec:
    n = length(a)
    return a[0] / n, a[1] / n, a[2] / n


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def rotate(q: Quat, v: Vec) -> Vec:
    """v rotated by a unit quaternion."""
    u = q[0], q[1], q[2]
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, q[3])), cross(u, t))


def undistort(x: Column, y: Column, coefficients: Column, rounds: int = 8) -> Column:
    """Struct x, y: a normalised image point without lens distortion, by fixed-point rounds; coefficients are k1, k2, p1, p2, k3, missing ones zero."""
    k = [F.coalesce(F.try_element_at(coefficients, F.lit(i + 1)), F.lit(0.0)).cast("double") for i in range(5)]

    def step(at: Column, _: Column) -> Column:
        px, py = at["x"], at["y"]
        r = px * px + py * py
        radial = 1.0 + k[0] * r + k[1] * r * r + k[4] * r * r * r
        tx = 2.0 * k[2] * px * py + k[3] * (r + 2.0 * px * px)
        ty = k[2] * (r + 2.0 * py * py) + 2.0 * k[3] * px * py
        fine = F.abs(radial) > 1e-9
        return F.struct(F.when(fine, (x - tx) / radial).otherwise(px).alias("x"), F.when(fine, (y - ty) / radial).otherwise(py).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), step)


def pixel_ray(x: Column, y: Column, q: Quat | None = None, x_sign: int = -1) -> Vec:
    """World direction of the ray through a normalised image point of a camera that looks along -z; x_sign is +1 in plane projection."""
    d = normalise((x * x_sign, -y, F.lit(-1.0)))
    return d if q is None else normalise(rotate(q, d))


def closest_approach(df: DataFrame, first: str = "a_", second: str = "b_") -> DataFrame:
    """df with t1, t2, where the rays o, d of two prefixes come nearest; rows whose rays are parallel or meet outside the depth range go."""
    o1, d1, o2, d2 = vec(first + "o"), vec(first + "d"), vec(second + "o"), vec(second + "d")
    delta = sub(o1, o2)
    parts = {"qa": dot(d1, d1), "qb": dot(d1, d2), "qc": dot(d2, d2), "qd": dot(d1, delta), "qe": dot(d2, delta)}
    df = settled(df, parts).filter(F.abs(F.expr("qa * qc - qb * qb")) > PARALLEL)
    den = F.expr("qa * qc - qb * qb")
    df = settled(df, {"t1": F.expr("qb * qe - qc * qd") / den, "t2": F.expr("qa * qe - qb * qd") / den}).drop(*parts)
    return df.filter((F.col("t1") > MIN_DEPTH) & (F.col("t1") < MAX_DEPTH) & (F.col("t2") > MIN_DEPTH) & (F.col("t2") < MAX_DEPTH))


def distance_confidence(distance: Column, epsilon: Column | float) -> Column:
    """1 near zero, falling to 0 at epsilon; 0 for an epsilon of zero."""
    e = F.lit(epsilon) if isinstance(epsilon, float) else epsilon
    return F.when(e > 0, clamp((1.0 - distance / e) * 2.5, 0, 1)).otherwise(0.0)


def angle_confidence(d1: Vec, d2: Vec) -> Column:
    return clamp(length(cross(d1, d2)) * 2.0, 0, 1)


def ray_distance(origin: Vec, direction: Vec, point: Vec) -> Column:
    """Distance of a point from a forward ray; from its origin where the point lies behind."""
    to = sub(point, origin)
    t = dot(to, direction)
    return F.when(t <= 0, length(to)).otherwise(length(sub(to, scale(direction, t))))


def normalised_confidence(c: Column, low: Column | float, high: float = 0.4) -> Column:
    return clamp((c - low) / (high - low), 0, 1)


def frame_difference(t1: Vec, f1: Vec, t2: Vec, f2: Vec) -> Column:
    """Baseline length plus half of one minus the cosine of the viewing directions."""
    return length(sub(t1, t2)) + (1.0 - clamp(dot(f1, f2), -1, 1)) * 0.5


def rotation_degrees(q1: Quat, q2: Quat) -> Column:
    d = F.abs(q1[0] * q2[0] + q1[1] * q2[1] + q1[2] * q2[2] + q1[3] * q2[3])
    return F.degrees(2.0 * F.acos(clamp(d, 0, 1)))


def angle_degrees(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(clamp(dot(normalise(a), normalise(b)), -1, 1)))


def plane_angle_degrees(a: Vec, b: Vec) -> Column:
    """Angle of two planes by their normals, whichever way these point."""
    return F.degrees(F.acos(clamp(F.abs(dot(normalise(a), normalise(b))), 0, 1)))


def plane_hit(origin: Vec, direction: Vec, centre: Vec, normal: Vec) -> Column:
    """Struct x, y, z where a ray meets a plane; null if it is parallel or the plane lies behind."""
    den = dot(direction, normal)
    t = dot(sub(centre, origin), normal) / den
    p = add(origin, scale(direction, t))
    return F.when((F.abs(den) > PARALLEL) & (t > 0), F.struct(*(c.alias(n) for c, n in zip(p, "xyz"))))


def unproject(x: Column, y: Column, depth: Column, t: Vec, q: Quat) -> Vec:
    """World point of a normalised image point at a depth along the camera's axis."""
    return add(t, rotate(q, (x * depth, -y * depth, -depth)))


def box_volume(b: dict[str, Column]) -> Column:
    out = F.lit(1.0)
    for n in "xyz":
        out = out * F.greatest(b["max" + n] - b["min" + n], F.lit(0.0))
    return out


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    out = F.lit(1.0)
    for n in "xyz":
        out = out * F.greatest(F.least(a["max" + n], b["max" + n]) - F.greatest(a["min" + n], b["min" + n]), F.lit(0.0))
    return out


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller volume."""
    return box_intersection(a, b) / F.greatest(F.least(box_volume(a), box_volume(b)), F.lit(1e-8))


def box(prefix: str = "") -> dict[str, Column]:
    return {m + n: F.col(f"{prefix}{m}{n}") for m in ("min", "max") for n in "xyz"}


def inside(p: Vec, b: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c, n in zip(p, "xyz"):
        out = out & c.between(b["min" + n], b["max" + n])
    return out


def thresholds(accepted: Column, epsilon: float = 0.05, forbidden: float = 0.1, radius: float = 0.03) -> dict[str, Column]:
    """Triangulation thresholds that tighten from the 5th to the 30th accepted frame."""
    p = clamp((accepted - 5) / 25.0, 0, 1)
    m = 1.0 - 0.5 * p
    half = p * 0.5
    return {
        "epsilon": epsilon * m,
        "forbidden": F.greatest(epsilon * m, forbidden * m),
        "min_confidence": 0.4 * 0.25 * p,
        "radius": radius * m,
        "conflict_confidence": 0.7 + 0.3 * half,
        "addition_confidence": 0.5 + 0.5 * half,
        "component_confidence": 1.5 * (1.0 + 0.2 * p),
    }
