"""Zones: bounds, plane fits, views and placement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.functions import vec as v
from parallaxis.operators import frames, placement
from parallaxis.scratch import cut


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """Box of each zone's points, wider by a tenth of its largest side, 0.05 at least, and its centre."""
    sizes = {f"{m}{n}": (F.min if m == "min" else F.max)(n) for m in ("min", "max") for n in "xyz"}
    b = points.groupBy(*keys).agg(*(c.alias(k) for k, c in sizes.items()))
    pad = F.greatest(F.lit(0.05), 0.1 * F.greatest(*(F.col("max" + n) - F.col("min" + n) for n in "xyz")))
    b = b.withColumn("pad", pad)
    out = {f"{m}{n}": F.col(m + n) + (F.col("pad") if m == "max" else -F.col("pad")) for m in ("min", "max") for n in "xyz"}
    centre = {"c" + n: (F.col("min" + n) + F.col("max" + n)) / 2 for n in "xyz"}
    return b.select(*keys, *(c.alias(k) for k, c in centre.items()), *(c.alias(k) for k, c in out.items()))


def fit_plane(points: DataFrame, *keys: str, least: int = 3, rounds: int = 3, keep: float = 0.7) -> DataFrame:
    """Robust plane z = a x + b y + c of each group: least squares, refitted on the share of points nearest to it.

    Sums make each fit; a singular fit, or one of fewer than `least` points, gives nulls and a reason. points has a
    point_id, by which ties are told apart. Each fit is cut off, so that no stage holds the sorts of several.
    """

    def solve(p: DataFrame) -> DataFrame:
        n = F.count("*")
        m = {c: F.avg(c).alias("m" + c) for c in "xyz"}
        centred = p.join(p.groupBy(*keys).agg(*m.values(), n.alias("n")), list(keys))
        dx, dy, dz = (F.col(c) - F.col("m" + c) for c in "xyz")
        s = centred.groupBy(*keys).agg(*(F.first("m" + c).alias("m" + c) for c in "xyz"), F.first("n").alias("n"), *(F.sum(e).alias(k) for k, e in {"xx": dx * dx, "xy": dx * dy, "yy": dy * dy, "xz": dx * dz, "yz": dy * dz}.items()))
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        fine = (F.col("n") >= 3) & (F.abs(det) > 1e-12)
        a = F.when(fine, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)
        b = F.when(fine, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
        return s.select(*keys, "n", "mx", "my", "mz", a.alias("a"), b.alias("b")).withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my"))

    points = cut(points.select(*keys, "point_id", "x", "y", "z"))
    inliers, plane = points, cut(solve(points))
    for _ in range(rounds):
        left = inliers.join(plane.select(*keys, "a", "b", "c", "n"), list(keys)).withColumn("residual", F.round(F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c")), 12))
        ranked = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("residual", "point_id")))
        inliers = cut(ranked.filter(F.col("place") <= F.greatest(F.lit(3), F.floor(F.col("n") * keep))).drop("a", "b", "c", "n", "residual", "place"))
        plane = cut(solve(inliers))
    few = F.col("given") < least
    out = plane.join(points.groupBy(*keys).agg(F.count("*").alias("given")), list(keys)).withColumns({c: F.when(~few, F.col(c)) for c in "abc"})
    return out.withColumn("reason", F.when(few, "too few points").when(F.col("a").isNull(), "singular")).drop("given")


def best_view(views: DataFrame, *keys: str) -> DataFrame:
    """The view of most coverage in each group; ties by frame_id."""
    return views.groupBy(*keys).agg(F.max_by("frame_id", F.struct("coverage", -F.col("frame_id"))).alias("frame_id"), F.max("coverage").alias("coverage"))


def unoccluded(views: DataFrame, most: float = 0.2) -> DataFrame:
    """Views of zones (frame_id, zone_id, distance, left, top, right, bottom) that no nearer zone of the frame covers by more than `most` of their area."""
    a, b = views.alias("a"), views.alias("b")
    w = F.greatest(F.least(F.col("a.right"), F.col("b.right")) - F.greatest(F.col("a.left"), F.col("b.left")), F.lit(0.0))
    h = F.greatest(F.least(F.col("a.bottom"), F.col("b.bottom")) - F.greatest(F.col("a.top"), F.col("b.top")), F.lit(0.0))
    size = (F.col("a.right") - F.col("a.left")) * (F.col("a.bottom") - F.col("a.top"))
    return a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("b.distance") < F.col("a.distance")) & (w * h > most * size), "left_anti")


def unoccluded_outlines(views: DataFrame, most: float = 0.2) -> DataFrame:
    """Views of zones (frame_id, zone_id, distance, polygon: convex, counter-clockwise) of which no nearer zone's outline in the frame covers more than `most`. Outlines are clipped only where their boxes meet."""
    box = poly.bounds(F.col("polygon"))
    own = views.withColumns({"_" + k: c for k, c in box.items()}).withColumn("_area", poly.area(F.col("polygon")))
    a, b = own.alias("a"), own.alias("b")
    meet = (F.col("a._left") < F.col("b._right")) & (F.col("b._left") < F.col("a._right")) & (F.col("a._top") < F.col("b._bottom")) & (F.col("b._top") < F.col("a._bottom"))
    met = a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("b.distance") < F.col("a.distance")) & meet)
    row = ["frame_id", "zone_id", "distance", "polygon"]
    shared = met.select(*(F.col("a." + c).alias(c) for c in row), F.col("a._area").alias("_area"), F.col("b.polygon").alias("nearer"))
    covered = shared.filter(poly.shared_area(F.col("polygon"), F.col("nearer")) > most * F.col("_area")).select(row)
    return views.join(covered, row, "left_anti").select(*views.columns)


def target_zone(views: DataFrame) -> DataFrame:
    """frame_id, zone_id, coverage: the one zone that each frame is taken for: seen well, not covered by a nearer one, and of the most coverage (ties to the least id)."""
    seen = (unoccluded_outlines(views) if "polygon" in views.columns else unoccluded(views)).filter(view_is_good())
    return seen.groupBy("frame_id").agg(F.max_by("zone_id", F.struct("coverage", -F.col("zone_id"))).alias("zone_id"), F.max("coverage").alias("coverage"))


def view_is_good() -> Column:
    return (F.col("angle") < 75) & (F.col("coverage") > 0.3)


def area_in_range(area: Column, low: float = 0.001, high: float = 2.0) -> Column:
    """Null where a zone's area is plausible, else why not."""
    return F.when(area < low, "too small").when(area > high, "too large")


def is_placed(insignificant: Column, least: int = 3) -> Column:
    return insignificant >= least


def guidance(vertices: DataFrame, cameras: DataFrame) -> DataFrame:
    """For each zone the mean of its vertices, and the upper median of the cameras' distances to it, between 0.6 and 3.5; without cameras three times the largest extent."""
    target = vertices.groupBy("zone_id").agg(*(F.avg(c).alias("g" + c) for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("extent"))
    far = cameras.join(target, "zone_id").withColumn("far", F.round(v.length(v.sub(v.vec("t"), v.vec("g"))), 12))
    upper = far.groupBy("zone_id").agg(F.array_sort(F.collect_list("far")).alias("d"))
    median = F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int"))
    out = target.join(upper, "zone_id", "left")
    return out.select("zone_id", "gx", "gy", "gz", F.when(F.col("d").isNotNull(), v.clamp(median, 0.6, 3.5)).otherwise(3 * F.col("extent")).alias("radius"))


#: Directions tried around a zone, besides its normal; the steepest angle of a view; suggestions at most, and the likeness from which no view helps.
DIRECTIONS, STEEPEST, SUGGESTED, ALIKE = 256, 75.0, 25, 1.0
GOLDEN = 2.399963229728653


def hemisphere(zones: DataFrame, directions: int = DIRECTIONS) -> DataFrame:
    """zone_id, view_id, t* (camera), d* (direction from the zone), px, py (camera in the plane), angle, distance: views of each zone from a half sphere around it.

    zones: zone_id, g* (target), n* (normal), radius. The first view is along
    the normal; others turn by the golden angle while the cosine to the normal
    falls evenly, so any number of them covers the half sphere evenly and
    reruns agree. Those of STEEPEST or more are left out, and so are zones
    without a radius.
    """
    z = zones.filter("radius > 0").select("zone_id", "gx", "gy", "gz", "nx", "ny", "nz", "radius")
    for k, axis in enumerate("mab"):  # one after the other, so that expressions stay small
        of = v.normalise(v.vec("n")) if axis == "m" else placement.plane_axes(v.vec("m"))[k - 1]
        z = v.settled(z, {axis + c: x for c, x in zip("xyz", of)})
    z = z.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(directions))))
    turn = F.col("view_id") * GOLDEN
    z = v.settled(z, {"dot": F.when(F.col("view_id") == 0, F.lit(1.0)).otherwise(1.0 - (F.col("view_id") - 0.5) / directions), "turn": turn})
    dot, turn, flat = F.col("dot"), F.col("turn"), F.sqrt(F.greatest(1.0 - F.col("dot") * F.col("dot"), F.lit(0.0)))
    d = v.add(v.scale(v.vec("m"), dot), v.add(v.scale(v.vec("a"), F.cos(turn) * flat), v.scale(v.vec("b"), F.sin(turn) * flat)))
    z = v.settled(z, {"d" + c: k for c, k in zip("xyz", d)}).withColumn("angle", F.round(F.degrees(F.acos(v.clamp(dot, -1, 1))), 9)).filter(F.col("angle") < STEEPEST)
    px, py = F.cos(turn) * flat * F.col("radius"), F.sin(turn) * flat * F.col("radius")
    t = v.add(v.vec("g"), v.scale(v.vec("d"), F.col("radius")))
    return z.select("zone_id", "view_id", *(c.alias("t" + k) for c, k in zip(t, "xyz")), "dx", "dy", "dz", px.alias("px"), py.alias("py"), "angle", F.col("radius").alias("distance"))


def diverse_views(candidates: DataFrame, references: DataFrame, most: int = SUGGESTED, stop: float = ALIKE) -> DataFrame:
    """zone_id, view_id, place, score: views chosen one after the other, each the farthest from all before it and from the references.

    candidates and references: zone_id, view_id, angle, d*, px, py, distance.
    How far views are is placement.similar_views' measure; ties go to the
    smaller angle, then to the smaller view_id, and a zone ends where the
    farthest is within `stop`. Without a reference the first is the one of the
    smallest angle, its score null. A task holds one zone's candidates, which
    are as many for each, and its stored views, which are unlike each other.
    """
    own = ("view_id", "angle", "dx", "dy", "dz", "px", "py", "distance")
    degrees, shift_of = placement.DIFFERENT_DEGREES, placement.DIFFERENT_SHIFT

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if "dx" not in t.column_names:  # the side of a zone that has none brings no columns
            return np.zeros((0, 3)), np.zeros((0, 3))
        d = np.stack([t[c].to_numpy().astype(float) for c in ("dx", "dy", "dz")], 1).reshape(-1, 3)
        return d / np.maximum(np.linalg.norm(d, axis=1), 1e-12)[:, None], np.stack([t[c].to_numpy().astype(float) for c in ("px", "py", "distance")], 1).reshape(-1, 3)

    def far(d: np.ndarray, at: np.ndarray, one: np.ndarray, there: np.ndarray) -> np.ndarray:
        turn = np.degrees(np.arccos(np.clip(d @ one, -1, 1)))
        shift = np.hypot(at[:, 0] - there[0], at[:, 1] - there[1]) / np.maximum((at[:, 2] + there[2]) / 2, 1e-3)
        return np.round(turn / degrees + shift / shift_of, 6)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        d, at = columns(left)
        ids, angle = (left[c].to_numpy() if len(d) else np.zeros(0) for c in ("view_id", "angle"))
        best, rows = np.full(len(ids), np.inf), []
        for one, there in zip(*columns(right)):
            best = np.minimum(best, far(d, at, one, there))
        open_ = np.ones(len(ids), bool)
        while len(rows) < most and open_.any():
            k = min(np.flatnonzero(open_), key=lambda i: (-best[i], angle[i], ids[i]))
            if best[k] <= stop:
                break
            rows.append((int(ids[k]), len(rows) + 1, None if np.isinf(best[k]) else float(best[k])))
            open_[k] = False
            best = np.minimum(best, far(d, at, d[k], at[k]))
        zone = (key[0] if key[0].is_valid else left["zone_id"][0]).as_py() if len(left) else None
        columns_ = (pa.array([zone] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64()))))
        return pa.table(dict(zip(("zone_id", "view_id", "place", "score"), columns_)))

    sides = [x.select("zone_id", *own).groupBy("zone_id") for x in (candidates, references)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "zone_id long, view_id long, place int, score double")


def plane_pose(planes: DataFrame, cameras: DataFrame, *keys: str) -> DataFrame:
    """Fitted planes (a, b, c and centroid mx, my, mz) with their unit normal n*, turned to the camera (keys, t*); null where the fit has none."""
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1.0)
    n = (-F.col("a") / size, -F.col("b") / size, 1.0 / size)
    met = v.settled(planes.join(cameras.select(*keys, "tx", "ty", "tz"), list(keys)), {"n" + c: x for c, x in zip("xyz", n)})
    behind = v.dot(v.vec("n"), v.sub(v.vec("t"), v.vec("m"))) < 0
    return met.withColumns({"n" + c: F.when(behind, -F.col("n" + c)).otherwise(F.col("n" + c)) for c in "xyz"})


def overlapping_zones(a: DataFrame, b: DataFrame, *keys: str, least: float = 0.3) -> DataFrame:
    """keys, zone_id, other_id, overlap: boxes (zone_id, min*, max*) of a and b that share `least` of the smaller one's volume. Cells, as wide as the widest box, bound what is compared."""
    names = [m + n for m in ("min", "max") for n in "xyz"]
    wide = F.greatest(*(F.max(F.col("max" + n) - F.col("min" + n)) for n in "xyz"), F.lit(1e-6))
    cell = cut(a.select(*keys, *names).union(b.select(*keys, *names)).groupBy(*keys).agg(wide.alias("cell")))

    def celled(df: DataFrame, prefix: str, name: str) -> DataFrame:
        df = df.join(cell, list(keys)) if keys else df.crossJoin(F.broadcast(cell))
        for n in "xyz":
            df = df.withColumn("g" + n, F.explode(F.sequence(F.floor(F.col("min" + n) / F.col("cell")), F.floor(F.col("max" + n) / F.col("cell")))))
        return df.select(*keys, "gx", "gy", "gz", F.col("zone_id").alias(name), *(F.col(c).alias(prefix + c) for c in names))

    met = celled(a, "a_", "zone_id").join(celled(b, "b_", "other_id"), [*keys, "gx", "gy", "gz"])
    overlap = F.round(v.box_overlap(v.box("a_"), v.box("b_")), 9)
    return met.select(*keys, "zone_id", "other_id", overlap.alias("overlap")).filter(F.col("overlap") >= least).distinct()


def placed_zones(samples: DataFrame, cells: DataFrame, cameras: DataFrame, outlines: DataFrame, least: int = 6) -> DataFrame:
    """frame_id, zone_id, points, n*, m*, vertices, area, reason of detected zones put into the world.

    samples: frame_id, zone_id, sample_id, sx, sy; cells: depth of the frame;
    cameras: frame_id, focal, px, py (centre), t*, q*; outlines: frame_id,
    zone_id, polygon. Each sample takes the depth around it, the points fit a
    plane, and the outline's vertices meet it; zones of too few points, without
    a plane, with a vertex that misses it, or of an odd area have a reason.
    """
    keys = ["frame_id", "zone_id"]
    number = samples.withColumn("own", F.struct("zone_id", "sample_id"))
    depth = frames.depth_samples(number.select("frame_id", F.col("own").alias("sample_id"), "sx", "sy"), cells)
    points = depth.select("frame_id", "sample_id.zone_id", F.col("sample_id.sample_id").alias("point_id"), F.col("x").alias("ix"), F.col("y").alias("iy"), (F.col("mm") / 1000.0).alias("deep")).join(cameras, "frame_id")
    q = tuple(F.col("q" + c) for c in "xyzw")
    at = lambda c, m: (c - F.col(m)) / F.col("focal")
    points = points.select(*keys, "point_id", *(c.alias(n) for n, c in zip("xyz", v.unproject(at(F.col("ix"), "px"), at(F.col("iy"), "py"), F.col("deep"), v.vec("t"), q))))
    plane = plane_pose(fit_plane(points, *keys, least=least), cameras.join(outlines.select(*keys), "frame_id"), *keys)
    met = outlines.join(plane.drop("tx", "ty", "tz"), keys, "left").join(cameras, "frame_id")
    hit = lambda p: v.plane_hit(v.vec("t"), v.pixel_ray(at(p["x"], "px"), at(p["y"], "py"), q, x_sign=1), v.vec("m"), v.vec("n"))
    met = met.withColumn("vertices", F.when(F.col("nx").isNotNull(), F.transform("polygon", hit)))
    missed = F.exists("vertices", lambda p: p.isNull())
    for k, axis in enumerate("uw"):  # settled, so that expressions stay small
        met = v.settled(met, {axis + c: x for c, x in zip("xyz", placement.plane_axes(v.vec("n"))[k])})
    flat = F.transform("vertices", lambda p: poly.point(*placement.to_plane((p["x"], p["y"], p["z"]), v.vec("m"), (v.vec("u"), v.vec("w")))))
    met = met.withColumn("area", F.when(~missed, poly.area(flat)))
    reason = F.coalesce("reason", F.when(F.col("n").isNull(), "too few points"), F.when(missed, "outline misses the plane"), area_in_range(F.col("area")))
    return met.select(*keys, F.coalesce("n", F.lit(0)).alias("points"), "nx", "ny", "nz", "mx", "my", "mz", "vertices", "area", reason.alias("reason"))
