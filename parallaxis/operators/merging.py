"""Zones of a session, merged as they are detected."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parallaxis.operators.detect import _clipped_area
from parallaxis.operators.placement import PROJECTIONS, SAME_ANGLE, SAME_AREA
from parallaxis.operators.shapes import covered_hull, hull_of

#: Share of the smaller box from which two zones are one, and quiet merges after which a zone is placed.
SAME_BOX, PLACED = 0.3, 3
#: Rounds of a plane fit, and the share of points nearest to it that each keeps.
ROUNDS, KEEP = 3, 0.7


def fitted_plane(points: np.ndarray, camera: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Centre and unit normal, towards the camera, of the plane z = a x + b y + c that fits points, refitted on those nearest to it; None where there is none."""
    rows = points
    for k in range(ROUNDS + 1):
        centre = rows.mean(0)
        d = rows - centre
        xx, xy, yy, xz, yz = (float((d[:, a] * d[:, b]).sum()) for a, b in ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2)))
        det = xx * yy - xy * xy
        if len(rows) < 3 or abs(det) <= 1e-12:
            return None
        a, b = (xz * yy - yz * xy) / det, (yz * xx - xz * xy) / det
        if k < ROUNDS:
            off = np.round(np.abs(d[:, 2] - a * d[:, 0] - b * d[:, 1]), 12)
            rows = rows[np.argsort(off, kind="stable")[: max(3, int(len(rows) * KEEP))]]
    normal = np.array([-a, -b, 1.0]) / np.sqrt(a * a + b * b + 1)
    return centre, normal if normal @ (camera - centre) >= 0 else -normal


def _flat(points: np.ndarray, plane: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Points in the coordinates of a plane."""
    centre, n = plane
    x = np.cross(n, [0.0, 1.0, 0.0] if abs(n[1]) < 0.99 else [1.0, 0.0, 0.0])
    x /= np.linalg.norm(x)
    return np.column_stack([(points - centre) @ x, (points - centre) @ np.cross(n, x)])


@dataclass
class Merged:
    """A zone of a session: its points, what it was seen as (confidence, outline in the world, camera), its plane and the quiet merges since it last changed."""

    zone_id: int
    points: np.ndarray
    seen: list[tuple[float, np.ndarray, np.ndarray]]
    plane: tuple[np.ndarray, np.ndarray]
    quiet: int = 0
    box: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        low, high = self.points.min(0), self.points.max(0)
        pad = max(0.1 * float((high - low).max()), 0.05)
        self.box = np.stack([low - pad, high + pad])

    def overlap(self, other: Merged) -> float:
        """Shared volume over that of the smaller box."""
        shared = np.prod(np.maximum(np.minimum(self.box[1], other.box[1]) - np.maximum(self.box[0], other.box[0]), 0))
        return float(shared / max(min(np.prod(self.box[1] - self.box[0]), np.prod(other.box[1] - other.box[0])), 1e-8))

    def outline(self, plane: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What enough of its projections cover, in a plane's coordinates."""
        return covered_hull([_flat(p, plane) for _, p, _ in self.seen])


def take(zones: list[Merged], new: Merged) -> tuple[list[Merged], str]:
    """The zones after a detection, and what became of it: added, ignored (the zone there is placed), refused (nothing sound comes of a merge, or it would run into a third zone), merged or settled (merged, and little changed)."""
    near = max(zones, key=lambda z: (z.overlap(new), -z.zone_id), default=None)
    if near is None or near.overlap(new) < SAME_BOX:
        return [*zones, new], "added"
    if near.quiet >= PLACED:
        return zones, "ignored"
    seen = sorted(near.seen + new.seen, key=lambda x: -x[0])[:PROJECTIONS]
    points = np.concatenate([near.points, new.points])
    merged = Merged(near.zone_id, points, seen, fitted_plane(points, seen[0][2]) or new.plane)
    hull = merged.outline(merged.plane)
    meets = lambda p: len(h := hull_of(_flat(p, merged.plane))) > 2 and _clipped_area([*map(tuple, h)], [*map(tuple, hull)]) > 0
    merged.seen = [x for x in seen if len(hull) > 2 and meets(x[1])]
    if not merged.seen or any(merged.overlap(z) >= SAME_BOX for z in zones if z is not near):
        return zones, "refused"
    now, before = (z.outline(merged.plane) for z in (merged, near))
    area = lambda p: _clipped_area([*map(tuple, p)], [*map(tuple, p)]) if len(p) > 2 else 0.0
    larger = max(area(now), area(before))
    if len(now) < 3 or larger == 0:
        return zones, "refused"
    shared = _clipped_area([*map(tuple, now)], [*map(tuple, before)]) if len(before) > 2 else 0.0
    turn = np.degrees(np.arccos(min(1.0, abs(float(merged.plane[1] @ near.plane[1])))))
    quiet = turn < SAME_ANGLE and (area(now) + area(before) - 2 * shared) / larger <= SAME_AREA
    merged.quiet = near.quiet + 1 if quiet else 0
    return [merged if z is near else z for z in zones], "settled" if quiet else "merged"


DECISIONS = "session_id long, seq long, zone_id long, decision string, zones int, placed int, points int"


def fold(zones: list[Merged], seq: int, confidence: float, points: np.ndarray, outline: np.ndarray, camera: np.ndarray) -> tuple[list[Merged], tuple]:
    """The zones of a session after a detection, and (zone_id, decision, zones, placed, points) of it."""
    plane = fitted_plane(points, camera)
    if plane is None:
        return zones, (None, "no plane", len(zones), sum(z.quiet >= PLACED for z in zones), 0)
    new = Merged(seq, points, [(confidence, outline, camera)], plane)
    zones, decision = take(zones, new)
    own = max(zones, key=lambda z: z.overlap(new))
    return zones, (own.zone_id, decision, len(zones), sum(z.quiet >= PLACED for z in zones), len(own.points))


def merge_zones(detections: DataFrame) -> DataFrame:
    """What becomes of each detected zone of a session, in order of seq, and how many zones, placed ones and points of its zone the session then has.

    detections: session_id, seq, confidence, points (array of x, y, z; three at
    least), outline (array of x, y, z), tx, ty, tz (camera). A session is
    folded in one task that holds its zones: those of one scene.
    """
    names = [x.split()[0] for x in DECISIONS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(table: pa.Table) -> pa.Table:
        zones: list[Merged] = []
        rows = []
        for r in table.sort_by("seq").to_pylist():
            points, outline = (np.array([(p["x"], p["y"], p["z"]) for p in r[c]], float) for c in ("points", "outline"))
            zones, row = fold(zones, r["seq"], r["confidence"], points, outline, np.array([r["tx"], r["ty"], r["tz"]]))
            rows.append((r["session_id"], r["seq"], *row))
        return pa.table({n: pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, (n, x) in enumerate(zip(names, DECISIONS.split(", ")))})

    return detections.select("session_id", "seq", "confidence", "points", "outline", "tx", "ty", "tz").groupBy("session_id").applyInArrow(run, DECISIONS)
