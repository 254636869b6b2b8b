"""Counting objects frame by frame: support edges of each new frame grow, merge and dissolve the components of its zone."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import vec as v
from parallaxis.operators import fuse

#: Edges of a component, best confidence after normalisation, gain of a replacement and edges that replace.
MIN_EDGES, BEST, IMPROVEMENT, REPLACING = 4, 0.4, 1e-4, 2
#: Distance at which two components are one object, free edges between frames, and the bonus of new ones.
DISSOLVE, FREE_EDGES, BONUS = 0.005, 5_000, 0.15
#: Frames that are always accepted, and the share of observations without support (in tenths) beyond which later ones go.
WARM_UP, UNSUPPORTED = 3, 3
#: Accepted frames from which thresholds stay as they are.
SETTLED = 30

Observation = tuple[int, int]  # frame, detection
Point = tuple[float, float, float]


def _apart(a: Point, b: Point) -> float:
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5


@dataclass(eq=False)
class Component:
    """One observation a frame, and the edges (by their two observations: position, confidence) that hold them together."""

    members: dict[int, Observation]
    edges: dict[frozenset, tuple[Point, float]]
    centre: Point = (0.0, 0.0, 0.0)
    confidence: float = 0.0
    name: Observation | None = None

    def settle(self) -> None:
        """Centre weighted by confidence; confidence is the mean times the root of the number of edges."""
        weight = sum(c for _, c in self.edges.values())
        if weight > 0:
            self.centre = tuple(sum(p[k] * c for p, c in self.edges.values()) / weight for k in range(3))
        elif self.edges:
            self.centre = tuple(sum(p[k] for p, _ in self.edges.values()) / len(self.edges) for k in range(3))
        self.confidence = weight / len(self.edges) ** 0.5 if self.edges else 0.0


@dataclass
class Zone:
    """What is known of a zone after some frames. Its free edges are FREE_EDGES at most between frames."""

    limits: list[dict[str, float]]
    accepted: list[int] = field(default_factory=list)
    components: list[Component] = field(default_factory=list)
    free: dict[frozenset, tuple[Point, float]] = field(default_factory=dict)
    born: dict[frozenset, int] = field(default_factory=dict)
    at: dict[Observation, set[frozenset]] = field(default_factory=dict)
    compared: set[frozenset] = field(default_factory=set)  # pairs of frames
    candidates: set[frozenset] = field(default_factory=set)  # pairs of observations
    ignored: set[tuple[Observation, int]] = field(default_factory=set)
    sizes: dict[int, int] = field(default_factory=dict)  # observations of each accepted frame
    names: dict[Observation, Observation] = field(default_factory=dict)  # of the last component that each observation was in

    def christen(self, c: Component) -> None:
        """Gives a grown component the name that most of its observations had, if no living one has it (ties to the smallest), else that of its first observation without such a name."""
        living = {o.name for o in self.components}
        votes = Counter(n for o in c.members.values() if (n := self.names.get(o)) is not None and n not in living)
        used = living | set(self.names.values())
        c.name = min(votes, key=lambda n: (-votes[n], n)) if votes else min((o for o in c.members.values() if o not in used), default=min(c.members.values()))

    @property
    def now(self) -> dict[str, float]:
        return self.limits[min(len(self.accepted), SETTLED)]

    def forbidden(self, a: Observation, b: Observation) -> bool:
        """Whether two observations were compared, clearly, and are no candidates of each other."""
        return frozenset((a[0], b[0])) in self.compared and frozenset((a, b)) not in self.candidates and (a, b[0]) not in self.ignored and (b, a[0]) not in self.ignored

    def put(self, pair: frozenset, edge: tuple[Point, float]) -> None:
        self.free[pair], self.born[pair] = edge, len(self.accepted)
        for o in pair:
            self.at.setdefault(o, set()).add(pair)

    def drop(self, pair: frozenset) -> None:
        del self.free[pair], self.born[pair]
        for o in pair:
            self.at[o].discard(pair)

    def use(self, c: Component) -> None:
        """Edges of a component's observations are no longer free."""
        for o in c.members.values():
            for pair in list(self.at.get(o, ())):
                self.drop(pair)

    def bad(self, c: Component) -> bool:
        return c.confidence < self.now["component_confidence"] or len(c.edges) < MIN_EDGES

    def join(self, c: Component, o: Observation) -> bool:
        """Adds an observation to a component by its sure and near edges, or puts it in the place of the one member that is against it; tells whether."""
        if o[0] in c.members:
            return False
        good, against = {}, []
        for m in c.members.values():
            pair = frozenset((o, m))
            edge = self.free.get(pair)
            if edge is None:
                if self.forbidden(o, m):
                    against.append(m)
            elif edge[1] >= self.now["conflict_confidence"] and _apart(edge[0], c.centre) <= self.now["radius"]:
                good[pair] = edge
            else:
                against.append(m)
        if not good or len(against) > 1:
            return False
        total = sum(x for _, x in good.values())
        if against:
            old = [pair for pair in c.edges if against[0] in pair]
            if len(good) < REPLACING or total - sum(c.edges[pair][1] for pair in old) <= IMPROVEMENT:
                return False
            del c.members[against[0][0]]
            for pair in old:
                del c.edges[pair]
        elif total / len(good) < self.now["addition_confidence"]:
            return False
        c.members[o[0]] = o
        c.edges.update(good)
        c.settle()
        return True

    def grow(self, seed: frozenset) -> Component:
        """The component of the best free edge and all observations that join it, the nearest first."""
        c = Component({o[0]: o for o in seed}, {seed: self.free[seed]})
        c.settle()
        while True:
            near: dict[Observation, float] = {}
            for m in c.members.values():
                for pair in self.at[m]:
                    if pair not in c.edges:
                        (o,) = pair - {m}
                        if o[0] not in c.members:
                            far = _apart(self.free[pair][0], c.centre)
                            near[o] = min(far, near.get(o, far))
            if not any(self.join(c, o) for o in sorted(near, key=lambda o: (near[o], o))):
                return c

    def audit(self, new: dict[frozenset, tuple[Point, float]]) -> dict[frozenset, tuple[Point, float]]:
        """Dissolves bad components, pairs of them at one place, and the weakest beyond the most observations of a frame; gives their edges."""
        gone = {id(c) for c in self.components if self.bad(c)}
        for k, a in enumerate(self.components):
            for b in self.components[k + 1 :]:
                if _apart(a.centre, b.centre) <= DISSOLVE:
                    gone |= {id(a), id(b)}
        seen: dict[int, set[Observation]] = {}
        for o in [*(o for c in self.components for o in c.members.values()), *(o for pair in new for o in pair)]:
            seen.setdefault(o[0], set()).add(o)
        rest = sorted((c for c in self.components if id(c) not in gone), key=lambda c: (c.confidence, sorted(c.members.values())))
        gone |= {id(c) for c in rest[: max(0, len(rest) - max(map(len, seen.values()), default=0))]}
        released = {pair: edge for c in self.components if id(c) in gone for pair, edge in c.edges.items()}
        self.components = [c for c in self.components if id(c) not in gone]
        return released

    def resolve(self, new: dict[frozenset, tuple[Point, float]], on_rays: dict[Observation, list[Component]]) -> None:
        """Takes the edges of a newly accepted frame: audit, joining by rays, attaching by place, trimming, growing."""
        for pair, edge in new.items():
            self.put(pair, edge)
        released = self.audit(new)
        for pair, edge in released.items():
            self.put(pair, edge)
        merged = set()
        for o, components in on_rays.items():
            for c in components:
                if c in self.components and self.join(c, o):
                    self.use(c)
                    merged.add(o)
                    break
        for pair, (place, _) in sorted((new | released).items(), key=lambda x: (-x[1][1], sorted(x[0]))):
            if pair & merged:
                continue
            near = sorted((far, k) for k, c in enumerate(self.components) if (far := _apart(place, c.centre)) <= self.now["radius"])
            for _, k in near:
                c = self.components[k]
                if any([self.join(c, o) for o in sorted(pair)]):
                    self.use(c)
                    break
        if len(self.free) > FREE_EDGES:
            age = lambda pair: len(self.accepted) - self.born[pair]
            order = sorted(self.free, key=lambda p: (-(self.free[p][1] + BONUS / (age(p) + 1)), age(p), -self.free[p][1], sorted(p)))
            for pair in order[FREE_EDGES:]:
                self.drop(pair)
        for seed in sorted(self.free, key=lambda p: (-self.free[p][1], sorted(p))):
            if seed in self.free and self.likely(seed):
                c = self.grow(seed)
                if not self.bad(c):
                    self.christen(c)
                    self.components.append(c)
                    self.use(c)
        for c in self.components:
            self.names.update(dict.fromkeys(c.members.values(), c.name))

    def likely(self, seed: frozenset) -> bool:
        """Whether any sure edge meets the seed: without one nothing joins it."""
        return any(self.free[pair][1] >= self.now["conflict_confidence"] for o in seed for pair in self.at[o] if pair != seed)

    def objects(self) -> list[Component]:
        """The components after the last frame, the surest first. Those that the next audit would find at the place of a surer one are the same object, and so are those that lie within the radius of a surer one and that no frame tells from it."""
        out: list[Component] = []
        for c in sorted(self.components, key=lambda c: (-c.confidence, sorted(c.members.values()))):
            if not any(self.same(c, o) for o in out):
                out.append(c)
        return out

    def same(self, c: Component, o: Component) -> bool:
        """Whether two components are one object: at one place, or near, of different frames, and without observations that are against each other."""
        far = _apart(c.centre, o.centre)
        if far <= DISSOLVE or far > self.now["radius"]:
            return far <= DISSOLVE
        return not c.members.keys() & o.members.keys() and not any(self.forbidden(a, b) for a in c.members.values() for b in o.members.values())

    def see(self, frame: int, observations: dict[int, dict], earlier: list[int], candidates: dict[int, list[dict]]) -> bool:
        """Compares a frame with accepted earlier ones and takes its edges, or rejects it; tells which."""
        limits = self.limits[min(len(self.accepted) + 1, SETTLED)]
        earlier = [g for g in earlier if g in self.accepted]
        on_rays = {}
        for det, r in observations.items():
            near = sorted((far, k) for k, c in enumerate(self.components) if frame not in c.members and (far := _off_ray(r, c.centre)) <= limits["radius"])
            on_rays[frame, det] = [self.components[k] for _, k in near]
        new, pairs, ignored, sizes = {}, set(), set(), {g: self.sizes[g] for g in earlier}
        for g in earlier:
            rows = [r for r in candidates.get(g, ()) if r["distance"] <= limits["forbidden"]]
            support: dict[Observation, int] = {}
            for r in rows:
                if r["distance"] <= limits["epsilon"]:
                    for o in ((g, r["a_det_id"]), (frame, r["b_det_id"])):
                        support[o] = support.get(o, 0) + 1
            unclear = {o for o, n in support.items() if n > _ceil_root(sizes[g] if o[0] == frame else len(observations))}
            ignored |= {(o, g if o[0] == frame else frame) for o in unclear}
            for r in rows:
                a, b = (g, r["a_det_id"]), (frame, r["b_det_id"])
                if a in unclear or b in unclear:
                    continue
                pair = frozenset((a, b))
                pairs.add(pair)
                if r["distance"] <= limits["epsilon"] and r["inside"]:
                    sure = min(1.0, max(0.0, (1 - r["distance"] / limits["epsilon"]) * 2.5)) if limits["epsilon"] > 0 else 0.0
                    c = r["a_conf"] * r["b_conf"] * sure * r["angle_conf"]
                    low = limits["min_confidence"]
                    new[pair] = (r["x"], r["y"], r["z"]), min(1.0, max(0.0, (c - low) / (BEST - low)))
        supported = {o for pair in new for o in pair if o[0] == frame}
        if len(self.accepted) >= WARM_UP and (not observations or (len(observations) - len(supported)) * 10 > len(observations) * UNSUPPORTED):
            return False
        self.accepted.append(frame)
        self.sizes[frame] = len(observations)
        self.compared |= {frozenset((frame, g)) for g in earlier}
        self.candidates |= pairs
        self.ignored |= ignored
        self.resolve(new, on_rays)
        return True


def saved(zone: Zone) -> dict[str, str]:
    """A zone in parts, as text: one for each accepted frame (what it was compared with), one for each component, the free edges, and the names."""
    frames = {f: {"n": zone.sizes[f], "with": [], "pairs": [], "ignored": []} for f in zone.accepted}
    for pair in zone.compared:
        frames[max(pair)]["with"].append(min(pair))
    for pair in zone.candidates:
        (g, a), (f, b) = sorted(pair)
        frames[f]["pairs"].append((g, a, b))
    for o, frame in zone.ignored:
        frames[max(o[0], frame)]["ignored"].append((*o, frame))
    edges = lambda some: [[*sum(sorted(pair), ()), *place, conf] for pair, (place, conf) in some.items()]
    out = {f"frame {k} {f}": json.dumps({c: sorted(x) if isinstance(x, list) else x for c, x in v.items()}) for k, (f, v) in enumerate(frames.items())}
    out |= {f"component {'%d:%d' % c.name if c.name else k}": json.dumps({"at": k, "name": c.name, "members": sorted(c.members.values()), "edges": edges(c.edges)}) for k, c in enumerate(zone.components)}
    free = [[*row, zone.born[frozenset((tuple(row[:2]), tuple(row[2:4])))]] for row in edges(zone.free)]
    return out | {"free": json.dumps(free), "names": json.dumps([[*o, *n] for o, n in zone.names.items()])}


def restored(limits: list[dict[str, float]], parts: Iterable[tuple[str, str]]) -> Zone:
    """The zone that was saved."""
    zone, frames, components = Zone(limits), [], []
    pair_of = lambda row: frozenset((tuple(row[:2]), tuple(row[2:4])))
    free: list[list] = []
    for key, text in parts:
        kind, _, rest = key.partition(" ")
        held = json.loads(text)
        if kind == "frame":
            frames.append((*map(int, rest.split()), held))
        elif kind == "component":
            c = Component({m[0]: tuple(m) for m in held["members"]}, {pair_of(r): (tuple(r[4:7]), r[7]) for r in held["edges"]}, name=tuple(held["name"]) if held["name"] else None)
            c.settle()
            components.append((held["at"], c))
        elif kind == "free":
            free = held
        elif kind == "names":
            zone.names = {tuple(r[:2]): tuple(r[2:]) for r in held}
    for _, frame, held in sorted(frames, key=lambda x: x[0]):
        zone.accepted.append(frame)
        zone.sizes[frame] = held["n"]
        zone.compared |= {frozenset((frame, g)) for g in held["with"]}
        zone.candidates |= {frozenset(((g, a), (frame, b))) for g, a, b in held["pairs"]}
        zone.ignored |= {((f, d), g) for f, d, g in held["ignored"]}
    zone.components = [c for _, c in sorted(components, key=lambda x: x[0])]
    for row in free:
        pair = pair_of(row)
        zone.free[pair], zone.born[pair] = (tuple(row[4:7]), row[7]), row[8]
        for o in pair:
            zone.at.setdefault(o, set()).add(pair)
    return zone


def met_rays(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_conf: np.ndarray, b_conf: np.ndarray, box: np.ndarray, most: float) -> list[dict]:
    """Candidates of two frames of a zone: their rays (origin and direction, a row each) that pass within `most`, as ray_candidates has them."""
    o1, d1, o2, d2 = a[:, None, :3], a[:, None, 3:], b[None, :, :3], b[None, :, 3:]
    dot = lambda x, y: (x * y).sum(-1)
    w = o1 - o2
    qa, qb, qc, qd, qe = dot(d1, d1), dot(d1, d2), dot(d2, d2), dot(d1, w), dot(d2, w)
    den = qa * qc - qb * qb
    sound = np.abs(den) > v.PARALLEL
    den = np.where(sound, den, 1.0)
    t1, t2 = (qb * qe - qc * qd) / den, (qa * qe - qb * qd) / den
    for t in (t1, t2):
        sound &= (t > v.MIN_DEPTH) & (t < v.MAX_DEPTH)
    p, q = o1 + d1 * t1[..., None], o2 + d2 * t2[..., None]
    apart, middle = np.sqrt(dot(p - q, p - q)), (p + q) / 2
    angle = np.clip(2 * np.sqrt((np.cross(np.broadcast_to(d1, p.shape), np.broadcast_to(d2, p.shape)) ** 2).sum(-1)), 0, 1)
    inside = ((middle >= box[0]) & (middle <= box[1])).all(-1)
    rows, columns = np.nonzero(sound & (apart <= most))
    return [
        {"a_det_id": int(a_ids[i]), "b_det_id": int(b_ids[j]), "a_conf": float(a_conf[i]), "b_conf": float(b_conf[j]), "distance": float(apart[i, j]), "angle_conf": float(angle[i, j]), **dict(zip("xyz", map(float, middle[i, j]))), "inside": bool(inside[i, j])}
        for i, j in zip(rows.tolist(), columns.tolist())
    ]


def _ceil_root(n: int) -> int:
    k = int(n**0.5)
    return k if k * k >= n else k + 1


def _off_ray(r: dict, p: Point) -> float:
    """Distance of a point from an observation's forward ray; from its origin where the point lies behind."""
    to = p[0] - r["ox"], p[1] - r["oy"], p[2] - r["oz"]
    t = max(0.0, to[0] * r["dx"] + to[1] * r["dy"] + to[2] * r["dz"])
    return _apart(to, (t * r["dx"], t * r["dy"], t * r["dz"]))


def compared_frames(frame: int, pose: np.ndarray, earlier: dict[int, np.ndarray]) -> list[int]:
    """The earlier frames (frame to pose: translation and viewing direction) that a frame is compared with, as fuse.frame_pairs chooses them; frames count as in order of their ids."""
    far = lambda p: round(float(np.linalg.norm(p[:3] - pose[:3]) + (1 - np.clip(p[3:] @ pose[3:], -1, 1)) * 0.5), 9)
    ranked = sorted(earlier, key=lambda g: (-far(earlier[g]), g))
    return sorted(g for rank, g in enumerate(ranked) if fuse.is_compared(rank, g, frame))


RESOLVED = "zone_id long, component_id long, frame_id long, det_id long, x double, y double, z double, confidence double, edges long, name string"
_SEEN, _PAIRED = ("frame_id", "det_id", "ox", "oy", "oz", "dx", "dy", "dz", "earlier"), ("a_frame_id", "a_det_id", "b_frame_id", "b_det_id", "a_conf", "b_conf", "distance", "angle_conf", "x", "y", "z", "inside")


@cache
def _limits(session) -> list[dict[str, float]]:
    """The thresholds after so many accepted frames, up to SETTLED."""
    rows = session.range(SETTLED + 1).select("id", *(c.alias(k) for k, c in v.thresholds(F.col("id")).items())).orderBy("id").collect()
    return [r.asDict() for r in rows]


def count_objects(rays: DataFrame, pairs: DataFrame, candidates: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each member of each component of every zone, after all its frames in order. component_id is a rank; name (a frame and a detection) stays with an object when its component dissolves and grows again.

    rays: zone_id, frame_id, det_id, o*, d*. pairs: first_frame, second_frame
    to be compared. candidates: ray_candidates of the same, at the widest
    thresholds; they tighten as frames are accepted, and rejected frames are as
    never seen. boxes: bounds of each zone. A zone is folded in one task that
    holds its observations and candidates: a place in a scene, whose size does
    not grow with the number of zones. Zones without frames give nothing.
    """
    earlier = pairs.groupBy(F.col("second_frame").alias("frame_id")).agg(F.array_sort(F.collect_set("first_frame")).alias("earlier"))
    seen = rays.join(earlier, "frame_id", "left").select(F.col("zone_id").alias("zone"), *_SEEN)
    paired = candidates.join(boxes, "zone_id").withColumn("inside", v.inside(v.vec(""), v.box())).select("zone_id", *_PAIRED)
    limits = _limits(rays.sparkSession)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        zone, frames, met = Zone(limits), {}, {}
        for r in left.to_pylist():
            frames.setdefault(r["frame_id"], {})[r["det_id"]] = r
        for r in right.to_pylist():
            met.setdefault(r["b_frame_id"], {}).setdefault(r["a_frame_id"], []).append(r)
        for frame in sorted(frames):
            zone.see(frame, dict(sorted(frames[frame].items())), next(iter(frames[frame].values()))["earlier"] or [], met.get(frame, {}))
        rows = [(key[0].as_py(), n, *o, *c.centre, c.confidence, len(c.edges), "%d:%d" % c.name) for n, c in enumerate(zone.objects()) for o in sorted(c.members.values())]
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        return pa.table({x.split()[0]: pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, x in enumerate(RESOLVED.split(", "))})

    return seen.groupBy("zone").cogroup(paired.groupBy("zone_id")).applyInArrow(run, RESOLVED)
