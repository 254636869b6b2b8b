"""Operators that carry a growing state from one micro-batch to the next; each ends where its batch version ends on the same rows.

They need the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`
set to STORE. State is kept under the query's checkpoint, so a lost executor's
share is restored elsewhere. Where a state is forgotten after a time, the
engine runs batches for that alone, so such a query is stopped by hand:
availableNow ends only with `forget` None.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parallaxis.functions import vec as v
from parallaxis.operators import merging, triangulate

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(time: str | None) -> int | None:
    return int(pd.Timedelta(time).total_seconds() * 1000) if time else None


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> Iterator[Any]:
    """One key's rows of a micro-batch, in order."""
    return pd.concat(list(batches)).sort_values(list(order)).itertuples()


COUNTS = "session_id long, zone_id long, total long, queued long, processing long, completed long, failed long"
_STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")


class _Requests(StatefulProcessor):
    """Of each request the last working event, the first deletion and the beginning of work: whatever order they come in, the same."""

    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ("last_us", "last_seq", "begun_us", "begun_seq", "gone_us", "gone_seq")
        self.requests = handle.getMapState("requests", "request_id long", "working string, " + ", ".join(f"{f} long" for f in fields), self.forget)
        self.counts = handle.getValueState("counts", ", ".join(f"{s.lower()} long" for s in _STATES))

    @staticmethod
    def state(held: tuple | None) -> str | None:
        """The present state; None for a request that was deleted before work on it began."""
        if held is None:
            return None
        working, _, _, *rest = held
        begun, gone = tuple(rest[:2]), tuple(rest[2:])
        return None if gone[0] is not None and (begun[0] is None or gone < begun) else working

    @staticmethod
    def after(held: tuple | None, state: str, at: tuple[int, int]) -> tuple:
        working, last_us, last_seq, *rest = held or (None,) * 7
        begun, gone = tuple(rest[:2]), tuple(rest[2:])
        if state == "DELETE":
            gone = at if gone[0] is None else min(gone, at)
        else:
            if last_us is None or at > (last_us, last_seq):
                working, last_us, last_seq = state, *at
            if state != "QUEUED":
                begun = at if begun[0] is None else min(begun, at)
        return (working, last_us, last_seq, *begun, *gone)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = dict(zip(_STATES, self.counts.get() if self.counts.exists() else (0,) * 4))
        for r in _rows(rows, "us", "seq"):
            own = (int(r.request_id),)
            held = self.requests.getValue(own) if self.requests.containsKey(own) else None
            now = self.after(held, r.state, (int(r.us), int(r.seq)))
            for state, by in ((self.state(held), -1), (self.state(now), 1)):
                if state is not None:
                    counts[state] += by
            self.requests.updateValue(own, now)
        self.counts.update(tuple(counts.values()))
        yield pd.DataFrame([(*key, sum(counts.values()), *counts.values())], columns=_names(COUNTS))


def request_counts(events: DataFrame, forget: str | None = "7 days") -> DataFrame:
    """total, queued, processing, completed, failed of each zone of a session whenever an event of it comes: requests by their present state, each counted once and taken out of the state it leaves.

    events: session_id, zone_id, request_id, ts, seq, state (QUEUED, PROCESSING,
    COMPLETED, FAILED, or DELETE, which counts only before work began). Events
    may come late and twice. State is seven numbers a request, which go when no
    event of it came for `forget`; it stays counted.
    """
    rows = events.select("session_id", "zone_id", "request_id", F.unix_micros("ts").alias("us"), "seq", "state")
    return rows.groupBy("session_id", "zone_id").transformWithStateInPandas(_Requests(_ms(forget)), COUNTS, "Update", "ProcessingTime" if forget else "None")


PLACED = "session_id long, seq long, point_id long, zone_id long, what string"


class _Corrections(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, seq long", "op string, point_id long, zone_id long, zones array<long>")
        self.points = handle.getMapState("points", "point_id long", "zone_id long, zones array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x is None or x != x else int(x)
        due = set()
        for r in _rows(rows, "us", "seq"):
            self.waiting.updateValue((int(r.us), int(r.seq)), (r.op, number(r.point_id), number(r.zone_id), None if r.zones is None else [int(z) for z in r.zones]))
            due.add(int(r.us) // 1000 + 1)
        for ms in due:
            self.handle.registerTimer(ms)
        yield pd.DataFrame([], columns=_names(PLACED))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Applies what has waited until now: nothing earlier can come any more."""
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for at, event in sorted((tuple(k), tuple(e)) for k, e in self.waiting.iterator() if k[0] < until):
            self.waiting.removeKey(at)
            out += [(key[0], at[1], *row) for row in self.apply(*event)]
        yield pd.DataFrame(out, columns=_names(PLACED)).astype({"point_id": "Int64", "zone_id": "Int64"})

    def apply(self, op: str, point: int | None, zone: int | None, zones: list[int] | None) -> list[tuple]:
        held = self.points.getValue((point,)) if point is not None and self.points.containsKey((point,)) else None
        if op == "add" and point is not None:
            place = zone if zone is not None else zones[0] if zones else None
            self.points.updateValue((point,), (place, zones))
            return [(point, place, "placed")]
        if op == "rotate" and held is not None:
            around = list(held[1] or [])
            place = None if not around else around[(around.index(held[0]) + 1) % len(around)] if held[0] in around else around[0]
            self.points.updateValue((point,), (place, around))
            return [(point, place, "placed")]
        gone: list[int] = []
        if op == "delete" and held is not None:
            gone = [point]
        elif op in ("delete_zone", "reset"):
            gone = sorted(k[0] for k, p in self.points.iterator() if op == "reset" or (zone is not None and p[0] == zone))
        for p in gone:
            self.points.removeKey((p,))
        return [(p, None, "removed") for p in gone]


def corrections(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Every placing and removal of a point by a session's corrections, applied in order of (ts, seq) however they come.

    events: session_id, ts, seq, op (add, rotate, delete, delete_zone, reset),
    point_id, zone_id, zones (the point's zones, nearest first). An event waits
    until the watermark passes it; later ones than that are dropped by the
    engine. State is the waiting events and the points of a session; a reset
    clears its points. The last row of a point tells where it is.
    """
    rows = events.withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("us"), "seq", "op", "point_id", "zone_id", "zones")
    return rows.groupBy("session_id").transformWithStateInPandas(_Corrections(), PLACED, "Append", "EventTime")


class _Zones(StatefulProcessor):
    def __init__(self, forget: int | None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = "points array<double>, confidences array<double>, outlines array<array<double>>, cameras array<double>, plane array<double>, quiet int"
        self.zones = handle.getMapState("zones", "zone_id long", held, self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows_of = lambda flat: np.array(flat, float).reshape(-1, 3)
        flat = lambda a: [float(x) for x in np.asarray(a).reshape(-1)]
        zones = []
        for (zone_id,), (points, confidences, outlines, cameras, plane, quiet) in self.zones.iterator():
            seen = [(c, rows_of(o), np.array(t)) for c, o, t in zip(confidences, outlines, rows_of(cameras))]
            zones.append(merging.Merged(zone_id, rows_of(points), seen, (np.array(plane[:3]), np.array(plane[3:])), quiet))
        zones.sort(key=lambda z: z.zone_id)
        before = {z.zone_id: z for z in zones}
        out = []
        for r in _rows(rows, "seq"):
            points, outline = ([(p["x"], p["y"], p["z"]) for p in x] for x in (r.points, r.outline))
            zones, row = merging.fold(zones, int(r.seq), float(r.confidence), rows_of(points), rows_of(outline), np.array([r.tx, r.ty, r.tz]))
            out.append((key[0], int(r.seq), *row))
        for z in zones:
            if before.get(z.zone_id) is not z:
                self.zones.updateValue((z.zone_id,), (flat(z.points), [float(c) for c, _, _ in z.seen], [flat(o) for _, o, _ in z.seen], flat([t for _, _, t in z.seen]), flat(z.plane), int(z.quiet)))
        yield pd.DataFrame(out, columns=_names(merging.DECISIONS)).astype({"zone_id": "Int64"})


def merge_zones(detections: DataFrame, forget: str | None = "1 day") -> DataFrame:
    """What becomes of each detected zone, as merging.merge_zones tells it, with a session's zones carried between micro-batches. Zones that didn't change for `forget` go. Rows of a micro-batch go by seq."""
    rows = detections.select("session_id", "seq", "confidence", "points", "outline", "tx", "ty", "tz")
    return rows.groupBy("session_id").transformWithStateInPandas(_Zones(_ms(forget)), merging.DECISIONS, "Append", "ProcessingTime" if forget else "None")


class _LastValues(StatefulProcessor):
    def __init__(self, keys: list[str], value: str, kind: str):
        self.keys, self.value, self.kind = keys, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"us long, seq long, value {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        *_, newest = _rows(rows, "us", "seq")
        at = (int(newest.us), int(newest.seq))
        value = newest.value if newest.value is not None and newest.value == newest.value else None
        value = value.item() if hasattr(value, "item") else value
        out = []
        if held is None or at > tuple(held[:2]):
            self.last.update((*at, value))
            was = held[2] if held is not None else None
            if held is None or was != value:
                out = [(*key, was, value)]
        yield pd.DataFrame(out, columns=[*self.keys, "was", "now"], dtype=object)


def changed_values(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, was, now of the keys whose value is another after a micro-batch than before it; new ones were null. values: keys, ts, seq, value; the value of the latest (ts, seq) is a key's, and older ones that come later change nothing. State is one value a key."""
    kind = values.schema[value].dataType.simpleString()
    rows = values.select(*keys, F.unix_micros("ts").alias("us"), "seq", F.col(value).alias("value"))
    schema = ", ".join([*(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys), f"was {kind}", f"now {kind}"])
    return rows.groupBy(*keys).transformWithStateInPandas(_LastValues(list(keys), value, kind), schema, "Update", "None")


VIEWS = "session_id long, zone_id long, frame_id long, decision string"
#: What a view is told by in the state: direction from the zone, place in its plane, distance, coverage, and whether it was sent.
_VIEW = "dx double, dy double, dz double, px double, py double, distance double, coverage double, sent boolean"


class _Views(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "frame_id long", _VIEW)
        self.placed = handle.getValueState("placed", "placed boolean")

    @staticmethod
    def alike(a: tuple, b: tuple) -> bool:
        from parallaxis.operators.placement import DIFFERENT_DEGREES, DIFFERENT_SHIFT

        size = lambda x: sum(c * c for c in x) ** 0.5
        cosine = sum(x * y for x, y in zip(a[:3], b[:3])) / max(size(a[:3]) * size(b[:3]), 1e-12)
        turn = float(np.degrees(np.arccos(min(1.0, max(-1.0, cosine)))))
        shift = ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5 / max((a[5] + b[5]) / 2, 1e-3)
        return round(turn / DIFFERENT_DEGREES + shift / DIFFERENT_SHIFT, 6) <= 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: tuple(x) for k, x in self.kept.iterator()}
        before, placed, out = dict(kept), self.placed.exists(), []
        for r in _rows(rows, "us", "kind", "frame_id"):
            if r.kind == "placed":
                if not placed:
                    placed = True
                    self.placed.update((True,))
                    out += [(*key, f, "submitted") for f in sorted(kept) if not kept[f][7]]
                    kept = {f: (*x[:7], True) for f, x in kept.items()}
                continue
            frame = int(r.frame_id)
            new = (*(float(getattr(r, c)) for c in ("dx", "dy", "dz", "px", "py", "distance", "coverage")), placed)
            same = [f for f, x in kept.items() if self.alike(new, x)]
            if r.angle >= 75 or r.coverage <= 0.3:
                decision = "poor"
            elif not same:
                decision = "added"
            elif all(new[6] > kept[f][6] for f in same):
                decision = "replaced"
            else:
                decision = "skipped"
            out.append((*key, frame, decision))
            if decision in ("added", "replaced"):
                for f in sorted(same):
                    out.append((*key, f, "cancelled" if kept.pop(f)[7] else "dropped"))
                kept[frame] = new
                if placed:
                    out.append((*key, frame, "submitted"))
        for f in before.keys() - kept.keys():
            self.kept.removeKey((f,))
        for f, x in kept.items():
            if before.get(f) != x:
                self.kept.updateValue((f,), x)
        yield pd.DataFrame(out, columns=_names(VIEWS))


def best_views(views: DataFrame) -> DataFrame:
    """Decisions of a best-view store, and what they ask of the request queue.

    views: session_id, zone_id, kind (view or placed), frame_id, us, angle, d*
    (direction from the zone to the camera), px, py (camera in the plane),
    distance, coverage. A view is poor, or is added if it is like none kept
    (placement.similar_views), replaces all that are like it if it covers
    strictly more than each, or is skipped. A kept view is submitted once its
    zone is placed, and waits until then; one that is replaced is cancelled if
    it was submitted, else dropped. State is the kept views of a zone: views
    unlike each other, so as many as fit around it.
    """
    own = ("session_id", "zone_id", "kind", "frame_id", "us", "angle", "dx", "dy", "dz", "px", "py", "distance", "coverage")
    return views.select(*own).groupBy("session_id", "zone_id").transformWithStateInPandas(_Views(), VIEWS, "Append", "None")


OBJECTS = "zone_id long, name string, x double, y double, z double, confidence double, members int, alive boolean"
_FRAME = ("det_ids", "confs", "ox", "oy", "oz", "dx", "dy", "dz")


class _Triangulation(StatefulProcessor):
    def __init__(self, limits: list[dict[str, float]], forget: int | None):
        self.limits, self.forget = limits, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part string", "held string", self.forget)
        self.frames = handle.getMapState("frames", "frame_id long", "pose array<double>, rays array<double>, det_ids array<long>, confs array<double>", self.forget)
        self.told = handle.getMapState("told", "name string", "x double, y double, z double, confidence double, members int", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: x[0] for k, x in self.parts.iterator()}
        zone = triangulate.restored(self.limits, held.items())
        frames = {k[0]: (np.array(pose), np.array(rays).reshape(-1, 6), np.array(ids, np.int64), np.array(confs)) for k, (pose, rays, ids, confs) in self.frames.iterator()}
        most = max(x["forbidden"] for x in self.limits)
        for r in _rows(rows, "frame_id"):
            frame, ids = int(r.frame_id), np.array(r.det_ids, np.int64)
            if frame in frames:
                continue  # the same result again
            pose = np.array([r.tx, r.ty, r.tz, r.fx, r.fy, r.fz], float)
            rays = np.column_stack([np.array(getattr(r, c), float) for c in _FRAME[2:]]).reshape(-1, 6)
            confs = np.array(r.confs, float)
            box = np.array([[r.minx, r.miny, r.minz], [r.maxx, r.maxy, r.maxz]])
            earlier = triangulate.compared_frames(frame, pose, {f: x[0] for f, x in frames.items() if f < frame})
            met = {g: triangulate.met_rays(frames[g][1], rays, frames[g][2], ids, frames[g][3], confs, box, most) for g in earlier if g in zone.sizes}
            seen = {int(d): dict(zip(_FRAME[2:], map(float, x))) for d, x in sorted(zip(ids.tolist(), rays.tolist()))}
            taken = zone.see(frame, seen, earlier, met)
            frames[frame] = (pose, rays, ids, confs) if taken else (pose, rays[:0], ids[:0], confs[:0])
            self.frames.updateValue((frame,), tuple([float(x) for x in a.reshape(-1)] if a.dtype.kind == "f" else [int(x) for x in a] for a in frames[frame]))
        now = triangulate.saved(zone)
        for part in held.keys() - now.keys():
            self.parts.removeKey((part,))
        for part, text in now.items():
            if held.get(part) != text:
                self.parts.updateValue((part,), (text,))
        told = {k[0]: tuple(x) for k, x in self.told.iterator()}
        objects = {"%d:%d" % c.name: (*c.centre, c.confidence, len(c.members)) for c in zone.objects()}
        out = [(key[0], n, *x, True) for n, x in objects.items() if told.get(n) != x]
        for n in told.keys() - objects.keys():
            out.append((key[0], n, *told[n], False))
            self.told.removeKey((n,))
        for n, x in objects.items():
            if told.get(n) != x:
                self.told.updateValue((n,), x)
        yield pd.DataFrame(out, columns=_names(OBJECTS))


def frame_results(rays: DataFrame, poses: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each frame of a zone, as a segmentation result comes: its observations' rays as arrays, the frame's pose and the zone's box. rays: zone_id, frame_id, det_id, conf, o*, d*; poses: frame_id, t*, f*; boxes: zone_id, min*, max*."""
    one = F.array_sort(F.collect_list(F.struct("det_id", "conf", "ox", "oy", "oz", "dx", "dy", "dz")))
    grouped = rays.groupBy("zone_id", "frame_id").agg(one.alias("o"))
    arrays = [F.col("o." + c).alias(n) for c, n in zip(("det_id", "conf", *_FRAME[2:]), _FRAME)]
    return grouped.select("zone_id", "frame_id", *arrays).join(poses.select("frame_id", "tx", "ty", "tz", "fx", "fy", "fz"), "frame_id").join(boxes.select("zone_id", *v.box()), "zone_id")


def count_objects(results: DataFrame, forget: str | None = "1 day") -> DataFrame:
    """Objects of each zone as its frames' results (frame_results) come in: rows of those that are new, have changed or are gone (alive).

    A zone's accepted frames with what they were compared with, its components
    and its free edges are carried between micro-batches, a part of the state
    each, of which only those that changed are written. After all frames, the
    last rows of the living are triangulate.count_objects' components. State
    is what a zone's frames saw, its components and FREE_EDGES edges; it goes
    when nothing of it changed for `forget`. Frames of a micro-batch go by
    frame_id; one that comes again changes nothing.
    """
    limits = triangulate._limits(results.sparkSession)
    return results.groupBy("zone_id").transformWithStateInPandas(_Triangulation(limits, _ms(forget)), OBJECTS, "Update", "ProcessingTime" if forget else "None")
