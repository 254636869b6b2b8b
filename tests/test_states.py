"""Streams that carry state between micro-batches, against their batch versions on the same rows."""

import random
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import corrections, fuse, merging, triangulate
from parallaxis.plans.fixtures import view
from parallaxis.streaming import sessions, states
from tests_helpers import cuboid

SF = "/root/testdata/sf0.001"
_names = count()


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, states.STORE)
    yield
    spark.conf.unset(key)


def in_files(spark, tmp_path, df, parts):
    """df as a stream of micro-batches: parts is a list of conditions, a file for each."""
    at = f"{tmp_path}/in{next(_names)}"
    for k, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{at}/{k:03}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def drain(spark, df, mode):
    """All rows that a stream puts out, in order of its micro-batches."""
    out = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    assert query.awaitTermination(170)
    return out


def in_thirds(n=3):
    return [f"part = {k}" for k in range(n)]


def test_request_counts(spark, tmp_path):
    draw = random.Random(1)
    rows = []
    for r in range(40):
        for state in draw.choice([["QUEUED", "PROCESSING", "COMPLETED"], ["QUEUED", "DELETE"], ["QUEUED", "PROCESSING", "DELETE", "FAILED"], ["QUEUED"], ["DELETE", "QUEUED", "PROCESSING"]]):
            rows.append((r % 2, r % 3, r, len(rows) * 1_000_000, len(rows), state, draw.randrange(3)))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "session_id long, zone_id long, request_id long, us long, seq long, state string, part int").withColumn("ts", F.timestamp_micros("us"))
    got = {(r.session_id, r.zone_id): tuple(r)[2:] for r in drain(spark, states.request_counts(in_files(spark, tmp_path, df, in_thirds()), None), "update")}
    zones = df.select("session_id", "request_id", "zone_id").distinct()
    now = corrections.lifecycle(df).join(zones, ["session_id", "request_id"]).filter("state <> 'DELETED'")
    want = {(r.session_id, r.zone_id): tuple(r)[2:] for r in corrections.status_counts(now).collect()}
    assert {k: x for k, x in got.items() if x[0]} == want


def test_request_events_are_counted_once_in_their_session(spark, tmp_path):
    rows = [(1, 5, 7, 10**9, "QUEUED", 0), (2, 5, 7, 10**9, "QUEUED", 0), (1, 5, 7, 10**9 + 1, "QUEUED", 1)]
    df = spark.createDataFrame(rows, "session_id long, zone_id long, request_id long, us long, state string, part int").withColumn("ts", F.timestamp_micros("us"))
    got = drain(spark, sessions.request_events(in_files(spark, tmp_path, df, in_thirds(2))), "complete")
    assert {(r.session_id, r.n) for r in got} == {(1, 1), (2, 1)}


def test_corrections_out_of_order(spark, tmp_path):
    draw = random.Random(2)
    rows = []
    for s in range(2):
        for k in range(120):
            op = draw.choice(["add"] * 4 + ["rotate"] * 4 + ["delete", "delete_zone"]) if k != 50 else "reset"
            point = draw.randrange(9) if op in ("add", "rotate", "delete") else None
            zone = draw.randrange(4) if op == "delete_zone" or (op == "add" and draw.random() < 0.5) else None
            zones = [(point + j) % 4 for j in range(3)] if point is not None else None
            rows.append((s, k * 1_000_000, k, op, point, zone, zones, min(2, max(0, k // 40 + draw.choice([-1, 0, 0, 0])))))
    rows.append((99, 10**12, 0, "reset", None, None, None, 3))  # what comes last lets the watermark pass the rest
    df = spark.createDataFrame(rows, "session_id long, us long, seq long, op string, point_id long, zone_id long, zones array<long>, part int").withColumn("ts", F.timestamp_micros("us"))
    got = {}
    for r in drain(spark, states.corrections(in_files(spark, tmp_path, df, in_thirds(4)), "10 minutes"), "append"):
        got[r.session_id, r.point_id] = r.zone_id if r.what == "placed" else "gone"
    nearest = df.filter("point_id is not null").select("point_id", "zones").distinct()
    want = {(r.session_id, r.point_id): r.zone_id for r in corrections.replay(df, nearest).collect()}
    assert {k: z for k, z in got.items() if z != "gone"} == want and "gone" in got.values()


def test_a_zone_is_deleted_with_the_points_that_are_in_it_then(spark):
    nearest = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1, 2])], "point_id long, zones array<long>")
    events = [(0, 1, "add", 1, 1), (0, 2, "delete_zone", None, 2), (0, 3, "rotate", 1, None), (0, 4, "add", 2, 1), (0, 5, "delete_zone", None, 1), (0, 6, "rotate", 2, None), (0, 7, "add", 3, None)]
    df = spark.createDataFrame(events, "session_id long, seq long, op string, point_id long, zone_id long")
    assert {(r.point_id, r.zone_id) for r in corrections.replay(df, nearest).collect()} == {(1, 2), (3, 1)}


def test_zones_merge_over_micro_batches(spark, tmp_path):
    vector = "array<struct<x: double, y: double, z: double>>"
    rows = [cuboid(1, 0, 0.0, 0.0), cuboid(1, 1, 10.0, 0.0), *(cuboid(1, k, 0.05, 0.0) for k in range(2, 6)), cuboid(1, 6, 0.0, 0.1), cuboid(1, 7, 9.9, 0.0, size=3.0), cuboid(2, 0, 0.0, 0.0)]
    rows.append((1, 8, 0.5, [{"x": 1.0, "y": 1.0, "z": 1.0}] * 3, [], 0.0, 0.0, 5.0))
    df = spark.createDataFrame(rows, f"session_id long, seq long, confidence double, points {vector}, outline {vector}, tx double, ty double, tz double")
    got = drain(spark, states.merge_zones(in_files(spark, tmp_path, df, ["seq < 2", "seq between 2 and 3", "seq = 4", "seq > 4"]), None), "append")
    assert sorted(map(tuple, got)) == sorted(map(tuple, merging.merge_zones(df).collect()))


def test_best_views_ask_for_requests_and_cancel_them(spark, tmp_path):
    schema = "session_id long, zone_id long, kind string, frame_id long, us long, angle double, dx double, dy double, dz double, px double, py double, distance double, coverage double, part int"
    seen = lambda frame, turn, coverage, part, angle=40.0, zone=1: (1, zone, "view", frame, frame, angle, float(np.sin(np.radians(turn))), 0.0, float(np.cos(np.radians(turn))), float(np.sin(np.radians(turn))), 0.0, 3.0, coverage, part)
    rows = [
        seen(1, 40, 0.5, 0), seen(2, 41, 0.4, 0), seen(3, 41, 0.6, 1),  # 1 is replaced while it waits
        seen(4, -40, 0.4, 1),  # opposite at the same angle to the normal: another view
        (1, 1, "placed", -1, 5, *[0.0] * 8, 2), seen(6, 40, 0.7, 2), seen(7, 80, 0.9, 2, angle=80.0), seen(8, 40, 0.7, 3), seen(9, 0, 0.5, 3), seen(1, 0, 0.9, 0, zone=2),
    ]
    df = spark.createDataFrame(rows, schema)
    got = drain(spark, states.best_views(in_files(spark, tmp_path, df, in_thirds(4))), "append")
    first = [(r.frame_id, r.decision) for r in got if r.zone_id == 1]
    assert first == [(1, "added"), (2, "skipped"), (3, "replaced"), (1, "dropped"), (4, "added"), (3, "submitted"), (4, "submitted"), (6, "replaced"), (3, "cancelled"), (6, "submitted"), (7, "poor"), (8, "skipped"), (9, "added"), (9, "submitted")]
    assert [(r.frame_id, r.decision) for r in got if r.zone_id == 2] == [(1, "added")]
    # what is asked for, as events of the request queue, after work on frame 4 began
    asked = [(r.session_id, r.zone_id, r.frame_id, k * 1_000_000, k, {"submitted": "QUEUED", "cancelled": "DELETE"}[r.decision], 0) for k, r in enumerate(got) if r.decision in ("submitted", "cancelled")]
    asked += [(1, 1, 4, 10**9, 50, "PROCESSING", 1), (1, 1, 4, 2 * 10**9, 51, "DELETE", 1)]
    events = spark.createDataFrame(asked, "session_id long, zone_id long, request_id long, us long, seq long, state string, part int").withColumn("ts", F.timestamp_micros("us"))
    counts = drain(spark, states.request_counts(in_files(spark, tmp_path, events, in_thirds(2)), None), "update")
    assert tuple(counts[-1]) == (1, 1, 3, 2, 1, 0, 0)


def test_changed_values(spark, tmp_path):
    rows = [(1, 0, 0, 5, 0), (2, 0, 1, None, 0), (1, 1, 2, 5, 1), (2, 1, 3, 7, 1), (1, 2, 4, 6, 2), (1, 3, 5, 8, 2), (2, 0, 0, 9, 2)]
    df = spark.createDataFrame(rows, "zone_id long, us long, seq long, n long, part int").withColumn("ts", F.timestamp_micros("us"))
    got = drain(spark, states.changed_values(in_files(spark, tmp_path, df, in_thirds()), "n", "zone_id"), "update")
    assert [tuple(r) for r in got if r.zone_id == 1] == [(1, None, 5), (1, 5, 8)] and [tuple(r) for r in got if r.zone_id == 2] == [(2, None, None), (2, None, 7)]


def scene(spark):
    rays = fuse.with_rays(fuse.trim_weak(view(spark, SF, "obs")))
    poses = view(spark, SF, "cams").withColumn("session_id", F.lit(0))
    return rays, poses, view(spark, SF, "zones").select("zone_id", "minx", "maxx", "miny", "maxy", "minz", "maxz")


def test_objects_frame_by_frame(spark, tmp_path):
    """A scene's frames in five micro-batches give the components of one batch, with the names that they have there."""
    rays, poses, boxes = scene(spark)
    pairs = fuse.frame_pairs(poses)
    want = {(r.zone_id, r.name, round(r.x, 6), round(r.y, 6), r.n) for r in triangulate.count_objects(rays, pairs, fuse.ray_candidates(rays, pairs), boxes).groupBy("zone_id", "name").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.count("*").alias("n")).collect()}
    results = states.frame_results(rays, poses, boxes)
    got, changes = {}, 0
    for r in drain(spark, states.count_objects(in_files(spark, tmp_path, results, [f"frame_id between {5 * k} and {5 * k + 4}" for k in range(5)]), None), "update"):
        changes += 1
        got[r.zone_id, r.name] = (r.zone_id, r.name, round(r.x, 6), round(r.y, 6), r.members) if r.alive else None
    assert {x for x in got.values() if x} == want and len(want) == 10 and changes > len(want)


def test_a_saved_zone_is_the_same():
    limits = [{"epsilon": 0.05, "forbidden": 0.1, "min_confidence": 0.0, "radius": 0.03, "conflict_confidence": 0.7, "addition_confidence": 0.5, "component_confidence": 1.5}] * (triangulate.SETTLED + 1)
    draw = np.random.default_rng(0)
    objects = draw.uniform(-0.5, 0.5, (6, 3))
    zone, at, rays = triangulate.Zone(limits), {}, {}
    box = np.array([[-2.0] * 3, [2.0] * 3])
    for f in range(9):
        eye = np.array([1.2 * (f % 3) - 1.2, 1.1 * (f // 3) - 1.1, 3.0])
        d = objects - eye
        rays[f] = np.column_stack([np.broadcast_to(eye, d.shape), d / np.linalg.norm(d, axis=1)[:, None]])
        ids, conf = np.arange(6), np.full(6, 0.9)
        met = {g: triangulate.met_rays(rays[g], rays[f], ids, ids, conf, conf, box, 0.1) for g in range(f)}
        seen = {k: dict(zip(("ox", "oy", "oz", "dx", "dy", "dz"), rays[f][k])) for k in range(6)}
        zone.see(f, seen, list(range(f)), met)
        parts = triangulate.saved(zone)
        zone = triangulate.restored(limits, random.Random(f).sample(sorted(parts.items()), len(parts)))
        assert triangulate.saved(zone) == parts
        at[f] = {c.name for c in zone.components}
    assert len(zone.objects()) == 6 and len(at[8]) == 6


def test_names_survive_dissolving():
    limits = [{"epsilon": 0.05, "forbidden": 0.1, "min_confidence": 0.0, "radius": 0.03, "conflict_confidence": 0.7, "addition_confidence": 0.5, "component_confidence": 1.5}] * (triangulate.SETTLED + 1)
    zone = triangulate.Zone(limits)
    place = (0.0, 0.0, 0.0)
    edges = {frozenset(((a, 0), (b, 0))): (place, 1.0) for a in range(4) for b in range(a)}
    zone.resolve(edges, {})
    (first,) = zone.components
    first.confidence = 0.0  # the next audit dissolves it, and it grows again with another observation
    zone.resolve({frozenset(((9, 0), (k, 0))): (place, 1.0) for k in range(4)}, {})
    (second,) = zone.components
    assert second is not first and len(second.members) == 5 and second.name == first.name == (0, 0)
