import random

import pytest
from pyspark.sql import functions as F

from parallaxis.operators import assign, corrections, detect, evaluate, frames, zones


def test_suppression_equals_the_greedy_order(spark):
    rng, rows = random.Random(1), []
    for image in range(20):
        for det in range(15):
            left, top = rng.randrange(60), rng.randrange(60)
            rows.append((image, det, float(left), float(top), float(left + rng.randrange(5, 40)), float(top + rng.randrange(5, 40)), rng.randrange(5) / 5))
    boxes = spark.createDataFrame(rows, "image_id long, det long, left double, top double, right double, bottom double, score double")

    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    want = set()
    for image in range(20):
        kept = []
        for b in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):
            if all(iou(k, b) <= 0.3 for k in kept):
                kept.append(b)
        want |= {(k[0], k[1]) for k in kept}
    assert {(r.image_id, r.det) for r in detect.suppress(boxes, "image_id", above=0.3).collect()} == want


def test_gate_equals_a_sequential_loop(spark):
    rng = random.Random(2)
    rows = [(s, i, i * 17_000 + rng.randrange(5000), rng.random() < 0.4) for s in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, frame_id long, us long, ok boolean").withColumn("ts", F.timestamp_micros("us"))
    df = df.withColumns({"dark": F.when(F.col("ok"), 0.0).otherwise(0.9), "bright": F.lit(0.0), "luma_std": F.lit(50.0), "lap": F.lit(500.0), "move": F.lit(0.0), "turn": F.lit(0.0)})
    want = {}
    for s in range(5):
        last = None
        for _, i, us, ok in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            due = last is None or us - last >= 50_000
            if ok or due:
                last = us
            want[s, i] = (ok or due, not ok and due)
    assert {(r.session_id, r.frame_id): (r.accepted, r.forced) for r in frames.gate(df).collect()} == want


def boundary(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0)], "zone_id long, cx double, cy double, cz double")
    p = spark.createDataFrame([(i, x, 0.0, 0.0, 1.0, 0) for i, x in enumerate((1.0, 2.5, 4.0, 6.0, 7.5, 9.0))], "point_id long, x double, y double, z double, conf double, scene int")
    return p, z


def test_labels_spread_to_the_boundary(spark):
    p, z = boundary(spark)
    got = {r.point_id: (r.zone_id, r.is_anchor) for r in assign.propagate(p, z, "scene", k=2).collect()}
    assert [got[i][0] for i in range(6)] == [1, 1, 1, 2, 2, 2]
    assert got[0][1] and got[5][1] and not got[2][1]


def test_a_lone_point_falls_back_to_the_nearest_zone(spark):
    _, z = boundary(spark)
    p = spark.createDataFrame([(0, 4.9, 0.0, 0.0, 1.0, 0)], "point_id long, x double, y double, z double, conf double, scene int")
    got = assign.propagate(p, z, "scene").first()
    assert got.zone_id == 1 and not got.is_anchor


def test_corrections(spark):
    nearest = spark.createDataFrame([(7, [1, 2, 3, 4]), (8, [1, 2, 3, 4])], "point_id long, zones array<long>")
    schema = "session_id long, seq long, op string, point_id long, zone_id long"
    for turns, zone in ((1, 2), (2, 3), (3, 4), (4, 1), (5, 2)):
        rows = [(0, 1, "add", 7, None), *((0, 2 + k, "rotate", 7, None) for k in range(turns))]
        assert corrections.replay(spark.createDataFrame(rows, schema), nearest).first().zone_id == zone
    rows = [(0, 1, "add", 7, None), (0, 2, "add", 8, 3), (0, 3, "delete_zone", None, 1), (1, 1, "add", 7, 2), (1, 2, "reset", None, None), (1, 3, "add", 8, 4)]
    assert {(r.session_id, r.point_id, r.zone_id) for r in corrections.replay(spark.createDataFrame(rows, schema), nearest).collect()} == {(0, 8, 3), (1, 8, 4)}


def test_plane_fit_and_its_failures(spark):
    rows = [(1, k, float(k % 5), float(k // 5), 2.0 * (k % 5) - 1.0 * (k // 5) + 3 + (50.0 if k == 7 else 0.0)) for k in range(25)] + [(2, 0, 0.0, 0.0, 0.0)] + [(3, k, 1.0, 1.0, 1.0) for k in range(3)]
    got = {r.g: r for r in zones.fit_plane(spark.createDataFrame(rows, "g long, point_id long, x double, y double, z double"), "g").collect()}
    assert (got[1].a, got[1].b, got[1].c) == (pytest.approx(2), pytest.approx(-1), pytest.approx(3))
    assert 2 not in got or got[2].reason == "too few points"
    assert 3 not in got or got[3].reason == "singular"


def test_matching_is_the_best_assignment(spark):
    met = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 2, 0.7), (0, 2, 1, 0.85), (0, 3, 2, 0.2)], "image_id long, t long, p long, iou double")
    assert {(r.t, r.p) for r in evaluate.match_once(met, "image_id", least=0.3).collect()} == {(1, 2), (2, 1)}
    got = {(r.threshold, r.t, r.p) for r in evaluate.match_once(met, "image_id", least=[0.1, 0.88]).collect()}
    assert got == {(0.1, 1, 2), (0.1, 2, 1), (0.88, 1, 1)}


def test_assignment_equals_all_permutations():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        pairs = [(t, 10 + p, round(rng.random(), 3)) for t in range(n) for p in range(m) if rng.random() < 0.6]
        given = {(t, p): x for t, p, x in pairs}
        want = (0, 0.0)
        for order in permutations(range(10, 10 + max(n, m)), n):
            hit = [given[t, p] for t, p in enumerate(order) if (t, p) in given]
            want = max(want, (len(hit), round(sum(hit), 6)))
        got = evaluate.assigned(pairs)
        assert (len(got), round(sum(x for _, _, x in got), 6)) == want
        assert len({t for t, _, _ in got}) == len(got) == len({p for _, p, _ in got}) and all(given[t, p] == x for t, p, x in got)


def test_sweep_picks_the_first_best(spark):
    met = spark.createDataFrame([(0, 1, 1, 0.6), (0, 2, 2, 0.35)], "image_id long, t long, p long, iou double")
    own = spark.createDataFrame([(0, 1), (0, 2)], "image_id long, det long")
    rows = {r.threshold: (r.tp, r.f1, r.best) for r in evaluate.sweep(met, own, own, [0.1, 0.3, 0.5, 0.9], "image_id").collect()}
    assert rows == {0.1: (2, 1.0, True), 0.3: (2, 1.0, False), 0.5: (1, 0.5, False), 0.9: (0, 0.0, False)}


def test_polygon_suppression_goes_by_the_smaller_area(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [(0, 1, 0.9, square(0.0, 0.0, 10.0)), (0, 2, 0.8, square(8.0, 8.0, 4.0)), (0, 3, 0.7, square(9.0, 9.0, 1.0)), (0, 4, 0.6, square(30.0, 0.0, 2.0)), (0, 5, 0.5, []), (1, 6, 0.4, square(0.0, 0.0, 10.0))]
    polygons = spark.createDataFrame(rows, "image_id long, det long, score double, polygon array<struct<x: double, y: double>>")
    # 2 shares 4 of its 16 with 1; 3 lies inside 1 and 2
    assert {r.det for r in detect.suppress(polygons, "image_id", above=0.3, shape="polygon").collect()} == {1, 2, 4, 5, 6}
    assert {r.det for r in detect.suppress(polygons, "image_id", above=0.2, shape="polygon").collect()} == {1, 4, 5, 6}


@pytest.mark.parametrize("merged", [False, True])
def test_dense_outputs_become_polygons(spark, merged):
    """A 9 x 9 output with two strong cells apart, one weaker beside the first, and one on the border."""
    plane = [0.0] * 81
    for y, x, score in ((4, 3, 0.9), (4, 4, 0.8), (6, 6, 0.7), (0, 0, 1.0), (4, 5, 0.3)):
        plane[y * 9 + x] = score
    rays = [1.5] * (4 * 81)
    rows = [(7, 5, 9, 9, plane + rays)] if merged else [(7, 1, 9, 9, plane), (7, 4, 9, 9, rays)]
    outputs = detect.star_outputs(spark.createDataFrame(rows, "image_id long, channels int, height int, width int, values array<double>"))
    got = {r.det: r for r in detect.star_detections(outputs, least=0.5, above=0.4).collect()}
    assert outputs.count() == 81 and set(got) == {4 * 9 + 3, 6 * 9 + 6}
    assert (got[39].left, got[39].right, got[39].score) == (1.5, 4.5, 0.9)


def test_rows_become_detections_with_masks(spark):
    values = lambda x, score: [x, 8.0, 8.0, 8.0, score, 1.0, 0.0]
    rows = spark.createDataFrame([(1, 1, values(8.0, 0.9)), (1, 2, values(9.0, 0.8)), (1, 3, values(40.0, 0.7)), (1, 4, values(60.0, 0.1))], "image_id long, det long, values array<double>")
    cells = spark.createDataFrame([(1, y, x, [4.0 if x < 3 else -4.0, 0.0]) for y in range(16) for x in range(16)], "image_id long, y int, x int, proto array<double>")
    got = {r.det: r.pixels for r in detect.row_detections(rows, cells, width=64, height=64).collect()}
    assert got == {1: 6, 3: 0}
