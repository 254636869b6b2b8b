"""Rounds of counting, threshold grids and sweeps, suggested views and the export of masks, against plain Python."""

import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import annotations, detect, evaluate, rounds, zones
from parallaxis.operators.fuse import frame_pairs, ray_candidates
from parallaxis.plans import records as plans
from parallaxis.plans.fixtures import view
from parallaxis.sources import records

SF = "/root/testdata/sf0.001"
BOX = "zone_id long, minx double, maxx double, miny double, maxy double, minz double, maxz double"


def scene(spark, objects, zone=0, frames=12):
    """Rays of cameras in a circle to every object, as (rays, poses) rows."""
    rays, poses = [], []
    for f in range(frames):
        eye = np.array([1.5 * math.cos(2 * math.pi * f / frames), 1.5 * math.sin(2 * math.pi * f / frames), 3.0])
        poses.append((0, f, f, *map(float, eye), 0.0, 0.0, -1.0))
        for k, o in enumerate(objects):
            d = np.array(o) - eye
            rays.append((zone, f, k, 0.95, *map(float, eye), *map(float, d / np.linalg.norm(d))))
    return rays, poses


def counted(spark, rays, poses, zones=(0,)):
    r = spark.createDataFrame(rays, "zone_id long, frame_id long, det_id long, conf double, ox double, oy double, oz double, dx double, dy double, dz double")
    p = frame_pairs(spark.createDataFrame(poses, "session_id long, frame_id long, seq long, tx double, ty double, tz double, fx double, fy double, fz double"))
    boxes = spark.createDataFrame([(z, -3.0, 3.0, -3.0, 3.0, -1.0, 1.0) for z in zones], BOX)
    return rounds.count_objects(r, p, ray_candidates(r, p), boxes)


def test_objects_by_rounds(spark):
    """Objects far apart, and two that are nearer than twice the radius, so that the second waits for another round; a zone alike beside it."""
    objects = [(0.0, 0.0, 0.0), (0.045, 0.0, 0.0), (0.5, 0.2, 0.0), (-0.4, -0.3, 0.0)]
    rays, poses = scene(spark, objects)
    more, _ = scene(spark, objects[2:], zone=1)
    got = counted(spark, rays + more, poses, (0, 1)).collect()
    members = defaultdict(list)
    for r in got:
        members[r.zone_id, r.component_id].append(r)
    assert sorted(z for z, _ in members) == [0] * 4 + [1] * 2
    for own in members.values():
        assert len({r.det_id for r in own}) == 1 and len({r.frame_id for r in own}) == len(own) == 12
        truth = (objects if own[0].zone_id == 0 else objects[2:])[own[0].det_id]
        assert (own[0].x, own[0].y, own[0].z) == pytest.approx(truth, abs=1e-6) and own[0].name == f"0:{own[0].det_id}"


def test_rounds_without_anything(spark):
    rays, poses = scene(spark, [(0.0, 0.0, 0.0)], frames=2)
    assert counted(spark, rays, poses).count() == 0  # one edge makes no component
    assert counted(spark, rays[:1], poses).count() == 0


def test_suppression_at_all_thresholds_is_suppression_at_each(spark):
    boxes = view(spark, SF, "boxes")
    at = [0.1, 0.3, 0.5, 0.9]
    got = detect.suppress_at_all(boxes, at, "image_id").select("image_id", "det", "score", "stays").collect()
    for k, x in enumerate(at):
        for low in (0.0, 0.5):
            want = {(r.image_id, r.det) for r in detect.suppress(boxes.filter(F.col("score") >= low), "image_id", above=x).collect()}
            assert {(r.image_id, r.det) for r in got if r.stays[k] and r.score >= low} == want


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return round(w * h / union, 9) if union > 0 else 0.0


def largest_matching(pairs):
    """How many pairs without a common end there can be: by augmenting paths."""
    partner = {}

    def place(t, seen):
        for p in pairs[t]:
            if p not in seen:
                seen.add(p)
                if p not in partner or place(partner[p], seen):
                    partner[p] = t
                    return True
        return False

    return sum(place(t, set()) for t in pairs)


def by_image(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r.image_id].append(tuple(r[c] for c in columns))
    return out


def test_sweep_over_boxes_and_masks(spark):
    truth, boxes = (by_image(view(spark, SF, n), "left", "top", "right", "bottom") for n in ("truth", "boxes"))
    got = sorted(plans.matching_sweep(spark, SF).collect(), key=lambda r: r.threshold)
    assert [r.threshold for r in got] == plans.SWEPT and len(got) == 17
    met = [{(k, t): [(k, p, iou(a, b)) for p, b in enumerate(boxes[k])] for t, a in enumerate(truth[k])} for k in truth]
    cells = [defaultdict(set), defaultdict(set)]
    for side, df in zip(cells, plans._masks(spark, SF)):
        for r in df.collect():
            side[r.image_id, r.label].add((r.y, r.x))
    masks = defaultdict(dict)
    for (k, t), own in cells[0].items():
        masks[k][k, t] = [(k, p, round(len(own & other) / len(own | other), 9)) for (i, p), other in cells[1].items() if i == k and own & other]
    for groups, total, tp, f1, best in ((met, sum(map(len, truth.values())) + sum(map(len, boxes.values())), "tp", "f1", "best"), (list(masks.values()), sum(map(len, cells)), "mask_tp", "mask_f1", "mask_best")):
        want = []
        for x in plans.SWEPT:
            want.append(sum(largest_matching({t: [q[:2] for q in p if q[2] >= x and q[2] > 0] for t, p in g.items()}) for g in groups))
        assert [r[tp] for r in got] == want
        assert [r[f1] for r in got] == pytest.approx([2 * n / total for n in want], abs=2e-6)
        top = max(r[f1] for r in got)
        assert [r.threshold for r in got if r[best]] == [next(r.threshold for r in got if r[f1] == top)]


def test_the_whole_grid(spark):
    truth, rows = by_image(view(spark, SF, "truth"), "left", "top", "right", "bottom"), by_image(view(spark, SF, "boxes"), "left", "top", "right", "bottom", "score", "det")
    got = {(round(r.score, 1), round(r.overlap, 1)): r for r in plans.threshold_grid(spark, SF).collect()}
    assert len(got) == 81 and sum(r.best for r in got.values()) == 1
    total = sum(map(len, truth.values()))
    for s, o in ((0.1, 0.1), (0.1, 0.9), (0.3, 0.5), (0.5, 0.3), (0.8, 0.6), (0.9, 0.1)):
        kept = {}
        for k, own in rows.items():
            stays = []
            for b in sorted(own, key=lambda b: (-b[4], b[5])):
                if b[4] >= s and all(iou(b, x) <= o for x in stays):
                    stays.append(b)
            kept[k] = stays
        tp = sum(largest_matching({t: [p for p, b in enumerate(kept.get(k, [])) if iou(a, b) >= 0.5] for t, a in enumerate(own)}) for k, own in truth.items())
        predicted = sum(map(len, kept.values()))
        assert (got[s, o].tp, got[s, o].predicted) == (tp, predicted) and got[s, o].f1 == pytest.approx(2 * tp / (predicted + total), abs=2e-6)
    best = next(r for r in got.values() if r.best)
    assert best.f1 == max(r.f1 for r in got.values())


def test_scores_of_a_matching(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "image_id long, det long")
    matched = spark.createDataFrame([(1, 1, 1, 0.8), (1, 2, 3, 0.6)], "image_id long, t long, p long, iou double")
    r = evaluate.scores(matched, truth, truth.union(truth)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (2, 4, 1, pytest.approx(2 / 6), pytest.approx(2 / 3)) and r.f1 == pytest.approx(4 / 9)
    assert r.mean_iou == pytest.approx(0.7) and r.panoptic == pytest.approx(0.7 * 4 / 9) and r.accuracy == pytest.approx(2 / 7)
    none = evaluate.scores(matched.limit(0), truth.limit(0), truth.limit(0)).first()
    assert (none.f1, none.precision, none.panoptic) == (0.0, 0.0, 0.0)


def views_of(spark, radius=2.0):
    around = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.6, 0.8, radius), (2, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "zone_id long, gx double, gy double, gz double, nx double, ny double, nz double, radius double")
    return zones.hemisphere(around)


def test_views_around_a_zone(spark):
    rows = [r for r in views_of(spark).collect() if r.zone_id == 1]
    assert {r.zone_id for r in views_of(spark).collect()} == {1, 2} and rows[0].view_id == 0
    for r in rows:
        d = np.array([r.dx, r.dy, r.dz])
        assert np.linalg.norm(d) == pytest.approx(1) and (r.tx, r.ty, r.tz) == pytest.approx(tuple(2 * d)) and r.angle < 75
        assert math.degrees(math.acos(min(1.0, d @ [0, 0.6, 0.8]))) == pytest.approx(r.angle, abs=1e-6)
        assert math.hypot(r.px, r.py) == pytest.approx(2 * math.sin(math.radians(r.angle)), abs=1e-9)
    assert len(rows) == 1 + round(256 * (1 - math.cos(math.radians(75))))  # cosines fall evenly
    nearest = [min(math.degrees(math.acos(min(1.0, np.array([a.dx, a.dy, a.dz]) @ [b.dx, b.dy, b.dz]))) for b in rows if b is not a) for a in rows if a.view_id]
    assert min(nearest) > 3 and max(nearest) < 12


def far(a, b):
    turn = math.degrees(math.acos(max(-1.0, min(1.0, sum(a["d" + c] * b["d" + c] for c in "xyz") / math.sqrt(sum(a["d" + c] ** 2 for c in "xyz") * sum(b["d" + c] ** 2 for c in "xyz"))))))
    return round(turn / 15 + math.hypot(a.px - b.px, a.py - b.py) / max((a.distance + b.distance) / 2, 1e-3) / 0.1, 6)


@pytest.mark.parametrize("taken", [[], [0, 9, 40]])
def test_suggested_views(spark, taken):
    candidates = views_of(spark)
    references = candidates.filter(F.col("view_id").isin(taken or [-1]) & (F.col("zone_id") == 1))
    got = sorted(zones.diverse_views(candidates, references).collect(), key=lambda r: (r.zone_id, r.place))
    for zone in (1, 2):
        left = {r.view_id: r for r in candidates.collect() if r.zone_id == zone}
        had = [left[k] for k in taken] if zone == 1 else []
        want = []
        while left and len(want) < 25:
            score = {k: min((far(r, x) for x in had), default=math.inf) for k, r in left.items()}
            k = min(left, key=lambda k: (-score[k], left[k].angle, k))
            if score[k] <= 1:
                break
            want.append((zone, k, len(want) + 1, None if math.isinf(score[k]) else score[k]))
            had.append(left.pop(k))
        assert [tuple(r) for r in got if r.zone_id == zone] == [(*w[:3], w[3] if w[3] is None else pytest.approx(w[3], abs=2e-6)) for w in want] and want
    opposite = spark.createDataFrame([(1, 7, 40.0, math.sin(0.7), 0.0, math.cos(0.7), 0.5, 0.0, 3.0), (1, 8, 40.0, -math.sin(0.7), 0.0, math.cos(0.7), 0.5, 0.0, 3.0)], "zone_id long, view_id long, angle double, dx double, dy double, dz double, px double, py double, distance double")
    assert zones.diverse_views(opposite.filter("view_id = 8"), opposite.filter("view_id = 7")).count() == 1
    assert zones.diverse_views(candidates.limit(0), references.limit(0)).count() == 0


def test_the_suggestions_of_the_scene(spark):
    got = plans.suggested_views(spark, SF).collect()
    assert {r.zone_id for r in got} == {r.zone_id for r in view(spark, SF, "zones").collect()} and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1, 26))


def test_masks_become_a_document_for_each_folder(spark, tmp_path):
    """Pixels of all parts are the area, the outline is the largest part's, and numbers begin anew in each folder."""
    cells = [(1, y, x, 5) for y in range(4) for x in range(6)] + [(1, 9, 9, 5)] + [(1, 20, x, 7) for x in range(3)] + [(2, y, x, 1) for y in range(3) for x in range(3)] + [(3, y, x, 2) for y in range(3) for x in range(5)] + [(3, 9, 9, 0)]
    images = spark.createDataFrame([("f", 1, 30, 30, "a.png"), ("g", 2, 30, 30, "b.png"), ("f", 3, 30, 30, "c.png")], "folder string, image_id long, width int, height int, file_name string")
    out = annotations.exported_masks(images, spark.createDataFrame(cells, "image_id long, y int, x int, label long"))
    got = sorted((r.folder, r.image_id, r.ann, r.area, r.left, r.top, len(r.ring)) for r in out.collect())
    assert got == [("f", 1, 1, 25.0, 0.0, 0.0, 8), ("f", 3, 2, 15.0, 0.0, 0.0, 8), ("g", 2, 1, 9.0, 0.0, 0.0, 8)]
    rows = out.select("folder", F.col("ann").alias("id"), "image_id", F.array("ring").alias("segmentation"), F.array("left", "top", "width", "height").alias("bbox"), "area")
    records.write_annotations(images.withColumnRenamed("image_id", "id"), rows, f"{tmp_path}/out")
    documents = {r.folder: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()}
    assert [a["id"] for a in documents["f"]["annotations"]] == [1, 2] and len(documents["g"]["annotations"]) == 1


def test_matching_of_the_scene(spark):
    truth, rows = by_image(view(spark, SF, "truth"), "left", "top", "right", "bottom"), by_image(view(spark, SF, "boxes").filter("score >= 0.3"), "left", "top", "right", "bottom")
    tp = sum(largest_matching({t: [p for p, b in enumerate(rows[k]) if iou(a, b) >= 0.5] for t, a in enumerate(own)}) for k, own in truth.items())
    n, m = (sum(map(len, x.values())) for x in (truth, rows))
    got = plans.matching_scores(spark, SF).first()
    assert (got.tp, got.fp, got.fn) == (tp, m - tp, n - tp) and got.f1 == pytest.approx(2 * tp / (n + m), abs=2e-6)


def test_groups_are_matched_alike_by_all_choices_and_by_paths():
    draw = np.random.default_rng(4)
    for _ in range(300):
        n, m = sorted(draw.integers(2, 7, 2).tolist())
        part = [(t, p, float(draw.integers(1, 100)) / 100) for t in range(n) for p in range(m) if draw.random() < 0.6]
        if {t for t, _, _ in part} != set(range(n)) or {p for _, p, _ in part} != set(range(m)):
            continue
        a, b = evaluate._tried(part, list(range(n)), list(range(m))), evaluate._cheapest(part, list(range(n)), list(range(m)))
        assert len(a) == len(b) and sum(x[2] for x in a) == pytest.approx(sum(x[2] for x in b))
        assert len({x[0] for x in a}) == len({x[1] for x in a}) == len(a) == largest_matching({t: [p for u, p, _ in part if u == t] for t in range(n)})


def test_zones_by_propagation_of_the_given_points(spark):
    """Anchors, the graph of eight nearest neighbours, and rounds of votes of all points at once."""
    from parallaxis.plans import scene as plan

    points = [r.asDict() for r in view(spark, SF, "points").collect()]
    centres = {r.zone_id: (r.cx, r.cy, r.cz) for r in view(spark, SF, "point_zones").collect()}
    at = np.array([[p["x"], p["y"], p["z"]] for p in points])
    zone_ids = sorted(centres)
    to_zone = np.round(np.linalg.norm(at[:, None] - np.array([centres[z] for z in zone_ids])[None], axis=2), 12)
    order = np.argsort(to_zone, axis=1, kind="stable")
    nearest = [zone_ids[k] for k in order[:, 0]]
    first, second = np.take_along_axis(to_zone, order[:, :2], 1).T
    anchor = first * 2 < second
    ids = np.array([p["point_id"] for p in points])
    far = np.round(np.linalg.norm(at[:, None] - at[None], axis=2), 12)
    np.fill_diagonal(far, np.inf)
    edges, reach = {}, []
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (far[i, j], ids[j]))[:8]:
            reach.append(far[i, j])
            edges[min(i, j), max(i, j)] = far[i, j]
    sigma = max(float(np.median(reach)), 0.05)
    heard = defaultdict(list)
    for (i, j), d in edges.items():
        w = math.exp(-d * d / sigma**2) * points[i]["conf"] * points[j]["conf"]
        heard[i].append((j, w))
        heard[j].append((i, w))
    label = [nearest[i] if anchor[i] else None for i in range(len(ids))]
    for _ in range(64):
        now = list(label)
        for i in range(len(ids)):
            votes = defaultdict(float)
            for j, w in heard[i]:
                if label[j] is not None:
                    votes[label[j]] += w
            if votes and not anchor[i]:
                now[i] = max(votes, key=lambda z: (round(votes[z], 12), z == nearest[i], -z))
        if now == label:
            break
        label = now
    want = {int(ids[i]): (label[i] if label[i] is not None else nearest[i], bool(anchor[i])) for i in range(len(ids))}
    got = {r.point_id: (r.zone_id, r.is_anchor) for r in plan.zones_by_propagation(spark, SF).collect()}
    assert set(got) == set(want) and sum(got[k] != want[k] for k in got) <= 1  # a vote may tie in the last digit
