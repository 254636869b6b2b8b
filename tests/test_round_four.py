"""What the findings of round 4 asked for, in small."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from parallaxis.operators import evaluate, frames, masks, shapes
from parallaxis.plans import measures, records
from parallaxis.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """What run gives, and the rows that its stages shuffle."""
    context = spark.sparkContext
    nothing = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()

    def stages():
        found = context._jsc.sc().statusStore().stageList(None, False, False, *nothing)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = max(stages(), default=-1)
    out = run()
    return out, sum(n for k, n in stages().items() if k > before)


def test_samples_meet_cells_in_squares(spark):
    """Samples anywhere, left of zero too, take the depth that all cells around them tell, and are shuffled as a few rows each."""
    draw = np.random.default_rng(6)
    cells = [(f, x, y, int(draw.integers(0, 9)), int(draw.integers(0, 3))) for f in range(3) for x in range(-3, 30) for y in range(-3, 30) if draw.random() < 0.8]
    samples = [(f, k, *map(int, draw.integers(-9, 36, 2))) for f in range(4) for k in range(200)]
    c = spark.createDataFrame(cells, "frame_id long, x int, y int, mm int, confidence int")
    s = spark.createDataFrame(samples, "frame_id long, sample_id int, sx int, sy int")
    for reach in (0, 2, 4):
        want = {}
        for f, k, sx, sy in samples:
            near = [(sure, mm, x, y) for g, x, y, mm, sure in cells if g == f and mm > 0 and abs(x - sx) <= reach and abs(y - sy) <= reach]
            best = sorted(r[1:] for r in near if r[0] == max(near)[0])
            if near:
                want[f, k] = (*best[len(best) // 2], max(near)[0])
        got, rows = shuffled(spark, frames.depth_samples(s, c, reach).collect)
        assert {(r.frame_id, r.sample_id): (r.mm, r.x, r.y, r.confidence) for r in got} == want
    assert rows < 81 * len(samples)


def test_tables_are_dealt_before_many_rows_are_made(spark):
    """A table of one file and row group makes its pixels in several tasks."""
    assert view(spark, SF, "pixels").rdd.getNumPartitions() == 1 < view(spark, SF, "pixels", dealt={"part": "p_partkey"}).rdd.getNumPartitions()


def test_masks_of_whole_images_overlap(spark):
    """Every pixel of the images counts, not one of sixteen."""
    painted = [defaultdict(dict), defaultdict(dict)]
    for side, name in zip(painted, ("truth", "boxes")):
        for r in sorted(view(spark, SF, name).filter("image_id < 4").collect(), key=lambda r: r.det):
            side[r.image_id].update(dict.fromkeys(((y, x) for y in range(int(r.top), int(r.bottom)) for x in range(int(r.left), int(r.right))), r.det))
    want = {k: Counter((t, painted[1][k][at]) for at, t in painted[0][k].items() if at in painted[1][k]) for k in painted[0]}
    got = {r.image_id: (r.pairs, r.pixels, r.most) for r in measures.mask_overlaps(spark, SF).collect()}
    assert {k: got[k] for k in want} == {k: (len(n), sum(n.values()), max(n.values())) for k, n in want.items()} and len(want) == 4


def test_boxes_are_painted_as_rectangles():
    """A tile's boxes leave as many parts as their sides make, however large they are."""
    rows = pa.table({"layer": [0, 0, 1], "x0": [0, 100, 0], "y0": [0, 100, 0], "x1": [255, 255, 9], "y1": [255, 255, 9], "tx": [0] * 3, "ty": [0] * 3})
    parts = masks._owned(rows, np.zeros(3, int), 2)
    assert [tuple(int(c) for c in p) for p in zip(*parts.own, *parts[1:])] == [(0, 2, 0, 0, 10, 10), (0, -1, 0, 10, 10, 246), (0, -1, 10, 0, 90, 256), (0, -1, 100, 0, 156, 100), (1, -1, 100, 100, 156, 156)]


def followed(cells):
    """Corners (x, y) of the outline of the largest 4-connected part of cells (y, x), of equal ones the first, and that part's cells: a step along a side after the other."""
    left, best = set(cells), []
    for first in sorted(cells):
        part = [first] if first in left else []
        left -= {first}
        for y, x in part:
            near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
            left -= near
            part += near
        best = max(best, part, key=len)
    (y, x), (dy, dx), ring = min(best), (0, 1), []
    while not ring or (x, y) != ring[0]:
        ring.append((x, y))
        while True:
            y, x = y + dy, x + dx
            ahead = [(y + (dy - 1 + s * dx) // 2, x + (dx - 1 - s * dy) // 2) for s in (1, -1)]  # on the right and on the left
            if ahead[0] not in best or ahead[1] in best:
                dy, dx = (dx, -dy) if ahead[0] not in best else (-dx, dy)
                break
    return ring, len(best)


def test_outlines_of_many_labels_at_once(spark):
    """Labels in parts, with holes and pinches, of equal parts and across tiles, are followed as one alone is; where they are painted as where they are given."""
    draw = np.random.default_rng(9)
    cells = {k: [(int(y), int(x)) for y in range(k % 7 + 1) for x in range(k % 9 + 1) if draw.random() < 0.65] or [(0, 0)] for k in range(1, 600)}
    rows = [(k % 5, k, y + 250, x + 250) for k, own in cells.items() for y, x in own]
    given = shapes.largest_contours(spark.createDataFrame(rows, "image_id long, label long, y int, x int"), "image_id")
    assert {r.label: ([(p.x - 250, p.y - 250) for p in r.polygon], r.area, r.pixels) for r in given.collect()} == {k: (*followed(own), len(own)) for k, own in cells.items()}
    boxes = spark.createDataFrame([(int(k % 3), int(k), *map(float, (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(draw.integers((0, 0, 1, 1), (300, 300, 60, 60), (300, 4)), 1)], "image_id long, det long, left double, top double, right double, bottom double")
    assert sorted(masks.label_outlines(boxes, "image_id").collect()) == sorted(shapes.run_contours(masks.label_runs(boxes, "image_id"), "image_id").collect())


def test_masks_are_exported_where_they_are_painted(spark):
    """Labels are shuffled once after they were painted, to be numbered; outlines and all of their cells are not, nor are labels sampled."""
    n = view(spark, SF, "boxes").count()
    rows, moved = shuffled(spark, lambda: measures.exported_masks(spark, SF).collect())
    assert moved < 3.3 * n and sorted(r.ann for r in rows if r.folder == 1) == list(range(1, 1 + sum(r.folder == 1 for r in rows)))


def test_sweep_of_boxes_and_masks_at_once(spark):
    """Boxes that cross tiles, crowds and an image of one side only match as by joins; a missing image counts and meets nothing."""
    draw = np.random.default_rng(11)
    at = [[(int(k) if k < 9 else None, int(n), *map(float, (x, y, x + w, y + h))) for n, (k, x, y, w, h) in enumerate(draw.integers((0, -40, 200, 1, 1), (10 - side, 60, 300, 50, 60), (500, 5)))] for side in (0, 1)]
    t, p = (spark.createDataFrame(rows, "image_id long, det long, left double, top double, right double, bottom double") for rows in at)
    levels = [0.1, 0.3, 0.5, 0.7]
    got = sorted(evaluate.sweep_both(t, p, levels, "image_id").collect())
    by_box = sorted(evaluate.sweep(evaluate.overlaps(t, p, "image_id"), t, p, levels, "image_id").collect())
    met = masks.overlaps(*(df.filter("image_id is not null") for df in (t, p)), "image_id")
    by_mask = sorted(evaluate.sweep(evaluate.mask_ious(met, "image_id"), *(masks.label_boxes(df, "image_id") for df in (t, p)), levels, "image_id").collect())
    assert [(r.threshold, r.tp, r.f1, r.best) for r in got] == [tuple(r) for r in by_box] and got[0].tp > got[-1].tp > 0
    assert [(r.mask_tp, r.mask_f1, r.mask_best) for r in got] == [tuple(r)[1:] for r in by_mask] and got[0].mask_tp > got[-1].mask_tp
    assert [tuple(r) for r in evaluate.sweep_both(t.limit(0), p.limit(0), [0.5], "image_id").collect()] == [(0.5, 0, 0.0, True, 0, 0.0, True)]


def test_the_sweep_shuffles_boxes_once(spark):
    """Beside what the views shuffle, boxes are by image, and neither pairs nor labels."""
    n = sum(view(spark, SF, name).count() for name in ("truth", "boxes"))
    rows, moved = shuffled(spark, lambda: records.matching_sweep(spark, SF).collect())
    assert len(rows) == 17 and moved < 2.5 * n
