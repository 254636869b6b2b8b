"""Masks painted in tasks against masks of cells in plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.operators import annotations, evaluate, masks, shapes


def drawn(seed, images=70, many=400):
    r = random.Random(seed)
    rows = []
    for image in range(images):
        for det in range(many if image == 5 else r.randint(1, 9)):  # boxes that cross tiles and overlap, left of zero too
            left, top = r.randint(-40, 500), r.randint(-20, 300)
            rows.append((image, det, float(left), float(top), left + r.choice([1.0, 3.5, 30.0, 90.0]), top + r.choice([1.0, 2.5, 20.0, 70.0])))
    return rows


def painted(rows):
    out = {}
    for image, det, left, top, right, bottom in sorted(rows, key=lambda r: r[1]):
        for y in range(int(top), max(int(top) + 1, -int(-bottom // 1))):
            for x in range(int(left), max(int(left) + 1, -int(-right // 1))):
                out[image, y, x] = det
    return out


SCHEMA = "image_id long, det long, left double, top double, right double, bottom double"


def table(spark, seed):
    return spark.createDataFrame(drawn(seed), SCHEMA).repartition(3)


def test_boxes_runs_and_overlaps(spark):
    t, p = painted(drawn(1)), painted(drawn(2))
    one, two = table(spark, 1), table(spark, 2)
    assert {(r.image_id, r.y, r.x): r.label for r in masks.cells(one, "image_id").collect()} == t
    own: dict = {}
    for (image, y, x), label in t.items():
        own.setdefault((image, label), []).append((y, x))
    boxes = {(r.image_id, r.label): (r.left, r.top, r.right, r.bottom, r.area) for r in masks.label_boxes(one, "image_id").collect()}
    assert boxes == {k: (min(x for _, x in v), min(y for y, _ in v), max(x for _, x in v), max(y for y, _ in v), len(v)) for k, v in own.items()}
    runs = {(r.image_id, r.label): sorted((q.y, x) for q in r.runs for x in range(q.x, q.x + q.n)) for r in masks.label_runs(one, "image_id").collect()}
    assert runs == {k: sorted(v) for k, v in own.items()}
    both = Counter((k[0], t.get(k), p.get(k)) for k in t.keys() | p.keys())
    met = masks.overlaps(one, two, "image_id")
    assert {(r.image_id, r.t, r.p): r.pixels for r in met.collect()} == both
    cells = [masks.cells(x, "image_id") for x in (one, two)]
    assert sorted(evaluate.mask_ious(met, "image_id").collect()) == sorted(evaluate.mask_overlaps(*cells, "image_id").collect())


def test_one_crowded_tile_is_held_as_its_cells(spark):
    rows = [(1, k, float(k % 7), float(k % 5), k % 7 + 200.0, k % 5 + 200.0) for k in range(60)]  # 2.4 million cells in one tile
    met = masks.label_boxes(spark.createDataFrame(rows, SCHEMA), "image_id").collect()
    assert {r.label: r.area for r in met} == Counter(painted(rows).values())


def test_polygons_as_their_expression(spark):
    star = poly.star_polygon(F.col("left"), F.col("top"), F.array(*(F.lit(x) for x in (30.0, 6.5, 41.0, 9.0, 17.0))))
    stars = table(spark, 3).select("image_id", "det", star.alias("polygon"))
    b = poly.bounds(F.col("polygon"))
    span = lambda low, high: F.explode(F.sequence(F.ceil(low).cast("int"), F.floor(high).cast("int")))
    every = stars.withColumn("y", span(b["top"], b["bottom"])).withColumn("x", span(b["left"], b["right"]))
    want = every.filter(poly.contains(F.col("polygon"), F.col("x"), F.col("y"))).groupBy("image_id", "y", "x").agg(F.max("det").alias("label"))
    assert sorted(masks.cells(stars, "image_id").collect()) == sorted(want.collect())


def test_contours_of_runs_and_of_cells(spark):
    one = table(spark, 4).filter("image_id <> 5")
    by_run = shapes.run_contours(masks.label_runs(one, "image_id"), "image_id")
    by_cell = shapes.largest_contours(masks.cells(one, "image_id"), "image_id")
    assert sorted(by_run.collect()) == sorted(by_cell.collect())


def test_large_boxes_export(spark):
    """Boxes of four tiles, of which only the last is seen, make one annotation."""
    one = spark.createDataFrame([(1, k, 0.0, 0.0, 500.0, 500.0) for k in range(4)], SCHEMA)
    plan = annotations.exported_masks(spark.createDataFrame([(0, 1, 640, 480)], "folder long, image_id long, width int, height int"), masks.label_runs(one, "image_id"))
    assert [(r.ann, r.area) for r in plan.collect()] == [(1, 250_000.0)]
