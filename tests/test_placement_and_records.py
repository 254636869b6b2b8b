"""Zone merging and placement, coverage hulls, layouts, catalogue, correction logs and writers, on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import annotations, detect, merging, models, placement, resolve, shapes, zones
from parallaxis.sources import records
from parallaxis.streaming import sessions


def square(x, y, size=2.0):
    return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size)])


def test_coverage_hull_keeps_what_enough_outlines_cover(spark):
    outlines = [square(0, 0), square(1, 0), square(0.5, 0)]
    hull = shapes.covered_hull(outlines, share=1.0)
    assert sorted(map(tuple, hull)) == [(1, 0), (1, 2), (2, 0), (2, 2)]
    assert sorted(map(tuple, shapes.covered_hull(outlines, share=0.3))) == [(0, 0), (0, 2), (3, 0), (3, 2)]
    far = shapes.covered_hull([square(0, 0), square(9, 9)], share=1.0)  # nothing is covered twice
    assert len(far) == 6
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in ((1, outlines[0]), (1, outlines[1]), (2, outlines[2]))]
    got = shapes.coverage_hulls(spark.createDataFrame(rows, "zone_id long, polygon array<struct<x: double, y: double>>"), "zone_id", share=1.0).collect()
    assert {(r.x, r.y) for r in got if r.zone_id == 1} == {(1, 0), (2, 0), (2, 2), (1, 2)} and sum(r.zone_id == 2 for r in got) == 4


def detection(session, seq, x, y, confidence=0.5, size=1.0, tilt=0.0):
    grid = [(x + i * size / 4, y + j * size / 4) for i in range(5) for j in range(5)]
    points = [{"x": a, "y": b, "z": tilt * a} for a, b in grid]
    outline = [{"x": a, "y": b, "z": tilt * a} for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))]
    return (session, seq, confidence, points, outline, 0.0, 0.0, 5.0)


def test_zones_merge_settle_and_are_placed(spark):
    vector = "array<struct<x: double, y: double, z: double>>"
    rows = [detection(1, 0, 0.0, 0.0), detection(1, 1, 10.0, 0.0), *(detection(1, k, 0.05, 0.0) for k in range(2, 6)), detection(1, 6, 0.0, 0.1), detection(1, 7, 9.9, 0.0, size=3.0), detection(2, 0, 0.0, 0.0)]
    rows.append((1, 8, 0.5, [{"x": 1.0, "y": 1.0, "z": 1.0}] * 3, [], 0.0, 0.0, 5.0))
    df = spark.createDataFrame(rows, f"session_id long, seq long, confidence double, points {vector}, outline {vector}, tx double, ty double, tz double")
    got = {(r.session_id, r.seq): r for r in merging.merge_zones(df).collect()}
    assert [got[1, k].decision for k in range(9)] == ["added", "added", "settled", "settled", "settled", "ignored", "ignored", "merged", "no plane"]
    assert got[1, 4].placed == 1 and got[1, 8].zones == 2 and got[1, 2].zone_id == 0 and got[1, 2].points == 50 and got[2, 0].zones == 1


def test_a_merge_into_a_third_zone_is_refused():
    zone = lambda k, x, size: merging.Merged(k, (p := np.array([(x + i * size / 4, j * 0.25, 0.0) for i in range(5) for j in range(5)])), [(0.5, p[[0, 20, 24, 4]], np.array([0.0, 0.0, 5.0]))], (p.mean(0), np.array([0.0, 0.0, 1.0])))
    held, decision = merging.take([zone(0, 0.0, 1.0), zone(1, 1.3, 1.0)], zone(2, 0.4, 1.6))
    assert decision == "refused" and [z.zone_id for z in held] == [0, 1]


def test_zones_are_placed_by_depth(spark):
    """A camera that looks at a wall two metres away, with and without enough samples."""
    cells = spark.createDataFrame([(1, x, y, 2000, 7) for x in range(0, 100, 2) for y in range(0, 100, 2)], "frame_id long, x int, y int, mm int, confidence int")
    camera = spark.createDataFrame([(1, 100.0, 50.0, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "frame_id long, focal double, px double, py double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    samples = spark.createDataFrame([(1, 7, k, 30 + 10 * (k % 4), 30 + 10 * (k // 4)) for k in range(20)] + [(1, 8, 0, 20, 20)], "frame_id long, zone_id long, sample_id int, sx int, sy int")
    outline = [{"x": float(x), "y": float(y)} for x, y in ((30, 30), (60, 30), (60, 60), (30, 60))]
    huge = [{"x": float(x), "y": float(y)} for x, y in ((-300, -300), (400, -300), (400, 400), (-300, 400))]
    shape = spark.createDataFrame([(1, 7, outline), (1, 8, outline), (1, 9, huge)], "frame_id long, zone_id long, polygon array<struct<x: double, y: double>>")
    got = {r.zone_id: r for r in zones.placed_zones(samples, cells, camera, shape).collect()}
    assert got[7].reason is None and got[7].area == pytest.approx(0.36, abs=0.01) and got[7].nz == pytest.approx(1.0) and len(got[7].vertices) == 4
    assert got[8].reason == "too few points" and got[9].reason == "too few points" and got[9].points == 0
    wide = {r.zone_id: r for r in zones.placed_zones(samples.withColumn("zone_id", F.lit(9).cast("long")).filter("sx >= 30"), cells, camera, shape.filter("zone_id = 9")).collect()}
    assert wide[9].reason == "too large"


def test_layouts_of_tensors(spark):
    assert detect.row_layout(37, 32) == (False, 1) and detect.row_layout(38, 32) == (True, 1) and detect.row_layout(40, 32) == (False, 4)
    with pytest.raises(ValueError):
        detect.row_layout(36, 32)
    assert detect.output_layout((1, 33, 160, 160)) == "NCHW" and detect.output_layout((1, 160, 160, 33)) == "NHWC" and detect.output_layout((1, 8, 8, 8), "NHWC") == "NHWC"
    tensors = spark.createDataFrame([(1, 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "image_id long, d1 int, d2 int, values array<double>")
    got = {(r.image_id, r.det): r["values"] for r in detect.detection_rows(tensors).collect()}
    assert got[1, 0] == [1.0, 2.0] and got[1, 2] == [5.0, 6.0] and got[2, 0] == [1.0, 4.0] and got[2, 2] == [3.0, 6.0]
    cells = {(r.c, r.y, r.x): r.value for r in detect.tensor_cells(spark.createDataFrame([(1, 2, 1, 2, [1.0, 2.0, 3.0, 4.0])], "image_id long, channels int, height int, width int, values array<double>"), "NHWC").collect()}
    assert cells == {(0, 0, 0): 1.0, (1, 0, 0): 2.0, (0, 0, 1): 3.0, (1, 0, 1): 4.0}
    box = spark.createDataFrame([(10.0, 10.0, 700.0, 320.0, 1280, 320)], "left double, top double, right double, bottom double, image_width int, image_height int")
    r = detect.rescaled(box, 640, 640).first()
    assert (r.left, r.top, r.right, r.bottom) == (20.0, 5.0, 1280.0, 160.0)


def test_model_catalogue(spark):
    rows = models.with_specs(spark.createDataFrame([(1, "points-yolo-stardist"), (2, "none")], "image_id long, model_name string"), models.specs(spark)).collect()
    assert [(r.image_id, r.family, r.threshold, r.border) for r in rows] == [(1, "dense", 0.5, 2)]


def test_correction_log_and_vectors(spark, tmp_path):
    lines = ['{"session_id": "a", "seq": 1, "op": "add", "position": {"x": 1, "y": 2, "z": 3}, "other": 1}', '{"session_id": "a", "seq": 2, "op": "reset"}', '{"seq": 3, "op": "add"}', '{"session_id": "a", "seq": 4, "op": "odd"}', "broken"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(lines))
    good, bad = records.read_corrections(spark, f"{tmp_path}/log")
    assert sorted((r.seq, r.op) for r in good.collect()) == [(1, "add"), (2, "reset")] and bad.count() == 3
    row = spark.range(1).select(records.to_json_vector(F.lit(1), F.lit(2.5), F.lit(-3)).alias("j")).select("j", records.from_json_vector(F.col("j")).alias("v"), records.from_json_vector(F.lit('{"x": 1}')).alias("n"), records.from_json_vector(F.lit('{"x": 1, "y": 0, "z": 0, "w": 2}'), 4).alias("q")).first()
    assert json.loads(row.j) == {"x": 1.0, "y": 2.5, "z": -3.0} and tuple(row.v) == (1.0, 2.5, -3.0) and row.n is None and row.q.w == 2.0


def test_writers(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.5), (2, 0.7)], "image_id long, score double")
    for _ in range(2):
        records.write_predictions(p, f"{tmp_path}/p", "run1")
    assert spark.read.json(f"{tmp_path}/p").count() == 2
    records.write_report({"validation": p.agg(F.max("score").alias("best"))}, f"{tmp_path}/r", threshold=0.5, seed=42)
    r = spark.read.json(f"{tmp_path}/r").first()
    assert r.validation.best == 0.7 and (r.threshold, r.seed) == (0.5, 42)
    pairs = records.training_pairs(spark.createDataFrame([("a/x.png",), ("a/y.png",)], "path string"), spark.createDataFrame([("m/x.tif",)], "path string"))
    assert [tuple(r) for r in pairs.collect()] == [("x", "a/x.png", "m/x.tif")]
    assert annotations.class_manifest(["bar"]).splitlines()[3:] == ["nc: 1", "names: [bar]"]


def test_texts_and_ids(spark):
    df = spark.createDataFrame([(3, 12.34, 0.98, 0.6, -0.8, 0.421, True, 5)], "zone_id long, angle double, dot double, planar_x double, planar_y double, coverage double, fully_inside boolean, points long")
    text = df.select(placement.metrics_text(F.lit(1)).alias("a"), placement.metrics_text(F.lit(3)).alias("b")).first()
    assert text.a == "zone 3: angle 12.3, dot 0.98, direction (0.60, -0.80), coverage 42.1%, inside Y, 1 quiet merges, 5 points" and ", placed," in text.b
    ids = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (1, 10)], "zone long, first long").select(resolve.stable_id(F.col("zone"), F.col("first")).alias("i")).collect()
    assert ids[0] == ids[3] and len({r.i for r in ids}) == 3


def test_assignments_are_refreshed_by_session(spark, tmp_path):
    schema = "session_id long, point_id long, x double"
    assign = lambda p: p.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    for k, rows in enumerate(([(1, 1, 1.0), (2, 1, 5.0)], [(1, 2, 2.0), (1, 1, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = sessions.refresh(spark.readStream.schema(schema).json(f"{tmp_path}/in"), assign, f"{tmp_path}/table", f"{tmp_path}/checkpoint", every="1 second")
        q.processAllAvailable()
        q.stop()
    got = {r.session_id: (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/table/assigned").collect()}
    assert got == {1: (2, 3.0), 2: (1, 5.0)}
