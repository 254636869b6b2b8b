import json
import random

import pandas as pd
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.operators import annotations, frames, models, shapes
from parallaxis.sources import records
from parallaxis.streaming import sessions


def test_hull_of_a_grid_and_of_few_points(spark):
    rows = [(1, float(x), float(y)) for x in range(5) for y in range(5)] + [(2, 0.0, 0.0), (2, 1.0, 1.0), (2, 1.0, 1.0)]
    got = {}
    for r in shapes.hulls(spark.createDataFrame(rows, "k long, x double, y double"), "k").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    assert got == {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(0, 0), (1, 1)]}
    boxes = spark.createDataFrame([(1, 0, 0, 9, 9), (2, 0, 0, 3, 2), (3, 0, 0, 1, 1)], "k long, left int, top int, right int, bottom int")
    sizes = {r.k: r.a for r in shapes.hull_or_box(spark.createDataFrame(rows, "k long, x double, y double"), boxes, "k").select("k", poly.area(F.col("polygon")).alias("a")).collect()}
    assert sizes == {1: 16, 2: 6, 3: 1}


def test_contour_of_the_largest_part(spark):
    cells = [(1, y, x, 5) for y in range(4) for x in range(3)] + [(1, 9, 9, 5)] + [(1, 0, 8, 6)]
    df = spark.createDataFrame(cells, "image_id long, y int, x int, label int")
    got = {r.label: r for r in shapes.largest_contours(df, "image_id").collect()}
    assert got[5].area == 12 and {(p.x, p.y) for p in got[5].polygon} == {(0, 0), (3, 0), (3, 4), (0, 4)}
    assert got[6].area == 1 and len(got[6].polygon) == 4
    assert shapes.boundary(df.filter("label = 5 and x < 5"), "image_id").count() == 10


def test_simplified_rings_keep_their_corners(spark):
    ring = [(float(x), 0.0) for x in range(10)] + [(9.0, float(y)) for y in range(1, 10)] + [(float(x), 9.0) for x in range(8, -1, -1)] + [(0.0, float(y)) for y in range(8, 0, -1)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring]), (2, None)], "id long, polygon array<struct<x:double,y:double>>")
    got = {r.id: r.polygon for r in shapes.simplify(df).collect()}
    assert {(p.x, p.y) for p in got[1]} == {(0, 0), (9, 0), (9, 9), (0, 9)} and got[2] is None


def test_samples_lie_inside(spark):
    triangle = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 0.0, "y": 10.0}]
    df = spark.createDataFrame([(1, triangle)], "id long, polygon array<struct<x:double,y:double>>")
    got = shapes.samples(df, "id").collect()
    assert len(got) == 20 and all(r.x >= 0 and r.y >= 0 and r.x + r.y <= 10 for r in got)
    assert [(r.x, r.y) for r in got if r.place == 1] == [(5, 5)]


def test_predictors(spark):
    images = spark.createDataFrame([(1, 100, 50, "a"), (2, 10, 10, "b")], "image_id long, width int, height int, target string")

    def load():
        return lambda batch: pd.DataFrame({"image_id": batch.image_id, "det": 1, "left": 0.0, "top": 0.0, "right": batch.width * 1.0, "bottom": batch.height * 1.0, "score": 0.5})

    whole = models.predict(images, load)
    assert {(r.image_id, r.right) for r in whole.collect()} == {(1, 100), (2, 10)}
    routed = models.by_target(images, {"a": lambda df: models.predict(df, load), "b": lambda df: models.centred_box(df, 4, 4)})
    assert {(r.image_id, r.left, r.score) for r in routed.collect()} == {(1, 0, 0.5), (2, 3, 1.0)}


def coco(tmp_path):
    for subset, body in (("s1", {"images": [{"id": 1, "width": 10, "height": 10, "file_name": "a.png"}, {"id": 2, "width": 10, "height": 10, "file_name": "b.png"}], "categories": [{"id": 1, "name": "bar"}, {"id": 2, "name": "other"}], "annotations": [
        {"id": 1, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4]], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 4, 0]], "iscrowd": 0},
        {"id": 3, "image_id": 1, "category_id": 2, "segmentation": [[0, 0, 4, 0, 4, 4]]}, {"id": 4, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4]], "iscrowd": 1}]}),):
        for name, data in ((f"{subset}/annotations/instances_default.json", json.dumps(body, indent=1)), (f"{subset}/images/default/a.PNG", "x"), ("s2/annotations/instances_default.json", "{}"), (f"{subset}/images/default/notes.md", "x")):
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(data)


def test_annotation_scan(spark, tmp_path):
    coco(tmp_path)
    images, rows = records.read_annotations(spark, f"{tmp_path}/s1/annotations/*.json")
    got = {r.file_name: r.polygons for r in annotations.images_with_polygons(images, annotations.usable(rows, ["bar"])).collect()}
    assert got == {"a.png": 1, "b.png": 0}
    assert {(r.subset, r.usable) for r in records.subsets(spark, str(tmp_path)).collect()} == {("s1", True), ("s2", False)}
    assert [r.path.rsplit("/", 1)[1] for r in records.image_files(spark, str(tmp_path)).collect()] == ["a.PNG"]


def test_documents_and_lines_out(spark, tmp_path):
    images = spark.createDataFrame([("f", 1, 10, 10, "a.png"), ("g", 2, 10, 10, "b.png")], "folder string, id long, width int, height int, file_name string")
    rows = spark.createDataFrame([("f", 1, 1, [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]], [0.0, 0.0, 1.0, 1.0], 0.5)], "folder string, id long, image_id long, segmentation array<array<double>>, bbox array<double>, area double")
    records.write_annotations(images, rows, f"{tmp_path}/out")
    got = {r.folder: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()}
    assert len(got["f"]["annotations"]) == 1 and got["g"]["annotations"] == [] and got["f"]["licenses"] == []
    lines = spark.createDataFrame([("train", "a", 2, "0 2"), ("train", "a", 1, "0 1")], "split string, image string, det long, line string")
    records.write_label_lines(lines, f"{tmp_path}/lines")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines", wholetext=True).collect()] == ["0 1\n0 2\n"]


def test_predictions_and_snapshots(spark, tmp_path):
    bodies = spark.createDataFrame([('{"filename": "a", "width": 1, "height": 1, "count": 0, "instances": [], "extra": 1}',), ("{bad" + "x" * 3000,), (None,)], "body string")
    good, bad = records.parse_predictions(bodies)
    assert [r.filename for r in good.collect()] == ["a"] and sorted(len(r.body or "") for r in bad.collect()) == [0, 2000]
    (tmp_path / "s.json").write_text('{"session_id": "s", "request_id": "r", "zone_id": 1, "frame": {"png": "AAAA", "width": 3, "distortion": [1.0]}, "angle": 1.0, "coverage": 0.5, "more": 2}\n')
    snap = records.read_snapshots(spark, str(tmp_path / "s.json"))
    frame = json.loads(records.audit(snap).first().json)["frame"]
    assert frame["width"] == 3 and "png" not in frame and "distortion" not in frame
    ok, no = records.consistent(snap.withColumn("header_session", F.lit("t")))
    assert ok.count() == 0 and no.count() == 1


def drain(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams_equal_their_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, s * 100 + i, i * 20_000 + s, rng.random() < 0.3) for s in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id long, frame_id long, us long, good boolean").withColumn("ts", F.timestamp_micros("us"))
    df = df.withColumns({"dark": F.when(F.col("good"), 0.0).otherwise(0.9), "bright": F.lit(0.0), "luma_std": F.lit(50.0), "lap": F.lit(500.0)}).drop("us", "good")
    df.write.parquet(f"{tmp_path}/frames")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/frames")
    want = {(r.session_id, r.frame_id, r.accepted, r.forced) for r in frames.gate(df.withColumns({"move": F.lit(0.0), "turn": F.lit(0.0)})).collect()}
    assert {tuple(r) for r in drain(spark, sessions.gate(sessions.with_ok(stream)), "gated")} == want
    counted = drain(spark, sessions.frames_per_window(stream), "counted", "complete")
    assert sum(r.n for r in counted) == len(rows)
