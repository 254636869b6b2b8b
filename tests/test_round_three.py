"""What larger tables showed in the third round."""

import numpy as np
from pyspark.sql import functions as F

from parallaxis.functions import poly
from parallaxis.operators import annotations, assign, detect, evaluate, frames, fuse, order, placement, triangulate, zones


def test_an_object_whose_edges_grew_twice_counts_once():
    limits = [{"radius": 0.018}] * (triangulate.SETTLED + 1)
    part = lambda frames, x, conf, det=1: triangulate.Component({f: (f, det) for f in frames}, {}, (x, 0.0, 0.0), conf)
    count = lambda *components, **known: len(triangulate.Zone(limits, components=list(components), **known).objects())
    assert count(part((0, 1, 3), 0.0, 5.5), part((5, 9), 0.0062, 1.9)) == 1
    assert count(part((0, 1, 3), 0.0, 5.5), part((3, 9), 0.0062, 1.9, det=2)) == 2  # frame 3 saw both
    assert count(part((0, 1, 3), 0.0, 5.5), part((5, 9), 0.03, 1.9)) == 2
    against = {"compared": {frozenset((0, 5))}}
    assert count(part((0, 1, 3), 0.0, 5.5), part((5, 9), 0.0062, 1.9), **against) == 2


def test_numbers_in_folders_need_no_shuffle_by_folder(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("folder"), F.col("id").alias("det"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = annotations._numbered_by_folder(rows, "det")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.det, r.ann) for r in out.collect()} == {(k, k // 3 + 1) for k in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shapes_without_taps_are_not_cut_into_cells(spark):
    taps = spark.createDataFrame([(1, 1, 5.0, 5.0)], "image_id long, tap_id long, x double, y double")
    shapes = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 1, 0.0, 1e13)], "image_id long, shape_id long, low double, high double")
    low, high = F.col("low"), F.col("high")
    shapes = shapes.select("image_id", "shape_id", poly.box_polygon(low, low, high, high).alias("polygon"), ((low + high) / 2).alias("cx"), ((low + high) / 2).alias("cy"))
    assert [tuple(r) for r in placement.picked(taps, shapes, "image_id").collect()] == [(1, 1, 1, "inside")]


def test_suppression_gives_back_whole_rows_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(detect, "PAIRS", 5)  # several steps an image
    boxes = spark.createDataFrame([(1, k, 0.9 - k / 100, float(k * 3), 0.0, float(k * 3 + 10), 10.0, f"n{k}") for k in range(9)], "image_id long, det long, score double, left double, top double, right double, bottom double, name string")
    out = detect.suppress(boxes, "image_id", above=0.5)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.det, r.name) for r in out.collect()} == {(k, f"n{k}") for k in (0, 2, 4, 6, 8)}


def test_met_boxes_are_those_of_overlaps(spark, monkeypatch):
    monkeypatch.setattr(detect, "PAIRS", 7)  # several steps an image
    rng = np.random.default_rng(5)
    low = rng.integers(0, 40, (2, 30, 2)).astype(float)
    boxes = np.concatenate([low, low + rng.integers(1, 30, (2, 30, 2))], axis=2)
    tables = [spark.createDataFrame([(1, k, *map(float, b)) for k, b in enumerate(side)], "image_id long, det long, left double, top double, right double, bottom double") for side in boxes]
    want = {(r.t, r.p, r.iou) for r in evaluate.overlaps(*tables, "image_id").filter("iou >= 0.3").collect()}
    assert set(zip(*(x.tolist() for x in evaluate.met_boxes(*boxes, 0.3)))) == want and want
    assert evaluate._alone(np.array([1, 1, 2, 3]), np.array([5, 6, 7, 6])).tolist() == [False, False, True, False]


def test_cells_are_shuffled_in_runs_of_an_image(spark):
    rows = [(k, x, y, None if ((k or 0) + x + y) % 11 == 0 else ((k or 0) * 7 + x * 13 + y * 29) % 256) for k in (None, 0, 1, 2) for x in range(5) for y in range(4) if (x + y * k if k else x) % 5 < 4]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, luma int").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # images run over batches
    try:
        out = frames.image_statistics(pixels)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.image_id: tuple(round(v, 6) for v in r[1:]) for r in out.collect()}
        tiles = pixels.withColumn("x0", F.explode(F.array(F.lit(0), F.lit(2)))).select("image_id", "x0", F.lit(0).alias("y0"), "x", "y", F.col("luma").alias("value"))
        made = frames.stitched(tiles)
        assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
        stitched = {(r.image_id, r.x, r.y): r.value for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, cells = {}, {}
    for k in (None, 0, 1, 2):
        own = {(x, y): v for i, x, y, v in rows if i == k}
        for (x, y), v in own.items():
            for x0 in (0, 2):
                cells.setdefault((k, x + x0, y), []).append(v)

        def both(along, at):
            line = sorted(p for p in own if p[1 - along] == at[1 - along])
            n = line.index(at)
            before, after = (own[line[m]] if 0 <= m < len(line) else None for m in (n - 1, n + 1))
            before, after = (after if before is None else before), (before if after is None else after)
            return None if before is None else before + after

        lap = [both(0, p) + both(1, p) - 4 * v for p, v in own.items() if v is not None and both(0, p) is not None and both(1, p) is not None]
        luma = [v for v in own.values() if v is not None]
        want[k] = tuple(round(float(v), 6) for v in (np.mean(luma), np.std(luma), np.mean([v <= 24 for v in luma]), np.mean([v >= 231 for v in luma]), np.var(lap)))
    assert got == want
    known = {c: [v for v in values if v is not None] for c, values in cells.items()}
    assert stitched == {c: sum(v) / len(v) if v else None for c, v in known.items()}


def shuffled(spark):
    """Rows shuffled so far."""
    context = spark.sparkContext
    nothing = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, *nothing)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_nearest_of_crowds_lattices_and_groups_meet_in_blocks(spark, monkeypatch):
    """Equal points, equal distances and a far group, in many blocks dealt in shares, are those of all pairs; few rows are shuffled."""
    rng = np.random.default_rng(3)
    at = np.concatenate([np.tile([1.0, 1.0, 1.0], (150, 1)), rng.integers(0, 6, (300, 3)) * 0.5, rng.normal(100, 30, (150, 3)), rng.normal(0, 1, (4, 3))])
    group = np.r_[np.zeros(600, int), np.ones(4, int)]
    ids = [f"p{k}" for k in rng.permutation(len(at))]
    rows = [(int(g), i, *map(float, p)) for g, i, p in zip(group, ids, at)] + [(0, "nowhere", None, 0.0, 0.0), (0, "nan", float("nan"), 0.0, 0.0), (None, "alone", 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "scene long, point_id string, x double, y double, z double").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = lambda: {(r.point_id, r["rank"]): (r.target_id, r.distance) for r in order.k_nearest(points, points.withColumnRenamed("point_id", "target_id"), 7, "scene").collect()}
        before = shuffled(spark)
        whole = run()
        assert shuffled(spark) - before < 20 * len(rows)  # in cells each point went to 27
        monkeypatch.setattr(order, "BLOCK_BITS", 5)
        monkeypatch.setattr(order, "SHARE", 20)
        got = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == whole
    far = np.round(np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)), 12)
    want = {}
    for i in range(len(at)):
        own = sorted((far[i, j], ids[j]) for j in range(len(at)) if group[j] == group[i])[:7]
        want.update({(ids[i], n + 1): (t, d) for n, (d, t) in enumerate(own)})
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_median_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, float(x)) for k, x in enumerate(np.round(rng.exponential(1, 6001), 3))] + [(3, 1.0), (3, 2.0), (4, 7.0)]
    got = {r.g: r.d for r in order.median(spark.createDataFrame(rows, "g long, d double"), "d", "g", accuracy=200).collect()}
    assert got == {g: float(np.median([d for k, d in rows if k == g])) for g in range(5)}


def test_rounds_of_votes_shuffle_labels_not_edges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, 0, *map(float, p), 0.9) for k, p in enumerate(rng.uniform(0, 1, (600, 3)))]
    points = spark.createDataFrame(rows, "point_id long, scene long, x double, y double, z double, conf double")
    zones = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 0.9, 0.9, 0.9)], "zone_id long, cx double, cy double, cz double")
    run = lambda rounds: {tuple(r) for r in assign.propagate(points, zones, "scene", rounds=rounds).collect()}
    start = shuffled(spark)
    few = run(1)
    first = shuffled(spark)
    many = run(5)
    assert few != many and (shuffled(spark) - first) - (first - start) < 4 * 2 * len(rows)
    monkeypatch.setattr(order, "BLOCK_BITS", 5)  # labels cross blocks
    assert run(5) == many


def test_no_stage_of_a_plane_holds_several_fits(spark):
    points = spark.range(400).select((F.col("id") % 4).alias("zone"), F.col("id").alias("point_id"), F.sin("id").alias("x"), F.cos(F.col("id") * 7).alias("y"), F.sin(F.col("id") * 3).alias("z"))
    out = zones.fit_plane(points, "zone")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4


def test_marking_candidates_of_sized_rays_needs_no_join(spark):
    rows = [(z, f, k, 0.9, f * 0.1, 0.0, 3.0, k * 0.1 - f * 0.03, 0.0, -1.0) for z in (0, 1) for f in range(4) for k in range(3 + z)]
    rays = spark.createDataFrame(rows, "zone_id long, frame_id long, det_id long, conf double, ox double, oy double, oz double, dx double, dy double, dz double")
    pairs = spark.createDataFrame([(a, b) for b in range(4) for a in range(b)], "first_frame long, second_frame long")
    plain, sized = (fuse.ray_candidates(r, pairs) for r in (rays, fuse.with_sizes(rays)))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(fuse.mark_ambiguous(sized, rays)) == joins(sized)
    columns = ["zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id", "a_ignored", "b_ignored"]
    a, b = (sorted(tuple(r) for r in fuse.mark_ambiguous(c, rays).select(columns).collect()) for c in (plain, sized))
    assert a == b and a
