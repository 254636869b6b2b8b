"""Counting objects of whole zones at once, in rounds of joins: no task holds a zone.

A sure edge seeds if it is the best of both its observations. Seeds that no
better one is near take all sure edges around them; what those agree on is a
component. Seeds work side by side: they are so far apart that no edge is near
two of them. Observations that are used up, and places that were tried, are out
in the next round; rounds end when nothing seeds any more.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import vec as v
from parallaxis.operators import fuse, resolve
from parallaxis.operators.triangulate import BEST, DISSOLVE, MIN_EDGES
from parallaxis.scratch import cut

#: The most rounds; what still seeds then is left out, and count_objects raises an error.
MOST = 40


def _observation(side: str) -> Column:
    return F.struct(F.col(f"{side}_frame_id").alias("frame_id"), F.col(f"{side}_det_id").alias("det_id"))


def _near(points: DataFrame, others: DataFrame, radius: float, within: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of points and others (zone_id, seed, sx, sy, sz, ...) of a zone that are within radius, or that of each point, by cells of the size of radius; the others, which are few, go to all 27 cells around theirs."""
    cell = lambda c: F.floor(F.col(c) / radius)
    own = points.withColumns({"g" + n: cell(n) for n in "xyz"})
    spread = others.withColumns({"g" + n: cell("s" + n) for n in "xyz"})
    for n in "xyz":
        spread = spread.withColumn("g" + n, F.explode(F.array(*(F.col("g" + n) + k for k in (-1, 0, 1)))))
    far = v.length(v.sub(v.vec(""), v.vec("s")))
    cells = ["zone_id", "gx", "gy", "gz"]
    spread = spread.select(*(F.col(c).alias("_" + c if c in cells else c) for c in spread.columns))
    met = own.join(spread, reduce(and_, (F.col(c) == F.col("_" + c) for c in cells)) & (far <= F.lit(radius)) & (F.lit(True) if within is None else far <= within), how)
    return met.drop("gx", "gy", "gz", *("_" + c for c in cells))


def _halves(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select("zone_id", *columns, F.explode(F.array("a", "b")).alias("o"))


def sure_edges(rays: DataFrame, pairs: DataFrame, candidates: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure edges, against) of all zones at the thresholds that their number of frames has.

    Frames with too little support go first. Sure edges: zone_id, a, b
    (observations), conf (normalised), x, y, z, and the zone's radius,
    component_confidence. against: zone_id, a, b: pairs that were compared,
    clearly, and are no candidates of each other.
    """
    if "frames" not in candidates.columns:
        candidates = candidates.join(rays.groupBy("zone_id").agg(F.count_distinct("frame_id").alias("frames")), "zone_id")
    needed = [s + c for s in ("a_", "b_") for c in ("frame_id", "det_id", "conf", "n") if s + c in candidates.columns]
    limits = v.thresholds(F.col("frames"))
    own = candidates.select("zone_id", *needed, "distance", "x", "y", "z", "angle_conf", "frames").filter(F.col("distance") <= limits["forbidden"])
    marked = cut(fuse.mark_ambiguous(own, rays, limits["epsilon"]))
    every, marked = marked, marked.withColumns(limits)
    sound = marked.filter(~F.col("a_ignored") & ~F.col("b_ignored") & (F.col("distance") <= F.col("epsilon"))).join(boxes, "zone_id").filter(v.inside(v.vec(""), v.box()))
    conf = F.col("a_conf") * F.col("b_conf") * v.distance_confidence(F.col("distance"), F.col("epsilon")) * F.col("angle_conf")
    edges = sound.withColumn("conf", v.normalised_confidence(conf, F.col("min_confidence"), BEST))
    bad = fuse.frame_consistency(edges, rays).filter("rejected").select("zone_id", "frame_id")
    for side in "ab":
        edges = edges.join(bad.withColumnRenamed("frame_id", f"{side}_frame_id"), ["zone_id", f"{side}_frame_id"], "left_anti")
    sure = edges.filter(F.col("conf") >= F.greatest("conflict_confidence", "addition_confidence"))
    sure = sure.select("zone_id", _observation("a").alias("a"), _observation("b").alias("b"), "conf", "x", "y", "z", "radius", "component_confidence")
    return cut(sure), every


def _round(edges: DataFrame, marked: DataFrame, unclear: list[DataFrame], pairs: DataFrame, radius: float) -> tuple[DataFrame, DataFrame] | None:
    """(zone_id, seed, members and the component's summary of each seed of free edges; the edges that no seed has tried); None where nothing seeds."""
    order = F.struct("conf", "a", "b", "x", "y", "z")
    best = _halves(edges.withColumn("e", order), "e").groupBy("zone_id", "o").agg(F.max("e").alias("e"))
    seeds = best.groupBy("zone_id", "e").agg(F.count("*").alias("n")).filter("n = 2")
    seeds = cut(seeds.select("zone_id", F.struct("e.conf", "e.a", "e.b").alias("seed"), *(F.col("e." + n).alias("s" + n) for n in "xyz")))
    if not seeds.take(1):
        return None
    own = seeds.select("zone_id", F.col("seed").alias("mine"), *(F.col("s" + n).alias(n) for n in "xyz"))
    beaten = _near(own, seeds, 2 * radius).filter(F.col("mine") < F.col("seed")).select("zone_id", F.col("mine").alias("seed"))
    seeds = seeds.join(beaten.distinct(), ["zone_id", "seed"], "left_anti")
    met = cut(_near(edges, seeds, radius, F.col("radius"), "left"))  # no edge is near two seeds
    around, rest = met.filter("seed is not null"), met.filter("seed is null").drop("seed", "sx", "sy", "sz")

    votes = _halves(around, "seed", "conf").groupBy("zone_id", "seed", "o").agg(F.sum("conf").alias("votes"))
    votes = votes.groupBy("zone_id", "o").agg(F.max(F.struct("votes", "seed")).alias("v")).select("zone_id", "o", "v.votes", "v.seed")
    frame = F.col("o.frame_id")
    members = votes.groupBy("zone_id", "seed", frame.alias("frame_id")).agg(F.max(F.struct("votes", "o")).alias("v")).select("zone_id", "seed", "v.o", "v.votes")
    # of two members that were compared and are no candidates, the one of fewer votes goes
    one, two = (members.select("zone_id", "seed", F.col("o").alias(n), F.col("votes").alias(n + "_votes")) for n in "ab")
    met = one.join(two, ["zone_id", "seed"]).filter("a.frame_id < b.frame_id")
    met = met.join(pairs, (F.col("a.frame_id") == F.col("first_frame")) & (F.col("b.frame_id") == F.col("second_frame")), "left_semi")
    met = met.join(marked, ["zone_id", "a", "b"], "left_anti")
    for (side, other), few in zip(("ab", "ba"), unclear):
        few = few.withColumnRenamed("zone_id", "zone")
        met = met.join(few, (F.col("zone_id") == F.col("zone")) & (F.col(side) == F.col("o")) & (F.col(other + ".frame_id") == F.col("frame")), "left_anti")
    weaker = F.when(F.struct("a_votes", "a") < F.struct("b_votes", "b"), F.col("a")).otherwise(F.col("b"))
    members = cut(members.join(met.select("zone_id", "seed", weaker.alias("o")).distinct(), ["zone_id", "seed", "o"], "left_anti"))

    own = members.groupBy("zone_id", "seed").agg(F.collect_list("o").alias("members"))
    all_ = around.join(own, ["zone_id", "seed"], "left")
    components = resolve.component_summary(all_.filter(F.array_contains("members", F.col("a")) & F.array_contains("members", F.col("b"))), "zone_id", "seed")
    least = all_.groupBy("zone_id", "seed").agg(F.max("component_confidence").alias("least"), F.first("members").alias("members"))
    out = least.join(components, ["zone_id", "seed"], "left").withColumn("sound", F.coalesce((F.col("confidence") >= F.col("least")) & (F.col("edges") >= MIN_EDGES), F.lit(False)))
    return cut(out), rest


def count_objects(rays: DataFrame, pairs: DataFrame, candidates: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each member of each component of every zone: zone_id, component_id, frame_id, det_id, x, y, z, confidence, edges, name.

    The inputs are those of triangulate.count_objects. All frames count at
    once, at the thresholds of the last; a member never replaces another. A
    seed's edges and members are those of one place: frames squared at most.
    Of components at one place the surest stays; a zone may have more than any
    of its frames shows.
    """
    edges, marked = sure_edges(rays, pairs, candidates, boxes)
    unclear = [cut(marked.filter(f"{side}_ignored").select("zone_id", _observation(side).alias("o"), F.col(f"{other}_frame_id").alias("frame")).distinct()) for side, other in ("ab", "ba")]
    parts = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = marked.select("zone_id", _observation("a").alias("a"), _observation("b").alias("b")).repartition(parts, "zone_id", "a", "b").persist(StorageLevel.DISK_ONLY)  # no round shuffles them again
    radius = edges.agg(F.max("radius")).first()[0]
    compared = pairs.select("first_frame", "second_frame")
    found = None
    for _ in range(MOST):
        made = _round(edges, marked, unclear, compared, radius) if radius else None
        if made is None:
            break
        tried, edges = made
        sound = tried.filter("sound")
        found = sound if found is None else found.union(sound)
        used = sound.select("zone_id", F.explode("members").alias("o"))
        for side in "ab":
            edges = edges.join(used.withColumnRenamed("o", side), ["zone_id", side], "left_anti")
        edges = cut(edges)
    else:
        raise RuntimeError(f"zones still have seeds after {MOST} rounds")
    marked.unpersist()
    if found is None:
        return rays.limit(0).select("zone_id", F.lit(0).cast("long").alias("component_id"), "frame_id", "det_id", *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "confidence")), F.lit(0).cast("long").alias("edges"), F.lit("").alias("name"))
    found = cut(found.withColumn("first", F.array_min("members")))
    rank = F.struct("confidence", "first")
    own = found.select("zone_id", rank.alias("mine"), "x", "y", "z")
    other = found.select("zone_id", rank.alias("seed"), *(F.col(n).alias("s" + n) for n in "xyz"))
    twin = _near(own, other, DISSOLVE).filter(F.col("mine") < F.col("seed")).select("zone_id", F.col("mine.confidence").alias("confidence"), F.col("mine.first").alias("first")).distinct()
    alone = found.join(twin, ["zone_id", "confidence", "first"], "left_anti")
    place = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.desc("confidence"), "first"))
    kept = alone.withColumn("component_id", place.cast("long") - 1).withColumn("name", F.format_string("%d:%d", "first.frame_id", "first.det_id"))
    return kept.select("zone_id", "component_id", F.explode("members").alias("o"), "x", "y", "z", "confidence", "edges", "name").select("zone_id", "component_id", "o.frame_id", "o.det_id", "x", "y", "z", "confidence", "edges", "name")
