"""Summaries, audits and set operations of components and their edges, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import vec as v
from parallaxis.operators.triangulate import BONUS, FREE_EDGES, MIN_EDGES

#: Least confidence of a component.
COMPONENT = 1.5


def component_summary(edges: DataFrame, *keys: str) -> DataFrame:
    """Centre (weighted by confidence), confidence (mean times root of the number of edges, unclamped) and edges of each component."""
    weight = F.sum("conf")
    return edges.groupBy(*keys).agg(
        *((F.sum(F.col(c) * F.col("conf")) / weight).alias(c) for c in "xyz"),
        (F.avg("conf") * F.sqrt(F.count("*"))).alias("confidence"),
        F.count("*").alias("edges"),
        F.least(F.lit(1.0), F.avg("conf")).alias("confidence_norm"),
    )


def is_valid(least: float = COMPONENT) -> Column:
    return (F.col("confidence") >= least) & (F.col("edges") >= MIN_EDGES)


def near_pairs(points: DataFrame, key: str, radius: float, *within: str) -> DataFrame:
    """first, second (first < second), distance: points no farther apart than radius, by grid cells of that size and their neighbours."""
    cell = [F.floor(F.col(c) / radius) for c in "xyz"]
    a = points.select(*within, F.col(key).alias("first"), *(F.col(c).alias("a" + c) for c in "xyz"), *(c.alias("c" + n) for c, n in zip(cell, "xyz")))
    b = points.select(*within, F.col(key).alias("second"), *(F.col(c).alias("b" + c) for c in "xyz"), *(c.alias("c" + n) for c, n in zip(cell, "xyz")))
    for n in "xyz":
        b = b.withColumn("c" + n, F.explode(F.array(*(F.col("c" + n) + k for k in (-1, 0, 1)))))
    met = a.join(b, [*within, "cx", "cy", "cz"]).filter("first < second")
    met = met.withColumn("distance", v.length(v.sub(v.vec("a"), v.vec("b")))).filter(F.col("distance") <= radius)
    return met.select(*within, "first", "second", "distance")


def largest_frame(observations: DataFrame, *keys: str) -> DataFrame:
    """The most observations that one frame has: no more components can be right."""
    return observations.groupBy(*keys, "frame_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("largest"))


def surplus(components: DataFrame, limits: DataFrame, *keys: str) -> DataFrame:
    """The weakest components beyond the limit."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "component_id")
    return components.join(limits, list(keys)).withColumn("place", F.row_number().over(order)).filter(F.col("place") > F.col("largest")).drop("place", "largest")


def retained(edges: DataFrame, *keys: str, most: int = FREE_EDGES) -> DataFrame:
    """The most promising free edges: by confidence plus a bonus that fades with age in generations, then generation, then confidence."""
    own = Window.partitionBy(*keys)
    age = F.max("generation").over(own) - F.col("generation")
    ranked = edges.withColumn("priority", F.col("conf") + BONUS / (age + 1))
    ranked = ranked.withColumn("place", F.row_number().over(own.orderBy(F.desc("priority"), F.desc("generation"), F.desc("conf"), "edge_id")))
    return ranked.filter(F.col("place") <= most).drop("place")


def stable_id(zone: Column, first_observation: Column) -> Column:
    """An identity of a component that survives recentring: its zone and its least observation."""
    return F.xxhash64(zone, first_observation)


def free_edges(edges: DataFrame, used: DataFrame) -> DataFrame:
    """Edges of which no end is used: set difference by key. used: zone_id, frame_id, det_id."""
    for side in "ab":
        edges = edges.join(used.select("zone_id", F.col("frame_id").alias(f"{side}_frame_id"), F.col("det_id").alias(f"{side}_det_id")).distinct(), ["zone_id", f"{side}_frame_id", f"{side}_det_id"], "left_anti")
    return edges


def with_released(edges: DataFrame, released: DataFrame) -> DataFrame:
    """New and released edges, each once."""
    keys = ["zone_id", "a_frame_id", "a_det_id", "b_frame_id", "b_det_id"]
    return edges.unionByName(released).dropDuplicates(keys)
