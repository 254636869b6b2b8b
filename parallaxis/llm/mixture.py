"""Mixing sources to target weights along a time-varying curriculum.

Targets share a budget of words by source weight, none above a cap. Each
source's weight over the training run is a piecewise linear schedule; its
integral is the source's cumulative demand, and inverting that gives every
document the position at which its words are due.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from parallaxis.llm import _work

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
#: For each weight, in order: (progress, relative weight) knots. Heavy sources come early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents that one window task orders, about.
ROWS_PER_SHARD = 20_000


def inverse_demand(done: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """Progress at which a share (0 to 1) of a source's words has been asked for: the inverse of the schedule's integral."""
    areas = [(t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in zip(schedule, schedule[1:])]
    sums = [0.0, *accumulate(areas)]
    asked = done * sums[-1]
    out = F.lit(float(schedule[-1][0]))
    for k in reversed(range(len(areas))):
        (t1, a), (t2, b) = schedule[k], schedule[k + 1]
        rest = F.greatest(asked - sums[k], F.lit(0.0))
        slope = (b - a) / (t2 - t1)
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
        here = F.when(root + a > 0, t1 + 2 * rest / (root + a)).otherwise(float(t1))
        out = F.when(asked <= sums[k + 1], here).otherwise(out)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source_key, source_size -> with kind (place in weights) and target.

    Shares run by weight; sources that would pass cap times their size stop
    there, and the rest shares what they leave. In order of size over weight,
    the capped sources come first, so one pass of running sums settles it.
    This runs over one row a source.
    """
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    kind = F.pmod(rank, F.lit(len(weights))).cast("int")
    s = sources.select("source_key", "source_size", kind.alias("kind")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    whole = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum(F.col("source_size") * float(cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("free", F.sum("source_size").over(whole) * float(budget) - F.col("before"))
    s = s.withColumn("within", F.col("free") * F.col("weight") / F.col("left") <= F.col("source_size") * float(cap))
    first = F.min(F.when(F.col("within"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "source_key", "free", "left"))).over(whole)
    s = s.withColumn("first", first)
    is_capped = F.col("first").isNull() | (F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "source_key") < F.struct("first.ratio", "first.source_key"))
    return s.select("source_key", "source_size", "kind", F.when(is_capped, F.col("source_size") * float(cap)).otherwise(F.col("first.free") * F.col("weight") / F.col("first.left")).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """documents with size, source_size, target, taken, passes.

    Inside a source, documents queue in the order of a hash of doc_id (ties by
    doc_id and size), and the mix walks the queue, from its front again after
    its end, until the target is met; the last document is cut there. passes
    has (pass, words, position) for each walk that takes words, with the
    position in the training run, from 0 to 1, at which they are due.
    A null text has no words; null sources make one source, the last; rows of
    repeated doc_id queue each, and so do those without a doc_id, in the order
    of a hash of the whole row. Other columns come along, but for those whose
    names, in any case, clash with columns made here. Rows alike in all columns
    take places like any others, but are moved once, and their places are
    joined to them: very many of them are gathered in no task.
    """
    clash = {"size", "source_size", "target", "taken", "passes", "source_key", "kind", "queue", "shard", "before", "id_key", "row_key", "other_key", "row"}
    own = [c for c in documents.columns if c.lower() not in clash]
    docs = documents.select(*own, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    docs = docs.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")))
    values = [F.map_entries(c) if isinstance(documents.schema[c].dataType, MapType) else F.col(c) for c in own]
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in own])  # the hash passes over nulls
    docs = docs.withColumn("row_key", F.xxhash64(nulls, *values)).withColumn("other_key", F.xxhash64(F.lit(seed), *values, nulls))
    docs = docs.withColumn("id_key", F.coalesce("doc_id", F.lit(0)))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("row_key").cast("string")))
    docs = docs.withColumn("queue", F.md5(F.concat(F.lit(seed), named)))
    alike = ("id_key", "row_key", "other_key")
    placed = place(docs.select("doc_id", *alike, "source_key", "queue", "size"), weights, schedules, budget, cap)
    rows = docs.groupBy(*alike).agg(F.first(F.struct(*own)).alias("row"))
    return placed.select(*alike, "size", "source_size", "target", "taken", "passes").join(rows, [*alike]).select("row.*", "size", "source_size", "target", "taken", "passes")


def place(keys: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """doc_id, source_key, queue, size, ... -> with source_size, target, taken and passes.

    A source is cut into shards along its queue, so that a hot one is ordered
    by many tasks; shard totals give each shard's beginning.
    """
    keys = _work.stored(keys, "sizes")
    rows = keys.count()
    digits = 1
    while 16**digits * ROWS_PER_SHARD < 4 * rows and digits < 8:
        digits += 1
    keys = keys.withColumn("shard", F.substring("queue", 1, digits))
    shards = keys.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"))
    sources = targets(shards.groupBy("source_key").agg(F.sum("shard_size").alias("source_size")), weights, budget, cap)
    along = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("shard_before", F.coalesce(F.sum("shard_size").over(along), F.lit(0))).join(sources, "source_key").drop("shard_size")
    inside = Window.partitionBy("source_key", "shard").orderBy("queue", "doc_id", "size", *[c for c in ("row_key",) if c in keys.columns]).rowsBetween(Window.unboundedPreceding, -1)
    d = keys.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(shards, ["source_key", "shard"])
    d = d.withColumn("before", F.col("inside") + F.col("shard_before"))
    goal = F.floor(F.col("target") + 0.5)
    share = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("source_size") * k - F.col("before"))).cast("long") for k in range(int(cap))]

    def position(k: int) -> Column:
        done = (F.col("before") + F.col("source_size") * k) / F.col("target")
        out = inverse_demand(done, schedules[-1])
        for i in range(len(schedules) - 1):
            out = F.when(F.col("kind") == i, inverse_demand(done, schedules[i])).otherwise(out)
        return F.when(F.col("target") > 0, out).otherwise(0.0)

    passes = F.filter(F.array(*[F.struct(F.lit(k).alias("pass"), share[k].alias("words"), F.round(position(k), 9).alias("position")) for k in range(int(cap))]), lambda p: p["words"] > 0)
    return d.withColumn("taken", sum(share[1:], share[0])).withColumn("passes", passes).drop("shard", "inside", "shard_before")


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Documents as training reads them: a row for each pass, range-sorted by position."""
    rows = mixed.select(*columns, F.explode("passes").alias("p")).select(*columns, F.col("p.pass").alias("pass"), F.col("p.words").alias("taken"), F.col("p.position").alias("position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "pass")


def with_places(ordered: DataFrame) -> DataFrame:
    """Rows of in_order with place, their number in training order from 0. Rows are numbered inside their ranges, whose sizes are summed up; no task sees all rows."""
    rows = _work.stored(ordered.withColumn("numbered", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("numbered", 33), F.col("numbered").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("range")).agg(F.count("*").alias("n"))  # a row for each task that sorted
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.withColumn("range", part).join(F.broadcast(sizes.drop("n")), "range")
    return out.withColumn("place", F.col("before") + inside).drop("range", "numbered", "before")
