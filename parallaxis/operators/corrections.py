"""Manual corrections, request lifecycle and counts by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(requests: DataFrame) -> DataFrame:
    """total, queued, processing, completed, failed of each zone of a session; requests: session_id, zone_id, state (the present one)."""
    states = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")
    return requests.groupBy("session_id", "zone_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s.lower()) for s in states))


def status_text() -> Column:
    return F.format_string("%d total: %d queued, %d processing, %d completed, %d failed", *(F.col(c) for c in ("total", "queued", "processing", "completed", "failed")))


def lifecycle(events: DataFrame) -> DataFrame:
    """Present state of each request (session_id, request_id): the last event's, and whether it was deleted, which counts only before processing began."""
    e = events.groupBy("session_id", "request_id").agg(
        F.max_by("state", F.struct("ts", "seq")).alias("last"), F.min(F.when(F.col("state") == "DELETE", F.struct("ts", "seq"))).alias("deleted"), F.min(F.when(F.col("state").isin("PROCESSING", "COMPLETED", "FAILED"), F.struct("ts", "seq"))).alias("begun"),
        F.max_by("state", F.when(F.col("state") != "DELETE", F.struct("ts", "seq"))).alias("working"),
    )
    gone = F.col("deleted").isNotNull() & (F.col("begun").isNull() | (F.col("deleted") < F.col("begun")))
    return e.select("session_id", "request_id", F.when(gone, "DELETED").otherwise(F.col("working")).alias("state"))


def overlay(points: DataFrame, overrides: DataFrame, deleted: DataFrame, manual: DataFrame) -> DataFrame:
    """Points (session_id, point_id, zone_id, ...) under zone overrides, less the deleted, plus manual ones."""
    keys = ["session_id", "point_id"]
    moved = points.join(overrides.withColumnRenamed("zone_id", "override"), keys, "left").withColumn("zone_id", F.coalesce("override", "zone_id")).drop("override")
    return moved.join(deleted.select(*keys).distinct(), keys, "left_anti").unionByName(manual, allowMissingColumns=True)


def valid_points(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Manual points with reason, null where they are fine: finite position, confidence in [0, 1], a known zone if one is asked for."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = points.join(zones.select(F.col("zone_id"), F.lit(True).alias("known")).distinct(), "zone_id", "left")
    reason = F.when(~(number("x") & number("y") & number("z")), "position").when(~number("conf") | ~F.col("conf").between(0, 1), "confidence").when(F.col("zone_id").isNotNull() & F.col("known").isNull(), "zone")
    return known.withColumn("reason", reason).drop("known")


def replay(events: DataFrame, nearest: DataFrame) -> DataFrame:
    """session_id, point_id, zone_id of points left after a session's corrections in order of seq.

    events: session_id, seq, op (add, rotate, delete, delete_zone, reset),
    point_id, zone_id. Adding puts a point in the zone given or the nearest;
    each rotation moves it one on among its nearest zones; deletions of the
    point, or of a zone that it is in at that time, and resets of the session
    remove what came before them. nearest: point_id, zones (nearest first).
    """
    session = Window.partitionBy("session_id")
    after_reset = events.withColumn("reset", F.max(F.when(F.col("op") == "reset", F.col("seq"))).over(session)).filter("reset is null or seq > reset")
    own = after_reset.filter("point_id is not null and op in ('add', 'rotate', 'delete')")
    point = own.groupBy("session_id", "point_id").agg(
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"), F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("added"), F.max_by("zone_id", F.when(F.col("op") == "add", F.col("seq"))).alias("asked"), F.collect_list(F.when(F.col("op") == "rotate", F.col("seq"))).alias("turns")
    )
    alive = point.filter("added is not null and (deleted is null or added > deleted)").join(nearest, "point_id", "left")
    later = F.array_sort(F.filter("turns", lambda s: s > F.col("added")))
    start = F.coalesce("asked", F.get("zones", F.lit(0)))
    place = F.array_position("zones", start)
    after = lambda k: F.when(k == 0, start).otherwise(F.get("zones", F.pmod(F.greatest(place - 1, F.when(place == 0, F.lit(-1)).otherwise(F.lit(0))) + k, F.size("zones")).cast("int")))
    steps = alive.select("session_id", "point_id", "zones", "asked", later.alias("later"), "added").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("later"))))
    stays = steps.select("session_id", "point_id", after(F.col("k")).alias("zone_id"), F.when(F.col("k") == 0, F.col("added")).otherwise(F.get("later", F.col("k") - 1)).alias("since"), F.get("later", F.col("k")).alias("until"))
    closed = after_reset.filter("op = 'delete_zone'").select("session_id", F.col("zone_id").alias("closed_id"), F.col("seq").alias("closed"))
    hit = (stays.session_id == closed.session_id) & (F.col("zone_id") == F.col("closed_id")) & (F.col("closed") > F.col("since")) & (F.col("until").isNull() | (F.col("closed") < F.col("until")))
    gone = stays.join(closed, hit, "left_semi").select("session_id", "point_id").distinct()
    return stays.filter("until is null").join(gone, ["session_id", "point_id"], "left_anti").select("session_id", "point_id", "zone_id")


def changed(before: DataFrame, now: DataFrame, value: str, *keys: str) -> DataFrame:
    """Keys whose value is another than before (or new, or gone), with both."""
    b, n = before.select(*keys, F.col(value).alias("was")), now.select(*keys, F.col(value).alias("now"))
    return b.join(n, list(keys), "full").filter(~F.col("was").eqNullSafe(F.col("now")))


def first_known(counts: DataFrame) -> DataFrame:
    """Each row's count, or the first that its zone had; counts: session_id, zone_id, ts, seq, count (may be null)."""
    w = Window.partitionBy("session_id", "zone_id").orderBy("ts", "seq")
    return counts.withColumn("preserved", F.first("count", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def progress(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Finished requests against saved frames of each session, and whether all are done."""
    done = requests.groupBy("session_id").agg(F.count_if(F.col("state").isin("COMPLETED", "FAILED")).alias("finished"))
    n = saved.groupBy("session_id").agg(F.count("*").alias("saved"))
    return n.join(done, "session_id", "left").fillna(0, ["finished"]).withColumn("complete", F.col("finished") >= F.col("saved"))


def session_text(zones: DataFrame) -> DataFrame:
    """One text a session: a line for each zone by id with its points and, if kept, the local count."""
    line = F.concat(F.format_string("zone %d: %d points", "zone_id", "points"), F.when(F.col("local").isNotNull(), F.format_string(" (local %d)", "local")).otherwise(""))
    return zones.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
