"""The sequential operators as streams, keyed by session; each gives what its batch version gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parallaxis.operators import frames as gate_rules

GATED = "session_id long, frame_id long, accepted boolean, forced boolean"


def gate(frames: DataFrame, guard_seconds: float = 0.05, idle: str | None = None) -> DataFrame:
    """The quality gate over a stream of frames (session_id, frame_id, ts, ok): accepted if ok, first, or guard_seconds after the last accepted.

    Rows of a micro-batch go by time; state is one number a session, and goes
    when the session has been idle so long ("1 hour"), if a time is given.
    """
    guard = int(guard_seconds * 1e6)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "frame_id"])  # one session's rows of one micro-batch
        out = []
        for frame_id, us, ok in zip(rows.frame_id, rows.us, rows.ok):
            due = last is None or us - last >= guard
            if ok or due:
                last = int(us)
            out.append((key[0], frame_id, bool(ok or due), bool(not ok and due)))
        state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "frame_id", "accepted", "forced"])

    rows = frames.select("session_id", "frame_id", F.unix_micros("ts").alias("us"), "ok")
    return rows.groupBy("session_id").applyInPandasWithState(run, GATED, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def with_ok(frames: DataFrame) -> DataFrame:
    """Frames with ok by the image rules; motion is measured where frames are in order, so a stream brings it as columns or none."""
    own = frames if "move" in frames.columns else frames.withColumns({"move": F.lit(0.0), "turn": F.lit(0.0)})
    return own.withColumn("ok", F.size(gate_rules.reasons()) == 0)


def request_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Running counts of request events by session, zone and state; an event of a request that comes again within the lateness counts once. states.request_counts counts requests by their present state."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "request_id", "state"])
    return once.groupBy("session_id", "zone_id", "state").agg(F.count("*").alias("n"))


def frames_per_window(frames: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Frames of each session in each window of event time, final once the watermark has passed it."""
    return frames.withWatermark("ts", late).groupBy("session_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def refresh(points: DataFrame, assign: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Keeps a Parquet table of assigned points up to date with a stream of points (session_id, point_id, ...).

    A batch runs at most once in `every`, and only when new points came; the
    sessions that it touches are assigned anew, from all their points, and
    replace their part of the table. The first batch runs at once. Of a point
    that is sent again, the row of the last batch counts (of one batch, the
    last by seq if there is such a column).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("session_id").distinct()
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").partitionBy("session_id").parquet(f"{table}/points")
        held = spark.read.schema(batch.schema.add("_batch", "long")).parquet(f"{table}/points").join(touched, "session_id", "left_semi")
        newest = Window.partitionBy("session_id", "point_id").orderBy(*(F.desc(c) for c in ("_batch", "seq") if c in held.columns))
        every_point = held.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_batch")
        assign(every_point).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{table}/assigned")

    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
