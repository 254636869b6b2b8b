"""Frame streams: quality gate, motion, image statistics, cadence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.functions import vec as v

DARK_OR_BRIGHT, CONTRAST, SHARPNESS, MOVE, TURN = 0.35, 18.0, 120.0, 0.03, 8.0


def motion(frames: DataFrame) -> DataFrame:
    """Frames with translation and rotation since the one before in the session (0 for the first)."""
    w = Window.partitionBy("session_id").orderBy("ts", "frame_id")
    last = {c: F.lag(c).over(w) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")}
    move = v.length(tuple(F.col(c) - last[c] for c in ("tx", "ty", "tz")))
    turn = v.rotation_degrees(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")), tuple(last[c] for c in ("qx", "qy", "qz", "qw")))
    return frames.withColumn("move", F.coalesce(move, F.lit(0.0))).withColumn("turn", F.coalesce(turn, F.lit(0.0)))


def reasons() -> Column:
    """Why a frame fails the gate: exposure, contrast, blur, motion. Without image measurements only motion counts."""
    return F.array_compact(
        F.array(
            F.when((F.col("dark") > DARK_OR_BRIGHT) | (F.col("bright") > DARK_OR_BRIGHT), "exposure"),
            F.when(F.col("luma_std") < CONTRAST, "contrast"),
            F.when(F.col("lap") < SHARPNESS, "blur"),
            F.when((F.col("move") > MOVE) | (F.col("turn") > TURN), "motion"),
        )
    )


def gate(frames: DataFrame, guard_seconds: float = 0.05) -> DataFrame:
    """Frames with accepted and forced: those that pass, the first, and any that comes guard_seconds after the last accepted.

    A session's frames pass in time order through one task as a stream; of the
    past only the time of the last accepted frame is kept.
    """
    rows = frames.select("session_id", "frame_id", (F.size(reasons()) == 0).alias("ok"), F.unix_micros("ts").alias("us"))
    guard = int(guard_seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, last = None, False, 0
        for batch in batches:
            accepted, forced = [], []
            for session, ok, us in zip(*(batch.column(c).to_pylist() for c in ("session_id", "ok", "us"))):
                due = not begun or session != now or us - last >= guard
                accepted.append(ok or due)
                forced.append(due and not ok)
                if ok or due:
                    now, begun, last = session, True, us
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("frame_id"), pa.array(accepted, pa.bool_()), pa.array(forced, pa.bool_())], names=["session_id", "frame_id", "accepted", "forced"])

    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "us", "frame_id")
    return ordered.mapInArrow(run, "session_id long, frame_id long, accepted boolean, forced boolean")


def cadence(frames: DataFrame, seconds: int) -> DataFrame:
    """The first frame of each session in each window of so many seconds."""
    slot = F.window("ts", f"{seconds} seconds").alias("w")
    return frames.groupBy("session_id", slot).agg(F.min_by("frame_id", F.struct("ts", "frame_id")).alias("frame_id")).select("session_id", F.col("w.start").alias("start"), "frame_id")


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with their other columns as lists: a row for each run of rows of equal keys in a batch, so that whole runs are shuffled."""
    names = [*keys, *(c for c in rows.columns if c not in keys)]
    rows = rows.select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys]))
            begins = np.append(0, ends[:-1])
            own = [batch.column(k).take(pa.array(begins)) for k in keys]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), batch.column(n)) for n in range(len(keys), batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, *lists], names=names)

    schema = T.StructType([f if f.name in keys else T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema])
    return rows.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, so that rows of equal keys (the first columns) come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.unique(np.concatenate([np.append(0, pc.run_end_encode(batch.column(k)).run_ends.to_numpy()[:-1]) for k in range(keys)]))
        same = bool(held) and all(held[-1].column(k)[-1] == batch.column(k)[0] or not (held[-1].column(k)[-1].is_valid or batch.column(k)[0].is_valid) for k in range(keys))
        if same and len(starts) == 1:
            held.append(batch)
            continue
        last = int(starts[-1])
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Packed rows, those of equal keys together."""
    return packed(rows, *keys).repartition(*keys).sortWithinPartitions(*keys)


def _flat(table: pa.Table, *columns: str) -> list[pa.Array]:
    """Columns of packed rows with the rows side by side again."""
    return [pa.concat_arrays([x.flatten() for x in table[c].chunks]) for c in columns]


def _lengths(table: pa.Table, column: str) -> np.ndarray:
    return pc.list_value_length(table[column]).to_numpy()


def image_statistics(pixels: DataFrame) -> DataFrame:
    """Mean and deviation of luma, dark and bright shares, and variance of the Laplacian (borders mirrored without repeating the edge).

    Pixels are shuffled in runs of an image, and a task measures the images of
    a batch at once; it holds one image at least.
    """
    names = ("mean", "deviation", "dark", "bright", "sharpness")

    def sides(luma: np.ndarray, image: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = np.lexsort((place, line, image))
        own, same = luma[order], (line[order][1:] == line[order][:-1]) & (image[order][1:] == image[order][:-1])
        before, after = np.full(len(own), np.nan), np.full(len(own), np.nan)
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        out = np.empty(len(own))
        out[order] = np.where(np.isnan(before), after, before) + np.where(np.isnan(after), before, after)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            key = table["image_id"].combine_chunks()
            ends = pc.run_end_encode(key).run_ends.to_numpy()
            n = len(ends)
            image = np.repeat(np.repeat(np.arange(n), np.diff(ends, prepend=0)), _lengths(table, "luma"))
            x, y, luma = _flat(table, "x", "y", "luma")
            x, y = (c.fill_null(-(1 << 31)).to_numpy() for c in (x, y))
            luma = luma.cast(pa.float64()).to_numpy(zero_copy_only=False)
            lap = sides(luma, image, y, x) + sides(luma, image, x, y) - 4 * luma

            def mean(values: np.ndarray) -> np.ndarray:
                known = ~np.isnan(values)
                with np.errstate(invalid="ignore"):
                    return np.bincount(image[known], values[known], n) / np.bincount(image[known], minlength=n)

            middle, gap = mean(luma), np.isnan(luma)
            share = lambda x: mean(np.where(gap, np.nan, x))
            found = middle, np.sqrt(mean((luma - middle[image]) ** 2)), share(luma <= 24), share(luma >= 231), mean((lap - mean(lap)[image]) ** 2)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(ends - 1)), *(pa.array(c, from_pandas=True) for c in found)], names=["image_id", *names])

    schema = T.StructType([pixels.schema["image_id"], *(T.StructField(c, T.DoubleType()) for c in names)])
    return _by_key(pixels.select("image_id", "x", "y", "luma"), "image_id").mapInArrow(run, schema)


def percentile_normalised(pixels: DataFrame, low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Pixels with value, luma between its low and high percentiles of the image, clamped to [0, 1]."""
    p = pixels.groupBy("image_id").agg(F.percentile("luma", F.array(F.lit(low), F.lit(high))).alias("p"))
    span = F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-6))
    return pixels.join(p, "image_id").select("image_id", "x", "y", v.clamp((F.col("luma") - F.col("p")[0]) / span, 0, 1).alias("value"))


def channels(packed: Column) -> dict[str, Column]:
    """Red, green, blue in [0, 1] and luma (0 to 255) of a packed RGB pixel."""
    r, g, b = (F.shiftright(packed, n).bitwiseAND(255) for n in (16, 8, 0))
    return {"red": r / 255.0, "green": g / 255.0, "blue": b / 255.0, "luma": 0.299 * r + 0.587 * g + 0.114 * b}


def tiles(images: DataFrame, side: int = 1024) -> DataFrame:
    """A row for each tile of each image (width, height)."""
    rows = images.withColumn("ty", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / side) - 1)))
    return rows.withColumn("tx", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / side) - 1)))


#: Cells of a side of the blocks in which tiles are stitched.
BLOCK = 256


def stitched(tile_pixels: DataFrame) -> DataFrame:
    """The mean of overlapping tiles at each cell; tile_pixels: image_id, x0, y0, x, y, value. Cells are shuffled in runs of a block, and a task stitches the blocks of a batch at once."""
    cells = tile_pixels.select("image_id", (F.col("x0") + F.col("x")).alias("x"), (F.col("y0") + F.col("y")).alias("y"), "value")
    blocks = _by_key(cells.withColumns({"_" + c: F.floor(F.col(c) / BLOCK) for c in "xy"}), "image_id", "_x", "_y")
    names = ["image_id", "x", "y", "value"]
    schema = T.StructType([*(cells.schema[c] for c in names[:3]), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            own = table["image_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(table)), _lengths(table, "x"))))
            flat = pa.table([own, *_flat(table, "x", "y", "value")], names=names)
            mean = flat.group_by(names[:3], use_threads=False).aggregate([("value", "mean")])
            mean = pa.table([*(mean[c] for c in names[:3]), mean["value_mean"].cast(pa.float64())], names=names)
            yield from mean.to_batches()

    return blocks.mapInArrow(run, schema)


def decode_depth(frames: DataFrame) -> DataFrame:
    """frame_id, x, y, mm, confidence of each 16-bit sample: 13 bits of millimetres below 3 bits of confidence."""
    cells = frames.select("frame_id", "width", F.posexplode("values").alias("pos", "value"))
    mm, confidence = F.col("value").bitwiseAND(0x1FFF), F.shiftrightunsigned(F.col("value").bitwiseAND(0xE000), 13)
    return cells.select("frame_id", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), mm.alias("mm"), confidence.alias("confidence"))


def depth_samples(samples: DataFrame, cells: DataFrame, reach: int = 4) -> DataFrame:
    """For each sample (frame_id, sample_id, sx, sy) the upper median, by depth, x and y, of the most confident valid cells around it.

    Samples meet cells in squares, of which a sample touches four at most.
    """
    side = max(4 * reach, 1)
    around = samples.select("frame_id", "sample_id", "sx", "sy")
    for c in "xy":
        around = around.withColumn("g" + c, F.explode(F.sequence(*(F.floor((F.col("s" + c) + d) / side) for d in (-reach, reach)))))
    valid = cells.filter("mm > 0").withColumns({"g" + c: F.floor(F.col(c) / side) for c in "xy"})
    near = F.abs(F.col("x") - F.col("sx")).between(0, reach) & F.abs(F.col("y") - F.col("sy")).between(0, reach)
    met = around.join(valid, ["frame_id", "gx", "gy"]).filter(near)
    own = Window.partitionBy("frame_id", "sample_id")
    best = met.withColumn("top", F.max("confidence").over(own)).filter("confidence = top")
    ranked = best.withColumn("place", F.row_number().over(own.orderBy("mm", "x", "y"))).withColumn("n", F.count("*").over(own))
    return ranked.filter(F.col("place") == F.floor(F.col("n") / 2) + 1).select("frame_id", "sample_id", "x", "y", "mm", "confidence")
