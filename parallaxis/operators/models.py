"""Predictors as functions on tables of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORED = "image_id long, det long, left double, top double, right double, bottom double, score double"


def predict(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str = SCORED) -> DataFrame:
    """What a model says of images. load makes the model, once a task; the model turns a batch of images into rows of schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)


def by_target(images: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], column: str = "target") -> DataFrame:
    """The rows of each target through its own predictor; rows of other targets give nothing."""
    out = None
    for name, predictor in targets.items():
        part = predictor(images.filter(F.col(column) == name)).withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def centred_box(images: DataFrame, width: int, height: int) -> DataFrame:
    """A predictor for tests: one sure box of a size in the middle of each image (image_id, width, height)."""
    left, top = F.greatest((F.col("width") - width) / 2, F.lit(0.0)), F.greatest((F.col("height") - height) / 2, F.lit(0.0))
    return images.select("image_id", F.lit(1).cast("long").alias("det"), left.alias("left"), top.alias("top"), F.least(left + width, F.col("width")).cast("double").alias("right"), F.least(top + height, F.col("height")).cast("double").alias("bottom"), F.lit(1.0).alias("score"))


SPECS = "model_name string, target string, family string, normalisation string, threshold double, overlap double, mask double, classes int, border int, most int"
# The built-in models and their thresholds.
CATALOGUE = (
    ("zones-yolo-seg", "zones", "rows", "rgb", 0.25, 0.45, 0.5, 1, None, None),
    ("points-yolo-seg", "points", "rows", "rgb", 0.20, 0.40, 0.5, 1, None, None),
    ("points-yolo-stardist", "points", "dense", "percentile", 0.50, 0.50, None, 1, 2, 10_000),
)


def specs(spark: SparkSession) -> DataFrame:
    """The built-in models: target, family of outputs, input normalisation and thresholds."""
    return spark.createDataFrame(CATALOGUE, SPECS)


def with_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows with the parameters of their model (model_name); specs is a table of a few models."""
    return rows.join(F.broadcast(specs), "model_name")
