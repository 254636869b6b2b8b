"""The shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in spark.checkpoint.dir; where that is unset, in a temporary folder in local mode, as in tests, and an error elsewhere."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir() and not context.getConf().get("spark.checkpoint.dir", None):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-parallaxis-"))
    return df.checkpoint()
