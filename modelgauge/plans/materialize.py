"""Cuts lineage with reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "modelgauge-checkpoints"))
    return df.checkpoint()
