"""The run log as a stream: runs by project and window of time, with late ones up to a watermark.

The engine's queries are batch ones; this follows a log that others append to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_windows(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(project, window, runs, failed, score_sum) from runs(run_id, project, status, started_at, score), streaming or not."""
    g = runs.withWatermark("started_at", late).groupBy("project", F.window("started_at", window).alias("window"))
    return g.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("score").alias("score_sum"))


def follow(runs: DataFrame, target: str, checkpoint: str):
    """Writes closed windows to a Parquet table, each once."""
    return run_windows(runs).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
