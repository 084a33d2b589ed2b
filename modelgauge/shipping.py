"""Gives this package's modules to the executors, where functions that run in Python need them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_modelgauge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="modelgauge-"), "modelgauge.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"modelgauge/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._modelgauge_shipped = True
