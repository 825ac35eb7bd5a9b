"""Brings this package to the executors' Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application: the package's sources as a zip file through addPyFile."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="leafcast-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    spark.sparkContext.addPyFile(name)
    _done.add(app)
