"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[int] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per Spark application, whatever their PYTHONPATH is."""
    context = spark.sparkContext
    if id(context) in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quadrille-"), "quadrille-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, f"{top.name}/{file.relative_to(top)}")
    context.addPyFile(target)
    _shipped.add(id(context))
