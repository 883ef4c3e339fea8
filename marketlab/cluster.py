"""Sending the library to executors that don't have it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to what Python workers import, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(suffix=".zip", prefix="marketlab-")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(name)
    _SENT.add(context.applicationId)


def shipped(f):
    """``f(spark, ...)`` after the package was sent."""

    @functools.wraps(f)
    def run(spark, *args):
        ship(spark)
        return f(spark, *args)

    return run
