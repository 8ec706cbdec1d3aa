"""The package for Python workers: what runs in them imports it, and they may stand on machines that don't have it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers, once a session; without an argument those of the active one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_eqlake_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="eqlake-"), f"eqlake_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, "eqlake")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._eqlake_shipped = True
