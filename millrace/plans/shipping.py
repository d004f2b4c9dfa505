"""Sending the package to the executors.

Functions that run in Python workers are named, not copied, in what Spark sends, so workers must be able to import the
package. Where it isn't installed there, ``ship`` sends it as a zip, once per application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Add the packages' folders (by path) to every present and future worker of the session's application."""
    sc = spark.sparkContext
    for folder in packages:
        mark = f"{sc.applicationId}:{folder}"
        if mark in _SHIPPED:
            continue
        parent, name = os.path.split(os.path.abspath(folder))
        target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")   # the driver's; Spark hands it to the executors
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, files in os.walk(folder):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(top, f), os.path.relpath(os.path.join(top, f), parent))
        sc.addPyFile(target)
        _SHIPPED.add(mark)
