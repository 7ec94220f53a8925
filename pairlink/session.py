"""Making the package known to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per context, so that functions running there can import it."""
    context = spark.sparkContext
    if context not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="pairlink-zip-")  # the driver's own; its file server hands the archive out
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "pairlink"), "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(context)
    return spark
