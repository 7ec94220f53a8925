"""Lineage cutting for iterative plans.

Loops must not grow their plan without bound and must survive the loss of an executor, so every
intermediate table is written as Parquet below the folder named by ``spark.checkpoint.dir`` (shared by
all executors of a cluster) and read back.  A private temporary folder is chosen only when that setting
is absent *and* the session runs in local mode.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can read; raises on a cluster that names none."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pairlink-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_SETTING, f"file://{folder}")
    return f"file://{folder}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    """At exit; a context that is gone already can't be asked any more."""
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # noqa: BLE001
        pass


_roots: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this program now; frames that operators returned before can't be read any more."""
    for root in sorted(_roots):
        _delete(spark, root)
    _roots.clear()


class Scratch:
    """Tables of one run of an iterative operator, in their own sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.add(self.root)
        atexit.register(_remove, spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Run ``df``, write it, and return a frame that reads what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete saved tables that no later plan reads; the rest goes with :func:`clear` or when the program ends."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)
