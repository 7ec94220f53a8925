"""Global positions without a single-task sort: range partition, number within, add offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlink.scratch import Scratch


def with_positions(df: DataFrame, *keys: str, name: str = "pos", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``keys``.

    The rows are range partitioned once and kept, so that the partition numbers used for counting and for
    numbering are the same; only one count per partition is summed in one task.  Rows of equal keys stay in
    one partition and get consecutive positions.
    """
    scratch = scratch or Scratch(df.sparkSession, "positions")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.save(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return ranged.withColumn("__row", within).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__off") + F.col("__row")).drop("__part", "__row", "__off")
