"""The join that lists pairs: rows meet by keys, in tasks of like size however popular a key is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.records import dealt

#: Rows of either side of a key that meet in one place.
TILE = 2000
#: So many keys are dealt at most, those of most pairs, so that telling the tasks of them stays small.
DEALT_KEYS = 10_000


def _small(df: DataFrame) -> bool:
    """Is the table one that Spark sends to all tasks?"""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= int(conf.autoBroadcastJoinThreshold())


def meet(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], condition: Column) -> DataFrame:
    """The rows of ``left`` and ``right`` (with columns lid, rid) that agree on all keys, where ``condition`` holds.

    The pairs of a key are the product of its sides, so their number says nothing about the bytes by which Spark
    sizes tasks.  A key of more than ``TILE`` squared pairs is dealt into tiles of at most about ``TILE`` rows a
    side, and each tile of one side is sent to each of the other.  The work on tiles and other keys is hashed over
    a fixed number of tasks.  The rows of a stream can't be counted; there the other side alone decides.
    """
    on = condition
    for l, r in keys:
        on = on & (F.col(l) == F.col(r))
    if _small(right):
        return dealt(left).join(right, on)
    for l, r in keys:
        left, right = left.filter(F.col(l).isNotNull()), right.filter(F.col(r).isNotNull())
    own = [f"__k{i}" for i in range(len(keys))]
    counted = right.select(*(F.col(r).alias(k) for k, (_, r) in zip(own, keys)), F.lit(0).alias("l"), F.lit(1).alias("r"))
    if not left.isStreaming:
        counted = counted.union(left.select(*(F.col(l).alias(k) for k, (l, _) in zip(own, keys)), F.lit(1).alias("l"), F.lit(0).alias("r")))
    sums = counted.groupBy(*own).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    pairs = F.col("r") * (F.col("r") if left.isStreaming else F.col("l"))
    popular = sums.filter(pairs > TILE * TILE).orderBy(pairs.desc()).limit(DEALT_KEYS)
    popular = F.broadcast(popular.select(*own, F.greatest(F.ceil(F.col("l") / TILE), F.lit(1)).alias("__gl"), F.ceil(F.col("r") / TILE).alias("__gr")))

    def tiled(side: DataFrame, p: str, other: str) -> DataFrame:
        same = [F.col(pair[p == "r"]) == F.col(k) for k, pair in zip(own, keys)]
        of = lambda c: F.coalesce(f"__g{c}", F.lit(1).cast("bigint"))
        side = side.join(popular, same, "left").withColumn(f"__{p}{p}", F.pmod(F.xxhash64(f"{p}id"), of(p)))
        return side.withColumn(f"__{p}{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), of(other) - 1))).drop(*own, "__gl", "__gr")

    left, right = tiled(left, "l", "r"), tiled(right, "r", "l")
    if all(left.schema[l].dataType == right.schema[r].dataType for l, r in keys):
        spark = left.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        left = left.repartition(n, *(l for l, _ in keys), "__ll", "__lr")
        right = right.repartition(n, *(r for _, r in keys), "__rl", "__rr")
    equal = F.lit(True)
    for l, r in keys:
        equal = equal & (F.col(l) == F.col(r))
    return left.join(right, equal & (F.col("__ll") == F.col("__rl")) & (F.col("__lr") == F.col("__rr")) & condition).drop("__ll", "__lr", "__rl", "__rr")
