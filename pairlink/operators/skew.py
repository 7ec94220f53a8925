"""Per-key results when a handful of keys hold most rows.

Rows are range partitioned on (key, secondary order, tie breakers).  Spark samples the quantiles of that
composite, so a heavy key is cut into as many partitions as its share of the rows deserves, and every
partition holds about the same number of rows.  Each partition folds its rows into one partial state per
key it meets; only those states (partitions + keys many at most) are shuffled once more and stitched, in
range order, into one row per key.

Edge cases: null keys form one group of their own; null order values sort first and count as rows; ties in
the order are spread by the tie breakers; an empty input gives an empty result; other columns are pruned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind -> (partial over rows, merge over partials); ``o`` is the composite order value.
_MERGEABLE = {
    "count": (lambda c, o: F.count(c), lambda c: F.sum(c)),
    "sum": (lambda c, o: F.sum(c), lambda c: F.sum(c)),
    "min": (lambda c, o: F.min(c), lambda c: F.min(c)),
    "max": (lambda c, o: F.max(c), lambda c: F.max(c)),
}


def range_partitioned(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), tie_break: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """``df`` range partitioned on the composite, so that rows of one key lie in consecutive partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *(F.col(c) for c in (*keys, *order_by, *tie_break)))


def balanced_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, tuple[str, str | None]],
    order_by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """One row per key; ``aggs`` maps an output name to ``(kind, column)``.

    Kinds: ``count`` (column None counts rows), ``sum``, ``min``, ``max``.  The result has the key columns
    and the named aggregates; the work per task does not depend on how rows are spread over keys.
    """
    unknown = {k for k, _ in aggs.values()} - set(_MERGEABLE)
    if unknown:
        raise ValueError(f"unknown aggregate {sorted(unknown)}")
    inner = {f"__k{i}": F.col(c) for i, c in enumerate(keys)} | {f"__o{i}": F.col(c) for i, c in enumerate(order_by)}
    inner |= {f"__t{i}": F.col(c) for i, c in enumerate(tie_break)}
    inner |= {f"__v{i}": F.lit(1) if c is None else F.col(c) for i, (_, c) in enumerate(aggs.values())}
    rows = df.select(*(c.alias(n) for n, c in inner.items()))
    named = lambda p: [n for n in inner if n.startswith(p)]
    ranged = range_partitioned(rows, named("__k"), named("__o"), named("__t"), partitions)
    partial = [_MERGEABLE[k][0](F.col(f"__v{i}"), None).alias(f"__v{i}") for i, (k, _) in enumerate(aggs.values())]
    states = ranged.groupBy(F.spark_partition_id().alias("__p"), *named("__k")).agg(*partial)
    merged = [_MERGEABLE[k][1](F.col(f"__v{i}")).alias(f"__v{i}") for i, (k, _) in enumerate(aggs.values())]
    out = states.groupBy(*named("__k")).agg(*merged)
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)), *(F.col(f"__v{i}").alias(n) for i, n in enumerate(aggs)))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows into one state per run of equal keys; a run cut by a batch gives two states."""
    seq = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [n for n in batch.schema.names if n.startswith("__k")]
        start = np.zeros(batch.num_rows, dtype=bool)
        start[0] = True
        for n in names:
            codes = batch.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            start[1:] |= codes[1:] != codes[:-1]
        at = np.flatnonzero(start)
        end = np.append(at[1:], batch.num_rows) - 1
        micros = batch.column("__o0").cast(pa.int64())
        known = micros.is_valid().to_numpy(zero_copy_only=False)
        value = micros.fill_null(0).to_numpy(zero_copy_only=False)
        gap = np.zeros(batch.num_rows, dtype=np.int64)
        gap[1:] = np.where(known[1:] & known[:-1] & ~start[1:], value[1:] - value[:-1], 0)
        big, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        first = np.minimum.reduceat(np.where(known, value, big), at)
        last = np.maximum.reduceat(np.where(known, value, low), at)
        some = np.add.reduceat(known.astype(np.int64), at) > 0
        cols = {n: batch.column(n).take(pa.array(at)) for n in names}
        cols |= {
            "__s": pa.array(np.arange(seq, seq + len(at), dtype=np.int64)),
            "__n": pa.array((end - at + 1).astype(np.int64)),
            "__first": pa.array(first, mask=~some),
            "__last": pa.array(last, mask=~some),
            "__gap": pa.array(np.maximum.reduceat(gap, at)),
        }
        seq += len(at)
        yield pa.RecordBatch.from_pydict(cols)


def balanced_timeline(
    df: DataFrame, keys: Sequence[str], order_by: str, tie_break: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Order-dependent results per key: ``n_rows``, ``first_at``, ``last_at`` and ``longest_gap`` (microseconds).

    ``order_by`` is one timestamp column.  A gap lies between two consecutive rows of the key in that order; a
    gap that spans two partitions (or two Arrow batches) is found when their boundary states are stitched.
    Keys without any order value get null times and a gap of 0.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *(F.col(c).alias(n) for c, n in zip(keys, k)), F.unix_micros(F.col(order_by).cast("timestamp")).alias("__o0"), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(tie_break))
    )
    ranged = range_partitioned(rows, k, ["__o0"], [f"__t{i}" for i in range(len(tie_break))], partitions)
    ordered = ranged.select(*k, "__o0").sortWithinPartitions(*k, "__o0")
    schema = T.StructType([*(f for f in ordered.schema.fields if f.name in k), *(T.StructField(n, T.LongType()) for n in ("__s", "__n", "__first", "__last", "__gap"))])
    states = ordered.mapInArrow(_segments, schema).withColumn("__p", F.spark_partition_id())
    before = F.lag("__last", 1).over(Window.partitionBy(*k).orderBy(F.col("__p"), F.col("__s")))
    bridged = states.withColumn("__gap", F.greatest("__gap", F.coalesce(F.col("__first") - before, F.lit(0))))
    out = bridged.groupBy(*k).agg(F.sum("__n").alias("n_rows"), F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.max("__gap").alias("longest_gap"))
    return out.select(
        *(F.col(n).alias(c) for c, n in zip(keys, k)), "n_rows", F.timestamp_micros("__first").alias("first_at"), F.timestamp_micros("__last").alias("last_at"), "longest_gap"
    )


def heavy_keys(df: DataFrame, key: str, share: float, order_by: Sequence[str] = (), tie_break: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Non-null keys that hold at least ``share`` of all rows of ``df`` (null keys count among the rows)."""
    least = math.ceil(Fraction(str(share)) * df.count())  # exact where a product of floats isn't
    sizes = balanced_aggregate(df, [key], {"n_rows": ("count", None)}, order_by, tie_break, partitions)
    return sizes.filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(least)))
