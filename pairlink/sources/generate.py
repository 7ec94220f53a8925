"""Synthetic binary comparison vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_vectors(spark: SparkSession, n: int, n_match: int, m: Sequence[float], u: Sequence[float], random_state: int | None = None, return_links: bool = False, dtype: str = "tinyint"):
    """``n`` pairs of which ``n_match`` are matches; feature i is 1 with m[i] for matches and with u[i] for the others.

    The draws happen in the tasks (a seed per feature), so n isn't bounded by the driver.
    """
    if len(m) != len(u):
        raise ValueError("m and u need the same length")
    if not 0 <= n_match < n:
        raise ValueError("n_match must be at least 0 and below n")
    seed = 0 if random_state is None else random_state
    rows = spark.range(n).withColumn("match", F.col("id") < n_match)
    names = [f"c_{i + 1}" for i in range(len(m))]
    bits = [(F.rand(seed + 7919 * (i + 1)) < F.when(F.col("match"), float(p)).otherwise(float(q))).cast(dtype).alias(c) for i, (c, p, q) in enumerate(zip(names, m, u))]
    rows = rows.select(F.xxhash64("id", F.lit(seed)).alias("id_1"), F.xxhash64("id", F.lit(seed + 1)).alias("id_2"), *bits, "match")
    vectors = rows.select("id_1", "id_2", *names)
    return (vectors, rows.filter("match").select("id_1", "id_2")) if return_links else vectors


def binary_vectors_local(n: int, n_match: int, m: Sequence[float], u: Sequence[float], random_state: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, match flags) drawn on the driver from the classic generator, matches first; for small reproducible sets."""
    if len(m) != len(u):
        raise ValueError("m and u need the same length")
    if not 0 <= n_match < n:
        raise ValueError("n_match must be at least 0 and below n")
    rng = np.random.RandomState(random_state)
    x = np.empty((n, len(m)), dtype=np.int8)
    for i, (p, q) in enumerate(zip(m, u)):
        x[:n_match, i] = rng.random_sample(n_match) >= 1 - p  # the upper end of the unit interval stands for 1
        x[n_match:, i] = rng.random_sample(n - n_match) >= 1 - q
    return x, np.arange(n) < n_match
