"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Texts are hashed into blocks of about ``block_tokens`` tokens within their source.  A source's quota is its
share of the mix, at most ``max_repeats`` times its own size; it is drawn as whole passes over all its
blocks plus the first blocks of one more permuted pass, the last block being cut between two texts; texts larger
than what that pass may hold are left out of it.  So a quota is met to within half a text.  The draws of a source form one permuted sequence.  The splitting tree halves the range of output shards again
and again; at each node the number of draws of every source that goes left is multivariate hypergeometric,
seeded by the node, so every shard can follow its own path without the others.  What a shard gets are
disjoint runs of each source's sequence; blocks are joined to them and every shard is shuffled by a hash.

Nothing but the totals of the sources in the target table (at most ``max_sources``) reaches the driver.  A
source with a third of all texts is spread over its blocks; ranks are prefix sums over buckets.

Edge cases: null and empty texts have no token and aren't drawn, and count for nothing; texts of
sources without a target count in the size of the mix only; a target without texts reaches 0; with no texts
at all the mix is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlink.llm.tokens import DEFAULT_TOKENIZER, with_token_counts
from pairlink.scratch import Scratch


#: From here on the generator's own hypergeometric draws are refused.
_LARGE = 1_000_000_000


def _factorial_ratio(m: int, d: int) -> float:
    """ln((m + d)! / m!) - d ln(m + 1), without the cancellation of two large logarithms."""
    if m < 1000 or m + d < 1000:
        return math.lgamma(m + d + 1) - math.lgamma(m + 1) - d * math.log(m + 1)
    rest = lambda k: 1 / (12 * k) - 1 / (360 * k**3)
    return (m + d + 0.5) * math.log1p(d / m) - d + d * (math.log(m) - math.log(m + 1)) + rest(m + d) - rest(m)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are among the ``good``, for populations of any size.

    Large populations are drawn by the ratio of uniforms (table mountain rejection), in about two tries.
    """
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mean = n * (good / total)
    spread = math.sqrt((total - n) / (total - 1) * mean * (bad / total) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    cells = ((mode, 1), (good - mode, -1), (n - mode, -1), (bad - n + mode, 1))
    slope = sum(sign * math.log(m + 1) for m, sign in cells)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high:
            d = k - mode
            if 2 * math.log(u) <= -d * slope - sum(_factorial_ratio(m, sign * d) for m, sign in cells):
                return k


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` by its marginals."""
    total = int(counts.sum())
    if total < _LARGE:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros(len(counts), dtype=np.int64)
    for i, c in enumerate(map(int, counts)):
        total -= c
        out[i] = hypergeometric(rng, c, total, n)
        n -= int(out[i])
    return out


def shard_runs(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) per source of the draws that ``shard`` gets: the path from the root to its leaf."""
    counts, start = np.asarray(counts, dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = _split(rng, counts, int(counts.sum()) * (mid - lo) // (hi - lo))
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, start, lo = counts - left, start + left, mid
    return start, counts


def _unit(*cols) -> F.Column:
    """A hash of ``cols`` as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _ranked(blocks: DataFrame, bucket_rows: int) -> DataFrame:
    """``pos`` and ``before`` (tokens ahead) of each block in the permuted pass of its source, without a window over a whole source."""
    part = ["source", "pass", "bucket"]
    blocks = blocks.withColumn("u", _unit("source", "block", "pass", "seed")).withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_blocks") / bucket_rows)))
    totals = blocks.groupBy(*part).agg(F.count("*").alias("bn"), F.sum("tokens").alias("bt"))
    ahead = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, F.coalesce(F.sum("bn").over(ahead), F.lit(0)).alias("pos0"), F.coalesce(F.sum("bt").over(ahead), F.lit(0)).alias("tok0"))
    within = Window.partitionBy(*part).orderBy("u", "block")
    blocks = blocks.withColumn("r", F.row_number().over(within) - 1).withColumn("c", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    return blocks.join(totals, part).withColumn("pos", F.col("pos0") + F.col("r")).withColumn("before", F.col("tok0") + F.col("c"))


class Mix:
    """The plan of a mix and its rows; ``rows`` and ``report()`` are frames, ``plan`` the totals per source."""

    def __init__(
        self, docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, size: float = 1.0, block_tokens: int = 8192, shard_tokens: int = 1 << 20,
        seed: int = 1, max_sources: int = 10_000, bucket_rows: int = 2_000,
    ):
        """``targets`` has (source, target_share, max_repeats); the mix has ``size`` times the tokens of all texts."""
        spark = docs.sparkSession
        self._scratch = Scratch(spark, "mixing")
        counted = with_token_counts(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t")), "t", "n", tokenizer)
        items = self._scratch.save(counted.filter("n > 0"))
        sizes = items.groupBy("source").agg(F.sum("n").alias("tokens"))
        goals = targets.select(F.col("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats")).filter("source is not null and share > 0")
        plan = goals.join(sizes, "source", "left").orderBy("source").limit(max_sources + 1).toPandas()
        if len(plan) > max_sources:
            raise ValueError(f"more than {max_sources} target rows")
        if plan["source"].duplicated().any():
            raise ValueError("a source has more than one target row")
        plan["tokens"] = plan["tokens"].fillna(0).astype("int64")
        self.total = int((items.agg(F.sum("n")).first()[0] or 0) * size)
        plan["wanted"] = plan["share"] * self.total
        plan["quota"] = np.floor(np.minimum(plan["wanted"], plan["repeats"] * plan["tokens"])).astype("int64")
        plan["passes"] = np.where(plan["tokens"] > 0, plan["quota"] // plan["tokens"].clip(lower=1), 0)
        plan["rest"] = plan["quota"] - plan["passes"] * plan["tokens"]
        plan["n_blocks"] = np.maximum(1, -(-plan["tokens"] // block_tokens))
        self.plan, self.key, self.source, self.items = plan, key, source, items
        used = plan[plan["quota"] > 0]
        small = spark.createDataFrame(
            [(r.source, int(r.n_blocks), int(r.passes), int(r.rest)) for r in used.itertuples()], "source string, n_blocks long, passes long, rest long"
        )
        placed = items.join(F.broadcast(small), "source").withColumn("block", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("n_blocks")))
        # a text larger than what is left for the last, partial pass can't be part of it
        fits = F.sum(F.when(F.col("n") <= F.col("rest"), F.col("n")).otherwise(0)).alias("fits")
        blocks = placed.groupBy("source", "block", "n_blocks", "passes", "rest").agg(F.sum("n").alias("tokens"), fits)
        blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)))).withColumn("seed", F.lit(seed))
        blocks = blocks.withColumn("tokens", F.when(F.col("pass") < F.col("passes"), F.col("tokens")).otherwise(F.col("fits"))).drop("fits")
        ranked = _ranked(blocks, bucket_rows)
        drawn = ranked.filter((F.col("pass") < F.col("passes")) | (F.col("before") < F.col("rest")))
        # tokens to take of the block that the quota ends in
        drawn = drawn.withColumn("take", F.when((F.col("pass") == F.col("passes")) & (F.col("before") + F.col("tokens") > F.col("rest")), F.col("rest") - F.col("before")))
        # every pass draws all blocks, so the passes before fill n blocks each
        many = blocks.groupBy("source", "pass").agg(F.count("*").alias("m")).filter("pass = 0").select("source", "m")
        drawn = self._scratch.save(
            drawn.join(F.broadcast(many), "source").select("source", "block", "pass", "take", (F.col("pos") + F.col("pass") * F.col("m")).alias("pos"))
        )
        counts = {r["source"]: r["c"] for r in drawn.groupBy("source").agg(F.count("*").alias("c")).collect()}
        names = sorted(counts)
        vector = np.array([counts[s] for s in names], dtype=np.int64)
        shards = max(1, -(-int(plan["quota"].sum()) // shard_tokens))
        self.shards = shards

        def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"] if names else ():
                    start, count = shard_runs(vector, shards, int(shard), seed)
                    yield pd.DataFrame({"shard": int(shard), "source": names, "first": start, "n": count})

        leaves = spark.range(shards).mapInPandas(runs, "shard long, source string, first long, n long").filter("n > 0")
        leaves = leaves.select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos"))
        given = drawn.join(leaves, ["source", "pos"]).select("source", "block", "pass", "take", "shard")
        rows = placed.select("k", "source", "n", "block", "passes", "rest").join(given, ["source", "block"]).filter("pass < passes or n <= rest")
        cut = rows.filter("take is not null").withColumn(
            "c", F.sum("n").over(Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64("k", "pass"), "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        )
        # the text at the cut is taken if that comes closer to the quota
        rows = rows.filter("take is null").unionByName(cut.filter("2 * c + n <= 2 * take").drop("c"))
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("k", "pass", F.lit(seed)), "k", "pass"))
        self.rows = rows.select(F.col("k").alias(key), F.col("source").alias(source), F.col("pass").alias("repeat_no"), F.col("n").alias("n_tokens"), "shard", slot.alias("slot"))

    def report(self) -> DataFrame:
        """(source, target_share, reached_share, n_tokens, source_tokens, max_repeats, short): what the drawn rows hold.

        ``short``: all permitted repeats of the source were drawn and stay below its share of the mix.
        """
        spark = self.rows.sparkSession
        plan = spark.createDataFrame(
            [(r.source, float(r.share), float(r.wanted), int(r.tokens), int(r.repeats)) for r in self.plan.itertuples()],
            "source string, target_share double, wanted double, source_tokens long, max_repeats int",
        )
        reached = self.rows.groupBy(F.col(self.source).alias("source")).agg(F.sum("n_tokens").alias("n_tokens"))
        out = plan.join(reached, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
        everything = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
        return out.select(
            "source", "target_share", F.coalesce(F.try_divide(F.col("n_tokens"), everything), F.lit(0.0)).alias("reached_share"), "n_tokens", "source_tokens", "max_repeats",
            ((F.col("n_tokens") == F.col("source_tokens") * F.col("max_repeats")) & (F.col("n_tokens") < F.col("wanted"))).alias("short"),
        )
