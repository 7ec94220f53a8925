"""Indexing: operators that produce candidate pairs.

Each algorithm returns a lazy pair table (two id columns).  One record table means deduplication (pairs of
different records, the one that is later in the order first), two mean linking.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.log import logger
from pairlink.operators.meeting import meet
from pairlink.operators.positions import with_positions
from pairlink.records import RecordSet, dealt, listed, pair_names, same_family, sides
from pairlink.scratch import Scratch


class IndexAlgorithm:
    """Base of all algorithms; subclasses give ``_link`` and, where the rule of the triangle isn't enough, ``_dedup``."""

    name = "index"

    def index(self, x, x_link=None) -> DataFrame:
        a, b = sides(x, x_link)
        pairs = self._link(a, b) if b is not None else self._dedup(a)
        return pairs.toDF(*pair_names(a, b))

    def _link(self, a: RecordSet, b: RecordSet) -> DataFrame:
        raise NotImplementedError("an index algorithm needs _link")

    def _dedup(self, a: RecordSet) -> DataFrame:
        """Pairs of ``_link(a, a)`` below the diagonal; algorithms that can push the rule into a join do so."""
        both = self._link(a, a).toDF("l", "r")
        order = a.columns([], "o")
        lower = both.join(order.select(F.col("oid").alias("l"), F.col("oord").alias("lo")), "l").join(order.select(F.col("oid").alias("r"), F.col("oord").alias("ro")), "r")
        return lower.filter("lo > ro").select("l", "r")


BaseIndexAlgorithm = IndexAlgorithm


def _below(dedup: bool) -> Column:
    return F.col("lord") > F.col("rord") if dedup else F.lit(True)


class Full(IndexAlgorithm):
    """All pairs.  The only algorithm whose result is quadratic by definition."""

    def _pairs(self, a: RecordSet, b: RecordSet, dedup: bool) -> DataFrame:
        logger.warning("indexing: the full index has a pair for every two records")
        left, right = dealt(a.columns([], "l")), b.columns([], "r")
        joined = left.join(right, _below(True)) if dedup else left.crossJoin(right)
        return joined.select("lid", "rid")

    def _link(self, a, b):
        return self._pairs(a, b, False)

    def _dedup(self, a):
        return self._pairs(a, a, True)


def _check_keys(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], block: Block) -> None:
    for (l, r), one, two in zip(keys, block.left_on, block.right_on):
        if not same_family(left.schema[l].dataType, right.schema[r].dataType):
            raise ValueError(f"keys of different types can't block: {one}, {two}")


class Block(IndexAlgorithm):
    """Pairs that agree on all keys; records with a null key are in no pair."""

    def __init__(self, left_on=None, right_on=None, on=None):
        self.left_on = listed(left_on if left_on is not None else on)
        self.right_on = listed(right_on) or self.left_on
        if not self.left_on or len(self.left_on) != len(self.right_on):
            raise ValueError("blocking needs the same number of keys on both sides")

    def _pairs(self, a, b, dedup):
        left, right = a.columns(self.left_on, "l"), b.columns(self.right_on, "r")
        keys = [(f"l{i}", f"r{i}") for i in range(len(self.left_on))]
        _check_keys(left, right, keys, self)
        return meet(left, right, keys, _below(dedup)).select("lid", "rid")

    def _link(self, a, b):
        return self._pairs(a, b, False)

    def _dedup(self, a):
        return self._pairs(a, a, True)


def _window(window: int) -> int:
    if isinstance(window, bool) or not isinstance(window, int) or window < 1 or window % 2 == 0:
        raise ValueError("a window is a positive odd integer")
    return window // 2


def _ranks(values: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, rank) of the distinct non-null values of a one-column frame."""
    distinct = values.toDF("value").filter("value is not null").distinct()
    return with_positions(distinct, "value", name="rank", scratch=scratch)


class SortedNeighbourhood(IndexAlgorithm):
    """Pairs whose sorting keys lie within half a window of each other among the distinct key values of both sides."""

    def __init__(self, left_on=None, right_on=None, window=3, sorting_key_values=None, block_on=(), block_left_on=(), block_right_on=(), on=None):
        self.left_on = listed(left_on if left_on is not None else on)
        self.right_on = listed(right_on) or self.left_on
        if len(self.left_on) != 1 or len(self.right_on) != 1:
            raise ValueError("sorted neighbourhood has one sorting key")
        self.half = _window(window)
        self.values = None if sorting_key_values is None else list(sorting_key_values)
        self.block_left = listed(block_on) or listed(block_left_on)
        self.block_right = listed(block_on) or listed(block_right_on)
        if len(self.block_left) != len(self.block_right):
            raise ValueError("blocking needs the same number of keys on both sides")

    def _pairs(self, a, b, dedup):
        left, right = a.columns([*self.left_on, *self.block_left], "l"), b.columns([*self.right_on, *self.block_right], "r")
        if not same_family(left.schema["l0"].dataType, right.schema["r0"].dataType):
            raise ValueError("sorting keys of different types")
        spark = left.sparkSession
        scratch = Scratch(spark, "neighbourhood")
        if self.values is None:
            keys = left.select("l0") if dedup else left.select("l0").union(right.select("r0"))
            ranks = _ranks(keys, scratch)
        else:
            kind = left.schema["l0"].dataType.simpleString()
            ranks = spark.createDataFrame(list(dict.fromkeys((v, i) for i, v in enumerate(self.values))), f"value {kind}, rank long").dropDuplicates(["value"])
        left = left.join(ranks.toDF("l0", "lrank"), "l0")
        right = right.join(ranks.toDF("r0", "rrank"), "r0")
        near = left.withColumn("near", F.explode(F.sequence(F.col("lrank") - self.half, F.col("lrank") + self.half)))
        on = (F.col("near") == F.col("rrank")) & _below(dedup)
        for i in range(1, len(self.block_left) + 1):
            on = on & (F.col(f"l{i}") == F.col(f"r{i}"))
        return near.join(right, on).select("lid", "rid")

    def _link(self, a, b):
        return self._pairs(a, b, False)

    def _dedup(self, a):
        return self._pairs(a, a, True)


class Random(IndexAlgorithm):
    """``n`` pairs drawn at random; pair ordinals are drawn, never the product of the tables."""

    def __init__(self, n: int, replace: bool = True, random_state: int | None = None):
        if isinstance(n, bool) or not isinstance(n, int):
            raise ValueError("n is an integer")
        self.n, self.replace, self.seed = n, replace, 0 if random_state is None else random_state

    def _ordinals(self, spark, n_max: int) -> DataFrame:
        """(draw, k): n ordinals below n_max."""
        n = self.n
        if n < 1 or n_max == 0 or (not self.replace and n > n_max):
            raise ValueError("n must be positive and, without replacement, at most the number of pairs")
        draw = lambda rows, seed: spark.range(rows).select(F.floor(F.rand(seed) * n_max).cast("long").alias("k"))
        if self.replace:
            return draw(n, self.seed)
        if n > n_max / 2 or n_max < 1_000_000:
            return spark.range(n_max).withColumnRenamed("id", "k").orderBy(F.xxhash64("k", F.lit(self.seed)), "k").limit(n)
        scratch = Scratch(spark, "random")
        got, seed = draw(n + n // 10 + 100, self.seed).distinct(), self.seed
        got = scratch.save(got)
        while got.count() < n:
            seed += 1
            got = scratch.save(got.union(draw(n, seed)).distinct())
        return got.orderBy(F.xxhash64("k", F.lit(self.seed)), "k").limit(n)

    def _link(self, a, b):
        left, right = with_positions(a.columns([], "l"), "lord", "lid", name="i"), with_positions(b.columns([], "r"), "rord", "rid", name="j")
        n_b = b.df.count()
        k = self._ordinals(left.sparkSession, a.df.count() * n_b)
        return k.select(F.expr(f"k div {max(n_b, 1)}").alias("i"), (F.col("k") % max(n_b, 1)).alias("j")).join(left, "i").join(right, "j").select("lid", "rid")

    def _dedup(self, a):
        left = with_positions(a.columns([], "l"), "lord", "lid", name="i")
        n = a.df.count()
        k = self._ordinals(left.sparkSession, n * (n - 1) // 2)
        # row i of the strict lower triangle holds the ordinals i(i-1)/2 ... ; the root is off by one at most
        guess = F.floor((1 + F.sqrt(1 + 8 * F.col("k").cast("double"))) / 2).cast("long")
        first = lambda i: F.expr(f"({i}) * (({i}) - 1) div 2")
        at = k.withColumn("g", guess).withColumn("i", F.when(first("g") > F.col("k"), F.col("g") - 1).when(first("g + 1") <= F.col("k"), F.col("g") + 1).otherwise(F.col("g")))
        at = at.select("i", (F.col("k") - first("i")).alias("j"))
        right = left.select(F.col("lid").alias("rid"), F.col("i").alias("j"))
        return at.join(left.select("lid", "i"), "i").join(right, "j").select("lid", "rid")


class NeighbourhoodBlock(IndexAlgorithm):
    """Blocking that tolerates some nulls, some differing keys, and neighbouring values.

    A pair is accepted when the keys within their windows, plus at most ``max_nulls`` null keys, number at
    least all keys but ``max_non_matches``.  An accepted pair really agrees on all keys but
    ``max_non_matches + max_nulls``, so joins on sets of keys find all of them, each in the set of its first keys.
    """

    def __init__(self, left_on=None, right_on=None, max_nulls: int = 0, max_non_matches: int = 0, windows: int | Sequence[int] = 1):
        self.left_on, self.right_on = listed(left_on), listed(right_on) or listed(left_on)
        self.max_nulls, self.max_non_matches = max_nulls, max_non_matches
        self.windows = [windows] if isinstance(windows, int) else list(windows)

    def _pairs(self, a, b, dedup):
        names_l = self.left_on or [c for c in a.df.columns if c in b.df.columns and c not in (a.id_col, b.id_col)]
        names_r = self.right_on or names_l
        if len(names_l) != len(names_r) or not names_l:
            raise ValueError("blocking needs the same number of keys on both sides")
        if len(self.windows) > len(names_l):
            raise ValueError("more windows than keys")
        halves = [_window(w) for w, _ in zip_longest(self.windows, names_l, fillvalue=self.windows[-1])]
        n = len(names_l)
        left, right = a.columns(names_l, "l"), b.columns(names_r, "r")
        scratch = Scratch(left.sparkSession, "neighbourhood")
        for i in range(n):
            ranks = scratch.save(_ranks(left.select(f"l{i}") if dedup and names_l == names_r else left.select(f"l{i}").union(right.select(f"r{i}")), scratch))
            left = left.join(ranks.toDF(f"l{i}", f"lr{i}"), f"l{i}", "left")
            right = right.join(ranks.toDF(f"r{i}", f"rr{i}"), f"r{i}", "left")
        left = left.select("lid", "lord", *(f"lr{i}" for i in range(n)))
        right = right.select("rid", "rord", *(f"rr{i}" for i in range(n)))
        needed = self.max_non_matches + self.max_nulls + 1
        agree = [F.coalesce((F.abs(F.col(f"lr{i}") - F.col(f"rr{i}")) <= halves[i]).cast("int"), F.lit(0)) for i in range(n)]
        nulls = [(F.col(f"lr{i}").isNull() | F.col(f"rr{i}").isNull()).cast("int") for i in range(n)]
        accept = reduce(Column.__add__, agree) + F.least(reduce(Column.__add__, nulls), F.lit(self.max_nulls)) >= n - self.max_non_matches
        if needed > n:
            found = left.join(right, _below(True)) if dedup else left.crossJoin(right)
            return found.filter(accept).select("lid", "rid")
        found = []
        for chosen in self._subsets(n, n - needed + 1):
            # the chosen keys are the first ones on which the pair agrees, so that it is found once
            first = reduce(Column.__and__, (agree[i] == int(i in chosen) for i in range(chosen[-1] + 1)))
            near, keys = left, [(f"lr{i}", f"rr{i}") for i in chosen if not halves[i]]
            wide = [i for i in chosen if halves[i]]
            if wide:
                i = wide[0]
                near = near.withColumn("near", F.explode(F.sequence(F.col(f"lr{i}") - halves[i], F.col(f"lr{i}") + halves[i])))
                keys.append(("near", f"rr{i}"))
            found.append(meet(near, right, keys, _below(dedup) & first & accept).select("lid", "rid"))
        return reduce(DataFrame.union, found)

    @staticmethod
    def _subsets(n: int, least: int) -> list[tuple[int, ...]]:
        """Sets of keys such that the first keys of any ``least`` or more are one of them: of as many keys as ten joins can cover."""
        size = max((t for t in range(1, least + 1) if math.comb(n - least + t, t) <= 10), default=1)
        return list(combinations(range(n - least + size), size))

    def _link(self, a, b):
        return self._pairs(a, b, False)

    def _dedup(self, a):
        return self._pairs(a, a, True)


class Index:
    """Union of the pairs of several algorithms, each pair once; a lone algorithm's result stays as it is."""

    def __init__(self, algorithms: IndexAlgorithm | Sequence[IndexAlgorithm] = ()):
        self.algorithms: list[IndexAlgorithm] = []
        self.add(algorithms)

    def add(self, model: IndexAlgorithm | Sequence[IndexAlgorithm]) -> Index:
        self.algorithms += list(model) if isinstance(model, (list, tuple)) else [model]
        return self

    def full(self) -> Index:
        return self.add(Full())

    def block(self, *args, **kwargs) -> Index:
        return self.add(Block(*args, **kwargs))

    def sortedneighbourhood(self, *args, **kwargs) -> Index:
        return self.add(SortedNeighbourhood(*args, **kwargs))

    def random(self, *args, **kwargs) -> Index:
        return self.add(Random(*args, **kwargs))

    def index(self, x, x_link=None) -> DataFrame:
        if not self.algorithms:
            raise ValueError("no index algorithm given")
        if len(self.algorithms) > 1 and all(type(m) is Block for m in self.algorithms):
            a, b = sides(x, x_link)
            return self._blocks(a, b or a, b is None).toDF(*pair_names(a, b))
        found = [m.index(x, x_link) for m in self.algorithms]
        return found[0] if len(found) == 1 else reduce(DataFrame.union, found).distinct()

    def _blocks(self, a: RecordSet, b: RecordSet, dedup: bool) -> DataFrame:
        """The pairs of several blocks, each block without those of the ones before it, so that no pair has to be shuffled."""
        made, earlier = [], F.lit(False)
        names_l, names_r = (list(dict.fromkeys(c for m in self.algorithms for c in side(m))) for side in (lambda m: m.left_on, lambda m: m.right_on))
        left, right = a.columns(names_l, "l"), b.columns(names_r, "r")
        for m in self.algorithms:
            keys = [(f"l{names_l.index(l)}", f"r{names_r.index(r)}") for l, r in zip(m.left_on, m.right_on)]
            _check_keys(left, right, keys, m)
            made.append(meet(left, right, keys, _below(dedup) & ~earlier).select("lid", "rid"))
            agree = reduce(Column.__and__, (F.col(l) == F.col(r) for l, r in keys))
            earlier = earlier | F.coalesce(agree, F.lit(False))
        return reduce(DataFrame.union, made)

    def stats(self, x, x_link=None) -> dict[str, float]:
        """Number of pairs, of possible pairs, and the reduction ratio (runs jobs)."""
        a, b = sides(x, x_link)
        n = self.index(x, x_link).count()
        n_a = a.df.count()
        n_max = n_a * (n_a - 1) // 2 if b is None else n_a * b.df.count()
        return {"n": n, "n_max": n_max, "reduction_ratio": 1 - n / n_max if n_max else math.nan}


def index_split(pairs: DataFrame, chunks: int, order_by: Sequence[str] | None = None) -> list[DataFrame]:
    """``chunks`` consecutive parts of the pairs; the first ones hold one more when it doesn't divide."""
    numbered = with_chunks(pairs, chunks, order_by)
    return [numbered.filter(F.col("chunk") == i).drop("chunk") for i in range(chunks)]


def with_chunks(pairs: DataFrame, chunks: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """``pairs`` with the number of their part, see :func:`index_split`."""
    if chunks < 1:
        raise ValueError("number of chunks must be positive")
    numbered = with_positions(pairs, *(order_by or pairs.columns[:2]), name="__pos")
    n = pairs.count()
    size, more = divmod(n, chunks)
    edge = more * (size + 1)
    chunk = F.expr(f"__pos div {size + 1}")
    if size:
        chunk = F.when(F.col("__pos") < edge, chunk).otherwise(F.expr(f"{more} + (__pos - {edge}) div {size}"))
    return numbered.withColumn("chunk", chunk.cast("int")).drop("__pos")


split_index = index_split
