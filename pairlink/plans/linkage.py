"""Blocking and comparing in one plan: the compared columns ride along with the blocking join.

The pairs never exist as a table of their own, so the two joins that would look the records up again are
gone: one shuffle by the blocking key (or none, when a side is small enough to broadcast) feeds the whole
projection.  In linking, frequencies among the pairs are counted from the sizes of the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlink.operators.compare import Compare
from pairlink.operators.indexing import Block
from pairlink.operators.meeting import meet
from pairlink.records import pair_names, same_family, sides


def block_and_compare(block: Block, compare: Compare, x, x_link=None, sum_above: float | None = None) -> DataFrame:
    """The same rows as ``compare.compute(block.index(x, x_link), x, x_link)``.

    ``sum_above`` is for who keeps only pairs whose features add up to more than that: pairs that can't are left
    out, as far as that shows without the dear features.
    """
    a, b = sides(x, x_link)
    one, two = pair_names(a, b)
    dedup, b = b is None, b or a
    left, right = compare.needed()
    l, r = a.columns([*left, *block.left_on], "l"), b.columns([*right, *block.right_on], "r")
    l, r = compare.enriched(l, "l"), compare.enriched(r, "r")
    on = F.col("lord") > F.col("rord") if dedup else F.lit(True)
    if sum_above is not None:
        on = on & compare.may_exceed(sum_above)
    keys = [(f"l{len(left) + i}", f"r{len(right) + i}") for i in range(len(block.left_on))]
    for i, (lk, rk) in enumerate(keys):
        if not same_family(l.schema[lk].dataType, r.schema[rk].dataType):
            raise ValueError(f"keys of different types can't block: {block.left_on[i]}, {block.right_on[i]}")
    if not dedup and not l.isStreaming:
        l, r = compare.ahead(l, r, keys)
    return compare.project(meet(l, r, keys, on), a, b, F.col("lid").alias(one), F.col("rid").alias(two))
