"""Consolidating pairwise matches into groups: deterministic Boruvka hooking.

Every round, each component selects its smallest outgoing edge; edges are ordered by (smaller end, larger
end), a total order after deduplication, so the selected edges form trees whose only cycle is the mutual
choice of the tree's smallest edge.  Trees collapse by pointer doubling, edges are relabelled by the roots
and deduplicated, and the rounds end when no edge is left.  At least half of the components disappear in
every round.  Because the smallest edge of a tree holds its smallest vertex, the root of a tree is the
smallest label below it and the final label is the smallest id of the group.

All state lives in tables of the shared scratch folder; the driver only learns whether a table is empty.
A hub (one id in a third of all pairs) meets only partial aggregates (min, distinct) and joins that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.scratch import Scratch


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(id, group_id)`` for every id that a pair links to another id.

    Pairs with a null end and pairs of an id with itself link nothing; repeated and reversed pairs count
    once; an empty input gives an empty result.  ``group_id`` is the smallest id of the group.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    u, v = F.col(left), F.col(right)
    edges = scratch.save(
        pairs.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    )
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        parents = scratch.save(_collapse(_smallest_edges(edges), scratch))
        rounds.append(parents)
        relabelled = scratch.save(_relabel(edges, parents))
        scratch.drop(edges)
        edges = relabelled
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = labels.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
        labels = earlier.join(later, "parent", "left").select("id", F.coalesce("root", "parent").alias("parent"))
    return labels.select("id", F.col("parent").alias("group_id"))


def _smallest_edges(edges: DataFrame) -> DataFrame:
    """(id, parent): the far end of each vertex's smallest edge, which is its smallest neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.col("u").alias("to")))).alias("e"))
    return both.groupBy(F.col("e.id").alias("id")).agg(F.min("e.to").alias("parent"))


def _collapse(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling until every vertex points at the root of its tree."""
    pointers = scratch.save(hooks)
    first = True
    while True:
        above = pointers.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        jump: Column = F.col("above")
        if first:  # the mutual choice: the smaller of the two becomes the root
            jump = F.when(F.col("above") == F.col("id"), F.least("id", "parent")).otherwise(F.col("above"))
        moved = scratch.save(pointers.join(above, "parent").select("id", jump.alias("parent"), (F.col("parent") != jump).alias("moved")))
        scratch.drop(pointers)
        pointers = moved
        if pointers.filter("moved").isEmpty():
            return pointers.select("id", "parent")
        first = False


def _relabel(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the roots, without loops, once each."""
    a = parents.select(F.col("id").alias("u"), F.col("parent").alias("ru"))
    b = parents.select(F.col("id").alias("v"), F.col("parent").alias("rv"))
    ends = edges.join(a, "u").join(b, "v").filter("ru <> rv")
    return ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()


def id_key(c: Column | str) -> Column:
    """The form under which differently written ids are the same: letters and digits, lower case."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^0-9a-z]+", "")


def record_groups(records: DataFrame, id_col: str, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(<id_col>, group_id)`` of the records that ``pairs`` links, ids as written in ``records``.

    Ids of pairs may be written in another case or with other separators and blanks.  Ids that ``records``
    doesn't hold still link their neighbours but are not returned; ``group_id`` is the smallest returned id
    of the group, and groups of which fewer than two records are known are left out.
    """
    keyed = pairs.select(id_key(left).alias("a"), id_key(right).alias("b"))
    groups = connected_groups(keyed, "a", "b")
    written = records.select(F.col(id_col).alias("rec")).filter("rec is not null").distinct().select(id_key("rec").alias("id"), "rec")
    scratch = Scratch(records.sparkSession, "groups")
    known = scratch.save(groups.join(written, "id").select(F.col("group_id").alias("g"), "rec"))
    names = known.groupBy("g").agg(F.min("rec").alias("group_id"), F.count("*").alias("n")).filter("n > 1").select("g", "group_id")
    return known.join(names, "g").select(F.col("rec").alias(id_col), "group_id")
