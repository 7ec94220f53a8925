"""Resolving links: one to one, one to many, connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlink.records import pair_columns
from pairlink.scratch import Scratch


def _ends(links: DataFrame) -> tuple[str, str]:
    if not isinstance(links, DataFrame):
        raise TypeError("links must be a DataFrame")
    return pair_columns(links)


def _ordered(links: DataFrame, order_by: str | None) -> tuple[DataFrame, list]:
    """The order in which links are served: the given column, then the ids."""
    one, two = pair_columns(links)
    return links, [*([F.col(order_by)] if order_by else []), F.col(one), F.col(two)]


class OneToOneLinking:
    """Keeps a link if no earlier kept link uses either of its ids (greedy, in the order of ``order_by`` and the ids).

    A round keeps the links that come first for both of their ids and drops what conflicts with them, which
    gives the same links as going through them one by one.  Chains of links that each wait for the one before
    would need a round per kept link, so after ``rounds`` rounds the components of what is left are gone
    through one by one, each in its own task; components of more than ``component_links`` links take further
    rounds.  Links with a null id are not kept.
    """

    def __init__(self, method: str = "greedy", rounds: int = 3, component_links: int = 100_000):
        if method != "greedy":
            raise ValueError(f"unknown matching method {method!r}")
        self.rounds, self.component_links = max(1, rounds), component_links
        self.rounds_run = 0

    def compute(self, links: DataFrame, order_by: str | None = None) -> DataFrame:
        one, two = _ends(links)
        links, order = _ordered(links, order_by)
        scratch = Scratch(links.sparkSession, "one-to-one")
        named = links.select(F.col(one).alias("a"), F.col(two).alias("b"), F.struct(*order).alias("o"))
        left = scratch.save(named.filter("a is not null and b is not null").groupBy("a", "b").agg(F.min("o").alias("o")))
        kept = [left.select("a", "b").limit(0)]
        self.rounds_run = 0
        while not left.isEmpty():
            self.rounds_run += 1
            by_a, by_b = left.groupBy("a").agg(F.min("o").alias("ao")), left.groupBy("b").agg(F.min("o").alias("bo"))
            best = scratch.save(left.join(by_a, "a").join(by_b, "b").filter("o = ao and o = bo").select("a", "b"))
            kept.append(best)
            rest = scratch.save(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti").select("a", "b", "o"))
            scratch.drop(left)
            left = rest
            if self.rounds_run % self.rounds == 0 and not left.isEmpty():
                scanned, left = self._by_component(left, scratch)
                kept.append(scanned)
        out = kept[0]
        for k in kept[1:]:
            out = out.union(k)
        return out.toDF(one, two)

    def _by_component(self, left: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(kept links of the components that fit into a task, all links of the others)."""
        labels = ConnectedComponents().compute(left.select("a", "b"), sides=True).select(F.col("component").alias("c"), "a", "b")
        placed = scratch.save(left.join(labels, ["a", "b"]).select("a", "b", "o", "c"))
        sizes = placed.groupBy("c").agg(F.count("*").alias("n"))
        placed = placed.join(sizes, "c")
        ranked = placed.filter(F.col("n") <= self.component_links).select("c", "a", "b", F.row_number().over(Window.partitionBy("c").orderBy("o")).alias("r"))

        def scan(pdf):
            used_a, used_b, keep = set(), set(), []
            for a, b in pdf.sort_values("r")[["a", "b"]].itertuples(index=False, name=None):
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    keep.append((a, b))
            return pd.DataFrame(keep, columns=["a", "b"])

        found = ranked.groupBy("c").applyInPandas(scan, ranked.select("a", "b").schema)
        return scratch.save(found), scratch.save(placed.filter(F.col("n") > self.component_links).select("a", "b", "o"))


class OneToManyLinking:
    """Keeps the first link of each id at ``level``."""

    def __init__(self, level: int = 0, method: str = "greedy"):
        if method != "greedy":
            raise ValueError(f"unknown matching method {method!r}")
        self.level = level

    def compute(self, links: DataFrame, order_by: str | None = None) -> DataFrame:
        ends = _ends(links)
        links, order = _ordered(links, order_by)
        first = Window.partitionBy(ends[self.level]).orderBy(*order)
        return links.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*ends)


class ConnectedComponents:
    """(component, id_1, id_2): the links with the smallest id of their component.

    Alternating stars: every vertex ties its larger neighbours to the smallest one it knows, then its smaller
    ones, until all edges point at the smallest id.  Rounds grow with the logarithm of the number of vertices
    whatever their labels are, and the edges never grow in number.  In linking, where both sides have ids of
    their own, tag them before (``sides=True``).  Links with a null first id are left out.
    """

    rounds_run = 0

    def compute(self, links: DataFrame, sides: bool = False) -> DataFrame:
        one, two = _ends(links)
        l, r = F.col(one), F.col(two)
        if sides:
            l, r = F.struct(F.lit(0).alias("side"), l.alias("id")), F.struct(F.lit(1).alias("side"), r.alias("id"))
        scratch = Scratch(links.sparkSession, "components")
        pairs = links.filter(F.col(one).isNotNull()).select(l.alias("u"), r.alias("v"), F.col(one).alias("__1"), F.col(two).alias("__2"))
        known = pairs.filter(F.col("__2").isNotNull()).filter("u <> v")
        edges, state = self._saved(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scratch)
        self.rounds_run = 0
        while True:
            self.rounds_run += 1
            stars, after = self._saved(self._small(self._large(edges)), scratch)
            scratch.drop(edges)
            edges = stars
            if after == state:
                break
            state = after
        found = pairs.join(edges.select("u", F.col("v").alias("c")), "u", "left").withColumn("c", F.coalesce("c", "u"))
        component = F.col("c.id") if sides else F.col("c")
        return found.select(component.alias("component"), F.col("__1").alias(one), F.col("__2").alias(two))

    @staticmethod
    def _saved(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
        """The written edges, and what tells them from other sets of edges (no Observation: it would keep models of Spark ML from being serialised)."""
        saved = scratch.save(edges)
        return saved, tuple(saved.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    @staticmethod
    def _large(edges: DataFrame) -> DataFrame:
        """Larger neighbours go to the smallest of a vertex and its neighbours."""
        lowest = edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("m")), F.struct("v", F.col("v").alias("m")))).alias("e")).groupBy(F.col("e.v").alias("v")).agg(F.min("e.m").alias("m"))
        return edges.join(lowest, "v").select("u", F.col("m").alias("v"))

    @staticmethod
    def _small(edges: DataFrame) -> DataFrame:
        """A vertex and its smaller neighbours go to the smallest of them."""
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        ends = edges.join(lowest, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        return ends.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
