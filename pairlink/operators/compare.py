"""Comparing: a similarity vector for every candidate pair, as one projection over one join per side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.operators import features as ft
from pairlink.records import RecordSet, pair_columns, sides


class Compare:
    """A list of features; ``compute`` joins the columns they need to the pairs and evaluates all at once."""

    def __init__(self, features: ft.Feature | Sequence[ft.Feature] = (), n_jobs: int = 1, indexing_type: str = "label"):
        self.features: list[ft.Feature] = []
        self.add(features)

    def add(self, model: ft.Feature | Sequence[ft.Feature]) -> Compare:
        self.features += list(model) if isinstance(model, (list, tuple)) else [model]
        return self

    def exact(self, *args, **kwargs) -> Compare:
        return self.add(ft.Exact(*args, **kwargs))

    def string(self, *args, **kwargs) -> Compare:
        return self.add(ft.String(*args, **kwargs))

    def numeric(self, *args, **kwargs) -> Compare:
        return self.add(ft.Numeric(*args, **kwargs))

    def geo(self, *args, **kwargs) -> Compare:
        return self.add(ft.Geographic(*args, **kwargs))

    def date(self, *args, **kwargs) -> Compare:
        return self.add(ft.Date(*args, **kwargs))

    def compare_vectorized(self, function: Callable, labels_left, labels_right, *args, label=None, returns=None, **kwargs) -> Compare:
        """A feature by a function of Columns or of pandas Series; see :class:`~pairlink.operators.features.Vectorised`."""
        return self.add(ft.Vectorised(function, labels_left, labels_right, *args, label=label, returns=returns, **kwargs))

    def needed(self) -> tuple[list[str], list[str]]:
        """The columns of either side that the features read."""
        return list(dict.fromkeys(c for f in self.features for c in f.left_on)), list(dict.fromkeys(c for f in self.features for c in f.right_on))

    def enriched(self, side: DataFrame, prefix: str) -> DataFrame:
        """``side`` (columns <prefix>0 ... as :meth:`needed`) with what features compute once per record, as <prefix>f<feature>_<column>."""
        names = self.needed()[prefix == "r"]
        made = {}
        for n, f in enumerate(self.features):
            once = f.per_record()
            if once:
                made |= {f"{prefix}f{n}_{i}": once(F.col(f"{prefix}{names.index(c)}")) for i, c in enumerate(f.left_on if prefix == "l" else f.right_on)}
        return side.withColumns(made) if made else side

    def ahead(self, l: DataFrame, r: DataFrame, keys: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
        """The two sides with what features know of all pairs that agree on ``keys`` before these are made."""
        left, right = self.needed()
        for n, f in enumerate(self.features):
            if isinstance(f, ft.Frequency):
                f.own = f"__f{n}"
                l, r = f.ahead(l, r, [F.col(f"l{left.index(c)}") for c in f.left_on], [F.col(f"r{right.index(c)}") for c in f.right_on], keys)
        return l, r

    def may_exceed(self, total: float) -> Column:
        """False where the features of a pair can't add up to more than ``total`` (null counts as 0); reads l0 ... and r0 ..., no dear feature."""
        left, right = self.needed()
        most = [f.most([F.col(f"l{left.index(c)}") for c in f.left_on], [F.col(f"r{right.index(c)}") for c in f.right_on]) for f in self.features]
        if not most or any(m is None for m in most):
            return F.lit(True)
        # a little more, for what rounding does
        return reduce(Column.__add__, (F.coalesce(m, F.lit(0.0)) for m in most)) > total - 1e-9

    def compute(self, pairs: DataFrame, x, x_link=None) -> DataFrame:
        """``pairs`` with a column per feature; every row of ``pairs`` is kept, repeated ones too."""
        if not isinstance(pairs, DataFrame):
            raise TypeError("pairs must be a DataFrame")
        a, b = sides(x, x_link)
        b = b or a
        one, two = pair_columns(pairs)
        left, right = self.needed()
        joined = pairs.select(F.col(one).alias("__1"), F.col(two).alias("__2"))
        joined = joined.join(self.enriched(a.columns(left, "l").drop("lord"), "l"), F.col("__1") == F.col("lid")).join(self.enriched(b.columns(right, "r").drop("rord"), "r"), F.col("__2") == F.col("rid"))
        return self.project(joined, a, b, F.col("__1").alias(one), F.col("__2").alias(two))

    def project(self, joined: DataFrame, a: RecordSet, b: RecordSet, *keep) -> DataFrame:
        """The features of a table that holds the needed columns as l0 ... and r0 ...; ``keep`` goes before them."""
        left, right = self.needed()
        names: list[str] = []
        columns = []
        for n, f in enumerate(self.features):
            f.check([a.df.schema[c] for c in f.left_on], [b.df.schema[c] for c in f.right_on])
            f.own = f"__f{n}"
            l, r = [F.col(f"l{left.index(c)}") for c in f.left_on], [F.col(f"r{right.index(c)}") for c in f.right_on]
            joined = f.prepare(joined, l, r)
            for side, p in ((l, "l"), (r, "r")):
                side += [F.col(c) for c in (f"{p}f{n}_{i}" for i in range(len(side))) if c in joined.columns]
            made = f.columns(l, r)
            labels = f.labels or [str(len(names) + i) for i in range(len(made))]
            if len(labels) != len(made):
                raise ValueError("a feature has another number of columns than labels")
            names += labels
            columns += [c.alias(n) for c, n in zip(made, labels)]
        return joined.select(*keep, *columns)
