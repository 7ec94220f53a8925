"""Comparison features: each turns two sides' columns into similarity columns."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlink.functions import decay, text
from pairlink.records import listed, same_family


def _missing(value: Any) -> Any:
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


def _number(value: Any) -> Any:
    """A literal as the feature shows it: numbers as double, text as text, NaN as null."""
    value = _missing(value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


class Feature:
    """Base of all features.

    Subclasses name the columns they need and give ``columns(left, right)``; one that needs statistics of all
    pairs overrides ``prepare``, which may add columns to the joined table under names from ``own``.
    """

    def __init__(self, left_on=None, right_on=None, label: str | Sequence[str] | None = None):
        self.left_on, self.right_on = listed(left_on), listed(right_on)
        self.labels = listed(label) if label is not None else None
        self.own = ""

    def check(self, left: list[T.StructField], right: list[T.StructField]) -> None:
        """Raise if the columns' types don't fit."""

    def per_record(self) -> Callable[[Column], Column] | None:
        """What to compute once per record from each of the feature's columns, before records meet in pairs.

        ``columns`` then gets the results behind the columns themselves.
        """
        return None

    def prepare(self, joined: DataFrame, left: list[Column], right: list[Column]) -> DataFrame:
        return joined

    def columns(self, left: list[Column], right: list[Column]) -> list[Column]:
        raise NotImplementedError("a feature needs columns")

    def most(self, left: list[Column], right: list[Column]) -> Column | None:
        """What the feature is at most for a pair, as far as that is cheap to tell; None if nothing is known."""
        return None


BaseCompareFeature = Feature


def mixed(known: Column, value: Column, missing: Any, *others: Any) -> Column:
    """``value`` where known, else the missing value; text if any of the literals is text."""
    missing = _number(missing)
    if any(isinstance(_number(x), str) for x in (missing, *others)):
        value = value.cast("string")
        missing = None if missing is None else str(missing)
    return F.when(known, value).otherwise(F.lit(missing))


class Exact(Feature):
    def __init__(self, left_on, right_on, agree_value: Any = 1, disagree_value: Any = 0, missing_value: Any = 0, label=None):
        super().__init__(left_on, right_on, label)
        self.agree, self.disagree, self.missing = agree_value, disagree_value, missing_value

    def check(self, left, right):
        if not same_family(left[0].dataType, right[0].dataType):
            raise ValueError("values of different types can't be equal")

    def columns(self, left, right):
        (l,), (r,) = left, right
        other = _number(self.disagree)
        if self.agree == "value":
            # a value, or one of two literals that its type may not hold: shown as text
            show = lambda x: F.lit(None if _missing(x) is None else str(x))
            return [F.when(l.isNull() | r.isNull(), show(self.missing)).when(l == r, l.cast("string")).otherwise(show(self.disagree))]
        agree = _number(self.agree)
        as_text = any(isinstance(x, str) for x in (agree, other, _number(self.missing)))
        lit = lambda x: F.lit(None if x is None else str(x) if as_text else x)
        return [F.when(l.isNull() | r.isNull(), lit(_number(self.missing))).when(l == r, lit(agree)).otherwise(lit(other)).cast("string" if as_text else "double")]

    def most(self, left, right):
        return None if any(isinstance(_number(x), str) for x in (self.agree, self.disagree, self.missing)) else self.columns(left, right)[0]


class String(Feature):
    def __init__(self, left_on, right_on, method: str = "levenshtein", threshold: float | None = None, missing_value: Any = 0.0, label=None):
        super().__init__(left_on, right_on, label)
        self.method, self.threshold, self.missing = method, threshold, missing_value

    def check(self, left, right):
        for f in (*left, *right):
            if not isinstance(f.dataType, (T.StringType, T.NullType)):
                raise TypeError(f"{f.name} is not a string column")

    def per_record(self):
        return (lambda c: text.bag(c.cast("string"))) if text.takes_bags(self.method) else None

    def columns(self, left, right):
        (l, *bag_l), (r, *bag_r) = left, right
        bags = (bag_l[0], bag_r[0]) if bag_l and bag_r else None
        value = text.similarity(l.cast("string"), r.cast("string"), self.method, self.threshold, bags)
        known = value.isNotNull()
        if self.threshold is not None:
            value = F.when(value >= self.threshold, 1.0).otherwise(0.0)
        return [mixed(known, value, self.missing)]

    def most(self, left, right):
        """1, and for the edit distance what the lengths of different strings leave."""
        missing = _number(self.missing)
        if isinstance(missing, str):
            return None
        l, r = left[0].cast("string"), right[0].cast("string")
        best = F.lit(1.0)
        if self.threshold is None and text.ALIASES.get(self.method) == "levenshtein":
            best = F.when(l == r, best).otherwise(1 - F.try_divide(F.greatest(F.abs(F.length(l) - F.length(r)), F.lit(1)), F.greatest(F.length(l), F.length(r))))
        return F.greatest(best, F.lit(0.0 if missing is None else missing))


class Numeric(Feature):
    def __init__(self, left_on, right_on, method: str = "linear", offset: float = 0.0, scale: float = 1.0, origin: float = 0.0, missing_value: Any = 0.0, label=None):
        super().__init__(left_on, right_on, label)
        decay.check(method, offset, scale)
        self.args, self.missing = (method, offset, scale, origin), missing_value

    def check(self, left, right):
        for f in (*left, *right):
            if not isinstance(f.dataType, (T.NumericType, T.NullType)):
                raise TypeError(f"{f.name} is not a number column")

    def _distance(self, left, right) -> Column:
        return right[0].cast("double") - left[0].cast("double")

    def columns(self, left, right):
        value = decay.similarity(self._distance(left, right), *self.args)
        return [mixed(value.isNotNull(), value, self.missing)]

    def most(self, left, right):
        return None if isinstance(_number(self.missing), str) else self.columns(left, right)[0]


class Geographic(Numeric):
    """The decay of the great-circle distance in km; the method has no default."""

    def __init__(self, left_on_lat, left_on_lng, right_on_lat, right_on_lng, method: str | None = None, offset: float = 0.0, scale: float = 1.0, origin: float = 0.0, missing_value: Any = 0.0, label=None):
        Feature.__init__(self, [left_on_lat, left_on_lng], [right_on_lat, right_on_lng], label)
        decay.check(method, offset, scale)
        self.args, self.missing = (method, offset, scale, origin), missing_value

    def _distance(self, left, right):
        return decay.haversine(*(c.cast("double") for c in (*left, *right)))


class Date(Feature):
    """1 for equal dates, less for swapped day and month or often confused months.

    Of the rules that fit, the last one counts, months after the swap; a rule that gives 1 is final.  A swap
    value of None or 0 leaves the rule out, NaN gives a null.
    """

    #: Fixed values: (month, other month, similarity) where nothing else is given.
    SWAPPED_MONTHS = [(6, 7, 0.5), (7, 6, 0.5), (9, 10, 0.5), (10, 9, 0.5)]

    def __init__(self, left_on, right_on, swap_month_day: float | None = 0.5, swap_months="default", errors: str = "coerce", missing_value: Any = 0.0, label=None):
        super().__init__(left_on, right_on, label)
        if isinstance(swap_months, str) and swap_months == "default":
            swap_months = self.SWAPPED_MONTHS
        if not all(isinstance(x, (list, tuple)) and len(x) == 3 for x in swap_months or []):
            raise ValueError("swap_months is a list of (month, other month, value)")
        self.swap, self.months, self.missing = swap_month_day, [tuple(x) for x in swap_months or []], missing_value

    def check(self, left, right):
        for f in (*left, *right):
            if not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise ValueError(f"{f.name} is not a date column")

    def columns(self, left, right):
        (l,), (r,) = left, right
        y, m, d = F.year, F.month, F.dayofmonth
        same_year = y(l) == y(r)
        rules = [(same_year & (m(l) == d(r)) & (d(l) == m(r)), self.swap)] if self.swap else []
        rules += [(same_year & (d(l) == d(r)) & (m(l) == one) & (m(r) == other), v) for one, other, v in self.months]
        value = F.when(l == r, F.lit(1.0))
        for fits, v in rules:
            if v == 1:
                value = value.when(fits, F.lit(1.0))
        for fits, v in reversed(rules):
            value = value.when(fits, F.lit(_number(v)).cast("double"))
        return [mixed(l.isNotNull() & r.isNotNull(), value.otherwise(F.lit(0.0)), self.missing)]

    def most(self, left, right):
        return None if isinstance(_number(self.missing), str) else self.columns(left, right)[0]


class Variable(Feature):
    """Passes columns of either side through."""

    def __init__(self, left_on=None, right_on=None, missing_value: Any = 0.0, label=None):
        super().__init__(left_on, right_on, label)
        self.missing = missing_value

    def columns(self, left, right):
        return [mixed(c.isNotNull(), c, self.missing) for c in (*left, *right)]


class VariableA(Variable):
    def __init__(self, on=None, missing_value: Any = 0.0, label=None):
        super().__init__(on, None, missing_value, label)


class VariableB(Variable):
    def __init__(self, on=None, missing_value: Any = 0.0, label=None):
        super().__init__(None, on, missing_value, label)


class Frequency(Feature):
    """How often a value occurs among the candidate pairs, as a share of them if ``normalise``."""

    def __init__(self, left_on=None, right_on=None, normalise: bool = True, missing_value: Any = 0.0, label=None):
        super().__init__(left_on, right_on, label)
        self.normalise, self.missing = normalise, missing_value

    def ahead(self, l: DataFrame, r: DataFrame, left: list[Column], right: list[Column], keys: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
        """Records with the counts of their values among the pairs that agree on ``keys``, so that no pair has to be moved for them.

        A record is in as many pairs as the other side has records of its keys.
        """
        k = [f"__k{i}" for i in range(len(keys))]
        sizes = [side.groupBy(*(F.col(pair[at]).alias(x) for x, pair in zip(k, keys))).agg(F.count("*").alias("__m")) for at, side in enumerate((l, r))]
        out = [l, r]
        for i, c in enumerate((*left, *right)):
            at = int(i >= len(left))
            own = [F.col(pair[at]) for pair in keys]
            held = (l, r)[at].filter(c.isNotNull()).groupBy(c.alias(f"{self.own}v{i}"), *(x.alias(f"__o{j}") for j, x in enumerate(own))).agg(F.count("*").alias("__n"))
            held = held.join(sizes[1 - at], [F.col(f"__o{j}") == F.col(x) for j, x in enumerate(k)])
            counts = held.groupBy(f"{self.own}v{i}").agg(F.sum(F.col("__n") * F.col("__m")).cast("double").alias(f"{self.own}c{i}"))
            out[at] = out[at].join(counts, c == F.col(f"{self.own}v{i}"), "left").drop(f"{self.own}v{i}")
        if self.normalise:
            both = sizes[0].join(sizes[1].toDF(*(f"__o{j}" for j in range(len(k))), "__n"), [F.col(f"__o{j}") == F.col(x) for j, x in enumerate(k)])
            out[0] = out[0].join(F.broadcast(both.agg(F.sum(F.col("__m") * F.col("__n")).cast("double").alias(f"{self.own}n"))), how="cross")  # one row
        return out[0], out[1]

    def prepare(self, joined, left, right):
        if f"{self.own}c0" in joined.columns:
            return joined
        # one small aggregate per column joined back, rather than a window that sorts all pairs by the value
        if self.normalise:
            joined = joined.join(F.broadcast(joined.agg(F.count("*").cast("double").alias(f"{self.own}n"))), how="left")  # one row
        for i, c in enumerate((*left, *right)):
            counts = joined.filter(c.isNotNull()).groupBy(c.alias(f"{self.own}v{i}")).agg(F.count("*").cast("double").alias(f"{self.own}c{i}"))
            joined = joined.join(counts, c == F.col(f"{self.own}v{i}"), "left")
        return joined

    def columns(self, left, right):
        out = []
        for i in range(len(left) + len(right)):
            count = F.col(f"{self.own}c{i}")
            out.append(mixed(count.isNotNull(), count / F.col(f"{self.own}n") if self.normalise else count, self.missing))
        return out


class FrequencyA(Frequency):
    def __init__(self, on=None, normalise: bool = True, missing_value: Any = 0.0, label=None):
        super().__init__(on, None, normalise, missing_value, label)


class FrequencyB(Frequency):
    def __init__(self, on=None, normalise: bool = True, missing_value: Any = 0.0, label=None):
        super().__init__(None, on, normalise, missing_value, label)


class RandomContinuous(Feature):
    """Uniform values between ``a`` and ``b``."""

    def __init__(self, a: float = 0.0, b: float = 1.0, label=None, random_state: int | None = None):
        super().__init__(None, None, label)
        self.a, self.b, self.seed = a, b, random_state

    def columns(self, left, right):
        return [F.rand(self.seed) * (self.b - self.a) + self.a]


class RandomDiscrete(Feature):
    """Values drawn from a list, or below an integer."""

    def __init__(self, a: int | Sequence = (0, 1), dtype: str = "double", label=None, random_state: int | None = None):
        super().__init__(None, None, label)
        self.values, self.dtype, self.seed = list(range(a)) if isinstance(a, int) else list(a), dtype, random_state

    def columns(self, left, right):
        at = F.floor(F.rand(self.seed) * len(self.values)).cast("int")
        return [F.get(F.array(*map(F.lit, self.values)), at).cast(self.dtype)]


def _probe(field: T.StructField) -> pd.Series:
    """Two values of the field's type, as a function of Series would meet them."""
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return pd.Series([True, False])
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return pd.Series([1.0, 2.0])
    if isinstance(t, T.NumericType):
        return pd.Series([1, 2])
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return pd.Series(pd.to_datetime(["2001-02-03", "2001-02-04"]))
    if isinstance(t, T.DateType):
        return pd.Series([datetime.date(2001, 2, 3), datetime.date(2001, 2, 4)])
    return pd.Series(["a", "b"])


def _outputs(result: Any, n: int) -> list[pd.Series]:
    """The columns of what a function of Series returns: one Series or array, several of them, or a DataFrame."""
    if isinstance(result, pd.DataFrame):
        result = [result[c] for c in result.columns]
    elif not isinstance(result, (tuple, list)) or len(result) == n and not any(hasattr(x, "__len__") and not isinstance(x, str) for x in result):
        result = [result]
    out = [pd.Series(np.asarray(x)) if not isinstance(x, pd.Series) else x.reset_index(drop=True) for x in result]
    if any(len(x) != n for x in out):
        raise ValueError("a comparison function returns one value per pair")
    return out


class Vectorised(Feature):
    """A user's function of Columns, or of pandas Series.

    A function of Columns returns one Column or several and runs in the JVM.  Any other function is called with
    Series of the pairs' values (left columns, right columns, then the further arguments) in Arrow batches and
    returns a Series, an array, several of them, or a DataFrame.  Their types are those it returns for two
    made-up pairs; ``returns`` (one type or a list) names them where that doesn't work.
    """

    def __init__(self, function: Callable, left_on, right_on, *args: Any, label=None, returns: str | Sequence[str] | None = None, **kwargs: Any):
        super().__init__(left_on, right_on, label)
        self.function, self.args, self.kwargs, self.returns = function, args, kwargs, listed(returns)
        self.fields: list[T.StructField] = []

    def check(self, left, right):
        self.fields = [*left, *right]

    def columns(self, left, right):
        if not self.returns:
            try:
                out = self.function(*left, *right, *self.args, **self.kwargs)
            except Exception:  # noqa: BLE001 - no function of Columns
                out = None
            if isinstance(out, Column):
                return [out]
            if isinstance(out, (list, tuple)) and out and all(isinstance(c, Column) for c in out):
                return list(out)
        return self._series(left, right)

    def _types(self) -> list[str]:
        if self.returns:
            return self.returns
        try:
            found = _outputs(self.function(*map(_probe, self.fields), *self.args, **self.kwargs), 2)
        except Exception as e:
            raise ValueError("the comparison function works on neither Columns nor Series of two pairs; name its types with returns") from e
        kinds = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "M": "timestamp"}
        return [kinds.get(x.dtype.kind, "string") for x in found]

    def _series(self, left, right):
        types = self._types()
        function, args, kwargs = self.function, self.args, self.kwargs

        def apply(*series: pd.Series) -> pd.DataFrame:
            out = _outputs(function(*series, *args, **kwargs), len(series[0]))
            # numbers may have become floats for the sake of a missing value
            return pd.DataFrame({f"c{i}": x.astype("Int64") if t in ("bigint", "int") and x.dtype.kind == "f" else x for i, (x, t) in enumerate(zip(out, types))})

        made = F.pandas_udf(apply, ", ".join(f"c{i} {t}" for i, t in enumerate(types)))(*left, *right)
        return [made.getField(f"c{i}") for i in range(len(types))]
