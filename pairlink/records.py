"""Record tables: a DataFrame with an id column and an order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlink.options import get_option


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating-point columns: a missing value is NULL everywhere else."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is so small that its scan can't give every core a split of its own.

    Else the pairs of a table of a file or two would all be made in the few tasks that read it.  Larger tables have
    splits enough and don't pay for a shuffle.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() * cores else df


@dataclass(frozen=True)
class RecordSet:
    """Records with a unique id.  ``order_by`` decides which record of a pair comes first in deduplication."""

    df: DataFrame
    id_col: str
    order_by: str | None = None

    def __post_init__(self) -> None:
        for c in (self.id_col, self.order_by or self.id_col):
            if c not in self.df.columns:
                raise KeyError(f"label is not found in the dataframe: {c}")

    def verify(self) -> RecordSet:
        """Raise if an id occurs twice (runs a job)."""
        if not self.df.groupBy(self.id_col).count().filter("count > 1").isEmpty():
            raise ValueError("The index of the records is not unique.")
        return self

    def columns(self, names: Sequence[str], prefix: str) -> DataFrame:
        """``<prefix>id``, ``<prefix>ord`` and the named columns as ``<prefix>0`` ..., in the order given."""
        for n in names:
            if n not in self.df.columns:
                raise KeyError(f"label is not found in the dataframe: {n}")
        clean = null_if_nan(self.df.select(*dict.fromkeys([self.id_col, self.order_by or self.id_col, *names])))
        return clean.select(F.col(self.id_col).alias(f"{prefix}id"), F.col(self.order_by or self.id_col).alias(f"{prefix}ord"), *(F.col(n).alias(f"{prefix}{i}") for i, n in enumerate(names)))


def as_records(x: RecordSet | DataFrame) -> RecordSet:
    """A DataFrame stands for records whose id is its first column."""
    if isinstance(x, RecordSet):
        return x
    if isinstance(x, DataFrame):
        return RecordSet(x, x.columns[0])
    raise ValueError("records must be a RecordSet or a DataFrame")


def sides(x, x_link=None) -> tuple[RecordSet, RecordSet | None]:
    """The arguments of an operator on one or two record tables: ``x``, ``[x]``, ``(a, b)`` or ``a, b``."""
    if x is None:
        raise ValueError("no records given")
    if isinstance(x, (list, tuple)):
        if len(x) not in (1, 2) or (len(x) == 2 and x_link is not None):
            raise ValueError("give one or two record tables")
        x, x_link = x[0], x[1] if len(x) == 2 else x_link
    return as_records(x), None if x_link is None else as_records(x_link)


def pair_names(a: RecordSet, b: RecordSet | None) -> tuple[str, str]:
    """Names of the pair columns: the id names, told apart by the suffixes of option indexing.pairs_suffixes if equal."""
    left, right = a.id_col, (b or a).id_col
    if left != right:
        return left, right
    one, two = get_option("indexing.pairs_suffixes")
    return f"{left}{one}", f"{right}{two}"


def pair_columns(pairs: DataFrame) -> tuple[str, str]:
    """The id columns of a pair table: its first two."""
    if len(pairs.columns) < 2:
        raise ValueError("a pair table needs two id columns")
    return pairs.columns[0], pairs.columns[1]


def listed(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def same_family(a: T.DataType, b: T.DataType) -> bool:
    """Can values of the two types be equal without a silent cast between text and numbers?"""
    family = lambda t: "number" if isinstance(t, T.NumericType) else "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else t.typeName()
    return family(a) == family(b)


def all_known(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out
