"""Cleaning of text columns."""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with an accent, and the letters without."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        kept = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(kept) == 1 and kept[0] != chr(code) and unicodedata.category(chr(code)).startswith("L"):
            marked.append(chr(code))
            plain.append(kept[0])
    return "".join(marked), "".join(plain)


def strip_accents(c: Column) -> Column:
    """Letters without their accents (one to one), and no combining marks."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}+", "")


_without = strip_accents


def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def _decoded(c: Column, encoding: str, decode_error: str) -> Column:
    if codecs.lookup(encoding).name == "utf-8" and decode_error == "strict":
        return F.validate_utf8(c.cast("string"))
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else bytes(x).decode(encoding, decode_error)), StringType())(c)


def clean(
    c: Column | str, lowercase: bool = True, replace_by_none: str | None = r"[^ \-\_A-Za-z0-9]+", replace_by_whitespace: str | None = r"[\-\_]",
    strip_accents: str | Callable[[pd.Series], pd.Series] | None = None, remove_brackets: bool = True,
    encoding: str | None = None, decode_error: str = "strict",
) -> Column:
    """Lower case, accents off, brackets with their content out, then the two patterns, single blanks, trimmed.  Null stays null.

    With an ``encoding`` the column holds bytes, which are decoded first; ``decode_error`` is 'strict' (the
    query fails), 'ignore' or 'replace'.
    """
    c = F.col(c) if isinstance(c, str) else c
    if decode_error not in ("strict", "ignore", "replace"):
        raise ValueError(f"invalid value for decode_error: {decode_error!r}")
    if encoding is not None:
        c = _decoded(c.cast("binary"), encoding, decode_error)
    if lowercase:
        c = F.lower(c)
    if callable(strip_accents):
        c = F.pandas_udf(strip_accents, StringType())(c)
    elif strip_accents == "unicode":
        c = _without(c)
    elif strip_accents == "ascii":
        c = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.pandas_udf(_ascii, StringType())(c))
    elif strip_accents is not None:
        raise ValueError(f"invalid value for strip_accents: {strip_accents!r}")
    if remove_brackets:
        c = F.regexp_replace(c, r"(?d)(\[.*?\]|\(.*?\)|\{.*?\})", "")
    if replace_by_none:
        c = F.regexp_replace(c, replace_by_none, "")
    if replace_by_whitespace:
        c = F.regexp_replace(c, replace_by_whitespace, " ")
    c = F.regexp_replace(c, r"(?U)\s\s+", " ")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def phonenumbers(c: Column | str) -> Column:
    """Only digits and plus signs."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^0-9+]+", "")


def value_occurence(df: DataFrame, column: str, name: str = "occurence") -> DataFrame:
    """``df`` with how often each row's value occurs; nulls are one value.  Counts are aggregated before they are joined back."""
    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")
