"""Similarity of numbers: decay functions of a distance, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = {"step": "step", "linear": "linear", "lin": "linear", "squared": "squared", "exp": "exp", "exponential": "exp", "gauss": "gauss", "gaussian": "gauss"}


def check(method: str, offset: float, scale: float) -> str:
    """The canonical name of the method; raises on wrong parameters."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is no decay method")
    name = METHODS[method]
    if offset < 0:
        raise ValueError("offset must not be negative")
    if name != "step" and scale <= 0:
        raise ValueError("scale must be positive")
    return name


def similarity(distance: Column, method: str, offset: float = 0.0, scale: float = 1.0, origin: float = 0.0) -> Column:
    """1 within ``offset`` of ``origin``, 0.5 one ``scale`` further; null distances give null, but 0 for the step method."""
    name = check(method, offset, scale)
    x = F.abs(distance - F.lit(float(origin)))
    if name == "step":
        return F.when(x <= offset, 1.0).otherwise(0.0)
    beyond = F.greatest(x - F.lit(float(offset)), F.lit(0.0))
    if name == "linear":
        value = 1 - F.least(beyond, F.lit(2.0 * scale)) / (2.0 * scale)
    elif name == "squared":
        value = 1 - 0.5 * F.least(F.pow(beyond / float(scale), 2), F.lit(2.0))
    elif name == "exp":
        value = F.pow(F.lit(2.0), -beyond / float(scale))
    else:
        value = F.pow(F.lit(2.0), -F.pow(beyond / float(scale), 2))
    return F.when(distance.isNotNull(), value)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km on a sphere of radius 6371."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
