"""Person records in the FEBRL layout, from CSV files that the user has, and their true links."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the files, all read as text.
COLUMNS = ["rec_id", "given_name", "surname", "street_number", "address_1", "address_2", "suburb", "postcode", "state", "date_of_birth", "soc_sec_id"]


def read_febrl(spark: SparkSession, path: str) -> DataFrame:
    """A FEBRL CSV file; blanks around values go, columns are found by name."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")
    return raw.toDF(*(c.strip() for c in raw.columns))


def true_links(records: DataFrame, id_col: str = "rec_id", pattern: str = r"rec-(\d+)") -> DataFrame:
    """Pairs of ids whose number after ``rec-`` is the same, the larger id first."""
    keyed = records.select(F.col(id_col).alias("id"), F.regexp_extract(id_col, pattern, 1).alias("k")).filter("k <> ''")
    pairs = keyed.withColumnRenamed("id", f"{id_col}_1").join(keyed.withColumnRenamed("id", f"{id_col}_2"), "k")
    return pairs.filter(F.col(f"{id_col}_1") > F.col(f"{id_col}_2")).select(f"{id_col}_1", f"{id_col}_2")


def _load(spark: SparkSession, name: str, folder: str | None, return_links: bool):
    folder = folder or os.environ.get("RL_DATA") or os.path.join("~", "rl_data")
    df = read_febrl(spark, os.path.join(os.path.expanduser(folder), name))
    return (df, true_links(df)) if return_links else df


def load_febrl1(spark: SparkSession, folder: str | None = None, return_links: bool = False):
    """1000 records, one duplicate per original."""
    return _load(spark, "dataset1.csv", folder, return_links)


def load_febrl2(spark: SparkSession, folder: str | None = None, return_links: bool = False):
    """5000 records, the number of duplicates Poisson distributed."""
    return _load(spark, "dataset2.csv", folder, return_links)


def load_febrl3(spark: SparkSession, folder: str | None = None, return_links: bool = False):
    """5000 records, the number of duplicates Zipf distributed."""
    return _load(spark, "dataset3.csv", folder, return_links)


def links_febrl4(spark: SparkSession, n: int = 5000) -> DataFrame:
    """rec-i-org with rec-i-dup-0 for every i."""
    return spark.range(n).select(F.format_string("rec-%d-org", "id").alias("rec_id_1"), F.format_string("rec-%d-dup-0", "id").alias("rec_id_2"))


def load_febrl4(spark: SparkSession, folder: str | None = None, return_links: bool = False):
    """Originals and their duplicates as two tables of 5000."""
    a, b = _load(spark, "dataset4a.csv", folder, False), _load(spark, "dataset4b.csv", folder, False)
    return (a, b, links_febrl4(spark)) if return_links else (a, b)
