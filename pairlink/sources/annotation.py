"""Annotation files: pairs of records for a person to judge, as one JSON document."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlink.records import RecordSet, pair_columns, sides

VERSION = 1


class Annotation(NamedTuple):
    """Judged pairs: matches, non-matches and pairs without a verdict; None where there are none."""

    links: DataFrame | None
    distinct: DataFrame | None
    unknown: DataFrame | None


def annotation_frame(pairs: DataFrame, df_a: RecordSet | DataFrame, df_b: RecordSet | DataFrame | None = None, dataset_a_name: str | None = None, dataset_b_name: str | None = None) -> DataFrame:
    """One row per pair with the document's entry as a struct ``pair``; the fields are the columns of the first table."""
    a, b = sides(df_a, df_b)
    names = dataset_a_name, dataset_a_name if b is None else dataset_b_name
    b = b or a
    one, two = pair_columns(pairs)
    fields = [c for c in a.df.columns if c != a.id_col]
    left, right = a.columns(fields, "l"), b.columns(fields, "r")
    joined = pairs.select(F.col(one).alias("__1"), F.col(two).alias("__2")).join(left, F.col("__1") == F.col("lid")).join(right, F.col("__2") == F.col("rid"))
    side = lambda c, i, p: F.struct(F.lit(c).alias("name"), F.col(f"{p}{i}").cast("string").alias("value"), F.lit("String").alias("type"))
    entries = [F.struct(side(c, i, "l").alias("a"), side(c, i, "r").alias("b"), F.lit(None).cast("double").alias("similarity")) for i, c in enumerate(fields)]
    who = lambda n, c: F.struct(F.lit(n).cast("string").alias("dataset"), F.col(c).cast("string").alias("record"))
    return joined.select(F.struct(F.array(*entries).alias("fields"), F.struct(who(names[0], "__1").alias("a"), who(names[1], "__2").alias("b")).alias("identifiers")).alias("pair"))


def write_annotation_file(fp: str, pairs: DataFrame, df_a, df_b=None, dataset_a_name: str | None = None, dataset_b_name: str | None = None, max_pairs: int = 100_000) -> None:
    """Write the document for at most ``max_pairs`` pairs; people judge no more, and a larger set is refused."""
    rows = annotation_frame(pairs, df_a, df_b, dataset_a_name, dataset_b_name).select(F.to_json("pair", {"ignoreNullFields": "false"})).limit(max_pairs + 1).collect()
    if len(rows) > max_pairs:
        raise ValueError(f"more than {max_pairs} pairs to annotate")
    with open(fp, "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "pairs": [json.loads(r[0]) for r in rows]}, f, indent=2)


def read_annotation_file(spark: SparkSession, fp: str) -> Annotation:
    """The pairs of an annotated document by verdict."""
    schema = "version int, pairs array<struct<identifiers: struct<a: struct<dataset: string, record: string>, b: struct<dataset: string, record: string>>, label: int>>"
    rows = spark.read.schema(schema).json(fp, multiLine=True).select(F.explode("pairs").alias("p")).select(F.col("p.identifiers.a.record").alias("id_1"), F.col("p.identifiers.b.record").alias("id_2"), F.col("p.label").alias("label"))

    def part(condition: str) -> DataFrame | None:
        found = rows.filter(condition).select("id_1", "id_2")
        return None if found.isEmpty() else found

    return Annotation(part("label = 1"), part("label = 0"), part("label is null or label not in (0, 1)"))
