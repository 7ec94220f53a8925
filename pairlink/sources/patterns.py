"""Comparison patterns of record pairs in CSV blocks, and the folder that data sets live in."""

from __future__ import annotations

import io
import os
import shutil
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a block, in this order in the files.
FEATURES = ["cmp_firstname1", "cmp_firstname2", "cmp_lastname1", "cmp_lastname2", "cmp_sex", "cmp_birthday", "cmp_birthmonth", "cmp_birthyear", "cmp_zipcode"]
SCHEMA = "id1 long, id2 long, " + ", ".join(f"{c} double" for c in FEATURES) + ", is_match boolean"


def get_data_home(folder: str | None = None) -> str:
    """The folder of data sets (given, RL_DATA, or ~/rl_data), made if it isn't there."""
    folder = os.path.expanduser(folder or os.environ.get("RL_DATA") or os.path.join("~", "rl_data"))
    os.makedirs(folder, exist_ok=True)
    return folder


def clear_data_home(folder: str | None = None) -> None:
    shutil.rmtree(get_data_home(folder))


def _unzipped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of zipped CSV blocks; every archive is unpacked in the task that reads it, a few lines at a time."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        with io.TextIOWrapper(archive.open(name), encoding="utf-8") as text:
                            next(text, None)  # the header
                            while part := [x.rstrip("\r\n") for x in islice(text, 10_000)]:
                                yield pd.DataFrame({"line": [x for x in part if x]})

    read = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(lines, "line string")
    return read.select(F.from_csv("line", SCHEMA, {"nullValue": "?"}).alias("r")).select("r.*")


def load_patterns(spark: SparkSession, folder: str | None = None, block: int | Sequence[int] | None = None, missing_values: float | dict | None = None, shuffle: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vectors, matches) of the blocks 1 to 10; ``?`` is null and may be filled, rows may be shuffled (seed 535)."""
    blocks = list(range(1, 11)) if block is None else [block] if isinstance(block, int) else list(block)
    if not all(1 <= b <= 10 for b in blocks):
        raise ValueError("blocks are numbered from 1 to 10")
    home = get_data_home(folder)
    plain, zipped = [], []
    for b in blocks:
        # a block counts once, in the first form that is there
        found = next((p for p in (os.path.join(home, "krebsregister", f"block_{b}{end}") for end in (".csv", ".csv.gz", ".zip")) if os.path.exists(p)), None)
        if found:
            (zipped if found.endswith(".zip") else plain).append(found)
    if not plain and not zipped:
        raise FileNotFoundError(f"no block files below {home}/krebsregister")
    parts = [spark.read.csv(plain, header=True, nullValue="?", schema=SCHEMA)] if plain else []
    parts += [_unzipped(spark, zipped)] if zipped else []
    rows = parts[0].union(parts[1]) if len(parts) == 2 else parts[0]
    if missing_values is not None:
        rows = rows.fillna(missing_values, subset=FEATURES) if not isinstance(missing_values, dict) else rows.fillna(missing_values)
    if shuffle:
        rows = rows.orderBy(F.rand(535))
    return rows.select("id1", "id2", *FEATURES), rows.filter("is_match").select("id1", "id2")
