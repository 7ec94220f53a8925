"""From linked forms to linked records.

Records that read alike are one *form*.  The linear result of an operator is the form of every record and the
links between different forms, each once; pairs of records follow from them by one expansion, whose size is
the number of pairs and so grows with the square of a popular form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(``<key>_1``, ``<key>_2``), smaller key first: all pairs of different records of a form or of two linked forms.

    ``members`` has (key, form), ``links`` has (form_1, form_2).
    """
    side = lambda f, x: members.select(F.col("form").alias(f), F.col(key).alias(x))
    across = links.join(side("form_1", "x").hint("merge"), "form_1").join(side("form_2", "y").hint("merge"), "form_2").select("x", "y")
    same = side("form", "x").join(side("form", "y").hint("merge"), "form").filter("x < y").select("x", "y")
    pairs = across.union(same).select(F.least("x", "y").alias(f"{key}_1"), F.greatest("x", "y").alias(f"{key}_2"))
    return pairs.filter(F.col(f"{key}_1") != F.col(f"{key}_2")).distinct()
