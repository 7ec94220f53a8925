"""Spelling variants of tokens: a symmetric-delete index and the spelling that a rare token stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.scratch import Scratch


def deletes(token: Column, twice: Column) -> Column:
    """Hashes of the token and of what is left of it after one (or two) deletions."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    first = F.array_distinct(one(token))
    second = F.when(twice, F.flatten(F.transform(first, one))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array_distinct(F.concat(F.array(token), first, second)), lambda v: F.xxhash64(v))


def near_tokens(tokens: DataFrame, min_len: int = 5, long_len: int = 9, max_len: int = 48) -> DataFrame:
    """(tok, df, other, odf, edits): distinct tokens within one edit, long ones within two, by the symmetric-delete index.

    A token of n characters has n (n + 1) / 2 entries; tokens over ``max_len`` characters are no words and stand for
    themselves.  Tokens with a ``df`` of 0 (tried, but never seen) only meet those that were seen, so of them only
    the lengths that can be near one are indexed.  Entries are shuffled once; few tokens meet in a hash, since they
    are one or two insertions away from one string.
    """
    spread = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of tokens become many entries: keep all tasks busy
    words = tokens.filter(F.length("tok").between(min_len, max_len))
    lengths = [r[0] for r in words.filter("df > 0").select(F.length("tok")).distinct().collect()]  # at most max_len
    able = sorted({n + k for n in lengths for k in range(-2, 3)})
    words = words.filter((F.col("df") > 0) | F.length("tok").isin(able)).repartition(spread, F.xxhash64("tok"))
    entries = words.select(F.struct("tok", "df").alias("a"), F.explode(deletes(F.col("tok"), F.length("tok") >= long_len)).alias("v")).repartition(spread, "v")
    shared = entries.join(entries.select("v", F.col("a").alias("b")).hint("merge"), "v")  # both sides read one exchange
    pairs = shared.filter("a.tok < b.tok and abs(length(a.tok) - length(b.tok)) <= 2 and (a.df > 0 or b.df > 0)").select("a", "b").distinct()
    a, b = F.col("a.tok"), F.col("b.tok")
    d = F.levenshtein(a, b, 2)
    swap = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    pairs = pairs.withColumn("d", d).filter("d >= 1").withColumn("edits", F.when((F.col("d") == 2) & swap, 1).otherwise(F.col("d")))
    side = lambda x, y: F.struct(F.col(f"{x}.tok").alias("tok"), F.col(f"{x}.df").alias("df"), F.col(f"{y}.tok").alias("other"), F.col(f"{y}.df").alias("odf"), "edits")
    return pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("n")).select("n.*")


def _adopted(near: DataFrame, fixed: set[str]) -> DataFrame:
    """(tok, up): the better spelling that a token adopts, of those near it."""
    better = (F.col("odf") > F.col("df")) | ((F.col("odf") == F.col("df")) & (F.col("other") < F.col("tok")))
    plausible = F.when(F.col("edits") == 1, (F.col("df") <= 2) | (F.col("odf") >= 3 * F.col("df"))).otherwise((F.length("tok") >= 9) & (F.col("odf") >= F.when(F.col("df") <= 2, 3).otherwise(10) * F.col("df")))
    near = near.filter(better & plausible)
    if fixed:
        near = near.filter(~F.col("tok").isin(sorted(fixed)))
    return near.groupBy("tok").agg(F.max(F.struct(-F.col("edits"), F.col("odf"), F.col("other"))).getField("other").alias("up"))


def respelt(tokens: DataFrame, fixed: set[str], scratch: Scratch) -> DataFrame:
    """(tok, canon): the tokens that stand for another spelling, as in :func:`spellings`; all others stand for themselves."""
    one = scratch.save(_adopted(near_tokens(tokens), fixed))
    moved = True
    while moved:
        above = one.select(F.col("tok").alias("up"), F.col("up").alias("top"))
        step = scratch.save(one.join(above.hint("merge"), "up", "left").select("tok", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        scratch.drop(one)
        one = step
        moved = not one.filter("moved").isEmpty()
    return one.select("tok", F.col("up").alias("canon"))


def spellings(tokens: DataFrame, fixed: set[str], scratch: Scratch, near: DataFrame | None = None) -> DataFrame:
    """(tok, canon, cdf): the spelling each token stands for and in how many names that occurs; ``near`` are the near tokens if known."""
    best = _adopted(near_tokens(tokens) if near is None else near, fixed)
    one = scratch.save(tokens.join(best.hint("merge"), "tok", "left").select("tok", "df", F.coalesce("up", "tok").alias("up")))
    # pointer doubling; a token only adopts a better one, so there are no circles and the last step moves none
    moved = True
    while moved:
        above = one.select(F.col("tok").alias("up"), F.col("up").alias("top"))
        step = scratch.save(one.join(above.hint("merge"), "up", "left").select("tok", "df", F.coalesce("top", "up").alias("up"), F.coalesce(F.col("top") != F.col("up"), F.lit(False)).alias("moved")))
        scratch.drop(one)
        one = step
        moved = not one.filter("moved").isEmpty()
    sums = one.groupBy("up").agg(F.sum("df").alias("cdf"))
    return one.join(sums.hint("merge"), "up").select("tok", F.col("up").alias("canon"), "cdf")
