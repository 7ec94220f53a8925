"""Text cut off by field limits or during transfer.

Two kinds of evidence, both from all documents:

* *Discrete length hazards*: h(L) is the share of a source's texts that stop without an end mark at length L
  among those of length L or more, in characters and in bytes.  Each h(L) is tested against the pooled hazard
  of the neighbouring lengths (window functions); a Chernoff bound on the binomial tail gives a conservative
  p-value and the Benjamini-Hochberg rule keeps the false-discovery rate per source.
* *Endings*: how often does the last pair of words (else the last word) close a sentence elsewhere in the
  corpus?  Words or pairs that occur inside texts but hardly ever close a sentence are unfinished, and a
  last word that occurs nowhere inside a text is a word cut in two.

At a significant length, a text is flagged when its ending is unfinished; where four stops of five are beyond
expectation and the source writes end marks, also when it merely has none: reason ``field limit``.  Cuts during transfer fall on any length, where no hazard can
show; there the unfinished ending alone decides: reason ``transfer``.  A full stop ends a sentence unless it
belongs to an abbreviation, behind which sentences hardly ever end.

Edge cases: null and blank texts are never flagged; trailing blanks and ellipses are not part of the
ending; null sources form a group of their own; repeated texts are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlink.scratch import Scratch

#: Marks that may close a sentence, and what may follow them within the sentence.
_END = r"""[.!?][\"'»”“’)\]]*"""
_LAST = tuple(""".!?"'»”“’)]""")
_ENTITIES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def _plain(text: Column) -> Column:
    plain = text
    for entity, char in _ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def _word(token: Column) -> Column:
    """Lower case, digits as one sign, without punctuation at either end."""
    core = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.regexp_replace(core, r"\p{N}+([.,]\p{N}+)*", "#")


def endings(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text, but with its length (``n_chars``, ``n_bytes``), a hash, and how it ends.

    ``prev`` and ``last`` are its last two words, ``marked`` says that it ends in an end mark, ``dotted`` in a
    full stop, ``closed`` in a numbered mark.  The text is turned round, so that no pattern walks through it.
    """
    # trailing blanks and ellipses aren't part of the ending
    backwards = F.regexp_replace(F.reverse(_plain(F.col(text))), r"^[\s…]+", "")
    found = docs.withColumn("__b", backwards).withColumn("__w", F.reverse(F.regexp_extract("__b", r"^\S*", 0)))
    found = found.withColumn("__p", F.reverse(F.regexp_extract("__b", r"^\S*\s+(\S+)", 1)))
    return found.select(
        *(c for c in docs.columns if c != text),
        F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("hash"),
        _word(F.col("__p")).alias("prev"), _word(F.col("__w")).alias("last"), F.col("__w").rlike(_END + "$").alias("marked"), F.col("__w").endswith(".").alias("dotted"),
        F.col("__w").rlike(r"\(\p{N}+\)[:;]?$").alias("closed"),
    )


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """(prev, word, n, ends, dots): word pairs inside texts, how often they close a sentence, and how often a full stop follows.

    The last word of a text is what is to be judged, so it isn't counted.  A sentence closes where an end
    mark is followed by a word with a capital letter.
    """
    tokens = docs.select(F.split(F.trim(_plain(F.col(text))), r"\s+").alias("t")).filter(F.size("t") > 1)
    triple = F.transform(
        F.sequence(F.lit(1), F.size("t") - 1),
        lambda i: F.struct(
            F.when(i > 1, F.get("t", i - 2)).otherwise(F.lit("")).alias("p"), F.get("t", i - 1).alias("w"), F.get("t", i).alias("x")
        ),
    )
    rows = tokens.select(F.explode(triple).alias("r")).select("r.p", "r.w", "r.x")
    dotted = F.right("w", F.lit(1)).isin(*_LAST) & F.col("w").rlike(_END + "$")
    closes = dotted & F.col("x").rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    # raw tokens repeat far more often than texts: fold them first, so that the patterns run once per distinct pair
    raw = rows.groupBy("p", "w", closes.alias("c")).agg(F.count("*").alias("n"))
    return raw.groupBy(_word(F.col("p")).alias("prev"), _word(F.col("w")).alias("word")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("c"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("dots")
    )


def field_limits(docs: DataFrame, text: str, source: str, neighbours: int = 12, fdr: float = 0.01, min_excess: float = 0.8) -> DataFrame:
    """(source, unit, length, n, at_risk, hazard, expected, p_value): lengths at which texts stop far too often.

    Only texts without an end mark stop, the others are at risk; copies of a text count once.  Besides being
    significant, the stops at a limit must be cuts for the most part: at least ``min_excess`` of them beyond
    the expected hazard.
    """
    judged = endings(docs.filter(F.length(F.trim(text)) > 0).select(F.col(source).alias("source"), F.col(text).alias("text")), "text")
    return _significant(judged, neighbours, fdr).filter(1 - F.col("expected") / F.col("hazard") >= min_excess)


def _significant(judged: DataFrame, neighbours: int = 12, fdr: float = 0.01) -> DataFrame:
    """All significant lengths, from what :func:`endings` found."""
    lengths = judged.select(
        "source", "hash", "marked",
        F.explode(F.array(F.struct(F.lit("char").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("byte").alias("unit"), F.col("n_bytes").alias("length")))).alias("l"),
    )
    n = lengths.select("source", "l.unit", "l.length", "hash", "marked").distinct().groupBy("source", "unit", "length").agg(F.count("*").alias("all"), F.sum(F.when(F.col("marked"), 0).otherwise(1)).alias("n"))
    by = Window.partitionBy("source", "unit")
    longer = by.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = by.orderBy("length").rangeBetween(-neighbours, neighbours)
    stats = n.withColumn("at_risk", F.sum("all").over(longer))
    # lengths without any text have the hazard 0 at the risk of the next longer one; risk changes little within the window
    own, risk = F.col("n"), F.col("at_risk")
    expected = (F.sum("n").over(near) - own + 0.5) / (F.lit(2 * neighbours) * F.avg("at_risk").over(near) + 1)
    stats = stats.withColumn("hazard", own / risk).withColumn("expected", F.least(expected, F.lit(0.999)))
    h, e = F.col("hazard"), F.col("expected")
    divergence = F.when(h > 0, h * F.log(h / e)).otherwise(0.0) + F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - e))).otherwise(0.0)
    stats = stats.withColumn("p_value", F.when(h > e, F.exp(-risk * divergence)).otherwise(1.0))
    tests = F.count("*").over(by)
    small = stats.withColumn("m", tests).filter(F.col("p_value") <= fdr).withColumn("k", F.row_number().over(by.orderBy("p_value", "length")))
    holds = F.max(F.when(F.col("p_value") <= F.col("k") * fdr / F.col("m"), F.col("k"))).over(by)
    return small.withColumn("last", holds).filter("k <= last").select("source", "unit", "length", "n", "at_risk", "hazard", "expected", "p_value")


def truncated(docs: DataFrame, key: str, text: str, source: str, closing_rate: float = 0.1, min_count: int = 3, min_excess: float = 0.8) -> DataFrame:
    """(key, source, reason) of the texts that stop before their end."""
    scratch = Scratch(docs.sparkSession, "truncation")
    src = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("text"))
    judged = scratch.save(endings(src.filter(F.length(F.trim("text")) > 0), "text"))
    pairs = scratch.save(pair_counts(src.filter("text is not null"), "text"))
    tails = judged.select("prev", F.col("last").alias("word")).distinct()
    words = pairs.groupBy("word").agg(F.sum("n").alias("wn"), F.sum("ends").alias("wends"), F.sum("dots").alias("wdots"))
    known = tails.join(pairs, ["prev", "word"], "left").join(words, "word", "left")
    pair_rate = F.when(F.col("n") >= min_count, F.col("ends") / F.col("n"))
    word_rate = F.when(F.col("wn") >= min_count, F.col("wends") / F.col("wn"))
    # how often a sentence ends where a full stop follows the word: hardly ever, if the stop belongs to an abbreviation
    stop_rate = F.coalesce(F.when(F.col("dots") >= min_count, F.col("ends") / F.col("dots")), F.when(F.col("wdots") >= min_count, F.col("wends") / F.col("wdots")), F.lit(1.0))
    known = known.select(F.col("prev").alias("p"), F.col("word").alias("w"), (F.coalesce(pair_rate, word_rate, F.lit(0.0)) < closing_rate).alias("open"), (stop_rate < closing_rate).alias("abbreviates"))
    mostly = (1 - F.col("expected") / F.col("hazard") >= min_excess).alias("mostly")
    at = _significant(judged).select(F.col("source").alias("s"), F.struct("unit", "length", mostly).alias("l")).groupBy("s").agg(F.collect_set("l").alias("limits"))
    marks = judged.groupBy(F.col("source").alias("s2")).agg(F.avg(F.col("marked").cast("double")).alias("mark_rate"))
    d = judged.join(known, (F.col("prev") == F.col("p")) & (F.col("last") == F.col("w")))
    d = d.join(marks, F.col("source").eqNullSafe(F.col("s2"))).join(at, F.col("source").eqNullSafe(F.col("s")), "left")

    def among(least: bool, less: int = 0) -> Column:
        """Is the length a significant one, and do mostly cuts stop there?"""
        size = lambda x: F.when(x["unit"] == "char", F.col("n_chars")).otherwise(F.col("n_bytes")) + less
        return F.coalesce(F.exists("limits", lambda x: (x["length"] == size(x)) & (x["mostly"] | F.lit(not least))), F.lit(False))

    unfinished = ~F.col("closed") & F.when(F.col("marked"), F.col("dotted") & F.col("abbreviates")).otherwise(F.col("open"))
    at_limit = among(True) & ~F.col("marked") & ~F.col("closed") & (F.col("mark_rate") >= 0.5)
    # a blank at the limit may have been trimmed
    reason = F.when(at_limit | ((among(False) | among(False, 1)) & unfinished), "field limit").when(unfinished, "transfer")
    return d.select(F.col("k").alias(key), F.col("source").alias(source), reason.alias("reason")).filter("reason is not null")


def truncation_rates(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, n_texts, n_truncated, n_at_limit, rate): how often each source cuts its texts."""
    cut = truncated(docs, key, text, source).groupBy(source).agg(F.count("*").alias("n_truncated"), F.sum(F.when(F.col("reason") == "field limit", 1).otherwise(0)).alias("n_at_limit"))
    cut = cut.withColumnRenamed(source, "__s")
    n = docs.groupBy(source).agg(F.count(text).alias("n_texts"))
    out = n.join(cut, F.col(source).eqNullSafe(F.col("__s")), "left")
    k = F.coalesce("n_truncated", F.lit(0))
    return out.select(source, "n_texts", k.alias("n_truncated"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), F.round(k / F.col("n_texts"), 6).alias("rate"))
