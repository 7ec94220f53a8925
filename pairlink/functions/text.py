"""String similarities as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairlink.functions import metrics
from pairlink.functions.clean import strip_accents

ALIASES = {
    "jaro": "jaro", "q_gram": "qgram", "qgram": "qgram", "cosine": "cosine", "jaro_winkler": "jarowinkler", "jarowinkler": "jarowinkler", "jw": "jarowinkler",
    "dameraulevenshtein": "damerau_levenshtein", "damerau_levenshtein": "damerau_levenshtein", "dl": "damerau_levenshtein", "levenshtein": "levenshtein", "lev": "levenshtein",
    "longest_common_substring": "lcs", "lcs": "lcs", "smith_waterman": "smith_waterman", "smithwaterman": "smith_waterman", "sw": "smith_waterman",
}
_KERNELS = {
    "jaro": metrics.jaro, "jarowinkler": metrics.jaro_winkler, "damerau_levenshtein": metrics.damerau_levenshtein_similarity, "smith_waterman": metrics.smith_waterman, "lcs": metrics.longest_common_substring,
}


def levenshtein(l: Column, r: Column) -> Column:
    """1 - edit distance / longer length; null for two empty strings."""
    return 1 - F.try_divide(F.levenshtein(l, r), F.greatest(F.length(l), F.length(r)))


def _bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters of each word with a blank at either end, lower case and without accents."""
    words = F.filter(F.split(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))))


def bag(c: Column) -> Column:
    """What a string brings to the comparison of its bigrams, in time linear in their number (but for sorting).

    ``total`` and ``norm`` of the counts, the distinct ``grams``, and those that occur several ``times``; most
    bigrams occur once, so that pairs mostly come down to one intersection.
    """
    def counted(sorted_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        starts = F.when(F.size(sorted_) > 0, starts).otherwise(F.array().cast("array<int>"))

        def with_counts(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.struct(F.get(sorted_, i).alias("g"), (F.coalesce(F.get(at, k + 1), F.size(sorted_)) - i).alias("n")))

        return _let(_let(starts, with_counts), lambda cells: F.struct(
            F.size(sorted_).alias("total"), F.sqrt(F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"].cast("bigint") * x["n"])).alias("norm"),
            F.transform(cells, lambda x: x["g"]).alias("grams"), F.map_from_entries(F.filter(cells, lambda x: x["n"] > 1)).alias("times"),
        ))

    return _let(F.array_sort(_bigrams(c)), counted)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times(bag_: Column, gram: Column) -> Column:
    return F.coalesce(F.try_element_at(bag_["times"], gram), F.lit(1)).cast("bigint")


def _total(bag_: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(bag_, F.lit(0).cast("bigint"), lambda acc, g: acc + value(g))


def qgram_bags(a: Column, b: Column) -> Column:
    """Shared bigrams / bigrams of the longer side; a null counts as an empty string, two empty ones give null."""
    both = F.array_intersect(F.map_keys(a["times"]), F.map_keys(b["times"]))
    shared = F.size(F.array_intersect(a["grams"], b["grams"])) + _total(both, lambda g: F.least(_times(a, g), _times(b, g)) - 1)
    return F.try_divide(shared, F.greatest(a["total"], b["total"]))


def cosine_bags(a: Column, b: Column) -> Column:
    """Cosine of the bigram counts; null where a side has none."""

    def more(common: Column) -> Column:
        return F.size(common) + F.when((F.size(a["times"]) > 0) | (F.size(b["times"]) > 0), _total(common, lambda g: _times(a, g) * _times(b, g) - 1)).otherwise(0)

    return F.try_divide(_let(F.array_intersect(a["grams"], b["grams"]), more), a["norm"] * b["norm"])


#: Similarities that read a bag of each side, which can be made once per record.
_OF_BAGS = {"qgram": qgram_bags, "cosine": cosine_bags}


def takes_bags(method: str) -> bool:
    return ALIASES.get(method) in _OF_BAGS


def similarity(l: Column, r: Column, method: str, threshold: float | None = None, bags: tuple[Column, Column] | None = None) -> Column:
    """The similarity of two strings by name; null where it isn't defined.

    Kernels in Python get nulls for what is decided without them: equal strings (their similarity is 1 by
    definition, except for empty strings and, for common substrings, a single character) and, under a
    threshold, edit distances that the lengths alone rule out.
    """
    if method not in ALIASES:
        raise ValueError(f"the algorithm {method!r} is not known")
    name = ALIASES[method]
    if name == "levenshtein":
        return levenshtein(l, r)
    if name in _OF_BAGS:
        value = _OF_BAGS[name](*(bags or (bag(l), bag(r))))
        return F.when((l == r) & l.rlike(r"\S"), 1.0).otherwise(value)
    decided = F.when((l == r) & (F.length(l) > 1), 1.0)
    if name == "damerau_levenshtein" and threshold is not None:
        longer = F.greatest(F.length(l), F.length(r))
        decided = decided.when(1 - F.try_divide(F.abs(F.length(l) - F.length(r)), longer) < threshold, 0.0)
    # an Arrow function runs before the expression around it, so only its arguments can spare it work
    open_ = lambda c: F.when(decided.isNull(), c)
    value = F.pandas_udf(metrics.vectorised(_KERNELS[name]), DoubleType())(open_(l), open_(r))
    return F.coalesce(decided, F.when(~F.isnan(value), value))
