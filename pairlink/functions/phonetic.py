"""Phonetic codes of names: soundex and match rating as expressions, NYSIIS and Metaphone as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

phonetic_algorithms = ["soundex", "nysiis", "metaphone", "match_rating"]
_ALIASES = {
    "soundex": "soundex", "nysiis": "nysiis", "nyssis": "nysiis", "metaphone": "metaphone", "match_rating": "match_rating", "matchrating": "match_rating", "match rating": "match_rating",
    "match_rating_codex": "match_rating", "matchratingcodex": "match_rating",
}


#: In a rule, the letter before the match stands for itself, or the match does.
_BEFORE, _SAME = object(), object()


class _Table:
    """Rules (pattern, code) read from left to right: at each place the first pattern that fits gives its code."""

    def __init__(self, *rules: tuple[str, object]):
        self.pattern = re.compile("|".join(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(rules)), re.DOTALL)
        self.codes = [c for _, c in rules]

    def code(self, m: re.Match) -> object:
        return self.codes[int(m.lastgroup[1:])]

    def codes_of(self, word: str, start: int = 0) -> Iterator[str]:
        for m in self.pattern.finditer(word, start):
            code = self.code(m)
            yield m[0] if code is _SAME else word[m.start() - 1] if code is _BEFORE else code


# The published rules of the New York State Identification and Intelligence System.
_NYSIIS_FIRST = _Table((r"^MAC", "MCC"), (r"^KN", "N"), (r"^K", "C"), (r"^P[HF]", "FF"), (r"^SCH", "SSS"))
_NYSIIS_LAST = _Table((r"(?:IE|EE)\Z", "Y"), (r"(?:[DRN]T|[RN]D)\Z", "D"))
_NYSIIS_INNER = _Table(
    (r"EV", "AF"), (r"[AEIOU]", "A"), (r"Q", "G"), (r"Z", "S"), (r"M|KN", "N"), (r"K", "C"), (r"SCH", "SS"), (r"PH", "F"),
    # h counts between vowels only; w behind a vowel does not
    (r"(?<=[AEIOU])H(?![AEIOU])", "A"), (r"(?<![AEIOU])H", _BEFORE), (r"(?<=[AEIOU])W", _BEFORE), (r".", _SAME),
)


def nysiis(name: str) -> str:
    """New York State Identification and Intelligence System code, not cut."""
    word = re.sub(r"\s+", "", name.upper())
    if not word:
        return ""
    for table in (_NYSIIS_FIRST, _NYSIIS_LAST):
        word = table.pattern.sub(table.code, word, count=1)
    key = word[0]
    for code in _NYSIIS_INNER.codes_of(word, 1):
        if code[-1] != key[-1]:
            key += code
    # what a key doesn't end in, unless it is all there is
    for end, rest in ((r"(?<=.)S\Z", ""), (r"AY\Z", "Y"), (r"(?<=.)A\Z", "")):
        key = re.sub(end, rest, key, flags=re.DOTALL)
    return key


# The published rules of Metaphone (0 is th).
_METAPHONE = _Table(
    (r"(?P<twin>[^c])(?=(?P=twin))", ""),  # doubled letters count once
    (r"(?:^|(?<= ))[aeiou]", _SAME), (r"[aeiou]", ""), (r"(?<=m)b(?= |\Z)", ""), (r"ci(?=a)|ch", "x"), (r"c[iey]", "s"), (r"c", "k"), (r"dg[iey]", "j"), (r"d", "t"),
    (r"g(?=[iey])", "j"), (r"gh(?=[^aeiou])|gn\Z", ""), (r"g", "k"), (r"(?<![aeiou])h|h(?=[aeiou])", "h"), (r"(?<!c)k", "k"), (r"ph", "f"), (r"p", "p"), (r"q", "k"),
    (r"sh|si[oa]", "x"), (r"t(?=i[oa])", "x"), (r"th", "0"), (r"t(?!ch)", "t"), (r"v", "f"), (r"^wh|w(?=[aeiou])", "w"), (r"^x", "s"), (r"x", "ks"), (r"y(?=[aeiou])", "y"), (r"z", "s"),
    (r"[bfjlmnrs ]", _SAME), (r".", ""),
)


def metaphone(name: str) -> str:
    """Metaphone code (0 for th), not cut."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    plain = re.sub(r"^(?:[kgp](?=n)|w(?=r)|a(?=e))", "", plain)  # a silent first letter
    return re.sub(" +", " ", "".join(_METAPHONE.codes_of(plain))).lstrip(" ").upper()


def _coded(code):
    def apply(s: pd.Series) -> pd.Series:
        codes = {v: code(v) for v in s.dropna().unique()}
        return s.map(codes)

    return F.pandas_udf(apply, StringType())


def phonetic(c: Column | str, method: str, concat: bool = True) -> Column:
    """The code of each value; blanks, hyphens and underscores are left out first unless ``concat`` is false.  Null stays null."""
    if method not in _ALIASES:
        raise ValueError(f"the phonetic algorithm {method!r} is not known")
    c = F.col(c) if isinstance(c, str) else c
    if concat:
        c = F.regexp_replace(c, r"[\-\_\s]", "")
    c = F.upper(c)
    name = _ALIASES[method]
    if name == "soundex":
        return F.soundex(c)
    if name == "match_rating":
        # vowels but the first letter go, doubled consonants become single, then the first and last three remain
        code = F.regexp_replace(F.regexp_replace(c, r"(?<!^)[AEIOU]", ""), r"([^AEIOU\s])\1+", "$1")
        return F.when(F.length(code) > 6, F.concat(F.substring(code, 1, 3), F.right(code, F.lit(3)))).otherwise(code)
    return _coded(nysiis if name == "nysiis" else metaphone)(c)
