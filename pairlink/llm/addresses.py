"""Same postal address written differently: a set-containment join for missing parts.

1. All fields of an address are read together (content is not always in its own field): house number and
   letter, postcode, street type, and words.  Words take the spelling of their frequent neighbour (symmetric
   delete index) and belong to the place or to the street by where they mostly occur; a postcode stands for
   the place most of its addresses name.  Addresses that read alike are one *form* from here on.
2. Every form is indexed under the rarest word of its street (and under the street in one word), and each other
   form probes the index with all its words; the house number is part of every token, since it must agree.
   Words whose spellings stayed apart, and streets of several words, meet near ones too.
3. A candidate is verified: the words of the emptier street must be contained in the fuller one by weight,
   and no component may contradict (another street type, another place).
4. Forms that leave out the place or the street type are linked to what most of their matches say, and to
   nothing when their matches disagree.

Edge cases: an address without a house number or without a street links to nothing; a street named like a
place stays a street where no other word is left; a padded number of five or six digits in the number field is
a postcode where the address names none; null fields are missing
parts; repeated addresses are linked to each other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlink.llm.forms import expand
from pairlink.llm.spelling import near_tokens, spellings
from pairlink.scratch import Scratch

# Street types with their usual abbreviations, and words that qualify the name of a place.
TYPES = {
    "avenue": "ave av aven avn", "boulevard": "blvd bd boul bvd", "close": "cl", "court": "ct", "crescent": "cres cr crsnt cresc", "drive": "dr drv", "grove": "gr", "lane": "ln la lne",
    "place": "pl", "road": "rd roa", "square": "sq sqr", "street": "st str strt", "terrace": "tce terr ter trc", "way": "wy",
}
QUALIFIERS = {
    "north": "n nth", "south": "s sth", "east": "e", "west": "w", "upper": "upr up", "lower": "lwr low", "great": "gt gr grt", "little": "lt lit", "saint": "st snt", "port": "pt prt", "on": "o", "new": "nw",
}
_TYPE = {a: t for t, rest in TYPES.items() for a in [t, *rest.split()]}
_QUALIFIER = {a: q for q, rest in QUALIFIERS.items() for a in [q, *rest.split()]}
KNOWN = set(_TYPE) | set(_QUALIFIER)

_POSTCODE = re.compile(r"\bp-?\s*(\d{3,6})\b|\b(\d{5,6})\b")
_NUMBER = re.compile(r"(?:\b(?:no|nr)\b\.?\s*|#\s*)?\b0*(\d{1,4})\s*[-/]?\s*([a-z])?(?![a-z0-9])")
_LONG = re.compile(r"\s*(?:(?:no|nr)\b\.?|#)?\s*(\d{5,})\s*[-/]?\s*([a-z])?\s*")
_WORD = re.compile(r"[^\W\d_]+")


def _fold(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return text.lower().replace("'", "")
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("'", "").replace("’", "")


def read_address(street: str | None, number: str | None, postcode: str | None, place: str | None) -> tuple[str, str, list[str], list[str]]:
    """(house number with letter, postcode, words of the street field, words of the place field); '' where missing."""
    street, number, postcode, place = map(_fold, (street, number, postcode, place))
    code = ""
    digits = re.sub(r"\D", "", postcode)
    if digits:
        code = digits.lstrip("0") or "0"
    # a long number in its field is the house number, unless it is the postcode or looks like one that is missing
    long = _LONG.fullmatch(number)
    long_house = long[1].lstrip("0") + (long[2] or "") if long and long[1].strip("0") else ""
    padded = bool(long) and long[1][0] == "0" and len(long[1]) <= 6
    house = long_house if long_house and code and long[1].lstrip("0") != code else ""
    given = code
    fields = []
    for text in ("" if house else number, street, place):
        m = _POSTCODE.search(text)
        if m and (code == "" or (m[1] or m[2]).lstrip("0") == code or text is place):
            code = code or (m[1] or m[2]).lstrip("0") or "0"
            text = text[: m.start()] + " " + text[m.end() :]
        fields.append(text)
    for i, text in enumerate(fields):
        m = _NUMBER.search(text)
        if m:
            if not house:
                house = m[1] + (m[2] or "")
            fields[i] = text[: m.start()] + " , " + text[m.end() :]
    if not house and long_house and (given or not padded):
        house, code = long_house, given
        if not code:
            m = _POSTCODE.search(street) or _POSTCODE.search(place)
            code = (m[1] or m[2]).lstrip("0") or "0" if m else ""
    drop = {"no", "nr"}
    words = [[w for w in _WORD.findall(t) if w not in drop] for t in fields]
    return house, code, [w for w in words[0] + words[1]], words[2]


def _misspelt_type(word: str, n: int, types: dict[str, int]) -> str:
    """The street type that a far rarer word is a slip of: one edit or one swap of neighbours; '' if none."""
    for t in TYPES:
        if len(t) >= 4 and n * 20 <= types.get(t, 0) and (_close(word, t, 1) or sorted(word) == sorted(t) and _close(word, t, 2)):
            return t
    return ""


def _parts(cells: list, types: dict[str, int], keep: frozenset[int] = frozenset()) -> tuple[list[str], str, str, list[str]]:
    """(street words, street type, place, qualifiers) of the tokens of one address; ``cells`` have field, canon, ps, pp.

    ``types`` says how often each street type occurs.  Words of the street field at the positions ``keep`` are
    street words wherever they mostly occur.
    """
    street, kind, base, quals = [], "", "", []
    held: list[tuple[int, bool]] = []  # words of the street field that mostly occur in places, and whether a type came before
    cells = sorted(cells, key=lambda c: (c["field"], c["pos"]))
    seen = {c["canon"]: c["ps"] for c in cells}
    river = False
    for i, c in enumerate(cells):
        w = c["canon"]
        follows = cells[i + 1] if i + 1 < len(cells) and cells[i + 1]["field"] == c["field"] else None
        placed = c["pp"] > c["ps"]
        if c["field"] == 0:
            saint = w == "st" and follows is not None and follows["pp"] > follows["ps"] and follows["canon"] not in KNOWN
            if w in _TYPE and not saint:
                kind = kind or _TYPE[w]
                continue
            if w in _QUALIFIER and (saint or placed or len(w) <= 3):
                if _QUALIFIER[w] != "on":
                    quals.append(_QUALIFIER[w])
                continue
            if not placed or c["pos"] in keep:
                street.append(w)
                continue
            held.append((c["pos"], bool(kind)))
        elif w in _QUALIFIER:
            river = bool(base)  # "on" or its rest, before the name of a river
            if not river:
                quals.append(_QUALIFIER[w])
            continue
        if not base and not river and len(w) >= 3:
            base = w
        river = False
    if held and not street:
        # a street named like a place: what stands before the type is the street, else the first word
        n = max(sum(not after for _, after in held), 1) if kind else 1
        return _parts(cells, types, frozenset(p for p, _ in held[:n]))
    if not kind and len(street) > 1:
        # the last word first, since the type mostly stands behind
        slips = [(i, _misspelt_type(w, seen[w], types)) for i, w in reversed(list(enumerate(street)))]
        at, kind = next(((i, t) for i, t in slips if t), (-1, ""))
        if kind:
            del street[at]
    return street, kind, base, sorted(set(quals))


def _close(a: str, b: str, limit: int) -> bool:
    """Is the edit distance at most ``limit``?  Banded dynamic programming."""
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > limit:
            return False
        row = new
    return row[-1] <= limit


def _verify(a: tuple, b: tuple) -> int:
    """2: one location, 1: one location unless something says otherwise, 0: they contradict or share too little.

    A side is (street words, their weights, type, place, qualifiers, place by postcode, street in one word).
    """
    sa, wa, ta, pa, qa, da, x = a
    sb, wb, tb, pb, qb, db, y = b
    if ta and tb and ta != tb:
        return 0
    if pa and pb:
        if pa != pb and not (len(pa) > 6 and _close(pa, pb, 2)):
            return 0
        if qa and qb and not set(qa) & set(qb):
            return 0
        known = True
    else:
        at_a, at_b = pa or da, pb or db
        if at_a and at_b and at_a != at_b:
            return 0
        known = bool(at_a and at_b)
    weight = dict(zip(sa, wa)) | dict(zip(sb, wb))
    less, more = (sa, sb) if sum(wa) <= sum(wb) else (sb, sa)
    total = sum(weight[w] for w in less)
    held = sum(weight[w] for w in less if w in more)
    whole = sum(weight[w] for w in more)
    if not (total and held >= 0.8 * total and held >= 0.5 * whole):
        if not (x == y or min(len(x), len(y)) >= 8 and _close(x, y, 2 if known else 1)):
            return 0
    return 2 if known and bool(ta) == bool(tb) else 1


def address_forms(addresses: DataFrame, key: str, street: str, number: str, postcode: str, place: str) -> tuple[DataFrame, DataFrame]:
    """((key, form), (form_1, form_2)): the form of every record with a house number and a street, and the forms of one location."""
    scratch = Scratch(addresses.sparkSession, "addresses")
    src = addresses.select(*(F.col(c).alias(n) for n, c in zip(("e", "s", "n", "c", "p"), (key, street, number, postcode, place))))
    e_type = src.schema["e"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(e, *read_address(s, n, c, p)) for e, s, n, c, p in zip(pdf["e"], *(pdf[x].where(pdf[x].notna(), None) for x in "sncp"))]
            yield pd.DataFrame(rows, columns=["e", "house", "code", "sw", "pw"])

    raw = src.mapInPandas(read, f"e {e_type}, house string, code string, sw array<string>, pw array<string>").filter("house <> '' and size(sw) > 0")
    raw = raw.withColumn("r", F.concat_ws("|", F.concat_ws(" ", "sw"), F.concat_ws(" ", "pw")))
    raw = scratch.save(raw)
    # words and where they occur
    texts = raw.groupBy("r").agg(F.first("sw").alias("sw"), F.first("pw").alias("pw"), F.count("*").alias("n"))
    cells = scratch.save(
        texts.select("r", "n", F.explode(F.concat(
            F.transform("sw", lambda w, i: F.struct(F.lit(0).alias("field"), i.alias("pos"), w.alias("tok"))),
            F.transform("pw", lambda w, i: F.struct(F.lit(1).alias("field"), i.alias("pos"), w.alias("tok"))),
        )).alias("c")).select("r", "n", "c.*")
    )
    tokens = cells.groupBy("tok").agg(F.sum("n").alias("df"))
    near = scratch.save(near_tokens(tokens, long_len=8))
    spelt = scratch.save(spellings(tokens, KNOWN, scratch, near).select("tok", "canon"))
    cells = cells.join(spelt.hint("merge"), "tok")
    where = cells.groupBy("canon").agg(F.sum(F.when(F.col("field") == 0, F.col("n")).otherwise(0)).alias("ps"), F.sum(F.when(F.col("field") == 1, F.col("n")).otherwise(0)).alias("pp"))
    where = scratch.save(where)
    types: dict[str, int] = {}
    for row in where.filter(F.col("canon").isin(sorted(_TYPE))).select("canon", "ps").collect():  # at most the listed words
        types[_TYPE[row["canon"]]] = types.get(_TYPE[row["canon"]], 0) + row["ps"]
    cells = cells.join(where.hint("merge"), "canon").groupBy("r").agg(F.collect_list(F.struct("field", "pos", "canon", "ps", "pp")).alias("cells"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r, *_parts(list(c), types)) for r, c in zip(pdf["r"], pdf["cells"])], columns=["r", "street", "kind", "base", "quals"])

    parts = cells.mapInPandas(split, "r string, street array<string>, kind string, base string, quals array<string>")
    full = scratch.save(raw.select("e", "house", "code", "r").join(parts.hint("merge"), "r").filter("size(street) > 0"))
    # the place a postcode stands for
    by_code = full.filter("code <> '' and base <> ''").groupBy("code", "base").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code")
    by_code = by_code.withColumn("all", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("n").desc(), "base"))).filter("k = 1 and n >= 0.6 * all and n >= 2")
    full = full.join(by_code.select("code", F.col("base").alias("implied")).hint("merge"), "code", "left")
    form_of = F.concat_ws("|", "house", F.concat_ws(" ", "street"), "kind", "base", F.concat_ws(" ", "quals"), F.when(F.col("base") == "", F.coalesce("implied", F.lit(""))).otherwise(F.lit("")))
    full = scratch.save(full.withColumn("form", form_of).select("e", "form", "house", "street", "kind", "base", "quals", F.when(F.col("base") == "", F.col("implied")).alias("implied")))
    forms = full.groupBy("form").agg(*(F.first(c).alias(c) for c in ("house", "street", "kind", "base", "quals", "implied")), F.count("*").alias("n"))
    forms = scratch.save(forms.withColumn("implied", F.coalesce("implied", F.lit(""))))

    # weights: rarity of the street's words among all addresses
    total = forms.agg(F.sum("n")).first()[0] or 0
    words = forms.select("form", "n", F.explode("street").alias("w"))
    df = scratch.save(words.groupBy("w").agg(F.sum("n").alias("df")))
    weighed = words.join(df.hint("merge"), "w").groupBy("form").agg(F.collect_list(F.struct("w", F.log(1 + F.lit(float(total)) / F.col("df")).alias("x"))).alias("ws"))
    forms = scratch.save(forms.join(weighed.hint("merge"), "form"))

    # index under the rarest street word that any other address of the number has too, and under the street in one
    # word; probe with every word.  The place is no index token: a popular one would bring all its addresses together.
    whole = F.when(F.size("street") > 1, F.array(F.concat_ws("", "street"))).otherwise(F.array().cast("array<string>"))
    tokens = forms.select("form", "house", F.explode(F.array_distinct(F.concat(F.col("street"), whole))).alias("w"), F.when(F.size("street") > 1, F.concat_ws("", "street")).alias("one"))
    tokens = scratch.save(tokens)
    often = tokens.groupBy("house", "w").agg(F.count("*").alias("k"))
    shared = scratch.save(tokens.join(often.filter("k > 1").hint("merge"), ["house", "w"]))
    own = F.min(F.when(~F.col("w").eqNullSafe(F.col("one")), F.struct("k", "w"))).getField("w")
    index = shared.groupBy("form", "house").agg(F.array_compact(F.array(own, F.max(F.when(F.col("w") == F.col("one"), F.col("w"))))).alias("ws"))
    index = index.select(F.col("form").alias("fa"), "house", F.explode("ws").alias("w"))
    probe = shared.select("house", "w", F.col("form").alias("fb"))
    pairs = index.join(probe.hint("merge"), ["house", "w"]).filter("fa <> fb").select("fa", "fb")
    # words whose spellings stayed apart but are near, and streets of several words that are near in one word
    kept = spelt.filter("tok = canon").select("tok")
    apart = near.join(kept.hint("merge"), "tok", "left_semi").join(kept.withColumnRenamed("tok", "other").hint("merge"), "other", "left_semi").select("tok", "other")
    several = tokens.filter("w = one").groupBy("w").agg(F.count("*").alias("df")).join(kept.select(F.col("tok").alias("w")).hint("merge"), "w", "left_anti").withColumnRenamed("w", "tok")
    apart = apart.union(near_tokens(several, min_len=8, long_len=8).select("tok", "other"))
    word = tokens.select("form", "house", F.col("w").alias("tok"))
    close = word.withColumnRenamed("form", "fa").join(apart.hint("merge"), "tok")
    close = close.join(word.select(F.col("form").alias("fb"), "house", F.col("tok").alias("other")).hint("merge"), ["house", "other"]).select("fa", "fb")
    pairs = pairs.union(close).select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb")).distinct()
    forms = forms.withColumn("one", F.concat_ws("", "street"))
    for x in "ab":
        pairs = pairs.join(forms.select(F.col("form").alias(f"f{x}"), *(F.col(c).alias(c + x) for c in ("ws", "one", "kind", "base", "quals", "implied", "n"))).hint("merge"), f"f{x}")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            side = lambda x: zip(pdf["ws" + x], pdf["one" + x], pdf["kind" + x], pdf["base" + x], pdf["quals" + x], pdf["implied" + x])
            pack = lambda ws, one, k, b, q, i: ([u["w"] for u in ws], [u["x"] for u in ws], k, b, list(q), i, one)
            v = [_verify(pack(*a), pack(*b)) for a, b in zip(side("a"), side("b"))]
            out = pdf[["fa", "fb", "na", "nb", "kinda", "kindb"]].assign(pa=pdf["basea"].where(pdf["basea"] != "", pdf["implieda"]), pb=pdf["baseb"].where(pdf["baseb"] != "", pdf["impliedb"]), v=v)
            yield out[out["v"] > 0]

    judged = scratch.save(pairs.mapInPandas(judge, "fa string, fb string, na long, nb long, kinda string, kindb string, pa string, pb string, v int"))
    sure = judged.filter("v = 2").select("fa", "fb")
    # the forms that lack a part: what do their matches say about it?
    sides = judged.filter("v = 1").select(F.col("fa").alias("f"), F.col("fb").alias("o"), F.col("nb").alias("m"), F.col("kinda").alias("k"), F.col("pa").alias("p"), F.col("kindb").alias("ok"), F.col("pb").alias("op")).union(
        judged.filter("v = 1").select("fb", "fa", "na", "kindb", "pb", "kinda", "pa")
    )
    says = (F.col("k") == "") & (F.col("ok") != "") | (F.col("p") == "") & (F.col("op") != "")
    # several gaps are filled from one match, so the answer is the pair of type and place
    votes = sides.filter(says).withColumn("answer", F.concat_ws("|", F.when(F.col("k") == "", F.col("ok")).otherwise(F.col("k")), F.when(F.col("p") == "", F.col("op")).otherwise(F.col("p"))))
    by = Window.partitionBy("f")
    counted = votes.groupBy("f", "answer").agg(F.sum("m").alias("m")).withColumn("all", F.sum("m").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.col("m").desc(), "answer")))
    top = counted.filter("r = 1").select("f", F.when(F.col("m") >= 0.6 * F.col("all"), F.col("answer")).alias("top"))
    top = scratch.save(top)
    weak = judged.filter("v = 1")
    own = lambda k, p: F.concat_ws("|", F.col(k), F.col(p))
    for x in "ab":
        weak = weak.join(top.select(F.col("f").alias(f"f{x}"), F.col("top").alias(f"t{x}"), F.lit(True).alias(f"v{x}")).hint("merge"), f"f{x}", "left")
        weak = weak.withColumn(f"t{x}", F.when(F.col(f"v{x}").isNull(), own(f"kind{x}", f"p{x}")).otherwise(F.col(f"t{x}")))
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    fits = lambda i: (part("ta", i) == part("tb", i)) | (part("ta", i) == "") | (part("tb", i) == "")
    weak = weak.filter(F.col("ta").isNotNull() & F.col("tb").isNotNull() & fits(1) & fits(2)).select("fa", "fb")
    linked = sure.union(weak).distinct()

    return full.select(F.col("e").alias(key), "form").distinct(), linked.select(F.col("fa").alias("form_1"), F.col("fb").alias("form_2"))


def linked_addresses(addresses: DataFrame, key: str, street: str, number: str, postcode: str, place: str) -> DataFrame:
    """(``<key>_1``, ``<key>_2``), smaller key first: records that denote one location; :func:`address_forms` is linear in the records."""
    return expand(*address_forms(addresses, key, street, number, postcode, place), key)
