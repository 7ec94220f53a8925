"""Variant spellings of the names of persons and organisations.

1. Names are split into tokens; equal names are one *form* from here on.
2. A symmetric-delete index over the distinct tokens finds those within one edit (an adjacent swap counts as
   one), for long tokens within two; a rare token takes the spelling of its frequent neighbour.  Split words
   ("kitpu givous") are mended when the joined word is known.
3. Every word of a form but listed given names, titles and legal forms is an identifying token, and so is
   what its surname field says; forms are compared when they share an identifying token, or have near ones,
   and a reading (nickname, abbreviation, initial) of another one.  A form's own word (the surname, else the
   rarest word) may stay unexplained only where a surname field confirms the shared token.
4. The other tokens are aligned by optimal assignment, permitting nicknames, abbreviations and initials.  Two
   forms are linked unless both keep a content word or an initial that nothing explains.
5. A form that gives only an initial is linked to the one name that its group offers for it; when several
   relatives fit, only if one of them holds most of the entries.

The common words (in at least ``common_share`` of the names, so at most tokens-per-name / common_share many)
go to the driver; everything else stays distributed.  Hot identifying tokens are split by the second key.

Edge cases: null and empty names link to nothing, nor does a single initial; the surname may be null or hold
something else; equal names are always linked; where all words are short or listed given names, any of them
identifies the form; ids are compared as numbers or text as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlink.llm.forms import expand
from pairlink.llm.spelling import near_tokens, spellings
from pairlink.scratch import Scratch

# Forms of address and legal forms; they neither identify nor contradict.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "doctor", "capt", "captain", "rev", "sir", "dame", "hon", "jr", "sr"}
LEGAL = {
    "the", "and", "of", "limited", "ltd", "company", "co", "comp", "cos", "incorporated", "inc", "corporation", "corp", "cooperative", "coop", "association", "assn", "assoc", "ass",
    "brothers", "bros", "brs", "bro", "sons", "son", "plc", "llc", "lp", "partners", "group", "holdings",
}

_SPACE = re.compile(r"[\s  -​ 　]+")
_JOIN = re.compile(r"(?<=\w)[-'’`´](?=\w)")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|\.(?=[^\W_]))*\.?")
_DOTTED = re.compile(r"^(?:[^\W\d_]\.)+[^\W\d_]?\.?$")


def split_name(name: str | None) -> tuple[list[str], list[str]]:
    """(words, initials) of a name, in lower case and in order."""
    if not name:
        return [], []
    name = _SPACE.sub(" ", name)
    mixed = name != name.upper()
    words, initials = [], []
    for token in _TOKEN.findall(_JOIN.sub("", name)):
        letters = token.replace(".", "")
        low = letters.lower()
        if len(letters) == 1 and not letters.isdigit() and letters.lower() != letters.upper():
            initials.append(low)
        elif _DOTTED.match(token) or (len(letters) == 2 and mixed and letters.isupper() and low not in TITLES | LEGAL):
            initials.extend(low)
        else:
            words.append(low)
    return words, initials


def abbreviates(short: str, word: str) -> bool:
    """Is ``short`` a prefix or a contraction of the longer ``word``?"""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0] or len(short) > 7:
        return False
    if word.startswith(short):
        return len(short) >= 3
    if len(short) == 2 and short[-1] != word[-1]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def same_stem(a: str, b: str) -> bool:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n >= max(4, 0.6 * max(len(a), len(b)))


class Readings:
    """What a word may stand for: the small model that the driver ships to the tasks."""

    def __init__(self, common: dict[str, int], nicknames: list[tuple[str, str]], learned: dict[str, str]):
        self.given: dict[str, set[str]] = {}
        for full, nick in nicknames:
            self.given.setdefault(nick, set()).add(full)
            self.given.setdefault(full, set()).add(full)
        for word, full in learned.items():
            self.given.setdefault(word, set()).update(self.given.get(full, {full}))
        self.common = {w: n for w, n in common.items() if w not in TITLES | LEGAL}
        self.long = sorted((w for w in self.common if len(w) >= 5), key=lambda w: (-self.common[w], w))
        self.memo: dict[str, frozenset[str]] = {}

    def of(self, word: str) -> frozenset[str]:
        if word not in self.memo:
            if word in LEGAL:
                found = {word[:2]}
            elif word in self.given:
                found = self.given[word]
            else:
                mine = self.common.get(word, 0)
                found = {w for w in self.long if abbreviates(word, w) and self.common[w] > mine}
                if not found and len(word) >= 5:
                    found = {w for w in self.long if w != word and w not in self.given and same_stem(word, w) and (self.common[w], w) > (mine, word)}
                found = {x for w in found for x in self.given.get(w, {w})} | {word}
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = frozenset(found)
        return self.memo[word]


def _match(a: tuple[str, frozenset[str]], b: tuple[str, frozenset[str]]) -> float:
    """Gain of aligning two units (an initial is a unit of one letter); 0: they don't fit."""
    if a[0] == b[0]:
        return 1.0 if len(a[0]) > 1 else 0.5
    if len(a[0]) == 1 or len(b[0]) == 1:
        one, other = (a, b) if len(a[0]) == 1 else (b, a)
        return 0.4 if len(other[0]) > 1 and any(w[0] == one[0] for w in other[1] | {other[0]}) else 0.0
    return 0.9 if (a[0] in LEGAL) == (b[0] in LEGAL) and a[1] & b[1] else 0.0


def _assign(gains: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of the greatest total gain (no more rows than columns), in cubic time."""
    n, m = len(gains), len(gains[0])
    row_price, col_price, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            done[j], r, step, nxt = True, row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    cost = -gains[r - 1][k - 1] - row_price[r] - col_price[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(m + 1):
                if done[k]:
                    row_price[row_of[k]] += step
                    col_price[k] -= step
                else:
                    least[k] -= step
            j = nxt
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def align(a: list[tuple[str, frozenset[str]]], b: list[tuple[str, frozenset[str]]]) -> tuple[float, list[tuple[int, int]]]:
    """Optimal assignment of units by total gain: by recursion for short lists, else by shortest augmenting paths."""
    if len(a) > len(b):
        gain, pairs = align(b, a)
        return gain, [(j, i) for i, j in pairs]
    gains = [[_match(x, y) for y in b] for x in a]
    if (len(b) + 1) ** len(a) > 5000:
        pairs = [(i, j) for i, j in enumerate(_assign(gains)) if gains[i][j]]
        return sum(gains[i][j] for i, j in pairs), pairs

    def best(i: int, used: int) -> tuple[float, tuple]:
        if i == len(a):
            return 0.0, ()
        top = best(i + 1, used)
        for j, g in enumerate(gains[i]):
            if g and not used >> j & 1:
                rest = best(i + 1, used | 1 << j)
                if rest[0] + g > top[0]:
                    top = (rest[0] + g, ((i, j), *rest[1]))
        return top

    gain, pairs = best(0, 0)
    return gain, list(pairs)


def _verdict(r: Readings, wa: list[str], ia: list[str], wb: list[str], ib: list[str], own: tuple[str, ...] = ()) -> int:
    """2: the names agree, 1: they agree by initials only, 0: they differ or say too little.

    ``own`` are words that tell a name from others that share the rest, so nothing agrees without them.
    """
    ua = [(w, r.of(w)) for w in wa if w not in TITLES] + [(c, frozenset()) for c in ia]
    ub = [(w, r.of(w)) for w in wb if w not in TITLES] + [(c, frozenset()) for c in ib]
    if sorted(u[0] for u in ua) == sorted(u[0] for u in ub) and (wa or not ua):
        return 2
    _, pairs = align(ua, ub)
    content = lambda u: len(u[0]) > 1 and u[0] not in LEGAL
    left_a = [u for i, u in enumerate(ua) if i not in {p for p, _ in pairs}]
    left_b = [u for j, u in enumerate(ub) if j not in {q for _, q in pairs}]
    if any(map(content, left_a)) and any(map(content, left_b)):
        return 0
    if any(u[0] in own for u in left_a + left_b):
        return 0
    letters = lambda left: [u for u in left if len(u[0]) == 1]
    if letters(left_a) and letters(left_b):
        return 0
    # an initial can't stand beside an unexplained word of the other side
    if (letters(left_a) and any(map(content, left_b))) or (letters(left_b) and any(map(content, left_a))):
        return 0
    strong = any(len(ua[i][0]) > 1 and len(ub[j][0]) > 1 and content(ua[i]) and content(ub[j]) for i, j in pairs)
    if strong:
        return 2
    return 1 if any(len(ua[i][0]) == 1 or len(ub[j][0]) == 1 for i, j in pairs) else 0


def few(rows: DataFrame, most: int, what: str) -> list:
    """The rows, for the driver's model; more than ``most`` are refused, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} {what}")
    return got


def nickname_pairs(nicknames: DataFrame | None, given: str, nickname: str, most: int = 100_000) -> list[tuple[str, str]]:
    """The list of nicknames in lower case; a list of more than ``most`` rows is refused."""
    if nicknames is None:
        return []
    return [(a.lower(), b.lower()) for a, b in few(nicknames.select(given, nickname).dropna(), most, "nicknames")]


def name_forms(
    entries: DataFrame, key: str, name: str, surname: str, nicknames: DataFrame | None = None, given: str = "given_name", nickname: str = "nickname", common_share: float = 0.001
) -> tuple[DataFrame, DataFrame]:
    """((key, form), (form_1, form_2)): the form of every entry that holds a name, and the forms that name the same one."""
    spark = entries.sparkSession
    scratch = Scratch(spark, "names")
    src = entries.select(F.col(key).alias("e"), F.col(name).alias("name"), F.col(surname).alias("sur"))
    nicks = nickname_pairs(nicknames, given, nickname)
    lexicon = {x for pair in nicks for x in pair}
    listed = lexicon | TITLES | LEGAL

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e, n, s in zip(pdf["e"], pdf["name"], pdf["sur"]):
                words, initials = split_name(n)
                sw, si = split_name(s)
                # a word split in two may be one elsewhere; listed words are no halves of another one
                whole = [a + b if a not in listed and b not in listed else "" for a, b in zip(words, words[1:])]
                rows.append((e, words, whole, initials, "".join(sw) if not si else ""))
            yield pd.DataFrame(rows, columns=["e", "words", "whole", "initials", "sur"])

    e_type = src.schema["e"].dataType.simpleString()
    parsed = src.mapInPandas(parse, f"e {e_type}, words array<string>, whole array<string>, initials array<string>, sur string")
    form = F.concat_ws("|", F.concat_ws(" ", "words"), F.concat_ws(" ", "initials"), "sur")
    parsed = scratch.save(parsed.filter("size(words) > 0 or size(initials) > 1").withColumn("form", form))
    forms = scratch.save(parsed.groupBy("form").agg(F.first("words").alias("words"), F.first("whole").alias("whole"), F.first("initials").alias("initials"), F.first("sur").alias("sur"), F.count("*").alias("n")))

    # spellings of all tokens, of surname fields, and of neighbouring words joined
    cells = forms.select(
        "form", "n",
        F.explode(F.concat(
            F.transform("words", lambda w, i: F.struct(F.lit("w").alias("kind"), i.alias("pos"), w.alias("tok"))),
            F.filter(F.transform("whole", lambda w, i: F.struct(F.lit("j").alias("kind"), i.alias("pos"), w.alias("tok"))), lambda x: x["tok"] != ""),
            F.when(F.col("sur") != "", F.array(F.struct(F.lit("s").alias("kind"), F.lit(0).alias("pos"), F.col("sur").alias("tok")))).otherwise(F.array().cast("array<struct<kind:string,pos:int,tok:string>>")),
        )).alias("c"),
    ).select("form", "n", "c.*")
    plain = F.col("kind") != "j"
    tokens = scratch.save(cells.groupBy("tok").agg(F.sum(F.when(plain, F.col("n")).otherwise(0)).alias("df")))
    able = tokens.filter((F.length("tok") >= 2) | F.col("tok").rlike(r"^\p{Lo}$"))
    near = scratch.save(near_tokens(able))
    spelt = scratch.save(spellings(able, lexicon, scratch, near))
    cells = cells.join(spelt.hint("merge"), "tok")
    own = tokens.select("tok", F.col("df").alias("own"))
    cells = cells.join(own.hint("merge"), "tok").filter(plain | (F.col("cdf") > 0))
    shaped = scratch.save(cells.groupBy("form").agg(F.first("n").alias("n"), F.collect_list(F.struct("kind", "pos", "tok", "canon", "cdf", "own")).alias("cells")))

    total = forms.agg(F.sum("n")).first()[0] or 0
    floor = max(5, int(common_share * total))
    common = {r["canon"]: r["cdf"] for r in few(spelt.filter(F.col("cdf") >= floor).select("canon", "cdf").distinct(), 200_000, "common words")}

    plain_model = spark.sparkContext.broadcast(Readings(common, nicks, {}))

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skip, r = lexicon | TITLES | LEGAL, plain_model.value
        for pdf in batches:
            rows = []
            for f, n, cs in zip(pdf["form"], pdf["n"], pdf["cells"]):
                initials = f.split("|")[1].split()
                words = {c["pos"]: (c["canon"], c["cdf"], c["tok"]) for c in cs if c["kind"] == "w"}
                surs = [(c["canon"], c["tok"]) for c in cs if c["kind"] == "s"]
                ids = []
                for c in sorted((c for c in cs if c["kind"] == "j"), key=lambda c: c["pos"]):
                    # two words that are one elsewhere: known as one word, and the parts are rarer than the whole
                    parts = [words.get(c["pos"]), words.get(c["pos"] + 1)]
                    if None not in parts and len(c["canon"]) >= 6 and min(p[1] for p in parts) <= c["cdf"] and not {p[0] for p in parts} & skip:
                        words[c["pos"]] = (c["canon"], c["cdf"], c["tok"])
                        del words[c["pos"] + 1]
                at = None
                if surs and surs[0][0] not in skip and len(surs[0][0]) > 2:
                    ids.append(surs[0])
                    at = next((p for p, w in words.items() if w[0] == surs[0][0]), None)
                if at is None:
                    able = [(w[1], p) for p, w in words.items() if w[0] not in skip and len(w[0]) >= 4]
                    able = [(n, p) for n, p in able if r.of(words[p][0]) == {words[p][0]}] or able
                    if able:
                        at = min(able)[1]
                        ids.append((words[at][0], words[at][2]))
                elif words[at][2] != surs[0][1]:
                    ids.append((words[at][0], words[at][2]))
                without = {p: [w[0] for q, w in sorted(words.items()) if q != p] for p in [*words, None]}
                sure = surs[0][0] if surs else None
                first = [{"id": i, "tok": t, "rest": without[at], "sure": i == sure} for i, t in dict.fromkeys(ids)]
                # which word is the surname or the firm's own is a guess, so the others identify as well
                more = [{"id": w[0], "tok": w[2], "rest": without[p], "sure": False} for p, w in sorted(words.items()) if p != at and w[0] not in skip and len(w[0]) >= 4]
                if sure and sure not in TITLES | LEGAL and not any(x["id"] == sure for x in first):
                    more.append({"id": sure, "tok": surs[0][1], "rest": without[next((p for p, w in words.items() if w[0] == sure), at)], "sure": True})
                if not first or all(w[0] in skip or len(w[0]) < 4 for w in words.values()):
                    # short or listed words only: any word identifies, titles and legal forms where there is no other
                    for p, w in sorted(words.items()):
                        if p != at and (w[0] not in TITLES | LEGAL or not words.keys() - {q for q, v in words.items() if v[0] in TITLES | LEGAL}):
                            more.append({"id": w[0], "tok": w[2], "rest": without[p], "sure": w[0] == sure})
                # the word that another form must not leave out; beside a listed given name the rarest may be a given name too
                told = at is not None and words[at][0] == sure
                own = words[at][0] if at is not None and (told or not any(w[0] in lexicon for w in words.values())) else ""
                rows.append((f, n, first + more, [x["id"] for x in first], without[at], own, initials))
            yield pd.DataFrame(rows, columns=["form", "n", "ids", "first", "rest", "own", "initials"])

    id_type = "struct<id:string,tok:string,rest:array<string>,sure:boolean>"
    who = scratch.save(shaped.mapInPandas(identify, f"form string, n long, ids array<{id_type}>, first array<string>, rest array<string>, own string, initials array<string>"))

    # nicknames that no list has: common words that keep company with one given name in the same groups
    seen = who.select(F.explode("first").alias("id"), "rest").select("id", F.explode("rest").alias("w"))
    learned: dict[str, str] = {}
    if nicks:
        seen = scratch.save(seen.distinct())
        often = seen.groupBy("w").agg(F.count("*").alias("k")).filter(F.col("k") >= max(3, int(0.1 * common_share * total)))
        fulls = F.broadcast(spark.createDataFrame([(g,) for g in sorted({a for a, _ in nicks})], "full string"))
        left = seen.join(often.hint("merge"), "w").filter(~F.col("w").isin(sorted(lexicon | TITLES | LEGAL)))
        both = left.join(seen.select("id", F.col("w").alias("full")).join(fulls, "full").hint("merge"), "id").groupBy("w", "k", "full").agg(F.count("*").alias("kk"))
        best = both.filter("kk >= 3 and kk >= 0.3 * k").groupBy("w").agg(F.max(F.struct("kk", "full")).alias("b"))
        learned = {r["w"]: r["full"] for r in few(best.select("w", "b.full"), 200_000, "learned nicknames")}
    model = spark.sparkContext.broadcast(Readings(common, nicks, learned))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = model.value
        for pdf in batches:
            rows = []
            for f, ids, initials in zip(pdf["form"], pdf["ids"], pdf["initials"]):
                for i in ids:
                    words = [w for w in i["rest"] if w not in TITLES | LEGAL]
                    reads = sorted({x for w in words for x in r.of(w)})
                    letters = sorted({x[0] for x in reads})
                    rows += [(f, i["id"], i["tok"], "=" + x, False) for x in reads]
                    rows += [(f, i["id"], i["tok"], "^" + x, False) for x in letters]
                    if not words:
                        rows += [(f, i["id"], i["tok"], "^" + x, True) for x in sorted(set(initials)) or [""]]
            yield pd.DataFrame(rows, columns=["form", "id", "tok", "second", "vague"])

    index = scratch.save(who.mapInPandas(keys, "form string, id string, tok string, second string, vague boolean"))
    # words meet words under a reading; a form with initials only meets all forms under its letter
    a = index.select("id", "second", F.col("form").alias("fa"), F.col("vague").alias("va"))
    b = index.select("id", "second", F.col("form").alias("fb"), F.col("vague").alias("vb"))
    same_id = (F.col("id").alias("ida"), F.col("id").alias("idb"))
    words = a.filter("second like '=%'").join(b.hint("merge"), ["id", "second"]).filter("fa < fb").select("fa", "fb", *same_id)
    vague = a.filter("va").join(b.hint("merge"), ["id", "second"]).filter("fa <> fb").select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"), *same_id)
    # so do forms whose identifying tokens are near but keep different spellings
    a = index.select("tok", "second", F.col("id").alias("ida"), F.col("form").alias("fa"), F.col("vague").alias("va"))
    b = index.select(F.col("tok").alias("other"), "second", F.col("id").alias("idb"), F.col("form").alias("fb"), F.col("vague").alias("vb"))
    apart = near.select("tok", "other").join(spelt.select("tok", F.col("canon").alias("c1")).hint("merge"), "tok").join(spelt.select(F.col("tok").alias("other"), F.col("canon").alias("c2")).hint("merge"), "other").filter("c1 <> c2")
    close = a.join(apart.select("tok", "other").hint("merge"), "tok").join(b.hint("merge"), ["other", "second"])
    close = close.filter("ida <> idb and fa < fb and (second like '=%' or va or vb)").select("fa", "fb", "ida", "idb")
    pairs = words.union(vague).union(close).distinct()
    side = who.select("form", "initials", "n", "own", F.explode("ids").alias("x")).select("form", "initials", "n", "own", "x.id", "x.rest", "x.sure").dropDuplicates(["form", "id"])
    cols = {"form": "f", "id": "id", "rest": "w", "initials": "i", "n": "n", "own": "o", "sure": "s"}
    for x in "ab":
        pairs = pairs.join(side.select(*(F.col(c).alias(k + x) for c, k in cols.items())).hint("merge"), [f"f{x}", f"id{x}"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = model.value
        says = lambda ws: any(w not in TITLES | LEGAL for w in ws)
        for pdf in batches:
            known = pdf["sa"] | pdf["sb"]  # a surname field says that the shared word is the surname
            owns = [() if k else (oa, ob) for k, oa, ob in zip(known, pdf["oa"], pdf["ob"])]
            out = [_verdict(r, list(wa), list(ia), list(wb), list(ib), own) for wa, ia, wb, ib, own in zip(pdf["wa"], pdf["ia"], pdf["wb"], pdf["ib"], owns)]
            res = pdf[["fa", "fb", "na", "nb"]].assign(v=out, ta=[says(w) for w in pdf["wa"]], tb=[says(w) for w in pdf["wb"]])
            yield res[res["v"] > 0]

    judged = pairs.mapInPandas(judge, "fa string, fb string, na long, nb long, v int, ta boolean, tb boolean")
    judged = scratch.save(judged.groupBy("fa", "fb", "na", "nb").agg(F.max(F.struct("v", "ta", "tb")).alias("x")).select("fa", "fb", "na", "nb", "x.*"))
    strong = judged.filter("v = 2").select("fa", "fb")
    # what an initial may stand for in its group, by the entries that say so; forms that agree are one name
    first = strong.union(strong.select("fb", "fa")).groupBy(F.col("fa").alias("o")).agg(F.min("fb").alias("g"))
    weak = judged.filter("v = 1 and ta <> tb")
    sides = weak.select(F.when(F.col("ta"), F.col("fb")).otherwise(F.col("fa")).alias("f"), F.when(F.col("ta"), F.col("fa")).otherwise(F.col("fb")).alias("o"), F.when(F.col("ta"), F.col("na")).otherwise(F.col("nb")).alias("m"))
    sides = scratch.save(sides.join(first.hint("merge"), "o", "left").withColumn("g", F.coalesce(F.least("g", "o"), F.col("o"))))
    by = Window.partitionBy("f")
    vote = sides.groupBy("f", "g").agg(F.sum("m").alias("m"))
    vote = vote.withColumn("all", F.sum("m").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.col("m").desc(), "g"))).filter("r = 1")
    vote = scratch.save(vote.select("f", F.when(F.col("m") >= 0.6 * F.col("all"), F.col("g")).alias("g")))
    fits = sides.join(vote.filter("g is not null").hint("merge"), ["f", "g"]).select(F.least("f", "o").alias("fa"), F.greatest("f", "o").alias("fb"))
    # two forms with initials only agree when they stand for the same name, or when their group offers none
    bare = judged.filter("v = 1 and not ta and not tb").select("fa", "fb")
    for x in "ab":
        bare = bare.join(vote.select(F.col("f").alias(f"f{x}"), F.col("g").alias(f"g{x}"), F.lit(True).alias(f"o{x}")).hint("merge"), f"f{x}", "left")
    bare = bare.filter("ga = gb or (oa is null and ob is null)").select("fa", "fb")
    linked = strong.union(fits).union(bare).distinct()

    return parsed.select(F.col("e").alias(key), "form").distinct(), linked.select(F.col("fa").alias("form_1"), F.col("fb").alias("form_2"))


def linked_names(entries: DataFrame, key: str, name: str, surname: str, nicknames: DataFrame | None = None, **settings) -> DataFrame:
    """(``<key>_1``, ``<key>_2``), smaller key first: entries that name the same person or organisation.

    ``settings`` are those of :func:`name_forms`, whose result is linear in the entries.
    """
    return expand(*name_forms(entries, key, name, surname, nicknames, **settings), key)
