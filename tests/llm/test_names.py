import itertools
import random

import pytest

from pairlink.llm.names import Readings, _assign, abbreviates, align, linked_names, split_name
from pairlink.llm.spelling import near_tokens, spellings
from pairlink.scratch import Scratch

NICKS = [("Robert", "Bob"), ("Margaret", "Peggy"), ("Catherine", "Kate")]
#: entity -> entries (name, surname field)
ENTITIES = {
    "bob": [("Robert Hallowmere", "Hallowmere"), ("Hallowmere, Bob", "Hallowmere"), ("R. Hallowmere", "Hallowmere"), ("Dr Robert Hallowmmere", "Hallowmere"), ("Hallow-Mere Robert", None), ("Robert Hallowmere", "Hallowmere")],
    "peg": [("Margaret Hallowmere", "Hallowmere"), ("Peggy Hallowmere", "Halowmere")],
    "kate": [("Catherine Quenlivard", "Quenlivard"), ("Kate Quenlivard", "QUENLIVARD"), ("Quen livard Catherine", "Quenlivard")],
    "mill": [("Vostrelune Milling Limited", None), ("Vostrelune Mlg Ltd.", None), ("The Vostrelune Milling", None), ("Milling Ltd Vostrelune", None), ("Vostrelune M.L.", None)],
    "dairy": [("Vostrelune Dairy Limited", None), ("Vostrelune Dairy", None)],
}


@pytest.fixture(scope="module")
def nicks(spark):
    return spark.createDataFrame(NICKS, "given_name string, nickname string")


@pytest.fixture(scope="module")
def filler():
    """Other people and firms, so that common words are common."""
    stems = ["Abrik", "Bendor", "Cladun", "Dropel", "Ertolm", "Fasgin", "Gulver", "Hinsop"]
    out = [(f"{g} {s}{e}", f"{s}{e}") for g, (s, e) in zip(itertools.cycle(["Robert", "Margaret", "Catherine"]), itertools.product(stems, ["wund", "feeld"]))]
    return out + [(f"{s}oxx {t} Limited", None) for s, t in itertools.product(stems, ["Milling", "Dairy"])]


def test_entities(spark, nicks, filler):
    rows, owner = [], {}
    for who, entries in ENTITIES.items():
        for entry in entries:
            owner[len(rows)] = who
            rows.append((len(rows), *entry, "x"))
    rows += [(100 + i, *f, "y") for i, f in enumerate(filler)]
    df = spark.createDataFrame(rows, "entry_id long, name_a string, surname string, form string")  # a column named like an inner one
    got = {tuple(r) for r in linked_names(df, "entry_id", "name_a", "surname", nicks).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(owner), 2) if owner[a] == owner[b]}
    assert {p for p in got if p[1] < 100} == want
    assert not [p for p in got if p[1] >= 100]


def test_initial_of_two_relatives_is_left_open(spark, nicks):
    rows = [(1, "Robert Hallowmere", "Hallowmere"), (2, "Rosalind Hallowmere", "Hallowmere"), (3, "R. Hallowmere", "Hallowmere"), (4, "R Hallowmere", None)]
    more = nicks.union(spark.createDataFrame([("Rosalind", "Roz")], "a string, b string"))
    got = {tuple(r) for r in linked_names(spark.createDataFrame(rows, "id long, n string, s string"), "id", "n", "s", more).collect()}
    assert not {(1, 3), (2, 3), (1, 4), (2, 4), (1, 2)} & got


def test_odd_rows(spark, nicks):
    schema = "id long, n string, s string"
    link = lambda rows: sorted(tuple(r) for r in linked_names(spark.createDataFrame(rows, schema), "id", "n", "s", nicks).collect())
    assert link([]) == []
    assert link([(1, None, None), (2, None, "x"), (3, "", ""), (4, " , ", None)]) == []
    assert link([(1, "Same Namesson", None), (2, "Same Namesson", None), (3, "Same Namesson", None)]) == [(1, 2), (1, 3), (2, 3)]
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    assert link([(1, long, None), (2, long, None), (3, None, "x" * 2000)]) == [(1, 2)]
    assert link([(1, long, None), (2, "x" * 5000, "x" * 2000)]) == []
    assert linked_names(spark.createDataFrame([(1, "Ann Lee", "Lee")], schema), "id", "n", "s").count() == 0


def test_reading_words():
    assert split_name("Hallow-Mere , R.  B.") == (["hallowmere"], ["r", "b"])
    assert split_name("Vostrelune U.B.") == (["vostrelune"], ["u", "b"])
    assert split_name(None) == ([], [])
    assert abbreviates("mlg", "milling") and abbreviates("eng", "engineering") and not abbreviates("xyz", "milling") and not abbreviates("milling", "mlg")
    r = Readings({"milling": 9, "dairy": 9}, [("robert", "bob")], {"rob": "robert"})
    assert r.of("mlg") >= {"milling"} and r.of("bob") == {"robert"} and "robert" in r.of("rob")


def test_alignment_is_optimal():
    unit = lambda *ws: [(w, frozenset({w})) for w in ws]
    gain, pairs = align(unit("a", "anna"), unit("anna", "alma"))
    assert sorted(pairs) == [(0, 1), (1, 0)] and gain == 1.4


def test_long_alignments_are_optimal_too():
    rng = random.Random(5)
    for _ in range(30):
        gains = [[rng.choice([0, 0.4, 0.5, 0.9, 1.0]) for _ in range(5)] for _ in range(4)]
        best = max(sum(gains[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(5), 4))
        assert sum(gains[i][j] for i, j in enumerate(_assign(gains))) == pytest.approx(best)
    words = [(w, frozenset({w})) for w in "abcdefghijklmnop"]
    assert align(words, words[::-1])[0] == 8.0 and len(align([("word", frozenset({"word"}))] * 40, [("word", frozenset({"word"}))] * 50)[1]) == 40


def test_edit_index_equals_brute_force(spark):
    words = ["hallowmere", "hallowmmere", "halowmere", "hallwomere", "hollowmere", "hollowmara", "quenlivard", "quenlivrad", "short", "shor", "shirt", "tiny"]
    df = spark.createDataFrame([(w, 1) for w in words], "tok string, df long")
    got = {(r["tok"], r["other"]) for r in near_tokens(df).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for a, b in itertools.permutations(words, 2):
        if min(len(a), len(b)) >= 9:
            assert ((a, b) in got) == (edits(a, b) <= 2), (a, b)
        elif min(len(a), len(b)) >= 5 and edits(a, b) <= 1:
            assert (a, b) in got


def test_near_spellings_used_equally_often_are_linked(spark, nicks, filler):
    rows = [(i, f"{('Toedsawudourd', 'Toedzawudourd')[i % 2]} {t}", None) for i, t in enumerate(["Milling", "Milling Ltd", "The Milling"] * 2)]
    rows += [(10 + i, f"Toedsawudourd Dairy{t}", None) for i, t in enumerate(["", " Ltd"])] + [(100 + i, *f) for i, f in enumerate(filler)]
    got = {tuple(r) for r in linked_names(spark.createDataFrame(rows, "id long, n string, s string"), "id", "n", "s", nicks).collect()}
    assert {p for p in got if p[0] < 100} == set(itertools.combinations(range(6), 2)) | {(10, 11)}


def test_adoptions_are_followed_to_the_end(spark):
    chain = ["hallower", "hallowar", "hallowas", "hallodas", "hallidas", "hablidas", "tablidas", "tublidas"]
    df = spark.createDataFrame([(w, n) for w, n in zip(chain, (1, 2, 6, 18, 54, 162, 486, 1458))], "tok string, df long")
    assert {r["canon"] for r in spellings(df, set(), Scratch(spark, "test")).collect()} == {"tublidas"}


def test_null_surname_and_a_rarer_unlisted_given_name(spark, nicks):
    rows = [(1, "Musgitusur,Dottie", None), (2, "Musgitusur,Dottie", "Musgitusur"), (3, "Dottie Musgitusur", "Musgitusur"), (4, "Dr Dottie Musgitusur", None), (5, "Dottie Musgitusur", "Dottie")]
    rows += [(6, "Zerbal Musgitusur", "Musgitusur"), (7, "Dottie Quenlivard", "Quenlivard"), (8, "Milling Dairy", None), (9, "Vostrelune Milling Dairy", None)]
    rows += [(100 + i, f"{g} {s}", s) for i, (g, s) in enumerate(itertools.product(["Robert", "Margaret"], ["Musgitusur"] * 3 + ["Quenlivard"] * 3))]
    rows += [(200 + i, f"{s}oxx Milling Dairy", None) for i, s in enumerate(["Abrik", "Bendor", "Cladun"])]
    got = {tuple(r) for r in linked_names(spark.createDataFrame(rows, "id long, n string, s string"), "id", "n", "s", nicks).collect()}
    assert {p for p in got if p[0] < 100} == set(itertools.combinations(range(1, 6), 2))


def test_short_and_listed_words_identify_where_no_other_does(spark, nicks):
    rows = [(1, "Li Wu", None), (2, "Li Wu", "Wu"), (3, "Wu, Li", None), (4, "Jo Ng", "Ng"), (5, "Jo Ng", "Ng"), (6, "Jo Wu", "Wu")]
    rows += [(10, "Robert Margaret", "Margaret"), (11, "Robert Margaret", "Margaret"), (12, "Bob Margaret", None), (13, "Catherine Margaret", "Margaret")]
    rows += [(20, "李伟", None), (21, "李伟", None), (22, "李 娜", None), (23, "娜 李", None), (24, "李娜娜", None), (30, "I.B.M.", None), (31, "I.B.M.", None), (32, "J.", None), (33, "J.", None)]
    got = {tuple(r) for r in linked_names(spark.createDataFrame(rows, "id long, n string, s string"), "id", "n", "s", nicks).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (4, 5), (10, 11), (10, 12), (11, 12), (20, 21), (22, 23), (30, 31)}
