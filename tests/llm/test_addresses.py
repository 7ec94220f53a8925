import itertools

from pairlink.llm.addresses import linked_addresses, read_address

COLS = "addr_id long, str_name string, street_number string, postcode string, place string"
LOCATIONS = {
    "a": [("Hallowmere Road", "12", "00500", "North Velgard"), ("Hallowmere Rd.", "No. 12", "500", "N. Velgard"), ("12, Hallowmere Road", None, "00500", None), ("Rd Hallowmere", "0012", None, "North Velgard"), ("Hallowmmere Road", "12", "P-00500", "North Velgardd"), ("Hallowmere", "12", "00500", "NORTH VELGARD"), ("Hallowmere Road 12, North Velgard", None, "00500", None), ("Hallowmere Road", "12", None, "00500 North Velgard")],
    "b": [("Hallowmere Road", "12b", "00500", "North Velgard"), ("Hallowmere Rd", "12/B", "00500", "North Velgard")],
    "c": [("Hallowmere Road", "13", "00500", "North Velgard")],
    "d": [("Castle Street", "3", "00600", "Upper Trosk"), ("Castle St", "3", None, "Upr Trosk")],
    "e": [("Castle Street", "3", "00500", "North Velgard")],
    "f": [("Castle Lane", "3", "00600", "Upper Trosk")],
}


def filler():
    streets = [f"{s}{e}" for s in ("Abrik", "Bendor", "Cladun", "Dropel") for e in ("wund", "feeld", "mont")]
    return [(f"{s} {t}", str(50 + i), c, p) for i, (s, (c, p)) in enumerate(itertools.product(streets, (("00500", "North Velgard"), ("00600", "Upper Trosk")))) for t in ("Road", "Street")]


def test_locations(spark):
    rows, owner = [], {}
    for where, entries in LOCATIONS.items():
        for entry in entries:
            owner[len(rows)] = where
            rows.append((len(rows), *entry))
    rows += [(100 + i, *f) for i, f in enumerate(filler())]
    df = spark.createDataFrame(rows, COLS).selectExpr("*", "1 AS house", "'x' AS form")
    got = {tuple(r) for r in linked_addresses(df, "addr_id", "str_name", "street_number", "postcode", "place").collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(owner), 2) if owner[a] == owner[b]}
    assert {p for p in got if p[1] < 100} == want
    assert not [p for p in got if p[1] >= 100]


def test_missing_place_in_two_places_is_left_open(spark):
    rows = [(1, "Castle Street", "3", "00600", "Upper Trosk"), (2, "Castle Street", "3", "00500", "North Velgard"), (3, "Castle Street", "3", None, None)]
    rows += [(100 + i, *f) for i, f in enumerate(filler())]
    got = {tuple(r) for r in linked_addresses(spark.createDataFrame(rows, COLS), "addr_id", "str_name", "street_number", "postcode", "place").collect()}
    assert not [p for p in got if p[1] < 100]


def test_odd_rows(spark):
    link = lambda rows: sorted(tuple(r) for r in linked_addresses(spark.createDataFrame(rows, COLS), "addr_id", "str_name", "street_number", "postcode", "place").collect())
    assert link([]) == []
    assert link([(1, None, None, None, None), (2, "Some Road", None, None, None), (3, None, "5", "1", "x"), (4, "", "", "", "")]) == []
    same = ("Some Lane", "5", None, None)
    assert link([(3, *same), (1, *same), (2, *same)]) == [(1, 2), (1, 3), (2, 3)]
    assert link([(1, "Some " * 3000 + "Lane", "5", None, "x" * 5000), (2, "Other", "5", None, None)]) == []


def test_reading():
    assert read_address("67/c Vassuko Sqr", None, None, "00706 LUKGO")[:2] == ("67c", "706")
    assert read_address("Stigvo, 46/C", None, "00513", None)[:2] == ("46c", "513")
    assert read_address("8 Voelbo Boulevard", None, "P-00749", "x")[:3] == ("8", "749", ["voelbo", "boulevard"])
    assert read_address("Road", "#0017", None, None)[0] == "17"


def test_street_named_like_a_popular_place_and_long_house_numbers(spark):
    rows = [(1, "Tolvane Road", "5", "00700", "Trosk"), (2, "Tolvane Rd", "5", "00700", "Trosk"), (3, "Tolvane Road 5, Trosk", None, "00700", None), (4, "Tolvane Road", "6", "00700", "Trosk")]
    rows += [(10, "Castle Street", "12345", "00700", "Trosk"), (11, "Castle St", "No. 12345", "00700", "Trosk"), (12, "Castle Street", "12346", "00700", "Trosk"), (13, "Castle Street", "12345b", "00700", "Trosk")]
    rows += [(14, "Castle Street", "98765", None, "Trosk"), (15, "Castle Street", "98765", None, "Trosk")]
    rows += [(100 + i, f"{s} Road", str(50 + i), "00800", "Tolvane") for i, s in enumerate(("Abrikwund", "Bendorfeeld", "Cladunmont", "Dropelwund", "Ertolmfeeld", "Fasginmont"))]
    got = {tuple(r) for r in linked_addresses(spark.createDataFrame(rows, COLS), "addr_id", "str_name", "street_number", "postcode", "place").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (10, 11), (14, 15)}
    assert read_address("Hallowmere Road 12", "00500", None, None)[:2] == ("12", "500")
    assert read_address("Castle Street", "12345", "12345", None)[:2] == ("12345", "12345")
