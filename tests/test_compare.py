import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlink import Block, Compare, Date, Exact, Frequency, FrequencyA, FrequencyB, Geographic, Numeric, RandomContinuous, RandomDiscrete, RecordSet, String, Variable, block_and_compare
from pairlink.functions import metrics, text


def aligned(spark, left, right, kind, kind_right=None):
    """Two tables whose rows pair up by position."""
    if kind == "double":
        left, right = ([None if v is None else float(v) for v in x] for x in (left, right))
    a = spark.createDataFrame([(i, v) for i, v in enumerate(left)], f"id int, col {kind}")
    b = spark.createDataFrame([(i, v) for i, v in enumerate(right)], f"id int, col {kind_right or kind}")
    pairs = spark.range(len(left)).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    return pairs, RecordSet(a, "id"), RecordSet(b, "id")


def values(spark, feature, left, right, kind, kind_right=None):
    got = Compare(feature).compute(*aligned(spark, left, right, kind, kind_right)).orderBy("i").collect()
    return [r[2] for r in got]


def test_exact(spark):
    assert values(spark, Exact("col", "col"), ["abc"] * 5, ["abc", "abd", "abc", "abc", "123"], "string") == [1, 0, 1, 1, 0]
    assert values(spark, Exact("col", "col"), [42, 42, 41, 43, None], [42] * 5, "int") == [1, 1, 0, 0, 0]
    l, r = ["a", "b", "c", "d", None], ["a", "b", "d", None, None]
    for missing in (9, None, math.nan):
        m = 9 if missing == 9 else None
        assert values(spark, Exact("col", "col", missing_value=missing), l, r, "string") == [1, 1, 0, m, m]
    assert values(spark, Exact("col", "col", missing_value="str"), l, r, "string") == ["1.0", "1.0", "0.0", "str", "str"]
    assert values(spark, Exact("col", "col", disagree_value=9), l, r, "string") == [1, 1, 9, 0, 0]
    assert values(spark, Exact("col", "col", agree_value="value", disagree_value=None), l, r, "string") == ["a", "b", None, "0", "0"]
    with pytest.raises(ValueError):
        values(spark, Exact("col", "col"), ["1"], [1], "string", "int")


def test_numeric(spark):
    assert values(spark, Numeric("col", "col", "step", offset=2), [1, 1, 1, None, 0], [1, 2, 3, None, None], "double") == [1, 1, 1, 0, 0]
    for m in (9, None):
        assert values(spark, Numeric("col", "col", "linear", scale=2, missing_value=m), [1, 1, 1, None, 0], [1, 1, 1, None, None], "double") == [1, 1, 1, m, m]
    for method in ("linear", "squared", "exp", "gauss"):
        got = values(spark, Numeric("col", "col", method, offset=1, scale=2), [1] * 5, [1, 2, 3, 4, 5], "double")
        assert got[:2] == [1, 1] and 0.5 < got[2] < 1 and got[3] == 0.5 and 0 <= got[4] < 0.5
    for bad in ({"scale": 0}, {"scale": -1}, {"offset": -1}, {"method": "unknown"}):
        with pytest.raises(ValueError):
            Numeric("col", "col", **{"method": "linear", **bad})
    assert values(spark, Numeric("col", "col", "gauss"), [math.nan], [1.0], "double") == [0]


A_DATES = [dt.date(1998, 3, 17), None, dt.date(2001, 3, 17), dt.date(1987, 2, 5), dt.date(1987, 10, 12), dt.date(1990, 6, 7)]
B_DATES = [dt.date(1998, 3, 17), dt.date(1990, 12, 31), dt.date(1998, 3, 17), dt.date(1987, 5, 2), dt.date(1987, 9, 12), dt.date(1990, 7, 6)]


@pytest.mark.parametrize(
    "args,want",
    [
        ({}, [1, 0, 0, 0.5, 0.5, 0.5]),
        ({"swap_month_day": 0}, [1, 0, 0, 0, 0.5, 0]),
        ({"swap_month_day": 7.25}, [1, 0, 0, 7.25, 0.5, 7.25]),
        ({"swap_month_day": 7.25, "swap_months": [(9, 10, 7.25), (10, 9, 7.25), (1, 2, 7.25), (2, 1, 7.25)]}, [1, 0, 0, 7.25, 7.25, 7.25]),
        # None leaves the swap out, NaN is the value of a swap
        ({"swap_month_day": None, "missing_value": None}, [1, None, 0, 0, 0.5, 0]),
        ({"swap_month_day": math.nan, "missing_value": None}, [1, None, 0, None, 0.5, None]),
        ({"missing_value": 9}, [1, 9, 0, 0.5, 0.5, 0.5]),
        # the last rule that fits counts, but 1 is final
        ({"swap_months": [(10, 9, 0.25), (10, 9, 0.75)]}, [1, 0, 0, 0.5, 0.75, 0.5]),
        ({"swap_months": [(10, 9, 1.0), (10, 9, 0.5)]}, [1, 0, 0, 0.5, 1, 0.5]),
        ({"swap_month_day": 1, "swap_months": None}, [1, 0, 0, 1, 0, 1]),
    ],
)
def test_dates(spark, args, want):
    assert values(spark, Date("col", "col", **args), A_DATES, B_DATES, "date") == want


def test_date_errors(spark):
    with pytest.raises(ValueError):
        values(spark, Date("col", "col"), ["2001-01-01"], ["2001-01-01"], "string")
    with pytest.raises(ValueError):
        Date("col", "col", swap_months=[(1, 2)])


def test_geo(spark):
    places = [(52.0842455, 5.0124516), (52.3747388, 4.7585305), (51.9280573, 4.4203581)]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lat double, lng double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(places[1:] + places[:1])], "id int, lat double, lng double")
    pairs = spark.range(3).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    compare = Compare().geo("lat", "lng", "lat", "lng", method="step", offset=50).geo("lat", "lng", "lat", "lng", method="exp", scale=1)
    got = compare.compute(pairs, RecordSet(a, "id"), RecordSet(b, "id")).orderBy("i").collect()
    assert [r["0"] for r in got] == [1, 0, 1]
    for r, km in zip(got, (36.639460, 54.765854, 44.092472)):
        assert -math.log2(r["1"]) == pytest.approx(km, abs=1e-5)
    with pytest.raises(ValueError):
        Geographic("lat", "lng", "lat", "lng")


GRETZKY = ["gretzky", "gretzky99", "gretzky", "gretzky"], ["gretzky", "gretzky", None, "wayne"]
METHODS = ["levenshtein", "damerau_levenshtein", "jaro", "jarowinkler", "qgram", "cosine", "smith_waterman", "lcs"]


@pytest.mark.parametrize(
    "method,threshold,missing,want",
    [("levenshtein", 0.5, 2, [1, 1, 2, 0]), ("levenshtein", 1.0, 0.5, [1, 0, 0.5, 0]), ("levenshtein", 0.0, None, [1, 1, None, 1]), ("cosine", 0.5, None, [1, 1, None, 0]), ("q_gram", 0.5, None, [1, 1, 0, 0])],
)
def test_string_thresholds(spark, method, threshold, missing, want):
    assert values(spark, String("col", "col", method, threshold, missing), *GRETZKY, "string") == want


@pytest.mark.parametrize("method", METHODS)
def test_string_rules(spark, method):
    assert values(spark, String("col", "col", method, missing_value=9), ["nan", None, None], ["nan", None, None], "string") == [1, 9, 9]
    got = values(spark, String("col", "col", method, missing_value=None), ["str_abc", "str_abc", "str_abc", None, "hsdkf"], ["str_abc", "str_abd", "jaskdfsd", None, None], "string")
    known = [x for x in got if x is not None]
    assert all(0 <= x <= 1 for x in known) and got[0] == 1 and min(known) < 1
    with pytest.raises(TypeError):
        values(spark, String("col", "col", method), [1], [1], "int")


def test_unknown_string_method(spark):
    with pytest.raises(ValueError):
        values(spark, String("col", "col", "unknown"), ["a"], ["a"], "string")


def test_empty_strings(spark):
    for method, want in (("levenshtein", None), ("damerau_levenshtein", None), ("qgram", None), ("cosine", None), ("smith_waterman", 0), ("lcs", 0), ("jaro", 0)):
        assert values(spark, String("col", "col", method, missing_value=None), [""], [""], "string") == [want], method


def test_bigrams_ignore_case_and_accents(spark):
    assert values(spark, String("col", "col", "qgram"), ["Ősi  Ház"], ["osi haz"], "string") == [1]


def test_very_long_text(spark):
    long = "word " * 4000
    assert values(spark, String("col", "col", "levenshtein"), [long], [long], "string") == [1]


texts = st.text(alphabet="abcd", max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=40))
def test_kernels_against_sql(pairs):
    con = duckdb.connect()
    rows = con.execute("SELECT jaro_similarity(x, y), jaro_winkler_similarity(x, y), damerau_levenshtein(x, y) FROM (SELECT unnest(?) AS x, unnest(?) AS y)", [[p[0] for p in pairs], [p[1] for p in pairs]]).fetchall()
    for (a, b), (jaro, winkler, edits) in zip(pairs, rows):
        if a or b:
            assert metrics.jaro(a, b) == pytest.approx(jaro)
            assert metrics.jaro_winkler(a, b) == pytest.approx(winkler)
        assert metrics.damerau_levenshtein(a, b) == edits


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_alignment_kernels(a, b):
    for kernel in (metrics.smith_waterman, metrics.longest_common_substring):
        assert kernel(a, b) == pytest.approx(kernel(b, a)) and 0 <= kernel(a, b) <= 1
        assert kernel(a, a) == pytest.approx(1 if len(a) > 1 or (a and kernel is metrics.smith_waterman) else 0)


def test_frequency_and_variable(spark):
    a = [None if i >= 90 else i // 10 for i in range(100)]
    b = [i % 20 for i in range(100)]
    pairs, x, y = aligned(spark, a, b, "int")
    got = Compare([FrequencyA("col", label="a"), FrequencyB("col", label="b"), FrequencyA("col", normalise=False, missing_value=None, label="n"), Variable("col", "col", missing_value=-1, label=["l", "r"])]).compute(pairs, x, y).orderBy("i").collect()
    assert {r["a"] for r in got[:90]} == {0.1} and {r["a"] for r in got[90:]} == {0.0}
    assert {r["b"] for r in got} == {0.05}
    assert [r["n"] for r in got] == [10.0] * 90 + [None] * 10
    assert [r["l"] for r in got] == [-1 if v is None else v for v in a] and [r["r"] for r in got] == b


def test_random_features(spark):
    pairs, x, y = aligned(spark, range(50), range(50), "int")
    got = Compare([RandomContinuous(2, 3, "u", 1), RandomDiscrete([4, 7], label="v", random_state=1), RandomDiscrete(3, label="w", random_state=2)]).compute(pairs, x, y).collect()
    assert all(2 <= r["u"] < 3 and r["v"] in (4, 7) and r["w"] in (0, 1, 2) for r in got)


def test_labels_and_user_functions(spark):
    pairs, x, y = aligned(spark, ["a", "b"], ["a", "c"], "string")
    got = Compare().exact("col", "col").exact("col", "col", label="e").compare_vectorized(lambda l, r: [F.concat(l, r), F.length(l)], "col", "col", label=["both", "n"]).compute(pairs, x, y)
    assert got.columns == ["i", "j", "0", "e", "both", "n"]
    with pytest.raises(KeyError):
        Compare().exact("nowhere", "col").compute(pairs, x, y)
    with pytest.raises(ValueError):
        Compare().compare_vectorized(lambda l, r: 1, "col", "col").compute(pairs, x, y)
    with pytest.raises(TypeError):
        Compare().exact("col", "col").compute([(1, 2)], x, y)


def test_repeated_pairs_stay(spark):
    pairs, x, y = aligned(spark, ["a", "b"], ["a", "c"], "string")
    assert Compare().exact("col", "col").compute(pairs.union(pairs), x, y).count() == 4


def test_fused_plan_gives_the_same(spark, rows):
    people = spark.createDataFrame([(1, "x", "ann", 1.0), (2, "x", "anne", 2.0), (3, "y", "bob", None), (4, None, "bob", 1.0), (5, "x", None, 9.0)], "id int, k string, name string, v double")
    a = RecordSet(people, "id")
    compare = Compare().string("name", "name", label="s").numeric("v", "v", "gauss", label="n")
    assert rows(block_and_compare(Block("k"), compare, a)) == rows(compare.compute(Block("k").index(a), a))
    other = RecordSet(people.withColumnRenamed("id", "id2"), "id2")
    assert rows(block_and_compare(Block("k"), compare, a, other)) == rows(compare.compute(Block("k").index(a, other), a, other))


def test_functions_of_series(spark):
    """User functions of pandas Series: arrays, several outputs, further arguments, nulls."""
    a = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (3, "xyz", None)], "id long, s string, n int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id_1 long, id_2 long")
    several = lambda x, n, y, m, k: pd.DataFrame({"size": x.str.len() * k, "sum": n + m})
    both = lambda x, y: ((x == y).to_numpy(), np.ones(len(x), dtype=int))
    compare = Compare().compare_vectorized(lambda x, y, k: np.ones(len(x), dtype=int) * k, "s", "s", 5, label="five")
    compare.compare_vectorized(several, ["s", "n"], ["s", "n"], k=3, label=["size", "sum"]).compare_vectorized(both, "s", "s", label=["same", "one"])
    compare.compare_vectorized(lambda x, y: [len(v or "") for v in x], "s", "s", label="listed", returns="int")
    got = [tuple(r)[2:] for r in compare.compute(pairs, a, a).orderBy("id_1").collect()]
    assert got == [(5, 9, 3, False, 1, 3), (5, None, None, False, 1, 0), (5, 9, None, False, 1, 3)]
    assert compare.compute(pairs.filter("false"), a, a).count() == 0
    for bad in (lambda x, y: 1 / 0, lambda x, y: [1]):
        with pytest.raises(ValueError):
            Compare().compare_vectorized(bad, "s", "s").compute(pairs, a, a)


def test_equal_strings_spare_the_kernel(spark):
    """What is decided without a kernel reaches it as null."""
    df = spark.createDataFrame([("same", "same"), ("one", "two"), (None, "x")], "l string, r string")
    for method in ("jaro", "jarowinkler", "damerau_levenshtein", "smith_waterman", "lcs"):
        plan = df.select(text.similarity(F.col("l"), F.col("r"), method).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        call = plan[plan.index("apply(") :]
        assert call.startswith("apply(CASE WHEN") or "CASE WHEN" in call.split("#")[0] or "if (" in call.split("#")[0], call[:80]


@given(st.lists(st.tuples(st.text(alphabet="abAB é😀", max_size=12), st.text(alphabet="abAB é😀", max_size=12)), min_size=20, max_size=60))
@settings(max_examples=30, deadline=None)
def test_batches_equal_single_pairs(pairs):
    for kernel in metrics._MANY:
        np.testing.assert_array_equal(metrics.many(kernel, pairs), np.array([kernel(a, b) for a, b in pairs], dtype=float))
    long = [("x" * 3000 + a, "x" * 2990 + b) for a, b in pairs[:2]]
    np.testing.assert_array_equal(metrics.many(metrics.jaro_winkler, long), [metrics.jaro_winkler(a, b) for a, b in long])


def people(spark):
    a = spark.createDataFrame([(i, "s" if i < 25 else f"s{i % 3}" if i < 38 else None, f"p{i % 4}" if i % 5 else None, f"name {i % 6}") for i in range(40)], "a int, k string, place string, name string")
    b = spark.createDataFrame([(i, "s" if i < 20 else f"s{i % 3}", f"p{i % 3}" if i % 7 else None, f"nane {i % 5}") for i in range(30)], "b int, k string, place string, name string")
    return RecordSet(a, "a"), RecordSet(b, "b")


def test_frequencies_are_counted_without_moving_pairs(spark, rows, monkeypatch):
    from pairlink.operators import meeting

    monkeypatch.setattr(meeting, "TILE", 3)
    a, b = people(spark)
    made = lambda: Compare([Frequency("place", "place", label=["x", "y"]), FrequencyA("place", normalise=False, missing_value=-1, label="n"), FrequencyB("name", label="m")])
    block = Block("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fused = block_and_compare(block, made(), a, b)
        assert rows(fused) == rows(made().compute(block.index(a, b), a, b)) != []
        # the last join is the one that makes the pairs: nothing is joined to them
        assert "LeftOuter" not in next(x for x in str(fused._jdf.queryExecution().optimizedPlan()).splitlines() if "Join " in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("method", ["jarowinkler", "levenshtein"])
def test_pairs_whose_sum_is_too_small_are_left_out_before_strings_are_compared(spark, rows, method):
    a, b = people(spark)
    made = lambda: Compare().string("name", "name", method, label="s").exact("place", "place", missing_value=0.25, label="e")
    for least in (0.3, 1.1, 1.7):
        every, few = block_and_compare(Block("k"), made(), a, b), block_and_compare(Block("k"), made(), a, b, sum_above=least)
        assert rows(few.filter(f"s + e > {least}")) == rows(every.filter(f"s + e > {least}")) != []
    assert few.count() < every.count()


def test_a_stream_leaves_out_pairs_whose_sum_is_too_small(spark, rows, monkeypatch, tmp_path):
    from pairlink.operators import meeting
    from pairlink.streaming.incremental import stream_link

    monkeypatch.setattr(meeting, "TILE", 3)
    a, b = people(spark)
    a.df.write.parquet(f"{tmp_path}/a")
    compare = Compare().string("name", "name", "jarowinkler", label="s").exact("place", "place", label="e")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = stream_link(spark.readStream.schema(a.df.schema).parquet(f"{tmp_path}/a"), "a", b, Block("k"), compare, sum_above=1.5)
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out")
        every = block_and_compare(Block("k"), compare, a, b)
        assert rows(got.filter("s + e > 1.5")) == rows(every.filter("s + e > 1.5")) != []
        assert got.count() < every.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
