import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairlink.llm.groups import connected_groups, record_groups


def brute(pairs):
    """Union by going through the pairs one by one."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in parent)


def found(spark, pairs, kind="string"):
    return sorted(tuple(r) for r in connected_groups(spark.createDataFrame(pairs, f"a {kind}, b {kind}"), "a", "b").collect())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_any_pairs(spark, pairs):
    assert found(spark, pairs, "int") == brute(pairs)


@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "hub", "ring"])
def test_shapes(spark, shape):
    n = 300
    ids = [f"r{i:04d}" for i in range(n)]
    if shape == "shuffled chain":
        random.Random(2).shuffle(ids)
    pairs = [(ids[0], x) for x in ids[1:]] if shape == "hub" else list(zip(ids, ids[1:])) + ([(ids[-1], ids[0])] if shape == "ring" else [])
    assert found(spark, pairs) == brute(pairs)


def test_odd_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [("a", "a"), (None, "b"), ("c", None), (None, None)]) == []
    assert found(spark, [("b", "a"), ("a", "b"), ("a", "b"), ("a", "a"), (None, "a"), ("", "b")]) == [("", ""), ("a", ""), ("b", "")]
    long = "x" * 50_000
    assert found(spark, [(long, "y")]) == brute([(long, "y")])


def test_ids_written_differently(spark):
    records = spark.createDataFrame([("rec-01", 1), ("rec-02", 2), ("rec-02", 3), ("rec-03", 4), ("rec-04", 5), (None, 6)], "rec_id string, group_id int")
    pairs = spark.createDataFrame([("REC-01", " rec-02 "), ("rec_02", "rec-99"), ("rec-99", "rec-03"), ("rec-04", "rec-77")], "x string, y string")
    got = sorted(tuple(r) for r in record_groups(records, "rec_id", pairs, "x", "y").collect())
    assert got == [("rec-01", "rec-01"), ("rec-02", "rec-01"), ("rec-03", "rec-01")]
    assert record_groups(records.filter("false"), "rec_id", pairs, "x", "y").count() == 0
