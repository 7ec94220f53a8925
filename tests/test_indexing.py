import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlink import Block, Full, Index, NeighbourhoodBlock, Random, RecordSet, SortedNeighbourhood, index_split
from pairlink.operators.indexing import IndexAlgorithm, with_chunks
from pairlink.options import option_context


def frame(spark, n, prefix):
    return spark.range(n).select(F.concat(F.lit(prefix), F.format_string("%03d", "id")).alias("rec_id"), F.lit(1).alias("var_single"), F.col("id").alias("var_arange"), F.floor(F.col("id") / 10).cast("double").alias("var_block10"))


@pytest.fixture(scope="module")
def ab(spark):
    return RecordSet(frame(spark, 100, "a"), "rec_id"), RecordSet(frame(spark, 150, "b"), "rec_id")


@pytest.mark.parametrize("key,link,dedup", [("var_arange", 100, 0), ("var_block10", 1000, 450), ("var_single", 15000, 4950)])
def test_block_counts(ab, key, link, dedup):
    a, b = ab
    assert Block(key).index(a, b).count() == link
    assert Block(key).index(a).count() == dedup


@pytest.mark.parametrize("window", [3, 5, 9])
def test_neighbourhood_counts(spark, ab, window):
    a = ab[0]
    b = RecordSet(frame(spark, 100, "b"), "rec_id")
    half = (window - 1) // 2
    more = sum(100 - k for k in range(1, half + 1))
    assert SortedNeighbourhood("var_arange", window=window).index(a, b).count() == 100 + 2 * more
    assert SortedNeighbourhood("var_arange", window=window).index(a).count() == more
    assert SortedNeighbourhood("var_arange", window=window, block_on="var_arange").index(a, b).count() == 100


@pytest.mark.parametrize("window", [0, -1, 2, 3.0, "3"])
def test_wrong_windows(window):
    with pytest.raises(ValueError):
        SortedNeighbourhood("x", window=window)


def test_given_key_order(spark, rows):
    a = RecordSet(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None), (5, "w")], "id int, k string"), "id")
    got = SortedNeighbourhood("k", window=3, sorting_key_values=["z", "x", "y"]).index(a)
    assert rows(got) == [(2, 1), (3, 1)]  # w has no place in the order, null no key


def test_full_and_names(spark, ab):
    a, b = ab
    assert Full().index(a, b).count() == 15000
    pairs = Full().index(a)
    assert pairs.count() == 4950 and pairs.columns == ["rec_id_1", "rec_id_2"]
    assert pairs.filter("rec_id_1 <= rec_id_2").isEmpty()
    other = RecordSet(b.df.withColumnRenamed("rec_id", "id"), "id")
    assert Full().index(a, other).columns == ["rec_id", "id"]
    with option_context("indexing.pairs_suffixes", ("_a", "_b")):
        assert Full().index(a, b).columns == ["rec_id_a", "rec_id_b"]


def test_argument_forms(ab):
    a, b = ab
    want = Block("var_arange").index(a, b).count()
    assert Block("var_arange").index((a, b)).count() == Block("var_arange").index([a, b]).count() == want
    assert Block("var_arange").index([a]).count() == 0
    with pytest.raises(ValueError):
        Full().index(None)
    with pytest.raises(ValueError):
        Index().index(a)
    with pytest.raises(KeyError):
        Block("nowhere").index(a, b)


def test_nulls_never_block(spark, rows):
    a = RecordSet(spark.createDataFrame([(1, None, 1.0), (2, "x", float("nan")), (3, "x", 2.0), (4, None, 1.0)], "id int, k string, v double"), "id")
    assert rows(Block("k").index(a)) == [(3, 2)]
    assert rows(Block("v").index(a)) == [(4, 1)]
    with pytest.raises(ValueError):
        Block("k", "v").index(a, a)


def test_order_by_decides_the_triangle(spark, rows):
    a = RecordSet(spark.createDataFrame([("x", 2, 0), ("y", 1, 0)], "id string, pos int, k int"), "id", order_by="pos")
    assert rows(Block("k").index(a)) == [("x", "y")]


def test_empty_frames(spark, ab):
    none = RecordSet(ab[0].df.filter("false"), "rec_id")
    for algorithm in (Full(), Block("var_arange"), SortedNeighbourhood("var_arange"), NeighbourhoodBlock(["var_arange"])):
        assert algorithm.index(none, ab[1]).count() == 0
        assert algorithm.index(none).count() == 0
    with pytest.raises(ValueError):
        Random(3).index(none)


def test_duplicate_ids_are_found(spark):
    with pytest.raises(ValueError):
        RecordSet(spark.createDataFrame([(1,), (1,)], "id int"), "id").verify()


@pytest.mark.parametrize("replace", [True, False])
def test_random(ab, replace):
    a, b = ab
    link = Random(1000, replace, random_state=5).index(a, b)
    assert link.count() == 1000 and (replace or link.distinct().count() == 1000)
    dedup = Random(1000, replace, random_state=5).index(a)
    assert dedup.count() == 1000 and dedup.filter("rec_id_1 <= rec_id_2").isEmpty()
    assert replace or dedup.distinct().count() == 1000


def test_random_takes_the_whole_triangle(ab):
    assert Random(4950, replace=False).index(ab[0]).distinct().count() == 4950
    for n in (0, 4951):
        with pytest.raises(ValueError):
            Random(n, replace=False).index(ab[0])
    with pytest.raises(ValueError):
        Random(2.5)


def test_sparse_random(spark):
    big = RecordSet(spark.range(3000).withColumnRenamed("id", "rid"), "rid")
    pairs = Random(500, replace=False, random_state=3).index(big)
    assert pairs.distinct().count() == 500


def test_union(ab):
    a, b = ab
    both = Index().block("var_block10").block("var_arange").sortedneighbourhood("var_arange", window=3)
    got = both.index(a, b)
    assert got.count() == got.distinct().count()
    assert got.subtract(Full().index(a, b)).isEmpty()
    assert Block("var_block10").index(a, b).subtract(got).isEmpty()
    stats = Index(Block("var_block10")).stats(a)
    assert (stats["n"], stats["n_max"]) == (450, 4950)


def test_custom_algorithm(ab):
    class FirstLetter(IndexAlgorithm):
        def _link(self, a, b):
            return a.columns([], "l").crossJoin(b.columns([], "r")).filter("substr(lid, 4, 1) = substr(rid, 4, 1)").select("lid", "rid")

    a = ab[0]
    assert FirstLetter().index(a).count() == 10 * 45


def brute(left, right, max_nulls, max_non_matches, windows):
    """The acceptance rule over all pairs."""
    keys = list(zip(*[k for _, *k in left + right]))
    ranks = [{v: i for i, v in enumerate(sorted({x for x in column if x is not None}))} for column in keys]
    out = []
    for i, *x in left:
        for j, *y in right:
            nulls = sum(a is None or b is None for a, b in zip(x, y))
            same = sum(a is not None and b is not None and abs(r[a] - r[b]) <= w // 2 for a, b, r, w in zip(x, y, ranks, windows))
            if same + min(nulls, max_nulls) >= len(x) - max_non_matches:
                out.append((i, j))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_tolerant_blocking_equals_brute_force(spark, data):
    value = st.one_of(st.none(), st.integers(0, 4))
    side = lambda start: [(start + i, *data.draw(st.tuples(value, value, value))) for i in range(6)]
    left, right = side(0), side(100)
    nulls, differing, windows = data.draw(st.integers(0, 2)), data.draw(st.integers(0, 3)), data.draw(st.lists(st.sampled_from([1, 3]), min_size=3, max_size=3))
    a, b = (RecordSet(spark.createDataFrame(x, "id int, x int, y int, z int"), "id") for x in (left, right))
    got = NeighbourhoodBlock(["x", "y", "z"], max_nulls=nulls, max_non_matches=differing, windows=windows).index(a, b)
    assert sorted(tuple(r) for r in got.collect()) == brute(left, right, nulls, differing, windows)


def test_split(spark, ab):
    pairs = Block("var_block10").index(ab[0])
    sizes = [c.count() for c in index_split(pairs, 4)]
    assert sizes == [113, 113, 112, 112]
    assert with_chunks(pairs, 1000).select("chunk").distinct().count() == 450
    with pytest.raises(ValueError):
        index_split(pairs, 0)


@pytest.fixture
def tiles(spark, monkeypatch):
    """Tiles of three rows, and no table so small that all tasks get it."""
    from pairlink.operators import meeting

    monkeypatch.setattr(meeting, "TILE", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield meeting
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_a_popular_key_are_made_in_several_tasks(spark, rows, tiles):
    people = [(i, None if i == 7 else "p" if i < 40 else f"k{i % 4}") for i in range(60)]
    a = RecordSet(spark.createDataFrame(people, "id int, k string"), "id")
    b = RecordSet(spark.createDataFrame([(100 + i, k) for i, k in people[:50]], "other int, k string"), "other")
    once = Block("k").index(a)
    assert rows(once) == sorted(((x, y) for x, k in people for y, m in people if k is not None and k == m and x > y), key=str)
    assert rows(Block("k").index(a, b)) == sorted(((x, 100 + y) for x, k in people for y, m in people[:50] if k is not None and k == m), key=str)
    where = once.filter("id_1 < 40").withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert where.count() > 4
    # a key's rows on either side may be few, and types may differ
    c = RecordSet(spark.createDataFrame([(i, i % 2) for i in range(30)], "c int, k long"), "c")
    d = RecordSet(spark.createDataFrame([(i, i % 3) for i in range(4)], "d int, k int"), "d")
    assert rows(Block("k").index(c, d)) == sorted(((x, y) for x in range(30) for y in range(4) if x % 2 == y % 3), key=str)


def _moves_no_pair(pairs):
    """No aggregate above the joins: pairs aren't gathered to be told apart."""
    plan = str(pairs._jdf.queryExecution().optimizedPlan())
    return "Aggregate" not in plan.split("Join ")[0]


def test_several_blocks_give_each_pair_once(spark, rows, tiles):
    people = [(i, f"a{i % 3}" if i % 11 else None, f"b{i % 4}" if i % 7 else None, i % 5) for i in range(50)]
    a = RecordSet(spark.createDataFrame(people, "id int, x string, y string, z int"), "id")
    b = RecordSet(spark.createDataFrame(people[:30], "other int, x string, y string, z int"), "other")
    index = Index().block(["x", "z"]).block("y").block(["y", "z"]).block(left_on="z", right_on="z")
    same = lambda p, q: any(None not in k and k == m for k, m in (((p[1], p[3]), (q[1], q[3])), (p[2:3], q[2:3]), (p[3:], q[3:])))
    assert rows(index.index(a)) == sorted(((p[0], q[0]) for p in people for q in people if p[0] > q[0] and same(p, q)), key=str)
    assert rows(index.index(a, b)) == sorted(((p[0], q[0]) for p in people for q in people[:30] if same(p, q)), key=str)
    assert _moves_no_pair(index.index(a))


@pytest.mark.parametrize("nulls, others, windows", [(0, 1, [1, 1, 3, 1]), (1, 1, [3, 1, 1, 5]), (0, 2, 1), (0, 0, [1, 3, 3, 1]), (1, 2, [1, 1, 1, 3])])
def test_tolerant_blocking_gives_each_pair_once(spark, rows, tiles, nulls, others, windows):
    people = [(i, *((i * m + i // 5) % 4 if (i + m) % 9 else None for m in (1, 2, 3, 5))) for i in range(36)]
    a = RecordSet(spark.createDataFrame(people, "id int, w int, x int, y int, z int"), "id")
    half = [w // 2 for w in ([windows] * 4 if isinstance(windows, int) else windows)]

    def accepted(p, q):
        agree = sum(s is not None and t is not None and abs(s - t) <= h for s, t, h in zip(p[1:], q[1:], half))
        return agree + min(nulls, sum(s is None or t is None for s, t in zip(p[1:], q[1:]))) >= 4 - others

    found = NeighbourhoodBlock(["w", "x", "y", "z"], max_nulls=nulls, max_non_matches=others, windows=windows).index(a)
    assert rows(found) == sorted(((p[0], q[0]) for p in people for q in people if p[0] > q[0] and accepted(p, q)), key=str) != []
    assert _moves_no_pair(found)
