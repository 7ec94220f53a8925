import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlink.llm.packing import best_fit, containers, pack, pack_sizes, permitted_lengths


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 4))
def test_best_fit(sizes, steps):
    lengths = permitted_lengths(64, steps)
    bins, final = best_fit(sizes, lengths)
    used = np.bincount(bins, sizes, len(final)) if len(sizes) else np.array([])
    assert set(final) <= set(lengths) and (used <= final).all()
    # each container has the smallest permitted length for what it holds, and no two part-filled ones fit together
    assert all(f == min(x for x in lengths if x >= u) for u, f in zip(used, final))
    if len(used) > 1:
        a, b = sorted(used)[:2]
        assert a + b > 64 or steps > 1


def test_little_is_left(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.lognormal(4.2, 1.0, 6000).clip(1, 9000))]
    packed = pack_sizes(spark.createDataFrame(rows, "id long, n long"), "id", "n", 2048, shard_items=2000).cache()
    c = containers(packed).agg(F.sum("used").alias("used"), F.sum("capacity").alias("room"), F.max(F.col("used") - F.col("capacity")).alias("over")).first()
    assert c["over"] <= 0 and c["used"] == sum(n for _, n in rows) and c["used"] / c["room"] > 0.99
    assert packed.select("shard").distinct().count() >= 3
    # pieces of a text follow each other without gap, and only oversize texts have several
    pieces = packed.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max("n_pieces").alias("m"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    back = {r["id"]: r for r in pieces.collect()}
    for i, n in rows:
        assert back[i]["n"] == back[i]["end"] == n and back[i]["k"] == back[i]["m"] == -(-n // 2048)
    again = pack_sizes(spark.createDataFrame(rows[::-1], "id long, n long"), "id", "n", 2048, shard_items=2000)
    assert packed.exceptAll(again).isEmpty()


def test_texts(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000, "x"), (5, "one two three", "x"), (5, "one two three", "x")], "doc_id long, text string, n string")
    packed = pack(docs, "doc_id", "text", 2048).cache()
    assert sorted({r["doc_id"] for r in packed.collect()}) == [1, 4, 5]
    assert packed.filter("doc_id = 4 and n_pieces > 10").count() > 10
    assert packed.filter("doc_id = 5").count() == 2
    assert [r["doc_id"] for r in packed.filter("piece_no = 0 and n_pieces > 1").collect()] == [4]
    assert pack(docs.filter("false"), "doc_id", "text", 2048).count() == 0


def test_exact_capacity_is_not_split(spark):
    packed = pack_sizes(spark.createDataFrame([(1, 16), (2, 17), (3, 32)], "id long, n long"), "id", "n", 16).collect()
    assert {(r["id"], r["n_pieces"]) for r in packed} == {(1, 1), (2, 2), (3, 2)}
    with pytest.raises(ValueError):
        pack_sizes(spark.createDataFrame([(1, 16)], "id long, n long"), "id", "n", 16, lengths=[4, 8])


def test_popular_key_is_spread(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, id, 7) AS id", "id % 50 + 1 AS n")
    packed = pack_sizes(df, "id", "n", 64, shard_items=100).cache()
    assert packed.count() == 3000 and packed.agg(F.sum("n_tokens")).first()[0] == df.agg(F.sum("n")).first()[0]
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert max(sizes) < 400
    again = pack_sizes(df.repartition(5, "n"), "id", "n", 64, shard_items=100)
    assert packed.exceptAll(again).isEmpty() and again.exceptAll(packed).isEmpty()


def test_fill_of_documents(spark):
    """Used / capacity over the texts of a test table, in one shard and in several."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for shard_items, least in ((20_000, 0.995), (200, 0.95)):
        c = containers(pack(docs, "doc_id", "text", 2048, shard_items=shard_items)).agg(F.sum("used").alias("u"), F.sum("capacity").alias("c")).first()
        assert c["u"] / c["c"] > least
