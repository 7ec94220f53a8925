import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlink.llm import mixing
from pairlink.llm.mixing import Mix, hypergeometric, shard_runs


def test_runs_split_the_draws():
    counts = np.array([50, 7, 0, 143])
    runs = [shard_runs(counts, 13, s, seed=3) for s in range(13)]
    for k in range(4):
        spans = sorted((int(start[k]), int(n[k])) for start, n in runs if n[k])
        at = 0
        for start, n in spans:
            assert start == at
            at += n
        assert at == counts[k]
    sizes = [int(n.sum()) for _, n in runs]
    assert sum(sizes) == 200 and max(sizes) - min(sizes) <= 4


def test_runs_are_hypergeometric():
    counts = np.array([600, 400])
    first = np.array([shard_runs(counts, 10, 0, seed=s)[1][0] for s in range(400)])
    assert first.mean() == pytest.approx(60, abs=1.2)
    assert first.var() == pytest.approx(100 * 0.6 * 0.4 * 900 / 999, rel=0.35)


@pytest.mark.parametrize("counts", [[3_000_000_000, 5, 0, 1_234_567_890], [10**12, 7 * 10**11, 1, 3 * 10**9]])
def test_runs_of_large_mixes(counts):
    """Populations beyond what the generator draws itself: shards are disjoint, complete, even and drawn at random."""
    runs = [shard_runs(np.array(counts), 13, s, seed=3) for s in range(13)]
    for k, c in enumerate(counts):
        at = 0
        for start, n in sorted((int(start[k]), int(n[k])) for start, n in runs if n[k]):
            assert start == at
            at += n
        assert at == c
    sizes = [int(n.sum()) for _, n in runs]
    assert sum(sizes) == sum(counts) and max(sizes) - min(sizes) <= 4
    p, total = counts[0] / sum(counts), sum(counts)
    spread = (total / 13 * p * (1 - p) * 12 / 13) ** 0.5
    assert all(abs(int(n[0]) - total / 13 * p) < 6 * spread for _, n in runs)


def test_large_draws_follow_the_distribution(monkeypatch):
    """The rejection draws against the generator's own on small populations."""
    monkeypatch.setattr(mixing, "_LARGE", 0)
    rng = np.random.default_rng(1)
    for good, bad, n in ((50, 30, 20), (3, 100, 50), (5000, 10, 4000), (10, 3, 9), (0, 5, 3), (5, 0, 3)):
        mine = np.bincount([hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1) / 20_000
        theirs = np.bincount(rng.hypergeometric(good, bad, n, size=200_000), minlength=n + 1) / 200_000
        assert np.abs(mine - theirs).max() < 0.02


@pytest.fixture(scope="module")
def docs(spark):
    # a source with a third of all texts, small ones, one without target, null and empty texts
    rows = [(i, "big" if i % 3 == 0 else "tiny" if i % 50 == 1 else "none" if i % 7 == 2 else f"s{i % 4}", None if i % 41 == 0 else "" if i % 43 == 0 else "some words of text " * (1 + i % 9), i) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, pass long").cache()


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.2, 1), ("tiny", 0.3, 3), ("s0", 0.2, 4), ("s1", 0.1, 2), ("s2", 0.1, 1), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")


def test_mix(spark, docs, targets):
    mix = Mix(docs, "doc_id", "text", "source", targets, block_tokens=200, shard_tokens=5000, bucket_rows=5)
    rows = mix.rows.cache()
    report = {r["source"]: r for r in mix.report().collect()}
    assert set(report) == {"big", "tiny", "s0", "s1", "s2", "absent"}
    assert {s for s, r in report.items() if r["short"]} == {"tiny", "absent"}
    longest = 40
    for s in ("big", "s0", "s1", "s2"):
        assert 2 * abs(report[s]["n_tokens"] - report[s]["target_share"] * mix.total) <= longest + 2
    assert report["tiny"]["n_tokens"] == 3 * report["tiny"]["source_tokens"] and report["absent"]["n_tokens"] == 0
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1)
    # a text is drawn at most once per pass and at most max_repeats times
    assert rows.count() == rows.select("doc_id", "repeat_no").distinct().count()
    most = {r[0]: r[1] for r in rows.groupBy("source").agg(F.max("repeat_no")).collect()}
    assert most["tiny"] == 2 and most["big"] == 0 and "none" not in most
    # every shard is whole, and close to its share in size and composition
    per = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.sum("n_tokens").alias("t"), F.avg((F.col("source") == "big").cast("int")).alias("b")).collect()
    assert len(per) == mix.shards and all(r["n"] == r["m"] for r in per)
    assert np.std([r["t"] for r in per]) < 0.25 * np.mean([r["t"] for r in per])
    again = Mix(docs.orderBy(F.desc("doc_id")), "doc_id", "text", "source", targets, block_tokens=200, shard_tokens=5000, bucket_rows=5)
    assert rows.exceptAll(again.rows).isEmpty()


def test_odd_rows(spark, docs, targets):
    empty = Mix(docs.filter("false"), "doc_id", "text", "source", targets)
    assert empty.rows.count() == 0 and empty.report().filter("n_tokens <> 0").isEmpty()
    nulls = Mix(docs.withColumn("source", F.lit(None).cast("string")), "doc_id", "text", "source", targets)
    assert nulls.rows.count() == 0 and nulls.total > 0 and nulls.report().filter("short").count() == 6
    assert Mix(docs, "doc_id", "text", "source", targets.filter("false")).rows.count() == 0
    with pytest.raises(ValueError):
        Mix(docs, "doc_id", "text", "source", targets.union(targets))
    with pytest.raises(ValueError):
        Mix(docs, "doc_id", "text", "source", targets, max_sources=2)
    one = Mix(spark.createDataFrame([(1, "big", "a very long text " * 20_000, 0)], docs.schema), "doc_id", "text", "source", targets)
    assert {r["source"] for r in one.report().filter("short").collect()} == {"tiny", "s0", "s1", "s2", "absent"}


def test_a_huge_text_does_not_blow_its_quota(spark):
    """One text larger than its source's whole quota stays out, the others fill it."""
    rows = [(i, "a", "some words of text " * 4) for i in range(400)] + [(1000, "a", "some words of text " * 30_000)] + [(2000 + i, "b", "other words " * 400) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = Mix(docs, "doc_id", "text", "source", spark.createDataFrame([("a", 0.01, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int"))
    a = mix.report().filter("source = 'a'").first()
    assert mix.rows.filter("doc_id = 1000").isEmpty() and abs(a["n_tokens"] - 0.01 * mix.total) <= 12
