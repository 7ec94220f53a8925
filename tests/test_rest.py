import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import pairlink as pl
from pairlink.operators import skew
from pairlink.operators.measures import confusion_frame
from pairlink.sources import annotation, febrl, generate, patterns
from pairlink.sources.generate import binary_vectors_local

NAMES = ["John", "Mary Ann", "billy", "Jonathan", "Gretha", "Micheal", "Sjors", None]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")


def mapped(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


# preprocessing


def test_clean(spark):
    df = column(spark, ["Mary-ann", "Bob :)", "Angel", "Bob (alias Billy)", "Mary  ann", "John", None])
    assert mapped(df, pl.clean("x")) == ["mary ann", "bob", "angel", "bob", "mary ann", "john", None]
    assert mapped(column(spark, ["bra(cke)ts", "brackets with (brackets)"]), pl.clean("x")) == ["brats", "brackets with"]
    for how in ("ascii", "unicode"):
        assert mapped(column(spark, ["ősdfésdfë", "without", None]), pl.clean("x", strip_accents=how)) == ["osdfesdfe", "without", None]
    assert mapped(column(spark, ["ab"]), pl.clean("x", strip_accents=lambda s: s + "c")) == ["abc"]
    assert mapped(column(spark, ["A  B", " nb  sp "]), pl.clean("x", lowercase=False, replace_by_none=None)) == ["A B", "nb sp"]
    with pytest.raises(ValueError):
        pl.clean("x", strip_accents="unknown")


def test_clean_bytes(spark):
    raw = [bytearray("Zo\u00eb-Ann".encode("latin-1")), bytearray(b"plain"), None]
    got = lambda **kw: mapped(column(spark, raw, "binary"), pl.clean("x", replace_by_none=None, **kw))
    assert got(encoding="latin-1") == ["zo\u00eb ann", "plain", None]
    assert got(encoding="utf-8", decode_error="ignore") == ["zo ann", "plain", None]
    assert got(encoding="utf-8", decode_error="replace") == ["zo\ufffd ann", "plain", None]
    with pytest.raises(Exception):
        got(encoding="utf-8")
    with pytest.raises(ValueError):
        pl.clean("x", decode_error="unknown")


def test_phone_numbers(spark):
    assert mapped(column(spark, ["0033612345678", "+1 201 123 4567", "+336-123 45678", None]), pl.phonenumbers("x")) == ["0033612345678", "+12011234567", "+33612345678", None]


def test_occurrence(spark):
    values = [None, None, "a", "a", "a", "a", "b", "c", "c", "a"]
    got = pl.value_occurence(column(spark, values), "x").orderBy("id").collect()
    assert [r["occurence"] for r in got] == [2, 2, 5, 5, 5, 5, 1, 2, 2, 5]


# The codes that these names must have, in the order of NAMES.
CODES = {
    "soundex": ["J500", "M650", "B400", "J535", "G630", "M240", "S620"],
    "nysiis": ["JAN", "MARYAN", "BALY", "JANATAN", "GRAT", "MACAL", "SJAR"],
    "metaphone": ["JN", "MRYN", "BL", "JN0N", "KR0", "MXL", "SJRS"],
    "match_rating": ["JHN", "MRYN", "BLY", "JNTHN", "GRTH", "MCHL", "SJRS"],
}


@pytest.mark.parametrize("method", CODES)
def test_phonetic(spark, method):
    got = dict(zip(NAMES, mapped(column(spark, NAMES), pl.phonetic("x", method))))
    assert [got[n] for n in NAMES if n is not None] == CODES[method]
    assert all(code is None for n, code in got.items() if n is None)
    assert method in pl.phonetic_algorithms
    with pytest.raises(ValueError):
        pl.phonetic("x", "unknown")


def test_old_names_warn(spark):
    from pairlink import standardise

    with pytest.warns(DeprecationWarning):
        assert mapped(column(spark, ["A-b"]), standardise.clean("x")) == ["a b"]


def test_submodules():
    from pairlink import adapters, compare, datasets, index, preprocessing

    assert index.Block is pl.Block and compare.Exact is pl.Exact and preprocessing.clean is pl.clean and datasets.binary_vectors is pl.binary_vectors and adapters.SKLearnAdapter is pl.SKLearnAdapter


# classifiers

M, U = [0.92, 0.81, 0.85, 0.90, 0.99, 0.70, 0.56], [0.19, 0.23, 0.50, 0.11, 0.20, 0.14, 0.50]
LABELS = ["name", "second_name", "surname", "dob", "street", "state", "zipcode"]


@pytest.fixture(scope="module")
def data(spark):
    v, links = pl.binary_vectors(spark, 5000, 1000, M, U, random_state=535, return_links=True)
    v = v.toDF("id_1", "id_2", *LABELS).cache()
    return v, links.cache()


@pytest.mark.parametrize("make", [pl.LogisticRegressionClassifier, pl.SVMClassifier, pl.NaiveBayesClassifier, pl.KMeansClassifier, pl.ECMClassifier])
def test_classifiers(data, make):
    v, links = data
    with pytest.raises(pl.NotFittedError):
        make().predict(v)
    with pytest.raises(ValueError):
        make().fit(v.filter("false"), links)
    c = make().fit(v, links)
    found = c.predict(v)
    assert pl.fscore(links, found) > 0.9
    with pl.option_context("classification.return_type", "series"):
        labelled = c.predict(v)
        assert labelled.columns[-1] == "classification" and labelled.count() == 5000
    with pl.option_context("classification.return_type", "array"):
        assert c.predict(v).sum() == found.count()
    if make in (pl.SVMClassifier, pl.KMeansClassifier):
        with pytest.raises(AttributeError):
            c.prob(v)
    else:
        low, high = c.prob(v).agg(F.min("prob"), F.max("prob")).first()
        assert 0 <= low <= high <= 1


def test_supervised_needs_matches(data):
    with pytest.raises(ValueError):
        pl.NaiveBayesClassifier().fit(data[0])
    with pytest.raises(ValueError):
        pl.NaiveBayesClassifier().fit(data[0], [(1, 2)])
    with pytest.raises(pl.LearningError):
        pl.NaiveBayesClassifier().fit(data[0], data[1].filter("false"))


def test_kmeans_golden(spark):
    """Centres learnt from one seeded set, matches counted in another."""
    sets = []
    for n, n_match in ((5_000, 1_000), (50_000, 10_000)):
        x, _ = binary_vectors_local(n, n_match, M, U, random_state=535)
        values, counts = np.unique(x, axis=0, return_counts=True)
        rows = [(i, *map(int, v), int(n)) for i, (v, n) in enumerate(zip(values, counts))]
        df = spark.createDataFrame(rows, "a int, " + ", ".join(f"{c} int" for c in LABELS) + ", n int")
        sets.append(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select("a", "k", *LABELS))
    assert pl.KMeansClassifier().fit(sets[0]).predict(sets[1]).count() == 11670


def test_ecm_recovers(spark):
    v = pl.binary_vectors(spark, 4000, 2000, [0.9, 0.85, 0.8, 0.9, 0.95, 0.9], [0.1] * 6, random_state=1)
    c = pl.ECMClassifier().fit(v)
    assert c.p == pytest.approx(0.5, abs=0.05)
    assert c.m_probs["c_2"][1] == pytest.approx(0.85, abs=0.05) and c.u_probs["c_2"][1] == pytest.approx(0.1, abs=0.05)
    shared = pl.ECMClassifier(max_patterns=1).fit(v)  # the same by grouped sums
    for f, levels in c.m_probs.items():
        for level, p in levels.items():
            assert shared.m_probs[f][level] == pytest.approx(p, abs=1e-6)
    with pytest.raises(ValueError):
        pl.ECMClassifier().fit(v.withColumn("c_1", F.col("c_1") + F.rand(1)))
    assert 0 < pl.ECMClassifier(init="random", seed=4).fit(v).p < 1


def test_naive_bayes_parameters(spark):
    rows = [(i, i, int(i < 40 if i < 50 else i >= 90)) for i in range(100)]
    v = spark.createDataFrame(rows, "a int, b int, x int")
    c = pl.NaiveBayesClassifier(use_col_names=False).fit(v, v.filter("a < 50").select("a", "b"))
    assert c.p == 0.5 and c.m_probs[0][1] == pytest.approx((40 + 1e-4) / (50 + 2e-4))
    assert c.weights[0][1] == pytest.approx(4, rel=1e-3) and c.log_weights[0][1] == pytest.approx(math.log(c.weights[0][1]))
    assert set(c.params_frame(spark).columns) == {"feature", "level", "m", "u", "weight"}
    assert pl.NaiveBayesClassifier(class_prior=[0.9, 0.1]).fit(v, v.select("a", "b").limit(9)).p == pytest.approx(0.1)
    with pytest.raises(ValueError):
        pl.NaiveBayesClassifier(alpha=-1).fit(v, v.select("a", "b"))


def test_given_parameters_need_no_fitting(spark, rows):
    v = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 2, 0.0, 1.0)], "a int, b int, x double, y double")
    assert rows(pl.LogisticRegressionClassifier([2.0, 1.0], -2.5).predict(v)) == [(1, 1)]
    assert rows(pl.KMeansClassifier([1, 1], [0, 0]).predict(v.withColumn("y", F.col("x")))) == [(1, 1)]
    assert rows(pl.sum_rule(v, 1)) == [(1, 1)]
    with pytest.raises(ValueError):
        pl.LogisticRegressionClassifier([1.0], 0).predict(v)


def stump():
    """A model whose class goes to the tasks with it."""

    class Stump:
        def fit(self, x, y=None):
            self.cut = float(x[:, 0].mean())

        def predict(self, x):
            return (x[:, 0] > self.cut).astype(int)

        def predict_proba(self, x):
            p = self.predict(x)
            return np.stack([1 - p, p], axis=1)

    return Stump()


def test_adapters(data):
    v, links = data
    local = pl.SKLearnAdapter(stump()).fit(v, links)
    assert local.predict(v).count() == v.filter("name = 1").count() == local.prob(v).filter("prob = 1").count()
    net = pl.KerasAdapter(stump()).fit(v, links)
    assert net.predict(v).count() == v.filter("name = 1").count()
    from pyspark.ml.classification import LogisticRegression

    ml = pl.SparkMLClassifier(LogisticRegression()).fit(v, links)
    assert pl.recall(links, ml.predict(v)) > 0.9 and ml.prob(v).count() == 5000
    with pytest.raises(ValueError):
        pl.DriverModelClassifier(stump(), max_rows=10).fit(v, links)


def test_adapter_of_more_rows_than_the_driver_takes(spark, rows):
    """Beyond max_rows a model learns from distinct vectors with their counts; to the means that is the same."""
    from pairlink.catalogue import _Centroid

    v = spark.range(300).selectExpr("id", "id + 1 as id2", "cast(id % 3 as double) as x", "if(id % 50 = 0, 9.0D, cast(id % 2 as double)) as y")
    matches = v.filter("id % 3 = 2 or id % 50 = 0").select("id", "id2")
    few, all_ = pl.DriverModelClassifier(_Centroid(), max_rows=30), pl.DriverModelClassifier(_Centroid())
    assert rows(few.fit_predict(v, matches)) == rows(all_.fit_predict(v, matches)) != []
    np.testing.assert_allclose(few.kernel.means, all_.kernel.means)
    with pytest.raises(ValueError, match="sample_weight"):
        pl.DriverModelClassifier(stump(), max_rows=30).fit(v, matches)
    with pytest.raises(ValueError, match="different"):
        few.fit(v.withColumn("x", v.id * 1.0), matches)


# links


def links(spark, pairs):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "a int, b int, o int")


def test_one_to_one(spark, rows):
    given = links(spark, [(1, 1), (2, 2), (3, 3), (3, 4), (3, 5), (4, 4), (5, 5), (6, 5), (7, 7), (7, 6), (7, 8)])
    assert rows(pl.OneToOneLinking().compute(given, "o")) == [(i, i) for i in (1, 2, 3, 4, 5, 7)]
    assert pl.OneToOneLinking().compute(given.filter("false")).count() == 0
    with pytest.raises(ValueError):
        pl.OneToOneLinking("unknown")
    with pytest.raises(TypeError):
        pl.OneToOneLinking().compute([(1, 2)])
    with pytest.raises(ValueError):
        pl.OneToOneLinking().compute(given.select("a"))


def test_one_to_one_equals_one_by_one(spark, rows):
    rng = np.random.default_rng(1)
    pairs = list(dict.fromkeys((int(a), int(b)) for a, b in rng.integers(0, 30, (120, 2))))
    used_a, used_b, want = set(), set(), []
    for a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b))
    assert rows(pl.OneToOneLinking().compute(links(spark, pairs), "o")) == sorted(want, key=str)


def test_chains_of_links_take_few_rounds(spark, rows):
    """Each link of the zigzag waits for the one before it; both ways of going on give the links of one by one."""
    zigzag = [(i, j) for i in range(60) for j in (i, i - 1) if j >= 0]
    given = spark.createDataFrame(zigzag, "a int, b int")
    linking = pl.OneToOneLinking()
    assert rows(linking.compute(given)) == sorted(((i, i) for i in range(60)), key=str)
    assert linking.rounds_run <= 2 * math.log2(len(zigzag)) + 4
    assert rows(pl.OneToOneLinking(component_links=5, rounds=1).compute(given.filter("a < 8"))) == sorted(((i, i) for i in range(8)), key=str)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1)], "a int, b int")
    assert rows(pl.OneToOneLinking().compute(odd)) == [(1, 1)]


def test_components_take_few_rounds(spark):
    """A path whose labels are bit-reversed, so that every second vertex is a local minimum."""
    label = [int(format(i, "07b")[::-1], 2) for i in range(65)]
    found = pl.ConnectedComponents()
    path = spark.createDataFrame([(label[i], label[i + 1]) for i in range(64)], "a int, b int")
    assert {r["component"] for r in found.compute(path).collect()} == {0}
    assert found.rounds_run <= 2 * math.log2(65) + 4


def test_models_stay_serialisable_after_iterative_operators(spark):
    """An Observation in the session would make the summary of a Spark ML model, which holds the session, fail in tasks."""
    from pyspark.ml.classification import LogisticRegression

    assert pl.ConnectedComponents().compute(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")).count() == 2
    x = spark.createDataFrame([(i, i, float(i % 2)) for i in range(40)], "id_1 int, id_2 int, c double")
    assert pl.SparkMLClassifier(LogisticRegression()).fit(x, x.filter("c = 1").select("id_1", "id_2")).prob(x).count() == 40


def test_components_of_odd_links(spark, rows):
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (5, 4), (4, 5)], "a int, b int")
    assert rows(pl.ConnectedComponents().compute(odd)) == sorted([(1, 1, 1), (3, 3, None), (4, 4, 5), (4, 5, 4), (4, 5, 4)], key=str)
    assert pl.ConnectedComponents().compute(odd.filter("false")).count() == 0


def test_one_to_many(spark, rows):
    given = links(spark, [(1, 1), (2, 2), (3, 3), (3, 4), (3, 5), (4, 4), (5, 5), (6, 5), (7, 7), (7, 7), (7, 8)])
    assert rows(pl.OneToManyLinking().compute(given, "o")) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert pl.OneToManyLinking(level=1).compute(given, "o").count() == 7


def test_components(spark, rows):
    got = rows(pl.ConnectedComponents().compute(links(spark, [(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (8, 9)]).select("a", "b")))
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (5, 5, 6), (5, 5, 7), (8, 8, 9)]
    tagged = pl.ConnectedComponents().compute(links(spark, [(1, 2), (2, 1)]).select("a", "b"), sides=True)
    assert tagged.select("component").distinct().count() == 2
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert pl.ConnectedComponents().compute(chain).select("component").distinct().count() == 1


# measures


def test_measures(spark):
    true = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int")
    pred = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (1, 2)], "a int, b int")
    m = pl.confusion_matrix(true, pred, 9)
    assert m.tolist() == [[1, 2], [3, 3]] and np.isnan(pl.confusion_matrix(true, pred)[1, 1])
    assert (pl.true_positives(true, pred), pl.false_positives(true, pred), pl.false_negatives(true, pred), pl.true_negatives(true, pred, 9)) == (1, 3, 2, 3)
    for source in ((true, pred), (m,), ([[1, 2], [3, 3]],)):
        assert pl.recall(*source) == pytest.approx(1 / 3) and pl.precision(*source) == 0.25 and pl.fscore(*source) == pytest.approx(2 / 7)
    assert pl.accuracy(true, pred, 9) == pytest.approx(4 / 9) and pl.specificity(m) == 0.5
    assert pl.full_index_size(10) == 45 and pl.full_index_size(10, 10) == pl.full_index_size((10, 10)) == 100
    assert pl.reduction_ratio(5, 10) == pytest.approx(8 / 9) and pl.reduction_ratio(25, 10, 10) == 0.75
    with pytest.raises(ValueError):
        pl.reduction_ratio(46, 10)
    with pytest.raises(ZeroDivisionError):
        pl.fscore(true, pred.filter("false"))
    with pytest.warns(DeprecationWarning):
        assert pl.max_pairs((10, 10)) == 100
    assert tuple(confusion_frame(true.filter("false"), pred.filter("false")).first()) == (0, 0, 0)


# options, logging


def test_options():
    assert pl.get_option("return_type") == pl.options.classification.return_type == "index"
    with pl.option_context("classification.return_type", "series"):
        assert pl.get_option("classification.return_type") == "series"
    pl.options.classification.return_type = "array"
    assert "[currently: array]" in pl.describe_option("classification")
    pl.reset_option("all")
    assert pl.get_option("classification.return_type") == "index"
    for bad in (("classification.return_type", "unknown"), ("classification.return_type",)):
        with pytest.raises(ValueError):
            pl.set_option(*bad)
    with pytest.raises(KeyError):
        pl.get_option("nowhere")
    pl.set_verbosity("ERROR")
    assert pl.get_verbosity() == 40


# sources


def test_febrl_files(spark, tmp_path, rows):
    (tmp_path / "dataset1.csv").write_text("rec_id, given_name, surname, postcode\nrec-1-org, ann, lee, 0123\nrec-1-dup-0, anne, , 0123\nrec-2-org, bob, roe, 0456\n")
    df, truth = pl.load_febrl1(spark, str(tmp_path), return_links=True)
    assert df.columns[0] == "rec_id" and df.filter("rec_id = 'rec-1-org'").first()["postcode"] == "0123" and df.filter("surname is null").count() == 1
    assert rows(truth) == [("rec-1-org", "rec-1-dup-0")]
    assert febrl.links_febrl4(spark).count() == 5000


def test_patterns(spark, tmp_path):
    home = tmp_path / "krebsregister"
    home.mkdir()
    head = "id1,id2," + ",".join(patterns.FEATURES) + ",is_match\n"
    (home / "block_1.csv").write_text(head + "1,2,0.5,?,1,?,1,1,1,1,0,TRUE\n3,4,0,?,0,?,1,1,1,1,0,FALSE\n")
    vectors, matches = pl.load_patterns(spark, str(tmp_path), block=1, missing_values=0.25)
    assert vectors.count() == 2 and [tuple(r) for r in matches.collect()] == [(1, 2)] and vectors.filter("cmp_firstname2 = 0.25").count() == 2
    with zipfile.ZipFile(home / "block_3.zip", "w") as archive:
        archive.writestr("block_3.csv", head + "5,6,0.5,?,1,?,1,1,1,1,0,TRUE\r\n7,8,0,?,0,?,1,1,1,1,?,FALSE\n")
    vectors, matches = pl.load_patterns(spark, str(tmp_path), block=[1, 3], shuffle=False)
    assert sorted(r["id1"] for r in vectors.collect()) == [1, 3, 5, 7] and matches.count() == 2
    assert vectors.filter("id1 = 7 and cmp_zipcode is null and cmp_lastname1 = 0").count() == 1
    with pytest.raises(ValueError):
        pl.load_patterns(spark, str(tmp_path), block=11)
    with pytest.raises(FileNotFoundError):
        pl.load_patterns(spark, str(tmp_path), block=2)
    assert pl.get_data_home(str(tmp_path / "new")).endswith("new")
    pl.clear_data_home(str(tmp_path / "new"))
    assert not (tmp_path / "new").exists()


def test_binary_vectors(spark):
    v, truth = generate.binary_vectors(spark, 1000, 200, [0.9, 0.5], [0.1, 0.5], random_state=1, return_links=True)
    assert v.count() == 1000 and truth.count() == 200 and v.schema["c_1"].dataType.simpleString() == "tinyint"
    assert v.join(truth, ["id_1", "id_2"]).agg(F.avg("c_1")).first()[0] > 0.8
    for bad in ((10, 10, [0.5], [0.5]), (10, 2, [0.5], [0.5, 0.5])):
        with pytest.raises(ValueError):
            generate.binary_vectors(spark, *bad)


def test_annotation_round_trip(spark, tmp_path, rows):
    people = spark.createDataFrame([("a", "Ann", 1.5), ("b", None, 2.0), ("c", "Cy", None)], "id string, name string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "x string, y string")
    path = str(tmp_path / "doc.json")
    pl.write_annotation_file(path, pairs, pl.RecordSet(people, "id"), dataset_a_name="people")
    document = json.load(open(path))
    assert document["version"] == 1 and len(document["pairs"]) == 3 and document["pairs"][0]["identifiers"]["a"]["dataset"] == "people"
    assert {f["a"]["type"] for p in document["pairs"] for f in p["fields"]} == {"String"} and "similarity" in document["pairs"][0]["fields"][0]
    got = pl.read_annotation_file(spark, path)
    assert got.links is None and got.distinct is None and got.unknown.count() == 3
    for p, label in zip(document["pairs"], (1, 0)):
        p["label"] = label
    json.dump(document, open(path, "w"))
    got = pl.read_annotation_file(spark, path)
    assert got.links.count() == got.distinct.count() == got.unknown.count() == 1
    with pytest.raises(ValueError):
        annotation.write_annotation_file(path, pairs, pl.RecordSet(people, "id"), max_pairs=2)


# popular keys


def brute_timeline(data):
    out = {}
    for key in {k for k, _ in data}:
        times = sorted(t for k, t in data if k == key and t is not None)
        n = sum(k == key for k, _ in data)
        gaps = [b - a for a, b in zip(times, times[1:])]
        out[key] = (n, times[0] if times else None, times[-1] if times else None, max(gaps, default=0))
    return out


def test_heavy_keys_and_timeline(spark):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 11}", None if i % 13 == 0 else int(rng.integers(0, 10**9))) for i in range(3000)]
    data += data[:50]  # repeated rows, ties
    df = spark.createDataFrame([(k, t, i % 5) for i, (k, t) in enumerate(data)], "key string, t long, n_rows int")  # a column named like an output
    df = df.withColumn("at", F.timestamp_micros("t"))
    got = skew.balanced_timeline(df, ["key"], "at", ["t"], partitions=7).select("key", "n_rows", F.unix_micros("first_at"), F.unix_micros("last_at"), "longest_gap").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_timeline(data)
    sums = {r["key"]: (r["n"], r["s"]) for r in skew.balanced_aggregate(df, ["key"], {"n": ("count", None), "s": ("sum", "t")}, ["at"], partitions=7).collect()}
    for key, (n, total) in sums.items():
        mine = [t for k, t in data if k == key]
        assert n == len(mine) and total == sum(t for t in mine if t is not None)
    assert [r["key"] for r in skew.heavy_keys(df, "key", 0.5, ["at"]).collect()] == ["hot"]
    with pytest.raises(ValueError):
        skew.balanced_aggregate(df, ["key"], {"n": ("median", "t")})


def test_share_is_exact(spark):
    df = spark.range(700).select(F.when(F.col("id") < 7, F.lit("just")).when(F.col("id") < 13, F.lit("less")).otherwise(F.col("id").cast("string")).alias("k"))
    assert [r["k"] for r in skew.heavy_keys(df, "k", 0.01).collect()] == ["just"]


def test_heavy_key_is_split_over_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    sizes = [r["count"] for r in skew.range_partitioned(df, ["k"], ["id"], partitions=8).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 20_000 / 8


def test_popular_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, at timestamp")
    assert skew.heavy_keys(empty, "key", 0.01).count() == 0
    assert skew.balanced_timeline(empty, ["key"], "at").count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "key string, at timestamp")
    assert skew.heavy_keys(nulls, "key", 0.01).count() == 0
    assert skew.balanced_timeline(nulls, ["key"], "at").first()["n_rows"] == 3
