"""The registered core queries and their SQL, in the form the driver reads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlink.functions import clean as cl
from pairlink.functions.phonetic import phonetic
from pairlink.operators import classify, features, indexing, measures, resolve, skew
from pairlink.operators.compare import Compare
from pairlink.plans.linkage import block_and_compare
from pairlink.records import RecordSet
from pairlink.scratch import Scratch
from pairlink.sources import annotation, febrl, generate
from pairlink.streaming.incremental import stream_link

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str, name: str) -> RecordSet:
    df = table(spark, folder, name)
    return RecordSet(df, df.columns[0])


def six(df: DataFrame, *names: str) -> DataFrame:
    """The named columns rounded to six decimals, as both engines compare them."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + 0.0 for n in names})


# --- indexing ---------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, r_regionkey FROM nation, region")
def idx_full_link(spark, folder):
    return indexing.Full().index(records(spark, folder, "nation"), records(spark, folder, "region"))


@query("SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2 FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey")
def idx_full_dedup(spark, folder):
    return indexing.Full().index(records(spark, folder, "supplier"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def idx_block_link(spark, folder):
    return indexing.Block("c_nationkey", "s_nationkey").index(records(spark, folder, "customer"), records(spark, folder, "supplier"))


CUSTOMER_PAIRS = """customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey > b.c_custkey"""


def customer_pairs(spark, folder) -> tuple[RecordSet, DataFrame]:
    c = records(spark, folder, "customer")
    return c, indexing.Block(["c_nationkey", "c_mktsegment"]).index(c)


@query(f"SELECT a.c_custkey AS c_custkey_1, b.c_custkey AS c_custkey_2 FROM {CUSTOMER_PAIRS}")
def idx_block_dedup_multi(spark, folder):
    return customer_pairs(spark, folder)[1]


@query("""WITH k AS (SELECT v, dense_rank() OVER (ORDER BY v) AS r FROM (SELECT DISTINCT c_acctbal AS v FROM customer UNION SELECT DISTINCT s_acctbal FROM supplier))
SELECT c_custkey, s_suppkey FROM customer JOIN k x ON x.v = c_acctbal JOIN k y ON abs(x.r - y.r) <= 1 JOIN supplier ON s_acctbal = y.v""")
def idx_sni_link(spark, folder):
    return indexing.SortedNeighbourhood("c_acctbal", "s_acctbal", window=3).index(records(spark, folder, "customer"), records(spark, folder, "supplier"))


@query("""WITH k AS (SELECT p_partkey, p_retailprice, dense_rank() OVER (ORDER BY p_retailprice) AS r FROM part WHERE p_retailprice IS NOT NULL)
SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2 FROM k a JOIN k b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND a.p_partkey > b.p_partkey""")
def idx_sni_dedup(spark, folder):
    return indexing.SortedNeighbourhood("p_retailprice", window=5).index(records(spark, folder, "part"))


@query("""WITH k AS (SELECT p_partkey, p_brand, p_retailprice, dense_rank() OVER (ORDER BY p_retailprice) AS r FROM part WHERE p_retailprice IS NOT NULL)
SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2 FROM k a JOIN k b ON a.p_brand = b.p_brand AND b.r BETWEEN a.r - 4 AND a.r + 4 AND a.p_partkey > b.p_partkey""")
def idx_sni_blocked(spark, folder):
    return indexing.SortedNeighbourhood("p_retailprice", window=9, block_on="p_brand").index(records(spark, folder, "part"))


@query("""WITH k(v, r) AS (VALUES (4, 0), (2, 1), (0, 2), (1, 3), (3, 4))
SELECT a.n_nationkey AS n_nationkey_1, b.n_nationkey AS n_nationkey_2 FROM nation a JOIN k x ON x.v = a.n_regionkey JOIN k y ON abs(x.r - y.r) <= 1
JOIN nation b ON b.n_regionkey = y.v AND a.n_nationkey > b.n_nationkey""")
def idx_sni_given_order(spark, folder):
    return indexing.SortedNeighbourhood("n_regionkey", window=3, sorting_key_values=[4, 2, 0, 1, 3]).index(records(spark, folder, "nation"))


@query("""SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2 FROM part a JOIN part b
ON a.p_brand = b.p_brand AND (a.p_type = b.p_type OR a.p_size = b.p_size) AND a.p_partkey > b.p_partkey""")
def idx_union(spark, folder):
    return indexing.Index().block(["p_brand", "p_type"]).block(["p_brand", "p_size"]).index(records(spark, folder, "part"))


@query("""WITH k AS (SELECT *, dense_rank() OVER (ORDER BY p_size) AS r FROM part)
SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2 FROM k a JOIN k b ON a.p_partkey > b.p_partkey AND
(CASE WHEN a.p_brand = b.p_brand THEN 1 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END + CASE WHEN abs(a.r - b.r) <= 1 THEN 1 ELSE 0 END) >= 2""")
def idx_neighbourhood(spark, folder):
    part = records(spark, folder, "part")
    return indexing.NeighbourhoodBlock(["p_brand", "p_type", "p_size"], max_non_matches=1, windows=[1, 1, 3]).index(part)


# A draw is checked by what holds for each: its size, that its ids exist, that pairs are ordered and, without
# replacement, different.


@query("SELECT 2500::BIGINT AS n_rows, 2500::BIGINT AS n_known")
def idx_random_link(spark, folder):
    drawn = indexing.Random(2500, random_state=1).index(records(spark, folder, "customer"), records(spark, folder, "supplier"))
    known = drawn.join(table(spark, folder, "customer").select("c_custkey"), "c_custkey").join(table(spark, folder, "supplier").select("s_suppkey"), "s_suppkey")
    return drawn.agg(F.count("*").alias("n_rows")).join(known.agg(F.count("*").alias("n_known")))


@query("SELECT 40::BIGINT AS n_rows, 40::BIGINT AS n_different, 40::BIGINT AS n_ordered")
def idx_random_dedup(spark, folder):
    drawn = indexing.Random(40, replace=False, random_state=1).index(records(spark, folder, "supplier"))
    one, two = drawn.columns
    return drawn.agg(F.count("*").alias("n_rows"), F.count_distinct(one, two).alias("n_different"), F.count_if(F.col(one) > F.col(two)).alias("n_ordered"))


@query("SELECT n_nationkey_1, n_nationkey_2, (ntile(7) OVER (ORDER BY n_nationkey_1, n_nationkey_2) - 1)::INT AS chunk FROM (SELECT a.n_nationkey AS n_nationkey_1, b.n_nationkey AS n_nationkey_2 FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey)")
def idx_split(spark, folder):
    return indexing.with_chunks(indexing.Full().index(records(spark, folder, "nation")), 7)


# --- comparing --------------------------------------------------------------------------------------------------------

PART_PAIRS = "part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey > b.p_partkey"
PART_IDS = "a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2"
CUSTOMER_IDS = "a.c_custkey AS c_custkey_1, b.c_custkey AS c_custkey_2"


def part_features(spark, folder, compare: Compare) -> DataFrame:
    return block_and_compare(indexing.Block(["p_brand", "p_size"]), compare, records(spark, folder, "part"))


def customer_features(spark, folder, compare: Compare, sum_above: float | None = None) -> DataFrame:
    return block_and_compare(indexing.Block(["c_nationkey", "c_mktsegment"]), compare, records(spark, folder, "customer"), sum_above=sum_above)


@query(f"SELECT {PART_IDS}, CASE WHEN a.p_type IS NULL OR b.p_type IS NULL THEN 0.0 WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END::DOUBLE AS same FROM {PART_PAIRS}")
def cmp_exact(spark, folder):
    return part_features(spark, folder, Compare().exact("p_type", "p_type", label="same"))


@query(f"SELECT {PART_IDS}, CASE WHEN a.p_type = b.p_type THEN a.p_type ELSE 'differs' END AS same FROM {PART_PAIRS}")
def cmp_exact_value(spark, folder):
    return part_features(spark, folder, Compare().exact("p_type", "p_type", agree_value="value", disagree_value="differs", label="same"))


PERSON_PAIRS = "person_a a JOIN person_b b ON a.surname = b.surname"
PERSON_IDS = "a.rec_id AS rec_id_1, b.rec_id AS rec_id_2"


def person_features(spark, folder, compare: Compare, sum_above: float | None = None) -> DataFrame:
    return block_and_compare(indexing.Block("surname"), compare, records(spark, folder, "person_a"), records(spark, folder, "person_b"), sum_above)


@query(f"SELECT {PERSON_IDS}, CASE WHEN a.place IS NULL OR b.placename IS NULL THEN 'unknown' WHEN a.place = b.placename THEN '1.0' ELSE '0.0' END AS same FROM {PERSON_PAIRS}")
def cmp_exact_missing(spark, folder):
    return person_features(spark, folder, Compare().exact("place", "placename", missing_value="unknown", label="same"))


def text_query(method: str, sql: str, threshold: float | None = None, on: str = "p_name") -> Query:
    def run(spark, folder):
        return six(part_features(spark, folder, Compare().string(on, on, method, threshold, label="sim")), "sim")

    run.__name__ = f"cmp_{method}" + ("_threshold" if threshold else "")
    return query(f"SELECT {PART_IDS}, round(({sql})::DOUBLE, 6) AS sim FROM {PART_PAIRS}" if sql else None)(run)


_LEV = "1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE"
text_query("levenshtein", _LEV)
text_query("levenshtein", f"CASE WHEN {_LEV} >= 0.5 THEN 1 ELSE 0 END", 0.5)
text_query("damerau_levenshtein", "1 - damerau_levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE")
text_query("jaro", "jaro_similarity(a.p_name, b.p_name)")
text_query("jarowinkler", "jaro_winkler_similarity(a.p_name, b.p_name)")


def _smith_waterman_sql() -> str:
    """The alignment matrix row by row: match 5, mismatch and first gap -5, a longer gap -1, scaled by the mean length."""
    diagonal = "r.row[j] + CASE WHEN substr(x, i::INT, 1) = substr(y, j::INT, 1) THEN 5.0 ELSE -5.0 END"
    across, below = "r.row[j + 1] + CASE WHEN r.wide[j + 1] THEN -1.0 ELSE -5.0 END", "s.row[j] + CASE WHEN s.tall THEN -1.0 ELSE -5.0 END"
    best = f"greatest({diagonal}, {across}, {below})"
    cell = f"{{'row': list_append(s.row, greatest({best}, 0.0)::DOUBLE), 'wide': list_append(s.wide, {best} > 0 AND {best} = {across}), 'tall': {best} > 0 AND {best} = {below}, 'best': greatest(s.best, {best})::DOUBLE}}"
    first = "{'row': [0.0::DOUBLE], 'wide': [false], 'tall': false, 'best': r.best}"
    start = "{'row': list_transform(range(0, length(y) + 1), lambda k: 0.0::DOUBLE), 'wide': list_transform(range(0, length(y) + 1), lambda k: false), 'tall': false, 'best': 0.0::DOUBLE}"
    score = f"list_reduce(range(1, length(x) + 1), lambda r, i: list_reduce(range(1, length(y) + 1), lambda s, j: {cell}, {first}), {start}).best"
    return f"""WITH v AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM {PART_PAIRS}), m AS (SELECT x, y, {score} / (5 * (length(x) + length(y)) / 2.0) AS sim FROM v)
SELECT {PART_IDS}, round(m.sim::DOUBLE, 6) AS sim FROM {PART_PAIRS} JOIN m ON m.x = a.p_name AND m.y = b.p_name"""


def _lcs_sql() -> str:
    """Common substrings of two characters or more, taken out one after the other, the longest and then the first in front."""
    found = "list_max(list_filter(flatten(list_transform(range(1, length(x)), lambda i: list_transform(range(2, length(x) - i + 2), lambda k: {'k': k, 'i': -i}))), lambda c: contains(y, substr(x, (-c.i)::INT, c.k::INT))))"
    return f"""WITH RECURSIVE v AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM {PART_PAIRS}), o AS (SELECT x, y FROM v UNION SELECT y, x FROM v),
r(x0, y0, x, y, n, c) AS (SELECT x, y, x, y, 0, {found} FROM o UNION ALL SELECT x0, y0, x, y, n, {found} FROM (SELECT x0, y0, n + c.k::INT AS n, substr(x, 1, (-c.i - 1)::INT) || substr(x, (c.k - c.i)::INT) AS x,
 substr(y, 1, position(substr(x, (-c.i)::INT, c.k::INT) IN y) - 1) || substr(y, (position(substr(x, (-c.i)::INT, c.k::INT) IN y) + c.k)::INT) AS y FROM r WHERE c IS NOT NULL)),
m AS (SELECT x0, y0, max(n) AS n FROM r GROUP BY ALL)
SELECT {PART_IDS}, round(((s.n + t.n)::DOUBLE / (length(a.p_name) + length(b.p_name))), 6) AS sim FROM {PART_PAIRS}
JOIN m s ON s.x0 = a.p_name AND s.y0 = b.p_name JOIN m t ON t.x0 = b.p_name AND t.y0 = a.p_name"""


for _method, _sql in (("smith_waterman", _smith_waterman_sql()), ("lcs", _lcs_sql())):

    def _aligned(spark, folder, method=_method):
        return six(part_features(spark, folder, Compare().string("p_name", "p_name", method, label="sim")), "sim")

    _aligned.__name__ = f"cmp_{_method}"
    query(_sql)(_aligned)

_GRAMS = """WITH w AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS t FROM part), g AS (SELECT p_partkey, unnest(list_transform(range(1, length(t) + 2), lambda i: substr(' ' || t || ' ', i::INT, 2))) AS x FROM w WHERE t <> ''),
c AS (SELECT p_partkey, x, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT p_partkey, sum(n)::DOUBLE AS total, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
p AS (SELECT a.p_partkey AS i, b.p_partkey AS j FROM """ + PART_PAIRS + "), m AS (SELECT i, j, sum(least(x.n, y.n)) AS both_n, sum(x.n * y.n) AS dot FROM p JOIN c x ON x.p_partkey = i JOIN c y ON y.p_partkey = j AND x.x = y.x GROUP BY ALL) "


@query(_GRAMS + "SELECT p.i AS p_partkey_1, p.j AS p_partkey_2, round(coalesce(both_n, 0)::DOUBLE / greatest(u.total, v.total), 6) AS sim FROM p LEFT JOIN m USING (i, j) JOIN s u ON u.p_partkey = p.i JOIN s v ON v.p_partkey = p.j")
def cmp_qgram(spark, folder):
    return six(part_features(spark, folder, Compare().string("p_name", "p_name", "qgram", label="sim")), "sim")


@query(_GRAMS + "SELECT p.i AS p_partkey_1, p.j AS p_partkey_2, round(coalesce(dot, 0)::DOUBLE / (u.norm * v.norm), 6) AS sim FROM p LEFT JOIN m USING (i, j) JOIN s u ON u.p_partkey = p.i JOIN s v ON v.p_partkey = p.j")
def cmp_cosine(spark, folder):
    return six(part_features(spark, folder, Compare().string("p_name", "p_name", "cosine", label="sim")), "sim")


_GAP = "abs(b.s_acctbal - a.s_acctbal)"


@query(f"""SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2, round(1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name))::DOUBLE, 6) AS lev,
round(jaro_similarity(a.s_name, b.s_name), 6) AS jaro, round(jaro_winkler_similarity(a.s_name, b.s_name), 6) AS jw, CASE WHEN a.s_nationkey = b.s_nationkey THEN 1.0 ELSE 0.0 END::DOUBLE AS nation,
round((1 - least({_GAP}, 2000) / 2000)::DOUBLE, 6) AS near, round(pow(2, -pow({_GAP} / 1000, 2)), 6) AS nearer FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey""")
def cmp_full_dedup(spark, folder):
    """Every pair of a table with six features: 499,500 pairs at scale 0.1."""
    suppliers = records(spark, folder, "supplier")
    compare = Compare().string("s_name", "s_name", label="lev").string("s_name", "s_name", "jaro", label="jaro").string("s_name", "s_name", "jarowinkler", label="jw")
    compare.exact("s_nationkey", "s_nationkey", label="nation").numeric("s_acctbal", "s_acctbal", "linear", scale=1000, label="near").numeric("s_acctbal", "s_acctbal", "gauss", scale=1000, label="nearer")
    return six(compare.compute(indexing.Full().index(suppliers), suppliers), "lev", "jaro", "jw", "near", "nearer")


_D = "abs(b.c_acctbal - a.c_acctbal)"
for _method, _sql in {
    "step": f"CASE WHEN {_D} <= 100 THEN 1 ELSE 0 END",
    "linear": f"1 - least(greatest({_D} - 100, 0), 2000) / 2000",
    "squared": f"1 - 0.5 * pow(least(greatest({_D} - 100, 0), sqrt(2) * 1000) / 1000, 2)",
    "exp": f"pow(2, -greatest({_D} - 100, 0) / 1000)",
    "gauss": f"pow(2, -pow(greatest({_D} - 100, 0) / 1000, 2))",
}.items():

    def _numeric(spark, folder, method=_method):
        return six(customer_features(spark, folder, Compare().numeric("c_acctbal", "c_acctbal", method, offset=100, scale=1000, label="sim")), "sim")

    _numeric.__name__ = f"cmp_num_{_method}"
    query(f"SELECT {CUSTOMER_IDS}, round(({_sql})::DOUBLE, 6) AS sim FROM {CUSTOMER_PAIRS}")(_numeric)


_HAVERSINE = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal / 200 AS lat, s_suppkey % 360 - 180.0 AS lng FROM supplier)
SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2, round(pow(2, -({_HAVERSINE}) / 500), 6) AS sim FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey > b.s_suppkey""")
def cmp_geo(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 200).alias("lat"), (F.col("s_suppkey") % 360 - F.lit(180.0)).alias("lng"))
    compare = Compare().geo("lat", "lng", "lat", "lng", method="exp", scale=500, label="sim")
    return six(block_and_compare(indexing.Block("s_nationkey"), compare, RecordSet(s, "s_suppkey")), "sim")


_SAME = "year(a.dob) = year(b.date_of_birth)"


@query(f"""SELECT {PERSON_IDS}, (CASE WHEN a.dob IS NULL OR b.date_of_birth IS NULL THEN -1 WHEN a.dob = b.date_of_birth THEN 1
WHEN {_SAME} AND day(a.dob) = day(b.date_of_birth) AND (month(a.dob), month(b.date_of_birth)) IN ((6, 7), (7, 6), (9, 10), (10, 9)) THEN 0.5
WHEN {_SAME} AND month(a.dob) = day(b.date_of_birth) AND day(a.dob) = month(b.date_of_birth) THEN 0.5 ELSE 0 END)::DOUBLE AS sim FROM {PERSON_PAIRS}""")
def cmp_date(spark, folder):
    return person_features(spark, folder, Compare().date("dob", "date_of_birth", missing_value=-1, label="sim"))


@query(f"SELECT {PERSON_IDS}, coalesce(a.income, 0)::DOUBLE AS income_1, coalesce(b.income, 0)::DOUBLE AS income_2 FROM {PERSON_PAIRS}")
def cmp_variable(spark, folder):
    return person_features(spark, folder, Compare([features.VariableA("income", label="income_1"), features.VariableB("income", label="income_2")]))


@query(f"""WITH p AS (SELECT {PERSON_IDS}, a.place, b.placename FROM {PERSON_PAIRS})
SELECT rec_id_1, rec_id_2, CASE WHEN place IS NULL THEN 0 ELSE round(count(*) OVER (PARTITION BY place) / (count(*) OVER ())::DOUBLE, 6) END::DOUBLE AS share,
CASE WHEN placename IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY placename) END::DOUBLE AS n FROM p""")
def cmp_frequency(spark, folder):
    compare = Compare([features.FrequencyA("place", label="share"), features.FrequencyB("placename", normalise=False, label="n")])
    return six(person_features(spark, folder, compare), "share")


@query(f"""WITH p AS (SELECT {PERSON_IDS}, a.income AS x, b.income AS y, a.place, b.placename FROM {PERSON_PAIRS})
SELECT rec_id_1, rec_id_2, coalesce(x, -1)::DOUBLE AS income_1, coalesce(y, -1)::DOUBLE AS income_2, CASE WHEN place IS NULL THEN -1 ELSE round(count(*) OVER (PARTITION BY place) / (count(*) OVER ())::DOUBLE, 6) END::DOUBLE AS share_1,
CASE WHEN placename IS NULL THEN -1 ELSE round(count(*) OVER (PARTITION BY placename) / (count(*) OVER ())::DOUBLE, 6) END::DOUBLE AS share_2 FROM p""")
def cmp_variable_frequency(spark, folder):
    """Both sides of a pair through one feature each."""
    compare = Compare([features.Variable("income", "income", -1, label=["income_1", "income_2"]), features.Frequency("place", "placename", missing_value=-1, label=["share_1", "share_2"])])
    return six(person_features(spark, folder, compare), "share_1", "share_2")


@query(f"""SELECT {PERSON_IDS}, coalesce(length(a.place) - length(b.placename), 0)::BIGINT AS longer, coalesce(a.income / b.income, 0)::DOUBLE AS ratio FROM {PERSON_PAIRS}""")
def cmp_vectorized_series(spark, folder):
    """A user's function of pandas Series with two outputs."""

    def both(place_a, income_a, place_b, income_b):
        return (place_a.str.len() - place_b.str.len()).fillna(0).astype("int64"), (income_a / income_b).fillna(0)

    return person_features(spark, folder, Compare().compare_vectorized(both, ["place", "income"], ["placename", "income"], label=["longer", "ratio"]))


@query(f"SELECT {PERSON_IDS}, coalesce(abs(year(a.dob) - year(b.date_of_birth)), -1)::INT AS years, coalesce(a.sex = upper(left(b.gender, 1)), false) AS same_sex FROM {PERSON_PAIRS}")
def cmp_vectorized(spark, folder):
    def both(born_a: Column, sex: Column, born_b: Column, gender: Column) -> list[Column]:
        return [F.coalesce(F.abs(F.year(born_a) - F.year(born_b)), F.lit(-1)), F.coalesce(sex == F.upper(F.substring(gender, 1, 1)), F.lit(False))]

    return person_features(spark, folder, Compare().compare_vectorized(both, ["dob", "sex"], ["date_of_birth", "gender"], label=["years", "same_sex"]))


@query(f"SELECT count(*) AS n_rows, count(*) AS n_between, count(*) AS n_listed FROM {CUSTOMER_PAIRS}")
def cmp_random(spark, folder):
    drawn = customer_features(spark, folder, Compare([features.RandomContinuous(1, 2, "u", 1), features.RandomDiscrete([1, 5], label="v", random_state=2)]))
    return drawn.agg(F.count("*").alias("n_rows"), F.count_if(F.col("u").between(1, 2)).alias("n_between"), F.count_if(F.col("v").isin(1, 5)).alias("n_listed"))


# --- preprocessing ----------------------------------------------------------------------------------------------------


@query(r"""SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name_a), '(\[.*?\]|\(.*?\)|\{.*?\})', '', 'g'), '[^ \-\_A-Za-z0-9]+', '', 'g'), '[\-\_]', ' ', 'g'), '\s\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS name
FROM name_entries""")
def prep_clean(spark, folder):
    return table(spark, folder, "name_entries").select("entry_id", cl.clean("name_a").alias("name"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def prep_accents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", cl.strip_accents(F.col("text")).alias("text"))


@query(r"SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(replace(name_a, chr(160), ' '), chr(12288), ' ')), '[^\x00-\x7F]', '', 'g'), '\s\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS name FROM name_entries")
def prep_accents_ascii(spark, folder):
    return table(spark, folder, "name_entries").select("entry_id", cl.clean("name_a", lowercase=False, replace_by_none=None, replace_by_whitespace=None, remove_brackets=False, strip_accents="ascii").alias("name"))


@query("SELECT addr_id, regexp_replace(street_number, '[^0-9+]+', '', 'g') AS number FROM address_records")
def prep_phone(spark, folder):
    return table(spark, folder, "address_records").select("addr_id", cl.phonenumbers("street_number").alias("number"))


@query("SELECT rec_id, loaded_at, surname, count(*) OVER (PARTITION BY surname) AS n FROM febrl_records")
def prep_occurrence(spark, folder):
    records_ = table(spark, folder, "febrl_records").select("rec_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), "surname")
    return cl.value_occurence(records_, "surname", "n")


def _singles(sql: str, letters: str) -> str:
    """Runs of a letter become one."""
    for c in letters:
        sql = f"regexp_replace({sql}, '{c}{c}+', '{c}', 'g')"
    return sql


_LETTERS = "upper(regexp_replace(surname, '[-_\\s]', '', 'g'))"
#: Letters of one sound under one digit, 0 for vowels (and what is no letter); h and w are passed over.
_SOUNDS = "translate(left(w, 1) || regexp_replace(regexp_replace(substr(w, 2), '[HW]', '', 'g'), '[^A-Z]', 'A', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
_PHONETIC_SQL = {
    "soundex": f"""WITH w AS (SELECT rec_id, surname, {_LETTERS} AS w FROM febrl_records)
SELECT rec_id, surname, CASE WHEN w = '' THEN '' WHEN NOT regexp_matches(w, '^[A-Z]') THEN w ELSE left(w, 1) || left(replace(substr({_singles(_SOUNDS, '123456')}, 2), '0', '') || '000', 3) END AS code FROM w""",
    "match_rating": f"""WITH w AS (SELECT rec_id, surname, {_LETTERS} AS w FROM febrl_records), c AS (SELECT rec_id, surname, {_singles("left(w, 1) || regexp_replace(substr(w, 2), '[AEIOU]', '', 'g')", 'BCDFGHJKLMNPQRSTVWXYZ')} AS c FROM w)
SELECT rec_id, surname, CASE WHEN length(c) > 6 THEN left(c, 3) || right(c, 3) ELSE c END AS code FROM c""",
}

for _method in ("soundex", "nysiis", "metaphone", "match_rating"):

    def _phonetic(spark, folder, method=_method):
        return table(spark, folder, "febrl_records").select("rec_id", "surname", phonetic("surname", method).alias("code"))

    _phonetic.__name__ = f"prep_{_method}"
    query(_PHONETIC_SQL.get(_method))(_phonetic)


# --- classifiers ------------------------------------------------------------------------------------------------------

SCORES = ["cmp_firstname1", "cmp_lastname1", "cmp_sex", "cmp_birthday", "cmp_birthmonth", "cmp_birthyear", "cmp_zipcode"]


def vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The compared pairs with a 0 for what wasn't compared, and the pairs judged to match."""
    rows = table(spark, folder, "comparison_pairs")
    return rows.select("id1", "id2", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in SCORES)), rows.filter("is_match").select("id1", "id2")


def _summed(weights: list[float]) -> str:
    return " + ".join(f"{w} * coalesce({c}, 0)" for c, w in zip(SCORES, weights))


@query(f"SELECT id1, id2 FROM comparison_pairs WHERE {_summed([1] * 7)} > 5")
def clf_sum_rule(spark, folder):
    return classify.sum_rule(vectors(spark, folder)[0], 5)


_WEIGHTS = [2.0, 3.0, 0.5, 1.0, 1.0, 1.5, 1.0]


@query(f"SELECT id1, id2, round(1 / (1 + exp(-({_summed(_WEIGHTS)} - 6.25))), 6) AS prob FROM comparison_pairs")
def clf_logistic_manual(spark, folder):
    return six(classify.LogisticRegressionClassifier(_WEIGHTS, -6.25).prob(vectors(spark, folder)[0]), "prob")


@query("""WITH v AS (SELECT id1, id2, """ + ", ".join(f"CASE WHEN {c} > 0.5 THEN 1 ELSE 0 END AS {c}" for c in SCORES) + """ FROM comparison_pairs),
l AS (SELECT v.*, CASE WHEN m.id1 IS NULL THEN 0 ELSE 1 END AS y FROM v LEFT JOIN (SELECT DISTINCT id1, id2 FROM comparison_pairs WHERE is_match) m ON v.id1 = m.id1 AND v.id2 = m.id2),
t AS (SELECT sum(y)::DOUBLE AS m, sum(1 - y)::DOUBLE AS u FROM l), """
+ ", ".join(f"f{i} AS (SELECT {c} AS x, ln((sum(y) + 0.0001) / (m + 0.0002)) - ln((sum(1 - y) + 0.0001) / (u + 0.0002)) AS w FROM l, t GROUP BY {c}, m, u)" for i, c in enumerate(SCORES))
+ " SELECT id1, id2, round(1 / (1 + exp(-(ln(m / u) + " + " + ".join(f"f{i}.w" for i in range(7)) + "))), 6) AS prob FROM v, t, " + ", ".join(f"f{i}" for i in range(7)) + " WHERE " + " AND ".join(f"v.{c} = f{i}.x" for i, c in enumerate(SCORES)))
def clf_naive_bayes(spark, folder):
    x, matches = vectors(spark, folder)
    return six(classify.NaiveBayesClassifier(binarize=0.5).fit(x, matches).prob(x), "prob")


_LABELLED = """v AS (SELECT id1, id2, """ + ", ".join(f"CASE WHEN {c} > 0.5 THEN 1 ELSE 0 END AS {c}" for c in SCORES) + """ FROM comparison_pairs),
l AS (SELECT v.*, CASE WHEN m.id1 IS NULL THEN 0 ELSE 1 END AS y FROM v LEFT JOIN (SELECT DISTINCT id1, id2 FROM comparison_pairs WHERE is_match) m ON v.id1 = m.id1 AND v.id2 = m.id2)"""


@query(f"WITH {_LABELLED}, c AS (SELECT feature, x::DOUBLE AS level, sum(y) AS n1, sum(1 - y) AS n0 FROM (UNPIVOT l ON {', '.join(SCORES)} INTO NAME feature VALUE x) GROUP BY feature, x), t AS (SELECT sum(y) AS t1, sum(1 - y) AS t0 FROM l)"
"SELECT feature, level, round((n1 + 1e-4) / (t1 + 2e-4), 6)::DOUBLE AS m, round((n0 + 1e-4) / (t0 + 2e-4), 6)::DOUBLE AS u, round(((n1 + 1e-4) / (t1 + 2e-4)) / ((n0 + 1e-4) / (t0 + 2e-4)), 4)::DOUBLE AS weight FROM c, t")
def clf_parameters(spark, folder):
    """P(level | match), P(level | other) and their ratio of the fitted model."""
    x, matches = vectors(spark, folder)
    return six(classify.NaiveBayesClassifier(binarize=0.5).fit(x, matches).params_frame(spark), "m", "u").withColumn("weight", F.round("weight", 4))


def _sq(center: float) -> str:
    return " + ".join(f"pow(coalesce({c}, 0) - {center}, 2)" for c in SCORES)


@query(f"SELECT id1, id2 FROM comparison_pairs WHERE {_sq(0.9)} < {_sq(0.2)}")
def clf_kmeans_fixed(spark, folder):
    return classify.KMeansClassifier([0.9] * 7, [0.2] * 7).predict(vectors(spark, folder)[0])

_POINT = "[" + ", ".join(f"coalesce({c}, 0)" for c in SCORES) + "]"
_KMEANS_SQL = f"""WITH RECURSIVE x AS (SELECT id1, id2, {_POINT} AS x FROM comparison_pairs),
t AS (SELECT ({' + '.join(f"var_pop(x[{i}])" for i in range(1, 8))}) / 7 * 1e-4 AS still FROM x),
c(n, u, m, done) AS (SELECT 0, list_transform(range(7), lambda k: 0.05::DOUBLE), list_transform(range(7), lambda k: 0.95::DOUBLE), false
UNION ALL SELECT n + 1, nu, nm, list_distance(nu, u) ** 2 + list_distance(nm, m) ** 2 <= still FROM (
 SELECT n, u, m, still, [{', '.join(f"avg(x[{i}]) FILTER (NOT near)" for i in range(1, 8))}] AS nu, [{', '.join(f"avg(x[{i}]) FILTER (near)" for i in range(1, 8))}] AS nm
 FROM (SELECT *, list_distance(x, m) < list_distance(x, u) AS near FROM c, x, t WHERE NOT done AND n < 300) GROUP BY n, u, m, still))
SELECT id1, id2 FROM x, (SELECT * FROM c ORDER BY n DESC LIMIT 1) WHERE list_distance(x, m) < list_distance(x, u)"""


@query(_KMEANS_SQL)
def clf_kmeans(spark, folder):
    return classify.KMeansClassifier().fit_predict(vectors(spark, folder)[0])


_BITS = "[" + ", ".join(f"CASE WHEN {c} > 0.5 THEN 1 ELSE 0 END" for c in SCORES) + "]"
_ODDS = "ln(p) - ln(1 - p) + " + " + ".join(f"CASE WHEN x[{i}] = 1 THEN greatest(ln(m[{i}]), -700) - greatest(ln(u[{i}]), -700) ELSE greatest(ln(1 - m[{i}]), -700) - greatest(ln(1 - u[{i}]), -700) END" for i in range(1, 8))
_ECM_SQL = f"""WITH RECURSIVE v AS (SELECT id1, id2, {_BITS} AS x FROM comparison_pairs), x AS (SELECT x, count(*)::DOUBLE AS w FROM v GROUP BY x),
c(n, p, m, u, done) AS (SELECT 0, 0.1::DOUBLE, list_transform(range(7), lambda k: 0.9::DOUBLE), list_transform(range(7), lambda k: 0.1::DOUBLE), false
UNION ALL SELECT n + 1, np, nm, nu, abs(np - p) <= 1e-4 + 1e-5 * np AND {' AND '.join(f"abs(nm[{i}] - m[{i}]) <= 1e-4 + 1e-5 * least(nm[{i}], 1 - nm[{i}]) AND abs(nu[{i}] - u[{i}]) <= 1e-4 + 1e-5 * least(nu[{i}], 1 - nu[{i}])" for i in range(1, 8))} FROM (
 SELECT n, p, m, u, sum(w * g) / sum(w) AS np, [{', '.join(f"sum(w * g * x[{i}]) / sum(w * g)" for i in range(1, 8))}] AS nm, [{', '.join(f"sum(w * (1 - g) * x[{i}]) / sum(w * (1 - g))" for i in range(1, 8))}] AS nu
 FROM (SELECT *, 1 / (1 + exp(-({_ODDS}))) AS g FROM c, x WHERE NOT done AND n < 100) GROUP BY n, p, m, u))
SELECT id1, id2 FROM v, (SELECT * FROM c ORDER BY n DESC LIMIT 1) WHERE {_ODDS} > 0"""


@query(_ECM_SQL)
def clf_ecm(spark, folder):
    return classify.ECMClassifier(binarize=0.5).fit_predict(vectors(spark, folder)[0])


def _gradient(x: DataFrame, matches: DataFrame, model, slope: Callable[[Column, Column], Column], intercept_penalty: float) -> DataFrame:
    """(parameter, gradient) of a fitted linear model's objective per pair: 0 everywhere only at the one optimum."""
    data = classify.with_labels(x, matches)
    plane = F.lit(model.intercept)
    for c, w in zip(SCORES, model.coefficients):
        plane = plane + F.col(c) * w
    data = data.withColumn("__s", slope(plane, F.col("label").cast("double")))
    sums = data.agg(F.count("*").alias("n"), *(F.sum(F.col("__s") * F.col(c)).alias(c) for c in SCORES), F.sum("__s").alias("intercept"))
    penalty = {c: w for c, w in zip(SCORES, model.coefficients)} | {"intercept": model.intercept * intercept_penalty}
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("parameter"), (F.round((F.col(c) + w) / F.col("n"), 4) + 0.0).alias("gradient")) for c, w in penalty.items())))
    return sums.select(cells.alias("g")).select("g.*")


_OPTIMUM = "SELECT unnest([" + ", ".join(f"'{c}'" for c in [*SCORES, "intercept"]) + "]) AS parameter, 0.0::DOUBLE AS gradient"


@query(_OPTIMUM)
def clf_logistic_fit(spark, folder):
    x, matches = vectors(spark, folder)
    return _gradient(x, matches, classify.LogisticRegressionClassifier().fit(x, matches), lambda plane, y: 1 / (1 + F.exp(-plane)) - y, 0.0)


@query(_OPTIMUM)
def clf_svm(spark, folder):
    x, matches = vectors(spark, folder)
    return _gradient(x, matches, classify.SVMClassifier().fit(x, matches), lambda plane, y: -2 * (2 * y - 1) * F.greatest(1 - (2 * y - 1) * plane, F.lit(0.0)), 1.0)


class _Centroid:
    """A small local model: the nearer of the two class means."""

    def fit(self, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None) -> None:
        w = np.ones(len(x)) if sample_weight is None else sample_weight
        self.means = np.stack([w[y == k] @ x[y == k] / w[y == k].sum() for k in (0, 1)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return ((x[:, None, :] - self.means) ** 2).sum(axis=2).argmin(axis=1)


@query(f"""WITH x AS (SELECT id1, id2, {_POINT} AS x FROM comparison_pairs), t AS (SELECT DISTINCT id1, id2 FROM comparison_pairs WHERE is_match),
l AS (SELECT x.*, t.id1 IS NOT NULL AS y FROM x LEFT JOIN t USING (id1, id2)), c AS (SELECT [{', '.join(f"avg(x[{i}]) FILTER (y)" for i in range(1, 8))}] AS m, [{', '.join(f"avg(x[{i}]) FILTER (NOT y)" for i in range(1, 8))}] AS u FROM l)
SELECT id1, id2 FROM x, c WHERE list_distance(x, m) < list_distance(x, u)""")
def clf_adapter_local(spark, folder):
    return classify.DriverModelClassifier(_Centroid()).fit_predict(*vectors(spark, folder))


@query()
def clf_adapter_spark(spark, folder):
    from pyspark.ml.classification import DecisionTreeClassifier

    return classify.SparkMLClassifier(DecisionTreeClassifier(maxDepth=3)).fit_predict(*vectors(spark, folder))


# --- links ------------------------------------------------------------------------------------------------------------


def _links(spark, folder) -> DataFrame:
    """Customers and suppliers of a nation, the nearest balances first."""
    found = block_and_compare(indexing.Block("c_nationkey", "s_nationkey"), Compare().numeric("c_acctbal", "s_acctbal", "linear", scale=500, label="sim"), records(spark, folder, "customer"), records(spark, folder, "supplier"))
    return found.filter("sim > 0.5").select("c_custkey", "s_suppkey", F.round(-F.col("sim"), 6).alias("o"))


_LINKS = "SELECT c_custkey, s_suppkey, round(-(1 - least(abs(s_acctbal - c_acctbal), 1000) / 1000), 6) AS o FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE 1 - least(abs(s_acctbal - c_acctbal), 1000) / 1000 > 0.5"


@query(f"SELECT c_custkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o, c_custkey, s_suppkey) AS r FROM ({_LINKS})) WHERE r = 1")
def net_one_to_many(spark, folder):
    return resolve.OneToManyLinking(0).compute(_links(spark, folder), order_by="o")


@query(f"""WITH l AS ({_LINKS}), k AS (SELECT list_reduce(list({{'a': [c_custkey], 'b': [s_suppkey]}} ORDER BY o, c_custkey, s_suppkey), lambda s, x:
CASE WHEN list_contains(s.a, x.a[1]) OR list_contains(s.b, x.b[1]) THEN s ELSE {{'a': s.a || x.a, 'b': s.b || x.b}} END) AS s FROM l) SELECT unnest(s.a) AS c_custkey, unnest(s.b) AS s_suppkey FROM k""")
def net_one_to_one(spark, folder):
    return resolve.OneToOneLinking().compute(_links(spark, folder), order_by="o")


_NEAR = "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey > b.c_custkey WHERE abs(a.c_acctbal - b.c_acctbal) <= 200"


def _near(spark, folder) -> DataFrame:
    return customer_features(spark, folder, Compare().numeric("c_acctbal", "c_acctbal", "step", offset=200, label="sim")).filter("sim = 1").drop("sim")


@query(f"""WITH RECURSIVE e AS ({_NEAR}), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT c AS component, e.x AS c_custkey_1, e.y AS c_custkey_2 FROM e JOIN (SELECT x, least(min(y), x) AS c FROM r GROUP BY x) m ON m.x = e.x""")
def net_components(spark, folder):
    return resolve.ConnectedComponents().compute(_near(spark, folder))


# --- evaluation -------------------------------------------------------------------------------------------------------

_JUDGED = """WITH t AS (SELECT DISTINCT id1, id2 FROM comparison_pairs WHERE is_match), p AS (SELECT DISTINCT id1, id2 FROM comparison_pairs WHERE """ + _summed([1] * 7) + """ > 5),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p)) AS fn, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t)) AS fp) """


def _judged(spark, folder) -> tuple[DataFrame, DataFrame]:
    x, matches = vectors(spark, folder)
    return matches, classify.sum_rule(x, 5)


@query(_JUDGED + "SELECT tp, fn, fp FROM c")
def eval_confusion(spark, folder):
    return measures.confusion_frame(*_judged(spark, folder))


@query(_JUDGED + ", n AS (SELECT count(DISTINCT (id1, id2)) AS total FROM comparison_pairs) SELECT tp, total - tp - fn - fp AS tn, fp, fn FROM c, n")
def eval_counts(spark, folder):
    """The four cells one by one."""
    true, predicted = _judged(spark, folder)
    total = vectors(spark, folder)[0].select("id1", "id2").distinct()
    cells = [measures.true_positives(true, predicted), measures.true_negatives(true, predicted, total), measures.false_positives(true, predicted), measures.false_negatives(true, predicted)]
    return spark.createDataFrame([tuple(int(c) for c in cells)], "tp long, tn long, fp long, fn long")


@query(_JUDGED + ", n AS (SELECT count(DISTINCT (id1, id2)) AS total FROM comparison_pairs) " + """SELECT round(tp / (tp + fp)::DOUBLE, 6) AS precision_, round(tp / (tp + fn)::DOUBLE, 6) AS recall_, round((total - fn - fp) / total::DOUBLE, 6) AS accuracy_,
round((total - tp - fn - fp) / (total - tp - fn)::DOUBLE, 6) AS specificity_, round(2 * tp / (2 * tp + fn + fp)::DOUBLE, 6) AS fscore_ FROM c, n""")
def eval_scores(spark, folder):
    m = measures.confusion_matrix(*_judged(spark, folder), vectors(spark, folder)[0].select("id1", "id2").distinct())
    row = (measures.precision(m), measures.recall(m), measures.accuracy(m), measures.specificity(m), measures.fscore(m))
    return spark.createDataFrame([tuple(round(x, 6) for x in row)], "precision_ double, recall_ double, accuracy_ double, specificity_ double, fscore_ double")


@query(f"SELECT round(1 - (SELECT count(*) FROM {CUSTOMER_PAIRS}) / ((SELECT count(*) FROM customer) * ((SELECT count(*) FROM customer) - 1) / 2)::DOUBLE, 6) AS ratio")
def eval_reduction_ratio(spark, folder):
    c, pairs = customer_pairs(spark, folder)
    return spark.createDataFrame([(round(measures.reduction_ratio(pairs, c), 6),)], "ratio double")


# --- sources ----------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT 'rec-' || c_custkey || '-org' AS id, c_custkey AS k FROM customer UNION ALL SELECT 'rec-' || o_custkey || '-dup-' || o_orderkey, o_custkey FROM orders)
SELECT a.id AS rec_id_1, b.id AS rec_id_2 FROM r a JOIN r b ON a.k = b.k AND a.id > b.id""")
def src_true_links(spark, folder):
    """Customers as originals and their orders as duplicates, under ids as the generator of such data writes them."""
    originals = table(spark, folder, "customer").select(F.format_string("rec-%d-org", "c_custkey").alias("rec_id"))
    copies = table(spark, folder, "orders").select(F.format_string("rec-%d-dup-%d", "o_custkey", "o_orderkey").alias("rec_id"))
    return febrl.true_links(originals.union(copies))


@query("SELECT 'rec-' || i || '-org' AS rec_id_1, 'rec-' || i || '-dup-0' AS rec_id_2 FROM range(5000) t(i)")
def src_febrl4_links(spark, folder):
    return febrl.links_febrl4(spark)


_DRAWN_M, _DRAWN_U = [0.95, 0.75, 0.6, 0.9], [0.05, 0.3, 0.1, 0.45]


@query("SELECT 40000::BIGINT AS n_rows, 40000::BIGINT AS n_different, true AS as_likely")
def src_binary_vectors(spark, folder):
    """How many vectors come out, and whether every feature is 1 as often as asked for (within five standard errors)."""
    drawn, links = generate.binary_vectors(spark, 40_000, 8_000, _DRAWN_M, _DRAWN_U, random_state=11, return_links=True)
    judged = drawn.join(links.withColumn("y", F.lit(True)), ["id_1", "id_2"], "left")
    near = F.lit(True)
    for i, (m, u) in enumerate(zip(_DRAWN_M, _DRAWN_U)):
        for p, n, own in ((m, 8_000, F.col("y").isNotNull()), (u, 32_000, F.col("y").isNull())):
            near = near & (F.abs(F.avg(F.when(own, F.col(f"c_{i + 1}"))) - p) < 5 * (p * (1 - p) / n) ** 0.5)
    return judged.agg(F.count("*").alias("n_rows"), F.count_distinct("id_1", "id_2").alias("n_different"), near.alias("as_likely"))


@query("""SELECT p.id_a AS id_1, p.id_b AS id_2, a.name_a AS value_a, CASE WHEN b.rec_id IS NOT NULL THEN b.name_b END AS value_b, 2::INT AS n_fields
FROM annotated_pairs p JOIN person_a a ON a.rec_id = p.id_a JOIN person_b b ON b.rec_id = p.id_b""")
def src_annotation(spark, folder):
    a, b = table(spark, folder, "person_a").select("rec_id", F.col("name_a").alias("name"), "surname"), table(spark, folder, "person_b").select("rec_id", F.col("name_b").alias("name"), "surname")
    found = annotation.annotation_frame(table(spark, folder, "annotated_pairs").select("id_a", "id_b"), a, b, "a", "b")
    field = F.col("pair.fields")[0]
    return found.select(F.col("pair.identifiers.a.record").alias("id_1"), F.col("pair.identifiers.b.record").alias("id_2"), field["a"]["value"].alias("value_a"), field["b"]["value"].alias("value_b"), F.size("pair.fields").alias("n_fields"))


# --- whole pipelines --------------------------------------------------------------------------------------------------

_E2E = "CASE WHEN greatest(length(a.c_name), length(b.c_name)) = 0 THEN 0 ELSE 1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name))::DOUBLE END"
_GAUSS = "pow(2, -pow((b.c_acctbal - a.c_acctbal) / 1000, 2))"


@query(f"SELECT * FROM (SELECT {CUSTOMER_IDS}, round({_E2E}, 6) AS name, round({_GAUSS}, 6) AS balance FROM {CUSTOMER_PAIRS}) WHERE name + balance > 1")
def e2e_dedup(spark, folder):
    compare = Compare().string("c_name", "c_name", label="name").numeric("c_acctbal", "c_acctbal", "gauss", scale=1000, label="balance")
    return six(customer_features(spark, folder, compare), "name", "balance").filter(F.col("name") + F.col("balance") > 1)


_LINK = f"SELECT {PERSON_IDS} FROM {PERSON_PAIRS} WHERE coalesce(jaro_winkler_similarity(a.name_a, b.name_b), 0) + CASE WHEN a.dob = b.date_of_birth THEN 1 ELSE 0 END + CASE WHEN a.place = b.placename THEN 1 ELSE 0 END > 2.5"


@query(_LINK)
def e2e_link(spark, folder):
    compare = Compare().string("name_a", "name_b", "jarowinkler").exact("dob", "date_of_birth").exact("place", "placename")
    return classify.sum_rule(person_features(spark, folder, compare, 2.5), 2.5)


@query(_LINK)
def stream_e2e_link(spark, folder):
    """The same links with person_a as a stream: read as it stands, joined to person_b, written out batch by batch."""
    compare = Compare().string("name_a", "name_b", "jarowinkler").exact("dob", "date_of_birth").exact("place", "placename")
    schema = table(spark, folder, "person_a").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/person_a.parquet*")
    found = classify.sum_rule(stream_link(stream, "rec_id", records(spark, folder, "person_b"), indexing.Block("surname"), compare, 2.5), 2.5)
    out = Scratch(spark, "stream").root
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


# --- popular keys -----------------------------------------------------------------------------------------------------


@query("""SELECT surname FROM febrl_records WHERE surname IS NOT NULL GROUP BY surname
HAVING count(*) * 100 >= (SELECT count(*) FROM febrl_records)""")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "febrl_records")
    return skew.heavy_keys(records, "surname", 0.01, ["recorded_at"], ["rec_id"]).select("surname")


@query("""WITH g AS (SELECT surname, recorded_at, date_diff('microsecond', lag(recorded_at) OVER (PARTITION BY surname ORDER BY recorded_at), recorded_at) AS gap FROM febrl_records)
SELECT surname, count(*)::BIGINT AS n_rows, min(recorded_at) AS first_at, max(recorded_at) AS last_at, coalesce(max(gap), 0)::BIGINT AS longest_gap FROM g GROUP BY surname""")
def p4_timeline(spark: SparkSession, folder: str) -> DataFrame:
    out = skew.balanced_timeline(table(spark, folder, "febrl_records"), ["surname"], "recorded_at", ["rec_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
