"""The registered queries of this subpackage and their SQL, in the form the driver reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlink.llm import addresses, entities, mixing, names, packing, truncation
from pairlink.llm.groups import record_groups

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("""WITH RECURSIVE e AS (
  SELECT regexp_replace(lower(id1), '[^0-9a-z]+', '', 'g') AS a, regexp_replace(lower(id2), '[^0-9a-z]+', '', 'g') AS b FROM comparison_pairs WHERE is_match AND id1 IS NOT NULL AND id2 IS NOT NULL),
 l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 w AS (SELECT DISTINCT rec_id, regexp_replace(lower(rec_id), '[^0-9a-z]+', '', 'g') AS k FROM febrl_records WHERE rec_id IS NOT NULL)
SELECT x.rec_id, min(y.rec_id) AS group_id FROM r JOIN w x ON x.k = r.a JOIN w y ON y.k = r.b GROUP BY x.rec_id HAVING count(DISTINCT y.rec_id) > 1""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _table(spark, folder, "comparison_pairs").filter("is_match")
    return record_groups(_table(spark, folder, "febrl_records"), "rec_id", pairs, "id1", "id2")


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked_names(_table(spark, folder, "name_entries"), "entry_id", "name_a", "surname", _table(spark, folder, "nicknames"))


_PERSON_A = {
    "id": "rec_id", "name": "name_a", "surname": "surname", "sex": "sex", "born": "dob", "street": "str_name", "number": "street_number", "postcode": "postcode", "place": "place", "income": "income",
}
_PERSON_B = {"id": "rec_id", "name": "name_b", "surname": "surname", "sex": "gender", "born": "date_of_birth", "street": "streetname", "place": "placename", "income": "income"}


@query()
def p3_matches(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _table(spark, folder, "person_a"), _table(spark, folder, "person_b")
    return entities.matched_entities(a, b, _PERSON_A, _PERSON_B, _table(spark, folder, "nicknames"))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_matches(spark, folder).filter("probability >= 0.3").select("id_a", "id_b")


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.linked_addresses(_table(spark, folder, "address_records"), "addr_id", "str_name", "street_number", "postcode", "place")


# No table holds token counts, so the SQL of the next queries counts words and marks instead: texts that are too large
# for a container are so by far, and so are sources that fall short of their share.
_WORDS = "len(regexp_extract_all(text, '\\w+|[^\\w\\s]'))"


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    capacity = _table(spark, folder, "pack_settings").first()["capacity_tokens"]
    return packing.pack(_table(spark, folder, "documents"), "doc_id", "text", capacity)


@query(f"SELECT doc_id FROM documents, pack_settings WHERE {_WORDS} > capacity_tokens")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).filter("piece_no = 0 and n_pieces > 1").select("doc_id")


@query()
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(_packed(spark, folder))


@query("SELECT count(*) AS n_texts, 0::BIGINT AS n_over, 0::BIGINT AS n_gaps, true AS well_filled FROM documents WHERE text <> ''")
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for every packing: each text is in, no container is over its length, pieces join up, little room is left."""
    packed = _packed(spark, folder)
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("k"), F.max("n_pieces").alias("m"))
    texts = texts.agg(F.count("*").alias("n_texts"), F.count_if((F.col("n") != F.col("end")) | (F.col("k") != F.col("m"))).alias("n_gaps"))
    boxes = packing.containers(packed).agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_over"), (F.sum("used") / F.sum("capacity") > 0.99).alias("well_filled"))
    return texts.join(boxes).select("n_texts", "n_over", "n_gaps", "well_filled")  # one row each


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, folder, "documents"), "doc_id", "text", "source", _table(spark, folder, "mix_targets"))


_SHORT = f"""WITH s AS (SELECT source, sum({_WORDS}) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM s),
m AS (SELECT m.source, coalesce(n, 0) * max_repeats < target_share * total AS short FROM mix_targets m LEFT JOIN s USING (source), t) """


@query(_SHORT + "SELECT source FROM m WHERE short")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report().filter("short").select("source")


@query()
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report()


@query(_SHORT + "SELECT source, short, true AS kept FROM m")
def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: is it short, and does it give all its permitted repeats, or its share of the mix to within half a text?"""
    mix = _mix(spark, folder)
    rest = spark.createDataFrame([(r.source, int(r.rest)) for r in mix.plan.itertuples()], "source string, rest long")
    longest = mix.items.join(rest, "source").filter("n <= rest").groupBy("source").agg(F.max("n").alias("longest"))
    off = F.abs(F.col("n_tokens") - F.col("target_share") * mix.total)
    kept = F.when(F.col("short"), F.col("n_tokens") == F.col("source_tokens") * F.col("max_repeats")).otherwise(2 * off <= F.coalesce("longest", F.lit(0)) + 2)
    return mix.report().join(longest, "source", "left").select("source", "short", kept.alias("kept"))


@query()
def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).rows


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(_table(spark, folder, "documents"), "doc_id", "text", "source").select("doc_id")


@query()
def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(_table(spark, folder, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
