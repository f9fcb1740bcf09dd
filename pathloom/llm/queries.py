"""The queries of the training-data operators, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import canonical, encode, overlap, packing, terms, truncation

FIELDS = {"form": "node_form_id", "lemma": "node_lemma_id"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlap_pairs(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "splits"))
    return pairs.select(
        F.least("eval_id", "train_id").alias("sentence_id_a"), F.greatest("eval_id", "train_id").alias("sentence_id_b")
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "splits"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_coverage(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "splits"))


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf_dir, "sentences"), "sentence_id", FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("mark is not null").select("kind", "id", "mark")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, value) of the records to map, each record once."""
    diagnosis = table(spark, sf_dir, "gold_diagnosis").select(F.lit("gold_diagnosis").alias("src"), F.col("diag_id").alias("rec_id"), F.col("lemma_norm").alias("value"))
    typed = table(spark, sf_dir, "lemma_map").select(F.lit("lemma_map").alias("src"), F.col("map_id").alias("rec_id"), F.col("map_value").alias("value"))
    # deliveries of one record are equal, so the least value is the value
    return diagnosis.unionByName(typed).where("value is not null and rec_id is not null").groupBy("src", "rec_id").agg(F.min("value").alias("value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = table(spark, sf_dir, "lemma_list")
    records = _typed(spark, sf_dir)
    exact = reference.where("lemma is not null").select(F.col("lemma").alias("value")).distinct()
    odd = records.join(exact, "value", "left_anti")
    nearest = canonical.nearest_entries(odd.select("value"), reference, "lemma_id", "lemma")
    return odd.join(nearest, "value", "left").select("src", "rec_id", F.coalesce("entry", F.lit(-1)).cast("int").alias("lemma_id"))


def p3_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct typed value with its entry, edits and records; unmatched ones have entry -1."""
    reference = table(spark, sf_dir, "lemma_list")
    records = _typed(spark, sf_dir)
    counts = records.groupBy("value").agg(F.count("*").alias("records"))
    nearest = canonical.nearest_entries(records.select("value"), reference, "lemma_id", "lemma")
    return counts.join(nearest, "value", "left").select("value", "records", F.coalesce("entry", F.lit(-1)).alias("lemma_id"), "distance")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, sf_dir, "documents")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p1_coverage, p2_found, p2_terms, p3_found, p3_mapping, p5_ids, p6_containers, p6_fill, p7_found, p7_sources)}


def oracle_sql() -> dict[str, str]:
    counted = """
with s as (select sentence_id, any_value(node_form_id) f, any_value(node_lemma_id) l from sentences where sentence_id is not null group by sentence_id),
t as (select 'form' kind, sentence_id, unnest(f) id from s union all select 'lemma', sentence_id, unnest(l) from s),
c as (select kind, id, count(*) occurrences, count(distinct sentence_id) records from t where id >= 1 group by kind, id),
m as (select *, case when records < 3 then 'rare' when records * 5 > (select count(*) from s) then 'common' end mark from c)
"""
    return {
        "p2_terms": counted + "select kind, id::int id, occurrences, records, mark from m",
        "p2_found": counted + "select kind, id::int id, mark from m where mark is not null",
    }
