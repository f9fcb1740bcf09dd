"""References of the gold diagnoses to the gold vocabulary, and of the tables to one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.translit import nfc_strip_column
from ..operators.references import orphan_cascade, orphan_report
from ..tables import ensure_checkpoint_dir, table


def code_text(col: Column) -> Column:
    """A numeric code as plain integer text; null if it is blank or no whole number."""
    number = F.regexp_replace(col, r"[\s\u00a0]+", "").try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string"))


def lemma_text(df: DataFrame, column: str) -> DataFrame:
    """The column trimmed and in composed form, null if blank: converted once per distinct value."""
    other = F.col(column).rlike(r"[^\x21-\x7e]")
    forms = df.where(other).select(F.col(column).alias("raw")).distinct().withColumn("form", nfc_strip_column(F.col("raw")))
    out = df.join(forms, F.col(column) == F.col("raw"), "left").withColumn(column, F.coalesce("form", column)).drop("raw", "form")
    return out.withColumn(column, F.when(F.col(column) != "", F.col(column)))


def vocabulary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gold_vocab").where("token is not null")
    lemmas = lemma_text(rows.where("kind = 'lemma'").select("token", "added_at", "removed_at"), "token")
    codes = rows.where("kind = 'cng'").select(code_text(F.col("token")).alias("token"), "added_at", "removed_at")
    return lemmas.withColumn("parent", F.lit("gold_vocab.lemma")).unionByName(codes.withColumn("parent", F.lit("gold_vocab.cng"))).withColumnRenamed("token", "key")


def diagnosis_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per diagnosis, field and referenced token; deliveries of a diagnosis are one."""
    rows = table(spark, sf_dir, "gold_diagnosis").where("diag_id is not null").select("diag_id", "lemma", "expected_cng", "available_cngs", "diagnosed_at")
    rec, at = F.col("diag_id").cast("string").alias("rec"), F.col("diagnosed_at").alias("at")
    lemmas = lemma_text(rows.where("lemma is not null").select(rec, "lemma", at), "lemma").select("rec", F.lit("lemma").alias("field"), F.lit("gold_vocab.lemma").alias("parent"), F.col("lemma").alias("ref"), "at")
    # one pass over the codes: the expected one and the available ones are one array
    expected = F.array(F.struct(F.lit("expected_cng").alias("field"), F.col("expected_cng").alias("code")))
    available = F.transform(F.coalesce("available_cngs", F.array()), lambda c: F.struct(F.lit("available_cngs").alias("field"), c.alias("code")))
    codes = rows.select(rec, F.explode(F.concat(expected, available)).alias("c"), at).where("c.code is not null")
    codes = codes.select("rec", F.col("c.field").alias("field"), F.lit("gold_vocab.cng").alias("parent"), code_text(F.col("c.code")).alias("ref"), "at")
    refs = lemmas.unionByName(codes).where("ref is not null").distinct()
    return refs.select(F.lit("gold_diagnosis").alias("child"), "rec", "field", "parent", "ref", "at")


FIELDS = ("lemma", "expected_cng", "available_cngs")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, stem, loaded_at), stored once: references, spans and, in every round, identities come from it."""
    ensure_checkpoint_dir(spark)
    rows = table(spark, sf_dir, "sentences").groupBy("sentence_id").agg(F.min("stem").alias("stem"), F.min("loaded_at").alias("loaded_at"))
    return rows.where("sentence_id is not null").checkpoint()


def _graph(spark: SparkSession, sf_dir: str, sentences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, spans and identities of the diagnoses and of what they hang on.

    Diagnoses refer to the gold vocabulary and, by its stem, to a sentence; sentences refer to a
    split assignment. References of sentences are dated by the sentence's loading. An assignment
    holds from the beginning: that a sentence is loaded before it is assigned is the usual order.
    """
    never, sid = F.lit(None).cast("timestamp_ntz").alias("removed_at"), F.col("sentence_id").cast("string")
    loaded = F.col("loaded_at").cast("timestamp_ntz")
    splits = table(spark, sf_dir, "splits").where("sentence_id is not null").select(F.lit("splits").alias("parent"), sid.alias("key"), F.lit("0001-01-01").cast("timestamp_ntz").alias("added_at"), never).distinct()
    # a sentence is named by two keys; the name of a key decides whose records it names
    named = sentences.select(sid.alias("rec"), loaded.alias("added_at"), F.explode(F.array(F.struct(F.lit("sentences").alias("parent"), sid.alias("key")), F.struct(F.lit("sentences.stem").alias("parent"), F.col("stem").alias("key")))).alias("k"))
    spans = vocabulary_spans(spark, sf_dir).unionByName(splits).unionByName(named.select("k.parent", "k.key", "added_at", never))
    identity = named.select(F.lit("sentences").alias("table"), "k.parent", "k.key", "rec")
    own = sentences.select(F.lit("sentences").alias("child"), sid.alias("rec"), F.lit("sentence_id").alias("field"), F.lit("splits").alias("parent"), sid.alias("ref"), loaded.alias("at"))
    diagnoses = table(spark, sf_dir, "gold_diagnosis").where("diag_id is not null and sent_id is not null").select("diag_id", "sent_id", "diagnosed_at").distinct()
    diagnoses = diagnoses.select(
        F.lit("gold_diagnosis").alias("child"), F.col("diag_id").cast("string").alias("rec"), F.lit("sent_id").alias("field"),
        F.lit("sentences.stem").alias("parent"), F.trim("sent_id").alias("ref"), F.col("diagnosed_at").alias("at"),
    )
    return diagnosis_references(spark, sf_dir).unionByName(own).unionByName(diagnoses), spans, identity


def _diagnosis_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans of the diagnoses, by the cascade over the tables they hang on."""
    return orphan_cascade(*_graph(spark, sf_dir, _sentences(spark, sf_dir))).where("child = 'gold_diagnosis'")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references to vocabulary tokens that do not exist: the direct orphans of the three fields."""
    orphans = _diagnosis_orphans(spark, sf_dir).where(F.col("field").isin(*FIELDS) & (F.col("kind") == "direct"))
    return orphans.select(F.col("rec").cast("long").alias("diag_id"), "field", "ref", "reason")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field and month of the diagnoses, direct beside inherited orphans."""
    return orphan_report(_diagnosis_orphans(spark, sf_dir))


def _each_node(orphans: DataFrame, nodes: DataFrame) -> DataFrame:
    """The orphans with a sentence's reference of table nodes repeated for each of its distinct nodes."""
    shared = orphans.where("child = 'nodes'").withColumn("sentence_id", F.col("rec").cast("long"))
    each = shared.join(nodes, "sentence_id").withColumn("rec", F.concat_ws(" ", "rec", "node_id")).select(*orphans.columns).distinct()
    return orphans.where("child <> 'nodes'").unionByName(each)


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans over all tables' foreign keys: a sentence in no split orphans its nodes too."""
    sentences = _sentences(spark, sf_dir)
    references, spans, identity = _graph(spark, sf_dir, sentences)
    sid = F.col("sentence_id").cast("string")
    # the nodes of a sentence share one reference, so the cascade carries it once; the report counts the nodes
    every = table(spark, sf_dir, "nodes").where("sentence_id is not null and node_id is not null").select("sentence_id", "node_id")
    nodes = every.select("sentence_id").distinct().join(sentences, "sentence_id", "left")
    nodes = nodes.select(F.lit("nodes").alias("child"), sid.alias("rec"), F.lit("sentence_id").alias("field"), F.lit("sentences").alias("parent"), sid.alias("ref"), F.col("loaded_at").cast("timestamp_ntz").alias("at"))
    return orphan_report(_each_node(orphan_cascade(references.unionByName(nodes), spans, identity), every))


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p4_cascade)}

_CASES = """
with v as (select distinct kind, case when kind = 'cng' then cast(cast(trim(token) as double) as bigint)::varchar else nfc_normalize(trim(token)) end as ref, added_at, removed_at from gold_vocab),
d as (select distinct diag_id, lemma, expected_cng, available_cngs, diagnosed_at from gold_diagnosis where diag_id is not null),
r as (select diag_id, 'lemma' as field, 'lemma' as kind, trim(nfc_normalize(lemma), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as ref, diagnosed_at from d
  union select diag_id, 'expected_cng', 'cng', trim(expected_cng, ' ' || chr(9) || chr(160)), diagnosed_at from d
  union select diag_id, 'available_cngs', 'cng', trim(x, ' ' || chr(9) || chr(160)), diagnosed_at from (select diag_id, diagnosed_at, unnest(available_cngs) as x from d)),
k as (select distinct diag_id, field, kind, case when kind = 'cng' then cast(cast(ref as double) as bigint)::varchar else ref end as ref, diagnosed_at from r where ref is not null and ref <> ''),
c as (select k.diag_id, k.field, k.ref, k.diagnosed_at, count(v.ref) as n,
  count(*) filter (where v.added_at <= k.diagnosed_at and (v.removed_at is null or v.removed_at > k.diagnosed_at)) as alive,
  count(*) filter (where v.removed_at <= k.diagnosed_at) as ended
  from k left join v on v.kind = k.kind and v.ref = k.ref group by all),
o as (select diag_id, field, ref, diagnosed_at, case when n = 0 then 'missing' when ended > 0 then 'deleted' else 'late' end as reason from c where alive = 0)
"""
_GRAPH = _CASES + """, s as (select sentence_id, min(stem) as stem, min(loaded_at) as loaded_at from sentences where sentence_id is not null group by 1),
os as (select * from s where sentence_id not in (select sentence_id from splits where sentence_id is not null)),
nd as (select distinct sentence_id, node_id from nodes where sentence_id is not null and node_id is not null),
sd as (select distinct diag_id, trim(sent_id) as stem, diagnosed_at from gold_diagnosis where diag_id is not null and sent_id is not null),
sx as (select sd.*, (select count(*) from s where s.stem = sd.stem) as known, (select count(*) from s where s.stem = sd.stem and (sd.diagnosed_at is null or s.loaded_at <= sd.diagnosed_at)) as alive, (select count(*) from os where os.stem = sd.stem) as bad from sd),
a as (select 'gold_diagnosis' as "table", field, diagnosed_at as dated, 'direct' as kind, reason, diag_id::varchar as rec from o
  union all select 'sentences', 'sentence_id', loaded_at, 'direct', 'missing', sentence_id::varchar from os
  union all select 'nodes', 'sentence_id', null, 'direct', 'missing', sentence_id || ' ' || node_id from nd where sentence_id not in (select sentence_id from s)
  union all select 'nodes', 'sentence_id', os.loaded_at, 'inherited', 'parent', nd.sentence_id || ' ' || nd.node_id from nd join os on os.sentence_id = nd.sentence_id
  union all select 'gold_diagnosis', 'sent_id', diagnosed_at, 'direct', case when known = 0 then 'missing' else 'late' end, diag_id::varchar from sx where alive = 0
  union all select 'gold_diagnosis', 'sent_id', diagnosed_at, 'inherited', 'parent', diag_id::varchar from sx where alive > 0 and bad > 0)
select "table", field, strftime(dated, '%Y-%m') as month, kind, reason, count(*) as refs, count(distinct rec) as records from a where {rows} group by all"""
SQL = {
    "p4_found": _CASES + "select diag_id, field, ref, reason from o",
    "p4_report": _GRAPH.replace("{rows}", "\"table\" = 'gold_diagnosis'"),
    "p4_cascade": _GRAPH.replace("{rows}", "true"),
}
