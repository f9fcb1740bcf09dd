"""Gold resolution, surface reconstruction, convention maps and diagnosis over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.features import split_name
from ..operators import align, maps, surface
from ..operators import lattice as L
from ..tables import table
from .features import TRAIN, train_sentences
from .lattice import NODES


def _annotation(nodes: DataFrame) -> DataFrame:
    """The gold words in order: (sentence_id, place, chunk, lemma_id, tag_id)."""
    w = W.partitionBy("sentence_id").orderBy("topo_level", "node_id")
    gold = nodes.where("is_gold")
    return gold.select("sentence_id", (F.row_number().over(w) - 1).alias("place"), "chunk", "lemma_id", "tag_id")


ORPHAN, DECOY = 100_000, 200_000


def _marked(gold: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations and lattice nodes in which every pass has something to do, by the sentence's number.

    One sentence in four has a first word that only a node without edges has (a redirected place), one
    a first word with another tag (a variant), one a first word that only a node at the end of the
    lattice has (a widened place); of the others every third has a last word that no node has. The
    rest are as they are. Boundaries are no words: the nodes are those of the inner lattice.
    """
    case = F.pmod("sentence_id", F.lit(4))
    first, last = F.col("place") == 0, F.col("place") == F.max("place").over(W.partitionBy("sentence_id"))
    lemma = F.when(first & (case == 1), -7).when(first & (case == 3), -8).when(last & (F.pmod("sentence_id", F.lit(12)) == 0), -10).otherwise(F.col("lemma_id"))
    annotation = gold.select("sentence_id", "place", "chunk", lemma.alias("lemma_id"), F.when(first & (case == 2), -9).otherwise(F.col("tag_id")).alias("tag_id"))
    columns = ["sentence_id", "node_id", "chunk", "form_id", "lemma_id", "tag_id", "topo_level"]
    inner = nodes.where("chunk >= 0").select(*columns)
    top = inner.groupBy("sentence_id").agg(F.max("topo_level").alias("top"))
    extra = gold.where(first & case.isin(1, 3)).join(top, "sentence_id").select(
        "sentence_id", (F.col("node_id") + F.when(case == 1, ORPHAN).otherwise(DECOY)).alias("node_id"), "chunk", "form_id",
        F.when(case == 1, -7).otherwise(-8).alias("lemma_id"), "tag_id", F.when(case == 3, F.col("top")).alias("topo_level"),
    )
    return annotation, inner.unionByName(extra)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes"))
    w = W.partitionBy("sentence_id").orderBy("topo_level", "node_id")
    gold = nodes.where("is_gold").withColumn("place", F.row_number().over(w) - 1)
    annotation, inner = _marked(gold, nodes)
    # a variant is another analysis with the same lemma in the chunk
    found = inner.select("sentence_id", "chunk", "lemma_id", F.col("tag_id").alias("other"), F.col("node_id").alias("node"))
    cands = annotation.join(found, ["sentence_id", "chunk", "lemma_id"]).select("sentence_id", "place", "node", (F.col("other") == F.col("tag_id")).alias("exact"))
    return align.resolve(annotation, cands, inner.select("sentence_id", F.col("node_id").alias("node"), "chunk", F.col("form_id").alias("surface")), L.level_edges(inner))


def g15_gold_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotated sentence with the pass that resolved it and its path."""
    path = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path")
    return resolved(spark, sf_dir).select("sentence_id", "resolved_by", path)


def g16_resolution_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).groupBy("resolved_by").agg(F.count("*").alias("sentences"))


def g17_redirected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with redirected places, and how they ended."""
    return resolved(spark, sf_dir).where("redirected > 0").select("sentence_id", "redirected", "resolved_by")


def g18_widened_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that reached the widened pass with places that grew, and how they ended."""
    return resolved(spark, sf_dir).where("widened > 0").select("sentence_id", "widened", "resolved_by")


def g19_redirect_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).agg(F.sum("redirected").alias("redirected"), F.sum("widened").alias("widened"), F.count("*").alias("sentences"))


def j02_annotation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes"))
    gold = _annotation(nodes)
    keys = ["sentence_id", "chunk", "lemma_id", "tag_id"]
    found = nodes.where("chunk >= 0").select(*keys, "node_id")
    return gold.join(found, keys).groupBy("sentence_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node_id")), lambda n: n.cast("string")), ",").alias("nodes"))


def j03_surface_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every non-gold node the gold nodes of its sentence, chunk and form."""
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).where("chunk >= 0")
    keys = ["sentence_id", "chunk", "form_id"]
    left = nodes.where("not is_gold").select(*keys, F.col("node_id").alias("orphan"))
    return left.join(nodes.where("is_gold").select(*keys, F.col("node_id").alias("twin")), keys).select("sentence_id", "orphan", "twin")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "vocab").where("kind = 'form'").select(F.col("id").alias("form_id"), F.col("token").alias("word"))
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).where("chunk >= 0")
    return nodes.join(forms, "form_id", "left").select("sentence_id", "node_id", "chunk", "position", "length", "word")


def a04_character_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.winners(_words(spark, sf_dir))


def a04_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.chunk_texts(_words(spark, sf_dir))


def a04_sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.sentence_texts(surface.chunk_texts(_words(spark, sf_dir)))


def a05_chunk_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.extents(_words(spark, sf_dir))


def a06_vote_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.vote_stats(_words(spark, sf_dir))


def w04_chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.chunk_starts(surface.chunk_texts(_words(spark, sf_dir)))


def _gold_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vocab")
    name = lambda kind, key: v.where(F.col("kind") == kind).select(F.col("id").alias(f"{key}_id"), F.col("token").alias(key))
    gold = L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold").join(train_sentences(spark, sf_dir), "sentence_id", "left_semi")
    return gold.join(name("form", "form"), "form_id").join(name("lemma", "lemma"), "lemma_id").join(name("tag", "tag"), "tag_id")


def a10_dominant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.dominant(_gold_named(spark, sf_dir), ["form"], ["lemma"], 3, 0.9)


def a10_pair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold_named(spark, sf_dir).select("form", "preverb_id", F.col("lemma").alias("to_lemma"), F.col("tag").alias("to_tag"))
    return maps.dominant(rows, ["form", "preverb_id"], ["to_lemma", "to_tag"], 2, 0.5, drop_identity=False)


def a11_bridge_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.purity(_gold_named(spark, sf_dir), "form", "lemma", 10, 0.9)


def j15_map_with_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out gold words through rules learned on the training sentences: form and preverb together, else the form alone.

    The pair rule gives a lemma and a tag, the single one a lemma; a word that neither knows stays.
    """
    v = table(spark, sf_dir, "vocab")
    train = _gold_named(spark, sf_dir)
    pairs = maps.dominant(train.select("form", F.col("preverb_id").cast("string").alias("tag"), F.col("lemma").alias("to_lemma"), F.col("tag").alias("to_tag")), ["form", "tag"], ["to_lemma", "to_tag"], 2, 0.5, drop_identity=False)
    single = maps.dominant(train, ["form"], ["lemma"], 3, 0.9).select(F.col("form").alias("lemma"), F.col("lemma").alias("to"))
    forms = v.where("kind = 'form'").select(F.col("id").alias("form_id"), F.col("token").alias("lemma"))
    held = L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold").where(split_name(F.col("sentence_id")) != "train").join(forms, "form_id")
    rows = held.select("sentence_id", "node_id", "lemma", F.col("preverb_id").cast("string").alias("tag"))
    out = maps.apply_with_backoff(rows, pairs.select(F.col("form").alias("lemma"), "tag", "to_lemma", "to_tag"), single)
    return out.select("sentence_id", "node_id", "rule", "new_lemma", "new_tag")


def j16_bridge_with_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature bundles of analysed documents to codes, misses to a sentinel that names the bundle."""
    docs = table(spark, sf_dir, "documents").where("genre = 'parse' and text is not null")
    bundles = docs.select("doc_id", F.posexplode(tokens.parse_analysed(F.col("text"))["tags"]).alias("place", "bundle"))
    bridge = table(spark, sf_dir, "vocab").where("kind = 'tag'").groupBy(F.col("token").alias("bundle")).agg(F.min("id").alias("code"))
    return maps.with_sentinel(bundles, bridge, "bundle", "code").select("doc_id", "place", "code")


def e17_map_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and sentences right before and after the form-to-lemma map, on the sentences held out."""
    v = table(spark, sf_dir, "vocab")
    forms, lemmas = (v.where(F.col("kind") == k).select(F.col("id").alias(f"{k}_id"), F.col("token").alias(k)) for k in ("form", "lemma"))
    gold = L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold").where(split_name(F.col("sentence_id")) != "train")
    words = gold.join(forms, "form_id").join(lemmas, "lemma_id").select("sentence_id", "form", "lemma")
    rules = maps.dominant(_gold_named(spark, sf_dir), ["form"], ["lemma"], 3, 0.9).select("form", F.col("lemma").alias("to"))
    after = words.join(rules, "form", "left").withColumn("mapped", F.coalesce("to", "form"))
    per = after.groupBy("sentence_id").agg(F.count("*").alias("n"), F.count_if(F.col("form") == F.col("lemma")).alias("before"), F.count_if(F.col("mapped") == F.col("lemma")).alias("after"))
    return per.agg(
        F.sum("n").alias("words"), F.sum("before").alias("words_before"), F.sum("after").alias("words_after"), F.count("*").alias("sentences"),
        F.count_if(F.col("before") == F.col("n")).alias("sentences_before"), F.count_if(F.col("after") == F.col("n")).alias("sentences_after"),
    )


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each diagnosis with what its sentence's lattice has: sentence_missing, chunk_missing, lemma_mismatch, cng_mismatch or matched."""
    d = table(spark, sf_dir, "gold_diagnosis").select("diag_id", "category", "sent_id", "chunk", "lemma_norm", "expected_cng").distinct()
    s = table(spark, sf_dir, "sentences").select("sentence_id", F.col("stem").alias("sent_id")).distinct()
    lemmas = table(spark, sf_dir, "vocab").where("kind = 'lemma'").select(F.col("id").alias("lemma_id"), F.col("token").alias("lemma_norm"))
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).where("chunk >= 0").join(lemmas, "lemma_id").select("sentence_id", "chunk", "lemma_norm", F.col("tag_id").cast("string").alias("tag"))
    rows = d.join(s, "sent_id", "left")
    chunks = nodes.select("sentence_id", "chunk", F.lit(True).alias("has_chunk")).distinct()
    words = nodes.select("sentence_id", "chunk", "lemma_norm", F.lit(True).alias("has_lemma")).distinct()
    full = nodes.select("sentence_id", "chunk", "lemma_norm", F.col("tag").alias("expected_cng"), F.lit(True).alias("has_code")).distinct()
    joined = rows.join(chunks, ["sentence_id", "chunk"], "left").join(words, ["sentence_id", "chunk", "lemma_norm"], "left").join(full, ["sentence_id", "chunk", "lemma_norm", "expected_cng"], "left")
    found = F.when(F.col("sentence_id").isNull(), "sentence_missing").when(F.col("has_chunk").isNull(), "chunk_missing").when(F.col("has_lemma").isNull(), "lemma_mismatch").when(F.col("has_code").isNull(), "cng_mismatch").otherwise("matched")
    return joined.select("diag_id", "category", "lemma_norm", found.alias("found"))


def e13_gold_match_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).groupBy("category", "found").agg(F.count("*").alias("n"))


def a17_failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 examples of each finding."""
    return maps.examples(_diagnosed(spark, sf_dir), "found", ["diag_id"], 30).select("found", "diag_id", "category")


def t09_top_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 commonest typed lemmas of the diagnoses."""
    rows = table(spark, sf_dir, "gold_diagnosis").select("diag_id", "lemma_norm").where("lemma_norm is not null").distinct()
    return maps.most_common(rows, ["lemma_norm"], 20)


def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are in the training split and in another one, by every assignment there ever was."""
    name = F.lower(F.trim(F.regexp_replace("splits", r"\s", "")))
    rows = table(spark, sf_dir, "splits").where("sentence_id is not null").select("sentence_id", name.alias("s"))
    return maps.assert_disjoint(rows.where("s = 'train'"), rows.where("s in ('dev', 'test')"), "sentence_id")


QUERIES = {
    f.__name__: f
    for f in (
        g15_gold_paths, g16_resolution_passes, g17_redirected_places, g18_widened_places, g19_redirect_tallies, j02_annotation_candidates, j03_surface_twins, a04_character_votes, a04_chunk_texts,
        a04_sentence_texts, a05_chunk_extents, a06_vote_stats, w04_chunk_starts, a10_dominant_map, a10_pair_map, a11_bridge_purity, j15_map_with_backoff,
        j16_bridge_with_sentinel, e13_gold_match_diagnosis, e17_map_before_after, a17_failure_examples, t09_top_lemmas, leakage_guard,
    )
}

_CAND = """a as (select sentence_id, row_number() over (partition by sentence_id order by topo_level, node_id) - 1 as place, chunk, lemma_id, tag_id from n where is_gold),
c as (select distinct a.sentence_id, a.place, b.node_id as node from a join n b on a.sentence_id = b.sentence_id and a.chunk = b.chunk and a.lemma_id = b.lemma_id and a.tag_id = b.tag_id where b.chunk >= 0)"""
_WORDS = f"{NODES}, w as (select n.sentence_id, n.node_id, n.chunk, n.position, n.length, coalesce(v.token, '') as word from n left join vocab v on v.kind = 'form' and v.id = n.form_id where n.chunk >= 0)"
_VOTES = _WORDS + """, l as (select sentence_id, chunk, node_id, position, length, word, unnest(range(1, least(length, length(word)) + 1)) as i from w),
v as (select sentence_id, chunk, position + i - 1 as pos, word[i] as ch, sum(case when length(word) = length then 4 else 1 end) as weight, min((node_id, i)) as first from l group by all),
b as (select sentence_id, chunk, pos, ch, row_number() over (partition by sentence_id, chunk, pos order by weight desc, first, ch) as r, count(*) over (partition by sentence_id, chunk, pos) as kinds from v),
x as (select sentence_id, chunk, pos, ch, kinds from b where r = 1),
g as (select sentence_id, chunk, max(position + length) as width from w group by all),
h as (select g.sentence_id, g.chunk, greatest(g.width, coalesce(max(x.pos) + 1, 0), 0) as width from g left join x on x.sentence_id = g.sentence_id and x.chunk = g.chunk and x.pos >= 0 group by g.sentence_id, g.chunk, g.width),
o as (select sentence_id, chunk, unnest(range(0, width)) as pos from h),
ct as (select h.sentence_id, h.chunk, coalesce(t.text, '') as text from h left join (select o.sentence_id, o.chunk, string_agg(coalesce(x.ch, '?'), '' order by o.pos) as text from o left join x using (sentence_id, chunk, pos) group by all) t using (sentence_id, chunk))"""
_GOLDNAMES = f"{NODES}, {TRAIN}, q as (select n.sentence_id, n.preverb_id, f.token as form, l.token as lemma, t.token as tag from n semi join tr using (sentence_id) join vocab f on f.kind = 'form' and f.id = n.form_id join vocab l on l.kind = 'lemma' and l.id = n.lemma_id join vocab t on t.kind = 'tag' and t.id = n.tag_id where is_gold)"
_DOM = """, k as (select form, lemma, count(*) as support from q group by all), r as (select *, sum(support) over (partition by form)::bigint as total, row_number() over (partition by form order by support desc, lemma) as i from k),
rules as (select form, lemma, support, total from r where i = 1 and support >= 3 and support >= 0.9 * total and form <> lemma)"""
_DIAG = f"""{NODES}, dd as (select distinct diag_id, category, sent_id, chunk, lemma_norm, expected_cng from gold_diagnosis), ss as (select distinct sentence_id, stem from sentences),
nn as (select distinct n.sentence_id, n.chunk, v.token as lemma, n.tag_id::varchar as tag from n join vocab v on v.kind = 'lemma' and v.id = n.lemma_id where n.chunk >= 0),
r as (select d.diag_id, d.category, case when s.sentence_id is null then 'sentence_missing' when not exists (select 1 from nn where nn.sentence_id = s.sentence_id and nn.chunk = d.chunk) then 'chunk_missing'
 when not exists (select 1 from nn where nn.sentence_id = s.sentence_id and nn.chunk = d.chunk and nn.lemma = d.lemma_norm) then 'lemma_mismatch'
 when not exists (select 1 from nn where nn.sentence_id = s.sentence_id and nn.chunk = d.chunk and nn.lemma = d.lemma_norm and nn.tag = d.expected_cng) then 'cng_mismatch' else 'matched' end as found from dd d left join ss s on s.stem = d.sent_id)"""

_RESOLVED = f"""with recursive {NODES},
w as (select *, row_number() over (partition by sentence_id order by topo_level, node_id) - 1 as place, count(*) over (partition by sentence_id) - 1 as last from n where is_gold),
i as (select sentence_id, node_id, chunk, form_id, lemma_id, tag_id, topo_level from n where chunk >= 0
 union all select sentence_id, node_id + {ORPHAN}, chunk, form_id, -7, tag_id, null from w where place = 0 and sentence_id % 4 = 1
 union all select sentence_id, node_id + {DECOY}, chunk, form_id, -8, tag_id, (select max(topo_level) from n where n.sentence_id = w.sentence_id and n.chunk >= 0) from w where place = 0 and sentence_id % 4 = 3),
a as (select sentence_id, place, last, chunk, case when place = 0 and sentence_id % 4 = 1 then -7 when place = 0 and sentence_id % 4 = 3 then -8 when place = last and sentence_id % 12 = 0 then -10 else lemma_id end as lemma_id,
 case when place = 0 and sentence_id % 4 = 2 then -9 else tag_id end as tag_id from w),
ie as materialized (select x.sentence_id, x.node_id as src, y.node_id as dst from i x join i y on x.sentence_id = y.sentence_id and y.topo_level = x.topo_level + 1),
nd as materialized (select i.*, exists (select 1 from ie where ie.sentence_id = i.sentence_id and ie.dst = i.node_id) as has_in, exists (select 1 from ie where ie.sentence_id = i.sentence_id and ie.src = i.node_id) as has_out from i),
cv as materialized (select a.sentence_id, a.place, d.node_id as node, bool_or(d.tag_id = a.tag_id) as exact, bool_or(d.has_in or d.has_out) as wired from a join nd d on a.sentence_id = d.sentence_id and a.chunk = d.chunk and a.lemma_id = d.lemma_id group by all),
tw as materialized (select distinct c.sentence_id, c.place, t.node_id as node from cv c join nd d on d.sentence_id = c.sentence_id and d.node_id = c.node join nd t on t.sentence_id = d.sentence_id and t.chunk = d.chunk and t.form_id = d.form_id and (t.has_in or t.has_out)),
lone as (select sentence_id, place from cv group by all having not bool_or(wired)), moved as materialized (select distinct sentence_id, place from lone semi join tw using (sentence_id, place)),
c2 as materialized (select sentence_id, place, node from cv anti join moved using (sentence_id, place) union select sentence_id, place, node from tw semi join moved using (sentence_id, place)),
c3 as materialized (select * from c2 union select distinct c.sentence_id, c.place, t.node_id from c2 c join nd d on d.sentence_id = c.sentence_id and d.node_id = c.node join nd t on t.sentence_id = d.sentence_id and t.chunk = d.chunk and t.form_id = d.form_id and (t.has_in or t.has_out)),
c as materialized (select 1 as pass, sentence_id, place, node from cv where exact union all select 2, * from c2 union all select 3, * from c3),
rc as (select c.pass, c.sentence_id, c.place, c.node, c.node::varchar as path from c join nd d on d.sentence_id = c.sentence_id and d.node_id = c.node where c.place = 0 and not d.has_in
  union all select rc.pass, rc.sentence_id, rc.place + 1, c.node, arg_min(rc.path, rc.node) || '-' || c.node from rc join c on c.pass = rc.pass and c.sentence_id = rc.sentence_id and c.place = rc.place + 1 join ie on ie.sentence_id = rc.sentence_id and ie.src = rc.node and ie.dst = c.node group by rc.pass, rc.sentence_id, rc.place, c.node),
ends as (select rc.pass, rc.sentence_id, arg_min(rc.path, rc.node) as path from rc join (select distinct sentence_id, last from a) l on l.sentence_id = rc.sentence_id and l.last = rc.place join nd d on d.sentence_id = rc.sentence_id and d.node_id = rc.node where not d.has_out group by 1, 2),
best as (select sentence_id, min(pass) as pass, arg_min(path, pass) as path from ends group by 1),
mv as (select sentence_id, count(*) as k from moved group by 1), gr as (select sentence_id, count(*) as k from (select sentence_id, place, count(*) as k3, (select count(*) from c2 where c2.sentence_id = c3.sentence_id and c2.place = c3.place) as k2 from c3 group by all) where k3 > k2 group by 1),
r as (select s.sentence_id, case b.pass when 1 then 'exact' when 2 then 'variant' when 3 then 'widened' else 'none' end as resolved_by, coalesce(b.path, '') as path,
 (case when b.pass = 1 then 0 else coalesce(mv.k, 0) end)::int as redirected, (case when b.pass <= 2 then 0 else coalesce(gr.k, 0) end)::int as widened from (select distinct sentence_id from a) s left join best b using (sentence_id) left join mv using (sentence_id) left join gr using (sentence_id)) """

SQL = {
    "g15_gold_paths": _RESOLVED + "select sentence_id, resolved_by, path from r",
    "g16_resolution_passes": _RESOLVED + "select resolved_by, count(*) as sentences from r group by 1",
    "g17_redirected_places": _RESOLVED + "select sentence_id, redirected, resolved_by from r where redirected > 0",
    "g18_widened_places": _RESOLVED + "select sentence_id, widened, resolved_by from r where widened > 0",
    "g19_redirect_tallies": _RESOLVED + "select sum(redirected)::bigint as redirected, sum(widened)::bigint as widened, count(*) as sentences from r",
    "j15_map_with_backoff": f"""with {_GOLDNAMES} {_DOM}, k2 as (select form, preverb_id, lemma as to_lemma, tag as to_tag, count(*) as support from q group by all),
r2 as (select *, sum(support) over (partition by form, preverb_id)::bigint as total, row_number() over (partition by form, preverb_id order by support desc, to_lemma, to_tag) as i from k2), pr as (select * from r2 where i = 1 and support >= 2 and support >= 0.5 * total)
select n.sentence_id, n.node_id, case when pr.form is not null then 'pair' when rules.form is not null then 'lemma' else 'none' end as rule, coalesce(pr.to_lemma, rules.lemma, f.token) as new_lemma, coalesce(pr.to_tag, n.preverb_id::varchar) as new_tag
from n join vocab f on f.kind = 'form' and f.id = n.form_id left join pr on pr.form = f.token and pr.preverb_id = n.preverb_id left join rules on rules.form = f.token where n.is_gold and n.sentence_id not in (select sentence_id from tr)""",
    "j16_bridge_with_sentinel": """with d as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '') as t from documents where genre = 'parse' and text is not null),
b as (select doc_id, unnest(range(0, len(t))) as place, unnest(list_transform(t, lambda x: trim(regexp_replace(array_to_string(string_split(x, '_')[3:], '_'), '^_+|_+$', '', 'g')))) as bundle from d), v as (select token, min(id)::varchar as code from vocab where kind = 'tag' group by 1)
select doc_id, place, coalesce(v.code, '<unmapped:' || bundle || '>') as code from b left join v on v.token = b.bundle""",
    "j02_annotation_candidates": f"with {NODES}, {_CAND} select sentence_id, place, string_agg(node::varchar, ',' order by node) as nodes from c group by all",
    "j03_surface_twins": f"with {NODES} select a.sentence_id, a.node_id as orphan, b.node_id as twin from n a join n b on a.sentence_id = b.sentence_id and a.chunk = b.chunk and a.form_id = b.form_id where not a.is_gold and b.is_gold and a.chunk >= 0",
    "a04_character_votes": f"with {_VOTES} select sentence_id, chunk, pos, ch, kinds from x",
    "a04_chunk_texts": f"with {_VOTES} select sentence_id, chunk, text from ct",
    "a04_sentence_texts": f"with {_VOTES} select sentence_id, string_agg(text, ' ' order by chunk) as text from ct group by 1",
    "a05_chunk_extents": f"with {NODES} select sentence_id, chunk, max(position + length) as width from n where chunk >= 0 group by all",
    "a06_vote_stats": f"with {_VOTES} select (select count(*) from x) as positions, (select count(*) from x where kinds > 1) as ambiguous, (select coalesce(sum(length(text) - length(replace(text, '?', ''))), 0)::bigint from ct) as holes",
    "w04_chunk_starts": f"with {_VOTES} select sentence_id, chunk, coalesce(sum(length(text) + 1) over (partition by sentence_id order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as start from ct",
    "a10_dominant_map": f"with {_GOLDNAMES} {_DOM} select * from rules",
    "a10_pair_map": f"""with {_GOLDNAMES}, k as (select form, preverb_id, lemma as to_lemma, tag as to_tag, count(*) as support from q group by all),
r as (select *, sum(support) over (partition by form, preverb_id)::bigint as total, row_number() over (partition by form, preverb_id order by support desc, to_lemma, to_tag) as i from k) select form, preverb_id, to_lemma, to_tag, support, total from r where i = 1 and support >= 2 and support >= 0.5 * total""",
    "a11_bridge_purity": f"""with {_GOLDNAMES}, k as (select form, lemma, count(*) as n from q group by all), s as (select form, sum(n) as support, max(n) as most from k group by form),
o as (select count(*) as keys, sum(support)::bigint as tokens, round(sum(most) / sum(support), 6) as purity, round(sum(most) filter (where support >= 10) / sum(support) filter (where support >= 10), 6) as solid_purity, count(*) filter (where support < 10) as low_support_keys, round(coalesce(sum(support) filter (where most < 0.9 * support) / sum(support), 0), 6) as impure_share from s)
select *, solid_purity >= 0.9 as passes from o""",
    "e17_map_before_after": f"""with {_GOLDNAMES} {_DOM}, t as (select n.sentence_id, f.token as form, l.token as lemma, coalesce(rules.lemma, f.token) as mapped from n join vocab f on f.kind = 'form' and f.id = n.form_id join vocab l on l.kind = 'lemma' and l.id = n.lemma_id left join rules on rules.form = f.token
 where is_gold and n.sentence_id not in (select sentence_id from tr)), p as (select sentence_id, count(*) as n, count(*) filter (where form = lemma) as b, count(*) filter (where mapped = lemma) as a from t group by 1)
select sum(n)::bigint as words, sum(b)::bigint as words_before, sum(a)::bigint as words_after, count(*) as sentences, count(*) filter (where b = n) as sentences_before, count(*) filter (where a = n) as sentences_after from p""",
    "e13_gold_match_diagnosis": f"with {_DIAG} select category, found, count(*) as n from r group by all",
    "a17_failure_examples": f"with {_DIAG} select found, diag_id, category from (select *, row_number() over (partition by found order by diag_id) as i from r) where i <= 30",
    "t09_top_lemmas": "select lemma_norm, count(*) as n from (select distinct diag_id, lemma_norm from gold_diagnosis where lemma_norm is not null) group by 1 order by 2 desc, 1 limit 20",
    "leakage_guard": "with s as (select distinct sentence_id, lower(regexp_replace(splits, '\\s', '', 'g')) as s from splits where sentence_id is not null) select count(distinct a.sentence_id) as shared from s a join s b on a.sentence_id = b.sentence_id where a.s = 'train' and b.s in ('dev', 'test')",
}
