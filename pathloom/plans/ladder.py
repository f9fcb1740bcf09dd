"""Whole analyses of the best paths against a reference with conventions of its own.

The reference has the gold words in text order, lemmas in IAST, and writes n as retroflex in the lemmas
of even id, so that strict and tolerant agreement differ. Paths are decoded by a scorer that reads
tags, so that words of one form and lemma can be analysed wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import tokens, translit
from ..operators import ladder
from ..operators import lattice as L
from ..operators import maps
from ..operators import metrics as M
from ..operators.sweep import level_sweep
from ..sources import tables as IO
from ..tables import ensure_checkpoint_dir, table
from .evaluation import _G, _MICRO, _S, gold_paths
from .features import TRAIN, _iast, _normalized, _ROLES, _spelled, train_sentences
from .lattice import _BEAMS, _ENDS, EDGES, INTEGER_WEIGHT, NODES

BY_TAG = "length * 10 + pmod(tag_id * 5 + form_id, 7)"
SCORERS = {"uniform": "1", "length": "length", "length and form": INTEGER_WEIGHT}


def best_paths(spark: SparkSession, sf_dir: str, weight: str) -> DataFrame:
    """(sentence_id, nodes): the best path of every lattice by a node weight, without its boundaries."""
    best = level_sweep(table(spark, sf_dir, "nodes"), F.expr(weight), "kbest", 1)
    return best.select("sentence_id", M.strip(F.col("nodes")).alias("nodes"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with tokens; a code is the least id of a tag's token, the sentinel where there is none."""
    v = table(spark, sf_dir, "vocab")
    named = lambda kind, name: v.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("token").alias(name))
    code = v.where("kind = 'tag'").groupBy("token").agg(F.min("id").alias("code")).withColumnRenamed("token", "tag")
    tags = maps.with_sentinel(named("tag", "tag"), code, "tag", "code")
    lemma = ladder.reference_lemmas(named("lemma", "lemma").withColumn("raw", _convention()), "raw").drop("raw")
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).select("sentence_id", "node_id", "char_start", "form_id", "lemma_id", "tag_id")
    out = nodes.join(named("form", "form"), "form_id").join(lemma, "lemma_id", "left").join(tags, "tag_id", "left")
    return out.na.fill("", ["lemma", "strict", "tag"]).withColumns({"code": F.coalesce("code", F.lit("<unmapped:>")), "tolerant": F.coalesce("tolerant", F.array(F.lit("")))})


def _convention() -> Column:
    iast = translit.slp1_to_iast_column(F.col("lemma"))
    return F.when(F.col("lemma_id") % 2 == 0, F.replace(iast, F.lit("n"), F.lit("ṇ"))).otherwise(iast)


def _reference(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    return ladder.analyses(gold_paths(table(spark, sf_dir, "nodes")), words, ["form", "strict", "tolerant", "code"])


def e03_sequence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of the best paths, over all sentences with a reference."""
    words = _words(spark, sf_dir)
    predicted = ladder.analyses(best_paths(spark, sf_dir, BY_TAG), words, ["form", "lemma", "code"])
    return ladder.ladder(_reference(spark, sf_dir, words), predicted)


def e04_gold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved gold paths by the same scorer: how well the labels themselves agree; sentences of unlike length are skipped."""
    words = _words(spark, sf_dir)
    gold = ladder.analyses(gold_paths(table(spark, sf_dir, "nodes")), words, ["form", "lemma", "code"])
    both = ladder.sided(_reference(spark, sf_dir, words), gold, "inner").where(F.size("p_form") == F.size("g_form"))
    return M.sequence_levels(both, ladder.levels())


def e07_external_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external system's JSON lines by the same scorer, on all sentences and on those it cuts as the reference does.

    The other system is a decoder by word length; its tags are bundles that a bridge turns into codes,
    with a sentinel where it knows none.
    """
    path = IO.scratch(spark, "predictions")
    words = _words(spark, sf_dir)
    other = ladder.analyses(best_paths(spark, sf_dir, "length"), words, ["form", "lemma", "tag"])
    lines = other.select(F.col("sentence_id").cast("string").alias("id"), F.lit("external").alias("mode"), F.col("form").alias("words"), F.col("lemma").alias("lemmas"), F.col("tag").alias("tags"), F.array_join("form", " ").alias("raw"))
    lines.write.json(path)
    read = IO.read_predictions(spark, path).where((F.size("words") == F.size("lemmas")) & (F.size("words") == F.size("tags")))
    bridge = table(spark, sf_dir, "vocab").where("kind = 'tag'").groupBy(F.col("token").alias("tag")).agg(F.min("id").alias("code"))
    each = maps.with_sentinel(read.select("id", F.posexplode("tags").alias("at", "tag")), bridge, "tag", "code")
    codes = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("x")).select("id", F.col("x.code").alias("code"))
    predicted = read.join(codes, "id").select(F.col("id").cast("long").alias("sentence_id"), F.col("words").alias("form"), F.col("lemmas").alias("lemma"), "code")
    reference = _reference(spark, sf_dir, words)
    agreeing = ladder.sided(reference, predicted, "inner").where("g_form = p_form")
    return ladder.ladder(reference, predicted).withColumn("subset", F.lit("all")).unionByName(M.sequence_levels(agreeing, ladder.levels()).withColumn("subset", F.lit("agreeing")))


def e10_report_with_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of gold words per bucket of training frequency, scorer after scorer, with the step from the one before."""
    raw = table(spark, sf_dir, "nodes")
    counts = X.word_counts(L.clean_nodes(raw), train_sentences(spark, sf_dir), "form_id")
    gold = raw.where("is_gold").select("sentence_id", "node_id", "form_id").distinct().join(counts, "form_id", "left").na.fill(0, ["n"])
    gold = gold.select("sentence_id", "node_id", X.frequency_bucket(F.col("n")).alias("bucket"))
    hits = None
    for step, (name, weight) in enumerate(SCORERS.items()):
        one = best_paths(spark, sf_dir, weight).select("sentence_id", F.explode("nodes").alias("node_id"), F.lit(step).alias("step"), F.lit(name).alias("scorer"))
        hits = one if hits is None else hits.unionByName(one)
    # hits of a bucket are few numbers, so the report's spine and steps are small
    hit = gold.join(hits, ["sentence_id", "node_id"]).groupBy("bucket", "step").agg(F.count("*").alias("hits"))
    spine = gold.groupBy("bucket").agg(F.count("*").alias("words")).select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("scorer")) for i, n in enumerate(SCORERS)])).alias("s"))
    rows = spine.select("bucket", "words", "s.step", "s.scorer").join(hit, ["bucket", "step"], "left").na.fill(0, ["hits"])
    rows = rows.withColumn("recall", F.round(F.col("hits") / F.col("words"), 6))
    return rows.withColumn("delta", F.round(F.col("recall") - F.lag("recall").over(W.partitionBy("bucket").orderBy("step")), 6))


def e11_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best paths get wrong word by word: categories, confusions, direction, verbless and separable errors, the gate."""
    ensure_checkpoint_dir(spark)
    words, vocab = _words(spark, sf_dir), table(spark, sf_dir, "vocab")
    sides = []
    for paths in (gold_paths(table(spark, sf_dir, "nodes")), best_paths(spark, sf_dir, BY_TAG)):
        side = ladder.analyses(paths, words, ["node_id", "form", "lemma", "tag"])
        sides.append(side.join(ladder.role_counts(side, vocab), "sentence_id"))
    return ladder.error_report(ladder.word_errors(*sides).checkpoint())


def a16_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro figures of the best paths, of sentences whose gold nodes are a path and of all others."""
    raw = table(spark, sf_dir, "nodes")
    levels = raw.where("is_gold").select("sentence_id", "node_id", "topo_level").distinct().groupBy("sentence_id")
    # consecutive levels are fully linked: gold nodes are a path where they have one level after another
    whole = levels.agg((F.countDistinct("topo_level") == F.count("*")).alias("one"), (F.max("topo_level") - F.min("topo_level") + 1 == F.count("*")).alias("dense"))
    whole = whole.select("sentence_id", (F.col("one") & F.col("dense")).alias("resolved"))
    rows = M.compared(gold_paths(raw), best_paths(spark, sf_dir, BY_TAG)).join(whole, "sentence_id")
    return M.macro(rows, ["resolved"])


def m12_rerank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the four best paths the one with the number of finite verbs nearest to one; ties keep the base order."""
    raw = table(spark, sf_dir, "nodes")
    paths = level_sweep(raw, F.expr(BY_TAG), "kbest", 4).withColumn("nodes", M.strip(F.col("nodes")))
    tags = table(spark, sf_dir, "vocab").where("kind = 'tag'").select(F.col("id").alias("tag_id"), tokens.roles(F.col("token"))["is_finite"].alias("finite")).where("finite")
    finite = L.clean_nodes(raw).join(tags, "tag_id", "left_semi").select("sentence_id", "node_id")
    counts = paths.select("sentence_id", "rank", F.explode("nodes").alias("node_id")).join(finite, ["sentence_id", "node_id"]).groupBy("sentence_id", "rank").agg(F.count("*").alias("verbs"))
    scored = paths.join(counts, ["sentence_id", "rank"], "left")
    return M.pick(scored, -F.abs(F.coalesce("verbs", F.lit(0)) - 1)).select("sentence_id", "rank")


WALK = "pmod(sentence_id * 7919 + node_id * 104729, 1000)"


def g22_random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk from source to sink per sentence: at every step the successor that a hash of sentence and node puts first.

    Consecutive levels are fully linked, so the walk is the best path under the hashes as weights.
    """
    walks = level_sweep(table(spark, sf_dir, "nodes"), F.expr(WALK), "kbest", 1)
    return walks.select("sentence_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path"))


def e18_gold_beats_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the best path, the gold path and a random walk of each sentence, and how often either beats the first."""
    raw = table(spark, sf_dir, "nodes")
    best = level_sweep(raw, F.expr(INTEGER_WEIGHT), "kbest", 1).select("sentence_id", F.col("score").cast("long").alias("best"))
    walk = level_sweep(raw, F.expr(WALK), "kbest", 1).select("sentence_id", F.explode(F.slice("nodes", F.lit(2), F.size("nodes"))).alias("node_id"))
    weights = L.clean_nodes(raw).select("sentence_id", "node_id", "is_gold", F.expr(INTEGER_WEIGHT).cast("long").alias("w"))
    walked = walk.join(weights, ["sentence_id", "node_id"]).groupBy("sentence_id").agg(F.sum("w").alias("walk"))
    gold = weights.where("is_gold").groupBy("sentence_id").agg(F.sum("w").alias("gold"))
    rows = best.join(walked, "sentence_id", "left").join(gold, "sentence_id", "left")
    return rows.agg(
        F.count("*").alias("sentences"), F.sum("best").alias("best"), F.sum("walk").alias("walk"), F.sum("gold").alias("gold"),
        F.count_if(F.col("walk") > F.col("best")).alias("walk_beats"), F.count_if(F.col("gold") > F.col("best")).alias("gold_beats"),
    )


def g22_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of the sentences that have fewer than 256: their number, best and worst score, and sum of scores."""
    paths = level_sweep(table(spark, sf_dir, "nodes"), F.expr(INTEGER_WEIGHT), "kbest", 256)
    per = paths.groupBy("sentence_id").agg(F.count("*").alias("paths"), F.max("score").cast("long").alias("best"), F.min("score").cast("long").alias("worst"), F.sum("score").cast("long").alias("total"))
    return per.where("paths < 256")


def e15_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split by the latest assignment: distinct normalised texts, and how many of them stand in another split too."""
    name = F.lower(F.regexp_replace("s.splits", r"^[\s ]+|[\s ]+$", ""))
    last = table(spark, sf_dir, "splits").where("sentence_id is not null and assigned_at is not null").groupBy("sentence_id").agg(F.max(F.struct("assigned_at", "splits")).alias("s")).select("sentence_id", name.alias("split"))
    text = F.trim(F.regexp_replace("surface_text", r"[ \t\r\n]+", " "))
    texts = table(spark, sf_dir, "sentences").select("sentence_id", text.alias("text")).where("text <> ''").distinct()
    sides = texts.join(last.where("split <> ''"), "sentence_id").select("split", "text").distinct()
    wide = sides.groupBy("text").agg(F.count("*").alias("splits"))
    per = sides.join(wide, "text").groupBy("split").agg(F.count("*").alias("texts"), F.count_if(F.col("splits") > 1).alias("shared"))
    return per.withColumn("share", F.round(F.col("shared") / F.col("texts"), 6))


QUERIES = {
    f.__name__: f
    for f in (
        a16_by_resolution, e03_sequence_levels, e04_gold_ladder, e07_external_predictions, e10_report_with_deltas, e11_case_errors, e15_contamination,
        e18_gold_beats_decoder, g22_exhaustive, g22_random_walks, m12_rerank_pick,
    )
}

_TAG_W = "b.length * 10 + (((b.tag_id * 5 + b.form_id) % 7) + 7) % 7"
_WALK_W = "(b.sentence_id * 7919 + b.node_id * 104729) % 1000"
_STEPS = {"uniform": "1", "length": "b.length", "length and form": "b.length * 10 + ((b.form_id % 7) + 7) % 7"}


def _best(weight: str, k: int = 1, name: str = "pp") -> str:
    """A recursive query (to be opened by its caller's with) whose last table is ``name``: the k best stripped paths."""
    edges = EDGES.replace("b.length * 10 + ((b.form_id % 7) + 7) % 7 as w", f"{weight} as w")
    return _BEAMS.format(edges=edges, nodes="n", level="topo_level", first=0, k=k) + "," + _ENDS + f", {name} as (select sentence_id, place as rank, score, list_transform(string_split(path, '-')[2:-2], lambda x: x::int) as p from fin where place < {k})"


_RAW = f"case when id % 2 = 0 then replace({_iast('token')}, 'n', 'ṇ') else {_iast('token')} end"
_WORDS = f"""vt as (select id, token as tag, min(id) over (partition by token)::varchar as code from vocab where kind = 'tag'),
vl as materialized (select id, token as lemma, {_normalized('raw')} as strict, {_spelled('raw', True)} as tolerant from (select id, token, {_RAW} as raw from vocab where kind = 'lemma')),
wd as (select n.*, f.token as form, coalesce(l.lemma, '') as lemma, coalesce(l.strict, '') as strict, coalesce(l.tolerant, ['']) as tolerant, coalesce(t.tag, '') as tag, coalesce(t.code, '<unmapped:>') as code
 from n join vocab f on f.kind = 'form' and f.id = n.form_id left join vl l on l.id = n.lemma_id left join vt t on t.id = n.tag_id where f.token <> ''),
ga as (select sentence_id, list(form order by char_start, topo_level, node_id) as f, list(lemma order by char_start, topo_level, node_id) as gl, list(strict order by char_start, topo_level, node_id) as s, list(tolerant order by char_start, topo_level, node_id) as t, list(code order by char_start, topo_level, node_id) as c from wd where is_gold group by 1)"""
_PRED = """pa as (select x.sentence_id, list(form order by char_start, i) as f, list(lemma order by char_start, i) as l, list(code order by char_start, i) as c
 from (select sentence_id, unnest(p) as node_id, generate_subscripts(p, 1) as i from pp where rank = 0) x join wd using (sentence_id, node_id) group by 1)"""
_FLAGS = """coalesce({f} = g.f, false) as s, coalesce({l} = g.s, false) as l, coalesce({c} = g.c, false) as m,
 coalesce(len({l}) = len(g.t) and list_bool_and(list_transform(range(1, len(g.t) + 1), lambda i: list_contains(g.t[i], {l}[i]))), false) as t"""
_RUNGS = {"S": "s", "L": "l", "L(tol)": "t", "S+M": "s and m", "L+M": "l and m", "L+M(tol)": "t and m", "S+L+M": "s and l and m", "S+L+M(tol)": "s and t and m"}


def _rungs(rows: str, extra: str = "") -> str:
    share = "round(case when count(*) > 0 then count(*) filter (where {c}) / count(*) else 0 end, 6)"
    return " union all ".join(f"select {extra}'{n}' as level, count(*) as sentences, count(*) filter (where {c}) as hits, {share.format(c=c)} as share from {rows}" for n, c in _RUNGS.items())


_AGREED = _FLAGS.format(f="p.f", l="p.l", c="p.c")
_ERRORS = _best(_TAG_W).replace("with recursive ", f"with recursive {_ROLES}, ") + ", " + _WORDS + """,
sd as (select 'g' as side, sentence_id, node_id, char_start, topo_level as i from wd where is_gold union all select 'p', x.sentence_id, wd.node_id, wd.char_start, x.i from (select sentence_id, unnest(p) as node_id, generate_subscripts(p, 1) as i from pp where rank = 0) x join wd using (sentence_id, node_id)),
sw as (select sd.side, wd.*, sd.i as at, q.case_name, q.is_finite, q.is_participle, row_number() over (partition by sd.side, wd.sentence_id order by wd.char_start, sd.i, wd.node_id) as place from sd join wd using (sentence_id, node_id) left join q on q.id = wd.tag_id),
ct as (select side, sentence_id, count(*) as words, count(*) filter (where case_name = 'nom') as nn, count(*) filter (where case_name = 'acc') as na, count(*) filter (where is_finite) as nf, count(*) filter (where is_participle) as np from sw group by all),
cb as (select g.sentence_id, g.words = p.words as alike, g.nn as gn, g.na as ga_, g.nf as gf, g.np as gp_, p.nn as pn, p.na as pa_, p.nf as pf, p.np as pp_ from ct g join ct p on g.sentence_id = p.sentence_id where g.side = 'g' and p.side = 'p'),
er as (select cb.*, 'length' as category, null::varchar as p_tag, null::varchar as g_tag from cb where not alike union all
 select cb.*, case when g.node_id = p.node_id then 'right' when g.form <> p.form then 'form' when g.lemma <> p.lemma then 'lemma' when g.tag = p.tag then 'same' else 'morph' end, p.tag, g.tag
 from cb join sw g on g.sentence_id = cb.sentence_id and g.side = 'g' join sw p on p.sentence_id = cb.sentence_id and p.side = 'p' and p.place = g.place where alike),
mo as (select *, split_part(p_tag, '.', 1) as ph, split_part(g_tag, '.', 1) as gh, case when contains(p_tag, '.') then substr(p_tag, strpos(p_tag, '.') + 1) else '' end as pr, case when contains(g_tag, '.') then substr(g_tag, strpos(g_tag, '.') + 1) else '' end as gr,
 gn <= greatest(1, gf) and not pn <= greatest(1, pf) as r1, (ga_ = 0 or gf + gp_ > 0) and not (pa_ = 0 or pf + pp_ > 0) as r2, gn <= gf + 1 and not pn <= pf + 1 as r3 from er where category = 'morph')
select 'category' as section, category as name, count(*) as n from er group by all
union all select 'confusion', p_tag || ' -> ' || g_tag, count(*) from mo group by all
union all select 'direction', ph || ' -> ' || gh, count(*) from mo where pr = gr and ph in ('nom', 'acc', 'dat', 'abl', 'g', 'loc', 'voc', 'i') and gh in ('nom', 'acc', 'dat', 'abl', 'g', 'loc', 'voc', 'i') group by all
union all select 'morph', 'errors', count(*) from mo union all select 'morph', 'verbless', count(*) from mo where gf = 0
union all select 'morph', 'identical counts', count(*) from mo where gn = pn and ga_ = pa_ and gf = pf and gp_ = pp_
union all select 'morph', 'one nominative per verb', count(*) from mo where r1 union all select 'morph', 'accusative has a governor', count(*) from mo where r2
union all select 'morph', 'nominatives up to verbs plus one', count(*) from mo where r3 union all select 'morph', 'any rule', count(*) from mo where r1 or r2 or r3
union all select 'morph', 'gate', (count(*) filter (where r1 or r2 or r3) >= 0.4 * greatest(count(*), 1))::bigint from mo"""
_BUCKETED = f"{TRAIN}, fc as (select form_id, count(*) as c from n semi join tr using (sentence_id) where chunk >= 0 group by 1), gb as (select sentence_id, node_id, case when coalesce(c, 0) = 0 then 'unseen' when c <= 4 then 'rare' when c <= 49 then 'mid' else 'common' end as bucket from n left join fc using (form_id) where is_gold)"

SQL = {
    "e03_sequence_levels": _best(_TAG_W) + f", {_WORDS}, {_PRED}, jj as (select {_AGREED} from ga g left join pa p using (sentence_id)) " + _rungs("jj"),
    "e04_gold_ladder": f"with {NODES}, {_WORDS}, jj as (select {_FLAGS.format(f='g.f', l='g.gl', c='g.c')} from ga g) " + _rungs("jj"),
    "e07_external_predictions": _best("b.length") + f", {_WORDS}, {_PRED}, jj as (select {_AGREED}, p.f is not null as has from ga g left join pa p using (sentence_id)), aa as (select * from jj where has and s) " + _rungs("jj", "'all' as subset, ") + " union all " + _rungs("aa", "'agreeing' as subset, "),
    "e10_report_with_deltas": "select *, round(recall - lag(recall) over (partition by bucket order by step), 6) as delta from (" + " union all ".join(
        f"select * from ({_best(w)}, {_BUCKETED}, h as (select sentence_id, unnest(p) as node_id from pp) select bucket, {i} as step, '{n}' as scorer, count(*) as words, count(h.node_id) as hits, round(count(h.node_id) / count(*), 6) as recall from gb left join h using (sentence_id, node_id) group by bucket)"
        for i, (n, w) in enumerate(_STEPS.items())) + ")",
    "e11_case_errors": _ERRORS,
    "a16_by_resolution": _best(_TAG_W) + f", {_G}, {_S}, re as (select sentence_id, count(distinct topo_level) = count(*) and max(topo_level) - min(topo_level) + 1 = count(*) as resolved from n where is_gold group by 1) "
    + "select resolved, count(*) as sentences, round(avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end), 6) as precision, round(avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end), 6) as recall, round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 6) as f1 from cc join re using (sentence_id) group by 1",
    "m12_rerank_pick": _best(_TAG_W, 4).replace("with recursive ", f"with recursive {_ROLES}, ") + """, vb as (select x.sentence_id, x.rank, count(*) filter (where q.is_finite) as c from (select sentence_id, rank, unnest(p) as node_id from pp) x join n using (sentence_id, node_id) left join q on q.id = n.tag_id group by 1, 2)
select sentence_id, rank from (select pp.sentence_id, pp.rank, row_number() over (partition by pp.sentence_id order by abs(coalesce(c, 0) - 1), pp.rank) as i from pp left join vb using (sentence_id, rank)) where i = 1""",
    "g22_random_walks": _BEAMS.format(edges=EDGES.replace("b.length * 10 + ((b.form_id % 7) + 7) % 7 as w", f"{_WALK_W} as w"), nodes="n", level="topo_level", first=0, k=1) + "," + _ENDS + "select sentence_id, path from fin where place = 0",
    "e18_gold_beats_decoder": f"""select count(*) as sentences, sum(best)::bigint as best, sum(walk)::bigint as walk, sum(gold)::bigint as gold, count(*) filter (where walk > best) as walk_beats, count(*) filter (where gold > best) as gold_beats from
(select sentence_id, score as best from ({_best(_STEPS['length and form'])} select * from pp)) a left join
(select sentence_id, sum(n.length * 10 + ((n.form_id % 7) + 7) % 7) as walk from (select sentence_id, unnest(p || [last]) as node_id from ({_best(_WALK_W)} select pp.*, z.last from pp join (select sentence_id, max(node_id) as last from n group by 1) z using (sentence_id))) join (with {NODES} select * from n) n using (sentence_id, node_id) group by 1) b using (sentence_id) left join
(with {NODES} select sentence_id, sum(length * 10 + ((form_id % 7) + 7) % 7) as gold from n where is_gold group by 1) c using (sentence_id)""",
    "g22_exhaustive": f"""with recursive {EDGES}, lv as (select sentence_id, max(topo_level) as top from n group by 1), lc as (select sentence_id, topo_level, count(*) as c from n group by 1, 2),
few as (select sentence_id from lc group by 1 having product(c) < 256), en as (select sentence_id, node_id, topo_level as level, 0::bigint as score from n semi join few using (sentence_id) where topo_level = 0
 union all select en.sentence_id, e.dst, en.level + 1, en.score + e.w from en join e on e.sentence_id = en.sentence_id and e.src = en.node_id)
select sentence_id, count(*) as paths, max(score)::bigint as best, min(score)::bigint as worst, sum(score)::bigint as total from en join lv using (sentence_id) where level = top group by 1""",
    "e15_contamination": """with l as (select sentence_id, arg_max(splits, (assigned_at, splits)) as s from splits where sentence_id is not null and assigned_at is not null group by 1),
t as (select distinct sentence_id, trim(regexp_replace(surface_text, '[ \\t\\r\\n]+', ' ', 'g')) as text from sentences), d as (select distinct lower(trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as split, text from t join l using (sentence_id) where text <> '' and trim(s) <> ''),
w as (select text, count(*) as k from d group by 1) select split, count(*) as texts, count(*) filter (where k > 1) as shared, round(count(*) filter (where k > 1) / count(*), 6) as share from d join w using (text) group by 1""",
}
