"""Functions and features over the vocabulary, the nodes and the sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import lemmas, tokens, translit
from ..operators import lattice as L
from ..tables import table
from .lattice import NODES


def _vocab(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "vocab").where(F.col("kind") == kind).select("id", "token")


def _joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


def _bits(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("int").cast("string")), "")


def _rounded(x: Column, n: int = 6) -> Column:
    return F.transform(x, lambda v: F.round(v, n))


def train_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "sentences").select("sentence_id").distinct()
    return ids.where(X.split_name(F.col("sentence_id")) == "train")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, surface_text, text_length), each sentence once."""
    return table(spark, sf_dir, "sentences").groupBy("sentence_id").agg(F.min("surface_text").alias("surface_text")).withColumn("text_length", F.length("surface_text"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_nodes(table(spark, sf_dir, "nodes"))


def f01_normalize_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "gold_diagnosis").select("lemma").distinct()
    return raw.select("lemma", lemmas.normalize_lemma(F.col("lemma")).alias("normalized"))


def f02_lemma_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab(spark, sf_dir, "lemma")
    return v.select("id", F.array_join(lemmas.lemma_candidates(F.col("token")), ",").alias("spellings"))


def f03_lemma_candidates_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab(spark, sf_dir, "lemma")
    return v.select("id", F.array_join(lemmas.lemma_candidates(F.col("token"), True), ",").alias("spellings"))


def f05_lemma_code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gold_diagnosis").select("lemma", F.trim("expected_cng").alias("code")).where("lemma is not null and code is not null").distinct()
    rows = rows.unionByName(spark.createDataFrame([("mahā", "2")], "lemma string, code string"))
    return rows.select("lemma", "code", F.size(lemmas.lemma_code_candidates(F.col("lemma"), F.col("code"))).alias("pairs"))


def f06_slp1_to_iast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir, "form").select("id", translit.slp1_to_iast_column(F.col("token")).alias("iast"))


def f06_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = translit.iast_to_slp1_column(translit.slp1_to_iast_column(F.col("token")))
    return _vocab(spark, sf_dir, "form").select("id", "token", back.alias("back"))


def f08_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = translit.nfc_strip_column(F.col("surface_text"))
    squeezed = F.trim(F.regexp_replace(F.replace(F.replace(composed, F.lit("'"), F.lit("")), F.lit("’"), F.lit("")), r"[ \t\r\n]+", " "))
    return texts(spark, sf_dir).select("sentence_id", squeezed.alias("text"))


def f09_tag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir, "tag").select("id", _bits(X.tag_bits(F.col("token"))).alias("bits"))


def f10_length_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.length_features(F.col("length"))
    cols = [F.round(x[i], 6).alias(n) for i, n in enumerate(("log_length", "share", "short", "middle", "long"))]
    return _nodes(spark, sf_dir).select("sentence_id", "node_id", *cols)


def f11_position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).join(texts(spark, sf_dir).select("sentence_id", "text_length"), "sentence_id", "left")
    p = X.position_features(rows)
    names = ("start", "stop", "to_chunk_end", "chunk_number")
    return p.select("sentence_id", "node_id", *[F.round(F.col("position_x")[i], 6).alias(n) for i, n in enumerate(names)])


def f12_frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    fitted = X.fit(nodes, train_sentences(spark, sf_dir))
    x = X.frequency_features(F.coalesce("n", F.lit(0)), F.coalesce("lemma_n", F.lit(0)), F.coalesce("rank", F.lit(1.0)))
    rows = nodes.join(fitted["forms"], "form_id", "left").join(fitted["lemmas"].withColumnRenamed("n", "lemma_n"), "lemma_id", "left")
    return rows.select("sentence_id", "node_id", *[F.round(x[i], 6).alias(n) for i, n in enumerate(("form_log", "lemma_log", "hapax", "form_rank"))])


def f13_character_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.character_features(F.col("token"))
    names = ("vowels", "clusters", "retroflex", "visarga", "anusvara", "ends_vowel", "begins_vowel", "ends_long")
    return _vocab(spark, sf_dir, "form").select("id", *[F.round(x[i], 6).alias(n) for i, n in enumerate(names)])


def f14_ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir, "form").select("id", _joined(_rounded(X.ngram_features(F.col("token")))).alias("x"))


def f15_featurizer_scalars64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featurized(spark, sf_dir, "scalars64")


def f15_featurizer_morph43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featurized(spark, sf_dir, "morph43")


def f15_featurizer_ngrams80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featurized(spark, sf_dir, "ngrams80")


def f15_featurizer_ngrams96(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featurized(spark, sf_dir, "ngrams96")


def f15_featurizer_ngrams128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featurized(spark, sf_dir, "ngrams128")


def _featurized(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    fitted = X.fit(nodes, train_sentences(spark, sf_dir))
    rows = nodes.join(texts(spark, sf_dir).select("sentence_id", "text_length"), "sentence_id", "left")
    return X.featurize(name, rows, table(spark, sf_dir, "vocab"), fitted)


def f16_remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = X.word_counts(_nodes(spark, sf_dir), train_sentences(spark, sf_dir), "form_id")
    dense = X.remap_ids(counts, "form_id", 2)
    ids = _nodes(spark, sf_dir).select("form_id").distinct()
    return ids.join(dense, "form_id", "left").select("form_id", F.coalesce("dense", F.lit(1)).alias("dense"))


def f17_md5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "sentences").select("sentence_id").distinct()
    return ids.select("sentence_id", X.md5_bucket(F.col("sentence_id")).alias("bucket"), X.split_name(F.col("sentence_id")).alias("split"))


def f18_span_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).join(texts(spark, sf_dir).select("sentence_id", "text_length"), "sentence_id", "left")
    last = F.greatest(F.coalesce("text_length", F.lit(0)) - 1, F.lit(0))
    start = F.least(F.greatest("char_start", F.lit(0)), last)
    stop = F.least(F.greatest(F.col("char_start") + F.col("length") - 1, start), last)
    return rows.select("sentence_id", "node_id", start.alias("start"), stop.alias("stop"))


def f19_parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("genre = 'parse' and text is not null")
    return rows.select("doc_id", *[F.array_join(c, " ").alias(n) for n, c in tokens.parse_analysed(F.col("text")).items()])


def f20_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir, "tag").select("id", *[c.alias(n) for n, c in tokens.roles(F.col("token")).items()])


def f21_path_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.gold_constraints(_nodes(spark, sf_dir), table(spark, sf_dir, "vocab"))


def a19_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.gold_role_counts(_nodes(spark, sf_dir), table(spark, sf_dir, "vocab"))


def f22_frequency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = X.word_counts(_nodes(spark, sf_dir), train_sentences(spark, sf_dir), "form_id")
    ids = _nodes(spark, sf_dir).select("form_id").distinct().join(counts, "form_id", "left").na.fill(0, ["n"])
    return ids.groupBy(X.frequency_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"))


def f23_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("sentence_id", "node_id", "length", "is_gold")
    text = F.to_json(row)
    back = F.from_json(text, "sentence_id long, node_id int, length int, is_gold boolean")
    return _nodes(spark, sf_dir).select(back["sentence_id"].alias("sentence_id"), back["node_id"].alias("node_id"), back["length"].alias("length"), back["is_gold"].alias("is_gold"))


def a03_train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.word_counts(_nodes(spark, sf_dir), train_sentences(spark, sf_dir), "form_id")


def a23_nonzero_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = _vocab(spark, sf_dir, "tag").select(F.posexplode(X.tag_bits(F.col("token"))).alias("place", "v"))
    return bits.groupBy("place").agg((F.max(F.abs("v")) > 0).alias("used"))


def w03_frequency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    ranks = X.frequency_ranks(X.word_counts(nodes, train_sentences(spark, sf_dir), "form_id"), nodes, "form_id")
    return ranks.select("form_id", "n", F.round("rank", 6).alias("rank"))


def w05_chunk_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("sentence_id", "chunk")
    return _nodes(spark, sf_dir).where("chunk >= 0").select("sentence_id", "node_id", F.max(F.col("position") + F.col("length")).over(w).alias("width"))


def w08_local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("sentence_id").orderBy("node_id")
    return _nodes(spark, sf_dir).where("chunk >= 0").select("sentence_id", "node_id", F.row_number().over(w).alias("local_id"))


QUERIES = {
    f.__name__: f
    for f in (
        f01_normalize_lemma, f02_lemma_candidates, f03_lemma_candidates_extended, f05_lemma_code_candidates, f06_slp1_to_iast, f06_round_trip, f08_text_normalize,
        f09_tag_bits, f10_length_features, f11_position_features, f12_frequency_features, f13_character_features, f14_ngram_features, f15_featurizer_morph43,
        f15_featurizer_scalars64, f15_featurizer_ngrams80, f15_featurizer_ngrams96, f15_featurizer_ngrams128, f16_remap_ids, f17_md5_split, f18_span_clamp, f19_parse_tokens, f20_roles,
        f21_path_constraints, f22_frequency_bucket, f23_json_round_trip, a03_train_counts, a19_role_counts, a23_nonzero_features, w03_frequency_rank,
        w05_chunk_width, w08_local_ids,
    )
}


def _normalized(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in lemmas.DIGRAPHS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"replace(translate({out}, '{lemmas.LETTERS_FROM}', '{lemmas.LETTERS_TO}'), '''', '')"


def _chained(word: str, steps: list[tuple[str, str]]) -> str:
    for a, b in steps:
        word = f"replace({word}, '{a}', '{b}')"
    return word


def _grown(words: str, families: list, suffixes: bool) -> str:
    out = ["w", *[_chained("w", steps) for family in families for steps in family]]
    if suffixes:
        out += [f"case when ends_with(w, '{ending}') and length(w) >= {least} then left(w, length(w) - {cut}) else w end" for ending, least, cut in lemmas.SUFFIXES]
    return f"list_distinct(flatten(list_transform({words}, lambda w: [{', '.join(out)}])))"


def _spelled(x: str, extended: bool) -> str:
    words = _grown(_grown(f"[{_normalized(x)}]", [lemmas.RETROFLEX, lemmas.VOWELS, lemmas.GRADES], True), [lemmas.RETROFLEX, lemmas.VOWELS, lemmas.GRADES], True)
    if extended:
        words = f"list_distinct(list_concat({words}, {_grown(_grown(words, [lemmas.ANUSVARA, lemmas.R_GRADES], False), [], True)}))"
    other = f"list_filter(list_transform({words}, lambda w: case w {' '.join(f"when '{a}' then '{b}'" for a, b in lemmas.ALIASES.items())} end), lambda w: w is not null)"
    return f"list_sort(list_distinct(list_concat({words}, {other})))"


def _iast(x: str) -> str:
    for a, b in translit.SLP1_TO_IAST.items():
        if len(b) == 2:
            x = f"replace({x}, '{a}', '{b}')"
    single = {a: b for a, b in translit.SLP1_TO_IAST.items() if len(b) == 1 and a != b}
    return f"translate({x}, '{''.join(single)}', '{''.join(single.values())}')"


_BUCKET = "(('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 100)"
TRAIN = f"tr as (select distinct sentence_id from sentences where {_BUCKET} >= 10)"
_FIT = f"""{NODES}, {TRAIN}, fc as (select form_id, count(*) as n from n semi join tr using (sentence_id) where chunk >= 0 group by form_id),
lc as (select lemma_id, count(*) as n from n semi join tr using (sentence_id) where chunk >= 0 group by lemma_id),
fr as (select form_id, coalesce(fc.n, 0) as n, (row_number() over (order by coalesce(fc.n, 0) desc, form_id) - 1) / greatest(count(*) over () - 1, 1) as rank from (select distinct form_id from n) left join fc using (form_id))"""
_TEXT = "t as (select sentence_id, min(surface_text) as surface_text, length(min(surface_text)) as text_length from sentences group by sentence_id)"
_TAG_LIST = "string_split_regex(replace(token, '.', ' '), '\\s+')"
_ROLE = {
    "is_participle": "list_has_any(t, ['ppr', 'pfp', 'pp', 'ppa'])",
    "is_finite": "list_has_any(t, ['1', '2', '3']) and not list_has_any(t, ['ppr', 'pfp', 'pp', 'ppa'])",
    "case_name": "coalesce(list_filter(['nom', 'acc', 'dat', 'abl', 'g', 'loc', 'voc', 'i'], lambda c: list_contains(t, c))[1], '')",
    "number_name": "coalesce(list_filter(['sg', 'du', 'pl'], lambda c: list_contains(t, c))[1], '')",
    "is_indeclinable": "list_has_any(t, ['adv', 'ind', 'conj', 'prep', 'part'])",
    "is_compound": "list_contains(t, 'iic')",
}
_ROLES = "q as (select id, " + ", ".join(f"{v} as {k}" for k, v in _ROLE.items()) + f" from (select id, {_TAG_LIST} as t from vocab where kind = 'tag'))"
_CLASS = {"vowels": f"[{X.VOWELS}]", "retroflex": f"[{X.RETROFLEX}]"}

SQL = {
    "f01_normalize_lemma": f"select distinct lemma, {_normalized('lemma')} as normalized from gold_diagnosis",
    "f02_lemma_candidates": f"select id, array_to_string({_spelled('token', False)}, ',') as spellings from vocab where kind = 'lemma'",
    "f03_lemma_candidates_extended": f"select id, array_to_string({_spelled('token', True)}, ',') as spellings from vocab where kind = 'lemma'",
    "f05_lemma_code_candidates": f"""select lemma, code, (length({_spelled('lemma', False)}) + case when {_normalized('lemma')} = 'mahA' and code = '2' and not list_contains({_spelled('lemma', False)}, 'x') then 1 else 0 end)::int as pairs
from (select distinct lemma, trim(expected_cng) as code from gold_diagnosis where lemma is not null and expected_cng is not null union all select 'mahā', '2')""",
    "f06_slp1_to_iast": f"select id, {_iast('token')} as iast from vocab where kind = 'form'",
    "f06_round_trip": "select id, token, token as back from vocab where kind = 'form'",
    "f08_text_normalize": f"""with {_TEXT} select sentence_id, trim(regexp_replace(replace(replace(trim(nfc_normalize(surface_text), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '''', ''), '’', ''), '[ \\t\\r\\n]+', ' ', 'g')) as text from t""",
    "f09_tag_bits": f"select id, array_to_string(list_transform({X.TAG_TOKENS!r}, lambda k: case when list_contains({_TAG_LIST}, k) then '1' else '0' end), '') || case when token = 'UNKNOWN' then '1' else '0' end as bits from vocab where kind = 'tag'",
    "f10_length_features": f"with {NODES} select sentence_id, node_id, round(ln(1 + length), 6) as log_length, round(least(length / 20, 1), 6) as share, (length <= 3)::int::double as short, (length > 3 and length <= 8)::int::double as middle, (length > 8)::int::double as long from n",
    "f11_position_features": f"""with {NODES}, {_TEXT},
x as (select n.*, greatest(coalesce(text_length, 0), 1) as tl, greatest(char_start, 0) as st, greatest(max(position + length) over (partition by sentence_id, greatest(chunk, 0)), 1) as wd from n left join t using (sentence_id))
select sentence_id, node_id, round(greatest(least(st / tl, 1), 0), 6) as start, round(greatest(least((st + length) / tl, 1), 0), 6) as stop, round(greatest(least((wd - position - length) / wd, 1), 0), 6) as to_chunk_end, round(least(greatest(chunk, 0) / 20, 1), 6) as chunk_number from x""",
    "f12_frequency_features": f"""with {_FIT} select sentence_id, node_id, round(ln(1 + coalesce(fr.n, 0)) / 10, 6) as form_log, round(ln(1 + coalesce(lc.n, 0)) / 10, 6) as lemma_log, (coalesce(fr.n, 0) <= 1)::int::double as hapax, round(coalesce(fr.rank, 1), 6) as form_rank
from n left join fr using (form_id) left join lc using (lemma_id)""",
    "f13_character_features": f"""with c as (select id, token, length(token) as k, length(regexp_replace(token, '[{X.VOWELS}]', '', 'g')) as cons, length(regexp_replace(token, '[{X.RETROFLEX}]', '', 'g')) as plain,
  list_sum(list_transform(range(1, length(token)), lambda i: case when not regexp_matches(token[i], '[{X.VOWELS}]') and not regexp_matches(token[i + 1], '[{X.VOWELS}]') then 1 else 0 end)) as pairs from vocab where kind = 'form')
select id, round(case when k > 0 then (k - cons) / k else 0 end, 6) as vowels, round(case when k > 0 then coalesce(pairs, 0) / greatest(k - 1, 1) else 0 end, 6)::double as clusters, round(case when k > 0 then (k - plain) / k else 0 end, 6) as retroflex,
  contains(token, 'H')::int::double as visarga, contains(token, 'M')::int::double as anusvara, regexp_matches(token, '[{X.VOWELS}]$')::int::double as ends_vowel, regexp_matches(token, '^[{X.VOWELS}]')::int::double as begins_vowel, regexp_matches(token, '[{X.LONG_VOWELS}]$')::int::double as ends_long from c""",
    "f16_remap_ids": f"with {_FIT}, kept as (select form_id, row_number() over (order by form_id) + 1 as dense from fc where n >= 2) select form_id, coalesce(dense, 1) as dense from (select distinct form_id from n) left join kept using (form_id)",
    "f17_md5_split": f"select distinct sentence_id, {_BUCKET} as bucket, case when {_BUCKET} < 5 then 'dev' when {_BUCKET} < 10 then 'test' else 'train' end as split from sentences",
    "f18_span_clamp": f"""with {NODES}, {_TEXT}, x as (select n.*, greatest(coalesce(text_length, 0) - 1, 0) as la from n left join t using (sentence_id)),
y as (select *, least(greatest(char_start, 0), la) as s from x) select sentence_id, node_id, s as start, least(greatest(char_start + length - 1, s), la) as stop from y""",
    "f20_roles": f"with {_ROLES} select * from q",
    "f21_path_constraints": f"""with {NODES}, {_ROLES}, g as (select * from n join q on n.tag_id = q.id where is_gold)
select sentence_id, bool_or(is_finite) as has_finite, bool_or(case_name = 'nom') as has_nominative, exists (select 1 from g a join g b on a.sentence_id = b.sentence_id where a.sentence_id = g.sentence_id and a.case_name = 'nom' and b.is_finite and a.number_name <> '' and a.number_name = b.number_name) as agrees from g group by sentence_id""",
    "f22_frequency_bucket": f"with {_FIT} select case when n = 0 then 'unseen' when n <= 4 then 'rare' when n <= 49 then 'mid' else 'common' end as bucket, count(*) as forms, sum(n)::bigint as occurrences from fr group by 1",
    "f23_json_round_trip": f"with {NODES} select sentence_id, node_id, length, is_gold from n",
    "a03_train_counts": f"with {_FIT} select form_id, n from fc",
    "a19_role_counts": f"""with {NODES}, {_ROLES} select sentence_id, {', '.join(f"count(*) filter (where case_name = '{c}') as n_{c}" for c in ('nom', 'acc', 'dat', 'abl', 'g', 'loc', 'voc', 'i'))},
{', '.join(f"count(*) filter (where number_name = '{c}') as n_{c}" for c in ('sg', 'du', 'pl'))}, count(*) filter (where is_finite) as n_finite, count(*) filter (where is_participle) as n_participle,
count(*) filter (where is_indeclinable) as n_indeclinable, count(*) filter (where is_compound) as n_compound, count(*) as n_words from n left join q on n.tag_id = q.id where is_gold group by sentence_id""",
    "a23_nonzero_features": f"""with b as (select list_transform({X.TAG_TOKENS!r}, lambda k: list_contains({_TAG_LIST}, k)) || [token = 'UNKNOWN'] as x from vocab where kind = 'tag')
select (i - 1)::int as place, bool_or(x[i]) as used from b, range(1, {len(X.TAG_TOKENS) + 2}) r(i) group by i""",
    "w03_frequency_rank": f"with {_FIT} select form_id, n, round(rank, 6) as rank from fr",
    "w05_chunk_width": f"with {NODES} select sentence_id, node_id, max(position + length) over (partition by sentence_id, chunk) as width from n where chunk >= 0",
    "w08_local_ids": f"with {NODES} select sentence_id, node_id, row_number() over (partition by sentence_id order by node_id) as local_id from n where chunk >= 0",
}


def _crc_sql() -> str:
    """crc (gram, h): the CRC-32 of the two- and three-letter parts of all forms, from the polynomial, for letters of one byte."""
    steps = ", ".join(f"t{i + 1} as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end as v from t{i})" for i in range(8))
    one = lambda c, k: f"xor(t[(xor({c}, ascii(gram[{k}])) & 255) + 1], {c} >> 8)"
    return f"""t0 as (select i, i::bigint as v from range(256) r(i)), {steps}, tb as (select list(v order by i) as t from t8),
gm as (select distinct gram from (select unnest(list_transform(range(1, length(token)), lambda i: substr(token, i, 2)) || list_transform(range(1, length(token) - 1), lambda i: substr(token, i, 3))) as gram from vocab where kind = 'form')),
c1 as (select gram, t, {one("4294967295::bigint", 1)} as c from gm, tb), c2 as (select gram, t, {one("c", 2)} as c from c1), c3 as (select gram, case when length(gram) = 3 then {one("c", 3)} else c end as c from c2),
crc as (select gram, xor(c, 4294967295) as h from c3)"""


def _ngram_sql(buckets: int) -> str:
    """ng (id, g): the shares of a form's parts in each bucket."""
    return f"""{_crc_sql()}, fg as (select id, unnest(list_transform(range(1, length(token)), lambda i: substr(token, i, 2)) || list_transform(range(1, length(token) - 1), lambda i: substr(token, i, 3))) as gram from vocab where kind = 'form'),
hs as (select v.id, coalesce(list(h % {buckets}) filter (where h is not null), []) as hs from (select id from vocab where kind = 'form') v left join fg on fg.id = v.id left join crc on crc.gram = fg.gram group by v.id),
ng as (select id, list_transform(range({buckets}), lambda b: len(list_filter(hs, lambda h: h = b)) / greatest(len(hs), 1)) as g from hs)"""


def _scalar_sql(buckets: int = 0) -> str:
    grams = (f"{_ngram_sql(buckets)},\n", f" || coalesce(ng.g, list_transform(range({buckets}), lambda i: 0::double))", " left join ng on ng.id = w.form_id") if buckets else ("\n", "", "")
    return f"""with {_FIT}, {_TEXT}, {grams[0]}
q as (select id, list_transform({X.TAG_TOKENS!r}, lambda k: list_contains({_TAG_LIST}, k)::int::double) || [(token = 'UNKNOWN')::int::double] as x from vocab where kind = 'tag'),
c as (select id, [(k - cons) / k, coalesce(pairs, 0) / greatest(k - 1, 1), (k - plain) / k, contains(token, 'H')::int, contains(token, 'M')::int, regexp_matches(token, '[{X.VOWELS}]$')::int, regexp_matches(token, '^[{X.VOWELS}]')::int, regexp_matches(token, '[{X.LONG_VOWELS}]$')::int]::double[] as x
 from (select id, token, length(token) as k, length(regexp_replace(token, '[{X.VOWELS}]', '', 'g')) as cons, length(regexp_replace(token, '[{X.RETROFLEX}]', '', 'g')) as plain,
 list_sum(list_transform(range(1, length(token)), lambda i: case when not regexp_matches(token[i], '[{X.VOWELS}]') and not regexp_matches(token[i + 1], '[{X.VOWELS}]') then 1 else 0 end)) as pairs from vocab where kind = 'form' and token <> '')),
w as (select n.*, greatest(coalesce(text_length, 0), 1) as tl, greatest(char_start, 0) as st, greatest(max(position + length) over (partition by n.sentence_id, greatest(chunk, 0)), 1) as wd from n left join t on t.sentence_id = n.sentence_id)
select w.sentence_id, node_id, case when chunk < 0 then list_transform(range({64 + buckets}), lambda i: 0::float) else (coalesce(q.x, list_transform(range(43), lambda i: 0::double)) || [ln(1 + length), greatest(least(length / 20, 1), 0), (length <= 3)::int, (length > 3 and length <= 8)::int, (length > 8)::int]::double[]
 || [greatest(least(st / tl, 1), 0), greatest(least((st + length) / tl, 1), 0), greatest(least((wd - position - length) / wd, 1), 0), least(greatest(chunk, 0) / 20, 1)]::double[]
 || [ln(1 + coalesce(fr.n, 0)) / 10, ln(1 + coalesce(lc.n, 0)) / 10, (coalesce(fr.n, 0) <= 1)::int, coalesce(fr.rank, 1)]::double[] || coalesce(c.x, list_transform(range(8), lambda i: 0::double)){grams[1]})::float[] end as x
from w left join q on q.id = w.tag_id left join c on c.id = w.form_id left join fr on fr.form_id = w.form_id left join lc on lc.lemma_id = w.lemma_id{grams[2]}"""


SQL["f15_featurizer_scalars64"] = _scalar_sql()
SQL |= {f"f15_featurizer_ngrams{64 + b}": _scalar_sql(b) for b in (16, 32, 64)}
SQL["f14_ngram_features"] = f"with {_ngram_sql(16)} select id, array_to_string(list_transform(g, lambda v: round(v, 6)::varchar), ',') as x from ng"
