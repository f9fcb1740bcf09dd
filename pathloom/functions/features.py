"""Node features as columns, and the registry of featurizers.

Statistics are fitted on given training sentences only; what depends on a word alone is computed
once per distinct word and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lattice import is_boundary
from ..tables import ensure_checkpoint_dir

# The grammatical tokens of a tag, in feature order; one more feature marks UNKNOWN.
TAG_TOKENS = (
    "nom acc dat abl g loc voc i sg du pl m f n * pr pft impft fut aor opt imp per ac md ps 1 2 3 ppr pfp pp ppa adv ind abs inf iic conj prep part ca"
).split()
# Letter classes of SLP1.
VOWELS, LONG_VOWELS, RETROFLEX = "aAiIuUfFxXeEoO", "AIUFXeEoO", "wWqQRzfF"
WIDTH = 64


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    """The first eight hex digits of the MD5 of the key's text, modulo the number of buckets."""
    digest = F.md5(F.encode(key.cast("string"), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split_name(key: Column, dev: int = 5, test: int = 5) -> Column:
    """dev for the first buckets, test for the next, train for the rest; null for a null key."""
    b = md5_bucket(key)
    return F.when(b < dev, "dev").when(b < dev + test, "test").when(b.isNotNull(), "train")


def tag_bits(tag: Column) -> Column:
    """The 43 multi-hot features of a tag; unknown tokens set nothing, a null tag nothing at all."""
    tokens = F.split(F.replace(F.coalesce(tag, F.lit("")), F.lit("."), F.lit(" ")), r"\s+")
    bits = [F.array_contains(tokens, t).cast("double") for t in TAG_TOKENS]
    return F.array(*bits, F.coalesce((tag == "UNKNOWN").cast("double"), F.lit(0.0)))


def length_features(length: Column) -> Column:
    """log1p, twentieths up to 1, and the classes short (3), middle (8) and long."""
    n = length.cast("double")
    one = lambda c: c.cast("double")
    return F.array(F.log1p(n), F.greatest(F.least(n / 20, F.lit(1.0)), F.lit(0.0)), one(n <= 3), one((n > 3) & (n <= 8)), one(n > 8))


def _clip(col: Column) -> Column:
    return F.greatest(F.least(col, F.lit(1.0)), F.lit(0.0))


def position_features(nodes: DataFrame, text_length: str = "text_length") -> DataFrame:
    """nodes with ``position_x``: start and end in the sentence, distance to the chunk's end, chunk number.

    A chunk is as wide as its furthest reaching candidate. Boundaries start at 0.
    """
    reach = F.col("position") + F.col("length")
    width = F.greatest(F.max(reach).over(W.partitionBy("sentence_id", F.greatest("chunk", F.lit(0)))), F.lit(1)).cast("double")
    total = F.greatest(F.coalesce(F.col(text_length), F.lit(0)), F.lit(1)).cast("double")
    start = F.greatest(F.col("char_start"), F.lit(0)).cast("double")
    x = F.array(_clip(start / total), _clip((start + F.col("length")) / total), _clip((width - reach) / width), _clip(F.greatest("chunk", F.lit(0)).cast("double") / 20))
    return nodes.withColumn("position_x", x)


def word_counts(nodes: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """(column, n): occurrences over the non-boundary nodes of the training sentences."""
    kept = nodes.where(~is_boundary()).join(train.select("sentence_id").distinct(), "sentence_id", "left_semi")
    return kept.groupBy(column).agg(F.count("*").alias("n"))


def frequency_ranks(counts: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(column, n, rank): rank by count descending and id ascending, scaled to [0, 1]; unseen ids have n 0.

    The order is total, so ranks come from sizes of id ranges and not from one sorted task: a
    range partitioning by the order, numbered within and shifted by the ranges before.
    """
    return _ranked(ids.select(column).distinct().join(counts, column, "left").na.fill(0, ["n"]), column)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in a total order without gathering them in one task.

    Rows are range-partitioned and sorted; each is numbered within its partition, and the sizes of
    the partitions before are added. Only one count per partition is joined back. The ranges are
    stored in the shared checkpoint folder, since both sides must see the same ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    first = ranged.groupBy("_part").agg(F.min("_row").alias("_low"), F.count("*").alias("_size"))
    before = first.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition, so its size is bounded by their number
    return ranged.join(F.broadcast(before.select("_part", "_low", "_before")), "_part").withColumn(name, F.col("_row") - F.col("_low") + F.col("_before")).drop("_part", "_row", "_low", "_before")


def frequency_features(form_n: Column, lemma_n: Column, rank: Column) -> Column:
    """log1p / 10 of both counts, whether the form is unseen or seen once, and the form's rank."""
    return F.array(F.log1p(form_n.cast("double")) / 10, F.log1p(lemma_n.cast("double")) / 10, (form_n <= 1).cast("double"), rank)


def character_features(word: Column) -> Column:
    """Eight rates and flags of an SLP1 word; the empty and the null word have all zero."""
    n = F.length(word).cast("double")
    gone = lambda letters: F.length(F.regexp_replace(word, f"[{letters}]", ""))
    consonants = F.regexp_replace(word, f"[{VOWELS}]", " ")
    runs = F.regexp_replace(F.regexp_replace(consonants, r"[^ ]([^ ]*)", "$1"), " ", "")
    flag = lambda pattern: word.rlike(pattern).cast("double")
    x = F.array(
        (n - gone(VOWELS)) / n, F.length(runs) / F.greatest(n - 1, F.lit(1.0)), (n - gone(RETROFLEX)) / n,
        flag("H"), flag("M"), flag(f"[{VOWELS}]$"), flag(f"^[{VOWELS}]"), flag(f"[{LONG_VOWELS}]$"),
    )
    return F.when(F.length(word) > 0, x).otherwise(F.array(*[F.lit(0.0)] * 8))


def ngram_features(word: Column, buckets: int = 16, orders: tuple[int, ...] = (2, 3)) -> Column:
    """Share of a word's character n-grams in each CRC-32 bucket; all zero where it has none."""
    w = F.coalesce(word, F.lit(""))

    def grams(n: int) -> Column:
        starts = F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))

    hashed = F.transform(F.concat(*[grams(n) for n in orders]), lambda g: (F.crc32(F.encode(g, "UTF-8")) % buckets).cast("int"))
    total = F.greatest(F.size(hashed), F.lit(1)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(hashed, lambda h: h == b)) / total)


def remap_ids(counts: DataFrame, column: str, least: int) -> DataFrame:
    """(column, dense): ids seen at least ``least`` times count from 2 in id order; all others are 1 by default, 0 pads."""
    kept = counts.where(F.col("n") >= least).select(column)
    return global_rank(kept, [F.asc(column)], "dense").withColumn("dense", (F.col("dense") + 2).cast("int"))


def frequency_bucket(n: Column) -> Column:
    """The name of a training count's bucket."""
    return F.when(n == 0, "unseen").when(n <= 4, "rare").when(n <= 49, "mid").otherwise("common")


def fit(nodes: DataFrame, train: DataFrame) -> dict[str, DataFrame]:
    """The statistics of a featurizer, from the training sentences given (and no others).

    One pass over the nodes: occurrences per pair of form and lemma, from which both tables come.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    known = train.select("sentence_id", F.lit(1).alias("t")).distinct()
    seen = F.when(is_boundary(), 0).otherwise(F.coalesce("t", F.lit(0)))
    pairs = nodes.select("sentence_id", "form_id", "lemma_id", "chunk").join(known, "sentence_id", "left").groupBy("form_id", "lemma_id").agg(F.sum(seen).alias("n")).checkpoint()
    forms, lemmas = (pairs.groupBy(c).agg(F.sum("n").alias("n")) for c in ("form_id", "lemma_id"))
    return {"forms": _ranked(forms, "form_id"), "lemmas": lemmas}


def _ranked(counts: DataFrame, column: str) -> DataFrame:
    """(column, n, rank): rank by count descending and id ascending, scaled to [0, 1]."""
    placed = global_rank(counts, [F.desc("n"), F.asc(column)], "place")
    last = counts.select(F.greatest(F.count("*") - 1, F.lit(1))).scalar()
    return placed.select(column, "n", (F.col("place") / last).alias("rank"))


def _tags(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    bits = vocab.where("kind = 'tag'").select(F.col("id").alias("tag_id"), tag_bits(F.col("token")).alias("tag_x"))
    return nodes.join(bits, "tag_id", "left").withColumn("tag_x", F.coalesce("tag_x", F.array(*[F.lit(0.0)] * 43)))


def _pad(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0), width - F.size(x)))


def _boundary_zero(df: DataFrame, x: Column, width: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), width)
    return df.select("sentence_id", "node_id", F.when(is_boundary(), zero).otherwise(_pad(x, width)).cast("array<float>").alias("x"))


def morph43(nodes: DataFrame, vocab: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    return _boundary_zero(_tags(nodes, vocab), F.col("tag_x"), WIDTH)


def _scalars(nodes: DataFrame, vocab: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """nodes with all that the scalar vector reads; what a form brings is joined to the vocabulary first, so the nodes meet it once."""
    rows = position_features(_tags(nodes, vocab))
    words = vocab.where("kind = 'form'").select(F.col("id").alias("form_id"), character_features(F.col("token")).alias("char_x"), F.col("token").alias("word"))
    forms = fitted["forms"].withColumnsRenamed({"n": "form_n"}).join(words, "form_id", "full")
    lemmas = fitted["lemmas"].withColumnsRenamed({"n": "lemma_n"})
    return rows.join(forms, "form_id", "left").join(lemmas, "lemma_id", "left").na.fill(0, ["form_n", "lemma_n"]).na.fill(1.0, ["rank"])


def _scalar_vector() -> Column:
    chars = F.coalesce("char_x", F.array(*[F.lit(0.0)] * 8))
    return F.concat("tag_x", length_features(F.col("length")), "position_x", frequency_features(F.col("form_n"), F.col("lemma_n"), F.col("rank")), chars)


def scalars64(nodes: DataFrame, vocab: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    return _boundary_zero(_scalars(nodes, vocab, fitted), _scalar_vector(), WIDTH)


def _ngrams(buckets: int) -> Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame]:
    def run(nodes: DataFrame, vocab: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
        grams = vocab.where("kind = 'form'").select(F.col("id").alias("form_id"), ngram_features(F.col("token"), buckets).alias("gram_x"))
        rows = _scalars(nodes, vocab, fitted).join(grams, "form_id", "left")
        x = F.concat(_scalar_vector(), F.coalesce("gram_x", F.array(*[F.lit(0.0)] * buckets)))
        return _boundary_zero(rows, x, WIDTH + buckets)

    return run


FEATURIZERS: dict[str, Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame]] = {
    "morph43": morph43, "scalars64": scalars64, "ngrams80": _ngrams(16), "ngrams96": _ngrams(32), "ngrams128": _ngrams(64),
}


def register(name: str, run: Callable[[DataFrame, DataFrame, dict[str, DataFrame]], DataFrame]) -> None:
    """Add a featurizer: (nodes with text_length, vocab, fitted) to (sentence_id, node_id, x)."""
    if name in FEATURIZERS:
        raise ValueError(f"featurizer {name!r} is registered already")
    FEATURIZERS[name] = run


def featurize(name: str, nodes: DataFrame, vocab: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """(sentence_id, node_id, x array<float>) by a registered featurizer; boundaries are all zero."""
    if name not in FEATURIZERS:
        raise KeyError(f"unknown featurizer {name!r}; known: {', '.join(sorted(FEATURIZERS))}")
    return FEATURIZERS[name](nodes, vocab, fitted)
