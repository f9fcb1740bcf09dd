"""The same or nearly the same records in training and evaluation splits.

Every evaluation text is cut into disjoint passages, two more than it can have edits in a partner
of allowed length, or as many as it has letters. By the pigeonhole principle a partner holds at
least two of them unchanged, shifted by no more than the number of edits. The passages of a shard
of evaluation texts make one Aho-Corasick automaton that scans training texts; every match is an
interval of an evaluation text. The merged intervals of one evaluation text in one training text are
its coverage; where the coverage says that enough passages are there, the edit distance decides
exactly.

Evaluation texts are written once to the shared folder, by band of length. Training texts are moved
once, to a task that holds texts of one band, of a bounded number of letters. The task streams
the evaluation texts of its own and the two neighbouring bands (no other length can be near) from the
folder, a shard of bounded size at a time, and scans its texts with each shard's automaton. So every
evaluation text is set against every training text that can be near without a pair being made
first, and what is moved grows with the texts and not with their product.

Equal texts are one text. The result is pairs of distinct texts with the number of sentences on either
side; pairs of sentences are expanded from it, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.translit import slp1_letters
from ..tables import ensure_checkpoint_dir
from . import shared

#: letters of the evaluation texts of one automaton, and of the training texts of one task
SHARD_LETTERS = 1_000_000
PART_LETTERS = 16_000_000
#: a task holds at least so many letters, however many cores there are
LEAST_PART = 100_000
#: letters of training texts that are scanned together
STEP_LETTERS = 500_000
#: sentences of one text that are expanded to pairs together
MEMBER_BLOCK = 1_000
#: texts whose repeated letters a task leaves out; a full memory is emptied
SEEN_TEXTS = 200_000
#: above the greatest ratio of two near lengths, ten ninths
BAND_RATIO = 1.12
PER = 10


def within(a: str, b: str, limit: int) -> int | None:
    """The edit distance of two texts if at most ``limit``, by a bit-parallel column sweep."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return None
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    m = len(a)
    if not m or not len(b):
        d = max(m, len(b))
        return d if d <= limit else None
    eq: dict[str, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | (1 << i)
    mask, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = mask, 0, m, len(b)
    for c in b:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        left -= 1
        if score - left > limit:
            return None
        ph = (ph << 1 | 1) & mask
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv
    return score if score <= limit else None


def most_edits(n: int, per: int = PER) -> int:
    """The most edits in a partner of a text of n letters: of d edits the longer has 10 d letters at least."""
    return n // (per - 1)


def cuts(n: int, per: int = PER) -> tuple[list[int], int]:
    """The ends of the passages of a text of n letters, and how many of them a partner has at least."""
    d = most_edits(n, per)
    k = min(d + 2, n)
    return [n * j // k for j in range(k + 1)], k - d


def letter_counts(texts: list[str], kinds: int = 58) -> np.ndarray:
    """How often each text has each kind of letter; a kind is a class of letters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4") % kinds
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * kinds + codes, minlength=len(texts) * kinds).reshape(len(texts), kinds)


class PassageShard:
    """The automaton of one shard of evaluation texts."""

    def __init__(self, ids: list[str], texts: list[str], per: int = PER):
        import ahocorasick

        self.ids, self.texts, self.per = ids, texts, per
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.need = np.zeros(len(texts), dtype=np.int64)
        self.counts = letter_counts(texts)
        names: dict[str, int] = {}
        owner, begin, end, passage, number = [], [], [], [], []
        for i, text in enumerate(texts):
            ends, self.need[i] = cuts(len(text), per)
            for j in range(len(ends) - 1):
                owner.append(i)
                number.append(j)
                begin.append(ends[j])
                end.append(ends[j + 1])
                passage.append(names.setdefault(text[ends[j] : ends[j + 1]], len(names)))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, p in names.items():
            self.automaton.add_word(name, p)
        self.automaton.make_automaton()
        # postings sorted by (passage, end in the evaluation text): a match looks only at ends nearby
        self.span = int(self.lengths.max()) + 1 if len(texts) else 1
        key = np.array(passage, dtype=np.int64) * self.span + np.array(end, dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner, self.begin, self.end, self.number = (np.array(x, dtype=np.int64)[order] for x in (owner, begin, end, number))

    def scan(self, ids: list[str], texts: list[str], letters: int = STEP_LETTERS) -> Iterator[tuple[str, str, int, float]]:
        """(evaluation id, training id, edits, coverage) of every pair within the limit."""
        first, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= letters:
                yield from self._scan(ids[first : k + 1], texts[first : k + 1])
                first, held = k + 1, 0
        yield from self._scan(ids[first:], texts[first:])

    def _scan(self, ids: list[str], texts: list[str]) -> Iterator[tuple[str, str, int, float]]:
        ends, passages, where = [], [], []
        for t, text in enumerate(texts):
            found = list(self.automaton.iter(text))
            if found:
                e, p = zip(*found, strict=True)
                ends.extend(e)
                passages.extend(p)
                where.extend([t] * len(e))
        if not ends:
            return
        end, passage, where = np.array(ends, dtype=np.int64) + 1, np.array(passages, dtype=np.int64), np.array(where, dtype=np.int64)
        length = np.array([len(t) for t in texts], dtype=np.int64)[where]
        reach = most_edits(length, self.per)
        low = np.searchsorted(self.key, passage * self.span + np.maximum(end - reach, 0), side="left")
        high = np.searchsorted(self.key, passage * self.span + np.minimum(end + reach, self.span - 1), side="right")
        count = np.maximum(high - low, 0)
        match = np.repeat(np.arange(len(count)), count)
        posting = np.arange(len(match)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        e, n, m = self.owner[posting], length[match], self.lengths[self.owner[posting]]
        limit = np.maximum(n, m) // self.per
        near = (np.abs(n - m) <= limit) & (np.abs(end[match] - self.end[posting]) <= limit)
        posting, match, e = posting[near], match[near], e[near]
        if not len(e):
            return
        # an interval (passage of e) counts once per training text, however often it matches
        pair = where[match] * len(self.texts) + e
        interval = np.unique(pair * (int(self.number.max()) + 1) + self.number[posting], return_index=True)[1]
        pair, posting = pair[interval], posting[interval]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pairs, matched = pair[start], np.diff(np.r_[start, len(pair)])
        covered = np.add.reduceat(self.end[posting] - self.begin[posting], start)
        enough = matched >= self.need[pairs % len(self.texts)]
        pairs, covered = pairs[enough], covered[enough]
        t, i = pairs // len(self.texts), pairs % len(self.texts)
        # an edit drops one letter at most and brings one at most, so letters alone tell most pairs apart
        more = self.counts[i] - letter_counts(texts)[t]
        least = np.maximum(np.where(more > 0, more, 0).sum(axis=1), np.where(more < 0, -more, 0).sum(axis=1))
        near = least <= np.maximum(self.lengths[i], np.array([len(x) for x in texts], dtype=np.int64)[t]) // self.per
        for t, i, c in zip(t[near].tolist(), i[near].tolist(), covered[near], strict=True):
            a, b = self.texts[i], texts[t]
            edits = within(a, b, max(len(a), len(b)) // self.per)
            if edits is not None:
                yield self.ids[i], ids[t], edits, float(c) / len(a)


_PAIR = T.StructType(
    [T.StructField("eval_text", T.BinaryType()), T.StructField("train_text", T.BinaryType()), T.StructField("edits", T.IntegerType()), T.StructField("coverage", T.DoubleType())]
)


def latest_splits(splits: DataFrame) -> DataFrame:
    """One row (sentence_id, split): the name with the latest assigned_at, trimmed, in lower case.

    Rows without identifier or time are no assignments; of two names at the same time the greater
    string holds. A null or blank name is no split.
    """
    last = splits.where("sentence_id is not null and assigned_at is not null").groupBy("sentence_id").agg(F.max(F.struct("assigned_at", "splits")).alias("s"))
    name = F.lower(F.regexp_replace(F.col("s.splits"), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return last.select("sentence_id", name.alias("split")).where("split is not null and split <> ''")


_TEXT = "sentence_id long, split string, is_eval boolean, source string, text_key binary, n_letters int, letters string"


def _letters(batches: Iterator, training: str) -> Iterator:
    """Rows of labelled_texts; the letters of a text that the task has had before are null."""
    from hashlib import md5

    import pyarrow as pa

    seen: set[tuple[bool, bytes]] = set()
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for sid, split, source, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            letters = slp1_letters(text)
            if not letters:
                continue
            key, is_eval = md5(letters.encode()).digest(), split != training
            again = (is_eval, key) in seen
            if len(seen) >= SEEN_TEXTS:
                seen.clear()
            seen.add((is_eval, key))
            for c, v in zip(out, (sid, split, is_eval, source, key, len(letters), None if again else letters), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _TEXT.split(", ")])


def labelled_texts(sentences: DataFrame, splits: DataFrame, evaluation: tuple[str, ...] = ("dev", "test"), training: str = "train") -> DataFrame:
    """(sentence_id, split, is_eval, source, text_key, n_letters, letters) of the sentences of the splits.

    Sentences of no split, without text or without letters are left out. Repeated deliveries of a
    sentence are one. ``text_key`` is the MD5 of the letters: equal texts are one text. ``letters``
    is null where the same task has given them for that text and side already, so a text that many
    sentences share costs one row of letters per task and not one per sentence.
    """
    one = sentences.select("sentence_id", "surface_text", "source").where("sentence_id is not null and surface_text is not null")
    named = latest_splits(splits).where(F.col("split").isin(training, *evaluation))
    one = one.groupBy("sentence_id").agg(F.first("surface_text").alias("surface_text"), F.first("source").alias("source"))
    return one.join(named, "sentence_id").select("sentence_id", "split", "source", "surface_text").mapInArrow(lambda b: _letters(b, training), _TEXT)


def length_band(n: Column) -> Column:
    """The band of a text of n letters: partners' lengths differ by a ninth at most, so their bands by one at most."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND_RATIO))).cast("int")


def _parts(letters: dict[int, int], lanes: int, part_letters: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Per band (number of parts, first part), and the number of parts: more than lanes, if there is enough to do."""
    size = min(part_letters, max(min(LEAST_PART, part_letters), -(-sum(letters.values()) // (2 * lanes))))
    plan, first = {}, 0
    for band in sorted(letters):
        n = max(1, -(-letters[band] // size))
        plan[band] = (n, first)
        first += n
    return plan, first


def _shards(folder: str, bands: tuple[int, ...], shard_letters: int, per: int) -> Iterator[PassageShard]:
    """The automata of the evaluation texts of some bands, one after another."""
    keys: list[bytes] = []
    texts: list[str] = []
    held = 0
    for band in bands:
        for batch in shared.read(folder, "band", band, ["text_key", "letters"]):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                held += len(text)
                if held >= shard_letters:
                    yield PassageShard(keys, texts, per)
                    keys, texts, held = [], [], 0
    if texts:
        yield PassageShard(keys, texts, per)


def _scan(batches: Iterator, folder: str, shard_letters: int, per: int) -> Iterator:
    """Pairs of the training texts (band, text_key, letters) of a task, which are few enough to hold."""
    import pyarrow as pa

    held: dict[int, dict[bytes, str]] = {}
    for batch in batches:
        for band, key, letters in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(band, {})[key] = letters
    for band, texts in sorted(held.items()):
        keys, letters = list(texts), list(texts.values())
        for shard in _shards(folder, (band - 1, band, band + 1), shard_letters, per):
            found = list(shard.scan(keys, letters))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.float64()))], names=_PAIR.names)


def near_texts(texts: DataFrame, shard_letters: int = SHARD_LETTERS, part_letters: int = PART_LETTERS, per: int = PER) -> DataFrame:
    """(eval_text, train_text, edits, coverage): all pairs of distinct texts within the limit.

    ``texts`` has text_key, n_letters, letters and is_eval as ``labelled_texts`` gives them and is
    read several times, so it should be a stored table. Only the letters per band of training texts
    go to the driver (bands grow with the logarithm of the greatest length). Training texts are
    exchanged once, distinct evaluation texts once and written; a task reads the evaluation texts of
    three bands. A task holds about ``part_letters`` letters of training texts and
    one automaton of about ``shard_letters``, or one text, if that is longer. No side: no pairs.
    ``per`` is 10 or more, or bands would be too narrow.
    """
    if per < 10:
        raise ValueError("per must be at least 10")
    banded = texts.where("letters is not null").withColumn("band", length_band(F.col("n_letters")))
    evals = banded.where("is_eval").groupBy("band", "text_key").agg(F.first("letters").alias("letters"))
    folder = shared.store(evals, "evaluation-texts", "band")
    sized = banded.where("not is_eval").groupBy("band").agg(F.sum("n_letters").alias("n")).collect()
    plan, width = _parts({r["band"]: r["n"] for r in sized}, int(texts.sparkSession.sparkContext.defaultParallelism), part_letters)
    if not plan:
        return texts.sparkSession.createDataFrame([], _PAIR)
    known = lambda i: F.element_at(F.create_map(*[F.lit(x) for band, at in plan.items() for x in (band, at[i])]), F.col("band"))
    part = known(1) + F.pmod(F.xxhash64("text_key"), known(0)).cast("int")
    trains = banded.where("not is_eval").select("band", "text_key", "letters", part.cast("int").alias("part")).repartitionById(width, "part")
    return trains.select("band", "text_key", "letters").mapInArrow(lambda b: _scan(b, folder, shard_letters, per), _PAIR)


def stored_texts(sentences: DataFrame, splits: DataFrame) -> DataFrame:
    """labelled_texts, written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(sentences.sparkSession)
    return labelled_texts(sentences, splits).checkpoint()


def _members(texts: DataFrame, is_eval: bool) -> DataFrame:
    """(text_key, members): the sentences of each text of one side, pre-aggregated before they are exchanged."""
    return texts.where(F.col("is_eval") == is_eval).groupBy("text_key").agg(F.count("*").alias("members"))


def overlap_classes(texts: DataFrame) -> DataFrame:
    """(eval_text, train_text, edits, coverage, eval_members, train_members): one row per pair of distinct texts.

    The whole of the links: each text stands for its sentences, of which ``texts`` (as
    ``stored_texts`` gives it) has the list by text_key.
    """
    evals, trains = (_members(texts, flag).withColumnsRenamed({"text_key": name + "_text", "members": name + "_members"}) for flag, name in ((True, "eval"), (False, "train")))
    return near_texts(texts).join(evals, "eval_text").join(trains, "train_text").select(*_PAIR.names, "eval_members", "train_members")


def _blocks(texts: DataFrame, classes: DataFrame, side: str, block: int) -> DataFrame:
    """(<side>_text, <side>_block, <side>_rows): the sentences of the texts that have a partner, in blocks of about ``block``."""
    wanted = classes.groupBy(f"{side}_text").agg(F.first(f"{side}_members").alias("members"))
    rows = texts.where(F.col("is_eval") == (side == "eval")).select(F.col("text_key").alias(f"{side}_text"), "sentence_id", "split", "source")
    salted = rows.join(wanted, f"{side}_text").select(
        f"{side}_text", F.pmod(F.xxhash64("sentence_id"), F.ceil(F.col("members") / block)).alias(f"{side}_block"), F.struct("sentence_id", "split", "source").alias("x")
    )
    return salted.groupBy(f"{side}_text", f"{side}_block").agg(F.collect_list("x").alias(f"{side}_rows"))


def overlap_pairs(sentences: DataFrame, splits: DataFrame, block: int = MEMBER_BLOCK) -> DataFrame:
    """(eval_id, train_id, split, source, edits, coverage): every pair of sentences, each once.

    Expanded from the classes. The sentences of a text are cut into blocks of about ``block``, a
    pair of texts into all pairs of their blocks, so a text that a third of all sentences share is
    many small rows and no key of the joins is hot.
    """
    texts = stored_texts(sentences, splits)
    classes = overlap_classes(texts).checkpoint()
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    cells = classes.select("*", upto("eval_members").alias("eval_block")).select("*", upto("train_members").alias("train_block"))
    for side in ("eval", "train"):
        cells = cells.join(_blocks(texts, classes, side, block), [f"{side}_text", f"{side}_block"])
    each = cells.select("edits", "coverage", F.explode("eval_rows").alias("e"), "train_rows").select("edits", "coverage", "e", F.explode("train_rows").alias("t"))
    return each.select(F.col("e.sentence_id").alias("eval_id"), F.col("t.sentence_id").alias("train_id"), "e.split", "e.source", "edits", "coverage")


def overlap_coverage(sentences: DataFrame, splits: DataFrame) -> DataFrame:
    """Per evaluation sentence with a partner: partners, exact partners, least edits, best coverage."""
    texts = stored_texts(sentences, splits)
    return _partnered(texts, _per_text(texts)).drop("eval_text")


def _per_text(texts: DataFrame) -> DataFrame:
    return (
        overlap_classes(texts)
        .groupBy("eval_text")
        .agg(
            F.sum("train_members").alias("partners"),
            F.sum(F.when(F.col("edits") == 0, F.col("train_members")).otherwise(0)).alias("exact_partners"),
            F.min("edits").alias("least_edits"),
            F.round(F.max("coverage"), 6).alias("best_coverage"),
        )
    )


def _partnered(texts: DataFrame, per_text: DataFrame) -> DataFrame:
    evals = texts.where("is_eval").select("sentence_id", "split", "source", F.col("text_key").alias("eval_text"))
    return evals.join(per_text, "eval_text")


def overlap_report(sentences: DataFrame, splits: DataFrame) -> DataFrame:
    """Per evaluation split and source: sentences with a partner, with an exact one, and pairs.

    Sentences are counted per text, split and source before texts meet their partners.
    """
    texts = stored_texts(sentences, splits)
    evals = texts.where("is_eval").groupBy(F.col("text_key").alias("eval_text"), "split", "source").agg(F.count("*").alias("n"))
    per = evals.join(_per_text(texts), "eval_text")
    return per.groupBy("split", "source").agg(
        F.sum("n").alias("sentences"),
        F.coalesce(F.sum(F.when(F.col("exact_partners") > 0, F.col("n"))), F.lit(0)).alias("exact_sentences"),
        F.sum(F.col("n") * F.col("partners")).alias("pairs"),
    )
