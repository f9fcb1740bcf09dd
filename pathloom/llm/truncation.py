"""Texts that were cut off: a stack automaton for structure, and baselines for the rest.

Every text is read once by a stack automaton for markup, brackets and quotes, which also looks at
how it ends: with a sign of omission, a broken character, escape, entity or tag, a mark that only
stands between things, a closing mark, or a bare word. Whether a bare end is a finished one
depends on what the corpus does:

* a source that stores texts up to a fixed length, or to one after another (far more have that
  length than those near it), has cut those of that length, in characters or in bytes of UTF-8;
* a source or genre whose texts mostly end bare has no habit of a closing mark; its texts are cut
  where the last word is the beginning of a common one and, next to that, no word of the corpus;
* lists of records are cut where the last field never ends a line elsewhere;
* in all others a bare end is a cut, unless the last word (numbers alike), or the first word of a
  last line that ends with a number, closes texts habitually: signatures, colophons, references.

All counts are over all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir

FLUSH_WORDS = 300_000
#: a limit in bytes may fall into a character, which then is dropped or replaced
BYTE_SLACK = 3
LONGER_SHARE = 0.02
#: the neighbourhood of a length has at least so many lengths on either side
NEAR_LENGTHS = 10
#: what a genre's double dandas, or a word's full stops before lower case, must surely reach as a share
SURE_SHARE = 0.8
#: a limit has so many times the texts that the lengths below it would let expect, or those on both sides
LIMIT_RISE = 5
LIMIT_PEAK = 20
#: an abbreviation ends a sentence, or stands without its full stop, in less than this share of cases
ABBREVIATION_SHARE = 0.05
#: documents that have no lead are spread over so many keys of its join
NO_LEADS = 4_096
#: beginnings up to this length are looked up letter by letter, longer ones by their first 2, 4, 8 ... times as many
SHORT_BEGINNING = 16
PUNCTUATION = "|।॥.,;:!?()[]{}\"“”„«»'’‘<>…=—–-�*"
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*+)[^<>]*+>")
_MARK = re.compile(r"<(/?)([A-Za-z][\w:.-]*+)[^<>]*+>|[()\[\]{}“”„«»\"]")
_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "”", "«": "»"}
_OMISSION = re.compile(r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\))$")
_BROKEN = re.compile(r"(?:�|[\ud800-\udbff]|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|&#?[A-Za-z0-9]{0,8}|%[0-9A-Fa-f]?|</?[A-Za-z]?[^<>\s]*|<[A-Za-z][^<>]*)$")
_BETWEEN = re.compile(r"[,;:=(\[{“„«_+/\-–—]$")
_CLOSED = re.compile(r"(\|\||॥|[|।.!?])[\s)\]}”’»\"']*$")
_SENTENCE = re.compile(r"[.!?|।॥]\s")
_PART = re.compile(r"[.!?|।॥]\s+|[\r\n]+")
_DIGITS = re.compile(r"\d+")
_FIELDS = re.compile(r"[|;]|(?<=\s)=(?=\s)")


def unclosed(text: str) -> list[tuple[str, int]]:
    """What a stack automaton still holds at the end: names and places of tags, brackets and quotes.

    A closing sign without its opening one is ignored; one that closes an outer element closes
    the inner ones with it. Apostrophes are letters here. The empty text holds nothing.
    """
    stack: list[tuple[str, int]] = []
    held: defaultdict[str, int] = defaultdict(int)  # how many of each name the stack holds

    def push(name: str, at: int) -> None:
        stack.append((name, at))
        held[name] += 1

    for m in _MARK.finditer(text):
        sign = m.group()
        if sign == '"':
            want = sign
            if not held[sign]:
                push(sign, m.start())
                continue
        elif sign[0] == "<":
            want = "</" + m.group(2) + ">"
            if sign[-2] == "/":
                continue
            if not m.group(1):
                push(want, m.start())
                continue
        elif sign in _OPENERS:
            push(_OPENERS[sign], m.start())
            continue
        else:
            want = sign
        if held[want]:
            name = None
            while name != want:
                name = stack.pop()[0]
                held[name] -= 1
    return stack


def tokens(text: str) -> list[str]:
    """White-space words of a text without markup; digits are alike, a number goes with the word before it."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    numbered = _DIGITS.sub("9", text)
    words = numbered.split()
    if "9" in numbered:
        bare = [w.strip(PUNCTUATION) for w in words]
        words = [f"{words[i - 1]} {b}" if b[:1] == "9" and i else w for i, (w, b) in enumerate(zip(words, bare, strict=True))]
    return words


def is_record_list(lines: list[str]) -> bool:
    """Whether most lines are records of named or separated fields."""
    return bool(lines) and 2 * sum("=" in line for line in lines) > len(lines)


def word_counts(texts: Iterator[str | None]) -> Iterator[tuple[str, int]]:
    """(word, n) of all words but each text's last, and of marked things.

    ``word. a`` and ``word. A``: the word with a full stop, before a lower-case letter or digit,
    and before anything else. ``=field``: a field that ends a line but the last. ``</tag>``: a
    closing tag.
    """
    counts: Counter[str] = Counter()

    def flush() -> Iterator[tuple[str, int]]:
        out: Counter[str] = Counter()
        for word, n in counts.items():
            if word[:1] in "\0\1":
                out[("=" if word[:1] == "\0" else "") + word[1:]] += n
                continue
            bare = word.strip(PUNCTUATION)
            if bare:
                out[bare] += n
        yield from out.items()

    for text in texts:
        if not text:
            continue
        words = tokens(text)
        counts.update(words[:-1])
        if "." in text:  # what goes on in lower case or with a number after a full stop, and what does not
            for w, then in zip(words, words[1:], strict=False):
                if w[-1] == ".":
                    counts["\1" + w.strip(PUNCTUATION) + (". a" if then[:1].islower() or then[:1] == "9" else ". A")] += 1
        if "</" in text:
            counts.update("\1" + f"</{m.group(2)}>" for m in _TAG.finditer(text) if m.group(1))
        if "=" in text:
            lines = [x for x in text.splitlines() if x.strip()]
            if is_record_list(lines):
                counts.update("\0" + _FIELDS.split(x)[-1].strip() for x in lines[:-1])
        if len(counts) > FLUSH_WORDS:
            yield from flush()
            counts = Counter()
    yield from flush()


def ending(text: str) -> tuple[str, str, str, str, str, bool, list[str]]:
    """(state, mark, kind, key, lead, gap, open tags) of a text that isn't blank.

    state: omission, broken, unclosed, between, closed or bare. mark: the closing mark, if any.
    kind: records, line (one line without a mark inside) or text. key: what is looked up: the last
    field of a list of records, else the last word. lead: the first word of the last sentence or
    line, where that ends with a number. gap: white space without a line end follows.
    open tags: closing tags that are missing; a bracket or quote counts where it opens in the last
    sentence, or no closing mark follows it.
    """
    end = text.rstrip()
    gap = text[len(end) :]
    lines = [x for x in end.splitlines() if x.strip()]
    kind = "records" if is_record_list(lines) else "text"
    mark, open_ = _CLOSED.search(end), unclosed(end)
    if kind == "text" and len(lines) == 1 and not re.search(r"[.!?|।॥]", end):
        kind = "line"
    state = "bare"
    if _OMISSION.search(end):
        state = "omission"
    elif _BROKEN.search(end):
        state = "broken"
    elif any(name[0] != "<" and (not mark or not _SENTENCE.search(end, at)) for name, at in open_):
        state = "unclosed"
    elif re.search(r"<[^<>]+>$", end) or mark:
        state = "closed"
    elif _BETWEEN.search(end):
        state = "between"
    words = tokens(end)
    last = words[-1] if words else ""
    if kind == "records":
        key = "=" + _DIGITS.sub("9", _FIELDS.split(lines[-1])[-1].strip())
    else:
        key = last.strip(PUNCTUATION) or last
    lead = ""
    if state == "bare" and re.search(r" 9\w?$|9/9$", key):
        first = tokens(_PART.split(end)[-1])[:1]
        lead = first[0].strip(PUNCTUATION) or first[0] if first else ""
    tags = sorted({name for name, _ in open_ if name[0] == "<"})
    return state, mark.group(1) if mark else "", kind, key, lead, bool(gap) and not re.search(r"[\r\n]", gap), tags


_ENDING = "doc_id long, source string, genre string, n_chars long, n_bytes long, state string, mark string, kind string, key string, lead string, gap boolean, tags array<string>, text_id long"


def _endings(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from hashlib import blake2b

    for batch in batches:
        cols: list[list] = [[] for _ in range(13)]
        for doc, source, genre, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text is None or not text.strip():
                continue
            raw = text.encode("utf-8", "surrogatepass")
            row = (doc, source, genre, len(text), len(raw), *ending(text), int.from_bytes(blake2b(raw, digest_size=8).digest(), "big", signed=True))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
        names = [x.split()[0] for x in _ENDING.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def texts() -> Iterator[str | None]:
        for batch in batches:
            yield from batch.column(0).to_pylist()

    block: list[tuple[str, int]] = []
    for pair in word_counts(texts()):
        block.append(pair)
        if len(block) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in block]), pa.array([n for _, n in block], pa.int64())], names=["word", "n"])
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in block]), pa.array([n for _, n in block], pa.int64())], names=["word", "n"])


def _at_least(part: Column, whole: Column) -> Column:
    """The lower 95 % confidence bound (Wilson, one-sided) of the share part / whole; 0 of nothing."""
    z2 = 1.645**2
    p = part / F.nullif(whole, F.lit(0))
    low = (p + z2 / (2 * whole) - 1.645 * F.sqrt(p * (1 - p) / whole + z2 / (4 * whole * whole))) / (1 + z2 / whole)
    return F.coalesce(F.when(whole > 0, low), F.lit(0.0))


def _limits(ends: DataFrame, column: str, slack: int, copies: int) -> DataFrame:
    """(source, <column>, limit_<column>): the lengths at which a source cuts texts, with the slack; a source may have several.

    A limit is a length that at least ``copies`` different texts have, and that has five times the
    texts that the lengths below it would let expect where next to none are longer, or, counted in
    characters, twenty times what those on either side would (a limit that did not always hold).
    Of lengths in each other's slack the commonest is the limit.
    """
    import pandas as pd

    counts = ends.groupBy("source", F.col(column).alias("l")).agg(F.countDistinct("text_id").alias("texts"), F.count("*").alias("docs"))

    def spikes(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("l")
        l, texts = part["l"].to_numpy(), part["texts"].to_numpy()
        docs = np.concatenate([[0], part["docs"].to_numpy().cumsum()])
        ats = np.concatenate([[0], texts.cumsum()])
        place = lambda x, side="left": np.searchsorted(l, x, side)
        near = np.maximum(0.3 * l, NEAR_LENGTHS)
        low, high = place(l - slack), place(l + slack, "right")
        below, above = docs[low] - docs[place(l - near)], docs[place(l + near, "right")] - docs[high]
        at, longer = ats[high] - ats[low], docs[-1] - docs[high]
        width = (2 * slack + 1) / near
        good = (longer <= LONGER_SHARE * docs[-1]) & (at >= LIMIT_RISE * below * width)
        # a limit in characters also shows among the bytes of ASCII texts, so there it must hold for all
        if slack == 0:
            good |= at >= LIMIT_PEAK * np.maximum(below, above) * width
        kept: list[int] = []
        passed = np.flatnonzero(good & (texts >= copies))
        for i in passed[np.lexsort((-l[passed], -texts[passed]))]:
            if slack == 0 or all(abs(l[i] - k) > 2 * slack for k in kept):
                kept.append(int(l[i]))
        return pd.DataFrame({"source": part["source"].iloc[0], "l": pd.Series(kept, dtype="int64")})

    found = counts.groupBy("source").applyInPandas(spikes, "source string, l long")
    return found.select("source", F.explode(F.sequence(F.col("l") - slack, F.col("l") + slack)).alias(column), F.col("l").alias(f"limit_{column}"))


def _beginnings(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, longer): for each of the ``keys`` the occurrences of the commonest longer word that begins with it.

    A word is found by its beginnings of 1 to SHORT_BEGINNING letters and of 2, 4, 8 ... times as
    many, so what a word of n letters makes is in proportion to n. A longer key is looked up by the
    longest of those that it has, and then compared. Only beginnings that some key asks for are
    kept before counts meet.
    """
    short, double = F.lit(SHORT_BEGINNING), lambda n: F.floor(F.log2(n / F.lit(SHORT_BEGINNING))).cast("int")
    every = F.sequence(F.lit(1), F.least(F.length("word"), short))
    powers = F.transform(F.sequence(F.lit(1), F.greatest(double(F.length("word")), F.lit(1))), lambda i: short * F.pow(F.lit(2), i).cast("int"))
    steps = F.filter(F.concat(every, powers), lambda i: i <= F.length("word"))
    each = words.where("word <> ''").select("word", "n", F.explode(steps).alias("at")).select("word", "n", "at", F.substring("word", F.lit(1), F.col("at")).alias("begin"))
    at = F.when(F.length("key") <= short, F.length("key")).otherwise(short * F.pow(F.lit(2), double(F.length("key"))).cast("int"))
    asked = keys.where("key <> ''").select("key", at.alias("at")).select("key", F.substring("key", F.lit(1), F.col("at")).alias("begin"))
    exact = each.where((F.col("at") <= short) & (F.col("begin") != F.col("word"))).groupBy("begin").agg(F.max("n").alias("longer"))
    exact = asked.where(F.length("key") <= short).join(exact, "begin").select("key", "longer")
    near = each.where(F.col("at") >= short).join(asked.where(F.length("key") > short), "begin")
    near = near.where(F.col("word").startswith(F.col("key")) & (F.col("word") != F.col("key"))).select("key", F.col("n").alias("longer"))
    return exact.unionByName(near).repartition("key").groupBy("key").agg(F.max("longer").alias("longer"))


def truncated(
    documents: DataFrame, limit_copies: int = 5, bare_habit: float = 0.5, common_word: int = 3, closer_texts: int = 3, closer_share: float = 0.3, fragment_share: float = 0.001
) -> DataFrame:
    """(doc_id, source, reason) of every document whose text breaks off.

    ``documents`` has doc_id, text, source and genre. Null, empty and blank texts are no cases; a
    null source or genre is one of its own. A document is judged by its own text and the counts
    over all, so repeated rows are judged alike and come out as often as they come in.
    ``limit_copies``: texts of one length that can make it a source's limit; ``bare_habit``:
    share of bare ends above which a source or genre closes without a mark; ``common_word``:
    occurrences that make a word common; ``closer_texts`` and ``closer_share``: texts that a word
    must close, and its share of closing occurrences, to be a habitual closer; ``fragment_share``:
    occurrences of a beginning, for one of the word it begins, up to which it is no word itself.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    base = documents.select("doc_id", "source", "genre", "text")
    ends = base.mapInArrow(_endings, _ENDING).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("genre", F.coalesce("genre", F.lit(""))).checkpoint()
    words = base.select("text").where("text is not null").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    at_chars, at_bytes = (_limits(ends, column, slack, limit_copies) for column, slack in (("n_chars", 0), ("n_bytes", BYTE_SLACK)))
    plain = (F.col("kind") != "records") & F.col("state").isin("bare", "closed")
    share = F.avg(F.when(plain, (F.col("state") == "bare").cast("double")))
    by_source = ends.where("kind = 'text'").groupBy("source").agg(share.alias("source_bare"))
    by_genre = ends.groupBy("genre").agg(share.alias("genre_bare"))
    marks = ends.where("state = 'closed' and mark <> ''").withColumn("mark", F.translate("mark", "।॥", "|‖")).withColumn("mark", F.replace("mark", F.lit("||"), F.lit("‖")))
    per_mark = marks.groupBy("genre", "mark").agg(F.count("*").alias("m"))
    per_genre = per_mark.groupBy("genre").agg(F.sum("m").alias("all"), F.sum(F.when(F.col("mark") == "‖", F.col("m")).otherwise(0)).alias("double"))
    # a genre that closes with a double danda has not come to its end at a single one
    sure = _at_least(F.col("double"), F.col("all")) >= SURE_SHARE
    odd_marks = per_genre.where(sure).select("genre", F.lit("|").alias("mark_"), F.lit(True).alias("odd_mark"))
    marked = ends.withColumn("mark_", F.replace(F.translate("mark", "।॥", "|‖"), F.lit("||"), F.lit("‖")))
    keys = ends.where("state in ('bare', 'closed')").select("key", "state", "text_id").groupBy("key").agg(F.countDistinct(F.when(F.col("state") == "bare", F.col("text_id"))).alias("final"))
    stops = words.where(F.col("word").rlike(r"\. [aA]$")).withColumn("key", F.regexp_replace("word", r"\. [aA]$", ""))
    stops = stops.groupBy("key").agg(*[F.sum(F.when(F.col("word").endswith(x), F.col("n")).otherwise(0)).alias(name) for x, name in ((". a", "going_on"), (". A", "ending"))])
    begins = _beginnings(words.where(F.col("n") >= common_word), keys)
    known = (
        keys.join(words.withColumnRenamed("word", "key"), "key", "left")
        .join(begins, "key", "left")
        .join(stops, "key", "left")
        .na.fill(0, ["n", "longer", "going_on", "ending"])
    )
    # signatures and references that end with a number: known by the word they begin with
    leads = ends.where("state = 'bare' and lead <> ''").groupBy("lead").agg(F.countDistinct("text_id").alias("lead_final"))
    leads = leads.join(words.select(F.col("word").alias("lead"), F.col("n").alias("lead_n")), "lead", "left").na.fill(0, ["lead_n"]).withColumnRenamed("lead", "led")
    # a tag that is closed nowhere is no element
    elements = words.where(F.col("word").startswith("</")).select(F.col("word").alias("tag"))
    open_docs = ends.where(F.size("tags") > 0).select("doc_id", F.explode("tags").alias("tag")).join(elements, "tag", "left_semi").select("doc_id", F.lit(True).alias("open_tag")).distinct()
    judged = (
        marked.join(known, "key", "left")
        .join(at_chars, ["source", "n_chars"], "left")
        .join(at_bytes, ["source", "n_bytes"], "left")
        .join(by_source, "source", "left")
        .join(by_genre, "genre", "left")
        .join(odd_marks, ["genre", "mark_"], "left")
        .join(leads, F.coalesce(F.nullif("lead", F.lit("")), F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(NO_LEADS)).cast("string"))) == F.col("led"), "left")
        .join(open_docs, "doc_id", "left")
    )
    at_limit = F.col("limit_n_chars").isNotNull() | F.col("limit_n_bytes").isNotNull()
    closer = (F.col("final") >= closer_texts) & (F.col("final") >= closer_share * (F.col("n") + F.col("final"))) & (F.col("longer") < F.col("final"))
    numbered = F.coalesce((F.col("lead_final") >= closer_texts) & (F.col("lead_final") >= closer_share * F.col("lead_n")), F.lit(False))
    weak = (F.coalesce("source_bare", F.lit(0.0)) > bare_habit) | (F.coalesce("genre_bare", F.lit(0.0)) > bare_habit) | ((F.col("genre") == "") & (F.col("kind") == "line"))
    cut_word = (F.col("n") <= fragment_share * F.col("longer")) & (F.col("longer") >= common_word)
    dotted = F.col("going_on") + F.col("ending")
    abbreviation = (F.col("mark") == ".") & (_at_least(F.col("going_on"), dotted) >= SURE_SHARE) & (F.col("ending") < ABBREVIATION_SHARE * dotted) & (F.col("n") - dotted < ABBREVIATION_SHARE * dotted)
    reason = (
        F.when(F.col("state").isin("omission", "broken", "unclosed", "between"), F.col("state"))
        .when(F.col("open_tag"), "unclosed")
        .when(F.col("state") == "closed", F.when(abbreviation, "abbreviation").when(F.col("odd_mark"), "mark"))
        .when(at_limit, "limit")
        .when(F.col("gap"), "gap")
        .when(F.col("kind") == "records", F.when(F.col("n") == 0, "field"))
        .when(weak, F.when(cut_word, "word"))
        .when(~(closer | numbered), "sentence")
    )
    return judged.select("doc_id", "source", reason.alias("reason")).where("reason is not null")


def truncation_report(documents: DataFrame, **parameters) -> DataFrame:
    """Per source: documents, documents that stop, their share. A null source has the name ''."""
    cut = truncated(documents, **parameters).groupBy("source").agg(F.count("*").alias("cut"))
    total = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("documents"))
    return total.join(cut, "source", "left").select(
        "source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("documents"), 6).alias("share")
    )
