"""Texts that were cut off.

1. *Ends.*  What a text's end looks like (mark of omission, form and marks of
   the last line, last words), read from the whole text; nothing else of a text
   goes on.
2. *Limits.*  Per source, lengths at which far more texts end than at the
   lengths around them.
3. *Word statistics.*  Over all documents: how often each closing word occurs,
   how often it stands at the end of a sentence, and the most frequent longer
   word that begins with it.  Words and their beginnings are counted by hashes
   made in one pass over the distinct words, whatever their length.
4. *Training.*  A sample of at most SAMPLE documents: texts that end as whole
   texts do are negatives, some of them with a mark of omission in place of
   their last full stop; the same texts cut at pseudo-random places, some with
   such a mark, are positives.  Hashed logistic regression on closing
   characters, punctuation, the form of the last line, the last words'
   statistics and whether the length is the source's limit.
5. *Scoring.*  Every document; cut if the calibrated probability is at least
   THRESHOLD.

Defined results: null and empty texts are whole; sources are compared without
case and blanks, a null source is its own; repeated rows count once; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.linear import Sparse, balanced, bucket, logistic, platt
from kestrel.functions.sampling import smallest_hashes
from kestrel.session import by_bytes, materialized, release, spread, text_batches

#: Documents the model is fitted on, at most; the first by a hash of their id.
SAMPLE = 12_000
CUTS = 2
THRESHOLD = 0.5
BITS = 15

_MARK = re.compile(r"\s*(?:…|\.{3,}|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|<\s*(?:truncated|snip|more)[^>]*>)$")
_CHAT = re.compile(r"\[?\(?\d{1,2}:\d\d(?::\d\d)?[\])]?\s")
_LIST = re.compile(r"(?:[-*+•]|\d+[.)])\s")
_TRAILER = re.compile(r"(?:[A-Z][\w]*(?:-[A-Za-z]+)+:\s|(?:[Ff]ix(?:es|ed)?|[Cc]loses?|[Rr]efs?|[Ss]ee|PS|Change-Id|cc|CC)\b:?\s\S)")
_LAST_WORD = re.compile(r"([^\W_]+)$")
_TERMINAL = frozenset(".!?:;。")


def normal_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def form_of(text: str) -> tuple[str, str, str, str, str]:
    """(mark, form of the last line, closing class, last word, word before) of a text's end."""
    e = text.rstrip()
    m = _MARK.search(e)
    mark = ""
    if m and m.start() > 0:
        mark = "m" + ("b" if "[" in m[0] or "(" in m[0] or "<" in m[0] else "e")
        e = e[: m.start()].rstrip()
    at = e.rfind("\n")
    last = e[at + 1 :]
    fences = e.count("```")
    if last.startswith("```") and fences % 2 == 0 and fences:
        form = "fence"
    elif fences % 2:
        form = "infence"
    elif _CHAT.match(last):
        form = "chat"
    elif _LIST.match(last):
        form = "list"
    elif last.startswith(("#", "==")):
        form = "head"
    elif last.startswith("|") or last.endswith("|"):
        form = "table"
    elif _TRAILER.match(last):
        form = "trailer"
    elif len(last) < 30 and at > 0 and not _TERMINAL & set(last[-1:]) and len(last.split()) <= 2:
        form = "short"
    elif at < 0:
        form = "single"
    else:
        form = "text"
    c = last[-1:] or "∅"
    close = "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    w = _LAST_WORD.search(last)
    word = w[1].lower() if w else ""
    before = re.search(r"([^\W_]+)[^\w]*$", last[: w.start()] if w else last)
    return mark, form, close, word, before[1].lower() if before else ""


class End(NamedTuple):
    """What a text's end looks like."""

    mark: str
    form: str
    close: str
    word: str
    before: str
    odd: str
    words: int
    head: str
    first: str
    blank: int


def end_of(text: str) -> End:
    mark, form, close, word, before = form_of(text)
    e = text.rstrip()
    if mark:
        e = _MARK.sub("", e).rstrip()
    at = e.rfind("\n")
    last = e[at + 1 :]
    odd = f"{last.count('`') % 2}{last.count(chr(34)) % 2}{int(last.count('(') > last.count(')'))}"
    head = e[: at if at > 0 else 0].rstrip().rsplit("\n", 1)[-1]
    return End(
        mark, form, close, word, before, odd, len(last.split()), head if len(head) < 14 else "", last.split(" ", 1)[0] if form in ("trailer", "short") else "", int(at > 0 and e[:at].endswith("\n")),
    )


def features(end: End, source: str, at_limit: bool, seen: int, ends: int, longer: int) -> list[str]:
    """Feature names of a text's end; ``seen``, ``ends`` and ``longer`` are the last word's statistics."""
    mark, form, close, word, before, odd, words, head, first, blank = end
    rate = "-" if not word else "n" if seen < 3 else str(min(4, int(5 * ends / max(1, seen) + 0.999)))
    freq = "-" if not word else str(min(4, int(np.log2(seen + 1) / 2)))
    more = "-" if not word else str(min(5, int(np.log2((longer + 1) / (seen + 1) + 1))))
    lim = "L" if at_limit else "l"
    open_ = "o" if close in "a0A,`" else "c"
    n = str(min(6, words))
    return [
        f"fc:{form}:{close}:{mark}", f"fcl:{form}:{close}:{lim}", f"sfc:{source}:{form}:{close}", f"odd:{odd}:{close}", f"odf:{odd}:{form}", f"l:{lim}:{open_}",
        f"r:{form}:{rate}:{mark}", f"fr:{form}:{freq}:{mark}", f"rf:{rate}:{freq}:{close}", f"w:{word}:{mark}", f"wf:{form}:{word}", f"b:{before}:{word}", f"n:{form}:{n}:{close}",
        f"h:{head}:{form}", f"fw:{first}:{form}", f"k:{form}:{blank}:{close}", f"m:{mark}:{close}:{rate}", f"x:{form}:{more}:{freq}", f"xl:{more}:{lim}:{close}", f"xn:{form}:{n}:{more}:{rate}",
    ]


def _places(names: list[str]) -> list[int]:
    return [bucket(x, BITS) for x in names]


def looks_whole(end: End, at_limit: bool) -> bool:
    """Whether a sampled text may serve as a negative: nothing about its end speaks of a cut."""
    if end.mark or end.form == "infence":
        return False
    loose = end.close in "a0A`,;-"
    if loose and end.form in ("text", "single") and not (end.close == "`" and end.form == "single"):
        return False
    return not (at_limit and loose)


def trailing(text: str, seed: int) -> str | None:
    """The whole text with a mark of omission in place of its last full stop, as if its writer let it trail off; None where it has none or the seed says so."""
    e = text.rstrip()
    k = xxhash.xxh64_intdigest(e, seed) % 6
    return e[:-1] + ("..." if k else "…") if k < 2 and len(e) > 20 and e[-1] in ".!?" and e[-2].isalnum() else None


def cut(text: str, seed: int) -> str | None:
    """The text cut at a pseudo-random place, every third time with a mark; None where the cut can't be seen."""
    e = text.rstrip()
    if len(e) < 40:
        return None
    h = xxhash.xxh64_intdigest(e, seed)
    at = 20 + h % max(1, len(e) - 24)
    out = e[:at]
    if not out.strip() or out.rstrip()[-1] in ".!?|" or out.endswith("\n") or at >= len(e):
        return None
    if e[at : at + 1] in "\n" or e[at : at + 2] in (".", "!\n", ".\n"):
        return None
    k = (h >> 40) % 9
    return out + ("…" if k == 0 else "..." if k == 1 else " [...]" if k == 2 else "")


# -- statistics over all documents ---------------------------------------
_WORD_END = r"[\p{L}\p{N}]+[.!?…]?"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def beginnings(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whose) of every beginning of every word, the whole word last: one number per character, made in one pass."""
    lens = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lens) - lens
    whose = np.repeat(np.arange(len(words)), lens)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    at = np.arange(len(chars)) - starts[whose]
    power = np.full(int(lens.max(initial=1)), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    v = chars * power[at]
    c = np.cumsum(v, dtype=np.uint64)
    h = c - (c[starts] - v[starts])[whose] if len(words) and len(chars) else c
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29)), whose


def word_hash(word: str) -> int:
    """The hash of a word as it stands among ``beginnings``; 0 for none."""
    return int(beginnings([word])[0][-1].astype(np.int64)) if word else 0


_STAT = pa.schema([("h", pa.int64()), ("seen", pa.int64()), ("ends", pa.int64()), ("longer", pa.int64())])
STAT_SCHEMA = "h bigint, seen bigint, ends bigint, longer bigint"


def _stat_batches(batches):
    """Per distinct word its counts under its own hash, and under the hashes of its beginnings its count as that of a longer word."""
    for b in batches:
        words = b.column("word").to_pylist()
        if not words:
            continue
        seen, ends = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("seen", "ends"))
        h, whose = beginnings(words)
        last = np.append(whose[1:] != whose[:-1], True)
        own, more = h[last].astype(np.int64), h[~last].astype(np.int64)
        order = np.lexsort((-seen[whose[~last]], more))  # of each beginning the most frequent word of this batch goes on
        more, count = more[order], seen[whose[~last]][order]
        first = np.append(True, more[1:] != more[:-1]) if len(more) else np.empty(0, bool)
        zero = np.zeros(int(first.sum()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((own, more[first]), (seen, zero), (ends, zero), (np.zeros(len(own), np.int64), count[first]))], schema=_STAT
        )


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, seen, ends) of every word, ``ends`` where a sentence ends with it; texts are read once, counts are made before the shuffle."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD_END), F.lit(0))).alias("t"))
    ended = F.col("t").rlike("[.!?…]$")
    one = w.groupBy("t").agg(F.count("*").alias("n"))
    return one.select(F.regexp_replace("t", "[.!?…]$", "").alias("word"), "n", ended.alias("e")).groupBy("word").agg(
        F.sum("n").alias("seen"), F.sum(F.when(F.col("e"), F.col("n")).otherwise(0)).alias("ends")
    )


def word_statistics(counts: DataFrame) -> DataFrame:
    """(h, seen, ends, longer) by the hashes of words and their beginnings."""
    return counts.mapInArrow(_stat_batches, STAT_SCHEMA).groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"), F.max("longer").alias("longer"))


def limits(docs: DataFrame) -> DataFrame:
    """(s, at, at_limit): lengths at which at least five texts and five times the mean of the lengths around them end."""
    n = docs.select(F.coalesce(normal_source(F.col("source")), F.lit("")).alias("source"), F.length("text").cast("bigint").alias("at")).groupBy("source", "at").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("at").rangeBetween(-15, 15)
    around = n.withColumn("around", (F.sum("n").over(w) - F.col("n")) / 30)
    return around.where((F.col("n") >= 5) & (F.col("n") >= 5 * F.col("around")) & (F.col("at") > 60)).select(F.col("source").alias("s"), "at", F.lit(True).alias("at_limit"))


_FIELDS = [("key", pa.int64()), ("label", pa.int32()), ("nth", pa.int32()), ("source", pa.string()), ("at", pa.int64()), ("h", pa.int64())]
_KINDS = {"words": pa.int32(), "blank": pa.int32()}
_END = pa.schema([*_FIELDS, *((n, _KINDS.get(n, pa.string())) for n in End._fields)])
END_SCHEMA = "key bigint, label int, nth int, source string, at bigint, h bigint, " + ", ".join(f"{n} {'int' if n in _KINDS else 'string'}" for n in End._fields)


def _ends(batches, training):
    """Ends of texts: label -1 to be judged; in training 0 the text as it is, 2 as it is with a mark for its full stop, 1 cut."""
    for b in by_bytes(batches):
        rows = []
        for k, s, t in zip(*(b.column(n).to_pylist() for n in ("doc_id", "source", "text"))):
            if not t or not t.strip():
                continue
            made = [(-1, 0, t)]
            if training:
                made = [(0, 0, t), (2, 0, trailing(t, 5)), *((1, n, cut(t, n)) for n in range(CUTS))]
            for label, n, x in made:
                if x is not None:
                    e = end_of(x)
                    rows.append((k, label, n, s, len(t), word_hash(e.word), *e))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _END.types[n]) for n in range(len(_END.names))], schema=_END)


#: A word that closes more than one text in so many is joined apart; there are fewer than so many such words.
HOT = 1_000


def _with_statistics(ends: DataFrame, statistics: DataFrame, lim: DataFrame) -> DataFrame:
    """Ends with their closing words' statistics and whether they lie at a limit.

    Ends without a word need none; words that close very many texts, fewer than
    HOT of them, are joined by broadcast, so that no task gets all their texts.
    """
    worded = ends.where("h <> 0").groupBy("h").agg(F.count("*").alias("n"))
    worded = materialized(worded, "closing")
    least = (worded.agg(F.sum("n")).first()[0] or 0) / HOT
    known = materialized(statistics.join(worded, "h"), "statistics")  # of closing words only
    hot = F.broadcast(known.where(F.col("n") > least).drop("n"))
    some = ends.where("h <> 0")
    none = [F.lit(0).cast("bigint").alias(c) for c in ("seen", "ends", "longer")]
    joined = (
        some.join(hot, "h").unionByName(some.join(hot.select("h"), "h", "left_anti").join(known.where(F.col("n") <= least).drop("n"), "h", "left"))
        .unionByName(ends.where("h = 0").select("*", *none))
    )
    name = normal_source(F.col("source"))
    limited = joined.withColumn("s", F.coalesce(name, F.lit(""))).join(lim, ["s", "at"], "left")  # slim rows; Spark broadcasts the limits if they are as small as it checks
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "ends", "longer")]
    return limited.select("key", "label", "nth", F.col("s").alias("source"), F.col("at_limit").isNotNull().alias("at_limit"), *zero, *End._fields)


def fold_of(key: int) -> int:
    return xxhash.xxh32_intdigest(str(key), 7) % 2


class Model:
    """Two halves: each is fitted on one half of the documents and judges the other.

    The texts taken as whole hold a few cut ones; a model that has seen a
    document as whole must not be the one that judges it.
    """

    def __init__(self, found: list[tuple]):
        """found: key, label, nth, source, at_limit, seen, ends, longer, and the fields of End, of sampled texts and of what was made of them."""
        whole = {r[0] for r in found if r[1] == 0 and looks_whole(End(*r[8:]), r[4])}
        rows = []
        for key, label, nth, source, at_limit, seen, ends, longer, *end in found:
            if key in whole:
                # cuts at a limit are as frequent among positives as limits are among texts that end there
                at = at_limit or label == 1 and nth == 0 and key % 2 == 0
                rows.append((key, int(label == 1), End(*end), source, at, seen, ends, longer))
        y = np.array([r[1] for r in rows], float)
        self.fitted = len(rows) > 20 and 0 < y.sum() < len(y)
        self.report: dict[str, float] = {}
        if not self.fitted:
            return
        feats = [_places(features(*r[2:])) for r in rows]
        fold = np.array([fold_of(r[0]) for r in rows])
        pack = lambda idx: Sparse([(feats[i], [1.0] * len(feats[i])) for i in idx], 1 << BITS)
        self.parts = []
        right = 0
        for f in (0, 1):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(train) or not len(test) or y[train].min() == y[train].max():
                self.fitted = False
                return
            w, b = logistic(pack(train), y[train], balanced(y[train]), l2=3e-6, steps=250)
            z = pack(test).dot(w) + b
            slope, offset = platt(z, y[test])
            right += int(((slope * z + offset >= 0) == (y[test] > 0)).sum())
            self.parts.append((w, b, slope, offset))
        self.report = {"rows": float(len(rows)), "accuracy": right / len(rows)}

    def score(self, key: int, end: End, source: str, at_limit: bool, seen: int, ends: int, longer: int) -> float:
        """By the half of the model that was not fitted on this document."""
        if not self.fitted:
            return 0.0
        w, b, slope, offset = self.parts[fold_of(key)]
        z = float(w[_places(features(end, source, at_limit, seen, ends, longer))].sum()) + b
        return float(1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30))))


def _judge(batches, model):
    m: Model = model.value
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("key", "source", "at_limit", "seen", "ends", "longer", *End._fields)]
        p = [m.score(k, End(*end), s, lim, seen, ends, longer) for k, s, lim, seen, ends, longer, *end in zip(*cols)]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), pa.array(p, pa.float64())], names=["doc_id", "source", "score"])


def scored(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score) of every document that holds text."""
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null")
    lim = materialized(limits(docs), "limits")
    counts = materialized(word_counts(docs), "words")
    wide = spread(docs)
    few = smallest_hashes(docs, "doc_id", sample)
    ends = materialized(wide.mapInArrow(partial(_ends, training=False), END_SCHEMA).unionByName(spread(few).mapInArrow(partial(_ends, training=True), END_SCHEMA)), "ends")
    known = materialized(_with_statistics(ends, word_statistics(counts), lim), "known")
    rows = known.where("label >= 0").collect()  # at most SAMPLE texts, CUTS + 2 rows each
    model = spark.sparkContext.broadcast(Model(sorted({tuple(r) for r in rows})))
    release(counts, ends)
    return known.where("label < 0").mapInArrow(partial(_judge, model=model), "doc_id bigint, source string, score double")


def cut_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored(documents).where(F.col("score") >= threshold).select("doc_id").distinct()


def cut_rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, cut documents, rate."""
    one = scored(documents).groupBy("doc_id").agg(F.first("source").alias("source"), F.max((F.col("score") >= threshold).cast("int")).alias("cut"))
    return one.groupBy(F.when(F.col("source") != "", F.col("source")).alias("source")).agg(F.count("*").alias("n_documents"), F.sum("cut").alias("n_cut"), F.round(F.avg("cut"), 6).alias("cut_rate"))
