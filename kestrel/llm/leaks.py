"""Evaluation passages leaking into training text.

Passages and documents are cut into words (letter case, punctuation, markup
and line breaks aside).  What is searched for are items of two sizes:

- *whole passages*: windows of the documents as long as the passage, at its
  beginning and at its end (lengths are rounded down to steps of an eighth);
- *parts*: every run of 13 words of a passage, the size from which a shared run
  counts.

1. *Fingerprints.*  Each window has a 64-bit SimHash over its words, weighted
   by how rare they are among the passages; one pass of running sums serves
   windows of all sizes.
2. *Multi-index.*  The items' fingerprints are filed under four blocks of 16
   bits and, for whole passages, under all keys one bit away, so any two
   fingerprints within RADIUS (7; parts: 3) meet in a block.
3. *Verification.*  A whole passage and the stretch it meets are compared by
   the weighted Jaccard similarity of their runs of five words (weights: log
   inverse frequency among the passages), 0.8 and more count; parts count if
   they are equal word by word.

A run of 13 equal words has equal fingerprints, so ``leaked`` misses none.  Of
passages edited so that their similarity stays at 0.8 or more, radius 7 finds
more than 0.9 (measured against brute force in tests/llm).

The passages are a stated query set and go to the workers in slices of at most
SLICE windows; documents are read once per slice and never shuffled.  Long
documents are worked through in stretches of SEGMENT words.

Defined results: null or empty texts and passages and those under 13 words
have no windows; cases that share a passage all count; repeated rows count
once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import by_bytes, spread, text_batches

WINDOW = 13
BLOCKS, PART_RADIUS, RADIUS = 4, 3, 7
SHINGLE, SIMILARITY = 5, 0.8
#: Passage windows held by a worker at a time (8 bytes a word and 26 bytes a part, some 600 bytes a whole passage).
SLICE = 200_000
#: Words of documents whose running sums are held at a time (256 bytes a word).
SEGMENT = 100_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_CACHE: dict[str, int] = {}
_CACHE_MAX = 300_000


def words(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


def word_hashes(text: str | None) -> list[int]:
    out = []
    for w in words(text or ""):
        h = _CACHE.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(_CACHE) < _CACHE_MAX:
                _CACHE[w] = h
        out.append(h)
    return out


_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each run of SHINGLE words."""
    n = max(0, len(h) - SHINGLE + 1)
    x = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        x = (x + h[k : k + n]) * _MUL
        x ^= x >> np.uint64(29)
    return x


def length_class(n: int) -> int:
    """The largest window length up to n, in steps of an eighth."""
    size = WINDOW
    while size + max(1, size // 8) <= n:
        size += max(1, size // 8)
    return size


class Table:
    """Fingerprints of items of one length, filed by blocks: whatever lies within ``radius`` of a fingerprint is met."""

    def __init__(self, length: int, prints: np.ndarray, at: np.ndarray, owner: np.ndarray, offset: np.ndarray, radius: int):
        self.length, self.prints, self.at, self.owner, self.offset, self.radius = length, prints, at, owner, offset, radius
        near = radius // BLOCKS  # a pair within the radius differs in some block by no more
        flips = [0] + ([1 << k for k in range(16)] if near else [])
        assert near <= 1
        self.blocks = []
        for b in range(BLOCKS):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = (key[:, None] ^ np.array(flips)).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.searchsorted(keys[order], np.arange(65537)), order // len(flips)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item) of all fingerprints within the radius, each pair once."""
        left, right = [], []
        for b, (offsets, order) in enumerate(self.blocks):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            first = offsets[key]
            many = offsets[key + 1] - first
            met = np.flatnonzero(many)
            if not len(met):
                continue
            first, many = first[met], many[met]
            i = np.repeat(met, many)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many - first, many)]
            close = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.radius
            left.append(i[close])
            right.append(j[close])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(left) * len(self.prints) + np.concatenate(right))
        return both // len(self.prints), both % len(self.prints)


class PassageIndex:
    """A slice of passages: their words, word weights, and a table of fingerprints for each length of items."""

    def __init__(self, passages: list[tuple[list[int], list[int]]]):
        self.cases = [c for c, _ in passages]
        self.size = np.array([len(w) for _, w in passages], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.array([x for _, w in passages for x in w], dtype=np.uint64)
        df = Counter(x for _, w in passages for x in set(w))
        self.vocabulary = np.array(sorted(df), dtype=np.uint64)
        n = max(1, len(passages))
        self.rare = int(math.log2(n)) + 1
        self.rarity = np.array([1 + int(math.log2(n / df[x])) for x in self.vocabulary.tolist()], np.int32)
        self.shingles = [frozenset(shingle_hashes(np.array(w, dtype=np.uint64)).tolist()) for _, w in passages]
        held = Counter(x for s in self.shingles for x in s)
        self.weights = {x: math.log(1 + n / c) for x, c in held.items()}
        self.rarest = math.log(1 + n)
        groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, (_, w) in enumerate(passages):
            if len(w) < WINDOW:
                continue
            for o in range(len(w) - WINDOW + 1):
                groups.setdefault((WINDOW, PART_RADIUS), []).append((int(self.start[k]) + o, k, o))
            size = length_class(len(w))
            for o in sorted({0, len(w) - size}):
                groups.setdefault((size, RADIUS), []).append((int(self.start[k]) + o, k, o))
        sums = self.sums(self.words)
        self.tables = []
        for (size, radius), rows in groups.items():
            at, owner, offset = (np.array(x, np.int64) for x in zip(*rows))
            self.tables.append(Table(size, self.prints(sums, size)[at], at, owner, offset, radius))
        self.longest = max((t.length for t in self.tables), default=WINDOW)

    def sums(self, h: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted signs."""
        weight = np.full(len(h), self.rare, np.int32)
        if len(self.vocabulary):
            k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            weight = np.where(self.vocabulary[k] == h, self.rarity[k], weight)
        signs = (np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1) * weight[:, None]
        out = np.zeros((len(h) + 1, 64), np.int32)
        np.cumsum(signs, axis=0, out=out[1:])
        return out

    @staticmethod
    def prints(sums: np.ndarray, size: int) -> np.ndarray:
        """SimHash of each window of ``size`` words."""
        return np.packbits(sums[size:] > sums[:-size], axis=1).view(np.uint64).ravel() if len(sums) > size else np.empty(0, np.uint64)

    def similarity(self, shingles: set[int], k: int) -> float:
        """Weighted Jaccard similarity of a document window's shingles and those of passage k."""
        w = lambda s: sum(self.weights.get(v, self.rarest) for v in s)
        union = w(shingles | self.shingles[k])
        return w(shingles & self.shingles[k]) / union if union else 0.0


_OUT = pa.schema([("case_id", pa.int64()), ("doc_id", pa.int64()), ("similarity", pa.float64()), ("exact", pa.bool_())])
_SCHEMA = "case_id bigint, doc_id bigint, similarity double, exact boolean"


def _match(batches, index):
    ix: PassageIndex = index.value
    for b in by_bytes(batches, 1 << 20):
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        hs = [word_hashes(t) for t in texts]
        lens = np.array([len(h) for h in hs], np.int64)
        flat = np.array([x for h in hs for x in h], dtype=np.uint64)
        owner = np.repeat(np.arange(len(hs)), lens)
        ends = np.cumsum(lens)
        best: dict[tuple[int, int], list] = {}
        for s in range(0, len(flat), SEGMENT):
            sums = ix.sums(flat[s : s + SEGMENT + ix.longest - 1])
            for t in ix.tables:
                prints = ix.prints(sums, t.length)[:SEGMENT]
                inside = np.flatnonzero(owner[s : s + len(prints)] == owner[s + t.length - 1 : s + t.length - 1 + len(prints)])
                i, j = t.near(prints[inside])
                if len(i):
                    check = _parts if t.radius == PART_RADIUS else _wholes
                    check(ix, t, flat, owner, ends, lens, inside[i] + s, j, best)
        rows = [(c, ids[d], x, exact) for (d, p), (x, exact) in best.items() for c in ix.cases[p]]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _OUT.types[n]) for n in range(4)], schema=_OUT)


def _parts(ix, t, flat, owner, ends, lens, i, j, best) -> None:
    """Parts that are equal word by word; one that isn't shares no more than a shorter run, which does not count."""
    step = np.arange(WINDOW)
    for k in range(0, len(i), 50_000):
        a, q = i[k : k + 50_000], j[k : k + 50_000]
        same = (flat[a[:, None] + step] == ix.words[t.at[q][:, None] + step]).all(axis=1)
        for d, p in set(zip(owner[a[same]].tolist(), t.owner[q[same]].tolist())):
            best.setdefault((d, p), [0.0, False])[1] = True


def _wholes(ix, t, flat, owner, ends, lens, i, j, best) -> None:
    """Similarity of a passage and the stretch of the document that lies where its window does, as long as the passage."""
    for a, q in zip(i.tolist(), j.tolist()):
        d, p = int(owner[a]), int(t.owner[q])
        first = max(a - int(t.offset[q]), int(ends[d] - lens[d]))
        x = ix.similarity(set(shingle_hashes(flat[first : min(first + int(ix.size[p]), int(ends[d]))]).tolist()), p)
        if x >= SIMILARITY:
            row = best.setdefault((d, p), [0.0, False])
            row[0] = max(row[0], x)


def matches(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, doc_id, similarity, exact): similarity of the whole passage (0 where it stays under SIMILARITY), and whether a part occurs word by word."""
    spark = documents.sparkSession
    text_batches(spark)
    docs = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    grouped = cases.where("passage is not null and case_id is not null").groupBy("passage").agg(F.collect_set("case_id").alias("ids"))
    slices, current, windows = [], [], 0
    for r in grouped.toLocalIterator():
        h = word_hashes(r.passage)
        if len(h) < WINDOW:
            continue
        current.append((sorted(r.ids), h))
        windows += len(h) - WINDOW + 1
        if windows >= SLICE:
            slices.append(PassageIndex(current))
            current, windows = [], 0
    if current or not slices:
        slices.append(PassageIndex(current))
    parts = [docs.mapInArrow(partial(_match, index=spark.sparkContext.broadcast(ix)), _SCHEMA) for ix in slices]
    return reduce(DataFrame.union, parts)


def leaked(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, doc_id) with at least WINDOW words in a row in common."""
    return matches(documents, cases).where("exact").select("case_id", "doc_id").distinct()


def leak_report(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Per leaked case: documents that hold a part of its passage word by word, documents that hold the whole of it nearly, the best similarity."""
    one = matches(documents, cases).groupBy("case_id", "doc_id").agg(F.max(F.col("exact").cast("int")).alias("exact"), F.max("similarity").alias("similarity"))
    per = one.groupBy("case_id").agg(
        F.count("*").alias("n_documents"), F.sum("exact").alias("n_exact"), F.sum((F.col("similarity") > 0).cast("int")).alias("n_whole"),
        F.sum(((F.col("similarity") > 0) & (F.col("similarity") < 1)).cast("int")).alias("n_edited"), F.round(F.max("similarity"), 6).alias("best"),
    )
    split = cases.groupBy("case_id").agg(F.min("repo").alias("repo"), F.min("split").alias("split"))
    return per.join(split, "case_id").select("case_id", "repo", "split", "n_documents", "n_exact", "n_whole", "n_edited", "best")


def _words_sql(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '</?[a-z][^<>\\n]*>|<!--(?:.|\\n)*?-->', ' ', 'g')"
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("#39", "''"), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{mark}')"
    return f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+(?:_+[\\p{{L}}\\p{{N}}]+)*')"


#: Every run of 13 words of every passage looked up among those of every document.
FOUND_SQL = f"""
WITH p AS (SELECT case_id, {_words_sql("passage")} AS w FROM eval_cases WHERE passage IS NOT NULL AND case_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pr AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM p WHERE len(w) >= 13),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM d WHERE len(w) >= 13)
SELECT DISTINCT case_id, doc_id FROM pr JOIN dr USING (x)
"""
