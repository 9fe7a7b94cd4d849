"""Mixing sources to target shares of tokens.

1. *Membership.*  A classifier fitted on a sample of at most SAMPLE labelled
   documents gives every document likelihoods of the sources.  The document's
   own source, where the target table has it (without case and blanks), is
   further evidence: it is taken to be right with probability LABEL_TRUST.  The
   product, normalised, is the document's posterior; every document belongs to
   all sources, one without a usable source by its text alone.
2. *Rates.*  Projected gradient descent finds a rate in [0, limit] for every
   document, so that the expected tokens per source meet the targets in the
   least squares sense.  A step needs one sum per source, which the cluster
   adds up over all documents; a rate is the outcome of the steps so far, so
   tasks compute it from the document's own posterior and the list of steps
   (as many small vectors as there were steps), and nothing is kept in between.
   The steps are scaled by the sources' second moments, also added up in the
   cluster.
3. *Draw.*  A rate's whole part is given to the document.  For the rest, a
   source's documents are put in the order of a hash divided by that rest, and
   get one more until their tokens reach what is due to all of them together,
   so that a source misses its expected tokens by half a document at most.
   Running sums are taken in slices of that order, whose number grows with the
   documents, never in one task.

The largest total for which targets and limits agree is aimed at.  Where rates
can't meet the targets (a source without documents, say), ``shares`` says so in
``met``.

Defined results: null texts have no tokens and are not drawn, nor are
documents of a source without a target share; a null or unknown source is
judged by the text and may be used once; repeated rows (same doc_id) count
once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.linear import Sparse, balanced, logistic
from kestrel.functions.sampling import smallest_hashes
from kestrel.session import by_bytes, materialized, spread, text_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary wants text cut.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAMPLE = 6_000
BITS = 13
#: How far a document's own source is believed; the rest goes to the other sources by the text.
LABEL_TRUST = 0.9995
#: Steps of the descent, at most, and the miss (as a share of all tokens) at which it ends.
STEPS, TOLERANCE = 40, 1e-6
#: Documents of a source that one task puts in order, about; with fewer than SLICES times as many, SLICES tasks share them.
ORDERED_TOGETHER, SLICES = 500_000, 64


@cache
def encoder(path: str):
    """The tokenizer, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("kestrel", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def places(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of each document's distinct tokens and of its length's order, for all documents of a batch; sorted."""
    lens = np.array([len(t) for t in tokens], np.int64)
    ids = np.array([x for t in tokens for x in t], dtype=np.uint64)
    docs = np.arange(len(tokens), dtype=np.uint64)
    ids = np.concatenate([ids, np.uint64(1 << 31) + np.log2(lens + 1).astype(np.uint64)])
    owner = np.concatenate([np.repeat(docs, lens), docs])
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    both = np.unique((owner << np.uint64(BITS)) | mixed).astype(np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


class Classifier:
    """One logistic regression per source on the tokens of a text, fitted on the labelled table."""

    def __init__(self, rows: list[tuple[str, list[int]]], sources: list[str]):
        """rows: source, tokens."""
        self.sources = sources
        self.weights, self.bias = np.zeros((1 << BITS, len(sources))), np.zeros(len(sources))
        self.accuracy = None
        if not rows:
            return
        doc, place = places([t for _, t in rows])
        feats = [(p.tolist(), [1.0 / len(p) ** 0.5] * len(p)) for p in np.split(place, np.flatnonzero(np.diff(doc)) + 1)]
        y = np.array([sources.index(s) for s, _ in rows])
        test = np.arange(len(rows)) % 5 == 0
        x, z = Sparse([f for f, h in zip(feats, test) if not h], 1 << BITS), Sparse([f for f, h in zip(feats, test) if h], 1 << BITS)
        for k in range(len(sources)):
            t = (y[~test] == k).astype(float)
            self.weights[:, k], self.bias[k] = logistic(x, t, balanced(t), steps=120, rate=0.1)
        if test.any():
            scores = np.stack([z.dot(self.weights[:, k]) + self.bias[k] for k in range(len(sources))])
            self.accuracy = float((scores.argmax(axis=0) == y[test]).mean())

    def posteriors(self, tokens: list[list[int]], own: list[str | None]) -> np.ndarray:
        """Probability of each source for each document, from its tokens and, where it is one of the sources, its own."""
        k = len(self.sources)
        doc, place = places(tokens)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        many = np.diff(np.append(starts, len(doc)))
        z = np.add.reduceat(self.weights[place], starts, axis=0) / np.sqrt(many)[:, None] + self.bias if len(tokens) else np.zeros((0, k))
        p = np.maximum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6)
        at = {s: n for n, s in enumerate(self.sources)}
        label = np.array([at.get(s, -1) for s in own], np.int64)
        known = np.flatnonzero(label >= 0)
        if k > 1:
            p[known] *= (1 - LABEL_TRUST) / (k - 1)
            p[known, label[known]] *= LABEL_TRUST * (k - 1) / (1 - LABEL_TRUST)
        return p / p.sum(axis=1, keepdims=True)


_OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("member", pa.list_(pa.float64()))])
_SCHEMA = "doc_id bigint, source string, tokens bigint, member array<double>"


def _measure(batches, model, tokenizer):
    m: Classifier = model.value
    enc = encoder(tokenizer)
    for b in by_bytes(batches):
        tokens = enc.encode_ordinary_batch(b.column("text").to_pylist(), num_threads=1)
        p = m.posteriors(tokens, b.column("source").to_pylist())
        member = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([len(t) for t in tokens], pa.int64()), member], schema=_OUT)


def fit(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> Classifier:
    few = smallest_hashes(documents.where(F.col("source").isin(*sources)).select("source", "text", "doc_id"), "doc_id", sample)
    once = {r.doc_id: (r.source, r.text) for r in few.toLocalIterator()}
    rows = [once[i] for i in sorted(once)]
    return Classifier(list(zip([s for s, _ in rows], encoder(tokenizer).encode_ordinary_batch([t for _, t in rows]))), sources)


Goal = list[tuple[str, float, int]]


def measured(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> tuple[DataFrame, Goal]:
    """Documents with tokens and posteriors, and the target table's rows (source, share, limit)."""
    spark = documents.sparkSession
    text_batches(spark)
    goal = sorted((r.source.strip().lower(), r.target_share, r.max_repeats) for r in targets.dropDuplicates(["source"]).collect() if r.source and r.target_share and r.target_share > 0)
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    if not goal:
        return docs.select("doc_id", "source", F.lit(0).cast("bigint").alias("tokens"), F.array().cast("array<double>").alias("member")).where("false"), goal
    model = spark.sparkContext.broadcast(fit(docs, [g[0] for g in goal], tokenizer, sample))
    one = spread(docs).mapInArrow(partial(_measure, model=model, tokenizer=tokenizer), _SCHEMA).dropDuplicates(["doc_id"])
    return materialized(one, "tokens"), goal


# -- rates --------------------------------------------------------------
class Descent:
    """The steps of a projected gradient descent; a document's rate follows from them and its own posterior."""

    def __init__(self, goal: Goal):
        self.limits = {s: float(n) for s, _, n in goal}
        self.start = 0.0
        self.steps: list[np.ndarray] = []

    def rates(self, member: np.ndarray, sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(rate, limit) of documents: every step goes against the gradient, then back into [0, limit]."""
        limit = np.array([self.limits.get(s, 1.0) for s in sources])
        r = np.minimum(self.start, 1.0) * limit
        for step in self.steps:
            r = np.clip(r - member @ step, 0.0, limit)
        return r, limit


def _columns(b):
    k = len(b.column("member"))
    member = b.column("member").flatten().to_numpy(zero_copy_only=False).reshape(k, -1) if k else np.zeros((0, 1))
    return member, b.column("tokens").to_numpy(zero_copy_only=False).astype(float), b.column("source").to_pylist()


def _sums(batches, descent, width):
    """Partial sums of one step: expected tokens drawn and at the limit per source, and the sources' second moments over documents that can still move."""
    drawn, most, moments = np.zeros(width), np.zeros(width), np.zeros((width, width))
    for b in batches:
        member, tokens, sources = _columns(b)
        r, limit = descent.rates(member, sources)
        weight = member * tokens[:, None]
        drawn += r @ weight
        most += limit @ weight
        moments += weight.T @ member
    yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([drawn, most, moments.ravel()])]}, pa.schema([("sums", pa.list_(pa.float64()))]))


def _added(docs: DataFrame, descent: Descent, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(drawn, most, moments) over all documents: one small vector per partition, added up in the cluster by place."""
    part = docs.mapInArrow(partial(_sums, descent=descent, width=width), "sums array<double>")
    rows = part.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # width * (width + 2) rows
    s = np.zeros(width * (width + 2))
    for r in rows:
        s[r.k] = r.x
    return s[:width], s[width : 2 * width], s[2 * width :].reshape(width, width)


def descend(docs: DataFrame, goal: Goal) -> tuple[Descent, bool]:
    """The descent for the largest total that targets and limits allow, and whether it met the targets."""
    width = len(goal)
    share = np.array([g[1] for g in goal])
    share = share / share.sum()
    d = Descent(goal)
    _, most, moments = _added(docs, d, width)
    if not most.sum():
        return d, False
    reach = most / share
    there = reach > 0.01 * np.median(reach)  # the others have hardly a document: what is left of them is not met
    total = float(reach[there].min())
    want = np.where(there, share, 0.0)
    scale = np.linalg.pinv(moments + 1e-9 * np.trace(moments) * np.eye(width))
    d.start = total / most.sum()
    last = np.inf
    for _ in range(STEPS):
        drawn, _, _ = _added(docs, d, width)
        worst = np.abs(drawn - want * total)[there].max() / total
        if worst <= TOLERANCE:
            return d, bool(there.all())
        if worst > 0.7 * last:  # limits stand in the way: the total comes down to what was reached
            total *= min(1.0, float((drawn[there] / (want[there] * total)).min()))
        last = worst
        d.steps.append(scale @ np.where(there, drawn - want * total, 0.0))
    return d, False


_RATED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("grp", pa.int32()), ("whole", pa.int32()), ("part", pa.float64())])
_RATED_SCHEMA = "doc_id bigint, source string, tokens bigint, grp int, whole int, part double"


def _rate(batches, descent):
    names = {s: k for k, s in enumerate(descent.limits)}
    for b in batches:
        member, _, sources = _columns(b)
        r, _ = descent.rates(member, sources)
        whole = np.floor(r + 1e-9)
        part = np.where(r - whole > 1e-9, r - whole, 0.0)
        # documents that stand for the same source: by their own, else by the likeliest
        grp = np.array([names.get(s, len(names) + k) for s, k in zip(sources, member.argmax(axis=1).tolist())], np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("tokens"), pa.array(grp), pa.array(whole.astype(np.int32)), pa.array(part)], schema=_RATED)


def draw(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document that is used."""
    return _drawn(documents, targets, tokenizer, sample)[0]


def _drawn(documents: DataFrame, targets: DataFrame, tokenizer: str, sample: int) -> tuple[DataFrame, bool]:
    docs, goal = measured(documents, targets, tokenizer, sample)
    if not goal:
        return docs.select("doc_id", "source", "tokens", F.lit(0).alias("repeats")), False
    descent, met = descend(docs, goal)
    rated = materialized(docs.mapInArrow(partial(_rate, descent=descent), _RATED_SCHEMA), "rates")
    slices = max(SLICES, rated.count() // ORDERED_TOGETHER)
    place = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) / F.col("part")  # a likely document comes early
    d = rated.where("part > 0").withColumn("place", place).withColumn("cell", F.floor(F.col("place") / (1 + F.col("place")) * slices))
    per = d.groupBy("grp", "cell").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("x"))
    every = Window.partitionBy("grp")  # a row per slice
    before = per.select("grp", "cell", (F.sum("t").over(every.orderBy("cell")) - F.col("t")).alias("before"), F.sum("x").over(every).alias("due"))
    e = d.withColumn("upto", F.sum("tokens").over(Window.partitionBy("grp", "cell").orderBy("place", "doc_id"))).join(before, ["grp", "cell"])
    more = (F.col("before") + F.col("upto") - F.col("tokens") / 2 <= F.col("due")).cast("int")
    used = e.select("doc_id", "source", "tokens", (F.col("whole") + more).alias("repeats")).unionByName(rated.where("part = 0").select("doc_id", "source", "tokens", F.col("whole").alias("repeats")))
    return used.where("repeats > 0"), met


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE) -> DataFrame:
    """Per source: its target, what the draw reached, and whether the rates could meet all targets."""
    used, met = _drawn(documents, targets, tokenizer, sample)
    per = used.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_drawn"), F.max("repeats").alias("most_used"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    all_ = F.sum("tokens_drawn").over(Window.partitionBy(F.lit(0)))  # over one row per source
    return (
        t.join(per, "source", "full").withColumn("all", all_)
        .select("source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"),
                F.coalesce("most_used", F.lit(0)).alias("most_used"), F.round(F.coalesce("tokens_drawn", F.lit(0)) / F.col("all"), 6).alias("actual_share"), F.lit(met).alias("met"))
    )
