"""Hybrid retrieval as plans over a corpus and a table of queries.

``corpus``: row_id, path, kind, name, start_line, end_line, text.
``queries``: qid, query.  All operators work for many queries at once, windows
are partitioned by qid, and every order ends in a unique column.  Scores are
ordered and returned rounded to six places, so engines that add in another
order agree.

``scope`` names columns that the corpus and the queries share (``repo``, say):
every query then sees the rows of its own scope only, with the frequencies,
lengths, keys and symbols of that scope, as if each were an index of its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.tokens import GENERIC_NAME_TOKENS, identifiers, tokenize, tokens
from kestrel.session import by_bytes, each_once, materialized, text_batches

#: Fixed values of the ranking functions.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CANDIDATES, POOL, RESULTS = 50, 30, 8
EXPAND_FROM, EXPAND_CAP = 6, 8
NAME_BOOST = 0.25
LAMBDA = 0.7
DIM = 64


#: Columns that keep scopes apart; none: one corpus for all queries.
Scope = tuple[str, ...]


def _joined(a: DataFrame, b: DataFrame, scope: Scope, *on: str) -> DataFrame:
    """A join on the scope and further columns; of all pairs where there are none."""
    keys = [*scope, *on]
    return a.join(b, keys) if keys else a.join(b)


def _few(df: DataFrame, scope: Scope) -> DataFrame:
    """A table with some rows per scope: to be broadcast where there is one scope, left to Spark's own check where there may be many."""
    return df if scope else F.broadcast(df)


# -- corpus -------------------------------------------------------------
def corpus_of(chunks: DataFrame) -> DataFrame:
    """Index rows of a chunk table, each once; the repository is the first part of the path."""
    return each_once(chunks, "chunk_id").select(
        F.col("chunk_id").alias("row_id"), F.concat("repo", F.lit("/"), "path").alias("path"), "kind", "name", "start_line", "end_line", "text"
    )


def key_of(path: Column, start_line: Column) -> Column:
    return F.concat(path, F.lit(":"), start_line.cast("string"))


def _count_tokens(batches):
    for b in by_bytes(batches):
        made = [Counter(tokenize(t or "")) for t in b.column("text").to_pylist()]
        keep = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in keep), pa.array([c.total() for c in made], pa.int64()), pa.array([list(c) for c in made], pa.list_(pa.string())),
             pa.array([list(c.values()) for c in made], pa.list_(pa.int64()))], names=[*keep, "dl", "toks", "tfs"],
        )


def counted(corpus: DataFrame, scope: Scope = (), owner: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, dl, toks, tfs): every text's tokens with their counts, one row per text.

    A text is counted where it lies, so nothing is shuffled, and whatever is
    made of a text later (a score, a vector) is made from one row.
    """
    text_batches(corpus.sparkSession)
    rows = corpus.select(*scope, owner, F.col(text).alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_count_tokens, f"{kinds}, dl bigint, toks array<string>, tfs array<bigint>")


def postings_of(held: DataFrame, scope: Scope = (), owner: str = "row_id") -> DataFrame:
    """(row_id, dl, tok, tf) from counted texts."""
    return held.select(*scope, owner, "dl", F.explode(F.arrays_zip("toks", "tfs")).alias("p")).select(*scope, owner, "dl", F.col("p.toks").alias("tok"), F.col("p.tfs").alias("tf"))


def postings(corpus: DataFrame, scope: Scope = ()) -> DataFrame:
    """(row_id, dl, tok, tf), dl being the row's number of tokens."""
    return postings_of(counted(corpus, scope), scope)


def doc_freq(post: DataFrame, scope: Scope = ()) -> DataFrame:
    return post.groupBy(*scope, "tok").agg(F.count("*").alias("df"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    return corpus.select("row_id", F.size(tokens(F.col("text"))).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame, scope: Scope = ()) -> DataFrame:
    """One row (a scope): rows (token-less ones too) and mean length."""
    return lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_tokens(queries: DataFrame, scope: Scope = ()) -> DataFrame:
    """(qid, tok, qtf): repeated tokens count repeatedly."""
    return postings_of(counted(queries, scope, "qid", "query"), scope, "qid").drop("dl").withColumnRenamed("tf", "qtf")


# -- recall -------------------------------------------------------------
def inverse_frequencies(df: DataFrame, stats: DataFrame, scope: Scope = ()) -> DataFrame:
    """(tok, idf); negative ones become EPSILON times the mean over all terms."""
    raw = _joined(df, _few(stats.select(*scope, "n"), scope), scope).select(*scope, "tok", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.groupBy(*scope).agg(F.avg("idf").alias("mean"))
    return _joined(raw, _few(mean, scope), scope).select(*scope, "tok", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def top(scores: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows per query with their 0-based rank (a limit inside the window, not a sort of everything)."""
    w = Window.partitionBy("qid").orderBy(*order)
    # compared with the row number itself, else Spark shuffles and sorts all rows before it cuts them
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def search_tables() -> dict:
    """What is published with an index so that searches build nothing: postings sorted by token, with lengths; inverse frequencies; mean length."""

    def post(rows):
        return postings(rows).repartitionByRange("tok", "row_id").sortWithinPartitions("tok", "row_id")

    def terms(rows):
        return inverse_frequencies(doc_freq(postings(rows)), corpus_stats(doc_lengths(rows)))

    return {"postings": post, "terms": terms, "stats": lambda rows: corpus_stats(doc_lengths(rows))}


def filled(scores: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The first k of one query's scores, filled up with rows that score nothing, in row order."""
    hits = top(scores.select("qid", "row_id", "score"), k, [F.desc("score"), F.col("row_id")]).drop("rank")
    first = rows.select("row_id").orderBy("row_id").limit(2 * k)
    zero = first.join(hits.select("row_id"), "row_id", "left_anti").select(F.lit(0).alias("qid"), "row_id", F.lit(0.0).alias("score"))
    return top(hits.unionByName(zero), k, [F.desc("score"), F.col("row_id")])


class _Best:
    """The k first rows per query by score, then row, of what a task has seen; what can't be among them any more isn't kept."""

    def __init__(self, queries: int, k: int):
        self.k, self.most = k, 4 * k * max(1, queries)
        self.least = np.full(queries, -np.inf)  # of k rows already held
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        on = score >= self.least[query]
        self.parts.append((query[on], score[on], row[on]))
        self.size += int(on.sum())
        if self.size > self.most:
            self.cut()

    def cut(self) -> None:
        query, score, row = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.least[query[last]] = score[last]
        self.parts = [(query[nth < self.k], score[nth < self.k], row[nth < self.k])]
        self.size = len(self.parts[0][0])

    def out(self, qids: np.ndarray, none: float | None = None):
        """One batch of what was kept; scores of ``none`` and less become null."""
        if self.size:
            self.cut()
            query, score, row = self.parts[0]
            score = score if none is None else np.where(score > none, score, np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(row), pa.array(score, from_pandas=True)], names=["qid", "row_id", "score"])


def _lexical(batches, block, k):
    """The k best rows of a task for each query of a block, from counted texts."""
    qids, index, first, many, query, weight, means = block.value
    best = _Best(len(qids), k)
    for big in batches:
        for at in range(0, big.num_rows, 1_024):
            b = big.slice(at, 1_024)
            toks = b.column("toks")
            scopes = b.column("scope").to_pylist()
            doc = np.repeat(np.arange(b.num_rows), np.diff(toks.offsets.to_numpy()))
            flat = toks.flatten().to_pylist()
            get = index.get
            term = np.array([get((scopes[d], t), -1) for d, t in zip(doc.tolist(), flat)] if scopes[0] is not None else [get(t, -1) for t in flat], dtype=np.int64)
            on = np.flatnonzero(term >= 0)
            if not len(on):
                continue
            term, doc, tf = term[on], doc[on], b.column("tfs").flatten().to_numpy(zero_copy_only=False)[on].astype(float)
            dl = b.column("dl").to_numpy(zero_copy_only=False)[doc]
            mean = np.array([means.get(x, 1.0) for x in scopes])[doc]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            n = many[term]
            entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[term], n)
            place = query[entry] * b.num_rows + np.repeat(doc, n)
            where, inverse = np.unique(place, return_inverse=True)
            score = np.round(np.bincount(inverse, weights=weight[entry] * np.repeat(part, n)), 6)
            best.add(where // b.num_rows, score, b.column("row_id").to_numpy(zero_copy_only=False)[where % b.num_rows])
    yield from best.out(qids)


def bm25_top(queries: DataFrame, held: DataFrame, k: int = CANDIDATES, scope: Scope = ()) -> DataFrame:
    """(qid, row_id, score, rank): min(k, rows) entries, filled up with rows that score nothing, in row order.

    ``held``: the counted corpus.  Queries go out in blocks of about
    QUERY_BLOCK with the weights of their tokens; every task keeps its k best
    rows per query, so k rows a query and task are shuffled, not all scores.
    """
    spark = held.sparkSession
    key = F.concat_ws("\0", *scope) if scope else F.lit(None).cast("string")
    stats = materialized(corpus_stats(held, scope), "stats")  # a row per scope
    idf = inverse_frequencies(doc_freq(postings_of(held, scope), scope), stats, scope)
    terms = idf.join(query_tokens(queries, scope), [*scope, "tok"])  # slim rows; the queries may be many
    terms = materialized(terms.select(key.alias("scope"), "qid", "tok", (F.col("qtf") * F.col("idf")).alias("w")), "terms")  # of the queries' tokens only
    means = {r.scope: r.avgdl for r in stats.select(key.alias("scope"), "avgdl").collect()}
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = held.select("row_id", "dl", "toks", "tfs", key.alias("scope"))
    kinds = dict(queries.dtypes) | dict(held.dtypes)
    parts = []
    for n in range(blocks):
        t = terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).toArrow()
        if not t.num_rows and (n or blocks > 1):
            continue
        qids, query = np.unique(t.column("qid").to_numpy(), return_inverse=True)
        names = list(zip(t.column("scope").to_pylist(), t.column("tok").to_pylist())) if scope else t.column("tok").to_pylist()
        index = {x: i for i, x in enumerate(dict.fromkeys(names))}
        term = np.array([index[x] for x in names], dtype=np.int64)
        order = np.argsort(term, kind="stable")
        many = np.bincount(term, minlength=len(index)) if len(index) else np.zeros(0, np.int64)
        block = spark.sparkContext.broadcast((qids, index, np.cumsum(many) - many, many, query[order], t.column("w").to_numpy()[order], means))
        parts.append(rows.mapInArrow(partial(_lexical, block=block, k=k), f"qid {kinds['qid']}, row_id {kinds['row_id']}, score double"))
    hits = top(reduce(DataFrame.unionByName, parts), k, [F.desc("score"), F.col("row_id")]).drop("rank")
    hits = materialized(hits, "hits")  # k rows a query, read twice
    first = held.select("row_id").orderBy("row_id").limit(2 * k)
    if scope:
        w = Window.partitionBy(*scope).orderBy("row_id")
        first = held.select(*scope, "row_id", F.row_number().over(w).alias("n")).where(F.col("n") <= 2 * k).drop("n")
    fill = _joined(queries.select(*scope, "qid"), _few(first, scope), scope).join(hits.select("qid", "row_id"), ["qid", "row_id"], "left_anti").select("qid", "row_id", F.lit(0.0).alias("score"))
    return top(hits.select("qid", "row_id", "score").unionByName(fill), k, [F.desc("score"), F.col("row_id")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.try_divide(dot, size(a) * size(b))  # null where a side is all zeros


def dense_top(vectors: DataFrame, query: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Exact scan for one query: (qid, row_id, score, rank) of the nearest vectors; ``query`` (qid, qvec) has one row."""
    s = vectors.join(F.broadcast(query)).select("qid", "row_id", F.round(cosine(F.col("vec"), F.col("qvec")), 6).alias("score"))
    return top(s, k, [F.desc("score"), F.col("row_id")])


#: Queries that go to the tasks at a time: their vectors are all that is broadcast.
QUERY_BLOCK = 2_048


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths) of an Arrow column of vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x, np.sqrt((x * x).sum(axis=1))


def _nearest(batches, block, k, sharing):
    """The k best rows of a task for each query of a block, by one matrix product per batch."""
    qids, q, q_size, q_scope = block.value
    best = _Best(len(qids), k)
    for b in batches:
        if not b.num_rows or not len(qids):
            continue
        x, size = _unit(b.column("vec"))
        ids = b.column("row_id").to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.round((q @ x.T) / (q_size[:, None] * size[None, :]), 6)
        s[~np.isfinite(s)] = -2.0  # a side of zeros: behind all others
        out = (q_scope[:, None] != np.array(b.column("scope").to_pylist(), dtype=object)[None, :]) if q_scope is not None else None
        if sharing:
            none = ((q != 0).astype(np.float32) @ (x != 0).astype(np.float32).T) == 0
            out = none if out is None else out | none
        if out is not None:
            s[out] = -3.0
        where, what = np.nonzero((s > -3.0) & (s >= best.least[:, None]))
        best.add(where, s[where, what], ids[what])
    yield from best.out(qids, -2.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, scope: Scope = (), sharing: bool = False) -> DataFrame:
    """Exact scan for many queries: (qid, row_id, score, rank) of the nearest vectors (row_id, vec) for each query (qid, qvec).

    Queries go out in blocks of about QUERY_BLOCK, every task keeps its k best
    rows per query, so k rows a query and task are shuffled, not all scores.
    With ``sharing`` only rows count that have a place in common with the
    query's vector that is not zero.
    """
    spark = vectors.sparkSession
    key = F.concat_ws("\0", *scope) if scope else F.lit(None).cast("string")
    rows = vectors.select("row_id", "vec", key.alias("scope"))
    asked = queries.select("qid", "qvec", key.alias("scope"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    parts = []
    for n in range(blocks):
        t = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).toArrow()
        if not t.num_rows and n:
            continue
        q, size = _unit(t.column("qvec").combine_chunks())
        names = np.array(t.column("scope").to_pylist(), dtype=object) if scope else None
        block = spark.sparkContext.broadcast((t.column("qid").to_numpy(), q, size, names))
        parts.append(rows.mapInArrow(partial(_nearest, block=block, k=k, sharing=sharing), f"qid {kinds['qid']}, row_id {kinds['row_id']}, score double"))
    return top(reduce(DataFrame.unionByName, parts), k, [F.desc_nulls_last("score"), F.col("row_id")])


_PLACES: dict[str, tuple[int, float]] = {}
_PLACES_MAX = 300_000


def _place_of(token: str) -> tuple[int, float]:
    """A token's bucket and sign, from its md5."""
    h = hashlib.md5(token.encode()).hexdigest()
    p = int(h[0], 16) * 4 + int(h[1], 16) // 4, 1.0 if int(h[2], 16) < 8 else -1.0
    if len(_PLACES) < _PLACES_MAX:
        _PLACES[token] = p
    return p


def _hash_vectors(batches, out):
    for b in batches:
        toks = b.column("toks")
        doc = np.repeat(np.arange(b.num_rows), np.diff(toks.offsets.to_numpy()))
        get = _PLACES.get
        places = [get(t) or _place_of(t) for t in toks.flatten().to_pylist()]
        x = np.zeros(b.num_rows * DIM)
        if places:
            at, sign = (np.array(c) for c in zip(*places))
            x = np.bincount(doc * DIM + at, weights=sign * b.column("tfs").flatten().to_numpy(zero_copy_only=False), minlength=b.num_rows * DIM)
        keep = [n for n in b.schema.names if n not in ("dl", "toks", "tfs")]
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, DIM), pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), vec], names=[*keep, out])


def hashed_vectors(held: DataFrame, out: str) -> DataFrame:
    """Counted texts' tokens hashed into DIM buckets with signs; rows of zeros are left out."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in held.dtypes if n not in ("dl", "toks", "tfs"))
    return held.mapInArrow(partial(_hash_vectors, out=out), f"{kinds}, {out} array<double>").where(F.exists(out, lambda x: x != 0))


def embedded_top(queries: DataFrame, held: DataFrame, k: int = CANDIDATES, scope: Scope = ()) -> DataFrame:
    """(qid, row_id, score, rank) by the hashed embedding of both sides; ``held``: the counted corpus."""
    return nearest(hashed_vectors(held, "vec"), hashed_vectors(counted(queries, scope, "qid", "query"), "qvec"), k, scope, sharing=True)


# -- fusion -------------------------------------------------------------
def fuse(ranked: DataFrame, k: int = RRF_K, scope: Scope = ()) -> DataFrame:
    """(qid, key, rrf, pos) from (qid, list_no, rank, key): reciprocal ranks added, ties by first appearance."""
    s = ranked.groupBy(*scope, "qid", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.col("first"))
    return s.select(*scope, "qid", "key", "rrf", (F.row_number().over(w) - 1).alias("pos"))


def keyed(corpus: DataFrame, scope: Scope = ()) -> DataFrame:
    """(key, row_id): where two rows share a key the last one counts."""
    return corpus.select(*scope, key_of(F.col("path"), F.col("start_line")).alias("key"), "row_id").groupBy(*scope, "key").agg(F.max("row_id").alias("row_id"))


def pool_of(fused: DataFrame, corpus: DataFrame, size: int = POOL, scope: Scope = ()) -> DataFrame:
    """(qid, pos, key, row_id): the first ``size`` fused keys that exist."""
    found = fused.join(keyed(corpus, scope), [*scope, "key"])
    w = Window.partitionBy("qid").orderBy("pos")
    return found.select(*scope, "qid", "key", "row_id", (F.row_number().over(w) - 1).alias("pos")).where(F.col("pos") < size)


def symbol_defs(corpus: DataFrame, scope: Scope = ()) -> DataFrame:
    """(symbol, row_id): names of four characters and more that are not generic."""
    s = F.lower("name")
    return corpus.where(F.col("name").isNotNull() & (F.length("name") >= 4) & ~s.isin(*GENERIC_NAME_TOKENS)).select(*scope, s.alias("symbol"), "row_id")


def expand(pool: DataFrame, corpus: DataFrame, expand_from: int = EXPAND_FROM, cap: int = EXPAND_CAP, scope: Scope = ()) -> DataFrame:
    """The pool with up to ``cap`` rows per query behind it that define what its first rows mention, in other files."""
    pool = materialized(pool, "pool")  # a few rows a query, used four times below
    rows = corpus.select("row_id", "path", "name", "text", key_of(F.col("path"), F.col("start_line")).alias("key"))
    heads = pool.where(F.col("pos") < expand_from).select(*scope, "qid", "pos", "row_id").join(rows.drop("key"), "row_id")
    ids = heads.select(*scope, "qid", "pos", F.col("path").alias("from_path"), F.lower("name").alias("own"), F.explode(identifiers(F.col("text"))).alias("ident"))
    low = F.lower("ident")
    ids = ids.where((F.length("ident") >= 4) & ~low.isin(*GENERIC_NAME_TOKENS) & ~low.eqNullSafe(F.col("own"))).withColumn("symbol", low)
    hits = ids.join(symbol_defs(corpus, scope), [*scope, "symbol"]).join(rows.select("row_id", "path", "key"), "row_id").where("path <> from_path")
    hits = hits.join(pool.select("qid", "key"), ["qid", "key"], "left_anti")
    w = Window.partitionBy("qid", "key").orderBy("pos", "ident", "row_id")
    once = hits.withColumn("n", F.row_number().over(w)).where("n = 1")
    v = Window.partitionBy("qid").orderBy("pos", "ident", "row_id")
    extra = once.withColumn("k", F.row_number().over(v)).where(F.col("k") <= cap)
    size = pool.groupBy("qid").agg(F.count("*").alias("size"))
    return pool.unionByName(extra.select(*scope, "qid", "key", "row_id", "k").join(size, "qid").select(*scope, "qid", "key", "row_id", (F.col("size") + F.col("k") - 1).cast("int").alias("pos")))


# -- scoring ------------------------------------------------------------
def code_prior(path: Column, kind: Column) -> Column:
    """Weight by the kind of file: first match sets the base, places multiply it."""
    p = F.lower(path)
    base = F.element_at(F.split(p, "/"), -1)
    w = (
        F.when(p.rlike(r"\.(md|rst|txt)$"), 0.3).when(kind == "window", 0.4).when(p.rlike(r"\.(html|htm)$"), 0.6).otherwise(1.0)
    )
    w = w * F.when(p.contains("/migrations/"), 0.5).otherwise(1.0)
    w = w * F.when(p.contains("/tests/") | base.startswith("test_"), 0.7).otherwise(1.0)
    return w * F.when(p.contains("/management/commands/") | base.contains("seed"), 0.8).otherwise(1.0)


def name_matches(qtoks: Column, name: Column) -> Column:
    """How many distinct, long, specific query tokens agree with a token of the name."""
    names = F.array_distinct(tokens(name))

    def hit(q):
        return F.exists(names, lambda n: (q == n) | ((F.length(n) >= 4) & (F.startswith(q, n) | F.startswith(n, q))))

    return F.size(F.filter(F.array_distinct(qtoks), lambda q: (F.length(q) >= 5) & ~q.isin(*GENERIC_NAME_TOKENS) & hit(q)))


def boosted(relevance: Column, matches: Column) -> Column:
    return relevance * (1 + NAME_BOOST * matches)


def coverage(qtoks: Column, text: Column) -> Column:
    """The default reranker: share of the query's distinct tokens that a text holds."""
    q = F.array_distinct(qtoks)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def reranked(pool: DataFrame, queries: DataFrame, reranker) -> DataFrame:
    """(qid, row_id, score) of a pool (qid, row_id, pos, text) by a reranker, one call a query over its pool in order; rows it leaves out score 0."""

    def run(pdf):
        pdf = pdf.sort_values("pos")
        score = [0.0] * len(pdf)
        for i, x in reranker.rerank(pdf["query"].iloc[0], pdf["text"].tolist()):
            score[i] = float(x)
        return pdf[["qid", "row_id"]].assign(score=score)

    asked = pool.select("qid", "row_id", "pos", F.coalesce("text", F.lit("")).alias("text")).join(queries.select("qid", F.coalesce("query", F.lit("")).alias("query")), "qid")
    kinds = dict(asked.dtypes)
    return asked.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, row_id {kinds['row_id']}, score double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def diversify(pool: DataFrame, k: int = RESULTS, lam: float = LAMBDA) -> DataFrame:
    """Greedy selection with a penalty for files already chosen, in closed form: (…, mmr, rank).

    Within a file the best row always comes first and the penalty is the same
    for all later ones, so one window and one sort do what the loop would.
    """
    if not 0 <= lam <= 1:
        raise ValueError("lam must lie in [0, 1]")
    value = F.lit(lam) * F.col("relevance")
    w = Window.partitionBy("qid", "path").orderBy(value.desc(), F.col("pos"))
    s = pool.withColumn("mmr", F.round(value - (1 - lam) * F.when(F.row_number().over(w) > 1, 1.0).otherwise(0.0), 6))
    return top(s, k, [F.desc("mmr"), F.col("pos")])


def search(
    queries: DataFrame, corpus: DataFrame, held: DataFrame | None = None, k: int = RESULTS, candidates: int = CANDIDATES, pool: int = POOL,
    graph: bool = True, rerank: bool = True, lam: float = LAMBDA, scope: Scope = (), dense: DataFrame | None = None, lexical: DataFrame | None = None, reranker=None,
) -> DataFrame:
    """The whole flow: dense and lexical recall, fusion, expansion, rerank with prior, name boost, diversification.

    ``held`` is the counted corpus, where there is one; ``dense`` and ``lexical`` (qid, row_id, rank) replace the lists made from it,
    ``reranker`` the token coverage.
    """
    if dense is None or lexical is None:
        held = materialized(counted(corpus, scope), "counted") if held is None else held
    dense = embedded_top(queries, held, candidates, scope) if dense is None else dense
    rows = corpus.select(*scope, "row_id", key_of(F.col("path"), F.col("start_line")).alias("key"))
    lexical = bm25_top(queries, held, candidates, scope) if lexical is None else lexical
    dense, lexical = (x.select("qid", "row_id", "rank", F.lit(n).alias("list_no")) for n, x in enumerate((dense, lexical)))
    ranked = materialized(dense.union(lexical), "ranked")  # two lists a query
    chosen = pool_of(fuse(ranked.join(rows, "row_id").select(*scope, "qid", "list_no", "rank", "key"), scope=scope), corpus, pool, scope)
    if graph:
        chosen = expand(chosen, corpus, scope=scope)
    full = chosen.drop(*scope).join(corpus, "row_id").join(queries.select("qid", tokens(F.col("query")).alias("qtoks")), "qid")
    by = coverage(F.col("qtoks"), F.col("text"))
    if rerank and reranker is not None:
        full = materialized(full, "full")  # a few rows a query; the reranker sees and joins the same ones
        full, by = full.join(reranked(full, queries, reranker), ["qid", "row_id"]), F.col("score")
    base = by * code_prior(F.col("path"), F.col("kind")) if rerank else 1.0 / (F.col("pos") + 1)
    scored = full.withColumn("relevance", boosted(base, name_matches(F.col("qtoks"), F.col("name"))))
    return diversify(scored, k, lam).select("qid", "rank", "row_id", "key", "path", "kind", "name", "start_line", "end_line", F.round("relevance", 6).alias("relevance"), "mmr")


def format_hits(hits: DataFrame) -> DataFrame:
    """``path:start-end`` with kind and name where there is a name."""
    loc = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return hits.withColumn("location", F.concat(loc, F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.concat(F.lit(" "), "kind", F.lit(" "), "name")).otherwise("")))


# -- evaluation ---------------------------------------------------------
def recall(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, repo, n_expected, n_found, recall, hit, missing): an expected part counts if any hit's path holds it."""
    want = cases.select("qid", "repo", F.explode("expect").alias("part")).distinct()
    got = want.join(hits.select("qid", "path"), "qid", "left").groupBy("qid", "repo", "part").agg(F.max(F.coalesce(F.expr("contains(path, part)"), F.lit(False))).alias("found"))
    return got.groupBy("qid", "repo").agg(
        F.count("*").alias("n_expected"), F.sum(F.col("found").cast("int")).alias("n_found"), F.round(F.avg(F.col("found").cast("int")), 6).alias("recall"),
        F.max(F.col("found").cast("int")).alias("hit"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("part"))))).alias("missing"),
    )


def ndcg(hits: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg): gain of the hits (qid, row_id, rank from 0) discounted by rank, against the best order of ``relevance`` (qid, row_id, grade)."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 2)
    got = hits.where(F.col("rank") < k).select("qid", "row_id", F.col("rank").alias("place")).join(relevance, ["qid", "row_id"]).groupBy("qid").agg(F.sum(gain).alias("dcg"))
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "row_id")
    best = relevance.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("place", F.col("place") - 1)
    ideal = best.groupBy("qid").agg(F.sum(gain).alias("best"))
    return ideal.join(got, "qid", "left").select("qid", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("best"), 6).alias("ndcg"))


def evaluate(per_case: DataFrame) -> DataFrame:
    """Means per repository and over all cases (repo null)."""
    return per_case.rollup("repo").agg(F.count("*").alias("n_cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit"))
