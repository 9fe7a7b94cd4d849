"""Queries for the retrieval operators, over the whole chunk and evaluation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.tokens import GENERIC_NAME_TOKENS, tokens
from kestrel.operators import embedding
from kestrel.operators import retrieval as R
from kestrel.plans.queries import query
from kestrel.session import each_once, materialized
from kestrel.sources.tables import table

# -- SQL pieces ---------------------------------------------------------
_GENERIC = ", ".join(f"'{w}'" for w in GENERIC_NAME_TOKENS)


def toks_sql(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(regexp_replace(coalesce({text}, ''), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda z: lower(z))"
    )


CORPUS = """corpus AS (SELECT chunk_id AS row_id, repo || '/' || path AS path, kind, name, start_line, end_line, text, repo || '/' || path || ':' || start_line AS key
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) AS k_ FROM chunks) WHERE k_ = 1)"""
POST = CORPUS + f""",
raw AS (SELECT row_id, unnest({toks_sql('text')}) AS tok FROM corpus),
post AS (SELECT row_id, tok, count(*) AS tf FROM raw GROUP BY ALL)"""
LENGTHS = POST + """,
lengths AS (SELECT c.row_id, coalesce(sum(p.tf), 0) AS dl FROM corpus c LEFT JOIN post p USING (row_id) GROUP BY c.row_id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
dfreq AS (SELECT tok, count(*) AS df FROM post GROUP BY tok),
idf0 AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfreq, stats),
idf AS (SELECT tok, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0)"""
CASES = f""",
queries AS (SELECT case_id AS qid, query FROM eval_cases),
qt AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({toks_sql('query')}) AS tok FROM queries) GROUP BY ALL)"""
#: Queries whose tokens hardly occur: all places beyond the few hits are filled up.
NONE = CASES.replace("SELECT case_id AS qid, query FROM eval_cases", "SELECT case_id AS qid, reverse(query) AS query FROM eval_cases")
BM25 = """,
hits AS (SELECT q.qid, p.row_id, sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avgdl))) AS score
  FROM qt q JOIN post p USING (tok) JOIN idf i USING (tok) JOIN lengths l USING (row_id), stats s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) - 1 AS rank
  FROM (SELECT q.qid, l.row_id, round(coalesce(h.score, 0), 6) AS score FROM queries q CROSS JOIN lengths l LEFT JOIN hits h ON h.qid = q.qid AND h.row_id = l.row_id)) WHERE rank < 50)"""
_B = "((strpos('0123456789abcdef', substr(md5(tok), 1, 1)) - 1) * 4 + (strpos('0123456789abcdef', substr(md5(tok), 2, 1)) - 1) // 4)"
_S = "CASE WHEN strpos('0123456789abcdef', substr(md5(tok), 3, 1)) - 1 < 8 THEN 1 ELSE -1 END"
DENSE = f""",
dv AS (SELECT row_id, b, sum(s) AS v FROM (SELECT row_id, {_B} AS b, {_S} * tf AS s FROM post) GROUP BY ALL HAVING sum(s) <> 0),
dn AS (SELECT row_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM dv GROUP BY row_id),
qv AS (SELECT qid, b, sum(s) AS v FROM (SELECT qid, {_B} AS b, {_S} * qtf AS s FROM qt) GROUP BY ALL HAVING sum(s) <> 0),
qn AS (SELECT qid, sqrt(sum(v * v)::DOUBLE) AS norm FROM qv GROUP BY qid),
de AS (SELECT * FROM (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) - 1 AS rank FROM
  (SELECT qv.qid, dv.row_id, round(sum(dv.v * qv.v) / (max(dn.norm) * max(qn.norm)), 6) AS score FROM qv JOIN dv USING (b) JOIN dn USING (row_id) JOIN qn ON qn.qid = qv.qid GROUP BY qv.qid, dv.row_id)) WHERE rank < 50)"""
FUSED = """,
ranked AS (SELECT d.qid, 0 AS list_no, d.rank, c.key FROM de d JOIN corpus c USING (row_id) UNION ALL SELECT b.qid, 1, b.rank, c.key FROM bm b JOIN corpus c USING (row_id)),
fused AS (SELECT qid, key, rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, l, r) - 1 AS pos FROM
  (SELECT qid, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(list_no * 1000000 + rank) // 1000000 AS l, min(list_no * 1000000 + rank) % 1000000 AS r FROM ranked GROUP BY qid, key))"""
POOL = """,
keys AS (SELECT key, max(row_id) AS row_id FROM corpus GROUP BY key),
pool AS (SELECT * FROM (SELECT f.qid, f.key, k.row_id, row_number() OVER (PARTITION BY f.qid ORDER BY f.pos) - 1 AS pos FROM fused f JOIN keys k USING (key)) WHERE pos < 30)"""
DEFS = f""",
defs AS (SELECT lower(name) AS symbol, row_id FROM corpus WHERE name IS NOT NULL AND length(name) >= 4 AND lower(name) NOT IN ({_GENERIC}))"""
EXPAND = DEFS + f""",
ids AS (SELECT DISTINCT p.qid, p.pos, c.path AS from_path, lower(c.name) AS own, unnest(regexp_extract_all(c.text, '[A-Za-z_][A-Za-z0-9_]+')) AS ident FROM pool p JOIN corpus c USING (row_id) WHERE p.pos < 6),
cand AS (SELECT i.qid, i.pos, i.ident, c.row_id, c.key FROM ids i JOIN defs d ON d.symbol = lower(i.ident) JOIN corpus c ON c.row_id = d.row_id
  WHERE length(i.ident) >= 4 AND lower(i.ident) NOT IN ({_GENERIC}) AND lower(i.ident) IS DISTINCT FROM i.own AND c.path <> i.from_path
    AND NOT EXISTS (SELECT 1 FROM pool q WHERE q.qid = i.qid AND q.key = c.key)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos, ident, row_id) AS n FROM cand) WHERE n = 1),
extra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, ident, row_id) AS k FROM once) WHERE k <= 8),
wide AS (SELECT qid, key, row_id, pos FROM pool UNION ALL SELECT e.qid, e.key, e.row_id, s.size + e.k - 1 FROM extra e JOIN (SELECT qid, count(*) AS size FROM pool GROUP BY qid) s USING (qid))"""
PRIOR = """(CASE WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 0.3 WHEN kind = 'window' THEN 0.4 WHEN regexp_matches(lower(path), '\\.(html|htm)$') THEN 0.6 ELSE 1.0 END::DOUBLE
  * CASE WHEN contains(lower(path), '/migrations/') THEN 0.5 ELSE 1.0 END::DOUBLE
  * CASE WHEN contains(lower(path), '/tests/') OR starts_with(split_part(lower(path), '/', -1), 'test_') THEN 0.7 ELSE 1.0 END::DOUBLE
  * CASE WHEN contains(lower(path), '/management/commands/') OR contains(split_part(lower(path), '/', -1), 'seed') THEN 0.8 ELSE 1.0 END::DOUBLE)"""
_LIST_GENERIC = f"[{_GENERIC}]"
MATCHES = f"""len(list_filter(list_distinct(qtoks), lambda q: length(q) >= 5 AND NOT list_contains({_LIST_GENERIC}, q)
  AND len(list_filter(ntoks, lambda n: q = n OR (length(n) >= 4 AND (starts_with(q, n) OR starts_with(n, q))))) > 0))"""
COVER = "(CASE WHEN len(list_distinct(qtoks)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qtoks), list_distinct(ttoks)))::DOUBLE / len(list_distinct(qtoks)) END)"


def scored_sql(source: str, base: str, lam: float, k: int = 8) -> str:
    return f""",
full_ AS (SELECT w.qid, w.pos, c.*, {toks_sql('q.query')} AS qtoks, {toks_sql('c.name')} AS ntoks, {toks_sql('c.text')} AS ttoks FROM {source} w JOIN corpus c USING (row_id) JOIN queries q USING (qid)),
rel AS (SELECT *, {base} * (1 + 0.25::DOUBLE * {MATCHES}) AS relevance FROM full_),
pen AS (SELECT *, round({lam}::DOUBLE * relevance - (1 - {lam}::DOUBLE) * CASE WHEN row_number() OVER (PARTITION BY qid, path ORDER BY {lam}::DOUBLE * relevance DESC, pos) > 1 THEN 1 ELSE 0 END, 6) AS mmr FROM rel),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mmr DESC, pos) - 1 AS rank FROM pen) WHERE rank < {k})"""


RERANKED = f"({COVER} * {PRIOR})"
_OUT = "SELECT qid, rank::INT AS rank, row_id, key, path, kind, name, start_line, end_line, round(relevance, 6) AS relevance, mmr FROM best"
HYBRID = "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + POOL + EXPAND + scored_sql("wide", RERANKED, 0.7)


# -- inputs -------------------------------------------------------------
def corpus(spark, d):
    return R.corpus_of(table(spark, d, "chunks", "chunk_id", "repo", "path", "kind", "name", "start_line", "end_line", "text"))


def cases(spark, d):
    return table(spark, d, "eval_cases").select(F.col("case_id").alias("qid"), "repo", "query", "expect")


def all_cases(spark, d):
    return cases(spark, d).select("qid", "query")


def _index(spark, d):
    c = corpus(spark, d)
    return c, materialized(R.counted(c), "counted")


@query("tokenize_counts", "WITH " + CORPUS + f" SELECT row_id, len({toks_sql('text')}) AS n_tokens, len(list_distinct({toks_sql('text')})) AS n_distinct FROM corpus")
def tokenize_counts(spark, d):
    t = tokens(F.col("text"))
    return corpus(spark, d).select("row_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query("postings", "WITH " + POST + " SELECT row_id, tok, tf FROM post")
def postings(spark, d):
    return R.postings(corpus(spark, d)).select("row_id", "tok", "tf")


@query("doc_freq", "WITH " + POST + " SELECT tok, count(*) AS df FROM post GROUP BY tok")
def doc_freq(spark, d):
    return R.doc_freq(R.postings(corpus(spark, d)))


@query("corpus_stats", "WITH " + LENGTHS + " SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return R.corpus_stats(R.doc_lengths(corpus(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", "WITH " + LENGTHS + CASES + BM25 + " SELECT qid, row_id, score, rank::INT AS rank FROM bm")
def bm25_topk(spark, d):
    _, held = _index(spark, d)
    return R.bm25_top(cases(spark, d).select("qid", "query"), held)


@query("bm25_zero_fill", "WITH " + LENGTHS + NONE + BM25 + " SELECT qid, row_id, score, rank::INT AS rank FROM bm")
def bm25_zero_fill(spark, d):
    _, held = _index(spark, d)
    return R.bm25_top(all_cases(spark, d).select("qid", F.reverse("query").alias("query")), held)


@query("dense_topk", """
WITH q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.qid, e.vec_id AS row_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), q.v), 6) AS score FROM embeddings e CROSS JOIN q)
SELECT * FROM (SELECT qid, row_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) - 1)::INT AS rank FROM s) WHERE rank < 50
""")  # fmt: skip
def dense_topk(spark, d):
    """Every twentieth vector as a query against all vectors, exactly."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return R.nearest(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec")), q)


@query("embedded_topk", "WITH " + POST + CASES + DENSE + " SELECT qid, row_id, score, rank::INT AS rank FROM de")
def embedded_topk(spark, d):
    return R.embedded_top(all_cases(spark, d), R.counted(corpus(spark, d)))


def _ranked(spark, d):
    c, held = _index(spark, d)
    q = all_cases(spark, d)
    keys = c.select("row_id", R.key_of(F.col("path"), F.col("start_line")).alias("key"))
    both = R.embedded_top(q, held).select("qid", "row_id", "rank", F.lit(0).alias("list_no")).union(R.bm25_top(q, held).select("qid", "row_id", "rank", F.lit(1).alias("list_no")))
    return c, both.join(keys, "row_id").select("qid", "list_no", "rank", "key")


@query("rrf_fuse", "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + " SELECT qid, key, rrf, pos::INT AS pos FROM fused")
def rrf_fuse(spark, d):
    return R.fuse(_ranked(spark, d)[1])


@query("rrf_ties", """WITH ranked AS (SELECT label AS qid, 0 AS list_no, vec_id AS rank, vec_id::VARCHAR AS key FROM embeddings UNION ALL SELECT label, 1, 1000000 - vec_id, vec_id::VARCHAR FROM embeddings
UNION ALL SELECT label, 2, vec_id, (vec_id + 1)::VARCHAR FROM embeddings)
SELECT qid, key, rrf, (row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, f) - 1)::INT AS pos FROM
(SELECT qid, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(list_no * 10000000 + rank) AS f FROM ranked GROUP BY ALL)""")
def rrf_ties(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    lists = (
        e.select(F.col("label").alias("qid"), F.lit(0).alias("list_no"), F.col("vec_id").alias("rank"), F.col("vec_id").cast("string").alias("key"))
        .union(e.select("label", F.lit(1), F.lit(1000000) - F.col("vec_id"), F.col("vec_id").cast("string")))
        .union(e.select("label", F.lit(2), F.col("vec_id"), (F.col("vec_id") + 1).cast("string")))
    )
    return R.fuse(lists)


@query("key_dedupe", "WITH " + CORPUS + " SELECT key, max(row_id) AS row_id FROM corpus GROUP BY key")
def key_dedupe(spark, d):
    return R.keyed(corpus(spark, d))


@query("pool_cut", "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + POOL + " SELECT qid, key, row_id, pos::INT AS pos FROM pool")
def pool_cut(spark, d):
    c, ranked = _ranked(spark, d)
    return R.pool_of(R.fuse(ranked), c)


@query("symbol_defs", "WITH " + CORPUS + DEFS + " SELECT symbol, row_id FROM defs")
def symbol_defs(spark, d):
    return R.symbol_defs(corpus(spark, d))


@query("graph_expand", "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + POOL + EXPAND + " SELECT qid, key, row_id, pos::INT AS pos FROM wide")
def graph_expand(spark, d):
    c, ranked = _ranked(spark, d)
    return R.expand(R.pool_of(R.fuse(ranked), c), c)


@query("code_prior", "WITH " + CORPUS + f" SELECT row_id, round({PRIOR}, 6) AS prior FROM corpus")
def code_prior(spark, d):
    return corpus(spark, d).select("row_id", F.round(R.code_prior(F.col("path"), F.col("kind")), 6).alias("prior"))


#: Tokens are taken before the pairs are formed.
_PAIRS = CASES + f""",
ct AS (SELECT *, {toks_sql('name')} AS ntoks, {toks_sql('text')} AS ttoks FROM corpus),
full_ AS (SELECT q.qid, q.qtoks, c.* FROM ct c, (SELECT qid, {toks_sql('query')} AS qtoks FROM queries) q)"""


def _pairs(spark, d):
    q = all_cases(spark, d).select("qid", tokens(F.col("query")).alias("qtoks"))
    return corpus(spark, d).join(F.broadcast(q))


@query("name_match", "WITH " + CORPUS + _PAIRS + f" SELECT qid, row_id, {MATCHES}::INT AS matches FROM full_")
def name_match(spark, d):
    return _pairs(spark, d).select("qid", "row_id", R.name_matches(F.col("qtoks"), F.col("name")).alias("matches"))


@query("name_boost", "WITH " + CORPUS + _PAIRS + f" SELECT qid, row_id, round({PRIOR} * (1 + 0.25::DOUBLE * {MATCHES}), 6) AS boosted FROM full_")
def name_boost(spark, d):
    return _pairs(spark, d).select("qid", "row_id", F.round(R.boosted(R.code_prior(F.col("path"), F.col("kind")), R.name_matches(F.col("qtoks"), F.col("name"))), 6).alias("boosted"))


@query("lexical_rerank", "WITH " + CORPUS + _PAIRS + f" SELECT qid, row_id, round({COVER} * {PRIOR}, 6) AS relevance FROM full_")
def lexical_rerank(spark, d):
    return _pairs(spark, d).select("qid", "row_id", F.round(R.coverage(F.col("qtoks"), F.col("text")) * R.code_prior(F.col("path"), F.col("kind")), 6).alias("relevance"))


@query("sigmoid_rerank", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS score FROM events")
def sigmoid_rerank(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(R.sigmoid(F.col("value") / 100), 6).alias("score"))


@query("rank_proxy", "WITH " + LENGTHS + CASES + BM25 + " SELECT qid, row_id, round(1.0::DOUBLE / (rank + 1), 6) AS relevance FROM bm")
def rank_proxy(spark, d):
    _, held = _index(spark, d)
    return R.bm25_top(all_cases(spark, d), held).select("qid", "row_id", F.round(1.0 / (F.col("rank") + 1), 6).alias("relevance"))


def _mmr_sql(lam: float) -> str:
    return f"""WITH items AS (SELECT repo AS qid, path, scan_id AS pos, ((scan_id * 7919) % 1000) / 1000.0::DOUBLE AS relevance FROM (SELECT repo, path, min(scan_id) AS scan_id FROM file_scans GROUP BY repo, path, received_at)),
pen AS (SELECT *, round({lam}::DOUBLE * relevance - (1 - {lam}::DOUBLE) * CASE WHEN row_number() OVER (PARTITION BY qid, path ORDER BY {lam}::DOUBLE * relevance DESC, pos) > 1 THEN 1 ELSE 0 END, 6) AS mmr FROM items)
SELECT qid, path, pos, mmr, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mmr DESC, pos) - 1 AS rank FROM pen) WHERE rank < 8"""


def _mmr(spark, d, lam):
    items = table(spark, d, "file_scans").groupBy("repo", "path", "received_at").agg(F.min("scan_id").alias("pos")).select(
        F.col("repo").alias("qid"), "path", "pos", (((F.col("pos") * 7919) % 1000) / 1000.0).alias("relevance")
    )
    return R.diversify(items, 8, lam).select("qid", "path", "pos", "mmr", "rank")


@query("mmr_topk", _mmr_sql(0.7))
def mmr_topk(spark, d):
    return _mmr(spark, d, 0.7)


@query("mmr_pure", _mmr_sql(1.0))
def mmr_pure(spark, d):
    return _mmr(spark, d, 1.0)


@query("hybrid_search", HYBRID + _OUT)
def hybrid_search(spark, d):
    c = corpus(spark, d)
    return R.search(all_cases(spark, d), c, materialized(R.counted(c), "counted"))


@query("hybrid_no_graph", "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + POOL + scored_sql("pool", RERANKED, 0.7) + _OUT)
def hybrid_no_graph(spark, d):
    c = corpus(spark, d)
    return R.search(all_cases(spark, d), c, materialized(R.counted(c), "counted"), graph=False)


@query("hybrid_no_rerank", "WITH " + LENGTHS + CASES + BM25 + DENSE + FUSED + POOL + EXPAND + scored_sql("wide", "(1.0::DOUBLE / (pos + 1))", 0.7) + _OUT)
def hybrid_no_rerank(spark, d):
    c = corpus(spark, d)
    return R.search(all_cases(spark, d), c, materialized(R.counted(c), "counted"), rerank=False)


_FORMAT = """ SELECT qid, rank::INT AS rank, path || ':' || start_line || '-' || end_line || CASE WHEN name IS NOT NULL AND name <> '' THEN ' ' || kind || ' ' || name ELSE '' END AS location FROM best"""


@query("format_hits", HYBRID + _FORMAT)
def format_hits(spark, d):
    return R.format_hits(hybrid_search(spark, d)).select("qid", "rank", "location")


# -- evaluation: lexical retrieval of all cases --------------------------
_EVAL = LENGTHS + CASES + BM25 + """,
hits8 AS (SELECT b.qid, c.path FROM bm b JOIN corpus c USING (row_id) WHERE b.rank < 8),
want AS (SELECT DISTINCT case_id AS qid, repo, unnest(expect) AS part FROM eval_cases),
got AS (SELECT w.qid, w.repo, w.part, max(CASE WHEN contains(h.path, w.part) THEN 1 ELSE 0 END) AS found FROM want w LEFT JOIN hits8 h USING (qid) GROUP BY ALL),
per AS (SELECT qid, repo, count(*) AS n_expected, sum(found)::BIGINT AS n_found, round(avg(found), 6) AS recall, max(found)::INT AS hit,
  coalesce(string_agg(CASE WHEN found = 0 THEN part END, ',' ORDER BY part), '') AS missing FROM got GROUP BY ALL)"""


def _per_case(spark, d):
    c, held = _index(spark, d)
    k = cases(spark, d)
    hits = R.bm25_top(k.select("qid", "query"), held).where("rank < 8").join(c.select("row_id", "path"), "row_id")
    return R.recall(hits.select("qid", "path"), k)


@query("recall_at_k", "WITH " + _EVAL + " SELECT qid, n_expected, n_found, recall FROM per")
def recall_at_k(spark, d):
    return _per_case(spark, d).select("qid", "n_expected", "n_found", "recall")


@query("hit_at_k", "WITH " + _EVAL + " SELECT qid, hit FROM per")
def hit_at_k(spark, d):
    return _per_case(spark, d).select("qid", "hit")


@query("eval_missing", "WITH " + _EVAL + " SELECT qid, missing FROM per")
def eval_missing(spark, d):
    return _per_case(spark, d).select("qid", "missing")


@query("eval_by_group", "WITH " + _EVAL + " SELECT repo, count(*) AS n_cases, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM per GROUP BY ROLLUP (repo)")
def eval_by_group(spark, d):
    return R.evaluate(_per_case(spark, d))

# -- evaluation: the whole search of all cases, each in its own repository --
_OWN = "WITH " + f"""corpus AS (SELECT chunk_id AS row_id, repo, path, kind, name, start_line, end_line, text, path || ':' || start_line AS key
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) AS k_ FROM chunks) WHERE k_ = 1),
raw AS (SELECT repo, row_id, unnest({toks_sql('text')}) AS tok FROM corpus),
post AS (SELECT repo, row_id, tok, count(*) AS tf FROM raw GROUP BY ALL),
lengths AS (SELECT c.repo, c.row_id, coalesce(sum(p.tf), 0) AS dl FROM corpus c LEFT JOIN post p USING (row_id) GROUP BY ALL),
stats AS (SELECT repo, count(*) AS n, avg(dl) AS avgdl FROM lengths GROUP BY repo),
dfreq AS (SELECT repo, tok, count(*) AS df FROM post GROUP BY ALL),
idf0 AS (SELECT repo, tok, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfreq JOIN stats USING (repo)),
mean0 AS (SELECT repo, avg(idf) AS mean FROM idf0 GROUP BY repo),
idf AS (SELECT repo, tok, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM idf0 JOIN mean0 USING (repo)),
queries AS (SELECT case_id AS qid, repo, query FROM eval_cases),
qt AS (SELECT qid, repo, tok, count(*) AS qtf FROM (SELECT qid, repo, unnest({toks_sql('query')}) AS tok FROM queries) GROUP BY ALL),
hits AS (SELECT q.qid, p.row_id, sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avgdl))) AS score
  FROM qt q JOIN post p USING (repo, tok) JOIN idf i USING (repo, tok) JOIN lengths l ON l.row_id = p.row_id JOIN stats s ON s.repo = q.repo GROUP BY ALL),
bm AS (SELECT * FROM (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) - 1 AS rank
  FROM (SELECT q.qid, l.row_id, round(coalesce(h.score, 0), 6) AS score FROM queries q JOIN lengths l USING (repo) LEFT JOIN hits h ON h.qid = q.qid AND h.row_id = l.row_id)) WHERE rank < 50),
dv AS (SELECT repo, row_id, b, sum(s) AS v FROM (SELECT repo, row_id, {_B} AS b, {_S} * tf AS s FROM post) GROUP BY ALL HAVING sum(s) <> 0),
dn AS (SELECT row_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM dv GROUP BY row_id),
qv AS (SELECT qid, repo, b, sum(s) AS v FROM (SELECT qid, repo, {_B} AS b, {_S} * qtf AS s FROM qt) GROUP BY ALL HAVING sum(s) <> 0),
qn AS (SELECT qid, sqrt(sum(v * v)::DOUBLE) AS norm FROM qv GROUP BY qid),
de AS (SELECT * FROM (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) - 1 AS rank FROM
  (SELECT qv.qid, dv.row_id, round(sum(dv.v * qv.v) / (max(dn.norm) * max(qn.norm)), 6) AS score FROM qv JOIN dv USING (repo, b) JOIN dn USING (row_id) JOIN qn ON qn.qid = qv.qid GROUP BY qv.qid, dv.row_id)) WHERE rank < 50)""" + FUSED + f""",
keys AS (SELECT repo, key, max(row_id) AS row_id FROM corpus GROUP BY ALL),
pool AS (SELECT * FROM (SELECT f.qid, q.repo, f.key, k.row_id, row_number() OVER (PARTITION BY f.qid ORDER BY f.pos) - 1 AS pos FROM fused f JOIN queries q USING (qid) JOIN keys k ON k.key = f.key AND k.repo = q.repo) WHERE pos < 30),
defs AS (SELECT repo, lower(name) AS symbol, row_id FROM corpus WHERE name IS NOT NULL AND length(name) >= 4 AND lower(name) NOT IN ({_GENERIC})),
ids AS (SELECT DISTINCT p.qid, p.repo, p.pos, c.path AS from_path, lower(c.name) AS own, unnest(regexp_extract_all(c.text, '[A-Za-z_][A-Za-z0-9_]+')) AS ident FROM pool p JOIN corpus c USING (row_id) WHERE p.pos < 6),
cand AS (SELECT i.qid, i.pos, i.ident, c.row_id, c.key FROM ids i JOIN defs d ON d.symbol = lower(i.ident) AND d.repo = i.repo JOIN corpus c ON c.row_id = d.row_id
  WHERE length(i.ident) >= 4 AND lower(i.ident) NOT IN ({_GENERIC}) AND lower(i.ident) IS DISTINCT FROM i.own AND c.path <> i.from_path
    AND NOT EXISTS (SELECT 1 FROM pool q WHERE q.qid = i.qid AND q.key = c.key)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos, ident, row_id) AS n FROM cand) WHERE n = 1),
extra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, ident, row_id) AS k FROM once) WHERE k <= 8),
wide AS (SELECT qid, key, row_id, pos FROM pool UNION ALL SELECT e.qid, e.key, e.row_id, s.size + e.k - 1 FROM extra e JOIN (SELECT qid, count(*) AS size FROM pool GROUP BY qid) s USING (qid))""" + scored_sql("wide", RERANKED, 0.7) + """,
want AS (SELECT DISTINCT case_id AS qid, repo, unnest(expect) AS part FROM eval_cases),
got AS (SELECT w.qid, w.repo, w.part, max(CASE WHEN contains(h.path, w.part) THEN 1 ELSE 0 END) AS found FROM want w LEFT JOIN best h USING (qid) GROUP BY ALL),
per AS (SELECT qid, repo, count(*) AS n_expected, sum(found)::BIGINT AS n_found, round(avg(found), 6) AS recall, max(found)::INT AS hit,
  coalesce(string_agg(CASE WHEN found = 0 THEN part END, ',' ORDER BY part), '') AS missing FROM got GROUP BY ALL)"""


def own_corpus(spark, d):
    """Chunks as the index of each repository holds them: paths begin below the repository."""
    c = table(spark, d, "chunks", "chunk_id", "repo", "path", "kind", "name", "start_line", "end_line", "text")
    return each_once(c, "chunk_id").withColumnRenamed("chunk_id", "row_id")


def _searched(spark, d):
    c, k = own_corpus(spark, d), cases(spark, d)
    held = materialized(R.counted(c, ("repo",)), "counted")
    hits = R.search(k.select("repo", "qid", "query"), c, held, scope=("repo",))
    return R.recall(hits.select("qid", "path"), k)


@query("search_recall_at_k", _OWN + " SELECT qid, n_expected, n_found, recall FROM per")
def search_recall_at_k(spark, d):
    return _searched(spark, d).select("qid", "n_expected", "n_found", "recall")


@query("search_hit_at_k", _OWN + " SELECT qid, hit FROM per")
def search_hit_at_k(spark, d):
    return _searched(spark, d).select("qid", "hit")


@query("search_missing", _OWN + " SELECT qid, missing FROM per")
def search_missing(spark, d):
    return _searched(spark, d).select("qid", "missing")


@query("search_own", _OWN + " SELECT qid, rank::INT AS rank, row_id, key, round(relevance, 6) AS relevance, mmr FROM best")
def search_own(spark, d):
    """What the search finds for every case in its own repository."""
    c, k = own_corpus(spark, d), cases(spark, d)
    hits = R.search(k.select("repo", "qid", "query"), c, materialized(R.counted(c, ("repo",)), "counted"), scope=("repo",))
    return hits.select("qid", "rank", "row_id", "key", "relevance", "mmr")


@query("search_by_group", _OWN + " SELECT repo, count(*) AS n_cases, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM per GROUP BY ROLLUP (repo)")
def search_by_group(spark, d):
    return R.evaluate(_searched(spark, d))


# -- evaluation on cases whose answer exists: the name of every twentieth chunk that has one, and its file --
_FOUND_CASES = f""",
queries AS (SELECT row_id AS qid, array_to_string({toks_sql('name')}, ' ') AS query FROM corpus WHERE row_id % 20 = 0 AND len({toks_sql('name')}) > 0),
qt AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({toks_sql('query')}) AS tok FROM queries) GROUP BY ALL)"""


def _found_sql(k: int) -> str:
    return "WITH " + LENGTHS + _FOUND_CASES + BM25 + DENSE + FUSED + POOL + EXPAND + scored_sql("wide", RERANKED, 0.7, k)


_FOUND = _found_sql(R.RESULTS) + """,
want AS (SELECT row_id AS qid, split_part(path, '/', 1) AS repo, path AS part FROM corpus WHERE row_id IN (SELECT qid FROM queries)),
per AS (SELECT w.qid, w.repo, w.part, max(CASE WHEN contains(h.path, w.part) THEN 1 ELSE 0 END) AS found FROM want w LEFT JOIN best h USING (qid) GROUP BY ALL)"""


def _found_cases(spark, d):
    t = tokens(F.col("name"))
    named = corpus(spark, d).where((F.col("row_id") % 20 == 0) & (F.size(t) > 0))
    return named.select(F.col("row_id").alias("qid"), F.split("path", "/")[0].alias("repo"), F.array_join(t, " ").alias("query"), F.array("path").alias("expect"))


def _found(spark, d):
    c, k = corpus(spark, d), _found_cases(spark, d)
    hits = R.search(k.select("qid", "query"), c, materialized(R.counted(c), "counted"))
    return R.recall(hits.select("qid", "path"), k)


@query("found_recall_at_k", _FOUND + " SELECT qid, 1::BIGINT AS n_expected, found::BIGINT AS n_found, found::DOUBLE AS recall FROM per")
def found_recall_at_k(spark, d):
    return _found(spark, d).select("qid", "n_expected", "n_found", "recall")


@query("found_missing", _FOUND + " SELECT qid, found::INT AS hit, CASE WHEN found = 0 THEN part ELSE '' END AS missing FROM per")
def found_missing(spark, d):
    return _found(spark, d).select("qid", "hit", "missing")


@query("found_by_group", _FOUND + " SELECT repo, count(*) AS n_cases, round(avg(found), 6) AS recall, round(avg(found), 6) AS hit FROM per GROUP BY ROLLUP (repo)")
def found_by_group(spark, d):
    return R.evaluate(_found(spark, d))


@query("found_ndcg", _found_sql(10) + """,
grades AS (SELECT a.row_id AS qid, b.row_id, CASE WHEN a.row_id = b.row_id THEN 2 ELSE 1 END AS grade FROM corpus a JOIN corpus b ON a.path = b.path WHERE a.row_id IN (SELECT qid FROM queries)),
ideal AS (SELECT qid, sum((pow(2.0, grade) - 1) / log2(place + 2)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, row_id) - 1 AS place FROM grades) WHERE place < 10 GROUP BY qid),
got AS (SELECT g.qid, sum((pow(2.0, g.grade) - 1) / log2(h.rank + 2)) AS dcg FROM best h JOIN grades g ON g.qid = h.qid AND g.row_id = h.row_id GROUP BY g.qid)
SELECT i.qid, round(coalesce(g.dcg, 0) / i.best, 6) AS ndcg FROM ideal i LEFT JOIN got g USING (qid)""")
def found_ndcg(spark, d):
    """NDCG at 10 of the searches for those names: the chunk itself is worth most, others of its file less."""
    c, k = corpus(spark, d), _found_cases(spark, d)
    hits = R.search(k.select("qid", "query"), c, materialized(R.counted(c), "counted"), k=10)
    rows = c.select("row_id", "path")
    grades = rows.join(k.select("qid", F.col("expect")[0].alias("path")), "path").select("qid", "row_id", F.when(F.col("qid") == F.col("row_id"), 2).otherwise(1).alias("grade"))
    return R.ndcg(hits, grades)


@query("embedded_vectors", "WITH " + POST + f""",
dv AS (SELECT row_id, b, sum(s) AS v FROM (SELECT row_id, {_B} AS b, {_S} * tf AS s FROM post) GROUP BY ALL HAVING sum(s) <> 0),
dn AS (SELECT row_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM dv GROUP BY row_id)
SELECT row_id AS chunk_id, b::INT AS b, round(v / norm, 4) AS value FROM dv JOIN dn USING (row_id)""")
def embedded_vectors(spark, d):
    """What the default embedder makes of every chunk, in its batches: the places that are not zero."""
    v = embedding.embed_column(each_once(table(spark, d, "chunks", "chunk_id", "text"), "chunk_id"), embedding.HashedEmbedder())
    each = v.select("chunk_id", F.posexplode("vector").alias("b", "x")).where("x <> 0")
    return each.select("chunk_id", "b", F.round(F.col("x").cast("double"), 4).alias("value"))


_FOUND_OWN = _OWN.replace(
    "queries AS (SELECT case_id AS qid, repo, query FROM eval_cases)",
    f"queries AS (SELECT row_id AS qid, repo, array_to_string({toks_sql('name')}, ' ') AS query FROM corpus WHERE row_id % 20 = 0 AND len({toks_sql('name')}) > 0)",
).replace(
    "want AS (SELECT DISTINCT case_id AS qid, repo, unnest(expect) AS part FROM eval_cases)",
    "want AS (SELECT row_id AS qid, repo, path AS part FROM corpus WHERE row_id IN (SELECT qid FROM queries))",
)


def _found_own(spark, d):
    """The same names, each looked for in its own repository."""
    c, t = own_corpus(spark, d), tokens(F.col("name"))
    k = c.where((F.col("row_id") % 20 == 0) & (F.size(t) > 0)).select(F.col("row_id").alias("qid"), "repo", F.array_join(t, " ").alias("query"), F.array("path").alias("expect"))
    held = materialized(R.counted(c, ("repo",)), "counted")
    return R.recall(R.search(k.select("repo", "qid", "query"), c, held, scope=("repo",)).select("qid", "path"), k)


@query("found_own_recall_at_k", _FOUND_OWN + " SELECT qid, n_expected, n_found, recall FROM per")
def found_own_recall_at_k(spark, d):
    return _found_own(spark, d).select("qid", "n_expected", "n_found", "recall")


@query("found_own_by_group", _FOUND_OWN + " SELECT repo, count(*) AS n_cases, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM per GROUP BY ROLLUP (repo)")
def found_own_by_group(spark, d):
    return R.evaluate(_found_own(spark, d))
