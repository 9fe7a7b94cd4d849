import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.functions.tokens import tokenize, tokens
from kestrel.operators import files as FL
from kestrel.operators import retrieval as R


def test_tokens(spark):
    assert tokenize("fetchUserById") == ["fetch", "user", "by", "id"]
    assert tokenize("user_id") == ["user", "id"]
    assert tokenize("HTTPServerError") == ["http", "server", "error"]
    texts = ["fetchUserById HTTP2Server", None, "", "éa1B_c ABCd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tokens(F.col("t")).alias("x")).collect():
        assert r.x == tokenize(texts[r.i] or "")


def _fuse(spark, lists):
    rows = [(1, n, k, key) for n, ks in enumerate(lists) for k, key in enumerate(ks)]
    return [r.key for r in R.fuse(spark.createDataFrame(rows, "qid int, list_no int, rank int, key string")).orderBy("pos").collect()]


def test_fusion(spark):
    assert _fuse(spark, [["x", "a"], ["y", "a"]])[0] == "a"
    assert _fuse(spark, [["a", "b", "c"], ["b", "c", "a"]])[:2] == ["b", "a"]
    assert _fuse(spark, [[], []]) == []


def _greedy(paths, rel, k, lam):
    left, seen, out = list(range(len(paths))), set(), []
    while left and len(out) < k:
        best = max(left, key=lambda i: (round(lam * rel[i] - (1 - lam) * (paths[i] in seen), 6), -i))
        out.append(best)
        seen.add(paths[best])
        left.remove(best)
    return out


def test_diversify_is_the_greedy_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(200):
        n = rng.randint(1, 12)
        paths = [rng.choice("abcd") for _ in range(n)]
        rel = [rng.choice([0.1, 0.2, 0.5, 0.5, 0.9, 1.25]) for _ in range(n)]
        rows += [(q, i, p, r) for i, (p, r) in enumerate(zip(paths, rel))]
        want[q] = _greedy(paths, rel, 5, 0.7)
    got = {}
    for r in R.diversify(spark.createDataFrame(rows, "qid int, pos int, path string, relevance double"), 5, 0.7).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pos)
    assert got == want


def test_diversify_goldens(spark):
    rows = [(0, 0, "views", 1.0), (0, 1, "views", 0.95), (0, 2, "render", 0.8)]
    df = spark.createDataFrame(rows, "qid int, pos int, path string, relevance double")
    pick = lambda lam: [r.path for r in R.diversify(df, 2, lam).orderBy("rank").collect()]
    assert pick(1.0) == ["views", "views"] and pick(0.5) == ["views", "render"]


def test_prior_and_names(spark):
    rows = [("app/services/pdf.py", "function_definition"), ("README.md", "window"), ("app/tests/x.py", "function_definition"), ("app/migrations/1.py", "function_definition"), ("tests/x.py", "function_definition")]
    p = [r.p for r in spark.createDataFrame(rows, "path string, kind string").select(R.code_prior(F.col("path"), F.col("kind")).alias("p")).collect()]
    assert p == [1.0, 0.3, 0.7, 0.5, 1.0]
    q = "ollama aging payments report"
    names = [("_ollama_call", 1), ("report_aging", 2), ("Payment", 1), ("render_pdf_bytes", 0), (None, 0)]
    df = spark.createDataFrame(names, "name string, want int").withColumn("q", F.lit(q))
    for r in df.select("want", R.name_matches(tokens(F.col("q")), F.col("name")).alias("n")).collect():
        assert r.n == r.want
    df = spark.createDataFrame([("settings_view",), ("document_form_view",)], "name string").withColumn("q", F.lit("which views show documents"))
    assert [r.n for r in df.select(R.name_matches(tokens(F.col("q")), F.col("name")).alias("n")).collect()] == [0, 0]


CORPUS = "row_id bigint, path string, kind string, name string, start_line int, end_line int, text string"


def test_expansion_and_search(spark):
    corpus = spark.createDataFrame(
        [
            (1, "a.py", "function_definition", "make_pdf", 1, 3, "def make_pdf(): return render_bytes(load)"),
            (2, "b.py", "function_definition", "render_bytes", 1, 2, "def render_bytes(x): pass"),
            (3, "a.py", "function_definition", "render_bytes", 9, 9, "def render_bytes(y): pass"),
            (4, "c.py", "function_definition", "other", 1, 1, "def other(): pass"),
        ], CORPUS,
    )
    pool = spark.createDataFrame([(0, "a.py:1", 1, 0)], "qid int, key string, row_id bigint, pos int")
    assert [(r.row_id, r.pos) for r in R.expand(pool, corpus).orderBy("pos").collect()] == [(1, 0), (2, 1)]
    q = spark.createDataFrame([(0, "make the pdf bytes"), (1, "")], "qid int, query string")
    hits = R.search(q, corpus).orderBy("qid", "rank").collect()
    assert hits[0].row_id in (1, 2, 3) and {h.qid for h in hits if h["rank"] == 0} == {0, 1}
    assert R.format_hits(R.search(q, corpus)).where("qid = 0 and row_id = 1").first().location == "a.py:1-3 function_definition make_pdf"
    assert R.search(q, corpus.where("false")).count() == 0


def test_zero_scores_fill_up(spark):
    corpus = spark.createDataFrame([(i, f"p{i}", "x", None, 1, 1, "alpha beta" if i == 7 else "gamma") for i in range(9)], CORPUS)
    q = spark.createDataFrame([(0, "beta")], "qid int, query string")
    got = [r.row_id for r in R.bm25_top(q, R.counted(corpus), 4).orderBy("rank").collect()]
    assert got == [7, 0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "", "\n", "\r\n", "\r", "\u2028", "\x0b"]), max_size=200))
def test_windows_like_splitlines(parts):
    from kestrel.operators.chunking import window_chunks

    text = "".join(parts)
    lines = text.splitlines()
    got = list(window_chunks(text))
    n = len(lines)
    assert len(got) == (0 if n == 0 else 1 if n <= 60 else -(-(n - 60) // 50) + 1)
    for _, _, a, b, t, _ in got:
        assert t == "\n".join(lines[a - 1 : b])


def test_native_windows_agree(spark):
    from kestrel.operators.chunking import window_chunks

    texts = ["\n".join(f"l{i}" for i in range(n)) + tail for n in (1, 59, 60, 61, 110, 111, 260) for tail in ("", "\n", "\r\n")] + ["", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in FL.windows(df).collect():
        got.setdefault(r.i, []).append((r.start_line, r.end_line, r.text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(a, b, x) for _, _, a, b, x, _ in window_chunks(t)]


def test_recall(spark):
    cases = spark.createDataFrame([(1, "r", ["a/", "zz"]), (2, "s", ["b.py"])], "qid int, repo string, expect array<string>")
    hits = spark.createDataFrame([(1, "a/x.py"), (2, "c.py")], "qid int, path string")
    got = {r.qid: (r.recall, r.hit, r.missing) for r in R.recall(hits, cases).collect()}
    assert got == {1: (0.5, 1, "zz"), 2: (0.0, 0, "b.py")}
    assert {r.repo: r.recall for r in R.evaluate(R.recall(hits, cases)).collect()} == {"r": 0.5, "s": 0.0, None: 0.25}


def test_scoped_search_is_the_search_of_each_index(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta render_bytes make_pdf loadTree walk file_hash".split()
    names = ["render_bytes", "make_pdf", "load_tree", None, "walk_all"]
    schema = CORPUS + ", repo string"
    rows = [
        (i, f"{rng.choice(['src', 'tests', 'x'])}/{rng.choice('abcd')}.py", rng.choice(["window", "function_definition"]), rng.choice(names), rng.randint(1, 9), 20, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice("rs"))
        for i in range(160)
    ]
    corpus = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(0, "r", "make the pdf bytes"), (1, "s", "make the pdf bytes"), (2, "s", "walk file hash zzz"), (3, "r", ""), (4, "none", "alpha")], "qid int, repo string, query string")
    whole = sorted(map(tuple, R.search(q, corpus, scope=("repo",)).collect()))
    alone = []
    for repo in ("r", "s"):
        alone += map(tuple, R.search(q.where(F.col("repo") == repo).select("qid", "query"), corpus.where(F.col("repo") == repo).drop("repo")).collect())
    assert whole == sorted(alone) and {r[0] for r in whole} == {0, 1, 2, 3}


def test_recall_is_measured_on_the_search_in_the_own_repository(spark, tmp_path):
    from kestrel.plans import retrieval_queries  # noqa: F401  (it registers its queries)
    from kestrel.plans.queries import QUERIES

    rows = [(i, "other", f"o{i}.py", "function_definition", "quorum", 1, 2, "quorum leases") for i in range(40)]
    rows += [(100, "mine", "a/store.py", "function_definition", "keep", 1, 2, "def keep(): return quorum + leases + more + and_more")]
    rows += [(101 + i, "mine", f"m{i}.py", "function_definition", f"fn{i}", 1, 2, "nothing here") for i in range(20)]
    spark.createDataFrame(rows, "chunk_id bigint, repo string, path string, kind string, name string, start_line int, end_line int, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "mine", "quorum leases", ["a/store.py"])], "case_id bigint, repo string, query string, expect array<string>").write.parquet(f"{tmp_path}/eval_cases.parquet")
    assert QUERIES["recall_at_k"](spark, str(tmp_path)).first().recall == 0.0  # BM25 over all repositories
    assert QUERIES["search_recall_at_k"](spark, str(tmp_path)).first().recall == 1.0
    assert QUERIES["search_hit_at_k"](spark, str(tmp_path)).first().hit == 1
    assert QUERIES["search_missing"](spark, str(tmp_path)).first().missing == ""
    assert {r.repo: r.recall for r in QUERIES["search_by_group"](spark, str(tmp_path)).collect()} == {"mine": 1.0, None: 1.0}


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from kestrel.operators import retrieval as R

    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 8)).astype(float)
    x[7] = 0
    rows = [(i, v.tolist(), f"s{i % 3}") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "row_id bigint, vec array<double>, scope_ string").repartition(5)
    queries = spark.createDataFrame([(i, v, s) for i, v, s in rows[:40]], "qid bigint, qvec array<double>, scope_ string")
    monkeypatch.setattr(R, "QUERY_BLOCK", 9)

    def brute(scoped, sharing):
        out = {}
        for q in range(40):
            some = []
            for i in range(300):
                if scoped and i % 3 != q % 3 or sharing and not ((x[i] != 0) & (x[q] != 0)).any():
                    continue
                n = np.linalg.norm(x[i]) * np.linalg.norm(x[q])
                some.append((-round(float(x[i] @ x[q] / n), 6) if n else 2.0, i))
            out[q] = [i for _, i in sorted(some)[:10]]
        return out

    for scoped in (False, True):
        for sharing in (False, True):
            got = {}
            for r in R.nearest(vectors, queries, 10, ("scope_",) if scoped else (), sharing).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append(r.row_id)
            assert {q: v for q, v in brute(scoped, sharing).items() if v} == got
    assert R.nearest(vectors.where("false"), queries, 10).count() == 0 and R.nearest(vectors, queries.where("false"), 10).count() == 0


def test_ndcg(spark):
    from math import log2

    from kestrel.operators import retrieval as R

    hits = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (1, 7, 2), (2, 5, 0)], "qid int, row_id int, rank int")
    grades = spark.createDataFrame([(1, 6, 2), (1, 7, 1), (1, 9, 1), (2, 8, 1)], "qid int, row_id int, grade int")
    got = {r.qid: r.ndcg for r in R.ndcg(hits, grades).collect()}
    assert got == {1: round((3 / log2(3) + 1 / log2(4)) / (3 + 1 / log2(3) + 1 / log2(4)), 6), 2: 0.0}
