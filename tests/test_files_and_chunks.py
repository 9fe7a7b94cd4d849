import hashlib
import subprocess
import time

from pyspark.sql import functions as F

from kestrel.operators import embedding as E
from kestrel.operators import files as FL
from kestrel.operators.chunking import chunk_text
from kestrel.plans.index import index_repo
from kestrel.plans.service import PathRegistry, Service, safe_cwd
from kestrel.sources.store import VersionedTable
from kestrel.streaming import watch as W


def test_filters(spark):
    rows = [("a.py", "python", True, True), ("x/.env", None, False, True), (".env.local", None, False, True), ("a.min.js", "javascript", False, True), ("dist/a.ts", "typescript", True, False), ("a/b.egg-info/c.py", "python", True, False), ("dist", None, True, True)]
    df = spark.createDataFrame(rows, "path string, lang string, f boolean, d boolean")
    for r in df.select("*", FL.language_of(F.col("path")).alias("l"), FL.file_wanted(F.col("path")).alias("wf"), FL.dirs_wanted(F.col("path")).alias("wd")).collect():
        assert (r.l, r.wf, r.wd) == (r.lang, r.f, r.d)


def test_hash_and_decode(spark):
    df = spark.createDataFrame([(bytearray("é\r\nx\ry".encode()),), (bytearray(b"\x80"),)], "content binary").select(FL.decoded(F.col("content")).alias("t"))
    assert [r.t for r in df.collect()] == ["é\nx\ny", None]
    h = df.where("t is not null").select(FL.file_hash(F.col("t"), "m:1").alias("h")).first().h
    assert h == hashlib.sha1("v2\0m:1\0é\nx\ny".encode()).hexdigest()


def test_small_file_whole():
    got = chunk_text("a.py", "import x\n\n@d\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n")
    assert [(c[0], c[1], c[2], c[3], c[5]) for c in got] == [("function_definition", "f", 4, 5, None), ("class_definition", "A", 7, 9, None)]


def test_large_class_is_split():
    body = "".join(f"    field_{i} = {i}\n" for i in range(60)) + "".join(f"    @property\n    def p{i}(self):\n        return {i}\n\n" for i in range(30))
    body += "    def big(self):\n" + "".join(f"        x{i} = {i}\n" for i in range(10))
    got = chunk_text("a.py", "class Model:\n" + body)
    assert ("function_definition", "big", "Model") in [(c[0], c[1], c[5]) for c in got]
    assert all(c[4].startswith("# in Model:\n") for c in got) and sum(c[0] == "members" for c in got) >= 2
    text = "\n".join(c[4] for c in got)
    assert all(f"field_{i} = {i}" in text for i in range(60)) and all(f"def p{i}(" in text for i in range(30))


def test_leaf_script_text_and_languages():
    leaf = chunk_text("a.py", "def f():\n" + "".join(f"    a{i} = {i}\n" for i in range(130)))
    assert leaf and "a129 = 129" in "\n".join(c[4] for c in leaf)
    script = chunk_text("a.py", "".join(f"call({i})\n" for i in range(150)))
    assert {c[0] for c in script} == {"window"} and script[0][2] == 1
    assert [c[0] for c in chunk_text("notes.txt", "hello\n")] == ["window"]
    js = chunk_text("a.js", "function add(a, b) { return a + b }\nclass Svc { run() {} }\n")
    assert [c[1] for c in js] == ["add", "Svc"]
    assert [c[1] for c in chunk_text("u.py", "def café():\n    pass\n\nclass Ångström:\n    pass\n")] == ["café", "Ångström"]
    assert chunk_text("a.py", "") == [] and chunk_text("a.py", None) == [] and chunk_text("a.txt", " \n\n") == []
    deep = chunk_text("d.py", "".join(" " * i + f"if a{i}:\n" for i in range(90)) + " " * 90 + "pass\n")
    assert {c[0] for c in deep} == {"window"}


def test_batches():
    assert [len(b) for b in E.greedy_batches(["x"] * 7, 3)] == [3, 3, 1]
    got = list(E.greedy_batches(["x" * 200] * 4, 128, 100))
    assert sum(map(len, got)) == 4 and all(sum(map(E.estimate, b)) <= 100 for b in got)
    got = list(E.greedy_batches(["x" * 10_000, "a", "b"], 128, 100))
    assert [len(b) for b in got] == [1, 2]
    calls, slept = [], []

    def call(t):
        calls.append(t)
        if len(calls) < 3:
            raise E.RateLimited
        return [[1.0]] * len(t)

    assert E.with_retry(call, ["a"], slept.append) == [[1.0]] and len(slept) == 2 and slept[1] > slept[0]


def _git(root):
    for args in (["init", "-q"], ["add", "-A"]):
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)


class Counting(E.HashedEmbedder):
    model_name = "counting"


def test_index_and_service(spark, tmp_path):
    root, store = tmp_path / "proj", str(tmp_path / "store")
    root.mkdir()
    (root / "keep.py").write_text("def render_invoice(x):\n    return x\n")
    (root / "more.py").write_text("def load_payment(y):\n    return y\n")
    (root / "debug.log").write_text("noise\n")
    (root / ".gitignore").write_text("*.log\n")
    _git(root)
    n = index_repo(spark, str(root), "proj", store=store)
    t = VersionedTable(spark, store, "proj")
    rows = {r.path: r for r in t.read().collect()}
    assert "keep.py" in rows and "debug.log" not in rows and n == len(rows)
    assert index_repo(spark, str(root), "proj", store=store) == n and t.version() == 2
    (root / "more.py").write_text("def load_payment(y):\n    return y + 1\n\ndef extra():\n    pass\n")
    (root / "keep.py").unlink()
    assert index_repo(spark, str(root), "proj", store=store) == n
    assert {r.name for r in t.read().where("path like '%.py'").collect()} == {"load_payment", "extra"}
    for f in root.iterdir():
        if f.is_file():
            f.unlink()
    assert index_repo(spark, str(root), "proj", store=store) == 0 and t.version() == 3

    s = Service(spark, store, cwd="/")
    assert s.list_indexed_repos() == "- proj"
    assert s.codebase_search("load payment", "proj").startswith("more.py:1-2 function_definition load_payment")
    assert s.codebase_search("x", "unknown").startswith("Don't know")


def test_readiness(spark, tmp_path):
    calls = []

    def fake(spark, root, repo, store):
        calls.append(root)

    s = Service(spark, str(tmp_path), index=fake, cwd="/")
    VersionedTable(spark, str(tmp_path), "old").publish(spark.range(1))
    assert s.prepare("old", None) is None and calls == []
    assert s.prepare("old", "/p") is None and s.prepare("old", "/p") is None and s.prepare("old", None) is None
    assert calls == ["/p"] and s.resolve("old", None) == "/p" and s.resolve("old", "/q") == "/q" and s.resolve("none", None) is None
    reg = PathRegistry(str(tmp_path / "bad.json"))
    (tmp_path / "bad.json").write_text("{")
    assert reg.load() == {}
    reg.save("a", "/a")
    assert reg.load() == {"a": "/a"}
    assert safe_cwd("/") is None and safe_cwd(str(tmp_path)) == str(tmp_path.resolve())


def test_events(spark, tmp_path):
    rows = [("/r/a.py", False), ("/r/.git/x", False), ("/r/d", True), ("/r/__pycache__/a", False), ("/store2/x", False)]
    df = spark.createDataFrame(rows, "path string, is_directory boolean")
    assert [r.path for r in df.where(W.wanted_event(F.col("path"), F.col("is_directory"), ("/store",))).collect()] == ["/r/a.py"]
    log, runs = tmp_path / "log", []
    log.mkdir()
    q = W.start_watch(spark, str(log), lambda: runs.append(1), str(tmp_path / "cp"), quiet=0.5)
    try:
        tmp = tmp_path / "e.json"
        tmp.write_text("\n".join('{"ts":"2026-01-01T00:00:00","path":"/r/a%d.py","is_directory":false}' % i for i in range(8)))
        tmp.rename(log / "e1.json")
        end = time.time() + 40
        while not runs and time.time() < end:
            time.sleep(0.2)
        q.query.processAllAvailable()
        assert len(runs) == 1
        tmp.write_text('{"ts":"2026-01-01T00:00:00","path":"/r/.git/a","is_directory":false}')
        tmp.rename(log / "e2.json")
        q.query.processAllAvailable()
        time.sleep(0.7)
        assert len(runs) == 1
    finally:
        q.stop()


def test_walk_keeps_private_and_hidden_files(spark, tmp_path):
    from kestrel.operators import files as FL
    from kestrel.plans.index import index_repo

    kept = ["pkg/__init__.py", "pkg/_util.py", "pkg/a.py", "_internal/b.py", ".github/c.py", "__tests__/d.js", "top.py", ".hidden.py"]
    for p in [*kept, "node_modules/x.js", "pkg/__pycache__/y.py", "z.egg-info/z.py", ".env", "a.lock"]:
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text("x = 1\r\n")
    (tmp_path / "repo/big.py").write_text("x" * 1_000_001)
    (tmp_path / "repo/latin.py").write_bytes(b"\xe9")
    got = {r.path: r.text for r in FL.read_tree(spark, str(tmp_path / "repo")).collect()}
    assert got == {p: "x = 1\n" for p in kept}
    through_driver = FL.read_files(spark, str(tmp_path / "repo"), FL.walk_files(str(tmp_path / "repo")), shared=False)
    assert {r.path: r.text for r in through_driver.collect()} == got
    (tmp_path / "only").mkdir()
    (tmp_path / "only/__init__.py").write_text("def f():\n    return 1\n")
    assert index_repo(spark, str(tmp_path / "only"), "only", store=str(tmp_path / "store")) > 0


def test_steps_before_a_search():
    from kestrel.plans.service import next_step

    yes, no, cwd, none = lambda: True, lambda: False, lambda: "/here", lambda: None
    rows = [
        ((None, "/p", True, "/p", no, none), ("serve", None)), ((None, None, False, None, yes, cwd), ("adopt", None)), ((None, None, False, None, no, cwd), ("index", "/here")),
        ((None, None, False, None, no, none), ("refuse", None)), ((None, "/p", False, None, yes, cwd), ("index", "/p")), (("/q", "/p", True, "/p", yes, cwd), ("index", "/q")),
        (("/p", "/p", True, "/p", yes, cwd), ("serve", "/p")), (("/p", None, True, None, yes, cwd), ("index", "/p")),
    ]
    for facts, want in rows:
        assert next_step(*facts) == want


def test_indexing_one_repository_does_not_hold_another(spark, tmp_path):
    import threading

    began, go_on = threading.Event(), threading.Event()

    def slow(spark, root, repo, store):
        if repo == "slow":
            began.set()
            assert go_on.wait(30)

    s = Service(spark, str(tmp_path), index=slow, watch=lambda repo, root: 1 / 0, cwd="/")
    t = threading.Thread(target=s.prepare, args=("slow", "/a"))
    t.start()
    assert began.wait(30) and s.prepare("quick", "/b") is None
    go_on.set()
    t.join()
    assert s.state("slow").served and s.state("slow").watcher is None


def test_counts_and_blank_files(spark, tmp_path):
    from kestrel.plans.index import update_index

    root, store = tmp_path / "r", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    (root / "blank.py").write_text("\n\n")
    run = lambda: update_index(spark, str(root), "r", store=store)
    assert tuple(run()) == (1, 0, 1) and tuple(run()) == (1, 1, 0)
    (root / "b.py").write_text("def g():\n    return 2\n")
    assert tuple(run()) == (2, 1, 1)
    before = {r.path: r.row_id for r in VersionedTable(spark, store, "r").read(2).collect()}
    now = {r.path: r.row_id for r in VersionedTable(spark, store, "r").read().collect()}
    assert now["a.py"] == before["a.py"] < now["b.py"]


def test_definitions_of_a_file_with_an_error_stay():
    got = chunk_text("a.js", "function one() {\n  return 1;\n}\n\nconst x = = 2;\n\nfunction two() {\n  return 2;\n}\n")
    assert [(c[0], c[1], c[2], c[3]) for c in got] == [("function_declaration", "one", 1, 3), ("function_declaration", "two", 7, 9)]


def test_stored_postings_give_the_scores_of_the_whole_corpus(spark, tmp_path):
    from kestrel.operators import retrieval as R
    from kestrel.plans.service import Retriever

    root, store = tmp_path / "r", str(tmp_path / "store")
    root.mkdir()
    for i in range(30):
        (root / f"f{i:02}.py").write_text(f"def load_{'tree' if i % 7 == 0 else 'row'}_{i}(x):\n    return walk(x, {i}) + load(x)\n")
    index_repo(spark, str(root), "r", store=store)
    r = Retriever(spark, "r", store)
    q = spark.createDataFrame([(0, "load the tree tree")], "qid int, query string")
    want = [(x.row_id, x.score, x.rank) for x in R.bm25_top(q, R.counted(r.corpus), 12).orderBy("rank").collect()]
    assert [(x.row_id, x.score, x.rank) for x in r.lexical("load the tree tree", 12).orderBy("rank").collect()] == want
    assert "EqualTo(tok,load)" in r.lexical("load", 5)._jdf.queryExecution().toString()  # only the token's row groups are read
    assert [(x.score, x.rank) for x in r.lexical("???", 3).orderBy("rank").collect()] == [(0.0, 0), (0.0, 1), (0.0, 2)]


def test_bursts_are_put_off_until_they_end():
    runs = []
    d = W.Debounce(lambda: runs.append(time.monotonic()), 0.4)
    try:
        for _ in range(8):  # longer than the quiet time in all
            d()
            time.sleep(0.1)
        last = time.monotonic()
        assert runs == []
        time.sleep(0.8)
        assert len(runs) == 1 and runs[0] > last
        d()
        time.sleep(0.8)
        assert len(runs) == 2
    finally:
        d.stop()
    d()
    time.sleep(0.6)
    assert len(runs) == 2


def test_file_events(spark, tmp_path):
    import json

    root, log = tmp_path / "r", tmp_path / "log"
    (root / ".git").mkdir(parents=True)
    (root / "a.py").write_text("1")
    (root / "b.py").write_text("1")
    e = W.FileEvents(str(root), str(log), ignore=(str(root / "store"),))
    assert e.look() == []
    (root / "a.py").write_text("22")
    (root / "b.py").unlink()
    (root / "c.py").write_text("")
    (root / ".git/x").write_text("")
    (root / "store").mkdir()
    (root / "store/y").write_text("")
    assert e.look() == [str(root / n) for n in ("a.py", "b.py", "c.py")] and e.look() == []
    files = [f for f in log.iterdir()]
    assert len(files) == 1 and [json.loads(x)["path"] for x in files[0].read_text().splitlines()] == [str(root / n) for n in ("a.py", "b.py", "c.py")]


def test_a_watched_tree_is_indexed_again(spark, tmp_path):
    root, runs = tmp_path / "r", []
    root.mkdir()
    w = W.start_watch(spark, str(tmp_path / "log"), lambda: runs.append(1), str(tmp_path / "cp"), quiet=0.3, root=str(root))
    try:
        (root / "a.py").write_text("x = 1")
        end = time.time() + 40
        while not runs and time.time() < end:
            time.sleep(0.1)
        assert runs == [1]
    finally:
        w.stop()
