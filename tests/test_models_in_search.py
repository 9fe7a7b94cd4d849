import pytest

from kestrel.operators import embedding
from kestrel.plans.index import index_repo
from kestrel.plans.service import Retriever


class ByLength:
    """Puts a text on a circle by its length; the query looks for the longest."""

    model_name, dim = "by-length", 2

    def embed_documents(self, texts):
        return [[float(len(t)), 1000.0] for t in texts]

    def embed_query(self, text):
        return [1.0, 0.0]


class Backwards:
    def rerank(self, query, documents):
        assert query == "alpha"
        return [(i, 1.0 if "zebra" in d else 0.01) for i, d in enumerate(documents)]


def test_search_uses_the_embedder_and_the_reranker(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    root.mkdir()
    for i in range(60):
        (root / f"f{i:02}.py").write_text(f"def fn{i}():\n    return {'1 + ' * i}1\n")
    (root / "z.py").write_text("def zebra():\n    return 'zebra'\n")
    index_repo(spark, str(root), "r", ByLength(), store)
    r = Retriever(spark, "r", store, embedder=ByLength(), rerank=False)
    paths = [h.path for h in r.search("qqq", candidates=3, graph=False).collect()]
    assert {"f59.py", "f58.py", "f57.py"} <= set(paths)  # the longest, by the stored vectors
    got = Retriever(spark, "r", store, embedder=ByLength(), reranker=Backwards()).search("alpha", candidates=61, pool=61, graph=False).collect()
    assert got[0].path == "z.py" and round(got[0].relevance, 2) == 1.0
    with pytest.raises(ValueError, match="another embedder"):
        Retriever(spark, "r", store)


def test_default_models_stay(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def load_tree():\n    return walk_files\n")
    (root / "b.py").write_text("def other():\n    return 1\n")
    index_repo(spark, str(root), "r", None, store)
    assert Retriever(spark, "r", store, reranker=embedding.CoverageReranker()).search("load the tree").first().path == "a.py"


def test_clients_of_model_services(monkeypatch):
    import pickle

    asked = []

    def send(url, body, headers):
        asked.append((url, body, headers))
        if len(asked) == 1:
            raise embedding.RateLimited
        if "documents" in body:
            return {"data": [{"index": i, "relevance_score": 0.1 * len(d)} for i, d in enumerate(body["documents"])]}
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}

    monkeypatch.setenv("KESTREL_MODEL_KEY", "k")
    monkeypatch.setattr(embedding.time, "sleep", lambda s: None)
    e = embedding.RemoteEmbedder("http://m/embed", "code-2", 2, send=send)
    assert e.embed_query("abc") == [3.0, 1.0] and asked[-1][1]["input_type"] == "query" and asked[-1][2] == {"Authorization": "Bearer k"}
    assert e.embed_documents(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]] and asked[-1][1]["input_type"] == "document"
    r = embedding.RemoteReranker("http://m/rerank", "lite", send=send)
    assert r.rerank("q", ["a", "ccc", "bb"]) == [(1, pytest.approx(0.3)), (2, pytest.approx(0.2)), (0, pytest.approx(0.1))] and r.rerank("q", []) == []
    assert b"Bearer" not in pickle.dumps((e.url, e.model, e.key_variable))


def test_local_models(monkeypatch):
    import numpy as np

    loaded = []

    def load(model, tokenizer, most):
        loaded.append((model, tokenizer, most))
        return lambda texts: np.array([[len(t), 0.0] if isinstance(t, str) else [len(t[1]) - 2.0] for t in texts])

    monkeypatch.setenv("KESTREL_EMBED_BATCH", "2")
    e = embedding.LocalEmbedder("m.onnx", "t.json", 2, query_prompt="query: ", load=load)
    assert e.embed_documents(["abc", "d", "ef"]) == [[1.0, 0.0]] * 3 and e.embed_query("x") == [1.0, 0.0] and len(loaded) == 1 and e.model_name == "m.onnx"
    c = embedding.CrossEncoder("m", "t", load=load)
    got = c.rerank("q", ["a", "abcd", "ab"])
    assert [i for i, _ in got] == [1, 2, 0] and got[1][1] == 0.5 and c.rerank("q", []) == []


def test_unknown_models_are_an_error(monkeypatch):
    with pytest.raises(LookupError, match="no embedder"):
        embedding.make_embedder("nope")
    monkeypatch.setenv("KESTREL_RERANKER", "nope")
    with pytest.raises(LookupError, match="no reranker"):
        embedding.make_reranker()
    monkeypatch.setenv("KESTREL_RERANKER", "none")
    assert embedding.make_reranker() is None


def test_evaluation_of_searches(spark, tmp_path):
    import json

    from kestrel.plans.service import evaluate

    root, store = tmp_path / "r", str(tmp_path / "store")
    root.mkdir()
    (root / "tree.py").write_text("def load_tree():\n    return 1\n")
    (root / "row.py").write_text("def other_row():\n    return 1\n")
    index_repo(spark, str(root), "r", store=store)
    (tmp_path / "cases.json").write_text(json.dumps([{"repo": "r", "query": "load the tree", "expect": ["tree.py"]}, {"repo": "r", "query": "other", "expect": ["row.py", "none.py"]}]))
    out = evaluate(spark, str(tmp_path / "cases.json"), 1, store).splitlines()
    assert out == ["r: load the tree: recall 1.00, missing nothing", "r: other: recall 0.50, missing none.py", "r: 2 cases, recall@1 0.750, hit@1 1.000", "all: 2 cases, recall@1 0.750, hit@1 1.000"]
