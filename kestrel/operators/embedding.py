"""Model slots: batching, retries, a deterministic embedder, reranker protocol and factories."""

from __future__ import annotations

import hashlib
import math
import os
import random
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kestrel.functions.tokens import tokenize

#: What one call of the remote model may hold.
MAX_INPUTS, MAX_TOKENS = 128, 80_000
RETRIES = 6


class Embedder(Protocol):
    dim: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        """(index, score in [0, 1]) best first."""
        ...


def estimate(text: str) -> int:
    return max(1, len(text) // 3)


def greedy_batches(texts: Iterable[str], max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> Iterator[list[str]]:
    """Consecutive texts up to both limits; a text beyond the limit goes alone; no batch is empty."""
    held: list[str] = []
    used = 0
    for t in texts:
        need = estimate(t)
        if held and (len(held) == max_inputs or used + need > max_tokens):
            yield held
            held, used = [], 0
        held.append(t)
        used += need
    if held:
        yield held


class RateLimited(Exception):
    """Raised by an embedder whose service asks to wait."""


def with_retry(call: Callable[[list[str]], list[list[float]]], texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Repeat on RateLimited only, doubling the pause."""
    for n in range(RETRIES):
        try:
            return call(texts)
        except RateLimited:
            if n == RETRIES - 1:
                raise
            sleep(2 * 2**n + random.random())
    raise AssertionError


class HashedEmbedder:
    """Feature hashing of code tokens into dim signed buckets, L2-normalised; no model, the same everywhere."""

    model_name = "hashed-tokens"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_query(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for t in tokenize(text):
            h = hashlib.md5(t.encode()).hexdigest()
            v[(int(h[0], 16) * 4 + int(h[1], 16) // 4) % self.dim] += 1.0 if int(h[2], 16) < 8 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


class CoverageReranker:
    """Share of the query's distinct tokens that a document holds."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        q = set(tokenize(query))
        s = [(i, len(q & set(tokenize(d))) / len(q) if q else 0.0) for i, d in enumerate(documents)]
        return sorted(s, key=lambda x: (-x[1], x[0]))


# -- models behind a service or in a file ---------------------------------
Send = Callable[[str, dict, dict], dict]


def post_json(url: str, body: dict, headers: dict) -> dict:
    """One request; a service that asks to wait (429) raises RateLimited."""
    import json
    import urllib.error
    import urllib.request

    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(ask, timeout=120) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise RateLimited from e
        raise


class _Service:
    """What clients of a model service share: address, model, key (read when a request is made, so it is never shipped), and how to send."""

    def __init__(self, url: str, model: str, key_variable: str = "KESTREL_MODEL_KEY", send: Send = post_json):
        self.url, self.model, self.key_variable, self.send = url, model, key_variable, send

    def ask(self, body: dict) -> dict:
        key = os.environ.get(self.key_variable)
        return self.send(self.url, {"model": self.model, **body}, {"Authorization": f"Bearer {key}"} if key else {})


class RemoteEmbedder(_Service):
    """Vectors from a service; documents and queries are told apart by their role, answers are put in order by their index."""

    def __init__(self, url: str, model: str, dim: int = 1024, **kw):
        super().__init__(url, model, **kw)
        self.dim = dim

    def _vectors(self, texts: list[str], role: str) -> list[list[float]]:
        rows = sorted(self.ask({"input": texts, "input_type": role, "output_dimension": self.dim})["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError(f"{len(texts)} texts sent, {len(rows)} vectors received")
        return [r["embedding"] for r in rows]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._vectors(texts, "document")

    def embed_query(self, text: str) -> list[float]:
        return with_retry(lambda t: self._vectors(t, "query"), [text])[0]


class RemoteReranker(_Service):
    """Scores from a service, best first; no documents, no request."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        if not documents:
            return []
        got = with_retry(lambda docs: self.ask({"query": query, "documents": docs})["data"], documents)
        return sorted(((r["index"], float(r["relevance_score"])) for r in got), key=lambda x: (-x[1], x[0]))


class _LocalModel:
    """A model file run by onnxruntime with a tokenizer file, both loaded in each worker on first use."""

    def __init__(self, model_path: str, tokenizer_path: str, max_tokens: int = 512, load: Callable | None = None):
        self.model_path, self.tokenizer_path, self.max_tokens, self.load = model_path, tokenizer_path, max_tokens, load
        self._run = None

    def __getstate__(self):
        return self.__dict__ | {"_run": None}

    def run(self, texts: list) -> np.ndarray:
        """The first output for a batch of texts or text pairs."""
        if self._run is None:
            self._run = (self.load or _onnx)(self.model_path, self.tokenizer_path, self.max_tokens)
        return self._run(texts)


def _onnx(model_path: str, tokenizer_path: str, max_tokens: int) -> Callable:
    import onnxruntime
    from tokenizers import Tokenizer

    session = onnxruntime.InferenceSession(model_path)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    wanted = {i.name for i in session.get_inputs()}

    def run(texts):
        encoded = tokenizer.encode_batch(texts)
        fields = {"input_ids": "ids", "attention_mask": "attention_mask", "token_type_ids": "type_ids"}
        feed = {n: np.array([getattr(e, f) for e in encoded], dtype=np.int64) for n, f in fields.items() if n in wanted}
        out = session.run(None, feed)[0]
        if out.ndim == 3:  # one vector per token: their mean, padding left out
            mask = np.array([e.attention_mask for e in encoded], dtype=np.float32)[:, :, None]
            out = (out * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        return out

    return run


class LocalEmbedder(_LocalModel):
    """Unit vectors from a model file; queries get a prompt in front, $KESTREL_EMBED_BATCH texts (16) go through at a time."""

    def __init__(self, model_path: str, tokenizer_path: str, dim: int, model_name: str | None = None, query_prompt: str = "", **kw):
        super().__init__(model_path, tokenizer_path, **kw)
        self.dim, self.query_prompt, self.model_name = dim, query_prompt, model_name or os.path.basename(model_path)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        step = int(os.environ.get("KESTREL_EMBED_BATCH", "16"))
        out: list[list[float]] = []
        for k in range(0, len(texts), step):
            v = np.asarray(self.run(texts[k : k + step]), dtype=np.float64)
            out += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
        return out

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([self.query_prompt + text])[0]


class CrossEncoder(_LocalModel):
    """A reranker that reads query and document together; the sigmoid of its output is the score."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        if not documents:
            return []
        logits = np.asarray(self.run([(query, d) for d in documents]), dtype=np.float64).reshape(len(documents), -1)[:, 0]
        score = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
        return [(int(i), float(score[i])) for i in np.argsort(-score, kind="stable")]


def _setting(name: str) -> str:
    value = os.environ.get(name)
    if not value:
        raise LookupError(f"set {name}")
    return value


#: Named implementations; register a model's class here to make it selectable.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {
    "hashed": HashedEmbedder,
    "remote": lambda: RemoteEmbedder(_setting("KESTREL_EMBED_URL"), _setting("KESTREL_EMBED_MODEL"), int(os.environ.get("KESTREL_EMBED_DIM", "1024"))),
    "local": lambda: LocalEmbedder(_setting("KESTREL_EMBED_FILE"), _setting("KESTREL_EMBED_TOKENIZER"), int(_setting("KESTREL_EMBED_DIM"))),
}
RERANKERS: dict[str, Callable[[], Reranker | None]] = {
    "coverage": CoverageReranker,
    "none": lambda: None,
    "remote": lambda: RemoteReranker(_setting("KESTREL_RERANK_URL"), _setting("KESTREL_RERANK_MODEL")),
    "local": lambda: CrossEncoder(_setting("KESTREL_RERANK_FILE"), _setting("KESTREL_RERANK_TOKENIZER")),
}


def _made(kind: str, known: dict, name: str):
    if name not in known:
        raise LookupError(f"no {kind} is called {name!r}; there are {', '.join(sorted(known))}")
    return known[name]()


def make_embedder(name: str | None = None) -> Embedder:
    return _made("embedder", EMBEDDERS, name or os.environ.get("KESTREL_EMBEDDER") or "hashed")


def make_reranker(name: str | None = None) -> Reranker | None:
    return _made("reranker", RERANKERS, name or os.environ.get("KESTREL_RERANKER") or "coverage")


def embed_column(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector") -> DataFrame:
    """df with a vector per row; each Python worker forms its own batches as a stream."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType(), False))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[list[float]] = []
            for batch in greedy_batches(pdf[text].tolist()):
                vectors += with_retry(embedder.embed_documents, batch)
            pdf[out] = vectors
            yield pdf

    return df.mapInPandas(run, schema)


def batch_numbers(df: DataFrame, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(grp, id, tokens, batch_no): greedy batches in id order within each group (a file's chunks, say), groups in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        n, held, used, out = 0, 0, 0, []
        for need in pdf["tokens"]:
            if held and (held == max_inputs or used + need > max_tokens):
                n, held, used = n + 1, 0, 0
            held += 1
            used += need
            out.append(n)
        return pdf.assign(batch_no=out)

    return df.groupBy("grp").applyInPandas(run, "grp string, id bigint, tokens int, batch_no int")
