"""Generated, minified, vendored and data files among source files.

Linear support vectors over hashed character n-grams of the whole text, the
words and word pairs of the header comment, path components and a few shape
figures.  Patterns of giveaway headers and paths only label a bounded sample of
files weakly: none of them is a feature.  In a second copy of each training row
the giveaway lines of the header and the path are masked, for all classes, so
the weights do not rest on them alone.  Scores are calibrated on repositories
the model has not seen; ``Model.report`` holds the accuracy there and the
recall with giveaways masked.

Defined results: null and empty texts count as written by hand; files whose
language is ``text``, null or unknown are not judged; repeated rows count once;
without labelled files of both classes the weak labels decide; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.linear import Dense, balanced, bucket, platt, support_vectors
from kestrel.functions.sampling import smallest_hashes
from kestrel.session import spread, text_batches
from kestrel.syntax import LANGUAGES

#: Files the model is fitted on, at most; the first by a hash of their id.
SAMPLE = 4_000
THRESHOLD = 0.35
GRAM = 4
GRAM_BITS, WORD_BITS = 12, 12
_DENSE = 16
WIDTH = _DENSE + (1 << GRAM_BITS) + (1 << WORD_BITS)

#: Header lines that give a file away; only the comments at its top are looked at.  They make labels, not features.
_GENERATED = re.compile(
    r"(?i)generated (?:by|with|from|using)\b|code generated|auto-?\s?generated|machine.generated|@generated|do not (?:edit|modify)|auto-?\s?created by|\bregenerate\b"
    r"|changes will be (?:lost|overwritten)|compiled (?:by|from|with)"
)
_FOREIGN = re.compile(r"(?i)(?:\(c\)|©|copyright)[^\n]{0,12}\d{4}|@license|@preserve")
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|__generated__|autogen)/|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|\.g(?:en(?:erated)?)?\.\w+$|_generated\.\w+$|\.generated\.\w+$|(?:^|/)migrations/\d{4}_")
_FOREIGN_PATH = re.compile(r"(?:^|/)(?:node_modules|vendor|_vendor|third[_-]?party|bower_components|external|extern|site-packages)/")
_MINIFIED_PATH = re.compile(r"[.-]min\.\w+$|\.bundle\.js$|-[0-9a-z]{8,}\.js$")
_COMMENT = re.compile(r"\s*(?:/\*|\*|//|#|\"\"\"|'''|--|<!--|@Generated)")
_WORDS = re.compile(r"[A-Za-z]+|\(c\)|@\w+|\d{4}")
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\d[\d.]*|\"[^\"\n]*\"|'[^'\n]*'")


_CLOSES = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


def header_of(text: str) -> str:
    """The comment lines at the top: the leading comment block to its end, and those up to 25 lines in, with blank lines and declarations between."""
    out = []
    lead, close = True, ""  # still in the leading block; what ends the comment that is open
    for k, line in enumerate(text.split("\n")):
        bare = line.strip()
        if lead and close:
            out.append(bare)
            close = "" if close in bare else close
            continue
        comment = _COMMENT.match(line)
        if lead and bare and not comment:
            lead = False
        if k >= 25 and not lead:
            break
        if comment:
            out.append(bare)
            opener = next((o for o in _CLOSES if bare.startswith(o)), "")
            if lead and opener and _CLOSES[opener] not in bare[len(opener) :]:
                close = _CLOSES[opener]
        elif bare and out and k > 12:
            break
    return "\n".join(out)


def shape_of(text: str) -> list[float]:
    """A few figures about the whole text."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(b))
    lines = text.split("\n")
    lens = [len(x) for x in lines]
    full = [x for x in lines if x.strip()]
    shapes = {re.sub(r"(?:i *, *)+i", "i", _SHAPE.sub("i", x)).strip() for x in full}
    digits = float(((b >= 48) & (b <= 57)).sum()) / n
    blank = float(((b == 32) | (b == 9) | (b == 10)).sum()) / n
    letters = float((((b | 32) >= 97) & ((b | 32) <= 122)).sum()) / n
    longest = max(lens)
    return [
        np.log1p(longest) / 8, np.log1p(n / len(lines)) / 6, float(longest > 500), float(longest > 500 and longest > 0.3 * n), digits * 4, float(digits > 0.15), float(digits > 0.3), blank * 3,
        letters, 1 - letters - blank - digits, min(1.0, len(shapes) / max(1, len(full))), float(len(full) > 8 and len(shapes) < 0.3 * len(full)), text.count(";") / n * 20, text.count(",") / n * 10,
        np.log1p(n) / 12, 1.0,
    ]


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the whole text: places and normalised weights."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(b) < GRAM:
        return np.empty(0, np.int64), np.empty(0)
    low = b.astype(np.uint32)
    low[(b >= 48) & (b <= 57)] = 48  # digits alike
    h = low[: len(b) - GRAM + 1] * np.uint32(0x9E3779B1)
    for k in range(1, GRAM):
        h = (h ^ low[k : len(b) - GRAM + 1 + k]) * np.uint32(0x85EBCA6B)
    n = np.bincount((h >> np.uint32(32 - GRAM_BITS)).astype(np.int64), minlength=1 << GRAM_BITS)
    at = np.flatnonzero(n)
    v = np.sqrt(n[at])
    return at, v / np.linalg.norm(v)


_HASH = re.compile(r"(?=\w*\d)[0-9a-z]{8,}")
_NUMBERS = re.compile(r"\d+")


def names_of(header: str, path: str) -> list[str]:
    """Names of header and path features: words, word pairs, path components, the parts of the file's name."""
    words = ["9" if w.isdigit() else w.lower() for w in _WORDS.findall(header)]
    f = {"h:" + w for w in words if len(w) > 1} | {f"p:{a} {b}" for a, b in zip(words, words[1:])}
    if path:
        *folders, name = path.lower().split("/")
        f |= {"d:" + _NUMBERS.sub("9", p) for p in folders[1:]}
        stem, *ends = _HASH.sub("H", name).split(".")
        f |= {"e:" + ".".join(_NUMBERS.sub("9", x) for x in ends)} | {"s:" + _NUMBERS.sub("9", x) for x in re.split(r"[_\-]", stem)[-2:]}
        own = re.split(r"[.\-]", name)[0]
        if len(own) > 3 and own in header.lower():
            f.add("named")
    return sorted(f)


def masked(header: str) -> str:
    """A header without the lines that give the file away."""
    return "\n".join(x for x in header.split("\n") if not (_GENERATED.search(x) or _FOREIGN.search(x)))


def weak_label(text: str, header: str, path: str) -> tuple[int, str]:
    """(1 not written by hand, 0 written by hand; why)."""
    if _FOREIGN_PATH.search(path) or _FOREIGN.search(header):
        return 1, "foreign"
    if _GENERATED_PATH.search(path) or _GENERATED.search(header):
        return 1, "generated"
    s = shape_of(text)
    if s[7] < 0.24 and (_MINIFIED_PATH.search(path) or s[1] > 0.84):  # hardly a blank, lines of 150 characters and more on average
        return 1, "minified"
    if s[6]:
        return 1, "data"
    return 0, ""


#: What one header word and one path component weigh beside all n-grams of a text, which weigh 1 together.
WORD_WEIGHT, PATH_WEIGHT = 0.5, 1.5
#: Header words and path components count if files of so many repositories of the sample have them.
NAME_REPOS = 4


def features(text: str, header: str, path: str, known: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """``known``: the names that count."""
    at, v = grams_of(text)
    f = min(1.0, (len(text) / 400) ** 0.5)  # a short text's figures say less
    names = [x for x in names_of(header, path) if x in known]
    cols = [np.arange(_DENSE), _DENSE + at, np.array([_DENSE + (1 << GRAM_BITS) + bucket(x, WORD_BITS) for x in names], dtype=np.int64)]
    vals = [f * np.array(shape_of(text)), f * v, np.array([WORD_WEIGHT if x[:2] in ("h:", "p:") else PATH_WEIGHT for x in names])]
    return np.concatenate(cols), np.concatenate(vals)


def blind_features(text: str, header: str, known: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """The same with giveaway header lines and the whole path masked."""
    rest = masked(header)
    return features(text.replace(header, rest, 1) if header else text, rest, "", known)


#: Weight of a training row's masked copy.
MASKED_WEIGHT = 0.15


class Model:
    def __init__(self, rows: list[tuple[str, str, str]]):
        """rows: repo, path, text."""
        data = [(r, p, t, header_of(t)) for r, p, t in rows]
        labels = [weak_label(t, h, p) for _, p, t, h in data]
        y = np.array([a for a, _ in labels], float)
        self.fitted = len(rows) > 20 and 0 < y.sum() < len(y)
        self.report: dict[str, float] = {}
        if not self.fitted:
            return
        held = np.array([bucket("repo:" + (r or ""), 16) % 5 == 0 for r, *_ in data])
        if held.all() or not held.any() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            held = np.arange(len(rows)) % 5 == 0
        n = len(data)
        repos: dict[str, set] = {}
        for k, (r, p, _, h) in enumerate(data):
            if not held[k]:
                for name in names_of(h, p):
                    repos.setdefault(name, set()).add(r)
        self.known = frozenset(name for name, where in repos.items() if len(where) >= NAME_REPOS)
        x = Dense(2 * n, WIDTH)
        for i, (_, path, text, head) in enumerate(data):
            x.put(i, *features(text, head, path, self.known))
            x.put(n + i, *blind_features(text, head, self.known))
        weight = np.zeros(2 * n)  # held-out rows have none
        weight[:n][~held] = balanced(y[~held])
        weight[n:] = MASKED_WEIGHT * weight[:n]
        self.w, self.b = support_vectors(x, np.concatenate([y, y]), weight, l2=1e-4, steps=200)
        z = x.dot(self.w) + self.b
        self.slope, self.offset = platt(z[:n][held], y[held])
        hit = self.slope * z + self.offset >= math.log(THRESHOLD / (1 - THRESHOLD))
        self.report = {"held_out": float(held.sum()), "accuracy": float((hit[:n][held] == (y[held] > 0)).mean())}
        for why in ("foreign", "generated", "minified", "data"):
            mine = held & np.array([w == why for _, w in labels])
            if mine.any():
                self.report[f"recall {why}"], self.report[f"masked recall {why}"] = float(hit[:n][mine].mean()), float(hit[n:][mine].mean())

    def score(self, text: str | None, path: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        h, path = header_of(text), path or ""
        if not self.fitted:
            return float(weak_label(text, h, path)[0])
        cols, vals = features(text, h, path, self.known)
        z = float(np.dot(self.w[cols], vals)) + self.b
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def fit(files: DataFrame, sample: int = SAMPLE) -> Model:
    few = smallest_hashes(files.select("repo", "path", "text", "file_id").where("text is not null and path is not null"), "file_id", sample)
    once = {r.file_id: (r.repo, r.path, r.text) for r in few.toLocalIterator()}
    return Model([once[i] for i in sorted(once)])


def _judge(batches, model):
    m: Model = model.value
    for b in batches:
        p = [m.score(t, q) for t, q in zip(b.column("text").to_pylist(), b.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo"), b.column("language"), pa.array(p, pa.float64())], names=["file_id", "repo", "language", "score"])


def scored(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file_id, repo, language, score) of every file in a known language."""
    spark = files.sparkSession
    text_batches(spark)
    f = files.select("file_id", "repo", "path", "language", "text").where(F.col("language").isin(*LANGUAGES))
    model = spark.sparkContext.broadcast(fit(f, sample))
    return spread(f).mapInArrow(partial(_judge, model=model), "file_id bigint, repo string, language string, score double")


def not_by_hand(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored(files).where(F.col("score") >= threshold).select("file_id").distinct()


def rates(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per repository and language: files, and files not written by hand."""
    one = scored(files).groupBy("file_id").agg(
        F.first("repo").alias("repo"), F.first("language").alias("language"), F.max((F.col("score") >= threshold).cast("int")).alias("bad")
    )
    return one.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum("bad").alias("n_not_by_hand"), F.round(F.avg("bad"), 6).alias("rate"))
