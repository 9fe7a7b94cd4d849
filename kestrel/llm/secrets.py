"""Credentials embedded in source and configuration text: found, scored, redacted.

1. *Candidates.*  One pattern per way a value is written (private key blocks,
   URLs with a password, query parameters, authorization headers, quoted
   literals and runs of literals, unquoted configuration values, these also in
   comments and multi-line literals of code).  A literal is a candidate if it
   has eight characters, one of them a digit, and no blank, or if its name
   speaks of a secret; under a password's name also with four characters and
   with blanks.  There is no upper bound on lengths.
2. *Weak labels.*  Matches of known formats and telling names label some
   candidates as credentials; placeholders, references, checksums, ids and
   public keys label others as none; the rest stays unlabelled.
3. *Model.*  Logistic regression on the likelihood of the value under a
   character Markov chain of ordinary words, its composition and its words, the
   words of the surrounding identifier and context, and the path; fitted on all
   labelled candidates, whatever their number and length, calibrated on
   repositories it has not seen.  Features stay in the cluster, which adds up
   the gradient of each step.  No pattern that makes labels is a feature,
   words count if several repositories have them, and names are masked in a
   second copy of the training rows.  The labels are not looked at when
   candidates are scored; ``statistics`` counts what was found among those
   without a label.
4. *Redaction.*  Values scored at THRESHOLD or more are replaced between their
   quotes, literal by literal, so the text still parses.

Defined results: null and empty texts hold nothing; repeated rows count once;
several credentials on a line are one (file_id, line_no); with no labelled
candidate of one class the weak labels alone decide; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.linear import adam, bucket, newton
from kestrel.session import by_bytes, each_once, materialized, release, spread, text_batches

#: Labelled candidates whose features are one row of a table, and those that a task sums up in a step, about; what one task sums up it holds.
BLOCK_ROWS, TASK_ROWS = 400, 50_000
THRESHOLD = 0.5
NAME_BITS = 11

_Q = "\"'`"
#: Each pattern begins with characters that are rare, so a pass over a text is little more than a search for them.
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: what a key's body may hold where its end line is missing
_BODY = re.compile(r"(?:[\s\"'`+,\\(){};]|[A-Za-z0-9/=]{4,}|[A-Z][\w-]*: [^\n]*)*")
_URL = re.compile(rf"://([^\s{_Q}/@:<>]*):([^\s{_Q}/@<>]{{3,}})@")
_SCHEME = re.compile(r"[A-Za-z][\w+.\-]*$")
_AUTH = re.compile(r"(?:[Bb]asic|[Bb]earer|BEARER)[ \t]+([A-Za-z0-9+/=._~\-]{16,})")
_QUERY = re.compile(rf"[?&]([\w.\-]{{2,}})=([^\s{_Q}&<>#]{{8,}})")
_SECRET_QUERY = re.compile(r"(?i)key|token|secret|sig|passw|pwd|auth|cred")
#: Every literal is matched, so that a closing quote never opens one.
_LITERAL = re.compile(r"\"([^\"\\\n]*(?:\\.[^\"\\\n]*)*)\"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|`([^`\s]*)`")
_DIGIT = re.compile(r"\d")
_BARE = re.compile(rf"^(?P<lead>[ \t]*(?:(?:#|//|;|--|\*)+[ \t]*)?)(?:export[ \t]+|set[ \t]+|-[ \t]+)?(?P<name>[\w.\-]+)[ \t]*[:=][ \t]*(?P<val>[^\s{_Q},;]{{4,}})[ \t]*[,;]?[ \t]*\r?$", re.M)
#: the same in code: only in comments; what stands elsewhere unquoted is a name or an expression
_COMMENTED = re.compile(_BARE.pattern.replace("[ \\t]*)?)(?:export", "[ \\t]*))(?:export", 1), re.M)
#: what any telling name holds
_TELLING = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|signing|hmac|bearer|jwt|private")
#: Literals over several lines.
_BLOCK = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|`[^`]*`")
#: what joins two literals of one value
_JOIN = re.compile(r"[\"'`][ \t]*(?:\+|\.\.?|&|<>|\|\||,)?[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.?|&)?[ \t]*[bru]?[\"'`](?P<more>[^\s\"'`]{2,})(?=[\"'`])")
_OPERATOR = re.compile(r"[+.&\\]|\n|<>|\|\||^[\"'`][ \t]*[\"'`]")
_NAME = (
    re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'`\]]?[ \t]*:[ \t]*[&*\w<>\[\]' ]+?[ \t]*=[ \t]*\(?[ \t]*(?:[rbuf]|String\()?$"),
    re.compile(r"([A-Za-z_$][\w$.\-]*)[\"'`\]]?[ \t]*(?::=|=>|==|=|:|\()[ \t]*\(?[ \t]*(?:[rbuf])?$"),
)
_WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+")

#: Formats of issued credentials, by their public prefixes.
ISSUED = re.compile(
    r"^(?:(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abposr]-[\w\-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w\-]{30,}|ya29\.[\w\-]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{30,}"
    r"|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{60,}|shpat_[0-9a-fA-F]{32}|key-[0-9a-f]{32})$"
)
SECRET_WORDS = frozenset("password passwd pwd pass passphrase secret token apikey auth credential credentials signing hmac bearer jwt private".split())
#: Last words of a password's name.
PASSWORD_WORDS = frozenset("password passwd pwd passphrase".split())
#: Words of names whose hexadecimal values are sums and ids.
OPEN_WORDS = frozenset(
    "commit checksum hash sha md5 sha1 sha256 sha512 integrity digest etag uuid guid trace icon image img version revision rev build public fingerprint "
    "label hint placeholder field prompt title description salt id nonce cursor color url uri href src path file host port addr date time css class".split()
)
_PLACEHOLDER = re.compile(
    r"(?i)example|replace[_\-]?me|change[_\-]?me|your[_\-]|(?<![a-z])my[_\-]?(?:pass|key|secret|token)|placeholder|redacted|xxxx|(?<![a-z])(?:dummy|todo|insert|sample|fake)(?![a-z])|\*\*\*|\.\.\.|<[^>]*>|\$\{|\{\{|\$\(|%\(|\{[a-z_]*\}"
    r"|^\$[A-Z_a-z]|process\.env|os\.environ|getenv|vault:|secret:|ssm:|^env[:.]|^enc\[|^ref\+|^test[_\-]|none$|null$|(.)\1{7,}|1234567|abcdef"
)
#: What the body of a private key that was left out holds.
_NO_KEY = re.compile(r"\.\.\.|[<>*$]|(?i:redacted|example|your)|(.)\1{15,}")
_OPEN_SHAPE = re.compile(
    r"^(?:sha(?:1|256|384|512)[-:]|(?:\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\\d{1,3})+|[^\\]*\\[nrt]|md5[-:]|data:|ssh-|ecdsa-|[\da-fA-F]{8}-[\da-fA-F]{4}-[\da-fA-F]{4}-[\da-fA-F]{4}-[\da-fA-F]{12}$|W/|[vV]?\d+(?:\.\d+)+|\d[\d.,:\-TZ+/ ]*$|#[\da-fA-F]{3,8}$"
    r"|[a-z]+://[^@]*$|\.{0,2}/|[\w\-]+(?:\.[\w\-]+)*\.(?:com|org|net|io|dev|test|invalid|example|internal|local)(?:[:/].*)?$|[\w\-/.]+\.(?:js|ts|py|go|rs|java|json|html|css|png|svg|md|txt|ya?ml|xml)$)"
)


def words_of(name: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name or "")]


def telling(name: str) -> int:
    """2 for the name of a password, 1 for one that speaks of a secret, else 0."""
    ws = words_of(name)
    if ws and ws[-1] in PASSWORD_WORDS:
        return 2
    return int(bool(set(ws) & SECRET_WORDS or {"api", "key"} <= set(ws) or {"access", "key"} <= set(ws)))


_IDENTIFIER = re.compile(r"[\w$.\-]")


def _name_before(text: str, at: int, telling_only: bool = False) -> str:
    """The name a value at this place is given to, on its line; it is never cut, however long."""
    line = text.rfind("\n", 0, at) + 1
    a = max(line, at - 120)
    while a > line and _IDENTIFIER.match(text[a - 1]):
        a -= 1
    if telling_only and not _TELLING.search(text, a, at):
        return ""
    head = text[a:at]
    for p in _NAME:
        if m := p.search(head):
            return m[1]
    return ""


def _wanted(value: str, name: str) -> bool:
    """Whether a value may be a credential at all."""
    if len(value) >= 8 and _DIGIT.search(value) and not re.search(r"\s", value):
        return True
    how = telling(name)
    return how == 2 and len(value) >= 4 or how == 1 and len(value) >= 8 and not re.search(r"\s", value)


def candidates_of(text: str | None, configuration: bool) -> list[tuple[int, int, int, str, str, str, str]]:
    """(line, start, end, kind, name, value, context) of everything in a text that may be a credential."""
    if not text:
        return []
    out: list[tuple] = []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            end = text.find("-----END", m.end())
            body = text[m.end() : end] if end >= 0 else _BODY.match(text, m.end())[0]
            out.append((m.end(), m.end() + len(body), "pem", _name_before(text, m.start()), re.sub(r"\\[nr]|[\s\"'`+\\,]", "", body), m.start(), m[0]))
    if "://" in text:
        for m in _URL.finditer(text):
            head = _SCHEME.search(text[max(0, m.start() - 20) : m.start()])
            at = m.start() - len(head[0]) if head else m.start()
            out.append((m.start(2), m.end(2), "url", _name_before(text, at - (at > 0 and text[at - 1] in _Q)), m[2], at, f"url {head[0] if head else ''}"))
        for m in _QUERY.finditer(text):
            if _SECRET_QUERY.search(m[1]):
                out.append((m.start(2), m.end(2), "query", m[1], m[2], m.start(2), "query"))
    for m in _AUTH.finditer(text):
        at = m.start()
        out.append((m.start(1), m.end(1), "auth", _name_before(text, at - 1) if at and text[at - 1] in _Q else "", m[1], at, m[0].split()[0]))
    special = [(a, b) for a, b, *_ in out]
    skip = 0
    for m in _LITERAL.finditer(text):
        a, b = m.start() + 1, m.end() - 1
        if a < skip or b - a < 4:
            continue
        v = m[m.lastindex]
        if special and any(x < b and a < y for x, y in special) or text[b + 1 : b + 2] == ":" or text[b + 1 : b + 3] == " :":
            continue
        end = b
        if text[b + 1 : b + 2] in (" ", "+", "\\", "\n", "\r", ".", "&", "|", "<", "\t"):
            while (j := _JOIN.match(text, end)) and _OPERATOR.search(text[end : j.start("more")]) and "," not in text[end : j.start("more")]:
                v += j["more"]
                end = j.end("more")
        name = ""
        if len(v) < 8 or not _DIGIT.search(v) or " " in v:
            if end > b or "\t" in v:
                continue
            name = _name_before(text, a - 1, True)
        if _wanted(v, name):
            out.append((a, end, "literal", name or _name_before(text, a - 1), v, a, ""))
            skip = end
        elif end > b:
            skip = end
    taken = sorted((a, b) for a, b, *_ in out)
    if configuration:
        lines = _BARE.finditer(text)
    else:
        blocks = [m.span() for m in _BLOCK.finditer(text) if "\n" in m[0]] if any(q in text for q in ('"""', "'''", "`")) else []
        lines = itertools.chain(_COMMENTED.finditer(text), *(_BARE.finditer(text, *span) for span in blocks))
    for m in lines:
        a, b = m.span("val")
        if _wanted(m["val"], m["name"]) and not any(x < b and a < y for x, y in taken) and not m["val"].startswith("-----") and "://" not in m["val"]:
            out.append((a, b, "bare", m["name"], m["val"], a, ""))
            taken = [*taken, (a, b)]
    if not out:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    return [(bisect_left(ends, place) + 1, a, b, kind, name, value, context) for a, b, kind, name, value, place, context in sorted(out)]


def weak_label(kind: str, name: str, value: str) -> int:
    """1 a credential, 0 none, -1 unknown."""
    ws = set(words_of(name))
    if kind == "pem":
        return 0 if len(value) < 32 or _NO_KEY.search(value) else 1
    if _PLACEHOLDER.search(value):
        return 0
    if kind == "url":
        return 1
    if kind == "auth":
        return 1 if any(c.isdigit() for c in value) or len(value) > 30 else 0
    if _OPEN_SHAPE.search(value):
        return 0
    if ISSUED.match(value):
        return 1
    if ws & OPEN_WORDS and not ws & SECRET_WORDS and re.fullmatch(r"[\da-f]{7,}|[\dA-F]{7,}", value):
        return 0
    if ws & OPEN_WORDS and re.fullmatch(r"[A-Za-z]+(?:[_\-./ ][A-Za-z]+)*", value):
        return 0
    how = telling(name)
    if not how and len(value) > 200:
        return 0  # data
    if how:
        if how == 2 and len(value) >= 8 or any(c.isdigit() for c in value) and len(value) >= 8:
            return 1
        return 0 if re.fullmatch(r"[a-z]+(?:[_\-./ ][a-z]+)*", value) else -1
    if re.fullmatch(r"[A-Za-z]+(?:[_\-./ ][A-Za-z]+)*[_\-.]?\d{0,4}", value) or len(value) < 14 or not re.search(r"[A-Za-z]", value):
        return 0
    return -1


# -- features -----------------------------------------------------------
_ALPHA = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


class Markov:
    """Order-one chain over letters (case folded), digits and other marks, fitted on ordinary words."""

    SIZE = 29

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(self.SIZE, self.SIZE) + 0.5
        self.logs = np.log(n / n.sum(axis=1, keepdims=True))

    @classmethod
    def counts(cls, words: Iterable[str]) -> np.ndarray:
        """How often one mark follows another."""
        n = np.zeros((cls.SIZE, cls.SIZE))
        for t in words:
            x = cls.codes(t)
            np.add.at(n, (x[:-1], x[1:]), 1)
        return n.ravel()

    @staticmethod
    def codes(t: str) -> np.ndarray:
        return np.array([26 if c.isdigit() else _ALPHA.get(c, 27) for c in ("~" + t).lower()], dtype=np.int64)

    def mean(self, t: str) -> float:
        """Mean log likelihood of a character."""
        x = self.codes(t)
        return float(self.logs[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0


#: Marks whose presence in a value is a feature each.
_MARKS = "<>{}$%*.:/-_=+@#!\\ ()[]"
_DENSE = 20 + len(_MARKS)
_UUID = (8, 4, 4, 4, 12)


def shape(value: str, chain: Markov) -> list[float]:
    """Figures about the whole value: likelihood, length, composition."""
    n = max(1, len(value))
    low, up, dig = (sum(map(f, value)) / n for f in (str.islower, str.isupper, str.isdigit))
    kinds = [("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "_") for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    counts = np.array(list(Counter(value).values()), float)
    p = counts / counts.sum()
    entropy = float(-(p * np.log2(p)).sum())
    is_hex = bool(re.fullmatch(r"[\da-f]+|[\dA-F]+", value))
    runs = [len(r) for r in re.findall(r"[A-Za-z0-9]+", value)]
    like = chain.mean(value)
    return [
        like, like * like / 10, min(n, 100) / 50, math.log(n), low, up, dig, 1 - low - up - dig, turns, entropy / 5, (max(runs) if runs else 0) / 40, float(is_hex), float(is_hex and n == 40),
        float(is_hex and n in (32, 64, 128)), float(tuple(map(len, value.split("-"))) == _UUID), float(dig == 0), float(bool(re.search(r"[a-z]{4,}", value))), 1.0 if len(runs) > 3 else 0.0,
        float(p.max()), 1.0, *(float(c in value) for c in _MARKS),
    ]


_TEXT_PATH = re.compile(r"[A-Za-z]+")


def names_of(name: str, value: str, path: str, context: str, masked: bool = False) -> list[str]:
    """Names of the features beside the value's shape: words of the identifier (its last one twice), of the value, of the context, of the path."""
    ws = [] if masked else words_of(name)
    f = {"n:" + w for w in ws} | {"l:" + w for w in ws[-1:]} | {"n:named" if ws else "n:none"}
    f |= {"v:" + w for w in words_of(value) if len(w) > 3} | {"c:" + w.lower() for w in _TEXT_PATH.findall(context)}
    *folders, last = path.lower().split("/")
    return sorted(f | {"p:ext " + last.rsplit(".", 1)[-1]} | {"p:" + p for p in folders[1:]})


#: What a name feature weighs beside the figures.
NAME_WEIGHT, PATH_WEIGHT = 1.0, 0.3
#: Words count if labelled candidates of so many repositories have them.
NAME_REPOS = 4


def named(name: str, value: str, path: str, context: str, known: frozenset, masked: bool = False) -> tuple[list[int], list[float]]:
    """Places and values of the known names."""
    names = [x for x in names_of(name, value, path, context, masked) if x in known]
    return [_DENSE + bucket(x, NAME_BITS) for x in names], [PATH_WEIGHT if x[:2] == "p:" else NAME_WEIGHT for x in names]


WIDTH = _DENSE + (1 << NAME_BITS)


# -- training -----------------------------------------------------------
#: kind, name, value, path, context, repo, label
Row = tuple[str, str, str, str, str, str, int]
_ROW = ("kind", "name", "value", "path", "context", "repo", "label")
#: Ways to keep candidates for the calibration; the first that leaves both classes on both sides is taken.
SPLITS = ("repository", "value", "none")


def sides(r: Row, split: str) -> tuple[bool, bool]:
    """Whether a candidate is fitted on, and whether it is calibrated on."""
    if split == "none":
        return True, True
    held = bucket("held:" + (r[5] if split == "repository" else f"{r[3]} {r[2]}"), 8) % 5 == 0
    return not held, held


def _census(rows: Iterable[Row]) -> np.ndarray:
    """Candidates by split, side and label."""
    n = np.zeros((len(SPLITS), 2, 2))
    for r in rows:
        for k, split in enumerate(SPLITS):
            n[k, :, r[6]] += sides(r, split)
    return n.ravel()


def _words(rows: Iterable[Row]) -> Iterator[tuple[str]]:
    """Ordinary words: those of identifiers and paths."""
    for r in rows:
        yield from ((w,) for w in words_of(r[1]))
        yield from ((w,) for w in _TEXT_PATH.findall(r[3].lower()))


def _owners(rows: Iterable[Row], split: str) -> Iterator[tuple[str, str]]:
    """(name feature, repository) of what is fitted on."""
    for r in rows:
        if sides(r, split)[0]:
            yield from ((x, r[5]) for x in names_of(*r[1:5]))


class Block:
    """Features of labelled candidates: figures, and names with the identifier and without it."""

    def __init__(self, figures, label, train, test, plain, masked):
        self.figures, self.label, self.train, self.test = figures.astype(float), label.astype(float), train, test
        self.plain, self.masked = ((np.repeat(np.arange(len(label)), many), places.astype(int), vals.astype(float)) for many, places, vals in (plain, masked))

    def logits(self, w: np.ndarray, names: tuple) -> np.ndarray:
        row, places, vals = names
        return self.figures @ w[:_DENSE] + np.bincount(row, vals * w[places], len(self.label)) + w[-1]

    def back(self, g: np.ndarray, names: tuple) -> np.ndarray:
        row, places, vals = names
        out = np.bincount(places, vals * g[row], WIDTH + 1).astype(float)  # whole numbers where there are no names
        out[:_DENSE] += g @ self.figures
        out[-1] = g.sum()
        return out


def _packed(rows: list[Row], chain: Markov, known: frozenset, split: str) -> tuple:
    """What a Block is made of."""
    names = []
    for masked in (False, True):
        each = [named(*r[1:5], known, masked) for r in rows]
        names.append((np.array([len(c) for c, _ in each], np.int32), np.array([x for c, _ in each for x in c], np.int16), np.array([x for _, v in each for x in v], np.float32)))
    train, test = np.array([sides(r, split) for r in rows]).T
    return np.array([shape(r[2], chain) for r in rows], np.float32), np.array([r[6] for r in rows], np.int8), train, test, *names


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradient(blocks: Iterable[Block], w: np.ndarray, weight: tuple[float, float]) -> np.ndarray:
    """Gradient over what is fitted on, each with its names and masked; weight: of either class."""
    out = np.zeros(WIDTH + 1)
    for k in blocks:
        c = np.where(k.label > 0, weight[1], weight[0]) * k.train
        for names in (k.plain, k.masked):
            out += k.back(c * (_sigmoid(k.logits(w, names)) - k.label), names)
    return out


def _distance(blocks: Iterable[Block], w: np.ndarray) -> np.ndarray:
    """Sum of the distances from the border, of what is calibrated on."""
    return np.array([sum(float(np.abs(k.logits(w, k.plain)) @ k.test) for k in blocks)])


def _calibration(blocks: Iterable[Block], w: np.ndarray, scale: float, line: np.ndarray, goal: tuple[float, float]) -> np.ndarray:
    """Gradient and second derivatives by slope and offset; goal: the probability aimed at for either class."""
    out = np.zeros(6)
    for k in blocks:
        x = np.stack([k.logits(w, k.plain) / scale, np.ones(len(k.label))])
        p = _sigmoid(line @ x)
        out[:2] += x @ ((p - np.where(k.label > 0, goal[1], goal[0])) * k.test)
        out[2:] += ((x * (p * (1 - p) * k.test)) @ x.T).ravel()
    return out


def _right(blocks: Iterable[Block], w: np.ndarray, slope: float, offset: float) -> np.ndarray:
    """How many are told right of what is calibrated on, with names and masked."""
    out = np.zeros(2)
    for k in blocks:
        out += [((slope * k.logits(w, names) + offset >= math.log(THRESHOLD / (1 - THRESHOLD))) == (k.label > 0)) @ k.test.astype(float) for names in (k.plain, k.masked)]
    return out


STEPS = 500
#: Penalties of the squared weights and of the squared slope; the slope's is less where one class is rare, as its candidates are but few of the mean.
L2, SLOPE_L2 = 1e-5, 1e-3


def _trained(sums, n: np.ndarray, steps: int) -> np.ndarray:
    """Weights, slope, offset, how many are told right; sums(f, ...) adds up f over all blocks, n holds candidates by side and label."""
    (no, yes), (test_no, test_yes) = n
    train, test = no + yes, test_no + test_yes
    weight = train / (2 * no), train / (2 * yes)
    w = adam(lambda w: sums(_gradient, w=w, weight=weight) / (2 * train) + L2 * np.append(w[:-1], 0.0), WIDTH + 1, steps)
    scale = float(sums(_distance, w=w)[0]) / test or 1.0
    goal, penalty = (1 / (test_no + 2), (test_yes + 1) / (test_yes + 2)), SLOPE_L2 * 2 * min(test_no, test_yes) / test

    def miss(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = sums(_calibration, w=w, scale=scale, line=line, goal=goal) / test
        return s[:2] + penalty * line * [1, 0], s[2:].reshape(2, 2) + penalty * np.diag([1, 0])

    line = newton(miss, 2)
    slope, offset = max(float(line[0]), 0.05) / scale, float(line[1])
    return np.concatenate([w, [slope, offset], sums(_right, w=w, slope=slope, offset=offset)])


def _trained_here(blocks: Iterable[Block], n: np.ndarray, steps: int) -> np.ndarray:
    """The same where all blocks are at hand."""
    blocks = list(blocks)
    return _trained(lambda f, **given: f(blocks, **given), n, steps)


class Here:
    """Labelled candidates in memory."""

    def __init__(self, rows: list[Row]):
        self.rows = rows

    def census(self) -> np.ndarray:
        return _census(self.rows)

    def follows(self) -> np.ndarray:
        return Markov.counts(w for w, in set(_words(self.rows)))

    def known(self, split: str) -> frozenset:
        return frozenset(x for x, n in Counter(x for x, _ in set(_owners(self.rows, split))).items() if n >= NAME_REPOS)

    def trained(self, n: np.ndarray, **given) -> np.ndarray:
        return _trained_here([Block(*_packed(self.rows, **given))], n, STEPS)


def _rows(batches) -> Iterator[Row]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in _ROW))


def _blocks(batches) -> Iterator[Block]:
    for b in batches:
        for x in b.column("block"):
            yield Block(*pickle.loads(x.as_py()))


def _total(batches, f, read, given):
    """The sums of one task."""
    yield pa.RecordBatch.from_pydict({"sums": [f(read(batches), **given).tobytes()]}, pa.schema([("sums", pa.binary())]))


def _once(batches, f, names, given):
    """Tuples of strings, most of them once a task."""
    schema = pa.schema([(n, pa.string()) for n in names])
    rows = f(_rows(batches), **given)
    while some := list(itertools.islice(rows, 100_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*set(some))], schema=schema)


def _word_batches(batches):
    for b in batches:
        yield from b.column("word").to_pylist()


def _pack(batches, given):
    rows = _rows(batches)
    while some := list(itertools.islice(rows, BLOCK_ROWS)):
        yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(_packed(some, **given), 5)]}, pa.schema([("block", pa.binary())]))


class InCluster:
    """Labelled candidates of a table; only sums, a vector a task, and the known names come to the driver."""

    def __init__(self, found: DataFrame):
        self.rows = found.where("label >= 0").select(*_ROW)

    @staticmethod
    def _added(df: DataFrame, f, read, given: dict) -> np.ndarray:
        parts = df.mapInArrow(partial(_total, f=f, read=read, given=given), "sums binary").collect()
        return np.sum([np.frombuffer(r.sums) for r in parts] or [f(iter(()), **given)], axis=0)

    def census(self) -> np.ndarray:
        n = self._added(self.rows, _census, _rows, {})
        self.tasks = max(1, min(2 * self.rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n[-2:].sum() / TASK_ROWS)))
        return n

    def follows(self) -> np.ndarray:
        words = self.rows.mapInArrow(partial(_once, f=_words, names=["word"], given={}), "word string").distinct()
        return self._added(words, Markov.counts, _word_batches, {})

    def known(self, split: str) -> frozenset:
        owners = self.rows.mapInArrow(partial(_once, f=_owners, names=["x", "repo"], given={"split": split}), "x string, repo string").distinct()
        return frozenset(r.x for r in owners.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= NAME_REPOS).select("x").toLocalIterator())

    def trained(self, n: np.ndarray, **given) -> np.ndarray:
        """A pass over the features for each step; where one task can hold them, it takes all steps itself."""
        blocks = materialized(self.rows.mapInArrow(partial(_pack, given=given), "block binary"), "features")
        few = blocks.coalesce(self.tasks)
        if self.tasks == 1:
            out = self._added(few, _trained_here, _blocks, {"n": n, "steps": STEPS})
        else:
            out = _trained(lambda f, **given: self._added(few, f, _blocks, given), n, STEPS)
        release(blocks)
        return out


class Model:
    """Weights, calibration and chain; small enough to ship with a task."""

    def __init__(self, rows: list[Row] | InCluster):
        rows = rows if isinstance(rows, InCluster) else Here(rows)
        n = rows.census().reshape(len(SPLITS), 2, 2)
        self.n_rows = int(n[-1, 0].sum())
        self.fitted = bool(n[-1, 0].all())
        self.report: dict[str, float] = {}
        if not self.fitted:
            return
        k = next(k for k in range(len(SPLITS)) if n[k].all())
        self.chain, self.known = Markov(rows.follows()), rows.known(SPLITS[k])
        *w, self.b, self.slope, self.offset, right, blind = rows.trained(n[k], chain=self.chain, known=self.known, split=SPLITS[k]).tolist()
        self.w, test = np.array(w), float(n[k, 1].sum())
        self.report = {"held_out": test, "accuracy": right / test, "masked accuracy": blind / test}

    def score(self, kind: str, name: str, value: str, path: str, context: str = "") -> float:
        if not self.fitted:
            return float(weak_label(kind, name, value) == 1)
        places, vals = named(name, value, path, context, self.known)
        z = float(np.dot(self.w[:_DENSE], shape(value, self.chain)) + np.dot(self.w[places], vals)) + self.b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * z + self.offset))))


_CAND = pa.schema(
    [("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("line_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
     ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("context", pa.string()), ("label", pa.int32())]
)
CANDIDATE_SCHEMA = "file_id bigint, repo string, path string, line_no int, start int, stop int, kind string, name string, value string, context string, label int"


def _scan(batches):
    for b in by_bytes(batches):
        rows = []
        for i, r, p, g, t in zip(*(b.column(n).to_pylist() for n in ("file_id", "repo", "path", "language", "text"))):
            for line, a, e, kind, name, value, context in candidates_of(t, g == "text" or g is None):
                rows.append((i, r or "", p or "", line, a, e, kind, name, value, context, weak_label(kind, name, value)))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _CAND.types[n]) for n in range(len(_CAND.names))], schema=_CAND)


def candidates(files: DataFrame) -> DataFrame:
    """Every value that may be a credential, once per file and place; texts are scanned once and not shuffled."""
    text_batches(files.sparkSession)
    f = spread(files.select("file_id", "repo", "path", "language", "text").where("file_id is not null and text is not null"))
    return materialized(f.mapInArrow(_scan, CANDIDATE_SCHEMA).dropDuplicates(["file_id", "start", "stop"]), "candidates")


def fit(found: DataFrame) -> Model:
    """Fit on all labelled candidates; they and their features stay in the cluster."""
    return Model(InCluster(found))


def _judge(batches, model):
    m: Model = model.value
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("kind", "name", "value", "path", "context")]
        p = [m.score(*x) for x in zip(*cols)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])


def scored(files: DataFrame) -> DataFrame:
    """All candidates with their calibrated probability of being a credential."""
    found = candidates(files)
    model = files.sparkSession.sparkContext.broadcast(fit(found))
    return found.mapInArrow(partial(_judge, model=model), CANDIDATE_SCHEMA + ", score double")


def credentials(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, line_no) of each credential."""
    return scored(files).where(F.col("score") >= threshold).select("file_id", "line_no").distinct()


#: What a span over several literals or lines is made of: the marks between literals, line ends as written or as escapes, blanks; the rest is content.
_FRAME = re.compile(r"[\"'`][^\"'`A-Za-z0-9]*?(?:[bBrRuU]{0,2})[\"'`]|\\?\r?\n|\\[nr]|[ \t]+")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace the spans of values; quotes, joins and line structure stay, whatever they stand between."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        body, k, first = text[a:b], 0, True
        frames = list(_FRAME.finditer(body)) if kind == "pem" or any(q in body for q in _Q) else []
        for m in [*frames, None]:
            content = body[k : m.start() if m else len(body)]
            if content:
                out.append("REDACTED" if first else "")
                first = False
            if m:
                out.append(m[0])
                k = m.end()
        at = b
    out.append(text[at:])
    return "".join(out)


_REDACTED = pa.schema([("file_id", pa.int64()), ("n_redacted", pa.int32()), ("text", pa.string())])


def _redact_batches(batches, model, threshold):
    m: Model = model.value
    for b in by_bytes(batches):
        rows = []
        for i, p, g, t in zip(*(b.column(n).to_pylist() for n in ("file_id", "path", "language", "text"))):
            found = candidates_of(t, g == "text" or g is None)
            spans = sorted({(a, e, kind) for _, a, e, kind, name, value, context in found if m.score(kind, name, value, p or "", context) >= threshold})
            if spans:
                rows.append((i, len(spans), redact(t, spans)))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _REDACTED.types[n]) for n in range(3)], schema=_REDACTED)


def redacted(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, n_redacted, text) of each file that holds credentials, without them; other files are as they were.

    Once the model is fitted, texts are scanned again where they lie: none is
    joined with its spans or shuffled.
    """
    found = candidates(files)
    model = files.sparkSession.sparkContext.broadcast(fit(found))
    once = each_once(files.select("file_id", "path", "language", "text").where("text is not null"), "file_id")
    return spread(once).mapInArrow(partial(_redact_batches, model=model, threshold=threshold), "file_id bigint, n_redacted int, text string")


def statistics(files: DataFrame) -> DataFrame:
    """Per repository and kind: candidates, credentials, mean score of the credentials; candidates without a weak label and credentials among them."""
    s = scored(files)
    hit, free = F.col("score") >= THRESHOLD, F.col("label") < 0
    return s.groupBy("repo", "kind").agg(
        F.count("*").alias("n_candidates"), F.sum(hit.cast("int")).alias("n_credentials"), F.round(F.avg(F.when(hit, F.col("score"))), 6).alias("mean_score"),
        F.sum(free.cast("int")).alias("n_unlabelled"), F.sum((hit & free).cast("int")).alias("n_unlabelled_credentials"),
    )
