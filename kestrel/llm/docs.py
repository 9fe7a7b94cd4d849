"""Functions paired with their documentation.

Texts are parsed (:mod:`kestrel.syntax`), function nodes are visited, and the
documentation attached to each is taken with the function's exact source
range.  Documentation that says nothing is filtered.

Defined results: null or empty texts, unknown languages and texts with any
syntax error yield nothing; repeated rows count once; two functions whose
names stand on one line are two pairs but one (file_id, line_no); extra
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import each_once, spread, text_batches
from kestrel.syntax import LANGUAGES, parse_text

FUNCTION_KINDS = frozenset(
    "function_definition function_declaration generator_function_declaration function_signature method_definition method_signature "
    "method_declaration constructor_declaration function_item function_signature_item".split()
)
#: Whole documentations that are placeholders (compared in lower case, without punctuation).
PLACEHOLDERS = frozenset(
    "todo fixme tbd tba xxx hack wip na n a none null undocumented docs pending documentation pending doc pending pending "
    "description placeholder no description no documentation missing add description add docs document me document this "
    "to be documented to be done write me see code self explanatory auto generated autogenerated stub".split()
) | {"docs pending", "documentation pending", "n a", "no docs", "no description", "no documentation", "add description", "add docs", "description here",
     "document me", "document this", "to be documented", "to be done", "see code", "self explanatory", "fill in", "fill me in", "coming soon", "to do"}
_MARKED = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b.*$")
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:go:\w+|\+build|nolint|noqa|type:\s*ignore|pylint:|eslint-|jshint|jslint|istanbul|c8 ignore|prettier-|@ts-|tslint:|@flow|ts-ignore|"
    r"clippy|rustfmt|pragma|coverage:|nosec|mypy:|fmt:|yapf:|isort:|region\b|endregion\b|@formatter|checkstyle|noinspection|cspell:|spellchecker|"
    r"lint:|export \w+$|-\*-|vim:|@override\s*$|@inheritdoc\s*$|\{@inheritdoc\}\s*$|inheritdoc\s*$|@deprecated\s*$|@internal\s*$|@hidden\s*$|@private\s*$|@public\s*$|@noinspection).*$"
)
_BARE_TAG = re.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|returns?|throws|exception|type|typeparam|template|see|since|author|version)\b\s*(?:\{[^}]*\})?\s*(?:<?[\w.\[\]$]*>?)?\s*[-:.]*"
    r"|:(?:param|parameter|arg|argument|type|returns?|rtype|raises|raise|var|ivar)\b[^:]*:\s*[\w.\[\], ]{0,0}"
    r"|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Example|Examples|Errors|Panics|Safety|Note|Notes)\s*:?|#+\s*\w+\s*|[-=~*_#`'\"+^.\s]*)\s*$"
)
#: Words that say nothing on their own beside the words of a name.
FILLERS = frozenset("the a an this that function method func fn def it its is does of for to and or do in on our helper der die das el la los las".split())
_WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
_NAME_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


def says_something(doc: str, name: str | None) -> bool:
    """Whether documentation holds more than placeholders, directives, bare tags and the name's words."""
    words: list[str] = []
    for line in doc.split("\n"):
        if _MARKED.match(line) or _DIRECTIVE.match(line) or _BARE_TAG.match(line):
            continue
        words += [w.lower() for w in _WORD.findall(re.sub(r"[@\\:](?:param|arg|return|returns|type|rtype|throws|raises)\b:?", " ", line))]
    if not words or " ".join(words) in PLACEHOLDERS or all(w in PLACEHOLDERS for w in words) and len(words) < 3:
        return False
    own = {w.lower() for w in _NAME_WORD.findall(name or "")}
    left = [w for w in words if w not in FILLERS and not (w in own or w.rstrip("s") in own or w + "s" in own or w.removesuffix("es") in own)]
    return bool(left)


_STAR = re.compile(r"^\s*\*+ ?", re.M)


def _block(tok: str) -> str:
    return _STAR.sub("", tok[3:-2]).strip()


def _above(src, p: int, language: str) -> str | None:
    """The documentation directly above significant token p."""
    toks = src.toks
    k = (src.idx[p] if p < len(src.idx) else len(toks)) - 1
    lines: list[str] = []
    fresh = 0
    while k >= 0:
        t = toks[k]
        if t.isspace():
            fresh += t.count("\n")
            if fresh > 1:
                break
        elif t.startswith("//"):
            fresh = 0
            if language == "go" or language == "rust" and t.startswith("///") and not t.startswith("////"):
                before = toks[k - 1] if k else "\n"
                if k and not ("\n" in before or k == 1):  # a comment behind code on its line
                    break
                lines.append(t[2 if language == "go" else 3 :].rstrip("\r"))
            else:
                break
        elif t.startswith("/**") and t != "/**/" and language != "go":
            if not lines:
                return _block(t)
            break
        else:
            break
        k -= 1
    return "\n".join(reversed(lines)) if lines else None


def _inside(src, node, language: str) -> str | None:
    """Documentation between annotations or attributes and the name."""
    for k in range(src.idx[node.name_p], src.idx[node.outer], -1):
        t = src.toks[k]
        if t.startswith("/**") and t != "/**/" and language != "go":
            return _block(t)
        if language == "rust" and t.startswith("///") and not t.startswith("////"):
            out = []
            while k > src.idx[node.outer] and (t.isspace() or t.startswith("///")):
                if not t.isspace():
                    out.append(t[3:])
                k -= 1
                t = src.toks[k]
            return "\n".join(reversed(out))
    return None


def _docstring(parser, node) -> str | None:
    head = parser.lines[node.body]
    s, a = head[1], head[0]
    if not s.endswith(":"):  # def f(): "..."
        p = a + len(s) - 1
        if s[-1] != "s" or s[-2] != ":":
            return None
        return _literal([parser.src.tok(p)])
    if node.body + 1 >= len(parser.lines):
        return None
    a, s, _ = parser.lines[node.body + 1]
    n = len(s) - len(s.lstrip("s"))
    if not n or n < len(s) and s[n] != ";":
        return None
    return _literal([parser.src.tok(a + k) for k in range(n)])


def _literal(toks: list[str]) -> str | None:
    out = []
    for t in toks:
        q = min(k for k in (t.find('"'), t.find("'")) if k >= 0)
        prefix = t[:q].lower()
        if "b" in prefix or "f" in prefix:
            return None
        n = 3 if t[q : q + 3] in ('"""', "'''") else 1
        out.append(t[q + n : len(t) - n])
    return "".join(out)


def functions_of(text: str | None, language: str):
    """(name, kind, name line, first line, last line, documentation, exact source) of each function of a text that parses."""
    if not text:
        return []
    x = parse_text(text, language)
    if x is None or x.errors:
        return []
    src, out = x.src, []
    stack = list(reversed(x.top))
    while stack:
        n = stack.pop()
        stack.extend(reversed(n.children))
        if n.kind not in FUNCTION_KINDS or n.name_p is None or n.name is None:
            continue
        if language == "python":
            doc = _docstring(x, n)
        else:
            doc = _above(src, n.outer, language) or (_inside(src, n, language) if n.outer < n.name_p else None)
        if doc is None or not says_something(doc, n.name):
            continue
        a, b = src.offset(n.start), src.end_offset(n.end)
        out.append((n.name, n.kind, src.line(src.offset(n.name_p)), src.line(a), src.line(b), doc.strip(), src.text[a:b]))
    return out


_OUT = pa.schema(
    [("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("kind", pa.string()),
     ("line_no", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("doc", pa.string()), ("code", pa.string())]
)
SCHEMA = "file_id bigint, repo string, path string, language string, name string, kind string, line_no int, start_line int, end_line int, doc string, code string"
_LINES = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32())])


def _pair_batches(batches):
    for b in batches:
        head = [b.column(n).to_pylist() for n in ("file_id", "repo", "path", "language")]
        rows = [(*h, *f) for *h, t in zip(*head, b.column("text").to_pylist()) for f in functions_of(t, h[3])]
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], _OUT)


def _line_batches(batches):
    for b in batches:
        ids, langs, texts = (b.column(n).to_pylist() for n in ("file_id", "language", "text"))
        rows = [(i, f[2]) for i, g, t in zip(ids, langs, texts) for f in functions_of(t, g)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _LINES.types[k]) for k in (0, 1)], schema=_LINES)


def _known(files: DataFrame, *columns: str) -> DataFrame:
    text_batches(files.sparkSession)
    return spread(files.select(*columns).where(F.col("language").isin(*LANGUAGES)))


def function_pairs(files: DataFrame) -> DataFrame:
    """One row per documented function: names, kinds, lines, documentation and exact source; files are told apart first, so no source is shuffled."""
    return _known(each_once(files.select("file_id", "repo", "path", "language", "text"), "file_id"), "file_id", "repo", "path", "language", "text").mapInArrow(_pair_batches, SCHEMA)


def documented_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of each documented function's name; nothing else leaves the workers."""
    return _known(files, "file_id", "language", "text").mapInArrow(_line_batches, "file_id bigint, line_no int").distinct()


def pair_statistics(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documented functions and their documentation's length per language, kind and kind of the chunk that holds them."""
    pairs = _known(files, "file_id", "repo", "path", "language", "text").mapInArrow(_pair_batches, SCHEMA)
    slim = pairs.select("file_id", "repo", "path", "language", "name", "kind", "start_line", F.length("doc").alias("doc_chars")).distinct()
    held = chunks.where("name is not null").groupBy("repo", "path", "name", "start_line").agg(F.min("kind").alias("chunk_kind"))
    return (
        slim.join(held, ["repo", "path", "name", "start_line"], "left")
        .groupBy("language", "kind", F.coalesce("chunk_kind", F.lit("none")).alias("chunk_kind"))
        .agg(F.count("*").alias("n_pairs"), F.round(F.avg("doc_chars"), 6).alias("avg_doc_chars"))
    )
