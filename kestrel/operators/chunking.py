"""Syntax-aware chunks: definitions whole where they fit, split by members where they don't, windows where there are none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from kestrel.operators.files import LANGUAGE_OF_SUFFIX, LINE_ENDS, WINDOW_LINES, WINDOW_STEP
from kestrel.session import spread, text_batches
from kestrel.syntax import LANGUAGES, parse_text

#: Kinds (as endings) that make a definition, and sizes in lines.
DEFINITION_KINDS = (
    "function_definition",
    "function_declaration",
    "function_item",
    "method_definition",
    "method_declaration",
    "class_definition",
    "class_declaration",
    "impl_item",
    "interface_declaration",
    "struct_item",
)
MAX_CHUNK_LINES = 120
MIN_STANDALONE_LINES = 5

_ENDS = re.compile(LINE_ENDS)


def language_of_path(path: str) -> str | None:
    return next((g for s, g in LANGUAGE_OF_SUFFIX.items() if path.endswith(s)), None)


class Span(NamedTuple):
    """What becomes a chunk (``run`` is None) or a part of one: loose members next to each other with the same ``run`` stay together."""

    first: int
    last: int
    kind: str
    name: str | None
    parent: str | None
    run: int | None
    bare: int  # where it starts without decorators


class Outline:
    """The spans of one parsed text, in its order, and the chunks they give."""

    def __init__(self, parsed):
        self.x, self.src = parsed, parsed.src
        self.python = parsed.language == "python"

    @staticmethod
    def is_definition(n) -> bool:
        return n is not None and n.kind.endswith(DEFINITION_KINDS)

    def lines(self, a: int, b: int) -> tuple[int, int]:
        return self.src.line(self.src.offset(a)), self.src.line(self.src.end_offset(b) - 1)

    def height(self, a: int, b: int) -> int:
        first, last = self.lines(a, b)
        return last - first + 1

    def members(self, n):
        """(first token, last token, definition or None) of what stands in a definition's block."""
        if not self.python:
            return [m for m in n.body or [(n.start, n.end, None)] if m[0] != m[1] or self.src.s[m[0]] not in "{};"]
        lines, out = self.x.lines, []
        base = lines[n.body][2]
        own = {c.start: c for c in n.children}
        k, inner = n.body + 1, None
        while k < len(lines) and lines[k][0] <= n.end:
            a, s, indent = lines[k]
            inner = indent if inner is None else inner
            if indent <= base:
                break
            end = a + len(s) - 1
            if indent == inner:
                out.append([a, end, own.get(a)])
            else:
                out[-1][1] = end
            k += 1
        merged = []
        for a, b, d in out:
            if merged and merged[-1][3] and d is None and self.src.s[a] == "@":
                merged[-1][1] = b
            elif merged and merged[-1][3]:
                merged[-1][1:] = [b, d, False]
            else:
                merged.append([a, b, d, self.src.s[a] == "@"])
        return [(a, b, d) for a, b, d, _ in merged]

    def spans(self) -> Iterator[Span]:
        """Definitions that fit are spans; of larger ones their members are, down to any depth; what is no definition is looked into."""
        todo: list = [(n, None) for n in reversed(self.x.top)]
        opened = 0
        while todo:
            item = todo.pop()
            if isinstance(item, Span):
                yield item
                continue
            n, parent = item
            if not self.is_definition(n):
                todo += [(c, parent) for c in reversed(n.children)]
                continue
            parts = self.members(n) if self.height(n.start, n.end) > MAX_CHUNK_LINES else []
            if not parts:
                yield Span(n.start, n.end, n.kind, n.name, parent, None, n.start)
                continue
            opened += 1
            todo += [self._member(*m, n.name or parent, opened) for m in reversed(parts)]

    def _member(self, a: int, b: int, d, parent: str | None, run: int):
        """A member of an opened definition: to be opened itself, a chunk of its own, or loose."""
        size = self.height(d.start, d.end) if self.is_definition(d) else 0
        if size > MAX_CHUNK_LINES:
            return d, parent
        if size >= MIN_STANDALONE_LINES:
            return Span(d.start, d.end, d.kind, d.name, parent, None, d.start)
        return Span(a, b, "members", None, parent, run, a if d is None else d.start)

    def chunks(self) -> list[tuple]:
        """(kind, name, first line, last line, text, parent)"""
        out = []
        for run, together in groupby(self.spans(), key=lambda s: s.run):
            some = list(together)
            for part in ([s] for s in some) if run is None else self._cut(some):
                out.append(self._chunk(part))
        return out

    def _cut(self, loose: list[Span]) -> Iterator[list[Span]]:
        """Neighbours in pieces that end as soon as they are MAX_CHUNK_LINES high."""
        at = 0
        for k in range(1, len(loose) + 1):
            if k == len(loose) or self.height(loose[at].bare, loose[k - 1].last) >= MAX_CHUNK_LINES:
                yield loose[at:k]
                at = k

    def _chunk(self, part: list[Span]) -> tuple:
        s = part[0]
        a, b = s.bare, part[-1].last
        text = self.src.text[self.src.offset(a) : self.src.end_offset(b)]
        return (s.kind, s.name, *self.lines(a, b), f"# in {s.parent}:\n{text}" if s.parent else text, s.parent)


def window_chunks(text: str) -> list[tuple]:
    lines = _ENDS.split(text)
    n = len(lines) - (not lines[-1])
    starts = range(0, max(n - WINDOW_LINES, 0) + WINDOW_STEP, WINDOW_STEP) if n else ()
    ends = [min(s + WINDOW_LINES, n) for s in starts]
    return [("window", None, s + 1, e, "\n".join(lines[s:e]), None) for s, e in zip(starts, ends)]


def chunk_text(path: str, text: str | None, language: str | None = None) -> list[tuple]:
    """(kind, name, start_line, end_line, text, parent) of each chunk; line ends are read as LF, blank chunks are left out."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    language = language or language_of_path(path)
    out: list[tuple] = []
    if language in LANGUAGES:
        x = parse_text(text, language)
        out = Outline(x).chunks()
    return [c for c in out or window_chunks(text) if c[4].strip()]


_OUT = pa.schema([("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("name", pa.string()),
                  ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("parent", pa.string())])
SCHEMA = "file_id bigint, repo string, path string, language string, kind string, name string, start_line int, end_line int, text string, parent string"


def _cut(batches):
    for b in batches:
        rows = []
        for i, r, p, t in zip(*(b.column(n).to_pylist() for n in ("file_id", "repo", "path", "text"))):
            g = language_of_path(p or "") or "text"
            rows += [(i, r, p, g, *c) for c in chunk_text(p or "", t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _OUT.types[n]) for n in range(len(_OUT.names))], schema=_OUT)


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of every file (file_id, repo, path, text); texts are not shuffled."""
    text_batches(files.sparkSession)
    return spread(files.select("file_id", "repo", "path", "text")).mapInArrow(_cut, SCHEMA)
