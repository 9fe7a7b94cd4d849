"""What the brace-language parsers share: cursor, flat runs, recovery, results."""

from __future__ import annotations

import re

from kestrel.syntax.lexing import Source


class Bad(Exception):
    """A syntax error at significant token ``p``."""

    def __init__(self, p: int, why: str):
        super().__init__(why)
        self.p, self.why = p, why


class Node:
    """A definition: kind as in common syntax-tree grammars, significant-token range, members."""

    __slots__ = ("kind", "name", "name_p", "start", "end", "outer", "children", "body", "depth")

    def __init__(self, kind, name, name_p, start, outer=None):
        self.kind, self.name, self.name_p, self.start = kind, name, name_p, start
        self.outer = start if outer is None else outer  #: with annotations, export and so on
        self.end = start
        self.children: list = []
        self.body: list | None = None  #: (start, end, Node or None) of each member of its block
        self.depth = 0


def flat_pattern(prefix: str, atom: str, member: str, binary: str, depth: int = 3) -> re.Pattern:
    """A pattern for whole expressions whose nesting is at most ``depth`` calls.

    Possessive throughout: it takes what it can and never looks back, so its
    cost is linear, and what it can't take is left to the recursive rules.
    """
    a = f"(?:{prefix})*+{atom}(?:{member})*+"
    run = f"{a}(?:(?:{binary}){a})*+"
    for _ in range(depth - 1):
        a = f"(?:{prefix})*+{atom}(?:{member}|\\((?:{run}(?:,{run})*+,?+)?+\\)|\\[{run}\\])*+"
        run = f"{a}(?:(?:{binary}){a})*+"
    return re.compile(run)


_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


class BraceParser:
    """Recursive descent over ``src.s``; ``\\0`` marks the end."""

    language = ""
    flat: re.Pattern
    #: classes that start a statement, to stop recovery at
    starters: frozenset = frozenset()
    precedence: dict[str, int] = {}

    def __init__(self, src: Source):
        self.src = src
        self.s = src.s + "\0\0\0\0"
        self.p = 0
        self.errors: list[tuple[int, str]] = []
        self.top: list[Node] = []
        self.scope: list[Node] = []

    # -- cursor ---------------------------------------------------------
    def fail(self, why: str):
        raise Bad(self.p, why)

    def need(self, c: str, what: str | None = None):
        if self.s[self.p] != c:
            raise Bad(self.p, f"expected {what or repr(c)}")
        self.p += 1

    def take(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def word(self, p: int | None = None) -> str:
        return self.src.tok(self.p if p is None else p)

    def newline_before(self, p: int) -> bool:
        idx = self.src.idx
        if p >= len(idx) or p == 0:
            return True
        return any("\n" in t for t in self.src.toks[idx[p - 1] + 1 : idx[p]])

    def adjacent(self, p: int) -> bool:
        """No blank between tokens p and p + 1."""
        idx = self.src.idx
        return p + 1 < len(idx) and idx[p + 1] == idx[p] + 1

    # -- definitions ----------------------------------------------------
    def open_node(self, kind: str, name_p: int | None, start: int, outer: int | None = None) -> Node:
        n = Node(kind, None if name_p is None else self.src.tok(name_p), name_p, start, outer)
        (self.scope[-1].children if self.scope else self.top).append(n)
        n.depth = len(self.scope)
        self.scope.append(n)
        return n

    def close_node(self, n: Node):
        n.end = self.p - 1
        while self.scope and self.scope.pop() is not n:
            pass

    # -- recovery -------------------------------------------------------
    def recover(self, e: Bad, start: int):
        """Panic mode: note the error, skip to behind the next ``;``, or to a closing brace or the start of a statement on a new line."""
        self.errors.append((e.p, e.why))
        s, p, depth = self.s, max(e.p, start), 0
        if p == start:
            p += s[p] != "\0" and s[p] != "}"
        while True:
            c = s[p]
            if c == "\0":
                break
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                if depth:
                    depth -= 1
                elif c == "}":
                    break
            elif not depth and (c == ";" or c in self.starters and self.newline_before(p)):
                p += c == ";"
                break
            p += 1
        self.p = p

    def statements(self, end: str, rule):
        """Statements up to ``end`` (not taken), each recovering from its own error."""
        s = self.s
        while (c := s[self.p]) != end and c != "\0":
            start, depth = self.p, len(self.scope)
            try:
                rule()
            except Bad as e:
                lost = self.scope[depth:]
                del self.scope[depth:]
                self.recover(e, start)
                if self.p == start:
                    self.p += 1
                for n in lost:  # a definition that an error cut off reaches as far as what was skipped
                    n.end = max(n.start, min(self.p, len(self.src.idx)) - 1)

    def block(self, rule):
        self.need("{")
        self.statements("}", rule)
        self.need("}")

    def parse(self) -> "BraceParser":
        s = self.s
        while s[self.p] != "\0":
            self.statements("\0", self.top_statement)
            if s[self.p] == "\0":
                break
        return self

    def top_statement(self):
        if self.s[self.p] == "}":
            p = self.p
            self.p += 1
            raise Bad(p, "closing brace without an opening one")
        self.statement()

    def statement(self):
        raise NotImplementedError

    # -- expressions ----------------------------------------------------
    def run(self) -> bool:
        """Take a flat run if one starts here."""
        m = self.flat.match(self.s, self.p)
        if m:
            self.p = m.end()
            return True
        return False

    def binary(self, least: int):
        """Precedence climbing: operands joined by operators of at least ``least``."""
        self.unary()
        s, prec = self.s, self.precedence
        while (k := prec.get(s[self.p])) is not None and k >= least:
            c = s[self.p]
            if c == ">" and s[self.p + 1] in ">=C":  # shifts are lexed as single marks, for type arguments
                q = self.p
                while s[q] == ">" and self.adjacent(q) and s[q + 1] in ">":
                    q += 1
                if s[q] == ">" and s[q + 1] in "=C" and self.adjacent(q):
                    if s[q + 1] == "C" and self.word(q + 1) != ">=":
                        raise Bad(q, "operator without an operand")
                    return  # >>= assigns
                self.p = q
            self.p += 1
            self.binary(k + 1)

    def unary(self):
        raise NotImplementedError

    def commas(self, rule, end: str, trailing: bool = True):
        """rule, separated by commas, up to ``end``, which is taken."""
        s = self.s
        while s[self.p] != end:
            rule()
            if s[self.p] == ",":
                self.p += 1
                if s[self.p] == end and not trailing:
                    raise Bad(self.p, "trailing comma")
            elif s[self.p] != end:
                raise Bad(self.p, f"expected ',' or {end!r}")
        self.p += 1

    def attempt(self, rule) -> bool:
        """Run rule; on an error go back and say so."""
        p, depth, n = self.p, len(self.scope), len(self.errors)
        try:
            rule()
            return True
        except Bad:
            self.p = p
            del self.scope[depth:], self.errors[n:]
            return False

    def closing(self, p: int) -> int:
        """Position of the bracket that closes the one at p, or -1."""
        s, depth = self.s, 0
        for m in _BRACKETS.finditer(s, p):
            if m[0] in _OPEN:
                depth += 1
            else:
                depth -= 1
                if not depth:
                    return m.start()
        return -1


_BRACKETS = re.compile(r"[()\[\]{}]")
