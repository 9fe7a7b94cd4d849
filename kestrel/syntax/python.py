"""Python: logical lines give the block structure, each line's tokens are parsed by recursive descent.

Whether the tokens of a line form a statement depends on their classes alone,
so verdicts are remembered by class string in a bounded table.
"""

from __future__ import annotations

import re

from kestrel.syntax.base import Bad, BraceParser, Node, flat_pattern
from kestrel.syntax.lexing import PUNCT, PY_PATTERN, Classifier, Source, keyword_classes

K = keyword_classes(
    "if elif else for while try except finally with def class return raise yield import from global nonlocal pass break continue "
    "del assert lambda async await not and or is in as"
)
FIXED = PUNCT | K | dict.fromkeys(("None", "True", "False"), "v")
FIXED |= {"->": "P", ":=": "Z", "**": "W", "//": "/", ">>": "S", "!=": "C", "...": "v", "&&": "X", "||": "X", "++": "X", "--": "X", "=>": "X"}
for _gone in ("===", "!==", "??", "?.", "::", "?", "!", "`", "$", "#", "&&=", "||=", "??=", "&^="):
    FIXED[_gone] = "X"
FIXED |= dict.fromkeys(("**=", "//=", ">>=", "<<="), "A")


class _Classes(Classifier):
    def look(self, tok: str) -> str:
        c = tok[0]
        if c == "#" and "\n" not in tok or c == "\\" and len(tok) == 2:
            return " "
        if "\n" in tok and c in " \t\f\n\r#":
            return "\n"
        return super().look(tok)


CLASSES = _Classes(FIXED, newline="\n", prefixes="rRbBuUfF#")
_COUNT = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")
_TARGET_END = frozenset("i])")


class Line(BraceParser):
    """Parses one logical line; ``fn`` and ``cls`` say what it declares."""

    flat = flat_pattern(
        f"[-+~]|{K['not']}|{K['await']}", "(?:[inv]|s++)", r"\.i|\(\)",
        f"[-+*/%&|^CSW@<>]|{K['and']}|{K['or']}|{K['is']}{K['not']}?+|{K['not']}?+{K['in']}",
    )
    precedence = {K["or"]: 1, K["and"]: 2, K["in"]: 4, K["is"]: 4, "C": 4, "<": 4, ">": 4, "|": 5, "^": 6, "&": 7, "S": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "@": 10, "W": 12}

    def __init__(self, s: str, soft: str = ""):
        self.s = s + "\0\0\0"
        self.p = 0
        self.soft = soft
        self.header = False  #: ends in a colon and wants a block
        self.errors, self.scope, self.top = [], [], []
        self.source_end = len(s)

    def newline_before(self, p):
        return False

    def adjacent(self, p):
        return True

    def line(self):
        s = self.s
        c = s[0]
        rule = _RULES.get(c)
        if rule:
            rule(self)
        elif self.soft and self.attempt(self.soft_header):
            pass
        else:
            self.simple()
        if s[self.p] != "\0":
            self.fail("expected the end of the line")

    def block_or_rest(self):
        self.need(":")
        if self.s[self.p] == "\0":
            self.header = True
        else:
            self.simple()

    # -- headers --------------------------------------------------------
    def if_(self):
        self.p += 1
        self.named()
        self.block_or_rest()

    def else_(self):
        self.p += 1
        self.block_or_rest()

    def for_(self):
        self.p += 1
        self.targets()
        self.need(K["in"], "in")
        self.star_expressions()
        self.block_or_rest()

    def except_(self):
        self.p += 1
        self.take("*")
        if self.s[self.p] != ":":
            self.expression()
            while self.take(","):
                self.expression()
            if self.take(K["as"]):
                self.need("i", "a name")
        self.block_or_rest()

    def with_(self):
        s = self.s
        self.p += 1
        if not (s[self.p] == "(" and self.attempt(self.with_brackets)):
            self.with_item()
            while self.take(","):
                self.with_item()
        self.block_or_rest()

    def with_brackets(self):
        self.p += 1
        self.commas(self.with_item, ")")
        if self.s[self.p] != ":":
            self.fail("expected ':'")

    def with_item(self):
        self.expression()
        if self.take(K["as"]):
            self.one_target()

    def def_(self):
        self.p += 1
        self.need("i", "a function name")
        if self.take("["):
            self.commas(self.type_parameter, "]")
        self.need("(")
        self.commas(lambda: self.parameter(True), ")")
        if self.take("P"):
            self.expression()
        self.block_or_rest()

    def type_parameter(self):
        self.take("*") or self.take("W")
        self.need("i", "a type parameter")
        if self.take(":"):
            self.expression()
        if self.take("="):
            self.expression()

    def parameter(self, typed):
        s = self.s
        if s[self.p] == "/" and s[self.p + 1] in ",):":
            self.p += 1
            return
        if self.take("*"):
            if s[self.p] == ",":
                return
        else:
            self.take("W")
        self.need("i", "a parameter name")
        if typed and self.take(":"):
            self.take("*")
            self.expression()
        if self.take("="):
            self.expression()

    def class_(self):
        self.p += 1
        self.need("i", "a class name")
        if self.take("["):
            self.commas(self.type_parameter, "]")
        if self.s[self.p] == "(":
            self.arguments()
        self.block_or_rest()

    def async_(self):
        self.p += 1
        if self.s[self.p] not in (K["def"], K["for"], K["with"]):
            self.fail("expected def, for or with")
        _RULES[self.s[self.p]](self)

    def decorator(self):
        self.p += 1
        self.named()

    def soft_header(self):
        s = self.s
        w = self.soft
        if w == "type":
            self.p += 1
            self.need("i", "a type name")
            if self.take("["):
                self.commas(self.type_parameter, "]")
            self.need("=")
            self.expression()
            if s[self.p] != "\0":
                self.fail("expected the end of the line")
            return
        self.p += 1
        if w == "match":
            self.star_expressions()
        else:
            self.patterns()
            if self.take(K["if"]):
                self.named()
        self.block_or_rest()
        if s[self.p] != "\0":
            self.fail("expected the end of the line")

    def patterns(self):
        self.pattern()
        while self.take(","):
            if self.s[self.p] in (":", K["if"]):
                break
            self.pattern()

    def pattern(self):
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take(K["as"]):
            self.need("i", "a name")

    def closed_pattern(self):
        s = self.s
        c = s[self.p]
        if c == "*":
            self.p += 1
            self.need("i", "a name")
        elif c in "nsv-":
            while s[self.p] in "nsv-+":
                self.p += 1
        elif c == "i":
            self.p += 1
            while self.take("."):
                self.need("i", "a name")
            if self.take("("):
                self.commas(self.keyword_pattern, ")")
        elif c in "([":
            self.p += 1
            self.commas(self.pattern, ")" if c == "(" else "]")
        elif c == "{":
            self.p += 1
            self.commas(self.mapping_pattern, "}")
        else:
            self.fail("expected a pattern")

    def keyword_pattern(self):
        if self.s[self.p] == "i" and self.s[self.p + 1] == "=":
            self.p += 2
        self.pattern()

    def mapping_pattern(self):
        if self.take("W"):
            self.need("i", "a name")
            return
        self.closed_pattern()
        self.need(":")
        self.pattern()

    # -- simple statements ----------------------------------------------
    def simple(self):
        s = self.s
        while True:
            rule = _SIMPLE.get(s[self.p])
            if rule:
                rule(self)
            else:
                self.expression_statement()
            if not self.take(";") or s[self.p] == "\0":
                return

    def bare(self):
        self.p += 1

    def return_(self):
        self.p += 1
        if self.s[self.p] not in ";\0":
            self.star_expressions()

    def raise_(self):
        self.p += 1
        if self.s[self.p] not in ";\0":
            self.expression()
            if self.take(K["from"]):
                self.expression()

    def names(self):
        self.p += 1
        self.need("i", "a name")
        while self.take(","):
            self.need("i", "a name")

    def del_(self):
        self.p += 1
        self.targets()

    def assert_(self):
        self.p += 1
        self.expression()
        if self.take(","):
            self.expression()

    def dotted(self):
        self.need("i", "a name")
        while self.take("."):
            self.need("i", "a name")

    def import_(self):
        self.p += 1
        while True:
            self.dotted()
            if self.take(K["as"]):
                self.need("i", "a name")
            if not self.take(","):
                return

    def from_(self):
        s = self.s
        self.p += 1
        dots = self.p
        while s[self.p] in ".v":
            self.p += 1
        if s[self.p] == "i":
            self.dotted()
        elif self.p == dots:
            self.fail("expected a module name")
        self.need(K["import"], "import")
        if self.take("*"):
            return
        if self.take("("):
            if s[self.p] == ")":
                self.fail("expected a name")
            return self.commas(self.imported, ")")
        self.imported()
        while self.take(","):
            self.imported()

    def imported(self):
        self.need("i", "a name")
        if self.take(K["as"]):
            self.need("i", "a name")

    def expression_statement(self):
        s = self.s
        start = self.p
        self.star_expressions()
        c = s[self.p]
        if c == ":":
            self.p += 1
            self.expression()
            if self.take("="):
                self.yield_or_star()
        elif c == "=":
            while s[self.p] == "=":
                if not self.target_like(start, self.p):
                    self.fail("cannot assign to this")
                self.p += 1
                start = self.p
                self.yield_or_star()
        elif c == "A":
            if not self.target_like(start, self.p):
                self.fail("cannot assign to this")
            self.p += 1
            self.yield_or_star()

    def target_like(self, a, b) -> bool:
        """Whether tokens a..b can be assigned to: names, members, items, and lists of such."""
        s = self.s
        t = s[a:b]
        if _PLAIN_TARGETS.fullmatch(t):
            return True
        if t[-1] not in _TARGET_END and t[-1] != ",":
            return False
        depth = 0
        for c in t:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif not depth and c not in "i.,*sv":
                return False
        if t[-1] == ")":  # a call can't be assigned to, a bracketed target can
            q, depth = b - 1, 0
            while q >= a:
                depth += (s[q] == ")") - (s[q] == "(")
                if not depth:
                    break
                q -= 1
            return q == a or s[q - 1] == ","
        return True

    def yield_or_star(self):
        if self.s[self.p] == K["yield"]:
            self.yield_()
        else:
            self.star_expressions()

    def yield_(self):
        self.p += 1
        if self.take(K["from"]):
            self.expression()
        elif self.s[self.p] not in ");]}=\0":
            self.star_expressions()

    # -- expressions ----------------------------------------------------
    def targets(self):
        self.one_target()
        while self.take(","):
            if self.s[self.p] in (K["in"], "=", "\0", ";", ")"):
                return
            self.one_target()

    def one_target(self):
        s = self.s
        self.take("*")
        c = s[self.p]
        if c in "([" and self.attempt(self.bracket_targets):
            pass
        else:
            self.primary()
        self.postfix()
        if s[self.p - 1] not in "i])":
            self.fail("cannot assign to this")

    def bracket_targets(self):
        c = self.s[self.p]
        self.p += 1
        self.commas(self.one_target, ")" if c == "(" else "]")

    def star_expressions(self):
        s = self.s
        self.starred()
        while s[self.p] == ",":
            self.p += 1
            if s[self.p] in "=)]};:\0" or s[self.p] == "A":
                return
            self.starred()

    def starred(self):
        if self.take("*"):
            self.binary(5)
        else:
            self.named()

    def named(self):
        if self.s[self.p] == "i" and self.s[self.p + 1] == "Z":
            self.p += 2
        if self.s[self.p] == K["yield"]:
            return self.yield_()
        self.expression()

    def expression(self):
        s = self.s
        if s[self.p] == K["lambda"]:
            return self.lambda_()
        m = self.flat.match(s, self.p)
        if m:
            self.p = q = m.end()
            if s[q] in ",)=\0":
                return
            self.postfix()
        else:
            self.unary()
        self.climb()
        if s[self.p] == K["if"]:
            self.p += 1
            self.disjunction()
            self.need(K["else"], "else")
            self.expression()

    def disjunction(self):
        if self.s[self.p] == K["lambda"]:
            return self.lambda_()
        self.unary()
        self.climb()

    def climb(self):
        s, prec = self.s, self.precedence
        while True:
            c = s[self.p]
            if c == K["not"] and s[self.p + 1] == K["in"]:
                self.p += 1
                c = K["in"]
            elif c == K["is"] and s[self.p + 1] == K["not"]:
                self.p += 1
            k = prec.get(c)
            if k is None:
                return
            self.p += 1
            self.binary(k + 1)

    def binary(self, least):
        self.unary()
        s, prec = self.s, self.precedence
        while True:
            c = s[self.p]
            two = c == K["not"] and s[self.p + 1] == K["in"] or c == K["is"] and s[self.p + 1] == K["not"]
            k = 4 if two else prec.get(c)
            if k is None or k < least:
                return
            self.p += 1 + two
            self.binary(k + 1)

    def unary(self):
        s = self.s
        while s[self.p] in "-+~" or s[self.p] in (K["not"], K["await"]):
            self.p += 1
        if s[self.p] == K["lambda"]:
            return self.lambda_()
        self.primary()
        self.postfix()

    def lambda_(self):
        s = self.s
        self.p += 1
        while s[self.p] != ":":
            self.parameter(False)
            if s[self.p] != ":":
                self.need(",")
        self.p += 1
        self.expression()

    def primary(self):
        s = self.s
        c = s[self.p]
        if c in "inv":
            self.p += 1
        elif c == "s":
            while s[self.p] == "s":
                self.p += 1
        elif c == "(":
            self.p += 1
            if not self.take(")"):
                if s[self.p] == K["yield"]:
                    self.yield_()
                else:
                    self.comprehension_or_list(self.starred)
                self.need(")")
        elif c == "[":
            self.p += 1
            if not self.take("]"):
                self.comprehension_or_list(self.starred)
                self.need("]")
        elif c == "{":
            self.p += 1
            if not self.take("}"):
                self.comprehension_or_list(self.entry)
                self.need("}")
        else:
            self.fail("expected an expression" if c != "X" else "unterminated or stray token")

    def entry(self):
        if self.take("W"):
            return self.binary(5)
        self.starred()
        if self.take(":"):
            self.expression()

    def comprehension_or_list(self, rule):
        s = self.s
        rule()
        if s[self.p] in (K["for"], K["async"]):
            return self.clauses()
        while self.take(","):
            if s[self.p] in ")]}":
                return
            rule()

    def clauses(self):
        s = self.s
        while True:
            if s[self.p] == K["async"] and s[self.p + 1] == K["for"]:
                self.p += 1
            if self.take(K["for"]):
                self.targets()
                self.need(K["in"], "in")
                self.disjunction()
            elif self.take(K["if"]):
                if s[self.p] == "i" and s[self.p + 1] == "Z":
                    self.p += 2
                self.disjunction()
            else:
                return

    def postfix(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                self.need("i", "a member name")
            elif c == "(":
                self.arguments()
            elif c == "[":
                self.p += 1
                self.slice_()
                while self.take(","):
                    if s[self.p] == "]":
                        break
                    self.slice_()
                self.need("]")
            else:
                return

    def slice_(self):
        s = self.s
        if s[self.p] != ":":
            self.starred()
        for _ in range(2):
            if self.take(":") and s[self.p] not in ":],":
                self.expression()

    def arguments(self):
        self.need("(")
        self.commas(self.argument, ")")

    def argument(self):
        s = self.s
        if self.take("*") or self.take("W"):
            return self.expression()
        if s[self.p] == "i" and s[self.p + 1] == "=":
            self.p += 2
            return self.expression()
        self.named()
        if s[self.p] in (K["for"], K["async"]):
            self.clauses()


_PLAIN_TARGETS = re.compile(r"i(?:\.i)*")
_RULES = {
    K["if"]: Line.if_, K["elif"]: Line.if_, K["while"]: Line.if_, K["else"]: Line.else_, K["try"]: Line.else_, K["finally"]: Line.else_,
    K["for"]: Line.for_, K["except"]: Line.except_, K["with"]: Line.with_, K["def"]: Line.def_, K["class"]: Line.class_,
    K["async"]: Line.async_, "@": Line.decorator,
}
_SIMPLE = {
    K["pass"]: Line.bare, K["break"]: Line.bare, K["continue"]: Line.bare, K["return"]: Line.return_, K["raise"]: Line.raise_,
    K["global"]: Line.names, K["nonlocal"]: Line.names, K["del"]: Line.del_, K["assert"]: Line.assert_, K["import"]: Line.import_,
    K["from"]: Line.from_, K["yield"]: Line.yield_,
}
_ALONE = frozenset(K[w] for w in "if for while try with def class".split())
_AFTER = {K["elif"]: frozenset((K["if"], K["elif"])), K["else"]: frozenset(K[w] for w in "if elif for while except try".split()),
          K["except"]: frozenset((K["try"], K["except"])), K["finally"]: frozenset(K[w] for w in "try except else".split())}
_SOFT = frozenset(("match", "case", "type"))

_SEEN: dict[tuple[str, str], tuple[bool, int, str]] = {}
_SEEN_MAX = 50_000


def _verdict(s: str, soft: str) -> tuple[bool, int, str]:
    """(wants a block, position of the error or -1, why)."""
    v = _SEEN.get((s, soft))
    if v is None:
        x = Line(s, soft)
        try:
            x.line()
            v = x.header, -1, ""
        except Bad as e:
            v = s.endswith(":"), min(e.p, len(s)), e.why
        if len(s) < 200:
            if len(_SEEN) >= _SEEN_MAX:
                _SEEN.clear()
            _SEEN[s, soft] = v
    return v


class PythonParser:
    """Blocks by indentation, lines by ``Line``; recovery drops a line that does not parse."""

    language = "python"

    def __init__(self, src: Source):
        self.src = src
        self.errors: list[tuple[int, str]] = []
        self.top: list[Node] = []
        #: (first significant token, its class string, indentation, first token)
        self.lines: list[tuple[int, str, int]] = []

    def split(self):
        """Logical lines: line ends inside brackets do not count."""
        src = self.src
        s, idx, toks = src.s, src.idx, src.toks
        opens, closes = _COUNT
        first, depth, indent = 0, 0, 0
        if s and s[0] != "\n" and toks[0][0] in " \t":
            indent = len(toks[0].expandtabs(8))
        out_s, out_idx, start_out = [], [], 0
        pos, n = 0, len(s)
        cur: list[str] = []
        while pos <= n:
            q = s.find("\n", pos)
            if q < 0:
                q = n
            seg = s[pos:q]
            if seg:
                depth += len(opens.findall(seg)) - len(closes.findall(seg))
                cur.append(seg)
                out_idx.extend(idx[pos:q])
            if depth <= 0 or q == n:
                if cur:
                    line = "".join(cur)
                    self.lines.append((start_out, line, indent))
                    start_out += len(line)
                    out_s.append(line)
                    cur = []
                if depth < 0:
                    depth = 0
                if q < n:
                    ws = toks[idx[q]]
                    indent = len(ws[ws.rindex("\n") + 1 :].replace("\f", "").expandtabs(8))
            pos = q + 1
        if depth > 0:
            self.errors.append((start_out - 1, "bracket never closed"))
        src.s, src.idx = "".join(out_s), out_idx

    def parse(self):
        self.split()
        src, errors = self.src, self.errors
        stack = [0]  #: indentations of the open blocks
        heads: list[str] = [""]  #: class that began the last compound statement at each level
        expect = False
        nodes: list[tuple[int, Node]] = []  #: open definitions with their level
        decorated = None
        last = 0
        for at, (a, s, indent) in enumerate(self.lines):
            c = s[0]
            if expect:
                if indent > stack[-1]:
                    stack.append(indent)
                    heads.append("")
                else:
                    errors.append((a, "expected an indented block"))
                expect = False
            if indent > stack[-1]:
                errors.append((a, "unexpected indent"))
                stack.append(indent)
                heads.append("")
            elif indent < stack[-1]:
                while indent < stack[-1]:
                    stack.pop()
                    heads.pop()
                if indent != stack[-1]:
                    errors.append((a, "unindent matches no outer level"))
                    stack.append(indent)
                    heads.append("")
            level = len(stack)
            while nodes and nodes[-1][0] >= level:
                nodes.pop()[1].end = last
            soft = ""
            if c == "i" and len(s) > 1:
                w = src.tok(a)
                if w in _SOFT:
                    soft = w
            header, bad, why = _verdict(s, soft)
            if bad >= 0:
                errors.append((a + bad, why))
            if c in _AFTER:
                if heads[-1] not in _AFTER[c]:
                    errors.append((a, "clause without the statement it belongs to"))
                heads[-1] = c
            elif c in _ALONE or c == K["async"]:
                if heads[-1] == K["try"]:
                    errors.append((a, "try without except or finally"))
                heads[-1] = s[1] if c == K["async"] and len(s) > 1 else c
            else:
                if heads[-1] == K["try"]:
                    errors.append((a, "try without except or finally"))
                heads[-1] = ""
            expect = header
            if decorated is not None and c not in ("@", K["def"], K["class"], K["async"]):
                errors.append((a, "expected a definition behind decorators"))
                decorated = None
            if c == "@":
                decorated = a if decorated is None else decorated
            is_async = c == K["async"]
            if (d := s[is_async : is_async + 1]) in (K["def"], K["class"]) and d:
                name_p = a + is_async + 1
                node = Node("function_definition" if d == K["def"] else "class_definition", src.tok(name_p), name_p, a, decorated)
                node.depth, node.body = len(nodes), at
                (nodes[-1][1].children if nodes else self.top).append(node)
                nodes.append((level, node))
                decorated = None
            last = a + len(s) - 1
        for _, n in nodes:
            n.end = last
        if expect:
            errors.append((max(0, len(src.idx) - 1), "expected an indented block"))
        if decorated is not None:
            errors.append((decorated, "expected a definition behind decorators"))
        if heads[-1] == K["try"] and not expect:
            errors.append((last, "try without except or finally"))
        return self


def lex_python(text: str):
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    toks = PY_PATTERN.findall(text)
    cl = CLASSES(toks)
    return Source(text, toks, "".join(cl).replace(" ", ""), [k for k, c in enumerate(cl) if c != " "])
