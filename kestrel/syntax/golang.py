"""Go."""

from __future__ import annotations

from kestrel.syntax.base import BraceParser, flat_pattern
from kestrel.syntax.lexing import GO_PATTERN, PUNCT, Classifier, keyword_classes, lex_go

K = keyword_classes(
    "if else for range return break continue goto fallthrough switch select case default defer go "
    "func type struct interface map chan var const package import"
)
FIXED = PUNCT | K | dict.fromkeys(("nil", "true", "false"), "v") | {":=": "Z", "<-": "Y", "&^": "*", ">>": "S", ">>=": "A"}
for _gone in ("=>", "->", "===", "!==", "??", "?.", "::", "**", "@", "?", "#", "??=", "**=", "//=", "@="):
    FIXED[_gone] = "X"
_ENDERS = frozenset((K["break"], K["continue"], K["fallthrough"], K["return"]))
_TYPE_START = frozenset("i*[(Y" + K["func"] + K["map"] + K["chan"] + K["struct"] + K["interface"])


class GoParser(BraceParser):
    language = "go"
    flat = flat_pattern(r"[-+!^&*Y]", "[insv]", r"\.i|\(\)", r"[-+*/%&|^LCS<>]")
    precedence = {"L": 1, "C": 2, "<": 2, ">": 2, "+": 3, "-": 3, "|": 3, "^": 3, "*": 4, "/": 4, "%": 4, "S": 4, "&": 4}
    starters = frozenset(K[w] for w in "if for return switch select defer go func type var const".split())

    def __init__(self, src):
        super().__init__(src)
        self.bare = False  #: in the head of if, for or switch, where { begins the block
        self.stage = 0
        self.rules = {
            "{": self.inner_block, K["if"]: self.if_, K["for"]: self.for_, K["return"]: self.return_, K["switch"]: self.switch,
            K["select"]: self.select, K["defer"]: self.call_statement, K["go"]: self.call_statement, K["break"]: self.jump,
            K["continue"]: self.jump, K["goto"]: self.jump, K["fallthrough"]: self.jump, K["var"]: self.variables, K["const"]: self.variables,
            K["type"]: self.types,
        }

    def semi(self):
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c not in "})\0":
            self.fail("expected ';' or a new line")

    def top_statement(self):
        c = self.s[self.p]
        if self.stage == 0 and c != ";":
            self.stage = 1
            self.need(K["package"], "package")
            self.need("i", "a package name")
            self.semi()
        elif c == K["import"]:
            self.p += 1
            self.group(self.import_spec)
        elif c == K["func"]:
            self.function()
        elif c in (K["var"], K["const"]):
            self.variables()
        elif c == K["type"]:
            self.types()
        elif c == ";":
            self.p += 1
        elif c == "}":
            super().top_statement()
        else:
            self.fail("expected a declaration")

    def group(self, rule):
        if self.take("("):
            while not self.take(")"):
                if self.take(";"):
                    continue
                rule()
                self.semi()
        else:
            rule()
        self.semi()

    def import_spec(self):
        if self.s[self.p] in "i.":
            self.p += 1
        self.need("s", "an import path")

    def function(self):
        s, start = self.s, self.p
        self.p += 1
        kind = "function_declaration"
        if s[self.p] == "(":
            kind = "method_declaration"
            self.parameters()
        if s[self.p] != "i":
            self.fail("expected a function name")
        node = self.open_node(kind, self.p, start)
        self.p += 1
        if s[self.p] == "[":
            self.type_parameters()
        self.signature()
        if s[self.p] == "{":
            node.body = []
            self.bare = False
            self.block(self.statement)
        self.close_node(node)
        self.semi()

    def signature(self):
        self.parameters()
        c = self.s[self.p]
        if c == "(":
            self.parameters()
        elif c in _TYPE_START:
            self.type_()

    def parameters(self):
        self.need("(")
        self.commas(self.parameter, ")")

    def parameter(self):
        s = self.s
        if s[self.p] == "i" and (s[self.p + 1] in _TYPE_START or s[self.p + 1] == "E") and self.attempt(self.named_parameter):
            return
        self.take("E")
        self.type_()

    def named_parameter(self):
        self.p += 1
        self.take("E")
        self.type_()
        if self.s[self.p] not in ",)":
            self.fail("expected ','")

    def type_parameters(self):
        self.need("[")
        self.commas(self.type_parameter, "]")

    def type_parameter(self):
        self.need("i", "a type parameter")
        if self.s[self.p] not in ",]":
            self.constraint()

    def constraint(self):
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def type_(self):
        s = self.s
        c = s[self.p]
        if c == "i":
            self.p += 1
            if s[self.p] == "." and s[self.p + 1] == "i":
                self.p += 2
            if s[self.p] == "[" and s[self.p + 1] in _TYPE_START and s[self.p + 1] != "]":
                self.attempt(self.type_arguments)
        elif c == "*":
            self.p += 1
            self.type_()
        elif c == "(":
            self.p += 1
            self.type_()
            self.need(")")
        elif c == "[":
            self.p += 1
            if not self.take("]"):
                if not self.take("E"):
                    self.expression()
                self.need("]")
            self.type_()
        elif c == K["map"]:
            self.p += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif c == K["chan"]:
            self.p += 1
            self.take("Y")
            self.type_()
        elif c == "Y":
            self.p += 1
            self.need(K["chan"], "chan")
            self.type_()
        elif c == K["func"]:
            self.p += 1
            self.signature()
        elif c == K["struct"]:
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if not self.take(";"):
                    self.field()
                    self.semi()
        elif c == K["interface"]:
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if self.take(";"):
                    continue
                if s[self.p] == "i" and s[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        else:
            self.fail("expected a type")

    def type_arguments(self):
        self.need("[")
        self.commas(self.type_, "]")

    def field(self):
        s = self.s
        if s[self.p] == "i" and s[self.p + 1] not in ".;s}":
            self.p += 1
            while self.take(","):
                self.need("i", "a field name")
            self.type_()
        else:
            self.take("*")
            self.type_()
        self.take("s")

    def variables(self):
        const = self.s[self.p] == K["const"]
        self.p += 1
        self.group(self.constant if const else self.variable)

    def names(self):
        self.need("i", "a name")
        while self.take(","):
            self.need("i", "a name")

    def variable(self):
        self.names()
        if self.s[self.p] != "=":
            self.type_()
        if self.take("="):
            self.expressions()

    def constant(self):
        self.names()
        if self.s[self.p] not in "=;)":
            self.type_()
        if self.take("="):
            self.expressions()

    def types(self):
        self.p += 1
        self.group(self.type_spec)

    def type_spec(self):
        s = self.s
        self.need("i", "a type name")
        if s[self.p] == "[" and s[self.p + 1] == "i" and s[self.p + 2] != "]":
            self.attempt(self.type_parameters)
        self.take("=")
        self.type_()

    # -- statements -----------------------------------------------------
    def statement(self):
        s = self.s
        c = s[self.p]
        if c == ";":
            self.p += 1
            return
        rule = self.rules.get(c)
        if rule:
            return rule()
        if c == "i" and s[self.p + 1] == ":":
            self.p += 2
            return None if s[self.p] == "}" else self.statement()
        self.simple()
        self.semi()

    def simple(self):
        """Says whether it was ``... range x``."""
        s = self.s
        self.expression()
        while self.take(","):
            self.expression()
        c = s[self.p]
        if c in "=ZA":
            self.p += 1
            if self.take(K["range"]):
                self.expression()
                return True
            self.expressions()
        elif c == "I":
            self.p += 1
        elif c == "Y":
            self.p += 1
            self.expression()
        return False

    def inner_block(self):
        self.block(self.statement)
        self.semi()

    def body(self):
        self.bare = False
        self.block(self.statement)

    def if_(self):
        self.if_head()
        self.semi()

    def if_head(self):
        self.p += 1
        self.bare = True
        if not self.take(";"):
            self.simple()
            if self.take(";"):
                self.simple()
        else:
            self.simple()
        self.body()
        if self.take(K["else"]):
            if self.s[self.p] == K["if"]:
                self.if_head()
            else:
                self.body()

    def for_(self):
        s = self.s
        self.p += 1
        self.bare = True
        if s[self.p] != "{":
            ranged = False
            if self.take(K["range"]):
                self.expression()
                ranged = True
            elif s[self.p] != ";":
                ranged = self.simple()
            if not ranged and self.take(";"):
                if s[self.p] != ";":
                    self.simple()
                self.need(";")
                if s[self.p] != "{":
                    self.simple()
        self.body()
        self.semi()

    def return_(self):
        self.p += 1
        if self.s[self.p] not in ";}":
            self.expressions()
        self.semi()

    def call_statement(self):
        self.p += 1
        self.expression()
        self.semi()

    def jump(self):
        self.p += 1
        self.take("i")
        self.semi()

    def switch(self):
        s = self.s
        self.p += 1
        self.bare = True
        if s[self.p] != "{":
            if s[self.p] != ";":
                self.simple()
            if self.take(";") and s[self.p] != "{":
                self.simple()
        self.bare = False
        self.cases(self.case_types)

    def case_types(self):
        if not self.attempt(self.case_expressions):
            self.type_()
            while self.take(","):
                if not self.attempt(self.expression):
                    self.type_()

    def case_expressions(self):
        self.expressions()
        if self.s[self.p] != ":":
            self.fail("expected ':'")

    def cases(self, head):
        s = self.s
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if not self.take(K["default"]):
                self.need(K["case"], "case or default")
                head()
            self.need(":")
            while s[self.p] not in ("}", K["case"], K["default"]):
                if s[self.p] == "\0":
                    self.fail("expected '}'")
                self.statement()
        self.semi()

    def select(self):
        self.p += 1
        self.cases(self.simple)

    # -- expressions ----------------------------------------------------
    def expressions(self):
        self.expression()
        while self.s[self.p] == ",":
            self.p += 1
            self.expression()

    def expression(self):
        s = self.s
        m = self.flat.match(s, self.p)
        if m:
            self.p = q = m.end()
            if s[q] in ",;):=Z":
                return
            self.postfix()
        else:
            self.unary()
        while (k := self.precedence.get(s[self.p])) is not None:
            self.p += 1
            self.binary(k + 1)

    def unary(self):
        s = self.s
        while s[self.p] in "-+!^&*Y" or s[self.p] == "L" and self.word() == "&&":
            self.p += 1
        self.primary()
        self.postfix()

    def primary(self):
        s = self.s
        c = s[self.p]
        if c in "insv":
            self.p += 1
        elif c == "(":
            self.p += 1
            bare, self.bare = self.bare, False
            if not self.attempt(self.inner):
                self.type_()
            self.bare = bare
            self.need(")")
        elif c == K["func"]:
            self.p += 1
            self.signature()
            if s[self.p] == "{":
                bare, self.bare = self.bare, False
                self.block(self.statement)
                self.bare = bare
        elif c in "[" or c in (K["map"], K["struct"], K["chan"], K["interface"]):
            self.type_()
            if s[self.p] == "{":
                self.literal()
        else:
            self.fail("expected an expression" if c != "X" else "unterminated or stray token")

    def inner(self):
        self.expression()
        if self.s[self.p] != ")":
            self.fail("expected ')'")

    def literal(self):
        bare, self.bare = self.bare, False
        self.need("{")
        self.commas(self.element, "}")
        self.bare = bare

    def element(self):
        self.value()
        if self.take(":"):
            self.value()

    def value(self):
        if self.s[self.p] == "{":
            self.literal()
        else:
            self.expression()

    def postfix(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == "(":
                self.p += 1
                bare, self.bare = self.bare, False
                self.commas(self.argument, ")")
                self.bare = bare
            elif c == ".":
                self.p += 1
                if self.take("("):
                    if not self.take(K["type"]):
                        self.type_()
                    self.need(")")
                else:
                    self.need("i", "a member name")
            elif c == "[":
                self.index()
            elif c == "{" and not self.bare and s[self.p - 1] in "i]":
                self.literal()
            else:
                return

    def argument(self):
        if not self.attempt(self.value_argument):
            self.type_()

    def value_argument(self):
        self.expression()
        self.take("E")
        if self.s[self.p] not in ",)":
            self.fail("expected ',' or ')'")

    def index(self):
        self.p += 1
        bare, self.bare = self.bare, False
        s = self.s
        parts = 0
        while s[self.p] != "]":
            if s[self.p] == ":":
                self.p += 1
                parts += 1
                continue
            if not self.attempt(self.index_value):
                self.type_()
            if s[self.p] == ",":
                self.p += 1
            elif s[self.p] not in ":]":
                self.fail("expected ']'")
        if s[self.p - 1] == "[":
            self.fail("expected an index")
        self.p += 1
        self.bare = bare

    def index_value(self):
        self.expression()
        if self.s[self.p] not in ":],":
            self.fail("expected ']'")


CLASSES = Classifier(FIXED, newline="\n")


def lex_golang(text: str):
    return lex_go(text, GO_PATTERN, CLASSES, _ENDERS)
