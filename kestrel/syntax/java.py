"""Java."""

from __future__ import annotations

import re

from kestrel.syntax.base import BraceParser, flat_pattern
from kestrel.syntax.lexing import JAVA_PATTERN, PUNCT, Classifier, keyword_classes, lex

K = keyword_classes(
    "if else for while do return throw break continue switch case default try catch finally new instanceof "
    "class interface enum extends implements throws package import assert super synchronized "
    "public private protected static final abstract native transient volatile strictfp "
    "int long short byte char boolean float double void"
)
FIXED = PUNCT | K | dict.fromkeys(("this", "null", "true", "false"), "v")
for _gone in ("=>", "...", "===", "!==", "??", "?.", "**", "#", "`"):
    if _gone not in ("...",):
        FIXED[_gone] = "X"
PRIM = "".join(K[w] for w in "int long short byte char boolean float double void".split())
MODS = frozenset(K[w] for w in "public private protected static final abstract native transient volatile strictfp synchronized default".split())
_W = "".join(K.values())
_TYPE = f"(?:[{PRIM}]|i(?:\\.i)*+(?:<[i.,?<>\\[\\]&@{PRIM}{K['extends']}{K['super']}]*+>(?<=>))?+(?:\\.i)*+)(?:\\[\\])*+"
TYPE = re.compile(_TYPE)
# possessive runs inside angle brackets would also take the last '>', so they are matched greedily here
_TYPE = f"(?:[{PRIM}]|i(?:\\.i)*+(?:<[i.,?<>\\[\\]&@{PRIM}{K['extends']}{K['super']}]*>)?(?:\\.i)*+)(?:\\[\\])*+"
LOCAL = re.compile(_TYPE + r"i(?:\[\])*[=;:,]")
CAST_PRIM = re.compile(rf"\([{PRIM}](?:\[\])*\)")
CAST = re.compile(rf"\({_TYPE}(?:&{_TYPE})*\)(?=[insv(!~{K['new']}{K['switch']}{K['super']}])")
PATTERN_VAR = re.compile(rf"{_TYPE}i")
REFERENCE = re.compile(rf"{_TYPE}D(?:i|{K['new']})")
LAMBDA_END = re.compile("P")


class JavaParser(BraceParser):
    language = "java"
    flat = flat_pattern("[-+!~]", "[insv]", r"\.[iv]|\(\)|I", "[-+*/%&|^LCS<]|>{1,3}+")
    precedence = {"L": 1, "|": 2, "^": 3, "&": 4, "C": 5, "<": 6, ">": 6, K["instanceof"]: 6, "S": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
    starters = frozenset(K[w] for w in "if for while do return throw switch try public private protected class".split())

    def __init__(self, src):
        super().__init__(src)
        self.in_label = False
        self.rules = {
            "{": lambda: self.block(self.statement), ";": self.empty, K["if"]: self.if_, K["for"]: self.for_, K["while"]: self.while_,
            K["do"]: self.do_, K["return"]: self.return_, K["throw"]: self.throw_, K["break"]: self.jump, K["continue"]: self.jump,
            K["switch"]: self.switch_statement, K["try"]: self.try_, K["synchronized"]: self.synchronized, K["assert"]: self.assert_,
            K["final"]: self.local, K["abstract"]: self.local, "@": self.local, K["class"]: self.local, K["interface"]: self.local, K["enum"]: self.local, K["static"]: self.local,
        }

    # -- declarations ---------------------------------------------------
    def top_statement(self):
        s = self.s
        c = s[self.p]
        if c == "}":
            return super().top_statement()
        if c == ";":
            self.p += 1
        elif c == K["package"]:
            self.p += 1
            self.name()
            self.need(";")
        elif c == K["import"]:
            self.p += 1
            self.take(K["static"])
            self.need("i", "a name")
            while self.take("."):
                if self.take("*"):
                    break
                self.need("i", "a name")
            self.need(";")
        else:
            start = self.p
            self.modifiers()
            if s[self.p] == K["package"]:
                return self.top_statement()
            if not self.type_declaration(start):
                self.fail("expected a type declaration")

    def name(self):
        self.need("i", "a name")
        while self.s[self.p] == "." and self.s[self.p + 1] == "i":
            self.p += 2

    def modifiers(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == "@" and s[self.p + 1] == "i":
                self.annotation()
            elif c in MODS:
                if c == K["default"] and s[self.p + 1] in ":P":
                    return
                self.p += 1
            elif c == "i" and s[self.p + 1] in (K["class"], K["interface"], K["abstract"], K["public"], K["static"], "i") and self.word() == "sealed":
                self.p += 1
            elif c == "i" and s[self.p + 1] == "-" and self.word() == "non":
                self.p += 3
            else:
                return

    def annotation(self):
        self.p += 1
        self.name()
        if self.take("("):
            self.commas(self.element_pair, ")", trailing=False)

    def element_pair(self):
        if self.s[self.p] == "i" and self.s[self.p + 1] == "=":
            self.p += 2
        self.element_value()

    def element_value(self):
        c = self.s[self.p]
        if c == "@":
            self.annotation()
        elif c == "{":
            self.p += 1
            self.commas(self.element_value, "}")
        else:
            self.ternary()

    def type_declaration(self, outer, start=None) -> bool:
        s = self.s
        c = s[self.p]
        if c in (K["class"], K["interface"], K["enum"]):
            kind = {K["class"]: "class_declaration", K["interface"]: "interface_declaration", K["enum"]: "enum_declaration"}[c]
        elif c == "@" and s[self.p + 1] == K["interface"]:
            self.p += 1
            kind = "annotation_type_declaration"
        elif c == "i" and s[self.p + 1] == "i" and s[self.p + 2] in "(<" and self.word() == "record":
            kind = "record_declaration"
        else:
            return False
        self.p += 1
        if s[self.p] != "i":
            self.fail("expected a type name")
        node = self.open_node(kind, self.p, outer if start is None else start, outer)
        self.p += 1
        if s[self.p] == "<":
            self.type_parameters()
        if kind[0] == "r":
            self.parameters()
        if self.take(K["extends"]):
            self.types()
        if self.take(K["implements"]):
            self.types()
        if s[self.p] == "i" and self.word() == "permits":
            self.p += 1
            self.types()
        self.class_body(node, kind == "enum_declaration")
        self.close_node(node)
        return True

    def types(self):
        self.type_()
        while self.take(","):
            self.type_()

    def type_parameters(self):
        self.need("<")
        self.commas(self.type_parameter, ">", trailing=False)

    def type_parameter(self):
        while self.s[self.p] == "@":
            self.annotation()
        self.need("i", "a type parameter")
        if self.take(K["extends"]):
            self.type_()
            while self.take("&"):
                self.type_()

    def type_(self):
        s = self.s
        while s[self.p] == "@":
            self.annotation()
        if s[self.p] in PRIM:
            self.p += 1
        else:
            self.need("i", "a type")
            while True:
                if s[self.p] == "<":
                    self.p += 1
                    self.commas(self.type_argument, ">", trailing=False)
                elif s[self.p] == "." and s[self.p + 1] == "i":
                    self.p += 2
                else:
                    break
        while s[self.p] == "[" and s[self.p + 1] == "]":
            self.p += 2

    def type_argument(self):
        if self.take("?"):
            if self.take(K["extends"]) or self.take(K["super"]):
                self.type_()
        else:
            self.type_()

    def class_body(self, node, enum=False):
        s = self.s
        self.need("{")
        if node is not None:
            node.body = [(self.p - 1, self.p - 1, None)]
        if enum:
            while s[self.p] not in ";}":
                while s[self.p] == "@":
                    self.annotation()
                self.need("i", "a constant")
                if s[self.p] == "(":
                    self.arguments()
                if s[self.p] == "{":
                    self.class_body(None)
                if not self.take(","):
                    break
            if not self.take(";") and s[self.p] != "}":
                self.fail("expected ',' or '}'")
        self.statements("}", lambda: self.member(node))
        self.need("}")
        if node is not None:
            node.body.append((self.p - 1, self.p - 1, None))

    def member(self, owner):
        s, start = self.s, self.p
        note = (lambda n=None: owner.body.append((start, self.p - 1, n))) if owner is not None else (lambda n=None: None)
        if self.take(";"):
            return note()
        if s[start] == K["static"] and s[start + 1] == "{" or s[start] == "{":
            self.p += s[start] != "{"
            self.block(self.statement)
            return note()
        while s[self.p] == "@" and s[self.p + 1] == "i":
            self.annotation()
        begin = self.p
        self.modifiers()
        if self.type_declaration(start, begin):
            return note((self.scope[-1].children if self.scope else self.top)[-1])
        if s[self.p] == "<":
            self.type_parameters()
        if s[self.p] == "i" and s[self.p + 1] in "({":
            node = self.open_node("constructor_declaration", self.p, begin, start)
            self.p += 1
            if s[self.p] == "(":
                self.parameters()
            if self.take(K["throws"]):
                self.types()
            self.block(self.statement)
            self.close_node(node)
            return note(node)
        self.type_()
        if s[self.p] == "i" and s[self.p + 1] == "(":
            node = self.open_node("method_declaration", self.p, begin, start)
            self.p += 1
            self.parameters()
            while s[self.p] == "[" and s[self.p + 1] == "]":
                self.p += 2
            if self.take(K["throws"]):
                self.types()
            if self.take(K["default"]):
                self.element_value()
            if not self.take(";"):
                node.body = []
                self.block(self.statement)
            self.close_node(node)
            return note(node)
        self.declarators()
        self.need(";")
        note()

    def parameters(self):
        self.need("(")
        self.commas(self.parameter, ")", trailing=False)

    def parameter(self):
        s = self.s
        self.modifiers()
        self.type_()
        self.take("E")
        if s[self.p] == "v":
            self.p += 1
            return
        self.need("i", "a parameter name")
        while s[self.p] == "[" and s[self.p + 1] == "]":
            self.p += 2

    def declarators(self):
        s = self.s
        while True:
            self.need("i", "a name")
            while s[self.p] == "[" and s[self.p + 1] == "]":
                self.p += 2
            if self.take("="):
                self.initial()
            if not self.take(","):
                return

    def initial(self):
        if self.s[self.p] == "{":
            self.p += 1
            self.commas(self.initial, "}")
        else:
            self.expression()

    # -- statements -----------------------------------------------------
    def statement(self):
        s = self.s
        c = s[self.p]
        rule = self.rules.get(c)
        if rule:
            return rule()
        if c == "i":
            d = s[self.p + 1]
            if d == ":":
                self.p += 2
                return self.statement()
            if d == "i" and s[self.p + 2] == "=":  # the usual local variable
                self.p += 1
                self.declarators()
                return self.need(";")
            if d in ".<[i" and LOCAL.match(s, self.p):
                self.type_()
                self.declarators()
                return self.need(";")
            if d == "i" and s[self.p + 2] in "(<" and self.word() == "record":
                return self.local()
            if self.word() == "yield" and d not in "=.([":
                self.p += 1
        elif c in PRIM and s[self.p + 1] not in ".D" and s[self.p + 1 : self.p + 4] != "[].":
            self.type_()
            self.declarators()
            return self.need(";")
        self.expression()
        self.need(";")

    def empty(self):
        self.p += 1

    def local(self):
        start = self.p
        self.modifiers()
        if not self.type_declaration(start):
            self.type_()
            self.declarators()
            self.need(";")

    def paren(self):
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self):
        self.p += 1
        self.paren()
        self.statement()
        if self.take(K["else"]):
            self.statement()

    def while_(self):
        self.p += 1
        self.paren()
        self.statement()

    def do_(self):
        self.p += 1
        self.statement()
        self.need(K["while"], "while")
        self.paren()
        self.need(";")

    def for_(self):
        s = self.s
        self.p += 1
        self.need("(")
        if s[self.p] in (K["final"], "@") or s[self.p] in PRIM or LOCAL.match(s, self.p):
            self.modifiers()
            self.type_()
            if s[self.p] == "i" and s[self.p + 1] == ":":
                self.p += 2
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        elif s[self.p] != ";":
            self.expressions()
        self.need(";")
        if s[self.p] != ";":
            self.expression()
        self.need(";")
        if s[self.p] != ")":
            self.expressions()
        self.need(")")
        self.statement()

    def expressions(self):
        self.expression()
        while self.take(","):
            self.expression()

    def return_(self):
        self.p += 1
        if self.s[self.p] != ";":
            self.expression()
        self.need(";")

    def throw_(self):
        self.p += 1
        self.expression()
        self.need(";")

    def jump(self):
        self.p += 1
        self.take("i")
        self.need(";")

    def assert_(self):
        self.p += 1
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def synchronized(self):
        self.p += 1
        self.paren()
        self.block(self.statement)

    def switch_statement(self):
        self.switch()
        if self.s[self.p] in ".":
            self.postfix()
            self.need(";")

    def switch(self):
        s = self.s
        self.p += 1
        self.paren()
        self.need("{")
        while not self.take("}"):
            if self.take(K["default"]):
                pass
            else:
                self.need(K["case"], "case or default")
                self.label()
                while self.take(","):
                    if not self.take(K["default"]):
                        self.label()
                if s[self.p] == "i" and self.word() == "when":
                    self.p += 1
                    self.binary(1)
            if self.take("P"):
                if s[self.p] == "{":
                    self.block(self.statement)
                elif s[self.p] == K["throw"]:
                    self.throw_()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while s[self.p] not in ("}", K["case"], K["default"]):
                if s[self.p] == "\0":
                    self.fail("expected '}'")
                self.statement()

    def label(self):
        if not self.attempt(self.pattern):
            self.in_label = True  # an arrow behind a constant belongs to the case
            try:
                self.binary(1)
            finally:
                self.in_label = False

    def pattern(self):
        s = self.s
        self.modifiers()
        self.type_()
        if self.take("("):
            self.commas(self.pattern, ")", trailing=False)
            if s[self.p] == "i" and self.word() != "when":
                self.p += 1
        else:
            if s[self.p] == "i" and self.word() == "when":
                self.fail("no pattern")
            self.need("i", "a name")

    def try_(self):
        s = self.s
        self.p += 1
        some = False
        if self.take("("):
            some = True
            while not self.take(")"):
                self.modifiers()
                if LOCAL.match(s, self.p):
                    self.type_()
                    self.declarators()
                else:
                    self.expression()
                if s[self.p] != ")":
                    self.need(";")
        self.block(self.statement)
        while self.take(K["catch"]):
            some = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.need("i", "a name")
            self.need(")")
            self.block(self.statement)
        if self.take(K["finally"]):
            some = True
            self.block(self.statement)
        if not some:
            self.fail("expected catch or finally")

    # -- expressions ----------------------------------------------------
    def expression(self):
        s, p = self.s, self.p
        m = self.flat.match(s, p)
        if m:
            q = m.end()
            d = s[q]
            if d == "P" and q == p + 1 and s[p] == "i":
                self.p = q
                return self.lambda_body()
            if d in ",;)":
                self.p = q
                return
            if d in "D<[" and REFERENCE.match(s, p):
                return self.reference()
            self.p = q
            self.postfix()
        else:
            self.unary()
        self.climb()

    def reference(self):
        self.p = REFERENCE.match(self.s, self.p).end()

    def lambda_body(self):
        self.need("P", "->")
        if self.s[self.p] == "{":
            self.block(self.statement)
        else:
            self.expression()

    def ternary(self):
        self.binary(1)
        if self.take("?"):
            self.expression()
            self.need(":")
            self.expression()

    def climb(self):
        s = self.s
        while (c := s[self.p]) in self.precedence:
            if c == ">" and s[self.p + 1] in ">C":
                q = self.p
                while s[q] == ">":
                    q += 1
                if s[q] == "C" and self.word(q) == ">=":
                    self.p = q + 1
                    return self.expression()
                self.p = q - 1
            self.p += 1
            if c == K["instanceof"]:
                self.take(K["final"])
                if not self.attempt(self.pattern):
                    self.type_()
            else:
                self.binary(self.precedence[c] + 1)
        if c == "?":
            self.p += 1
            self.expression()
            self.need(":")
            self.expression()
        elif c == "=" or c == "A":
            self.p += 1
            self.expression()

    def binary(self, least):
        self.unary()
        s, prec = self.s, self.precedence
        while (k := prec.get(s[self.p])) is not None and k >= least:
            c = s[self.p]
            if c == ">" and s[self.p + 1] in ">C":
                return
            self.p += 1
            if c == K["instanceof"]:
                self.take(K["final"])
                if not self.attempt(self.pattern):
                    self.type_()
            else:
                self.binary(k + 1)

    def unary(self):
        s = self.s
        while s[self.p] in "-+!~I":
            self.p += 1
        if s[self.p] == "(":
            if (m := CAST_PRIM.match(s, self.p)) or (m := CAST.match(s, self.p)):
                if s[m.end()] != "P":
                    self.p = m.end()
                    return self.expression() if self.is_lambda() else self.unary()
        self.primary()
        self.postfix()

    def is_lambda(self) -> bool:
        s = self.s
        return s[self.p] == "i" and s[self.p + 1] == "P" or s[self.p] == "(" and (j := self.closing(self.p)) > 0 and s[j + 1] == "P"

    def primary(self):
        s = self.s
        c = s[self.p]
        if c in "insv":
            if c == "i" and s[self.p + 1] == "P" and not self.in_label:
                self.p += 1
                return self.lambda_body()
            if c == "i" and s[self.p + 1] in "<[.D" and REFERENCE.match(s, self.p):
                return self.reference()
            self.p += 1
        elif c == "(":
            j = self.closing(self.p)
            if j > 0 and s[j + 1] == "P":
                if s[self.p + 1] == "i" and s[self.p + 2] in ",)":
                    self.p += 1
                    self.commas(lambda: self.need("i", "a name"), ")", trailing=False)
                else:
                    self.parameters()
                return self.lambda_body()
            self.p += 1
            self.expression()
            self.need(")")
        elif c == K["new"]:
            self.p += 1
            while s[self.p] == "@":
                self.annotation()
            if s[self.p] in PRIM:
                self.p += 1
            else:
                self.name()
                if self.take("<"):
                    self.commas(self.type_argument, ">", trailing=False)
                while self.take("."):
                    self.need("i", "a name")
                    if self.take("<"):
                        self.commas(self.type_argument, ">", trailing=False)
            if s[self.p] == "(":
                self.arguments()
                if s[self.p] == "{":
                    self.class_body(None)
            elif s[self.p] == "[":
                while self.take("["):
                    if not self.take("]"):
                        self.expression()
                        self.need("]")
                if s[self.p] == "{":
                    self.initial()
            else:
                self.fail("expected '(' or '['")
        elif c == K["switch"]:
            self.switch()
        elif c == K["super"]:
            self.p += 1
            if s[self.p] not in ".(D":
                self.fail("expected '.'")
        elif c in PRIM:
            self.type_()
            if self.take("D"):
                self.need(K["new"], "new")
            else:
                self.need(".")
                self.need(K["class"], "class")
        else:
            self.fail("expected an expression" if c != "X" else "unterminated or stray token")

    def postfix(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if self.take("<"):
                    self.commas(self.type_argument, ">", trailing=False)
                d = s[self.p]
                if d == K["new"]:
                    self.primary()
                elif d in "iv" or d in (K["class"], K["super"]):
                    self.p += 1
                else:
                    self.fail("expected a member name")
            elif c == "(":
                self.arguments()
            elif c == "[":
                self.p += 1
                if s[self.p] == "]":
                    while self.take("]"):
                        self.take("[")
                    self.need(".")
                    self.need(K["class"], "class")
                else:
                    self.expression()
                    self.need("]")
            elif c == "I":
                self.p += 1
            elif c == "D":
                self.p += 1
                if not self.take("i"):
                    self.need(K["new"], "a method name")
            else:
                return

    def arguments(self):
        self.need("(")
        self.commas(self.expression, ")", trailing=False)


CLASSES = Classifier(FIXED)


def lex_java(text: str):
    return lex(text, JAVA_PATTERN, CLASSES)
