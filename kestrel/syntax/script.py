"""JavaScript, JSX, TypeScript and TSX."""

from __future__ import annotations

from kestrel.syntax.base import Bad, BraceParser, flat_pattern
from kestrel.syntax.lexing import JS_PATTERN, PUNCT, Classifier, keyword_classes, lex

K = keyword_classes(
    "if else for while do return throw break continue switch case default try catch finally var let const "
    "function class new delete typeof void in instanceof import export yield await async extends debugger with"
)
FIXED = PUNCT | K | dict.fromkeys(("this", "super", "null", "true", "false"), "v")
_W = "".join(K.values())
_NAME = frozenset("i" + K["async"] + K["await"] + K["yield"] + K["let"])
_KEY = frozenset("ivns#[" + _W)
_IN, _OF = K["in"], "of"
_VAR = frozenset((K["var"], K["let"], K["const"]))
_ENDS = frozenset(",;)]}:")
_PREFIX = frozenset("-+!~I" + K["typeof"] + K["void"] + K["delete"] + K["await"])
_MODIFIERS = frozenset("static public private protected readonly abstract async get set override declare accessor".split())
_NO_MODIFIER_BEFORE = frozenset("(=;:?!}<,\0")
_TYPE_WORDS = frozenset("keyof unique readonly infer asserts abstract".split())
_TYPE_START = frozenset("ivsn([{-<" + K["typeof"] + K["void"] + K["new"] + K["import"])


class ScriptParser(BraceParser):
    language = "javascript"
    typed = False
    markup = True
    flat = flat_pattern(
        f"[-+!~{K['typeof']}{K['void']}{K['delete']}{K['await']}]", "[insv]", f"[.Q][iv{_W}]|\\(\\)",
        f"[-+*/%&|^LCSW<{K['in']}{K['instanceof']}]|>{{1,3}}+",
    )
    precedence = {"L": 1, "|": 2, "^": 3, "&": 4, "C": 5, "<": 6, ">": 6, K["in"]: 6, K["instanceof"]: 6, "S": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9, "W": 10}
    starters = frozenset(K[w] for w in "if for while do return throw switch try var let const function class import export".split())

    def __init__(self, src):
        super().__init__(src)
        self.rules = {
            "{": lambda: self.block(self.statement), ";": self.empty, K["if"]: self.if_, K["for"]: self.for_, K["while"]: self.while_,
            K["do"]: self.do_, K["return"]: self.return_, K["throw"]: self.throw_, K["break"]: self.jump, K["continue"]: self.jump,
            K["switch"]: self.switch, K["try"]: self.try_, K["var"]: self.variables, K["let"]: self.variables, K["const"]: self.variables,
            K["function"]: self.function_declaration, K["class"]: self.class_declaration, K["import"]: self.import_, K["export"]: self.export,
            K["async"]: self.async_, K["debugger"]: self.jump, "@": self.decorated, K["with"]: self.while_,
        }

    # -- statements -----------------------------------------------------
    def statement(self):
        rule = self.rules.get(self.s[self.p])
        if rule:
            rule()
        else:
            self.expression_statement()

    def semi(self):
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c != "}" and c != "\0" and not self.newline_before(self.p):
            raise Bad(self.p, "expected ';' or a new line")

    def empty(self):
        self.p += 1

    def expression_statement(self):
        s, p = self.s, self.p
        if s[p] in _NAME:
            if s[p + 1] == ":":
                self.p += 2
                return self.statement()
            if self.typed and s[p + 1] in "is{" + K["class"] + K["function"] + K["const"] + K["let"] + K["var"] + K["async"] and self.typed_declaration():
                return
        self.expression()
        self.semi()

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
        self.take(";")

    def for_(self):
        s = self.s
        self.p += 1
        self.take(K["await"])
        self.need("(")
        if s[self.p] in _VAR:
            self.p += 1
            self.binding()
            if self.typed and self.take(":"):
                self.type_()
            if s[self.p] == _IN or self.word() == _OF:
                self.p += 1
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators(first=False)
        elif s[self.p] != ";":
            self.expression()
            if s[self.p] == "i" and self.word() == _OF:
                self.p += 1
                self.assign()
            if self.take(")"):
                return self.statement()
        self.need(";")
        if s[self.p] != ";":
            self.expression()
        self.need(";")
        if s[self.p] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def return_(self):
        self.p += 1
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c != "}" and c != "\0" and not self.newline_before(self.p):
            self.expression()
            self.semi()

    def throw_(self):
        self.p += 1
        self.expression()
        self.semi()

    def jump(self):
        self.p += 1
        if self.s[self.p] == "i" and not self.newline_before(self.p):
            self.p += 1
        self.semi()

    def switch(self):
        self.p += 1
        self.paren()
        self.need("{")
        s = self.s
        while not self.take("}"):
            if self.take(K["case"]):
                self.expression()
            else:
                self.need(K["default"], "case or default")
            self.need(":")
            while s[self.p] not in ("}", K["case"], K["default"]):
                if s[self.p] == "\0":
                    self.fail("expected '}'")
                self.statement()

    def try_(self):
        self.p += 1
        self.block(self.statement)
        caught = self.take(K["catch"])
        if caught:
            if self.take("("):
                self.binding()
                if self.typed and self.take(":"):
                    self.type_()
                self.need(")")
            self.block(self.statement)
        if self.take(K["finally"]):
            self.block(self.statement)
        elif not caught:
            self.fail("expected catch or finally")

    def variables(self):
        if self.typed and self.s[self.p] == K["const"] and self.word(self.p + 1) == "enum":
            self.p += 1
            return self.typed_declaration()
        const = self.s[self.p] == K["const"] and not self.typed
        self.p += 1
        self.declarators(const=const)
        self.semi()

    def declarators(self, first=True, const=False):
        s = self.s
        while True:
            if first:
                plain = s[self.p] == "i"
                self.binding()
                if self.typed:
                    self.take("!")
                    if self.take(":"):
                        self.type_()
            else:
                plain = True
            first = True
            if self.take("="):
                self.assign()
            elif const or not plain and not self.typed:
                self.fail("expected an initial value")
            if not self.take(","):
                return

    def binding(self):
        s = self.s
        c = s[self.p]
        if c in _NAME:
            self.p += 1
        elif c == "{":
            self.p += 1
            self.commas(self.binding_property, "}")
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("E")
                self.binding()
                if self.take("="):
                    self.assign()
                if s[self.p] != "]":
                    self.need(",")
        else:
            self.fail("expected a name")

    def binding_property(self):
        if self.take("E"):
            return self.binding()
        shorthand = self.s[self.p] in _NAME
        self.key()
        if self.take(":"):
            self.binding()
        elif not shorthand:
            self.fail("expected ':'")
        if self.take("="):
            self.assign()

    def key(self):
        c = self.s[self.p]
        if c not in _KEY:
            self.fail("expected a property name")
        self.p += 1
        if c == "[":
            self.assign()
            self.need("]")

    def decorators(self):
        while self.take("@"):
            if self.s[self.p] == "(":
                self.paren()
            else:
                self.need("i", "a name")
                while True:
                    if self.take("."):
                        self.need("i", "a name")
                    elif self.s[self.p] == "(":
                        self.arguments()
                    else:
                        break

    def decorated(self):
        start = self.p
        self.decorators()
        c = self.s[self.p]
        if c == K["export"]:
            self.export(start)
        elif c == K["class"]:
            self.class_declaration(start)
        elif self.typed and self.word() == "abstract":
            self.typed_declaration(start)
        else:
            self.fail("expected a class")

    def async_(self):
        if self.s[self.p + 1] == K["function"] and not self.newline_before(self.p + 1):
            self.function_declaration()
        else:
            self.expression_statement()

    def function_declaration(self, outer=None, kind="function_declaration", anonymous=False):
        start = self.p
        self.take(K["async"])
        self.p += 1
        if self.take("*"):
            kind = "generator_" + kind
        name = self.p if self.s[self.p] in _NAME else None
        if name is None and not anonymous:
            self.fail("expected a function name")
        node = self.open_node(kind, name, start, outer)
        self.p += name is not None
        self.signature()
        if self.typed and self.s[self.p] != "{":
            node.kind = "function_signature"
            self.semi()
        else:
            node.body = []
            self.block(self.statement)
        self.close_node(node)

    def signature(self):
        if self.typed and self.s[self.p] == "<":
            self.type_parameters()
        self.need("(")
        self.commas(self.parameter, ")")
        if self.typed and self.take(":"):
            self.type_()

    def parameter(self):
        s = self.s
        if s[self.p] == "@":
            self.decorators()
        if self.typed:
            while s[self.p] == "i" and s[self.p + 1] in "iv{[" and self.word() in _MODIFIERS:
                self.p += 1
            if s[self.p] == "v":
                self.p += 1
                self.need(":")
                return self.type_()
        self.take("E")
        self.binding()
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type_()
        if self.take("="):
            self.assign()

    def class_declaration(self, outer=None, kind="class_declaration", anonymous=False, start=None):
        s = self.s
        start = self.p if start is None else start
        self.need(K["class"])
        name = self.p if s[self.p] in _NAME and self.word() != "implements" else None
        if name is None and not anonymous:
            self.fail("expected a class name")
        node = self.open_node(kind, name, start, outer)
        self.p += name is not None
        if self.typed and s[self.p] == "<":
            self.type_parameters()
        if self.take(K["extends"]):
            self.unary()
            if self.typed and s[self.p] == "<":
                self.type_arguments()
        if self.typed and self.word() == "implements":
            self.p += 1
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        node.body = [(self.p - 1, self.p - 1, None)]
        self.statements("}", lambda: self.class_member(node))
        self.need("}")
        node.body.append((self.p - 1, self.p - 1, None))
        self.close_node(node)

    def class_member(self, owner):
        s, outer = self.s, self.p
        if self.take(";"):
            owner.body.append((outer, outer, None))
            return
        if s[self.p] == "@":
            self.decorators()
        start = self.p
        while (s[self.p] == "i" or s[self.p] == K["async"]) and s[self.p + 1] not in _NO_MODIFIER_BEFORE and self.word() in _MODIFIERS:
            self.p += 1
            if s[self.p] == "{" and self.word(self.p - 1) == "static":
                self.block(self.statement)
                owner.body.append((outer, self.p - 1, None))
                return
        self.take("*")
        if self.typed and s[self.p] == "[" and s[self.p + 1] == "i" and s[self.p + 2] == ":":
            self.type_member()
            self.semi()
            owner.body.append((outer, self.p - 1, None))
            return
        name = self.p
        self.key()
        if self.typed:
            self.take("?") or self.take("!")
        if s[self.p] == "(" or self.typed and s[self.p] == "<":
            node = self.open_node("method_definition", name, start, outer)
            self.signature()
            if self.typed and s[self.p] != "{":
                node.kind = "method_signature"
                self.semi()
            else:
                node.body = []
                self.block(self.statement)
            self.close_node(node)
            owner.body.append((outer, self.p - 1, node))
            return
        if self.typed and self.take(":"):
            self.type_()
        if self.take("="):
            self.assign()
        end = self.p - 1
        self.semi()
        owner.body.append((outer, end, None))

    def import_(self):
        s = self.s
        if s[self.p + 1] in "(.":
            return self.expression_statement()
        self.p += 1
        if self.take("s"):
            return self.attributes()
        if self.typed and self.word() == "type" and s[self.p + 1] in "i{*" and self.word(self.p + 1) != "from":
            self.p += 1
        if s[self.p] in _NAME:
            self.p += 1
            if self.typed and self.take("="):
                self.expression()
                return self.semi()
            if s[self.p] != "i":
                self.need(",")
                self.import_names()
        else:
            self.import_names()
        self.from_()

    def import_names(self):
        if self.take("*"):
            self.as_()
        else:
            self.need("{", "imported names")
            self.commas(self.specifier, "}")

    def as_(self):
        if self.word() != "as":
            self.fail("expected as")
        self.p += 1
        if self.s[self.p] not in _KEY or self.s[self.p] in "n[":
            self.fail("expected a name")
        self.p += 1

    def specifier(self):
        s = self.s
        if self.typed and self.word() == "type" and s[self.p + 1] in "i" + _W and self.word(self.p + 1) != "as":
            self.p += 1
        if s[self.p] not in _KEY or s[self.p] in "n[":
            self.fail("expected a name")
        self.p += 1
        if s[self.p] == "i":
            self.as_()

    def from_(self):
        if self.word() != "from":
            self.fail("expected from")
        self.p += 1
        self.need("s", "a module name")
        self.attributes()

    def attributes(self):
        if (self.word() in ("with", "assert")) and self.s[self.p + 1] == "{":
            self.p += 1
            self.object_()
        self.semi()

    def export(self, outer=None):
        s = self.s
        outer = self.p if outer is None else outer
        self.p += 1
        c = s[self.p]
        if c == "@":
            self.decorators()
            c = s[self.p]
        if self.take(K["default"]):
            c = s[self.p]
            if c == K["function"] or c == K["async"] and s[self.p + 1] == K["function"]:
                self.function_declaration(outer, anonymous=True)
            elif c == K["class"]:
                self.class_declaration(outer, anonymous=True)
            elif self.typed and c == "i" and s[self.p + 1] in "i" + K["class"] and self.typed_declaration(outer):
                return
            else:
                self.assign()
                self.semi()
        elif c == "*":
            self.p += 1
            if self.word() == "as":
                self.as_()
            self.from_()
        elif c == "{" or self.typed and c == "i" and s[self.p + 1] in "{*" and self.word() == "type":
            self.p += c == "i"
            if self.take("*"):
                self.from_()
                return
            self.p += 1
            self.commas(self.specifier, "}")
            if self.word() == "from":
                self.from_()
            else:
                self.semi()
        elif c in _VAR:
            self.variables()
        elif c == K["function"] or c == K["async"] and s[self.p + 1] == K["function"]:
            self.function_declaration(outer)
        elif c == K["class"]:
            self.class_declaration(outer)
        elif self.typed and c == "=":
            self.p += 1
            self.expression()
            self.semi()
        elif self.typed and c == K["import"]:
            self.import_()
        elif self.typed and c == "i" and self.typed_declaration(outer):
            return
        else:
            self.fail("expected something to export")

    # -- expressions ----------------------------------------------------
    def expression(self):
        self.assign()
        while self.s[self.p] == ",":
            self.p += 1
            self.assign()

    def assign(self):
        s, p = self.s, self.p
        m = self.flat.match(s, p)
        if m:
            self.p = q = m.end()
            d = s[q]
            if d in _ENDS:
                return
            if d == "R" and q == p + 1 and s[p] == "i":
                return self.arrow_body()
            self.postfix()
        else:
            c = s[p]
            if c == K["yield"]:
                self.p += 1
                if self.take("*") or s[self.p] not in ")]},;:\0" and not self.newline_before(self.p):
                    self.assign()
                return
            if c == K["async"] and self.async_arrow():
                return
            if (c == "(" or c == "<") and self.arrow():
                return
            self.unary()
        self.climb()

    def climb(self):
        """What may follow a first operand: operators, a condition, an assignment."""
        s = self.s
        while True:
            c = s[self.p]
            if c in self.precedence:
                if c == ">" and s[self.p + 1] in ">C":
                    q = self.p
                    while s[q] == ">":
                        q += 1
                    if s[q] == "C" and self.word(q) == ">=":
                        self.p = q + 1
                        return self.assign()
                    self.p = q - 1
                self.p += 1
                if not self.run():
                    self.binary(self.precedence[c] + 1)
                else:
                    self.postfix()
            elif c == "i" and self.typed and self.word() in ("as", "satisfies") and not self.newline_before(self.p):
                self.p += 1
                if not self.take(K["const"]):
                    self.type_()
            else:
                break
        if c == "?":
            self.p += 1
            self.assign()
            self.need(":")
            self.assign()
        elif c == "=" or c == "A":
            self.p += 1
            self.assign()

    def arrow_body(self):
        self.need("R", "=>")
        if self.s[self.p] == "{":
            self.block(self.statement)
        else:
            self.assign()

    def async_arrow(self) -> bool:
        s, p = self.s, self.p
        if s[p + 1] in _NAME and s[p + 2] == "R":
            self.p += 2
            self.arrow_body()
            return True
        if s[p + 1] in "(<":
            self.p += 1
            if self.arrow():
                return True
            self.p = p
        return False

    def arrow(self) -> bool:
        """An arrow function whose parameters stand in brackets, if there is one here."""
        s, p = self.s, self.p
        if s[p] == "(":
            j = self.closing(p)
            if j < 0 or s[j + 1] != "R" and not (self.typed and s[j + 1] == ":"):
                return False
            if s[j + 1] == "R":
                self.signature()
                self.arrow_body()
                return True
        elif not self.typed:
            return False

        def head():
            self.signature()
            if s[self.p] != "R":
                self.fail("expected =>")

        if self.attempt(head):
            self.arrow_body()
            return True
        return False

    def unary(self):
        s = self.s
        while s[self.p] in _PREFIX:
            self.p += 1
        self.primary()
        self.postfix()

    def primary(self):
        s = self.s
        c = s[self.p]
        if c in "insv" or c in _NAME and c != K["await"]:
            if c == K["async"] and s[self.p + 1] == K["function"]:
                return self.function_expression()
            self.p += 1
        elif c == "(":
            self.p += 1
            self.expression()
            self.need(")")
        elif c == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("E")
                self.assign()
                if s[self.p] != "]":
                    self.need(",")
        elif c == "{":
            self.object_()
        elif c == K["function"]:
            self.function_expression()
        elif c == K["class"]:
            self.class_declaration(kind="class", anonymous=True)
        elif c == K["new"]:
            self.p += 1
            if self.take("."):
                self.need("i", "target")
            else:
                self.primary()
                while s[self.p] in ".[":
                    self.member()
                if self.typed and s[self.p] == "<":
                    self.attempt(self.type_arguments)
                if s[self.p] == "(":
                    self.arguments()
        elif c == K["import"]:
            self.p += 1
            if s[self.p] not in "(.":
                self.fail("expected '('")
        elif c == "<" and self.markup:
            self.element()
        elif c == "<" and self.typed:
            self.type_arguments()
            self.unary()
        elif c == "@":
            self.decorators()
            self.class_declaration(kind="class", anonymous=True)
        else:
            self.fail("expected an expression" if c != "X" else "unterminated or stray token")

    def function_expression(self):
        self.function_declaration(kind="function_expression", anonymous=True)

    def member(self):
        s = self.s
        c = s[self.p]
        self.p += 1
        if c == "[":
            self.expression()
            self.need("]")
        else:
            if s[self.p] not in _KEY or s[self.p] in "ns[":
                if c == "Q" and s[self.p] in "([":
                    return
                self.fail("expected a member name")
            self.p += 1

    def postfix(self):
        s = self.s
        while True:
            c = s[self.p]
            if c in ".[Q":
                self.member()
            elif c == "(":
                self.arguments()
            elif c == "s" and self.word()[0] == "`":
                self.p += 1
            elif c == "I" and not self.newline_before(self.p):
                self.p += 1
                return
            elif c == "!" and self.typed and not self.newline_before(self.p):
                self.p += 1
            elif c == "<" and self.typed and self.attempt(self.generic_call):
                pass
            else:
                return

    def generic_call(self):
        self.type_arguments()
        if self.s[self.p] != "(":
            self.fail("expected '('")

    def arguments(self):
        self.need("(")
        self.commas(self.argument, ")")

    def argument(self):
        self.take("E")
        self.assign()

    def object_(self):
        self.need("{")
        self.commas(self.property_, "}")

    def property_(self):
        s = self.s
        if self.take("E"):
            return self.assign()
        start = self.p
        while (s[self.p] == K["async"] or s[self.p] == "i" and self.word() in ("get", "set")) and s[self.p + 1] in "*ivns#[" + _W:
            self.p += 1
        self.take("*")
        name, shorthand = self.p, s[self.p] in _NAME or s[self.p] == "v"
        self.key()
        if s[self.p] == "(" or self.typed and s[self.p] == "<":
            node = self.open_node("method_definition", name, start)
            self.signature()
            node.body = []
            self.block(self.statement)
            self.close_node(node)
        elif self.take(":"):
            self.assign()
        elif not shorthand:
            self.fail("expected ':'")
        elif self.take("="):
            self.assign()

    # -- markup ---------------------------------------------------------
    def tag_name(self):
        s = self.s
        if s[self.p] not in "iv" and s[self.p] not in _W:
            self.fail("expected an element name")
        while True:
            self.p += 1
            if s[self.p] in ".:-" and s[self.p + 1] != ">":
                self.p += 1
            else:
                return

    def element(self):
        s = self.s
        self.need("<")
        if not self.take(">"):
            at = self.p
            self.tag_name()
            name = s[at : self.p], [self.word(k) for k in range(at, self.p)]
            while s[self.p] not in "/>":
                if s[self.p] == "{":
                    self.p += 1
                    self.need("E", "'...'")
                    self.assign()
                    self.need("}")
                else:
                    self.tag_name()
                    if self.take("="):
                        if s[self.p] == "{":
                            self.p += 1
                            self.assign()
                            self.need("}")
                        elif s[self.p] == "<":
                            self.element()
                        else:
                            self.need("s", "an attribute value")
            if self.take("/"):
                return self.need(">")
            self.p += 1
        else:
            name = None
        while True:
            c = s[self.p]
            if c == "{":
                self.p += 1
                if s[self.p] != "}":
                    self.take("E")
                    self.expression()
                self.need("}")
            elif c == "<":
                if s[self.p + 1] == "/":
                    self.p += 2
                    if name:
                        at = self.p
                        self.tag_name()
                        if [self.word(k) for k in range(at, self.p)] != name[1]:
                            raise Bad(at, "closing tag of another element")
                    return self.need(">")
                self.element()
            elif c in "\0}>":
                self.fail("unclosed element")
            else:
                self.p += 1


class TypedScriptParser(ScriptParser):
    language = "typescript"
    typed = True
    markup = False
    #: without < and >, which may enclose type arguments
    flat = flat_pattern(
        f"[-+!~{K['typeof']}{K['void']}{K['delete']}{K['await']}]", "[insv]", f"[.Q][iv{_W}]|\\(\\)",
        f"[-+*/%&|^LCSW{K['in']}{K['instanceof']}]",
    )

    def typed_declaration(self, outer=None) -> bool:
        """Declarations that begin with a contextual word; says whether there was one."""
        s, p = self.s, self.p
        outer = p if outer is None else outer
        w, c = self.word(), s[p + 1]
        if self.newline_before(p + 1):
            return False
        if w == "type" and c == "i":
            self.p += 2
            if s[self.p] == "<":
                self.type_parameters()
            self.need("=")
            self.type_()
            self.semi()
        elif w == "interface" and c == "i":
            node = self.open_node("interface_declaration", p + 1, p, outer)
            self.p += 2
            if s[self.p] == "<":
                self.type_parameters()
            if self.take(K["extends"]):
                self.type_()
                while self.take(","):
                    self.type_()
            node.body = []
            self.type_body(node.body)
            self.close_node(node)
        elif w == "enum" and c == "i":
            self.p += 2
            self.need("{")
            self.commas(self.enum_member, "}")
        elif w in ("namespace", "module") and c in "is":
            self.p += 2
            while self.take("."):
                self.need("i", "a name")
            self.block(self.statement)
        elif w == "abstract" and c == K["class"]:
            self.p += 1
            self.class_declaration(outer, "abstract_class_declaration", start=p)
        elif w == "declare":
            self.p += 1
            if self.word() == "global":
                self.p += 1
                self.block(self.statement)
            else:
                self.statement()
        elif w == "global" and c == "{":
            self.p += 1
            self.block(self.statement)
        else:
            return False
        return True

    def enum_member(self):
        self.key()
        if self.take("="):
            self.assign()

    def type_parameters(self):
        self.need("<")
        self.commas(self.type_parameter, ">")

    def type_parameter(self):
        s = self.s
        while s[self.p] in (K["const"], _IN) or self.word() == "out" and s[self.p + 1] == "i":
            self.p += 1
        self.need("i", "a type parameter")
        if self.take(K["extends"]):
            self.type_()
        if self.take("="):
            self.type_()

    def type_arguments(self):
        self.need("<")
        self.commas(self.type_, ">", trailing=False)

    def type_(self):
        s = self.s
        if s[self.p] in "|&":
            self.p += 1
        self.type_operand()
        while s[self.p] in "|&":
            self.p += 1
            self.type_operand()
        if s[self.p] == K["extends"] and not self.newline_before(self.p):
            self.p += 1
            self.type_operand()
            while s[self.p] in "|&":
                self.p += 1
                self.type_operand()
            if self.take("?"):
                self.type_()
                self.need(":")
                self.type_()

    def type_operand(self):
        s = self.s
        while s[self.p] == "i" and s[self.p + 1] in _TYPE_START - {"<"} and self.word() in _TYPE_WORDS and not self.newline_before(self.p + 1):
            self.p += 1
        c = s[self.p]
        if c == "(" or c == "<":
            j = self.closing(self.p) if c == "(" else -2
            if j == -2 or j > 0 and s[j + 1] == "R":
                self.signature()
                self.need("R", "=>")
                return self.type_()
            self.p += 1
            self.type_()
            self.need(")")
        elif c == K["new"]:
            self.p += 1
            self.signature()
            self.need("R", "=>")
            return self.type_()
        elif c == "[":
            self.p += 1
            self.commas(self.tuple_member, "]")
        elif c == "{":
            self.type_body([])
        elif c == "-":
            self.p += 1
            self.need("n", "a number")
        elif c == K["typeof"]:
            self.p += 1
            if s[self.p] == K["import"]:
                return self.type_operand()
            if s[self.p] not in "iv":
                self.fail("expected a name")
            self.p += 1
        elif c == K["import"]:
            self.p += 1
            self.need("(")
            self.need("s", "a module name")
            self.need(")")
        elif c in "ivsn" or c == K["void"]:
            self.p += 1
            if c in "iv" and s[self.p] == "i" and self.word() == "is" and not self.newline_before(self.p):
                self.p += 1
                return self.type_()
        else:
            self.fail("expected a type")
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if s[self.p] not in "iv" and s[self.p] not in _W:
                    self.fail("expected a type name")
                self.p += 1
            elif c == "<" and not self.newline_before(self.p):
                self.type_arguments()
            elif c == "[" and not self.newline_before(self.p):
                self.p += 1
                if not self.take("]"):
                    self.type_()
                    self.need("]")
            else:
                return

    def tuple_member(self):
        s = self.s
        self.take("E")
        if s[self.p] in _NAME and (s[self.p + 1] == ":" or s[self.p + 1] == "?" and s[self.p + 2] == ":"):
            self.p += 1
            self.take("?")
            self.p += 1
        self.type_()
        self.take("?")

    def type_body(self, body: list):
        self.need("{")
        s = self.s
        while not self.take("}"):
            start = self.p
            self.type_member()
            body.append((start, self.p - 1, None))
            if s[self.p] in ",;":
                self.p += 1
            elif s[self.p] != "}" and not self.newline_before(self.p):
                self.fail("expected ';'")

    def type_member(self):
        s = self.s
        if s[self.p] in "+-" and self.word(self.p + 1) == "readonly":
            self.p += 1
        while s[self.p] in "i" + K["async"] and self.word() in ("readonly", "get", "set", "async") and s[self.p + 1] in "ivns[" + _W:
            self.p += 1
        if s[self.p] in "(<" or s[self.p] == K["new"] and s[self.p + 1] in "(<":
            self.take(K["new"])
            return self.signature()
        if s[self.p] == "[" and s[self.p + 1] == "i" and s[self.p + 2] in (":", _IN):
            self.p += 3
            self.type_()
            if self.word() == "as":
                self.p += 1
                self.type_()
            self.need("]")
        else:
            self.key()
        if s[self.p] in "+-" and s[self.p + 1] == "?":
            self.p += 1
        self.take("?")
        if s[self.p] in "(<":
            self.signature()
        elif self.take(":"):
            self.type_()


class TypedMarkupParser(TypedScriptParser):
    language = "tsx"
    markup = True


CLASSES = Classifier(FIXED)


def lex_script(text: str):
    if text.startswith("#!"):
        n = (text + "\n").index("\n")
        text = "//" + text[2:n][: max(0, n - 2)] + text[n:]
    return lex(text, JS_PATTERN, CLASSES)
