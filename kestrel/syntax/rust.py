"""Rust."""

from __future__ import annotations

from kestrel.syntax.base import BraceParser, flat_pattern
from kestrel.syntax.lexing import PUNCT, RUST_PATTERN, Classifier, keyword_classes, lex

K = keyword_classes(
    "if else for while loop match return break continue let mut ref fn struct enum trait impl use mod pub const static type "
    "extern unsafe async await where as in move dyn crate"
)
FIXED = PUNCT | K | dict.fromkeys(("true", "false"), "v") | {"..": "G", "..=": "G"}
for _gone in ("===", "!==", "??", "?.", "**", "~", "++", "--", "**=", "//=", "@=", "&^=", "&&=", "||=", "??="):
    FIXED[_gone] = "X"
_ITEMS = frozenset(K[w] for w in "fn struct enum trait impl use mod pub const static type extern".split()) | {"#"}
_BLOCKS = frozenset("{" + "".join(K[w] for w in "if for while loop match unsafe".split()))
_SEG = frozenset("i" + K["crate"])
_PRIMARY_START = frozenset("insv([{-!*&L|" + "".join(K[w] for w in "if match loop while for unsafe return break continue move async crate".split()) + "<D'")


class RustParser(BraceParser):
    language = "rust"
    flat = flat_pattern(f"[-!*]|&{K['mut']}?+", "[insv]", r"\.[in]|Di|\(\)|\?", r"[-+*/%&|^LCS<]|>{1,2}+")
    precedence = {"L": 1, "C": 2, "<": 2, ">": 2, "|": 3, "^": 4, "&": 5, "S": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}
    starters = frozenset(K[w] for w in "if for while loop match return let fn struct enum trait impl use mod pub".split())

    def __init__(self, src):
        super().__init__(src)
        self.bare = False

    # -- items ----------------------------------------------------------
    def top_statement(self):
        c = self.s[self.p]
        if c == "}":
            return super().top_statement()
        if c == ";":
            self.p += 1
        elif not self.item():
            self.fail("expected an item")

    def attributes(self):
        s = self.s
        while s[self.p] == "#" and (s[self.p + 1] == "[" or s[self.p + 1 : self.p + 3] == "!["):
            self.p += 1 + (s[self.p + 1] == "!")
            self.tree()

    def tree(self):
        """A bracketed token tree, as in macro calls and attributes."""
        j = self.closing(self.p)
        if self.s[self.p] not in "([{" or j < 0:
            self.fail("expected a token tree" if self.s[self.p] not in "([{" else "unclosed bracket")
        if "X" in self.s[self.p : j]:
            self.fail("stray token")
        self.p = j + 1

    def visibility(self):
        s = self.s
        if self.take(K["pub"]) and s[self.p] == "(" and (s[self.p + 1] in _SEG or s[self.p + 1] == K["in"]):
            self.p = self.closing(self.p) + 1 or self.p

    def item(self, inside=None) -> bool:
        s, outer = self.s, self.p
        self.attributes()
        start = self.p
        self.visibility()
        c = s[self.p]
        if c == K["crate"] or c == "i":
            w = self.word()
            if w == "macro_rules" and s[self.p + 1] == "!":
                self.p += 2
                self.need("i", "a macro name")
                brace = s[self.p] == "{"
                self.tree()
                return brace or self.take(";") or True
            if w == "union" and s[self.p + 1] == "i" and s[self.p + 2] in "{<":
                return self.record(start, outer, "union_item")
            if inside is None and self.depth0() and (s[self.p + 1] == "!" or s[self.p + 1] == "D"):
                self.path()
                self.need("!")
                brace = s[self.p] == "{"
                self.tree()
                if not brace:
                    self.need(";")
                return True
            if w == "auto" and s[self.p + 1] == K["trait"]:
                self.p += 1
                c = s[self.p]
            else:
                return self.no_item(outer, start)
        q = self.p
        while s[q] in (K["const"], K["async"], K["unsafe"], K["extern"]) or s[q] == "s" and s[q - 1] == K["extern"]:
            q += 1
        if s[q] == K["fn"]:
            self.p = q
            self.function(start, outer)
        elif c == K["use"]:
            self.p += 1
            self.use_tree()
            self.need(";")
        elif c == K["mod"] or s[q] == K["mod"]:
            self.p = q + 1
            self.need("i", "a module name")
            if not self.take(";"):
                self.block(self.top_statement)
        elif c == K["struct"]:
            self.record(start, outer, "struct_item")
        elif c == K["enum"]:
            self.enum(start, outer)
        elif s[q] == K["trait"]:
            self.p = q
            node = self.open_node("trait_item", q + 1, start, outer)
            self.p += 1
            self.need("i", "a trait name")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            node.body = []
            self.items(node)
            self.close_node(node)
        elif s[q] == K["impl"]:
            self.p = q
            self.impl(start, outer)
        elif c == K["type"]:
            self.p += 1
            self.need("i", "a type name")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type_()
            self.where()
            self.need(";")
        elif c == K["static"] or c == K["const"] and s[self.p + 1] in "i" + K["mut"]:
            self.p += 1
            self.take(K["mut"])
            self.need("i", "a name")
            self.need(":")
            self.type_()
            if self.take("="):
                self.expression()
            self.need(";")
        elif c == K["extern"] or c == K["unsafe"] and s[q - 1] in (K["extern"], "s"):
            self.p = q
            if s[self.p] == K["crate"]:
                self.p += 1
                self.need("i", "a crate name")
                if self.take(K["as"]):
                    self.need("i", "a name")
                self.need(";")
            else:
                self.block(self.top_statement)
        else:
            return self.no_item(outer, start)
        return True

    def depth0(self) -> bool:
        return not self.scope

    def no_item(self, outer, start) -> bool:
        if self.p != start:
            self.fail("expected an item")
        self.p = outer
        return False

    def use_tree(self):
        s = self.s
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                return self.commas(self.use_tree, "}")
            if s[self.p] == "D":
                self.p += 1
                continue
            if s[self.p] not in _SEG:
                self.fail("expected a name")
            self.p += 1
            if self.take("D"):
                continue
            if self.take(K["as"]):
                self.need("i", "a name")
            return

    def generics(self):
        if self.take("<"):
            self.commas(self.generic, ">")

    def generic(self):
        self.attributes()
        if self.take("'"):
            if self.take(":"):
                self.bounds()
            return
        const = self.take(K["const"])
        self.need("i", "a type parameter")
        if self.take(":"):
            if const:
                self.type_()
            else:
                self.bounds()
        if self.take("="):
            self.type_argument()

    def bounds(self):
        s = self.s
        while True:
            if s[self.p] == "'":
                self.p += 1
            elif s[self.p] in "i?D(~" or s[self.p] in (K["for"], K["crate"], K["dyn"]):
                if self.take("("):
                    self.bounds()
                    self.need(")")
                else:
                    self.take("?")
                    self.type_no_plus()
            else:
                return
            if not self.take("+"):
                return

    def where(self):
        s = self.s
        if self.take(K["where"]):
            while s[self.p] not in "{;=":
                if not self.take("'"):
                    self.type_no_plus()
                self.need(":")
                self.bounds()
                if not self.take(","):
                    break

    def function(self, start, outer):
        s = self.s
        self.need(K["fn"], "fn")
        if s[self.p] != "i":
            self.fail("expected a function name")
        node = self.open_node("function_item", self.p, start, outer)
        self.p += 1
        self.generics()
        self.need("(")
        self.commas(self.parameter, ")")
        if self.take("P"):
            self.type_()
        self.where()
        if self.take(";"):
            node.kind = "function_signature_item"
        else:
            node.body = []
            bare, self.bare = self.bare, False
            self.block(self.statement)
            self.bare = bare
        self.close_node(node)

    def parameter(self):
        s = self.s
        self.attributes()
        q = self.p
        if s[q] == "&":
            q += 1
            q += s[q] == "'"
        q += s[q] == K["mut"]
        if s[q] == "i" and self.word(q) == "self" and s[q + 1] in ",):":
            self.p = q + 1
            if self.take(":"):
                self.type_()
            return
        if s[self.p] == "E":
            self.p += 1
            return
        self.pattern()
        self.need(":")
        self.type_()

    def record(self, start, outer, kind):
        s = self.s
        node = self.open_node(kind, self.p + 1, start, outer)
        self.p += 1
        self.need("i", "a type name")
        self.generics()
        self.where()
        if self.take("("):
            self.commas(self.tuple_field, ")")
            self.where()
            self.need(";")
        elif s[self.p] == "{":
            node.body = []
            self.fields(node.body)
        else:
            self.need(";")
        self.close_node(node)
        return True

    def tuple_field(self):
        self.attributes()
        self.visibility()
        self.type_()

    def fields(self, body=None):
        self.need("{")

        def field():
            start = self.p
            self.attributes()
            self.visibility()
            self.need("i", "a field name")
            self.need(":")
            self.type_()
            if body is not None:
                body.append((start, self.p - 1, None))

        self.commas(field, "}")

    def enum(self, start, outer):
        node = self.open_node("enum_item", self.p + 1, start, outer)
        self.p += 1
        self.need("i", "a type name")
        self.generics()
        self.where()
        self.need("{")
        self.commas(self.variant, "}")
        self.close_node(node)

    def variant(self):
        self.attributes()
        self.need("i", "a variant")
        if self.take("("):
            self.commas(self.tuple_field, ")")
        elif self.s[self.p] == "{":
            self.fields()
        if self.take("="):
            self.expression()

    def impl(self, start, outer):
        node = self.open_node("impl_item", None, start, outer)
        self.p += 1
        if self.s[self.p] == "<":
            self.generics()
        self.take("!")
        self.type_no_plus()
        if self.take(K["for"]):
            self.type_no_plus()
        self.where()
        node.body = []
        self.items(node)
        self.close_node(node)

    def items(self, owner):
        s = self.s
        self.need("{")
        owner.body.append((self.p - 1, self.p - 1, None))

        def member():
            start = self.p
            before = len(owner.children)
            q = self.p
            if s[q] == "i" and self.word() == "default":
                self.p += 1
            if s[self.p] == "i" and s[self.p + 1] in "!D":
                self.path()
                self.need("!")
                self.tree()
                self.take(";")
            elif not self.item(owner):
                self.fail("expected an item")
            owner.body.append((start, self.p - 1, owner.children[-1] if len(owner.children) > before else None))

        self.statements("}", member)
        self.need("}")
        owner.body.append((self.p - 1, self.p - 1, None))

    # -- types ----------------------------------------------------------
    def type_(self):
        self.type_no_plus()
        if self.s[self.p] == "+":
            self.p += 1
            self.bounds()

    def type_no_plus(self):
        s = self.s
        c = s[self.p]
        if c == "&" or c == "L" and self.word() == "&&":
            self.p += 1
            self.take("'")
            self.take(K["mut"])
            self.type_no_plus()
        elif c == "*":
            self.p += 1
            if not self.take(K["const"]):
                self.need(K["mut"], "const or mut")
            self.type_no_plus()
        elif c == "(":
            self.p += 1
            self.commas(self.type_, ")")
        elif c == "[":
            self.p += 1
            self.type_()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif c == "!":
            self.p += 1
        elif c in (K["dyn"], K["impl"]):
            self.p += 1
            self.bounds()
        elif c == K["for"]:
            self.p += 1
            self.generics()
            self.type_no_plus()
        elif c in (K["fn"], K["unsafe"], K["extern"]):
            self.take(K["unsafe"])
            if self.take(K["extern"]):
                self.take("s")
            self.need(K["fn"], "fn")
            self.need("(")
            self.commas(self.fn_type_parameter, ")")
            if self.take("P"):
                self.type_no_plus()
        elif c == "<":
            self.qualified()
            while self.take("D"):
                self.type_segment()
        else:
            self.take("D")
            self.type_segment()
            while self.take("D"):
                self.type_segment()
            if self.s[self.p] == "!" and s[self.p + 1] in "([{":
                self.p += 1
                self.tree()

    def fn_type_parameter(self):
        if self.s[self.p] == "i" and self.s[self.p + 1] == ":":
            self.p += 2
        if not self.take("E"):
            self.type_()

    def qualified(self):
        self.need("<")
        self.type_()
        if self.take(K["as"]):
            self.type_()
        self.need(">")

    def type_segment(self):
        s = self.s
        if s[self.p] not in _SEG:
            self.fail("expected a type")
        self.p += 1
        if s[self.p] == "D" and s[self.p + 1] == "<":
            self.p += 1
        if s[self.p] == "<":
            self.p += 1
            self.commas(self.type_argument, ">")
        elif s[self.p] == "(":
            self.p += 1
            self.commas(self.type_, ")")
            if self.take("P"):
                self.type_no_plus()

    def type_argument(self):
        s = self.s
        c = s[self.p]
        if c in "'nsv":
            self.p += 1
        elif c == "-":
            self.p += 1
            self.need("n", "a number")
        elif c == "{":
            self.block(self.statement)
        else:
            self.type_()
            if self.take("="):
                self.type_()
            elif self.take(":"):
                self.bounds()

    # -- patterns -------------------------------------------------------
    def pattern(self):
        self.take("|")
        self.one_pattern()
        while self.take("|"):
            self.one_pattern()

    def one_pattern(self):
        s = self.s
        c = s[self.p]
        if c in "nsv" or c == "-" and s[self.p + 1] == "n":
            self.p += 1 + (c == "-")
            self.range_end()
        elif c == "&" or c == "L" and self.word() == "&&":
            self.p += 1
            self.take(K["mut"])
            self.one_pattern()
        elif c == "(" or c == "[":
            self.p += 1
            self.commas(self.pattern, ")" if c == "(" else "]")
        elif c == "G":
            self.p += 1
            if s[self.p] in "ns":
                self.p += 1
        elif c in (K["ref"], K["mut"]):
            self.take(K["ref"])
            self.take(K["mut"])
            self.need("i", "a name")
            if self.take("@"):
                self.one_pattern()
        elif c in _SEG or c in "<D":
            self.path()
            if self.take("!"):
                self.tree()
            elif self.take("("):
                self.commas(self.pattern, ")")
            elif s[self.p] == "{":
                self.p += 1
                self.commas(self.field_pattern, "}")
            elif self.take("@"):
                self.one_pattern()
            else:
                self.range_end()
        else:
            self.fail("expected a pattern")

    def range_end(self):
        s = self.s
        if self.take("G"):
            self.take("-")
            if s[self.p] in "nsv":
                self.p += 1
            elif s[self.p] in _SEG:
                self.path()

    def field_pattern(self):
        s = self.s
        self.attributes()
        if self.take("G"):
            return
        if s[self.p] in "in" and s[self.p + 1] == ":":
            self.p += 2
            return self.pattern()
        self.take(K["ref"])
        self.take(K["mut"])
        self.need("i", "a field")

    # -- statements -----------------------------------------------------
    def statement(self):
        s = self.s
        c = s[self.p]
        if c == ";":
            self.p += 1
        elif c == K["let"]:
            self.let()
        elif c in _ITEMS and not (c == K["const"] and s[self.p + 1] == "{") and self.item(self):
            return
        else:
            if c == "#":
                self.attributes()
                c = s[self.p]
                if c == K["let"]:
                    return self.let()
            if c in (K["unsafe"], K["async"], "i") and s[self.p + 1] in (K["fn"], K["unsafe"], K["impl"], K["trait"], K["extern"], "!", "i") and self.item(self):
                return
            start = self.p
            blocky = c in _BLOCKS or c == "'" and s[self.p + 1] == ":"
            if blocky:
                self.block_like()
                if s[self.p] not in ".?":
                    self.take(";")
                    return
                self.postfix()
                self.climb()
            else:
                self.expression()
            if s[self.p] == ";":
                self.p += 1
            elif s[self.p] != "}" and not (s[self.p - 1] == "}" and (blocky or s[start + 1] == "!" or s[start] in _SEG and "!" in s[start : start + 8])):
                self.fail("expected ';' or '}'")

    def let(self):
        self.p += 1
        self.pattern()
        if self.take(":"):
            self.type_()
        if self.take("="):
            self.expression()
            if self.take(K["else"]):
                self.block(self.statement)
        self.need(";")

    def block_like(self):
        s = self.s
        if self.take("'"):
            self.need(":")
        c = s[self.p]
        if c == "{":
            bare, self.bare = self.bare, False
            self.block(self.statement)
            self.bare = bare
        elif c == K["if"]:
            self.p += 1
            self.condition()
            self.body()
            if self.take(K["else"]):
                if s[self.p] == K["if"]:
                    self.block_like()
                else:
                    self.body()
        elif c == K["match"]:
            self.p += 1
            self.head()
            self.need("{")
            bare, self.bare = self.bare, False
            while not self.take("}"):
                self.attributes()
                self.pattern()
                if self.take(K["if"]):
                    self.let_chain()
                self.need("R", "=>")
                block = s[self.p] == "{"
                self.expression()
                if not self.take(",") and s[self.p] != "}" and not (block or s[self.p - 1] == "}"):
                    self.fail("expected ','")
            self.bare = bare
        elif c == K["while"]:
            self.p += 1
            self.condition()
            self.body()
        elif c == K["for"]:
            self.p += 1
            self.pattern()
            self.need(K["in"], "in")
            self.head()
            self.body()
        elif c in (K["loop"], K["unsafe"]):
            self.p += 1
            self.body()
        else:
            self.fail("expected a block")

    def body(self):
        bare, self.bare = self.bare, False
        self.block(self.statement)
        self.bare = bare

    def head(self):
        bare, self.bare = self.bare, True
        self.expression()
        self.bare = bare

    def condition(self):
        bare, self.bare = self.bare, True
        self.let_chain()
        self.bare = bare

    def let_chain(self):
        while True:
            if self.take(K["let"]):
                self.pattern()
                self.need("=")
                self.binary(2)
            else:
                self.expression()
            if not (self.s[self.p] == "L" and self.word() == "&&"):
                return
            self.p += 1

    # -- expressions ----------------------------------------------------
    def expression(self):
        s = self.s
        m = self.flat.match(s, self.p)
        if m:
            self.p = q = m.end()
            if s[q] in ",;)":
                return
            self.postfix()
        else:
            self.unary()
        self.climb()

    def climb(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == "L" and s[self.p + 1] == K["let"]:
                return
            if c in self.precedence:
                if c == ">" and s[self.p + 1] in ">C":
                    q = self.p
                    while s[q] == ">":
                        q += 1
                    if s[q] == "C" and self.word(q) == ">=":
                        self.p = q + 1
                        return self.expression()
                    self.p = q - 1
                self.p += 1
                self.binary(self.precedence[c] + 1)
            elif c == K["as"]:
                self.p += 1
                self.type_no_plus()
            else:
                break
        if c == "G":
            self.p += 1
            if s[self.p] in _PRIMARY_START and not (self.bare and s[self.p] == "{"):
                self.binary(1)
        elif c == "=" or c == "A":
            self.p += 1
            self.expression()

    def binary(self, least):
        self.unary()
        s, prec = self.s, self.precedence
        while True:
            c = s[self.p]
            if c == K["as"]:
                self.p += 1
                self.type_no_plus()
                continue
            k = prec.get(c)
            if k is None or k < least or c == "L" and s[self.p + 1] == K["let"] or c == ">" and s[self.p + 1] in ">C":
                return
            self.p += 1
            self.binary(k + 1)

    def unary(self):
        s = self.s
        while True:
            c = s[self.p]
            if c in "-!*":
                self.p += 1
            elif c == "&" or c == "L" and self.word() == "&&":
                self.p += 1
                if s[self.p] == "i" and s[self.p + 1] in (K["const"], K["mut"]) and self.word() == "raw":
                    self.p += 2
                self.take(K["mut"])
            else:
                break
        self.primary()
        self.postfix()

    def path(self):
        s = self.s
        if s[self.p] == "<":
            self.qualified()
            self.need("D", "'::'")
        else:
            self.take("D")
        while True:
            if s[self.p] not in _SEG:
                self.fail("expected a name")
            self.p += 1
            if s[self.p] == "D":
                self.p += 1
                if s[self.p] == "<":
                    self.p += 1
                    self.commas(self.type_argument, ">")
                    if not self.take("D"):
                        return
            else:
                return

    def primary(self):
        s = self.s
        c = s[self.p]
        if c in "nsv":
            self.p += 1
        elif c in _SEG or c in "<D":
            self.path()
        elif c == "(" or c == "[":
            end = ")" if c == "(" else "]"
            self.p += 1
            bare, self.bare = self.bare, False
            while s[self.p] != end:
                self.attributes()
                self.expression()
                if s[self.p] == "," or s[self.p] == ";" and c == "[":
                    self.p += 1
                elif s[self.p] != end:
                    self.fail(f"expected {end!r}")
            self.p += 1
            self.bare = bare
        elif c in _BLOCKS or c == "'":
            self.block_like()
        elif c in (K["async"], K["const"]) and s[self.p + 1] in "{" + K["move"] and (s[self.p + 1] == "{" or s[self.p + 2] == "{"):
            self.p += 1
            self.take(K["move"])
            self.body()
        elif c in "|L" or c in (K["move"], K["async"], K["static"]):
            self.closure()
        elif c in (K["return"], K["break"]):
            self.p += 1
            self.take("'")
            if s[self.p] in _PRIMARY_START and not (self.bare and s[self.p] == "{"):
                self.expression()
        elif c == K["continue"]:
            self.p += 1
            self.take("'")
        elif c == "G":
            self.p += 1
            if s[self.p] in _PRIMARY_START and not (self.bare and s[self.p] == "{"):
                self.binary(1)
        elif c == K["let"]:
            self.let_chain()
        else:
            self.fail("expected an expression" if c != "X" else "unterminated or stray token")

    def closure(self):
        s = self.s
        while s[self.p] in (K["move"], K["async"], K["static"]):
            self.p += 1
        if s[self.p] == "L" and self.word() == "||":
            self.p += 1
        else:
            self.need("|")
            while not self.take("|"):
                self.one_pattern()
                if self.take(":"):
                    self.type_()
                if s[self.p] != "|":
                    self.need(",")
        if self.take("P"):
            self.type_no_plus()
            self.body()
        else:
            self.expression()

    def postfix(self):
        s = self.s
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if s[self.p] in "in" or s[self.p] == K["await"]:
                    self.p += 1
                    if s[self.p] == "D":
                        self.p += 1
                        self.need("<")
                        self.commas(self.type_argument, ">")
                else:
                    self.fail("expected a member name")
            elif c == "(":
                self.p += 1
                bare, self.bare = self.bare, False
                self.commas(self.expression, ")")
                self.bare = bare
            elif c == "[":
                self.p += 1
                bare, self.bare = self.bare, False
                self.expression()
                self.need("]")
                self.bare = bare
            elif c == "?":
                self.p += 1
            elif c == "D" and s[self.p - 1] == "i":
                self.p += 1
                if self.take("<"):
                    self.commas(self.type_argument, ">")
                else:
                    self.need("i", "a name")
            elif c == "!" and s[self.p - 1] == "i" and s[self.p + 1] in "([{":
                self.p += 1
                self.tree()
            elif c == "{" and not self.bare and (s[self.p - 1] == "i" or s[self.p - 1] == ">") and self.literal_ahead():
                self.p += 1
                self.commas(self.field, "}")
            else:
                return

    def literal_ahead(self) -> bool:
        s, q = self.s, self.p + 1
        return s[q] in "}#" or s[q] == "G" or s[q] in "in" and s[q + 1] in ":,}"

    def field(self):
        s = self.s
        self.attributes()
        if self.take("G"):
            if s[self.p] != "}":
                self.expression()
            return
        if s[self.p] not in "in":
            self.fail("expected a field")
        self.p += 1
        if self.take(":"):
            self.expression()


CLASSES = Classifier(FIXED, prefixes="brc")


def lex_rust(text: str):
    return lex(text, RUST_PATTERN, CLASSES)
