"""Lexing: one regular expression per language, one class character per token.

``Source`` keeps every character of the text in ``toks`` (whitespace and
comments included), so exact source ranges are always recoverable.  The
parsers work on ``s``, a string holding one *class character* per significant
token, and on ``idx``, which maps a position in ``s`` to a token.  Working on a
string of classes lets flat runs of tokens be matched by compiled patterns.  A dotted chain of names is one token
of class ``i``.

Class characters shared by all languages: ``i`` identifier, ``n`` number,
``s`` string, ``v`` literal word, ``X`` a character or literal that no token
can start with, ``A`` compound assignment, ``C`` comparison, ``L`` logical
operator, ``S`` left shift, ``I`` increment, ``R`` fat arrow, ``P`` thin arrow,
``E`` ellipsis, ``D`` double colon, ``Q`` optional chaining, ``W`` power;
single punctuation marks stand for themselves.  Keywords get one private
character each.
"""

from __future__ import annotations

import re
from itertools import accumulate

def keyword_classes(words: str, first: int = 0xE000) -> dict[str, str]:
    """One private-use character per word, in the order given."""
    return {w: chr(first + n) for n, w in enumerate(words.split())}


class Classifier:
    """Token -> class character: a small table of fixed tokens, then the first
    character, then (for the few shapes that need it) a closer look.

    Blank tokens get a space, which never reaches the parsers.  ``newline`` is
    the class of blanks and comments that hold a line end.
    """

    def __init__(self, fixed: dict[str, str], newline: str = " ", prefixes: str = ""):
        self.fixed = {" ": " "} | fixed | dict.fromkeys(("\"", "'", "`", "\\"), "X")
        self.newline = newline
        self.first: dict[str, str | None] = {c: "i" for c in map(chr, range(0x80)) if c.isalpha() or c in "_$"}
        self.first |= dict.fromkeys("0123456789", "n") | dict.fromkeys("\"`", "s") | {" ": " ", "\t": " ", "\n": newline, "\r": " "}
        if newline != " ":
            self.first |= dict.fromkeys(" \t\r\f", None)
        self.first |= dict.fromkeys(prefixes)

    def look(self, tok: str) -> str:
        c = tok[0]
        if c.isspace() or c == "\ufeff":
            return self.newline if "\n" in tok else " "
        if c == "/":
            if tok[1] == "/" or tok[1] == "*":
                return self.newline if "\n" in tok else " "
            return "s"  # a regular expression literal
        if c == "'":
            return "s" if tok[-1] == "'" else "'"  # a lifetime
        if c == "#":
            return "i" if len(tok) > 1 else "#"
        if c == "_" or c.isalpha():
            return "s" if tok[-1] in "\"'" or tok[-1] == "#" else "i"
        if c == ".":
            return "n"
        return "s" if len(tok) > 1 and tok[-1] in "\"'`" else "X"

    def __call__(self, toks: list[str]) -> list[str]:
        fixed, first, look = self.fixed.get, self.first.get, self.look
        return [fixed(t) or first(t[0]) or look(t) for t in toks]


PUNCT = {c: c for c in "()[]{},;:.=<>+-*/%&|^!?@~"} | {
    "==": "C", "!=": "C", "===": "C", "!==": "C", "<=": "C", ">=": "C",
    "&&": "L", "||": "L", "??": "L", "<<": "S", "++": "I", "--": "I",
    "=>": "R", "->": "P", "...": "E", "::": "D", "?.": "Q", "**": "W",
    "#": "#",
} | {op + "=": "A" for op in ("+", "-", "*", "/", "%", "&", "|", "^", "<<", "&&", "||", "??", "**", "&^", "//", "@")}

_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)[A-Za-z]\w*|0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?[a-zA-Z]?"
_DQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_BLOCK = r"/\*[^*]*(?:\*(?!/)[^*]*)*\*/"
_LINE = r"//[^\n]*"
_OPS = r"===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|&\^=|\.\.\.|=>|->|::|\?\.(?!\d)|\*\*|==|!=|<=|>=|&&|\|\||\?\?|<<|\+\+|--|[-+*/%&|^]="


_IDENT = r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+"


def _pattern(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts) + r"|[\s\S]")


JS_PATTERN = _pattern(
    r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+",
    r"[ \n]++",
    r"[(){}\[\],;]",
    r"\s+",
    r"#?[^\W\d][\w$]*",
    r"(?<=>)[^<>{}();=&|'\"`]*['\"`][^<>{}();=&|]*(?=</|\{)",  # text of a markup element
    _DQ,
    _SQ,
    r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*\})*`",
    _LINE,
    _BLOCK,
    r"(?:(?<=[(,=:\[!&|?;\n+{])|(?<=[(,=:\[!&|?;+{] )|(?<=return )|(?<=typeof )|(?<=\n\t)|(?<=\n  ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
    _NUMBER,
    _OPS,
)
JAVA_PATTERN = _pattern(
    _IDENT, r"[ \n]++", r"[(){}\[\],;]", r"\s+", r"[^\W\d][\w$]*",
    r'"""[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""', _DQ, r"'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'",
    _LINE, _BLOCK, _NUMBER, _OPS,
)
GO_PATTERN = _pattern(
    _IDENT, r"[ ]++", r"[(){}\[\],;]", r"\s+", r"[^\W\d]\w*", _DQ, r"`[^`]*`",
    r"'(?:[^'\\\n]|\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\U[\da-fA-F]{8}|\\[0-7]{3}|\\.)'", r":=|<-|&\^", _LINE, _BLOCK, _NUMBER, _OPS,
)
RUST_PATTERN = _pattern(
    r"[A-Zad-qs-z_]\w*+(?:\.[A-Za-z_]\w*+)*+",
    r'b?r#"(?:[^"]|"(?!#))*"#|b?r##"(?:[^"]|"(?!##))*"##|b?r"[^"]*"|[bc]"(?:[^"\\]|\\[\s\S])*"|r#[^\W\d]\w*|b\'(?:[^\'\\\n]|\\x[\da-fA-F]{2}|\\.)\'',
    _IDENT, r"[ \n]++", r"[(){}\[\],;]", r"\s+", r"[^\W\d]\w*", r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"',
    r"'(?:[^'\\\n]|\\x[\da-fA-F]{2}|\\u\{[\da-fA-F_]+\}|\\.)'", r"'[^\W\d]\w*",
    _LINE, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/", r"\.\.=",
    r"(?:0[xbo][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?|[eE][+-]?\d+)?|\d[\d_]*\.(?![.\w]))\w*", r"\.\.", _OPS,
)
_PYSTR = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
PY_PATTERN = _pattern(
    r"[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+(?![\"'])",
    r"[ ]++(?![ \t\f]*[\n#])",
    r"[(){}\[\],]|\.\.\.",
    _PYSTR + r'(?:"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|"(?!"")[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|""(?!"))',
    _PYSTR + r"(?:'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|'(?!'')[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|''(?!'))",
    r"[^\W\d]\w*",
    r"(?:[ \t\f]*(?:#[^\n]*)?\n)+[ \t\f]*",
    r"[ \t\f]+|\\\n|#[^\n]*",
    r"[(){}\[\],.]",
    r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?[jJ]?",
    r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|==|<=|>=|<<|>>|[-+*/%&|^@]=",
)


class Source:
    """Tokens of one text; offsets and line numbers are computed when asked for."""

    __slots__ = ("text", "toks", "s", "idx", "_starts", "_ends")

    def __init__(self, text: str, toks: list[str], s: str, idx: list[int]):
        self.text, self.toks, self.s, self.idx = text, toks, s, idx
        self._starts = None
        self._ends = None

    def tok(self, p: int) -> str:
        return self.toks[self.idx[p]] if p < len(self.idx) else ""

    def offset(self, p: int) -> int:
        """Offset of the first character of significant token p (text length at the end)."""
        return self.token_offset(self.idx[p]) if p < len(self.idx) else len(self.text)

    def token_offset(self, k: int) -> int:
        if self._starts is None:
            self._starts = [0, *accumulate(map(len, self.toks))]
        return self._starts[k]

    def end_offset(self, p: int) -> int:
        """Offset behind the last character of significant token p."""
        k = self.idx[p]
        return self.token_offset(k) + len(self.toks[k])

    def line(self, offset: int) -> int:
        """1-based line of an offset; lines are split at LF."""
        if self._ends is None:
            self._ends = [m.start() for m in re.finditer("\n", self.text)]
        from bisect import bisect_left

        return bisect_left(self._ends, offset) + 1


def lex(text: str, pattern: re.Pattern, classes: Classifier) -> Source:
    toks = pattern.findall(text)
    cl = classes(toks)
    return Source(text, toks, "".join(cl).replace(" ", ""), [k for k, c in enumerate(cl) if c != " "])


#: Classes after which a line end ends a Go statement.
_GO_ENDS = frozenset("insv)]}I")


def lex_go(text: str, pattern: re.Pattern, classes: Classifier, enders: frozenset) -> Source:
    """Like lex, with a ``;`` for each line end behind a token that can end a statement."""
    toks = pattern.findall(text)
    idx, out, prev = [], [], ""
    ends = _GO_ENDS | enders
    for k, c in enumerate(classes(toks)):
        if c != " ":
            if c == "\n":
                if prev not in ends:
                    continue
                c = ";"
            idx.append(k)
            out.append(c)
            prev = c
    if prev in ends:
        idx.append(len(toks) - 1)
        out.append(";")
    return Source(text, toks, "".join(out), idx)
