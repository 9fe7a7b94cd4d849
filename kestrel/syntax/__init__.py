"""Parsers for the indexed languages: tokens, errors with recovery, definitions with exact ranges."""

from __future__ import annotations

import sys

from kestrel.syntax.golang import GoParser, lex_golang
from kestrel.syntax.java import JavaParser, lex_java
from kestrel.syntax.python import PythonParser, lex_python
from kestrel.syntax.rust import RustParser, lex_rust
from kestrel.syntax.script import ScriptParser, TypedMarkupParser, TypedScriptParser, lex_script

LANGUAGES = {
    "python": (lex_python, PythonParser),
    "javascript": (lex_script, ScriptParser),
    "typescript": (lex_script, TypedScriptParser),
    "tsx": (lex_script, TypedMarkupParser),
    "go": (lex_golang, GoParser),
    "rust": (lex_rust, RustParser),
    "java": (lex_java, JavaParser),
}

#: Interpreted frames live on the heap, so deep nesting is only a matter of this limit.
RECURSION_LIMIT = 60_000


def parse_text(text: str, language: str):
    """The parser of ``language`` after parsing ``text``; None if the language is unknown.

    ``.errors`` holds (significant token, cause) of every error, ``.top`` the
    definitions, ``.src`` the tokens.  Nesting beyond the interpreter's limit
    counts as an error of its own.
    """
    pair = LANGUAGES.get(language)
    if pair is None:
        return None
    lexer, parser = pair
    if sys.getrecursionlimit() < RECURSION_LIMIT:
        sys.setrecursionlimit(RECURSION_LIMIT)
    x = parser(lexer(text))
    try:
        x.parse()
    except RecursionError:
        x.errors.append((0, "nested too deeply"))
    return x
