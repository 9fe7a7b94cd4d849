"""Code-aware tokens: runs of ASCII letters and digits, cut at case changes, in lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shapes of one token, tried in this order.
TOKEN_PATTERN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
IDENTIFIER_PATTERN = r"[A-Za-z_][A-Za-z0-9_]+"
_TOKEN = re.compile(TOKEN_PATTERN)

#: Fixed value: structural words that are no symbol signal.
GENERIC_NAME_TOKENS = (
    "view", "views", "document", "documents", "model", "models", "form",
    "forms", "handler", "handlers", "service", "services", "command",
    "request", "response", "object", "base", "index", "data", "value",
)


def tokenize(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def tokens(text: Column) -> Column:
    """array<string> of the tokens of a text column, JVM-side; null gives an empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER_PATTERN), F.lit(0)))
