"""Tokens of the graph query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset(
    "MATCH WHERE RETURN ORDER BY LIMIT ASC DESC AND OR NOT IN IS NULL CONTAINS STARTS ENDS WITH DISTINCT AS TRUE FALSE COUNT SUM AVG MIN MAX".split()
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, number, word, keyword, hops or op
    value: str
    at: int


_PATTERN = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
      | (?P<number>\d+\.(?!\.)\d+|\d+)
      | (?P<word>[^\W\d]\w*)
      | (?P<hops>\*\s*(?:\d*\s*\.\.\s*\d*|\d+)?(?=\s*\]))
      | (?P<op>->|<-|<>|!=|>=|<=|=~|\.\.|[-+*/%=<>()\[\]{}:,.|])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def unescape(body: str) -> str:
    """`\\n`, `\\t` and `\\r` are those characters, any other escaped character is itself except before a regex letter, where the backslash stays."""
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            n = body[i + 1]
            out.append(n if n in "\\\"'" else _ESCAPES.get(n, "\\" + n))
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def tokenize(text: str) -> list[Token]:
    """All tokens; characters that belong to none are skipped."""
    out = []
    for m in _PATTERN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "string":
            value = unescape(value[1:-1])
        elif kind == "word" and value.upper() in KEYWORDS:
            kind, value = "keyword", value
        out.append(Token(kind, value, m.start()))
    return out
