"""Tokens of a query text."""

from __future__ import annotations

import re
from typing import NamedTuple


class QueryError(ValueError):
    """A query that cannot be parsed or resolved."""


class Token(NamedTuple):
    kind: str  # num, str, name, quoted, table, op, end
    text: str
    at: int


_TOKENS = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^']|'')*')|(?P<quoted>`[^`]+`)
    |(?P<table>@[A-Za-z_][\w-]*)|(?P<name>:?[A-Za-z_]\w*)|(?P<op>\|>|\|\||::|<=|>=|<>|!=|==|[-+*/%^=<>(),.\[\]])""",
    re.X,
)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            word = m[0]
            if m.lastgroup == "str":
                word = word[1:-1].replace("''", "'")
            elif m.lastgroup == "quoted":
                word = word[1:-1]
            out.append(Token(m.lastgroup, word, at))
        at = m.end()
    return [*out, Token("end", "", at)]
