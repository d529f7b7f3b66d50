"""Splitting SQL text into tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass


class ParseError(ValueError):
    """The text is no statement of the dialect."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, string, symbol, end
    text: str
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "name" and self.text.upper() in words


_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<name>[^\W\d]\w*)
    |(?P<quoted>"(?:[^"]|"")+")
    |(?P<symbol><>|<=|>=|!=|\|\||[-+*/%(),.;=<>])""",
    re.VERBOSE | re.DOTALL,
)


def tokenise(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        kind, body = found.lastgroup, found.group()
        if kind == "string":
            out.append(Token("string", body[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("quoted", body[1:-1].replace('""', '"'), at))
        elif kind:
            out.append(Token(kind, body, at))
        at = found.end()
    return [*out, Token("end", "", len(text))]
