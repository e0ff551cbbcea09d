"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from flatsql.errors import QueryError

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*)
  | (?P<number>(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?(?![A-Za-z_0-9.]))
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  | (?P<word>[^\W\d]\w*|\d\w*)
  | (?P<op><>|!=|>=|<=|[=<>(),.*;+-])
    """,
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else self.value if self.kind == "op" else ""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        match = _TOKEN.match(text, at)
        if match is None:
            raise QueryError(f"unexpected character {text[at]!r} at position {at}")
        kind, raw = match.lastgroup or "op", match[0]
        kind = next(k for k in ("space", "number", "string", "quoted", "word", "op") if match[k] is not None)
        if kind in ("string", "quoted"):
            raw = raw[1:-1].replace(raw[0] * 2, raw[0])
        if kind != "space":
            out.append(Token(kind, raw, at, match.end()))
        at = match.end()
    return [*out, Token("end", "", len(text), len(text))]
