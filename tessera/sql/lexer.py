"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.sql.errors import SqlError


class Token(NamedTuple):
    kind: str  # word, number, string, param, op, end
    text: str
    value: object = None


_SPEC = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
  | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
  | (?P<param>[@:][A-Za-z_][A-Za-z0-9_]*|\?)
  | (?P<quoted>`[^`]+`)
  | (?P<word>[^\W\d]\w*)
  | (?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),.;])
    """,
    re.X | re.S,
)


def tokenize(sql: str) -> list[Token]:
    out, at, unnamed = [], 0, 0
    while at < len(sql):
        m = _SPEC.match(sql, at)
        if not m:
            raise SqlError(f"Unexpected character {sql[at]!r} at position {at}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if kind == "number":
            out.append(Token("number", text, int(text) if text.isdigit() else float(text)))
        elif kind == "string":  # double quotes hold string literals too
            out.append(Token("string", text, text[1:-1].replace(text[0] * 2, text[0])))
        elif kind == "param":
            unnamed += text == "?"
            out.append(Token("param", text, f"p{unnamed}" if text == "?" else text[1:]))
        elif kind == "quoted":
            out.append(Token("word", text, text[1:-1]))
        else:
            out.append(Token(kind, text, text))
    return [*out, Token("end", "", None)]
