"""SQL text as tokens, and operations on token lists."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import DialectError

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)"
    r"|(?P<unicode>[uU]&(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")(?:\s+UESCAPE\s+'.')?)"
    r"|(?P<string>'(?:[^']|'')*')"
    r"|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`)"
    r"|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[a-zA-Z]*)"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<op><=>|<>|<=|>=|!=|==|\|\||->|::|.)",
    re.DOTALL | re.IGNORECASE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "op" else ""


def tokens(sql: str) -> list[Token]:
    """Without white space and comments; a unicode literal is decoded."""
    out = []
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "space":
            continue
        out.append(_decoded(m[0]) if m.lastgroup == "unicode" else Token(m.lastgroup, m[0]))
    return out


def _decoded(text: str) -> Token:
    m = re.fullmatch(r"[uU]&(['\"])(.*?)\1(?:\s+UESCAPE\s+'(.)')?", text, re.DOTALL | re.IGNORECASE)
    quote, body, escape = m[1], m[2].replace(m[1] * 2, m[1]), re.escape(m[3] or "\\")
    plain = re.sub(f"{escape}(?:({escape})|\\+([0-9a-fA-F]{{6}})|([0-9a-fA-F]{{4}}))", lambda x: x[1] or chr(int(x[2] or x[3], 16)), body)
    return Token("string", "'" + plain.replace("'", "''") + "'") if quote == "'" else Token("quoted", '"' + plain.replace('"', '""') + '"')


def text_of(ts: list[Token]) -> str:
    """Spark SQL text: doubled quotes inside strings and quoted names in Spark's spelling."""
    out = []
    for t in ts:
        if t.kind == "string":
            out.append("'" + t.text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'")
        elif t.kind == "quoted" and t.text[0] == '"':
            out.append("`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            out.append(t.text)
    return " ".join(out)


def closing(ts: list[Token], at: int) -> int:
    """The place of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i].low == "(") - (ts[i].low == ")")
        if not depth:
            return i
    raise DialectError("a parenthesis isn't closed")


def opening(ts: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        depth += (ts[i].low == ")") - (ts[i].low == "(")
        if not depth:
            return i
    raise DialectError("a parenthesis isn't opened")


def top_level(ts: list[Token], start: int = 0, stop: int | None = None):
    """(place, token) outside of all parentheses and CASE ... END."""
    depth = 0
    for i in range(start, len(ts) if stop is None else stop):
        low = ts[i].low
        if low == ")" or low == "end" and depth:
            depth -= 1
        if not depth:
            yield i, ts[i]
        if low == "(" or low == "case":
            depth += 1


def split(ts: list[Token], by: str = ",") -> list[list[Token]]:
    """The parts between separators outside of all parentheses."""
    places = [i for i, t in top_level(ts) if t.low == by]
    return [ts[a + 1 : b] for a, b in zip([-1, *places], [*places, len(ts)], strict=True)] if ts else []
