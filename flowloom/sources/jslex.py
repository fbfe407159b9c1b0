"""Tokens of JavaScript and TypeScript text.

One combined pattern finds each token; what a slash means is told from the token before it. Template
literals become pieces, so that the expressions inside them are ordinary tokens.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, tmpl (whole), head, mid, tail, regex, op, end
    text: str
    start: int
    end: int
    fresh: bool  # a line break stands before it


_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_TOKEN = re.compile(
    r"""(?P<id>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"?|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'?)
    |(?P<op>\.\.\.|=>|===|!==|==|!=|<=|<<=|<<|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!?:;,.=<>(){}\[\]@\#])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*")
#: after these words an expression begins, so a slash starts a regular expression
_BEFORE_EXPRESSION = frozenset("return typeof case do else in instanceof new void delete throw await yield of".split())


def _template(code: str, at: int) -> tuple[int, bool]:
    """From inside a template: (place after the next piece's end, whether an expression follows)."""
    n = len(code)
    while at < n:
        c = code[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, False
        elif c == "$" and code.startswith("${", at):
            return at + 2, True
        else:
            at += 1
    return n, False


def tokens(code: str) -> list[Token]:
    """All tokens, the last of kind 'end'. Never fails: an unknown character is an 'op' of its own."""
    out: list[Token] = []
    at, n, fresh = 0, len(code), True
    open_templates: list[int] = []  # depth of braces inside each open template expression
    while True:
        if m := _SKIP.match(code, at):
            fresh = fresh or bool(_BREAK.search(m[0]))
            at = m.end()
        if at >= n:
            out.append(Token("end", "", n, n, True))
            return out
        c, start = code[at], at
        if c == "`" or c == "}" and open_templates and open_templates[-1] == 0:
            first = c == "`"
            at, more = _template(code, at + 1)
            if not first:
                open_templates.pop()
            if more:
                open_templates.append(0)
            kind = ("head" if more else "tmpl") if first else ("mid" if more else "tail")
        elif c == "/" and _slash_is_regex(out) and (m := _REGEX.match(code, at)):
            kind, at = "regex", m.end()
        elif m := _TOKEN.match(code, at):
            kind, at = m.lastgroup, m.end()
            if open_templates and c in "{}":
                open_templates[-1] += 1 if c == "{" else -1
        else:
            kind, at = "op", at + 1
        out.append(Token(kind, code[start:at], start, at, fresh))
        fresh = False


def _slash_is_regex(before: list[Token]) -> bool:
    if not before:
        return True
    t = before[-1]
    if t.kind == "id":
        return t.text in _BEFORE_EXPRESSION and not (len(before) > 1 and before[-2].text in (".", "?."))
    return t.kind in ("head", "mid") or t.kind == "op" and t.text not in (")", "]", "++", "--")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_ESCAPE = re.compile(r"\\(u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r\n|.)", re.S)


def string_value(text: str) -> str:
    """The value of a quoted string literal."""
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        code = m[2] or m[3] or m[4]
        if code:
            value = int(code, 16)
            return chr(value) if value < 0x110000 else "\ufffd"
        return "" if m[1] in ("\n", "\r", "\r\n", "\u2028", "\u2029") else _ESCAPES.get(m[1], m[1])

    joined = _ESCAPE.sub(one, body)
    try:  # two escaped surrogates are one character
        return joined.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
