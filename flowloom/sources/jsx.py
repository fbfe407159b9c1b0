"""JSX: markup in expression position becomes an array of the expressions it holds, at the same places.

Tags, attribute names and text turn into blanks, braces into commas, and the ends of the outermost element into
brackets, so the parser sees ``[ , f(x) , "a" ]`` and every place in the text stays what it was. Attribute strings
stay string literals. Markup that doesn't end is left alone.
"""

from __future__ import annotations

import re

from .jslex import _REGEX, _SKIP, _TOKEN, Token, _slash_is_regex, _template

_ENDINGS = (".js", ".jsx", ".mjs", ".cjs", ".tsx")
_OPEN = re.compile(r"<(?=[A-Za-z_$>])")
#: type parameters of an arrow, not a tag
_GENERIC = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_TAG, _NAME, _CLOSE, _STRING = re.compile(r"<\s*[\w$.:-]*"), re.compile(r"[A-Za-z_$][\w$:.-]*"), re.compile(r"</\s*[\w$.:-]*\s*>"), re.compile(r"\"[^\"]*\"|'[^']*'")


class _Unfinished(Exception):
    pass


class _Masker:
    def __init__(self, code: str) -> None:
        self.code, self.out, self.n = code, list(code), len(code)

    def blank(self, a: int, b: int) -> None:
        for i in range(a, b):
            if self.out[i] not in "\n\r  ":
                self.out[i] = " "

    def skip(self, at: int) -> int:
        m = _SKIP.match(self.code, at)
        return m.end() if m else at

    def js(self, at: int, inside: bool) -> int:
        """Passes over script text: to the end, or (inside braces) to the brace that closes them."""
        code, before, depth = self.code, [], 0
        while (at := self.skip(at)) < self.n:
            c, start, kind = code[at], at, "op"
            if c == "`":
                at, kind = self.template(at + 1), "tmpl"
            elif c == "<" and _OPEN.match(code, at) and _slash_is_regex(before) and not _GENERIC.match(code, at):
                end = self.outermost(at)
                at, kind = (end, "str") if end else (at + 1, "op")
            elif c == "/" and _slash_is_regex(before) and (m := _REGEX.match(code, at)):
                at, kind = m.end(), "regex"
            elif m := _TOKEN.match(code, at):
                if inside and c == "}" and not depth:
                    return at
                depth += (c == "{") - (c == "}")
                at, kind = m.end(), m.lastgroup
            else:
                at += 1
            before = [*before[-1:], Token(kind, code[start:at], start, at, False)]
        if inside:
            raise _Unfinished
        return at

    def template(self, at: int) -> int:
        more = True
        while more:
            at, more = _template(self.code, at)
            if more:
                at = self.js(at, True) + 1
        return at

    def outermost(self, at: int) -> int | None:
        held = self.out[:]
        try:
            end = self.element(at)
        except _Unfinished:
            self.out = held
            return None
        self.out[at], self.out[end - 1] = "[", "]"
        return end

    def braces(self, at: int, first: str) -> int:
        """An expression in braces; first takes the place of the one that opens them."""
        self.out[at] = first
        end = self.js(at + 1, True)
        self.out[end] = " "
        return end + 1

    def element(self, at: int) -> int:
        """One element from its '<' on: the place after it."""
        code = self.code
        end = _TAG.match(code, at).end()
        self.blank(at, end)
        at = end
        while True:  # attributes
            at = self.skip(at)
            if at >= self.n:
                raise _Unfinished
            if code.startswith("/>", at):
                self.blank(at, at + 2)
                return at + 2
            if code[at] == ">":
                self.blank(at, at + 1)
                at += 1
                break
            if code[at] == "{":
                at = self.braces(at, ",")
            elif m := _NAME.match(code, at):
                self.blank(at, m.end())
                at = self.skip(m.end())
                if at < self.n and code[at] == "=":
                    self.out[at] = ","
                    at = self.skip(at + 1)
                    if m := _STRING.match(code, at):
                        at = m.end()
                    elif code.startswith("{", at):
                        at = self.braces(at, " ")
                    elif code.startswith("<", at):
                        at = self.element(at)
            else:
                raise _Unfinished
        while at < self.n:  # children
            if m := _CLOSE.match(code, at):
                self.blank(at, m.end())
                return m.end()
            if code[at] == "<" and _OPEN.match(code, at):
                at = self.element(at)
            elif code[at] == "{":
                at = self.braces(at, ",")
            else:
                self.blank(at, at + 1)
                at += 1
        raise _Unfinished


def may_hold_jsx(file: str, code: str) -> bool:
    return file.lower().endswith(_ENDINGS) and bool(_OPEN.search(code))


def masked(code: str) -> str:
    """The text with all markup masked, character by character."""
    masker = _Masker(code)
    masker.js(0, False)
    return "".join(masker.out)
