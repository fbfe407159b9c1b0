"""A parser of JavaScript and TypeScript for what the node table needs.

It finds functions, parameters, variable declarations, string literals, calls and return expressions,
with exact extents and nesting; operators are not ranked and types are only skipped (their string
literals are kept). Text that can't be parsed is skipped up to the next statement.
"""

from __future__ import annotations

from .jslex import Token, tokens


class Node:
    """kind: function, arrow, method, param, var, str, call, return, or '' for what only holds others."""

    __slots__ = ("kind", "start", "end", "kids", "info")

    def __init__(self, kind: str, start: int, end: int, kids: list[Node], **info) -> None:
        self.kind, self.start, self.end, self.kids, self.info = kind, start, end, kids, info


class Broken(Exception):
    """The text is not what the grammar wants here."""


_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= **= <<= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % & | ^ ** << && || ?? == != === !== <= < >".split())
_PREFIX_WORDS = frozenset("typeof void delete await".split())
_PREFIX_OPS = frozenset(("!", "~", "+", "-", "++", "--"))
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}
_NOT_OPERAND = frozenset("in of instanceof as satisfies else case default extends implements".split())


class Parser:
    def __init__(self, code: str) -> None:
        self.code, self.t, self.i, self.errors = code, tokens(code), 0, 0
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """Place of each opening bracket -> place of its partner."""
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "op":
                if t.text in _OPEN:
                    stack.append((i, _OPEN[t.text]))
                elif t.text in ")]}":
                    while stack:
                        j, want = stack.pop()
                        if want == t.text:
                            out[j] = i
                            break
        return out

    # token helpers

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.t[self.i]
        return t.text in texts and t.kind in ("op", "id")

    def take(self) -> Token:
        t = self.t[self.i]
        if t.kind == "end":
            raise Broken
        self.i += 1
        return t

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise Broken
        return self.take()

    def last_end(self) -> int:
        return self.t[self.i - 1].end if self.i else 0

    # statements

    def program(self) -> Node:
        kids: list[Node] = []
        while self.now.kind != "end":
            kids += self.guarded(top=True)
        return Node("", 0, len(self.code), kids)

    def guarded(self, top: bool = False) -> list[Node]:
        """One statement; on trouble what was not understood is skipped, but for its string literals."""
        first = self.i
        try:
            return self.statement(top)
        except (Broken, RecursionError):
            self.errors += 1
        self.i = max(self.i, first)
        kids = []
        j = first
        while self.t[j].kind != "end":
            t = self.t[j]
            if j > first and (t.text in (";", "}") and t.kind == "op" or j > self.i and t.fresh):
                j += t.text == ";" or top and t.text == "}"
                break
            if t.kind == "str":
                kids.append(Node("str", t.start, t.end, []))
            j += 1
        self.i = max(j, first + 1)
        return kids

    def block(self) -> list[Node]:
        self.need("{")
        kids: list[Node] = []
        while not self.at("}"):
            if self.now.kind == "end":
                return kids
            kids += self.guarded()
        self.take()
        return kids

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.now.fresh or self.now.kind == "end"):
            raise Broken

    def statement(self, top: bool = False) -> list[Node]:
        t = self.now
        if t.kind == "op":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.take()
                return []
            if t.text == "@":
                kids = self.decorators()
                return kids + self.statement(top)
        if t.kind == "id":
            method = getattr(self, f"s_{t.text}", None)
            if method and (found := method(top)) is not None:
                return found
            if self.peek().text == ":" and self.peek().kind == "op" and t.text not in ("default", "case"):
                self.i += 2
                return self.statement()
        kids = self.expression().kids
        self.semicolon()
        return kids

    def declarations(self, no_in: bool = False) -> list[Node]:
        kids = []
        while True:
            start = self.now.start
            name, inner = self.binding()
            self.eat("!")
            if self.eat(":"):
                inner += self.type()
            init = None
            if self.eat("="):
                value = self.assignment(no_in)
                init, inner = (value.start, value.end), inner + value.kids
            kids.append(Node("var", start, self.last_end(), inner, name=name, init=init))
            if not self.eat(","):
                return kids

    def binding(self) -> tuple[tuple[int, int], list[Node]]:
        """An identifier or a destructuring pattern: its extent and what it holds."""
        t = self.now
        if t.kind == "op" and t.text in ("{", "["):
            node = self.object() if t.text == "{" else self.array()
            return (t.start, self.last_end()), node.kids
        if t.kind != "id":
            raise Broken
        self.take()
        return (t.start, t.end), []

    def _variables(self, top: bool) -> list[Node] | None:
        if self.now.text == "const" and self.peek().text == "enum":
            self.take()
            return self.s_enum(top)
        if self.now.text == "let" and not (self.peek().kind == "id" or self.peek().text in ("{", "[")):
            return None
        self.take()
        kids = self.declarations()
        self.semicolon()
        return kids

    s_var = s_let = s_const = _variables

    def s_function(self, top: bool) -> list[Node]:
        return [self.function(self.now.start, top)]

    def s_async(self, top: bool) -> list[Node] | None:
        if self.peek().text == "function" and not self.peek().fresh:
            return [self.function(self.now.start, top)]
        return None

    def s_export(self, top: bool) -> list[Node]:
        start = self.take().start
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.peek().text == "function":
                return [self.function(start, top)]
            if self.at("class", "abstract", "interface", "@"):
                return self.statement()
            kids = self.expression().kids
            self.semicolon()
            return kids
        if self.at("function") or self.at("async") and self.peek().text == "function":
            return [self.function(start, top)]
        if self.at("declare") and self.peek().text == "function":
            self.take()
            return [self.function(start, top)]
        if self.at("{", "*", "type") and (not self.at("type") or self.peek().text in ("{", "*")):
            return self.module_text()
        if self.eat("="):
            kids = self.expression().kids
            self.semicolon()
            return kids
        if self.at("as"):
            return self.module_text()
        return self.statement()

    def module_text(self) -> list[Node]:
        """The rest of an import or export declaration: only its literals count."""
        kids = []
        while self.now.kind != "end" and not self.at(";"):
            if self.now.fresh and self.t[self.i - 1].kind == "str":
                break
            if self.at("{") and self.i in self.match:
                for t in self.t[self.i : self.match[self.i]]:
                    if t.kind == "str":
                        kids.append(Node("str", t.start, t.end, []))
                self.i = self.match[self.i] + 1
                if self.now.fresh and not self.at("from"):
                    break
                continue
            t = self.take()
            if t.kind == "str":
                kids.append(Node("str", t.start, t.end, []))
        self.eat(";")
        return kids

    def s_import(self, top: bool) -> list[Node] | None:
        if self.peek().text in ("(", "."):
            return None
        self.take()
        if self.now.kind == "id" and self.peek().text == "=":  # import x = require("y")
            self.i += 2
            kids = self.expression().kids
            self.semicolon()
            return kids
        return self.module_text()

    def s_if(self, top: bool) -> list[Node]:
        self.take()
        kids = self.parenthesised() + self.statement()
        if self.eat("else"):
            kids += self.statement()
        return kids

    def parenthesised(self) -> list[Node]:
        self.need("(")
        kids = self.expression().kids
        self.need(")")
        return kids

    def s_while(self, top: bool) -> list[Node]:
        self.take()
        return self.parenthesised() + self.statement()

    s_with = s_while

    def s_do(self, top: bool) -> list[Node]:
        self.take()
        kids = self.statement()
        self.need("while")
        kids += self.parenthesised()
        self.eat(";")
        return kids

    def s_for(self, top: bool) -> list[Node]:
        self.take()
        self.eat("await")
        self.need("(")
        kids: list[Node] = []
        if self.at("var", "const") or self.at("let") and (self.peek().kind == "id" or self.peek().text in ("{", "[")):
            self.take()
            kids += self.declarations(no_in=True)
        elif not self.at(";"):
            kids += self.expression(no_in=True).kids
        if self.eat("of") or self.eat("in"):
            kids += self.expression().kids
        else:
            self.need(";")
            if not self.at(";"):
                kids += self.expression().kids
            self.need(";")
            if not self.at(")"):
                kids += self.expression().kids
        self.need(")")
        return kids + self.statement()

    def s_switch(self, top: bool) -> list[Node]:
        self.take()
        kids = self.parenthesised()
        self.need("{")
        while not self.eat("}"):
            if self.now.kind == "end":
                break
            if self.eat("default"):
                self.need(":")
            elif self.eat("case"):
                kids += self.expression().kids
                self.need(":")
            else:
                kids += self.guarded()
        return kids

    def s_try(self, top: bool) -> list[Node]:
        self.take()
        kids = self.block()
        if self.eat("catch"):
            if self.eat("("):
                start = self.now.start
                name, inner = self.binding()
                if self.eat(":"):
                    inner += self.type()
                kids.append(Node("var", start, self.last_end(), inner, name=name, init=None))
                self.need(")")
            kids += self.block()
        if self.eat("finally"):
            kids += self.block()
        return kids

    def s_return(self, top: bool) -> list[Node]:
        start = self.take().start
        if self.at(";", "}") or self.now.fresh or self.now.kind == "end":
            self.eat(";")
            return [Node("return", start, self.last_end(), [], value=None)]
        value = self.expression()
        self.semicolon()
        return [Node("return", start, self.last_end(), value.kids, value=(value.start, value.end))]

    def s_throw(self, top: bool) -> list[Node]:
        self.take()
        kids = self.expression().kids
        self.semicolon()
        return kids

    def s_break(self, top: bool) -> list[Node]:
        self.take()
        if self.now.kind == "id" and not self.now.fresh:
            self.take()
        self.semicolon()
        return []

    s_continue = s_break

    def s_debugger(self, top: bool) -> list[Node]:
        self.take()
        self.semicolon()
        return []

    def s_class(self, top: bool) -> list[Node]:
        return self.class_body()

    def s_abstract(self, top: bool) -> list[Node] | None:
        if self.peek().text != "class":
            return None
        self.take()
        return self.class_body()

    def s_interface(self, top: bool) -> list[Node] | None:
        if self.peek().kind != "id" or self.peek().fresh:
            return None
        self.i += 2
        kids = self.type_parameters()
        if self.eat("extends"):
            kids += self.type()
            while self.eat(","):
                kids += self.type()
        return kids + self.type()

    def s_type(self, top: bool) -> list[Node] | None:
        if self.peek().kind != "id" or self.peek().fresh or self.peek(2).text not in ("=", "<"):
            return None
        self.i += 2
        kids = self.type_parameters()
        self.need("=")
        kids += self.type()
        self.semicolon()
        return kids

    def s_enum(self, top: bool) -> list[Node] | None:
        if self.peek().kind != "id":
            return None
        self.i += 2
        return self.object().kids

    def s_namespace(self, top: bool) -> list[Node] | None:
        if self.peek().kind not in ("id", "str") or self.peek().fresh:
            return None
        self.take()
        name = self.take()
        while self.eat("."):
            self.take()
        kids = [Node("str", name.start, name.end, [])] if name.kind == "str" else []
        return kids + (self.block() if self.at("{") else [])

    s_module = s_namespace

    def s_global(self, top: bool) -> list[Node] | None:
        if self.peek().text != "{":
            return None
        self.take()
        return self.block()

    def s_declare(self, top: bool) -> list[Node] | None:
        if self.peek().kind != "id" or self.peek().fresh:
            return None
        start = self.take().start
        if self.at("function"):
            return [self.function(start, top)]
        return self.statement(top)

    # functions and classes

    def function(self, start: int, top: bool = False, expression: bool = False) -> Node:
        self.eat("async")
        self.need("function")
        self.eat("*")
        name = self.take() if self.now.kind == "id" else None
        kids = self.type_parameters()
        params = self.parameters()
        kids += params
        if self.eat(":"):
            kids += self.type()
        if self.at("{"):
            kids += self.block()
        else:
            self.eat(";")  # an overload's signature
        return Node("function", start, self.last_end(), kids, name=name.text if name and not expression else "", params=params, top=top, expression=expression, value=None)

    def parameters(self, real: bool = True) -> list[Node]:
        """With real off (methods) the parameters are no nodes, only what they hold."""
        self.need("(")
        out: list[Node] = []
        while not self.eat(")"):
            start = self.now.start
            kids = self.decorators()
            while self.now.kind == "id" and self.now.text in _MODIFIERS and (self.peek().kind == "id" or self.peek().text in ("{", "[")):
                self.take()
            self.eat("...")
            name, inner = self.binding()
            kids += inner
            self.eat("?")
            if self.eat(":"):
                kids += self.type()
            if self.eat("="):
                kids += self.assignment().kids
            out.append(Node("param" if real else "", start, self.last_end(), kids, name=name))
            if not self.eat(",") and not self.at(")"):
                raise Broken
        return out

    def decorators(self) -> list[Node]:
        kids = []
        while self.eat("@"):
            kids += self.postfix().kids
        return kids

    def method(self) -> list[Node]:
        kids = self.type_parameters() + self.parameters(real=False)
        if self.eat(":"):
            kids += self.type()
        if self.at("{"):
            kids += self.block()
        return kids

    def class_body(self) -> list[Node]:
        self.need("class")
        if self.now.kind == "id" and not self.at("extends", "implements"):
            self.take()
        kids = self.type_parameters()
        if self.eat("extends"):
            kids += self.postfix().kids
            if self.at("<"):
                kids += self.type_arguments(True) or []
        if self.eat("implements"):
            kids += self.type()
            while self.eat(","):
                kids += self.type()
        self.need("{")
        while not self.eat("}"):
            if self.now.kind == "end":
                break
            if self.eat(";"):
                continue
            kids += self.decorators()
            if self.at("static") and self.peek().text == "{":
                self.take()
                kids += self.block()
                continue
            while self.now.kind == "id" and self.now.text in _MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "<", "}") and not (self.peek().fresh and self.now.text not in ("static", "async")):
                self.take()
            self.eat("*")
            kids += self.key()
            if not self.eat("?"):
                self.eat("!")
            if self.at("(", "<"):
                kids += self.method()
                continue
            if self.eat(":"):
                kids += self.type()
            if self.eat("="):
                kids += self.assignment().kids
            if not self.eat(";") and not self.at("}") and not self.now.fresh:
                raise Broken
        return kids

    def key(self) -> list[Node]:
        t = self.now
        if t.text == "[" and t.kind == "op":
            close = self.match.get(self.i)
            if self.peek().kind == "id" and self.peek(2).text == ":":  # an index signature
                self.i += 3
                kids = self.type()
                self.need("]")
                return kids
            self.take()
            kids = self.assignment().kids
            if close != self.i:
                raise Broken
            self.need("]")
            return kids
        if t.kind not in ("id", "str", "num"):
            raise Broken
        self.take()
        return [Node("str", t.start, t.end, [])] if t.kind == "str" else []

    # types: skipped, but for the string literals in them

    def type(self) -> list[Node]:
        kids = []
        if self.at("|", "&"):
            self.take()
        while True:
            kids += self.type_operand()
            if self.at("|", "&"):
                self.take()
            elif self.at("extends") and not self.now.fresh:
                self.take()
                kids += self.type()
                self.need("?")
                kids += self.type()
                self.need(":")
                kids += self.type()
                return kids
            elif self.at("is") and not self.now.fresh:
                self.take()
            else:
                return kids

    def type_operand(self) -> list[Node]:
        kids: list[Node] = []
        while self.at("keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new", "-") and self.peek().text not in (",", ")", ";", "=", ">", "|", "]", "}"):
            self.take()
        t = self.now
        if t.kind == "op" and t.text in _OPEN:
            close = self.match.get(self.i)
            if close is None:
                raise Broken
            kids += [Node("str", x.start, x.end, []) for x in self.t[self.i : close] if x.kind == "str"]
            self.i = close + 1
            if t.text == "(" and self.eat("=>"):
                return kids + self.type()
        elif t.text == "<" and t.kind == "op":
            kids += self.type_parameters() + self.type_operand()
        elif t.kind in ("str", "num", "tmpl"):
            self.take()
            if t.kind == "str":
                kids.append(Node("str", t.start, t.end, []))
        elif t.kind == "head":
            kids += self.template().kids
        elif t.kind == "id":
            self.take()
            while self.at(".") or t.text == "import" and self.at("("):
                if self.take().text == "(":
                    kids += self.type()
                    self.need(")")
                else:
                    self.take()
            if self.at("<") and not self.now.fresh:
                kids += self.type_arguments(True) or []
        else:
            raise Broken
        while self.at("[") and not self.now.fresh:
            close = self.match.get(self.i)
            if close is None:
                raise Broken
            kids += [Node("str", x.start, x.end, []) for x in self.t[self.i : close] if x.kind == "str"]
            self.i = close + 1
        return kids

    def type_parameters(self) -> list[Node]:
        kids: list[Node] = []
        if self.eat("<"):
            while not self.eat(">"):
                while self.at("const", "in", "out") and self.peek().kind == "id":
                    self.take()
                self.take()
                if self.eat("extends"):
                    kids += self.type()
                if self.eat("="):
                    kids += self.type()
                if not self.eat(",") and not self.at(">"):
                    raise Broken
        return kids

    def type_arguments(self, sure: bool = False) -> list[Node] | None:
        """Type arguments after an expression, or None (and no move) if '<' rather compares."""
        first, kids = self.i, []
        try:
            self.need("<")
            while not self.eat(">"):
                kids += self.type()
                if not self.eat(",") and not self.at(">"):
                    raise Broken
            if sure or self.at("(", ")", "]", ",", ";", ".", "?.", "{") or self.now.kind in ("tmpl", "head", "end"):
                return kids
        except Broken:
            if sure:
                raise
        self.i = first
        return None

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        kids, end = first.kids, first.end
        while self.eat(","):
            more = self.assignment(no_in)
            kids, end = kids + more.kids, more.end
        return Node("", first.start, end, kids)

    def arrow_ahead(self, in_condition: bool) -> bool:
        t, k = self.now, 0
        if t.text == "async" and t.kind == "id" and not self.peek().fresh and (self.peek().kind == "id" or self.peek().text in ("(", "<")):
            k = 1
        x = self.peek(k) if k else t
        if x.kind == "id" and x.text not in _NOT_OPERAND:
            return self.peek(k + 1).text == "=>" and self.peek(k + 1).kind == "op"
        if x.kind != "op" or x.text not in ("(", "<"):
            return False
        place = self.i + k
        if x.text == "<":
            depth, j = 0, place
            while j < len(self.t) and j < place + 200:
                depth += (self.t[j].text == "<") - (self.t[j].text == ">")
                j += 1
                if not depth:
                    break
            if j >= len(self.t) or self.t[j].text != "(":
                return False
            place = j
        close = self.match.get(place)
        if close is None:
            return False
        after = self.t[close + 1]
        if after.text == "=>" and after.kind == "op":
            return True
        if after.text == ":" and after.kind == "op" and not in_condition:
            held, errors = self.i, self.errors
            try:
                self.i = close + 2
                self.type()
                return self.at("=>")
            except Broken:
                return False
            finally:
                self.i, self.errors = held, errors
        return False

    def arrow(self, no_in: bool) -> Node:
        start = self.now.start
        if self.at("async") and self.peek().text != "=>":
            self.take()
        kids = self.type_parameters()
        if self.at("("):
            params = self.parameters()
        else:
            t = self.take()
            params = [Node("param", t.start, t.end, [], name=(t.start, t.end))]
        kids += params
        if self.eat(":"):
            kids += self.type()
        self.need("=>")
        if self.at("{"):
            body, value = self.block(), None
        else:
            x = self.assignment(no_in)
            body, value = x.kids, (x.start, x.end)
        return Node("arrow", start, self.last_end(), kids + body, name="", params=params, top=False, expression=True, value=value)

    def assignment(self, no_in: bool = False, in_condition: bool = False) -> Node:
        if self.arrow_ahead(in_condition):
            f = self.arrow(no_in)
            return Node("", f.start, f.end, [f])
        start = self.now.start
        if self.at("yield"):
            self.take()
            self.eat("*")
            if self.now.fresh or self.at(")", "]", "}", ",", ";", ":") or self.now.kind in ("end", "mid", "tail"):
                return Node("", start, self.last_end(), [])
            value = self.assignment(no_in, in_condition)
            return Node("", start, value.end, value.kids)
        left = self.binary(no_in)
        kids = left.kids
        if self.at("?"):
            self.take()
            kids = kids + self.assignment(in_condition=True).kids
            self.need(":")
            kids += self.assignment(no_in, in_condition).kids
        elif self.now.kind == "op" and self.now.text in _ASSIGN:
            self.take()
            kids = kids + self.assignment(no_in, in_condition).kids
        return Node("", start, self.last_end(), kids)

    def binary(self, no_in: bool) -> Node:
        first = self.unary()
        kids = first.kids
        while True:
            t = self.now
            if t.kind == "op" and t.text in _BINARY:
                self.take()
                if t.text == ">":  # shifts and comparisons that begin with '>' come one character at a time
                    while self.at(">", "=", "==", "===") and self.now.start == self.t[self.i - 1].end:
                        self.take()
            elif t.kind == "id" and (t.text == "instanceof" or t.text == "in" and not no_in):
                self.take()
            elif t.kind == "id" and t.text in ("as", "satisfies") and not t.fresh:
                self.take()
                kids = kids + ([] if self.eat("const") else self.type())
                continue
            else:
                return Node("", first.start, self.last_end(), kids)
            kids = kids + self.unary().kids

    def unary(self) -> Node:
        start = self.now.start
        t = self.now
        if t.kind == "op" and t.text in _PREFIX_OPS or t.kind == "id" and t.text in _PREFIX_WORDS and not (
            self.peek().kind == "op" and self.peek().text in (")", "]", "}", ",", ";", "=", ".", "=>", ":", "?") or self.peek().kind == "end"
        ):
            self.take()
            inner = self.unary()
            return Node("", start, inner.end, inner.kids)
        if t.text == "<" and t.kind == "op":  # an old type assertion
            kids = self.type_arguments(True) or []
            inner = self.unary()
            return Node("", start, inner.end, kids + inner.kids)
        return self.postfix()

    def postfix(self) -> Node:
        node = self.primary()
        while True:
            t = self.now
            if t.kind in ("tmpl", "head"):
                inner = self.template()
                node = Node("", node.start, inner.end, node.kids + inner.kids)
                continue
            if t.kind != "op":
                return node
            if t.text in (".", "?."):
                self.take()
                if t.text == "?." and self.at("(", "["):
                    continue
                if t.text == "?." and self.at("<"):
                    continue
                if self.now.kind != "id":
                    raise Broken
                self.take()
                node = Node("", node.start, self.last_end(), node.kids)
            elif t.text == "[":
                self.take()
                inner = self.expression()
                self.need("]")
                node = Node("", node.start, self.last_end(), node.kids + inner.kids)
            elif t.text == "(":
                args = self.arguments()
                call = Node("call", node.start, self.last_end(), node.kids + [k for a in args for k in a.kids], callee=(node.start, node.end), args=[(a.start, a.end) for a in args])
                node = Node("", call.start, call.end, [call])
            elif t.text == "<":
                kids = self.type_arguments()
                if kids is None:
                    return node
                node.kids = node.kids + kids  # the callee's text ends before them
            elif t.text == "!" and not t.fresh and not (self.peek().text in ("=", "==") and self.peek().start == t.end):
                self.take()
                node = Node("", node.start, t.end, node.kids)
            elif t.text in ("++", "--") and not t.fresh:
                self.take()
                node = Node("", node.start, t.end, node.kids)
            else:
                return node

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            start = self.now.start
            self.eat("...")
            x = self.assignment()
            out.append(Node("", start, x.end, x.kids))
            if not self.eat(",") and not self.at(")"):
                raise Broken
        return out

    def template(self) -> Node:
        t = self.take()
        kids: list[Node] = []
        if t.kind == "head":
            while True:
                kids += self.expression().kids
                piece = self.take()
                if piece.kind == "tail":
                    break
                if piece.kind != "mid":
                    raise Broken
        return Node("", t.start, self.last_end(), kids)

    def new(self) -> Node:
        start = self.take().start
        if self.at("."):
            self.i += 2
            return Node("", start, self.last_end(), [])
        node = self.new() if self.at("new") else self.primary()
        kids = node.kids
        while True:
            if self.at("."):
                self.i += 2
            elif self.at("["):
                self.take()
                kids = kids + self.expression().kids
                self.need("]")
            elif self.at("<") and (more := self.type_arguments()) is not None:
                kids = kids + more
            else:
                break
        if self.at("("):
            kids = kids + [k for a in self.arguments() for k in a.kids]
        return Node("", start, self.last_end(), kids)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "str":
            self.take()
            return Node("", t.start, t.end, [Node("str", t.start, t.end, [])])
        if t.kind in ("num", "regex"):
            self.take()
            return Node("", t.start, t.end, [])
        if t.kind in ("tmpl", "head"):
            return self.template()
        if t.kind == "id":
            if t.text == "function" or t.text == "async" and self.peek().text == "function" and not self.peek().fresh:
                f = self.function(t.start, expression=True)
                return Node("", f.start, f.end, [f])
            if t.text == "class":
                kids = self.class_body()
                return Node("", t.start, self.last_end(), kids)
            if t.text == "new":
                return self.new()
            if t.text in _NOT_OPERAND and t.text not in ("of", "as", "satisfies"):
                raise Broken
            self.take()
            return Node("", t.start, t.end, [])
        if t.kind == "op":
            if t.text == "(":
                self.take()
                inner = self.expression()
                self.need(")")
                return Node("", t.start, self.last_end(), inner.kids)
            if t.text == "[":
                return self.array()
            if t.text == "{":
                return self.object()
            if t.text == "@":
                kids = self.decorators() + self.class_body()
                return Node("", t.start, self.last_end(), kids)
        raise Broken

    def array(self) -> Node:
        start = self.need("[").start
        kids: list[Node] = []
        while not self.eat("]"):
            if self.eat(","):
                continue
            self.eat("...")
            kids += self.assignment().kids
            if not self.eat(",") and not self.at("]"):
                raise Broken
        return Node("", start, self.last_end(), kids)

    def object(self) -> Node:
        """An object literal, a pattern or the body of an enum."""
        start = self.need("{").start
        kids: list[Node] = []
        while not self.eat("}"):
            if self.eat("..."):
                kids += self.assignment().kids
            else:
                while self.now.text in ("get", "set", "async") and self.now.kind == "id" and self.peek().text not in ("(", ":", ",", "}", "=", "<"):
                    self.take()
                self.eat("*")
                kids += self.key()
                if self.at("(", "<"):
                    kids += self.method()
                else:
                    if self.eat(":"):
                        kids += self.assignment().kids
                    if self.eat("="):
                        kids += self.assignment().kids
            if not self.eat(",") and not self.at("}"):
                raise Broken
        return Node("", start, self.last_end(), kids)


def parse(code: str) -> tuple[Node, int]:
    """-> (the tree, how many statements could not be parsed)."""
    p = Parser(code)
    return p.program(), p.errors
