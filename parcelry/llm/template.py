"""A small sandboxed template language: text to syntax tree, constants folded, tree to Python closures.

    {{ expression }}   {% if a %} {% elif b %} {% else %} {% endif %}   {% for x in items %} {% endfor %}
    {% set name = expression %}   {% generation %} {% endgeneration %}   {# comment #}

A minus inside a mark ({{- -}}, {%- -%}, {#- -#}) strips the white space of the text on that side. Marks inside the
strings of an expression do not end it.

Expressions: strings, integers, true, false, none, names, a.key and a['key'] (mappings), a[0] (lists), loop.first / last /
index0 / index, + == != < <= > >= in, not, and, or, parentheses, and filters after a bar. There are no calls and no
attributes of Python objects, so a template reaches nothing but its variables. Unknown names are an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

_STRING = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_PART = re.compile(rf"\{{\{{(-?)((?:{_STRING}|(?!-?\}}\}}).)*)(-?)\}}\}}|\{{%(-?)\s*((?:{_STRING}|(?!\s*-?%\}}).)*)\s*(-?)%\}}|\{{\#(-?).*?(-?)\#\}}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.\[\]()=]))")
_FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": lambda v: len(v),
    "string": str,
}
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}


class TemplateError(ValueError):
    pass


class _Out:
    """Rendered text, its length, and the spans inside generation blocks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.spans = 0, []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


class _Expressions:
    """Recursive descent over one expression's tokens, giving tuples: ("lit", v), ("name", n), (operator, ...)."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, at, self.filters = [], 0, filters
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source!r}")
            kind = m.lastindex
            value = m[kind]
            self.tokens.append(("lit", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), value[1:-1])) if kind == 1 else ("lit", int(value)) if kind == 2 else ("word" if kind == 3 else "op", value))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "lit" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value}")

    def whole(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.sum()
        for op in _COMPARE:
            if self.take(op):
                return ("compare", op, node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.take("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self):
        node = self.access()
        while self.take("|"):
            name = self.word()
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def access(self):
        if self.take("("):
            node = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "lit":
            node = self.tokens[self.at]
            self.at += 1
        else:
            name = self.word()
            node = ("lit", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)
        while self.peek(".", "["):
            if self.take("."):
                node = ("get", node, ("lit", self.word()))
            else:
                self.need("[")
                node = ("get", node, self.either())
                self.need("]")
        return node


def parse(source: str, filters: Mapping[str, Callable] | None = None) -> tuple:
    """The syntax tree of a template: ("block", [nodes])."""
    known = _FILTERS | dict(filters or {})
    stack: list[tuple[str, list, Any]] = [("root", [], None)]
    at = 0

    def expression(text: str):
        return _Expressions(text, known).whole()

    strip = False  # whether the mark before asks to strip the text that follows

    def text(part: str, before: bool, after: bool) -> None:
        part = part.lstrip() if before else part
        part = part.rstrip() if after else part
        if part:
            stack[-1][1].append(("text", part))

    for m in _PART.finditer(source):
        text(source[at : m.start()], strip, bool(m[1] or m[4] or m[7]))
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
        if m[2] is not None:
            stack[-1][1].append(("show", expression(m[2])))
            continue
        if m[5] is None:
            continue
        word, _, rest = m[5].partition(" ")
        if word == "if":
            stack.append(("if", [], [("when", expression(rest))]))
        elif word in ("elif", "else"):
            kind, body, extra = stack.pop()
            if kind != "if":
                raise TemplateError(f"{word} outside if")
            extra[-1] = (*extra[-1], ("block", body))
            extra.append(("when", expression(rest) if word == "elif" else ("lit", True)))
            stack.append(("if", [], extra))
        elif word == "for":
            name, middle, items = rest.partition(" in ")
            if not middle or not name.strip().isidentifier():
                raise TemplateError("for needs: name in expression")
            stack.append(("for", [], (name.strip(), expression(items))))
        elif word == "generation":
            stack.append(("generation", [], None))
        elif word == "set":
            name, middle, value = rest.partition("=")
            if not middle or not name.strip().isidentifier():
                raise TemplateError("set needs: name = expression")
            stack[-1][1].append(("set", name.strip(), expression(value)))
        elif word in ("endif", "endfor", "endgeneration"):
            kind, body, extra = stack.pop()
            if "end" + kind != word:
                raise TemplateError(f"{word} closes {kind}")
            if kind == "if":
                extra[-1] = (*extra[-1], ("block", body))
                node = ("if", [(c, b) for _, c, b in extra])
            else:
                node = (kind, *(extra or ()), ("block", body))
            stack[-1][1].append(node)
        else:
            raise TemplateError(f"unknown statement {word!r}")
    text(source[at:], strip, False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][1])


def fold(node, filters: Mapping[str, Callable] | None = None):
    """The tree with constant expressions evaluated, dead branches dropped and neighbouring texts joined."""
    known = _FILTERS | dict(filters or {})

    def go(n):
        kind = n[0]
        if kind in ("lit", "name", "text"):
            return n
        if kind == "block":
            out = []
            for x in map(go, n[1]):
                items = x[1] if x[0] == "block" else [x]
                for y in items:
                    if y[0] == "text" and out and out[-1][0] == "text":
                        out[-1] = ("text", out[-1][1] + y[1])
                    elif y != ("text", ""):
                        out.append(y)
            return ("block", out)
        if kind == "show":
            e = go(n[1])
            return ("text", _shown(e[1])) if e[0] == "lit" else ("show", e)
        if kind == "if":
            arms = []
            for c, b in n[1]:
                c = go(c)
                if c[0] != "lit":
                    arms.append((c, go(b)))
                elif c[1]:
                    arms.append((c, go(b)))
                    break
            if not arms:
                return ("block", [])
            return arms[0][1] if arms[0][0][0] == "lit" else ("if", arms)
        if kind == "for":
            return ("for", n[1], go(n[2]), go(n[3]))
        if kind == "generation":
            return ("generation", go(n[1]))
        if kind == "set":
            return ("set", n[1], go(n[2]))
        if kind == "filter":
            e = go(n[2])
            return ("lit", known[n[1]](e[1])) if e[0] == "lit" else ("filter", n[1], e)
        if kind == "compare":
            a, b = go(n[2]), go(n[3])
            return ("lit", _COMPARE[n[1]](a[1], b[1])) if a[0] == b[0] == "lit" else ("compare", n[1], a, b)
        if kind == "add":
            a, b = go(n[1]), go(n[2])
            return ("lit", a[1] + b[1]) if a[0] == b[0] == "lit" else ("add", a, b)
        if kind == "not":
            a = go(n[1])
            return ("lit", not a[1]) if a[0] == "lit" else ("not", a)
        if kind in ("and", "or"):
            a, b = go(n[1]), go(n[2])
            if a[0] == "lit":
                return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
            return (kind, a, b)
        return ("get", go(n[1]), go(n[2]))

    return go(node)


def _shown(v: Any) -> str:
    return "" if v is None else str(v)


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping[str, Any]], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans of generation blocks in code points)."""
    known = _FILTERS | dict(filters or {})
    body = _statement(fold(parse(source, filters), filters), known)

    def render(variables: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        body(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


def _statement(node, known) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        return lambda v, out, s=node[1]: out.write(s)
    if kind == "show":
        e = _value(node[1], known)
        return lambda v, out: out.write(_shown(e(v)))
    if kind == "block":
        steps = [_statement(n, known) for n in node[1]]
        if len(steps) == 1:
            return steps[0]

        def block(v, out):
            for s in steps:
                s(v, out)

        return block
    if kind == "if":
        arms = [(_value(c, known), _statement(b, known)) for c, b in node[1]]

        def choose(v, out):
            for c, b in arms:
                if c(v):
                    return b(v, out)

        return choose
    if kind == "set":
        e = _value(node[2], known)
        return lambda v, out, name=node[1]: v.__setitem__(name, e(v))
    if kind == "generation":
        inner = _statement(node[1], known)

        def mark(v, out):
            start = out.size
            inner(v, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return mark
    name, items, inner = node[1], _value(node[2], known), _statement(node[3], known)

    def loop(v, out):
        rows = list(items(v))
        own = dict(v)
        for i, row in enumerate(rows):
            own[name] = row
            own["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            inner(own, out)

    return loop


def _value(node, known) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "lit":
        return lambda v, c=node[1]: c
    if kind == "name":
        def name(v, n=node[1]):
            if n not in v:
                raise TemplateError(f"no variable {n}")
            return v[n]

        return name
    if kind == "get":
        a, b = _value(node[1], known), _value(node[2], known)

        def get(v):
            x, k = a(v), b(v)
            if isinstance(x, (list, tuple)) and isinstance(k, int):
                if not -len(x) <= k < len(x):
                    raise TemplateError(f"no item {k}")
                return x[k]
            if not isinstance(x, Mapping):
                raise TemplateError("only mappings have keys, and lists numbers")
            return x.get(k)

        return get
    if kind == "filter":
        f, a = known[node[1]], _value(node[2], known)
        return lambda v: f(a(v))
    if kind == "compare":
        f, a, b = _COMPARE[node[1]], _value(node[2], known), _value(node[3], known)
        return lambda v: f(a(v), b(v))
    if kind == "not":
        a = _value(node[1], known)
        return lambda v: not a(v)
    a, b = _value(node[1], known), _value(node[2], known)
    if kind == "add":
        return lambda v: a(v) + b(v)
    if kind == "and":
        return lambda v: a(v) and b(v)
    return lambda v: a(v) or b(v)
