"""A compiler for a small sandboxed template language.

Source -> syntax tree -> folded tree -> Python closures. A template sees the values it is given and
nothing else: names come from that mapping, attributes are keys of mappings, functions are the
filters below, and there are no calls, assignments to attributes or imports.

    {{ expression }}  {# comment #}  {% set name = expression %}
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in e %} {% endfor %}         with loop.index, loop.index0, loop.first, loop.last
    {% generation %} {% endgeneration %}     what a model is to learn

A dash inside a tag (``{%-``, ``-%}``) strips the white space beside it. Rendering calls
``emit(text, learned)`` piece after piece and takes any iterable of turns, so a conversation of any
length renders in constant memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\](),]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
_KEYWORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


class TemplateError(ValueError):
    """The source isn't in the language, or asks for what it doesn't offer."""


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "lower": lambda v: _text(v).lower(), "upper": lambda v: _text(v).upper(),
    "string": _text, "length": lambda v: len(v), "default": lambda v, d="": d if v is None else v,
}


class _Parser:
    def __init__(self, filters: Mapping[str, Callable]):
        self.filters = filters

    # Statements: ("text", s) ("out", e) ("if", [(e, body)], else) ("for", name, e, body) ("set", name, e) ("generation", body)

    def template(self, source: str) -> list:
        self.parts, at, strip = [], 0, False
        for m in _TAG.finditer(source):
            before = source[at : m.start()]
            before = before.lstrip() if strip else before
            before = before.rstrip() if m[1] or m[4] else before
            if before:
                self.parts.append(("text", before))
            if m[2] is not None:
                self.parts.append(("out", m[2]))
            elif m[5] is not None:
                self.parts.append(("tag", m[5].strip()))
            strip, at = bool(m[3] or m[6]), m.end()
        rest = source[at:].lstrip() if strip else source[at:]
        if rest:
            self.parts.append(("text", rest))
        self.i = 0
        body, end = self._body(())
        return body

    def _body(self, ends: tuple[str, ...]) -> tuple[list, str]:
        out = []
        while self.i < len(self.parts):
            kind, value = self.parts[self.i]
            self.i += 1
            if kind == "text":
                out.append((kind, value))
            elif kind == "out":
                out.append(("out", self.expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                out.append(self._statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def _statement(self, word: str, rest: str):
        if word == "generation":
            return ("generation", self._body(("endgeneration",))[0])
        if word == "set":
            name, eq, value = rest.partition("=")
            return ("set", self._name(name), self.expression(value)) if eq else self._fail(rest)
        if word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S) or self._fail(rest)
            return ("for", self._name(m[1]), self.expression(m[2]), self._body(("endfor",))[0])
        if word == "if":
            arms, other, test = [], [], rest
            while True:
                body, end = self._body(("elif", "else", "endif"))
                arms.append((self.expression(test), body))
                if end.startswith("elif"):
                    test = end[4:]
                    continue
                if end == "else":
                    other, _ = self._body(("endif",))
                return ("if", arms, other)
        return self._fail(word)

    def _name(self, name: str) -> str:
        name = name.strip()
        if not re.fullmatch(r"[A-Za-z]\w*", name) or name in _KEYWORDS or name == "loop":
            raise TemplateError(f"{name!r} can't be a name here")
        return name

    @staticmethod
    def _fail(what: str):
        raise TemplateError(f"not understood: {what!r}")

    # Expressions: ("const", v) ("name", n) ("get", e, e) ("filter", name, [e]) ("not", e) ("and"/"or", e, e) ("cmp", op, e, e) ("~"/"+"/"-", e, e) ("choose", test, yes, no)

    def expression(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at) or self._fail(source[at:])
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.t = 0
        out = self._choose()
        return out if self.t == len(self.tokens) else self._fail(source)

    def _peek(self, *values: str) -> bool:
        return self.t < len(self.tokens) and self.tokens[self.t][0] != "str" and self.tokens[self.t][1] in values

    def _take(self, *values: str) -> bool:
        found = self._peek(*values)
        self.t += found
        return found

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise TemplateError(f"{value!r} is missing")

    def _choose(self):
        yes = self._or()
        if not self._take("if"):
            return yes
        test = self._or()
        no = self._choose() if self._take("else") else ("const", None)
        return ("choose", test, yes, no)

    def _or(self):
        out = self._and()
        while self._take("or"):
            out = ("or", out, self._and())
        return out

    def _and(self):
        out = self._not()
        while self._take("and"):
            out = ("and", out, self._not())
        return out

    def _not(self):
        return ("not", self._not()) if self._take("not") else self._compare()

    def _compare(self):
        out = self._sum()
        while self._peek("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            op = self.tokens[self.t][1]
            self.t += 1
            if op == "not":
                self._need("in")
                op = "not in"
            out = ("cmp", op, out, self._sum())
        return out

    def _sum(self):
        out = self._filtered()
        while self._peek("~", "+", "-"):
            op = self.tokens[self.t][1]
            self.t += 1
            out = (op, out, self._filtered())
        return out

    def _filtered(self):
        out = self._primary()
        while self._take("|"):
            kind, name = self.tokens[self.t] if self.t < len(self.tokens) else ("", "")
            self.t += 1
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            args = [out]
            if self._take("("):
                while not self._take(")"):
                    args.append(self._choose())
                    self._take(",")
            out = ("filter", name, args)
        return out

    def _primary(self):
        if self.t >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.t]
        self.t += 1
        if kind == "int":
            out = ("const", int(value))
        elif kind == "str":
            out = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif value in ("true", "false", "none"):
            out = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and value not in _KEYWORDS:
            out = ("name", value)
        elif value == "(":
            out = self._choose()
            self._need(")")
        else:
            return self._fail(value)
        while self._peek(".", "["):
            if self._take("."):
                kind, key = self.tokens[self.t] if self.t < len(self.tokens) else ("", "")
                self.t += 1
                if kind != "name" or key.startswith("_"):
                    raise TemplateError(f"no attribute {key!r}")
                out = ("get", out, ("const", key))
            else:
                self._take("[")
                out = ("get", out, self._choose())
                self._need("]")
        return out


def fold(node, filters: Mapping[str, Callable]):
    """The tree with constant expressions computed, dead branches gone and texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x[1] if x[0] == "body" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                else:
                    out.append(y)
        return out
    kind = node[0]
    if kind in ("text", "const", "name"):
        return node
    if kind == "out":
        e = fold(node[1], filters)
        return ("text", _text(e[1])) if e[0] == "const" else ("out", e)
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test, body = fold(test, filters), fold(body, filters)
            if test[0] != "const":
                arms.append((test, body))
            elif test[1]:
                return ("if", arms, body) if arms else ("body", body)
        other = fold(node[2], filters)
        return ("if", arms, other) if arms else ("body", other)
    if kind == "filter":
        out = ("filter", node[1], [fold(x, filters) for x in node[2]])
        parts = out[2]
    elif kind == "cmp":
        parts = [fold(x, filters) for x in node[2:]]
        out = ("cmp", node[1], *parts)
    else:
        parts = [fold(x, filters) for x in node[1:]]
        if kind == "choose" and parts[0][0] == "const":
            return parts[1] if parts[0][1] else parts[2]
        out = (kind, *parts)
    if all(x[0] == "const" for x in parts):
        return ("const", _value(out, filters)({}))
    return out


def _value(node, filters) -> Callable[[Mapping], Any]:
    """The closure of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "filter":
        call, args = filters[node[1]], [_value(x, filters) for x in node[2]]
        if len(args) == 1:
            only = args[0]
            return lambda names: call(only(names))
        return lambda names: call(*[a(names) for a in args])
    if kind == "cmp":
        compare, a, b = _COMPARE[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda names: compare(a(names), b(names))
    parts = [_value(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda names: not parts[0](names)
    if kind == "choose":
        test, yes, no = parts
        return lambda names: yes(names) if test(names) else no(names)
    a, b = parts
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    if kind == "~":
        return lambda names: _text(a(names)) + _text(b(names))
    if kind == "get":
        return lambda names: _get(a(names), b(names))
    add = operator.add if kind == "+" else operator.sub

    def arithmetic(names):
        x, y = a(names), b(names)
        if not (isinstance(x, int) and isinstance(y, int)):
            raise TemplateError(f"{kind} takes whole numbers; ~ joins texts")
        return add(x, y)

    return arithmetic


def _get(holder, key):
    return holder.get(key) if isinstance(holder, Mapping) else None


def _with_last(items: Iterable):
    """(index, item, whether it is the last), one item ahead."""
    held, n = [], 0
    for item in items:
        if held:
            yield n, held.pop(), False
            n += 1
        held.append(item)
    if held:
        yield n, held[0], True


def _statement(node, filters, learned: bool) -> Callable[[dict, Callable], None]:
    """The closure of a statement."""
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda names, emit: emit(text, learned)
    if kind == "out":
        value = _value(node[1], filters)
        return lambda names, emit: emit(_text(value(names)), learned)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def assign(names, emit):
            names[name] = value(names)

        return assign
    if kind == "generation":
        return _block(node[1], filters, True)
    if kind == "if":
        arms = [(_value(e, filters), _block(b, filters, learned)) for e, b in node[1]]
        other = _block(node[2], filters, learned)

        def choose(names, emit):
            for test, body in arms:
                if test(names):
                    return body(names, emit)
            return other(names, emit)

        return choose
    name, items, body = node[1], _value(node[2], filters), _block(node[3], filters, learned)

    def loop(names, emit):
        for i, item, last in _with_last(items(names) or ()):
            body(names | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": last}}, emit)

    return loop


def _block(nodes, filters, learned: bool) -> Callable[[dict, Callable], None]:
    steps = [_statement(n, filters, learned) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(names, emit):
        for step in steps:
            step(names, emit)

    return run


class Template:
    """A compiled template; ``tree`` is the folded syntax tree."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        filters = {**FILTERS, **(filters or {})}
        self.tree = fold(_Parser(filters).template(source), filters)
        self._run = _block(self.tree, filters, False)

    def render(self, names: Mapping[str, Any], emit: Callable[[str, bool], None]) -> None:
        """Call ``emit(text, learned)`` for each piece of the rendered text."""
        self._run(dict(names), emit)

    def text(self, **names) -> str:
        out: list[str] = []
        self.render(names, lambda text, learned: out.append(text))
        return "".join(out)
