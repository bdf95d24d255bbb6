"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded (literal operations, filters and branches, neighbouring text), and
the tree is turned into Python closures, once per worker. The language is the part of the usual chat template language that published
templates need, and it is sandboxed: values are strings, numbers, booleans, none, undefined, lists and records; a name is looked up in the given
variables and a field in a record, nothing else can be reached; the only calls are the filters, methods and functions below; the only loop
is over a list.

    {{ expr }}   {# comment #}   {%- ... -%} strips white space on that side; trim_blocks=True also drops the line break after
    a block tag and the blanks before one that stands first in its line
    {% for m in messages %} ... {% endfor %}           with loop.index, index0, first, last, length; for k, v in pairs
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set x = expr %}   {% set ns.x = expr %}         x outlives an if, not a loop; ns comes from namespace(x=...) and outlives both
    {% generation %} ... {% endgeneration %}           marks what the model is to produce

    expr: literals, [a, b], {'a': b}, names, a.b, a['b'], a[1:], + - * // % ~, == != < <= > >=, in, not in, and, or, not, x if c else y, x | filter,
          x is (not) defined, undefined, none, string, number, mapping, iterable, true, false
    filters: trim, upper, lower, length, capitalize, title, string, first, last, tojson, default(v), replace(a, b), join(s)
    methods: strip, lstrip, rstrip, split, startswith, endswith, of texts; items, get, of records
    functions: namespace(...), raise_exception(text)

render() gives a conversation's text and the character spans of its generation blocks. A message has role, text and content (the same as text).

Defined cases: a null role or text is an empty string; a null turn comes first; turns that tie are ordered by role and
text, and repeated rows are rendered each time; a null conversation id is a conversation; other columns are ignored;
an empty table gives an empty result. An unknown name, filter or tag is a TemplateError when the template is compiled (a name may be asked for
with is defined or default), an operation on unsuitable values one when it is rendered. A conversation is one row of the result, so a
worker holds the longest one as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = """\
{%- for m in messages -%}
{{ '<|im_start|>' + m.role + '\\n' }}
{%- if m.role == 'assistant' -%}
{%- generation -%}{{ m.text + '<|im_end|>' }}{%- endgeneration -%}
{%- else -%}
{{ m.text + '<|im_end|>' }}
{%- endif -%}
{{ '\\n' }}
{%- endfor -%}
"""
VARIABLES = ("messages", "add_generation_prompt", "bos_token", "eos_token", "tools")


class TemplateError(ValueError):
    """What is wrong with a template."""


class _Undefined:
    """The value of what isn't there: false, and written as nothing."""

    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


class _Namespace(dict):
    """A record that set can change."""


#: What operations on unsuitable values raise.
_FAULTS = (TypeError, ValueError, ZeroDivisionError, AttributeError, LookupError, OverflowError, RecursionError)


# --- syntax tree ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    parts: tuple


@dataclass(frozen=True)
class Listing:
    """A list, or a record if there are keys."""

    parts: tuple
    keys: tuple | None = None


@dataclass(frozen=True)
class Test:
    of: Any
    name: str


@dataclass(frozen=True)
class Call:
    """A method of of, or a function if there is none; keys: the names of the arguments of namespace."""

    of: Any
    name: str
    parts: tuple
    keys: tuple = ()


@dataclass(frozen=True)
class Op:
    """name: operator or filter; and, or and if don't evaluate all of their parts."""

    name: str
    parts: tuple


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class For:
    names: tuple
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    key: str | None
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- operations -----------------------------------------------------------------------------------------------------


def _text(v: Any) -> str:
    if v is None or v is UNDEFINED:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (str, int, float)):
        return str(v)
    raise TemplateError(f"{type(v).__name__} can't be written as text")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("+ needs two texts or two numbers; ~ joins anything")
    return a + b


def _contains(a: Any, b: Any) -> bool:
    if not isinstance(b, (str, list, tuple, dict)):
        raise TemplateError("in needs a text, a list or a record")
    return a in b


def _times(a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) or isinstance(b, (str, list)):
        raise TemplateError("* needs two numbers")
    return a * b


def _modulo(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        raise TemplateError("% needs two numbers")
    return a % b


OPERATIONS: dict[str, Callable] = {
    "+": _plus, "-": lambda a, b: a - b, "*": _times, "//": lambda a, b: a // b, "%": _modulo, "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": _contains, "not in": lambda a, b: not _contains(a, b), "not": lambda a: not a, "neg": lambda a: -a,
}
def _string(v: Any, name: str) -> str:
    if not isinstance(v, str):
        raise TemplateError(f"{name} needs a text")
    return v


def _length(v: Any) -> int:
    if not isinstance(v, (str, list, tuple, dict)):
        raise TemplateError("length needs a text, a list or a record")
    return len(v)


def _end(v: Any, at: int) -> Any:
    if not isinstance(v, (str, list, tuple)):
        raise TemplateError("first and last need a text or a list")
    return v[at] if v else UNDEFINED


def _replace(v: Any, a: Any, b: Any) -> str:
    return _text(v).replace(_string(a, "replace"), _string(b, "replace"))


def _raise(message: Any) -> Any:
    raise TemplateError(_text(message))


def _record(v: Any, name: str) -> dict:
    if not isinstance(v, dict):
        raise TemplateError(f"{name} needs a record")
    return v


FILTERS: dict[str, tuple[int, Callable]] = {
    "trim": (0, lambda v: _text(v).strip()), "upper": (0, lambda v: _text(v).upper()), "lower": (0, lambda v: _text(v).lower()), "capitalize": (0, lambda v: _text(v).capitalize()),
    "title": (0, lambda v: _text(v).title()), "string": (0, _text), "first": (0, lambda v: _end(v, 0)), "last": (0, lambda v: _end(v, -1)), "tojson": (0, lambda v: json.dumps(v, ensure_ascii=False)),
    "length": (0, _length), "default": (1, lambda v, d: d if v is None or v is UNDEFINED else v), "replace": (2, _replace), "join": (1, lambda v, s: _string(s, "join").join(map(_text, v))),
}
METHODS: dict[str, tuple[tuple[int, ...], Callable]] = {
    "strip": ((0, 1), lambda v, *a: _string(v, "strip").strip(*a)), "lstrip": ((0, 1), lambda v, *a: _string(v, "lstrip").lstrip(*a)), "rstrip": ((0, 1), lambda v, *a: _string(v, "rstrip").rstrip(*a)),
    "split": ((0, 1), lambda v, *a: _string(v, "split").split(*a)), "startswith": ((1,), lambda v, a: _string(v, "startswith").startswith(_string(a, "startswith"))),
    "endswith": ((1,), lambda v, a: _string(v, "endswith").endswith(_string(a, "endswith"))),
    "items": ((0,), lambda v: [list(x) for x in _record(v, "items").items()]), "get": ((1, 2), lambda v, k, *d: _record(v, "get").get(k, *d)),
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not UNDEFINED, "undefined": lambda v: v is UNDEFINED, "none": lambda v: v is None, "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "mapping": lambda v: isinstance(v, dict), "iterable": lambda v: isinstance(v, (str, list, tuple, dict)),
    "true": lambda v: v is True, "false": lambda v: v is False,
}

# --- parser -----------------------------------------------------------------------------------------------------------

_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_TAG = re.compile(rf"\{{\{{(-?)((?:{_QUOTED}|(?!-?\}}\}}).)*)(-?)\}}\}}|\{{%(-?)((?:{_QUOTED}|(?!-?%\}}).)*)(-?)%\}}|\{{#(-?).*?(-?)#\}}", re.S)
_TOKEN = re.compile(rf"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>{_QUOTED})|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=:{{}}]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_KEYWORDS = {"and", "or", "not", "in", "if", "else", "is"}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string"

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _KEYWORDS:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expr(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expr() if self.take("else") else Const(None)
            return Op("if", (test, value, other))
        return value

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.added()
        while True:
            for sign in ("==", "!=", "<=", ">=", "<", ">", "in"):
                if self.take(sign):
                    left = Op(sign, (left, self.added()))
                    break
            else:
                if self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                    self.at += 2
                    left = Op("not in", (left, self.added()))
                elif self.take("is"):
                    negated, at = self.take("not"), self.at
                    name = self.tokens[at][1].lower() if at < len(self.tokens) else ""
                    self.at += 1
                    if name not in TESTS:
                        raise TemplateError(f"unknown test {name!r}")
                    left = Op("not", (Test(left, name),)) if negated else Test(left, name)
                else:
                    return left

    def added(self) -> Any:
        left = self.multiplied()
        while self.peek("+", "-", "~"):
            sign = self.tokens[self.at][1]
            self.at += 1
            left = Op(sign, (left, self.multiplied()))
        return left

    def multiplied(self) -> Any:
        left = self.filtered()
        while self.peek("*", "//", "%"):
            sign = self.tokens[self.at][1]
            self.at += 1
            left = Op(sign, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = Op("neg", (self.reached(),)) if self.take("-") else self.reached()
        while self.take("|"):
            name, given = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    given.append(self.expr())
                    if not self.peek(")"):
                        self.need(",")
            if len(given) != FILTERS[name][0]:
                raise TemplateError(f"{name} takes {FILTERS[name][0]} arguments")
            value = Op(name, (value, *given))
        return value

    def given(self) -> tuple[tuple, tuple]:
        """Arguments and their names, up to the closing parenthesis."""
        parts, keys = [], []
        while not self.take(")"):
            named = self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("sign", "=")
            if named:
                keys.append(self.name())
                self.need("=")
            elif keys:
                raise TemplateError("an argument has no name")
            parts.append(self.expr())
            if not self.peek(")"):
                self.need(",")
        return tuple(parts), tuple(keys)

    def reached(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                name = self.name()
                if self.take("("):
                    parts, keys = self.given()
                    if name not in METHODS or keys or len(parts) not in METHODS[name][0]:
                        raise TemplateError(f"there is no such method as {name!r}")
                    value = Call(value, name, parts)
                else:
                    value = Field(value, Const(name))
            elif self.take("["):
                value = self.place(value)
            else:
                return value

    def place(self, value: Any) -> Any:
        """What stands in square brackets: a key, or up to three parts of a slice."""
        parts, colons = [Const(None)], 0
        while not self.take("]"):
            if self.take(":"):
                colons += 1
                parts.append(Const(None))
            else:
                parts[-1] = self.expr()
                if not self.peek(":", "]"):
                    self.need("]")
        if colons > 2 or (not colons and parts[0] == Const(None) and self.tokens[self.at - 2][1] == "["):
            raise TemplateError("there is no such place")
        return Slice(value, tuple(parts)) if colons else Field(value, parts[0])

    def atom(self) -> Any:
        if self.take("("):
            value = self.expr()
            self.need(")")
            return value
        if self.take("["):
            parts = []
            while not self.take("]"):
                parts.append(self.expr())
                if not self.peek("]"):
                    self.need(",")
            return Listing(tuple(parts))
        if self.take("{"):
            keys, parts = [], []
            while not self.take("}"):
                keys.append(self.expr())
                self.need(":")
                parts.append(self.expr())
                if not self.peek("}"):
                    self.need(",")
            return Listing(tuple(parts), tuple(keys))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Const(float(value) if "." in value else int(value))
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        name = self.name()
        literal = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
        if name in literal:
            return Const(literal[name])
        if name in ("namespace", "raise_exception") and self.take("("):
            parts, keys = self.given()
            if len(parts) != len(keys) if name == "namespace" else keys or len(parts) != 1:
                raise TemplateError(f"{name} can't be called so")
            return Call(None, name, parts, keys)
        return Name(name)


def parse(source: str, trim_blocks: bool = False) -> tuple:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at, strip_next, block, next_block = 0, False, False, False

    def text(upto: int, strip: bool) -> None:
        s = source[at:upto]
        if strip_next:
            s = s.lstrip()
        elif trim_blocks and block:
            s = s[1:] if s.startswith("\n") else s
        if strip:
            s = s.rstrip()
        elif trim_blocks and next_block:
            head, line, tail = s.rpartition("\n")
            s = head + line if not tail.strip(" \t") and (line or not at) else s
        parts.append(("text", s))

    for m in _TAG.finditer(source):
        left, right = next(g for g in (m[1], m[4], m[7]) if g is not None), next(g for g in (m[3], m[6], m[8]) if g is not None)
        next_block = m[2] is None
        text(m.start(), left == "-")
        if m[2] is not None:
            parts.append(("expr", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5]))
        at, strip_next, block = m.end(), right == "-", next_block
    next_block = False
    text(len(source), False)
    body, rest, _ = _block(parts, 0, ())
    if rest < len(parts):
        raise TemplateError("an end tag has no beginning")
    return body


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, _Expression | None]:
    """The nodes up to one of the end tags, the place after it, and the rest of that tag."""
    nodes: list = []
    while at < len(parts):
        kind, content = parts[at]
        at += 1
        if kind == "text":
            if content:
                nodes.append(Const(content))
            continue
        e = _Expression(content)
        if kind == "expr":
            nodes.append(Output(e.expr()))
            e.end()
            continue
        tag = e.name() if not e.peek("if", "else") else e.tokens[e.at][1]
        if e.peek("if", "else"):
            e.at += 1
        if tag in ends:
            e.tag = tag
            return tuple(nodes), at, e
        if tag == "for":
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            over = e.expr()
            e.end()
            body, at, _ = _block(parts, at, ("endfor",))
            nodes.append(For(tuple(names), over, body))
        elif tag == "if":
            node, at = _branch(e, parts, at)
            nodes.append(node)
        elif tag == "set":
            name = e.name()
            key = e.name() if e.take(".") else None
            e.need("=")
            nodes.append(Set(name, key, e.expr()))
            e.end()
        elif tag == "generation":
            e.end()
            body, at, _ = _block(parts, at, ("endgeneration",))
            nodes.append(Generation(body))
        else:
            raise TemplateError(f"unknown tag {tag!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at, None


def _branch(e: _Expression, parts: list[tuple[str, str]], at: int) -> tuple[If, int]:
    test = e.expr()
    e.end()
    then, at, end = _block(parts, at, ("elif", "else", "endif"))
    if end.tag == "elif":
        node, at = _branch(end, parts, at)
        return If(test, then, (node,)), at
    other: tuple = ()
    if end.tag == "else":
        end.end()
        other, at, _ = _block(parts, at, ("endif",))
    return If(test, then, other), at


# --- constant folding -------------------------------------------------------------------------------------------------


def fold_expr(e: Any) -> Any:
    """The same expression with less to do; what would never be evaluated isn't, and what can't be computed is left as it is."""
    if isinstance(e, Field):
        return Field(fold_expr(e.of), fold_expr(e.key))
    if isinstance(e, Slice):
        return Slice(fold_expr(e.of), tuple(map(fold_expr, e.parts)))
    if isinstance(e, Listing):
        return Listing(tuple(map(fold_expr, e.parts)), e.keys and tuple(map(fold_expr, e.keys)))
    if isinstance(e, Test):
        return Test(fold_expr(e.of), e.name)
    if isinstance(e, Call):
        return Call(e.of and fold_expr(e.of), e.name, tuple(map(fold_expr, e.parts)), e.keys)
    if not isinstance(e, Op):
        return e
    first = fold_expr(e.parts[0])
    if e.name == "if" and isinstance(first, Const):
        return fold_expr(e.parts[1] if first.value else e.parts[2])
    if e.name in ("and", "or") and isinstance(first, Const):
        return fold_expr(e.parts[1]) if bool(first.value) == (e.name == "and") else first
    parts = (first, *map(fold_expr, e.parts[1:]))
    if e.name == "+" and isinstance(parts[1], Const) and isinstance(first, Op) and first.name == "+" and isinstance(first.parts[1], Const):
        a, b = first.parts[1].value, parts[1].value
        if isinstance(a, str) and isinstance(b, str):
            return Op("+", (first.parts[0], Const(a + b)))
    if e.name not in ("if", "and", "or") and all(isinstance(p, Const) for p in parts):
        try:
            return Const(_function(e.name)(*[p.value for p in parts]))
        except _FAULTS:
            return Op(e.name, parts)
    return Op(e.name, parts)


def fold(nodes: tuple) -> tuple:
    """The same template with less to do: literals computed, dead branches gone, neighbouring texts joined."""
    out: list = []

    def add(n: Any) -> None:
        if isinstance(n, Const):
            if out and isinstance(out[-1], Const):
                out[-1] = Const(out[-1].value + n.value)
            elif n.value:
                out.append(n)
        else:
            out.append(n)

    for n in nodes:
        if isinstance(n, Output):
            e = fold_expr(n.expr)
            for part in _addends(e):
                add(Const(_text(part.value)) if isinstance(part, Const) and not isinstance(part.value, (list, dict)) else Output(part))
        elif isinstance(n, If):
            test = fold_expr(n.test)
            if isinstance(test, Const):
                for x in fold(n.then if test.value else n.other):
                    add(x)
            else:
                out.append(If(test, fold(n.then), fold(n.other)))
        elif isinstance(n, For):
            out.append(For(n.names, fold_expr(n.over), fold(n.body)))
        elif isinstance(n, Set):
            out.append(Set(n.name, n.key, fold_expr(n.expr)))
        elif isinstance(n, Generation):
            out.append(Generation(fold(n.body)))
        else:
            add(n)
    return tuple(out)


def _addends(e: Any) -> list:
    """a ~ b is written as a, then b, so that literal ends join the text around them."""
    if isinstance(e, Op) and e.name == "~":
        return _addends(e.parts[0]) + _addends(e.parts[1])
    return [e]


# --- closures ---------------------------------------------------------------------------------------------------------


def _function(name: str) -> Callable:
    return OPERATIONS[name] if name in OPERATIONS else FILTERS[name][1]


def _expr(e: Any, names: frozenset[str]) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        if e.name not in names:
            raise TemplateError(f"unknown name {e.name!r}")
        name = e.name
        return lambda env: env.get(name, UNDEFINED)
    if isinstance(e, Field):
        of, key = _expr(e.of, names), _expr(e.key, names)
        return lambda env: _reach(of(env), key(env))
    if isinstance(e, Slice):
        of, bounds = _expr(e.of, names), [_expr(p, names) for p in e.parts]
        return lambda env: _cut(of(env), slice(*[b(env) for b in bounds]))
    if isinstance(e, Listing):
        values, keys = [_expr(p, names) for p in e.parts], e.keys and [_expr(k, names) for k in e.keys]
        return lambda env: {k(env): v(env) for k, v in zip(keys, values)} if keys is not None else [v(env) for v in values]
    if isinstance(e, Test):
        test = TESTS[e.name]
        if isinstance(e.of, Name) and e.of.name not in names:
            answer = test(UNDEFINED)
            return lambda env: answer
        value = _expr(e.of, names)
        return lambda env: test(value(env))
    if isinstance(e, Call):
        given = [_expr(p, names) for p in e.parts]
        if e.name == "namespace":
            return lambda env: _Namespace(zip(e.keys, [g(env) for g in given]))
        if e.name == "raise_exception":
            return lambda env: _raise(given[0](env))
        of, method = _expr(e.of, names), METHODS[e.name][1]
        return lambda env: method(of(env), *[g(env) for g in given])
    if e.name == "default" and isinstance(e.parts[0], Name) and e.parts[0].name not in names:
        return _expr(e.parts[1], names)
    parts = [_expr(p, names) for p in e.parts]
    if e.name == "if":
        test, then, other = parts
        return lambda env: then(env) if test(env) else other(env)
    if e.name == "and":
        a, b = parts
        return lambda env: a(env) and b(env)
    if e.name == "or":
        a, b = parts
        return lambda env: a(env) or b(env)
    f = _function(e.name)
    if len(parts) == 1:
        a = parts[0]
        return lambda env: f(a(env))
    if len(parts) == 2:
        a, b = parts
        return lambda env: f(a(env), b(env))
    return lambda env: f(*[p(env) for p in parts])


def _reach(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    raise TemplateError("only records have fields, and only lists and texts have places")


def _cut(of: Any, part: slice) -> Any:
    if not isinstance(of, (str, list, tuple)):
        raise TemplateError("only texts and lists can be sliced")
    return of[part]


def _names_set(nodes: tuple) -> set[str]:
    """The names that may be set once these nodes have run; those of loops end with them."""
    found: set[str] = set()
    for n in nodes:
        if isinstance(n, Set) and n.key is None:
            found.add(n.name)
        elif isinstance(n, If):
            found |= _names_set(n.then) | _names_set(n.other)
        elif isinstance(n, Generation):
            found |= _names_set(n.body)
    return found


@dataclass
class _Out:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def _body(nodes: tuple, names: frozenset[str]) -> Callable[[dict, _Out], None]:
    steps = []
    for n in nodes:
        steps.append(_node(n, names))
        names = names | _names_set((n,))
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: _Out) -> None:
        for s in steps:
            s(env, out)

    return run


def _node(n: Any, names: frozenset[str]) -> Callable[[dict, _Out], None]:
    if isinstance(n, Const):
        text = n.value
        return lambda env, out: out.write(text)
    if isinstance(n, Output):
        value = _expr(n.expr, names)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(n, Set):
        value, name, key = _expr(n.expr, names), n.name, n.key
        if key is not None and name not in names:
            raise TemplateError(f"unknown name {name!r}")

        def assign(env: dict, out: _Out) -> None:
            if key is None:
                env[name] = value(env)
            elif isinstance(env.get(name), _Namespace):
                env[name][key] = value(env)
            else:
                raise TemplateError("only a namespace's fields can be set")

        return assign
    if isinstance(n, If):
        test, then, other = _expr(n.test, names), _body(n.then, names), _body(n.other, names)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(n, Generation):
        inner = _body(n.body, names)

        def mark(env: dict, out: _Out) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return mark
    over, body, single = _expr(n.over, names), _body(n.body, names | {*n.names, "loop"}), len(n.names) == 1

    def loop(env: dict, out: _Out) -> None:
        items = over(env)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("for needs a list")
        last = len(items) - 1
        for i, item in enumerate(items):
            if not single and (not isinstance(item, (list, tuple)) or len(item) != len(n.names)):
                raise TemplateError("an item doesn't have as many parts as there are names")
            body({**env, **({n.names[0]: item} if single else dict(zip(n.names, item))), "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == last, "length": last + 1}}, out)

    return loop


@lru_cache(maxsize=64)
def compile_template(source: str, variables: tuple[str, ...] = VARIABLES, trim_blocks: bool = False) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the variables to (text, generation spans in characters). A variable that isn't given is undefined."""
    try:
        run = _body(fold(parse(source, trim_blocks)), frozenset(variables))
    except RecursionError:
        raise TemplateError("the template is nested too deeply") from None

    def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        try:
            run({v: env[v] for v in variables if v in env}, out)
        except TemplateError:
            raise
        except _FAULTS as e:
            raise TemplateError(f"{type(e).__name__}: {e}") from e
        return "".join(out.parts), out.spans

    return render


# --- tables -----------------------------------------------------------------------------------------------------------


def render(conversations: DataFrame, template: str = TEMPLATE, trim_blocks: bool = False, **variables: Any) -> DataFrame:
    """(conv_id, n_turns, rendered, generation): a row per conversation; generation: array of (start, end).

    variables: what the template is given beside messages, as add_generation_prompt, bos_token, eos_token; plain values.
    """
    names = tuple(dict.fromkeys([*VARIABLES, *variables]))
    compile_template(template, names, trim_blocks)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = compile_template(template, names, trim_blocks)
        for b in batches:
            done = [own({**variables, "messages": [{**t, "content": t["text"]} for t in turns]}) for turns in b["turns"]]
            spans = pd.Series([[{"start": s, "end": e} for s, e in x] for _, x in done], dtype=object, index=b.index)
            yield pd.DataFrame({"conv_id": b["conv_id"], "n_turns": [len(t) for t in b["turns"]], "rendered": [t for t, _ in done], "generation": spans})

    return grouped.mapInPandas(run, f"conv_id {kind}, n_turns int, rendered string, generation array<struct<start:int,end:int>>")


def report(conversations: DataFrame) -> DataFrame:
    """render() with the spans as text, start-end;start-end."""
    spans = F.array_join(F.transform("generation", lambda g: F.concat_ws("-", g["start"], g["end"])), ";")
    return render(conversations).select("conv_id", "n_turns", "rendered", spans.alias("generation"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations),
l AS (SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY k) AS BIGINT) AS upto FROM t)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN (upto - 1 - length(body)) || '-' || (upto - 1) END, ';' ORDER BY k), '') AS generation
FROM l GROUP BY conv_id
"""
