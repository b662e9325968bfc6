"""A sandboxed template language: syntax tree, constant folding, and closures that render conversations.

    {{ expression }}                         the value as text
    {% for m in messages %} ... {% endfor %} with loop.index, loop.index0, loop.first, loop.last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %} marks what a model is to learn
    {# comment #}; a "-" inside a bracket trims the blanks beyond it

Expressions: strings, whole numbers, true, false, none, names, fields (``m.role`` or ``m["role"]``), ``+ - * // %``, ``~``
(joins texts), comparisons, ``in``, ``and or not``, ``a if c else b``, and filters of a fixed list (``x | trim``). There are no
calls, no attributes of Python objects, no reads or writes outside the variables, and no loop but over a list, so that
every template ends and touches nothing but its messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
import operator
import re
from typing import Any

MAX_SOURCE = 65_536
MAX_DEPTH = 40
MAX_NUMBER = 1 << 63
MAX_TEXT = 1 << 28      # of a text that an expression joins; messages themselves have no bound

# --- syntax tree


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
class Unary:
    sign: str
    of: Any


@dataclass(frozen=True)
class Binary:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    arguments: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple          # (test, body) pairs
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template is not in the language, or a value does not fit."""


# --- lexer and parser

_PART = re.compile(r"\{\{-?|\{%-?|\{#")
_ENDS = {"{{": re.compile(r"-?\}\}"), "{%": re.compile(r"-?%\}"), "{#": re.compile(r"-?#\}")}
_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=]))""",
    re.S,
)
_SPACES = " \t\r\n"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}


def _tokens(code: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while code[at:].strip():
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at:].strip()[:20]!r}")
        kind, text, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "string":
            text = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)
        elif kind == "number":
            text = int(text)
        elif kind == "name" and text in _KEYWORDS:
            kind = "sign"
        out.append((kind, text))
    return out


def _parts(source: str) -> Iterator[tuple[str, str]]:
    """("text", text), ("{{", code) and ("{%", code) in order; strings may hold closing brackets."""
    at, trim = 0, False
    while True:
        m = _PART.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip(_SPACES)
        if m and m[0].endswith("-"):
            text = text.rstrip(_SPACES)
        if text:
            yield "text", text
        if not m:
            return
        kind, at = m[0][:2], m.end()
        begin = at
        while True:
            end = _ENDS[kind].match(source, at)
            if end or at >= len(source):
                break
            quoted = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", re.S).match(source, at) if kind != "{#" else None
            at = quoted.end() if quoted else at + 1
        if not end:
            raise TemplateError(f"{kind} without its end")
        trim, at = end[0].startswith("-"), end.end()
        if kind != "{#":
            yield kind, source[begin : end.start()]


class _Expression:
    """Recursive descent over one bracket's tokens; weaker signs first."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def sign(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, what: str) -> Any:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")
        if what == kind == "name" or value == what and kind == "sign":
            self.at += 1
            return value
        raise TemplateError(f"expected {what}, found {value!r}")

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        value = self.level(0)
        if self.sign("if"):
            test = self.level(0)
            value = Choice(test, value, self.choice() if self.sign("else") else Const(""))
        self.depth -= 1
        return value

    def level(self, k: int) -> Any:
        if k == len(self.LEVELS):
            return self.filters()
        if self.LEVELS[k] == ("not",):
            turns = 0
            while self.sign("not"):
                turns += 1
            value = self.level(k + 1)
            for _ in range(min(turns, 2 - turns % 2)):
                value = Unary("not", value)
            return value
        left = self.level(k + 1)
        while True:
            sign = self.sign(*self.LEVELS[k])
            if not sign and "not in" in self.LEVELS[k] and self.tokens[self.at : self.at + 2] == [("sign", "not"), ("sign", "in")]:
                self.at += 2
                sign = "not in"
            if not sign:
                return left
            left = Binary(sign, left, self.level(k + 1))

    def filters(self) -> Any:
        value = Unary("-", self.fields()) if self.sign("-") else self.fields()
        while self.sign("|"):
            name, arguments = self.need("name"), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.sign("("):
                while not self.sign(")"):
                    arguments.append(self.choice())
                    if not self.sign(","):
                        self.need(")")
                        break
            value = Filter(name, value, tuple(arguments))
        return value

    def fields(self) -> Any:
        value = self.atom()
        while sign := self.sign(".", "["):
            if sign == ".":
                value = Field(value, Const(self.need("name")))
            else:
                value = Field(value, self.choice())
                self.need("]")
        return value

    def atom(self) -> Any:
        if self.sign("("):
            value = self.choice()
            self.need(")")
            return value
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")
        if kind not in ("number", "string", "name"):
            raise TemplateError(f"expected a value, found {value!r}")
        self.at += 1
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if kind == "number" and value >= MAX_NUMBER:
            raise TemplateError("number too large")
        return Const(value)


def _expression(code: str) -> Any:
    parser = _Expression(_tokens(code))
    value = parser.choice()
    parser.done()
    return value


def parse(source: str) -> tuple:
    """The template's statements."""
    if len(source) > MAX_SOURCE:
        raise TemplateError(f"a template has at most {MAX_SOURCE} characters")
    parts = list(_parts(source))
    body, at, end = _block(parts, 0, (), 0)
    if end is not None:
        raise TemplateError(f"unexpected {end[0]!r}")
    return body


def _block(parts: list, at: int, ends: tuple[str, ...], depth: int) -> tuple[tuple, int, tuple | None]:
    if depth > MAX_DEPTH:
        raise TemplateError("nested too deeply")
    out = []
    while at < len(parts):
        kind, code = parts[at]
        at += 1
        if kind == "text":
            out.append(Output(Const(code)))
            continue
        if kind == "{{":
            out.append(Output(_expression(code)))
            continue
        word, _, rest = code.strip().partition(" ")
        if word in ends:
            return tuple(out), at, (word, rest)
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in _WORDS or name.strip() in _KEYWORDS:
                raise TemplateError(f"cannot set {name.strip()!r}")
            out.append(Assign(name.strip(), _expression(value)))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError("for needs a name, in, and a list")
            body, at, end = _block(parts, at, ("endfor",), depth + 1)
            _closed("for", end)
            out.append(For(m[1], _expression(m[2]), body))
        elif word == "if":
            branches, otherwise, test = [], (), rest
            while True:
                body, at, end = _block(parts, at, ("elif", "else", "endif") if test is not None else ("endif",), depth + 1)
                _closed("if", end)
                if test is None:
                    otherwise = body
                else:
                    branches.append((_expression(test), body))
                if end[0] == "endif":
                    break
                test = end[1] if end[0] == "elif" else None
            out.append(If(tuple(branches), otherwise))
        elif word == "generation":
            body, at, end = _block(parts, at, ("endgeneration",), depth + 1)
            _closed("generation", end)
            out.append(Generation(body))
        else:
            raise TemplateError(f"unknown or misplaced {word!r}")
    return tuple(out), at, None


def _closed(what: str, end: tuple | None) -> None:
    if end is None:
        raise TemplateError(f"{what} without its end")


# --- values


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written")


def _number(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or abs(value) >= MAX_NUMBER:
        raise TemplateError("not a whole number")
    return value


def _joined(a: Any, b: Any) -> str:
    a, b = as_text(a), as_text(b)
    if a and b and len(a) + len(b) > MAX_TEXT:
        raise TemplateError("joined text too long")
    return a + b


def _add(a: Any, b: Any) -> Any:
    return _joined(a, b) if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return as_text(a) in b
    if isinstance(b, (list, tuple, dict)):
        return a in b
    raise TemplateError("in needs a text or a list")


def _ordered(compare: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        if not (isinstance(a, str) and isinstance(b, str)):
            a, b = _number(a), _number(b)
        return compare(a, b)

    return run


def _divided(divide: Callable) -> Callable:
    def run(a: Any, b: Any) -> int:
        if not _number(b):
            raise TemplateError("division by zero")
        return divide(_number(a), b)

    return run


SIGNS: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt),
    ">=": _ordered(operator.ge), "in": _within, "not in": lambda a, b: not _within(a, b), "~": _joined,
    "+": _add, "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b),
    "//": _divided(operator.floordiv), "%": _divided(operator.mod),
}


def _length(value: Any) -> int:
    if not isinstance(value, (str, list, tuple, dict)):
        raise TemplateError("this has no length")
    return len(value)


def _one_of(value: Any, last: bool) -> Any:
    if not isinstance(value, (str, list, tuple)):
        raise TemplateError("not a list")
    return value[-1 if last else 0] if value else None


# Strings with a meaning in the formatted text; inside messages a backslash stands before each, and before a backslash.
TURN, TURN_END = "###", "</turn>"
_CONTROL = re.compile(r"\\|%s|%s" % (re.escape(TURN), re.escape(TURN_END)))


def escaped(value: Any) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], as_text(value))


def escaped_line(value: Any) -> str:
    """For a text that must stay on one line: line feeds become a backslash and an n."""
    return escaped(value).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescaped_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


#: Every filter; none makes a text many times as long as what it gets.
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: as_text(x).strip(), "upper": lambda x: as_text(x).upper(), "lower": lambda x: as_text(x).lower(),
    "length": _length, "first": lambda x: _one_of(x, False), "last": lambda x: _one_of(x, True), "string": as_text,
    "default": lambda x, other="": other if x is None else x,
    "title": lambda x: as_text(x)[:1].upper() + as_text(x)[1:], "escape": escaped, "line": escaped_line,
}


def _field(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError("only messages have fields")


# --- constant folding


def folded(node: Any) -> Any:
    """The same tree with every part that hangs on constants alone worked out; untaken branches and empty texts go."""
    if isinstance(node, tuple):
        return _folded_body(node)
    if isinstance(node, Field):
        of, key = folded(node.of), folded(node.key)
        return Const(_field(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Field(of, key)
    if isinstance(node, Unary):
        of = folded(node.of)
        return Const(_unary(node.sign)(of.value)) if isinstance(of, Const) else Unary(node.sign, of)
    if isinstance(node, Binary):
        left, right = folded(node.left), folded(node.right)
        if node.sign in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.sign == "and") else left
            return Binary(node.sign, left, right)
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(SIGNS[node.sign](left.value, right.value))
        if node.sign == "~" and isinstance(right, Const) and isinstance(left, Binary) and left.sign == "~" and isinstance(left.right, Const):
            return Binary("~", left.left, Const(as_text(left.right.value) + as_text(right.value)))
        return Binary(node.sign, left, right)
    if isinstance(node, Choice):
        test = folded(node.test)
        if isinstance(test, Const):
            return folded(node.yes if test.value else node.no)
        return Choice(test, folded(node.yes), folded(node.no))
    if isinstance(node, Filter):
        of, arguments = folded(node.of), tuple(folded(a) for a in node.arguments)
        if isinstance(of, Const) and all(isinstance(a, Const) for a in arguments):
            return Const(FILTERS[node.name](of.value, *(a.value for a in arguments)))
        return Filter(node.name, of, arguments)
    return node


def _folded_body(body: tuple) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, If):
            branches, otherwise = [], folded(node.otherwise)
            for test, inner in node.branches:
                test = folded(test)
                if isinstance(test, Const) and not test.value:
                    continue
                if isinstance(test, Const):
                    otherwise = folded(inner)
                    break
                branches.append((test, folded(inner)))
            parts = (If(tuple(branches), otherwise),) if branches else otherwise
        elif isinstance(node, For):
            parts = (For(node.name, folded(node.over), folded(node.body)),)
        elif isinstance(node, Generation):
            parts = (Generation(folded(node.body)),)
        elif isinstance(node, Assign):
            parts = (Assign(node.name, folded(node.value)),)
        else:
            parts = (Output(folded(node.value)),)
        for part in parts:
            if isinstance(part, Output) and isinstance(part.value, Const):
                text = as_text(part.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(out[-1].value.value + text))
                elif text:
                    out.append(Output(Const(text)))
            else:
                out.append(part)
    return tuple(out)


# --- closures


@dataclass
class Page:
    """What is rendered: pieces of text, their length, and the marked spans. ``values`` are the variables."""

    values: dict[str, Any]
    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    marked: int | None = None

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _unary(sign: str) -> Callable[[Any], Any]:
    return operator.not_ if sign == "not" else lambda x: -_number(x)


def _value(node: Any) -> Callable[[dict[str, Any]], Any]:
    """A closure that gives an expression's value from the variables."""
    if isinstance(node, Const):
        return lambda v, value=node.value: value
    if isinstance(node, Name):
        return lambda v, name=node.name: v.get(name)
    if isinstance(node, Field):
        of, key = _value(node.of), _value(node.key)
        return lambda v: _field(of(v), key(v))
    if isinstance(node, Unary):
        of, run = _value(node.of), _unary(node.sign)
        return lambda v: run(of(v))
    if isinstance(node, Choice):
        test, yes, no = _value(node.test), _value(node.yes), _value(node.no)
        return lambda v: yes(v) if test(v) else no(v)
    if isinstance(node, Filter):
        of, arguments, run = _value(node.of), [_value(a) for a in node.arguments], FILTERS[node.name]
        return lambda v: run(of(v), *(a(v) for a in arguments))
    left, right = _value(node.left), _value(node.right)
    if node.sign == "and":
        return lambda v: left(v) and right(v)
    if node.sign == "or":
        return lambda v: left(v) or right(v)
    run = SIGNS[node.sign]
    return lambda v: run(left(v), right(v))


Step = Callable[[Page], Iterator[None] | None]


def _looped(items: Iterable) -> Iterator[tuple[dict[str, Any], Any]]:
    """Each item with its loop variables; one item is read ahead, to know the last."""
    items, k = iter(items), 0
    item = next(items, items)
    while item is not items:
        following = next(items, items)
        yield {"index": k + 1, "index0": k, "first": k == 0, "last": following is items}, item
        item, k = following, k + 1


def _statement(node: Any) -> Step:
    if isinstance(node, Output) and isinstance(node.value, Const):
        return lambda page, text=as_text(node.value.value): page.write(text)
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda page: page.write(as_text(value(page.values)))
    if isinstance(node, Assign):
        value, name = _value(node.value), node.name

        def assign(page: Page) -> None:
            page.values[name] = value(page.values)

        return assign
    if isinstance(node, If):
        branches, otherwise = [(_value(t), _body(b)) for t, b in node.branches], _body(node.otherwise)

        def decide(page: Page) -> None:
            for test, body in branches:
                if test(page.values):
                    return body(page)
            return otherwise(page)

        return decide
    if isinstance(node, Generation):
        body = _body(node.body)

        def mark(page: Page) -> None:
            if page.marked is not None:
                raise TemplateError("generation inside generation")
            page.marked = page.size
            body(page)
            if page.size > page.marked:
                page.spans.append((page.marked, page.size))
            page.marked = None

        return mark
    over, body, name = _value(node.over), _body(node.body), node.name

    def repeat(page: Page) -> None:
        items = over(page.values)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("for needs a list")
        for _ in _turns(page, name, items, body):
            pass

    return repeat


def _turns(page: Page, name: str, items: Iterable, body: Callable[[Page], None]) -> Iterator[None]:
    outer = {k: page.values[k] for k in (name, "loop") if k in page.values}
    for loop, item in _looped(items):
        page.values["loop"], page.values[name] = loop, item
        body(page)
        yield
    for k in (name, "loop"):
        page.values.pop(k, None)
    page.values |= outer


def _body(nodes: tuple) -> Callable[[Page], None]:
    steps = [_statement(n) for n in nodes]

    def run(page: Page) -> None:
        for step in steps:
            step(page)

    return run


def _names(node: Any) -> Iterator[str]:
    if isinstance(node, Name):
        yield node.name
    elif isinstance(node, tuple):
        for x in node:
            yield from _names(x)
    elif hasattr(node, "__dataclass_fields__"):
        if isinstance(node, (For, Assign)):
            yield node.name
        for f in node.__dataclass_fields__:
            yield from _names(getattr(node, f))


class Template:
    """A compiled template: ``render`` a list of messages, or ``stream`` them."""

    def __init__(self, source: str):
        self.source = source
        self.tree = folded(parse(source))
        loops = [n for n in self.tree if isinstance(n, For) and n.over == Name("messages")]
        others = [n for n in self.tree if n not in loops] + [n.body for n in loops]
        #: True if messages are read by one outer loop alone, so that a conversation need not be held as a whole.
        self.streams = len(loops) == 1 and "messages" not in set(_names(tuple(others)))
        self.steps = [(n.name, _body(n.body)) if self.streams and n in loops else _statement(n) for n in self.tree]

    def stream(self, messages: Iterable[dict[str, str]], limit: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Pieces of the rendered text of about ``limit`` characters or more, with the marked spans inside each.

        A template that does not stream gets a list and gives one piece.
        """
        page = Page({} if self.streams else {"messages": list(messages)})
        for step in self.steps:
            if not isinstance(step, tuple):
                step(page)
                continue
            for _ in _turns(page, step[0], messages, step[1]):
                if page.size >= limit:
                    yield "".join(page.pieces), page.spans
                    page.pieces, page.spans, page.size = [], [], 0
        if page.pieces:
            yield "".join(page.pieces), page.spans

    def render(self, messages: Iterable[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its marked spans, in code points."""
        texts, spans, size = [], [], 0
        for text, inside in self.stream(messages, 1 << 62):
            texts.append(text)
            spans += [(a + size, b + size) for a, b in inside]
            size += len(text)
        return "".join(texts), spans
