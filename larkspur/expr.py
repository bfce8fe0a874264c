"""Symbolic expressions: a head and arguments.

Arguments are atoms (bool, int, float, str, None, date), symbols or expressions.
An expression is syntax only; `larkspur.session.Engine` gives it meaning.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Sym:
    """A name: a column, an operator or a variable, depending on where it stands."""

    name: str

    def __repr__(self) -> str:
        return self.name

    def __call__(self, *args) -> "Expr":
        return Expr(self.name, args)

    # Symbols and expressions build larger ones by operators.
    def __add__(self, other):
        return Expr("Plus", (self, other))

    def __radd__(self, other):
        return Expr("Plus", (other, self))

    def __sub__(self, other):
        return Expr("Minus", (self, other))

    def __rsub__(self, other):
        return Expr("Minus", (other, self))

    def __mul__(self, other):
        return Expr("Times", (self, other))

    def __rmul__(self, other):
        return Expr("Times", (other, self))

    def __truediv__(self, other):
        return Expr("Divide", (self, other))

    def __gt__(self, other):
        return Expr("Greater", (self, other))

    def __lt__(self, other):
        return Expr("Greater", (other, self))

    def __and__(self, other):
        return Expr("And", (self, other))


@dataclass(frozen=True)
class Expr:
    head: str
    args: tuple

    def __repr__(self) -> str:
        return f"{self.head}({', '.join(map(repr, self.args))})"

    __add__, __radd__, __sub__, __rsub__ = Sym.__add__, Sym.__radd__, Sym.__sub__, Sym.__rsub__
    __mul__, __rmul__, __truediv__ = Sym.__mul__, Sym.__rmul__, Sym.__truediv__
    __gt__, __lt__, __and__ = Sym.__gt__, Sym.__lt__, Sym.__and__

    def with_args(self, args) -> "Expr":
        return Expr(self.head, tuple(args))


class _Builder:
    """q.Head(args...) builds expressions, s.name builds symbols."""

    def __init__(self, make):
        self._make = make

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self._make(name)

    __getitem__ = __getattr__


q = _Builder(lambda name: lambda *args: Expr(name, args))
s = _Builder(Sym)


def walk(e) -> Iterator:
    """The expression and all below it, parents first."""
    yield e
    if isinstance(e, Expr):
        for a in e.args:
            yield from walk(a)


def rewrite(e, change):
    """`change` applied from the leaves up."""
    if isinstance(e, Expr):
        e = e.with_args(rewrite(a, change) for a in e.args)
    return change(e)


# -- s-expressions -------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(;[^\n]*)|([()])|("(?:[^"\\]|\\.)*")|([^\s()";]+))""")
_INT, _FLOAT = re.compile(r"[+-]?\d+\Z"), re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?\Z")


def read_sexpr(text: str):
    """One expression from text such as `(Select t (Where (Greater x 3)))`."""
    out = read_all(text)
    if len(out) != 1:
        raise ValueError(f"one expression is wanted, there are {len(out)}")
    return out[0]


def read_all(text: str) -> list:
    stack: list[list] = [[]]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"cannot read {text[at:at + 20]!r}")
            break
        at = m.end()
        _, paren, string, word = m.groups()
        if paren == "(":
            stack.append([])
        elif paren == ")":
            if len(stack) < 2:
                raise ValueError("a closing parenthesis too many")
            stack.append([*stack.pop(-2), _closed(stack.pop())])
        elif string:
            stack[-1].append(json.loads(string))
        elif word:
            stack[-1].append(_atom(word))
    if len(stack) != 1:
        raise ValueError("a closing parenthesis is missing")
    return stack[0]


def _closed(items: list):
    if not items:
        return Expr("List", ())
    head, *args = items
    if not isinstance(head, Sym):
        raise ValueError(f"a head must be a symbol, not {head!r}")
    return Expr(head.name, tuple(args))


def _atom(word: str):
    if _INT.match(word):
        return int(word)
    if _FLOAT.match(word):
        return float(word)
    return {"true": True, "false": False, "#t": True, "#f": False}.get(word, Sym(word.removeprefix("'")))


def write_sexpr(e) -> str:
    if isinstance(e, Expr):
        return "(" + " ".join([e.head, *map(write_sexpr, e.args)]) + ")"
    if isinstance(e, bool):
        return "true" if e else "false"
    if isinstance(e, dt.date):
        return f'(DateObject "{e.isoformat()}")'
    return e.name if isinstance(e, Sym) else json.dumps(e, ensure_ascii=False)


# -- JSON ----------------------------------------------------------------------


def to_json(e) -> str:
    return json.dumps(_plain(e), ensure_ascii=False)


def _plain(e):
    if isinstance(e, Expr):
        return {"head": e.head, "args": [_plain(a) for a in e.args]}
    if isinstance(e, Sym):
        return {"symbol": e.name}
    return {"date": e.isoformat()} if isinstance(e, dt.date) else e


def from_json(text: str):
    def build(x):
        if not isinstance(x, dict):
            return x
        if "symbol" in x:
            return Sym(x["symbol"])
        return dt.date.fromisoformat(x["date"]) if "date" in x else Expr(x["head"], tuple(map(build, x["args"])))

    return build(json.loads(text))


# -- URL paths -----------------------------------------------------------------


def read_path(path: str):
    """An expression threaded through the parts of a URL path.

    Parts are separated by "/".  A part that begins with ":" opens an expression
    of that head whose first argument is what was read so far at this level (if
    anything); "::" closes one level, ":::" closes all.  Other parts are atoms.
    """
    stack: list[list] = [[]]

    def close():
        done = _closed(stack.pop())
        stack[-1].append(done)

    for part in filter(None, path.split("/")):
        if part == ":::":
            while len(stack) > 1:
                close()
        elif part == "::":
            if len(stack) < 2:
                raise ValueError("nothing to close")
            close()
        elif part.startswith(":"):
            before, stack[-1] = (stack[-1], []) if len(stack) == 1 else ([], stack[-1])
            stack.append([Sym(part[1:]), *before])
        else:
            stack[-1].append(_atom(part))
    while len(stack) > 1:
        close()
    if len(stack[0]) != 1:
        raise ValueError(f"one expression is wanted, there are {len(stack[0])}")
    return stack[0][0]
