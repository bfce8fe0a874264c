"""Scalar heads: expressions over columns, compiled to pyspark columns."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr import Expr, Sym
from ..registry import UnknownHead, scalar


def column(name: str) -> Column:
    """A column by its whole name, dots included; names are lower case."""
    return F.col("`" + name.lower().replace("`", "``") + "`")


def literal_date(text: str) -> dt.date:
    """An ISO date; what stands behind its ten characters is ignored."""
    return dt.date.fromisoformat(str(text)[:10])


def compile_scalar(e, context=None) -> Column:
    """The column of a scalar expression; `context` is the engine, for heads that need it."""
    if isinstance(e, Sym):
        return column(e.name)
    if not isinstance(e, Expr):
        return F.lit(e)
    found = scalar.get(e.head)
    if found is None:
        raise UnknownHead(f"unknown operator {e.head}")
    return found(context, e.args)


def _all(context, args) -> list[Column]:
    return [compile_scalar(a, context) for a in args]


def _fold(step):
    return lambda context, args: reduce(step, _all(context, args))


def _binary(step):
    def run(context, args):
        if len(args) != 2:
            raise ValueError(f"two arguments are wanted, not {len(args)}")
        return step(*_all(context, args))

    return run


def _int_divide(a: Column, b: Column) -> Column:
    """Whole-number quotient, towards zero."""
    return F.call_function("div", a, b)


def _sum(context, args) -> Column:
    """The sum of the arguments; of List(...) alone, the sum of its elements, of Span(column) the sum of an array's."""
    if len(args) == 1 and isinstance(args[0], Expr) and args[0].head == "List":
        args = args[0].args
    elif len(args) == 1 and isinstance(args[0], Expr) and args[0].head == "Span":
        array = compile_scalar(args[0].args[0], context)
        return F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.get(array, F.lit(0)), lambda a, x: a + x)
    return reduce(lambda a, b: a + b, _all(context, args))


scalar.update({
    "Plus": lambda context, args: _sum(context, args),
    "Times": _fold(lambda a, b: a * b),
    "Minus": _binary(lambda a, b: a - b),
    # Division gives a double; whole-number division has a head of its own.
    "Divide": _binary(lambda a, b: a / b),
    "IntDivide": _binary(_int_divide),
    "Equal": _binary(lambda a, b: a == b),
    "Greater": _binary(lambda a, b: a > b),
    "Less": _binary(lambda a, b: a < b),
    "And": _fold(lambda a, b: a & b),
    "Or": _fold(lambda a, b: a | b),
    "StringJoin": lambda context, args: F.concat(*_all(context, args)),
    "StringContainsQ": _binary(lambda a, b: F.contains(a, b)),
})


def _one(name: str):
    """Registers a function of one argument list."""
    return lambda f: scalar.setdefault(name, f)


@_one("Where")
def _where(context, args):
    (predicate,) = args
    return compile_scalar(predicate, context)


@_one("Function")
def _constant(context, args):
    """A function of a row that ignores the row: its body."""
    return compile_scalar(args[-1], context)


@_one("Not")
def _not(context, args):
    return ~compile_scalar(args[0], context)


@_one("Between")
def _between(context, args):
    x, low, high = _all(context, args)
    return x.between(low, high)


@_one("If")
def _if(context, args):
    test, yes, no = _all(context, args)
    return F.when(test, yes).otherwise(no)


@_one("DateObject")
def _date(context, args):
    (x,) = args
    return F.lit(literal_date(x)) if isinstance(x, str) else F.to_date(compile_scalar(x, context))


@_one("Year")
def _year(context, args):
    return F.year(compile_scalar(args[0], context))


@_one("UnixTime")
def _unix_time(context, args):
    """UnixTime(text [, Rule(TimeZone, zone)]): seconds since the epoch of a local time in the zone, UTC by default."""
    zone = "UTC"
    for a in args[1:]:
        if isinstance(a, Expr) and a.head == "Rule" and a.args[0] in (Sym("TimeZone"), "TimeZone"):
            zone = a.args[1] if isinstance(a.args[1], str) else a.args[1].name
    # A local time of the zone as a local time of UTC, then its seconds: the session's own zone plays no part.
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.to_timestamp_ntz(compile_scalar(args[0], context)))
    days = F.datediff(utc.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("long")
    return days * 86400 + F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)


@_one("GetEncodingFor")
def _encoding(context, args):
    """GetEncodingFor(text, column): the code of a text in the column's dictionary, -1 if it has none."""
    text, name = args
    return F.lit(context.codec.code_of(text, name.name if isinstance(name, Sym) else name))
