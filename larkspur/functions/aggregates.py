"""Aggregate heads and how a Group names what they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr import Expr, Sym
from ..registry import UnknownHead, aggregates
from .scalar import compile_scalar

aggregates.update({"Sum": F.sum, "Count": F.count, "Avg": F.avg, "Min": F.min, "Max": F.max})


def compile_aggregate(e, context=None) -> Column:
    """Sum(x), Count("*"), the bare symbol Count ..."""
    if e == Sym("Count"):
        return F.count(F.lit(1))
    if not isinstance(e, Expr) or e.head not in aggregates:
        raise UnknownHead(f"not an aggregate: {e!r}")
    (x,) = e.args
    if e.head == "Count" and x in ("*", Sym("*")):
        return F.count(F.lit(1))
    return aggregates[e.head](compile_scalar(x, context))


def default_name(e) -> str:
    """An aggregate without a name is called like its argument, where that is a column."""
    if isinstance(e, Expr) and e.args and isinstance(e.args[0], Sym) and e.args[0].name != "*":
        return e.args[0].name.lower()
    return (e.name if isinstance(e, Sym) else e.head).lower()


def is_aggregate(e) -> bool:
    return e == Sym("Count") or isinstance(e, Expr) and e.head in aggregates
