"""Which heads there are.  New operators register here; nothing else needs to change."""

from __future__ import annotations


class UnknownHead(ValueError):
    """No operator of that name."""


#: head -> function(engine, args) -> Column
scalar: dict = {}
#: head -> function(Column) -> Column, an aggregate
aggregates: dict = {}
#: head -> function(engine, args) -> DataFrame
relational: dict = {}
#: head -> function(engine, args) -> anything, for the control plane; arguments come unevaluated
control: dict = {}

#: Other names of heads.
ALIASES = {
    "OrderBy": "Order", "Sort": "Order", "SortBy": "Order", "TopN": "Top", "Multiply": "Times", "Subtract": "Minus",
    "StringContains": "StringContainsQ", "Date": "DateObject",
}


def relation(*names: str):
    """Registers an operator that gives a DataFrame."""

    def put(f):
        for n in names:
            relational[n] = f
        return f

    return put


def controlling(*names: str):
    """Registers an operator of the control plane."""

    def put(f):
        for n in names:
            control[n] = f
        return f

    return put


def heads() -> list[str]:
    """All heads that evaluation knows."""
    return sorted({*scalar, *aggregates, *relational, *control, *ALIASES})
