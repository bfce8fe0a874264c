"""The engine: gives expressions their meaning.

Relational heads become lazy DataFrames, so a query is one plan for the
optimizer.  The control plane (variables, guards, stages, settings, named
tables) is plain Python over expressions and starts no job.  A head that nobody
knows is left as it is, its arguments evaluated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .expr import Expr, Sym, rewrite, walk
from .functions import aggregates as _aggregates  # noqa: F401  registers heads
from .functions import scalar as _scalar  # noqa: F401
from .operators import positions as _positions  # noqa: F401
from .operators import relational as _relational  # noqa: F401
from .operators.codec import Codec
from .plans import control as _control  # noqa: F401
from .sources import tables as _tables  # noqa: F401

#: A guard that does not hold yet keeps its expression under a head with this before it.
HELD = "__"


class EvaluationError(Exception):
    """An expression and why it could not be evaluated."""

    def __init__(self, expression, message: str):
        super().__init__(f"{message} in {expression!r}")
        self.expression, self.message = expression, message


def normalise(e):
    """Other names of heads become the usual ones."""
    return rewrite(e, lambda x: Expr(registry.ALIASES[x.head], x.args) if isinstance(x, Expr) and x.head in registry.ALIASES else x)


class Engine:
    """Evaluates expressions against a Spark session.

    `catalog` maps table names to DataFrames or to functions that give one.
    """

    def __init__(self, spark: SparkSession, catalog: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self.catalog = {k.lower(): v for k, v in (catalog or {}).items()}
        self.saved: dict[str, DataFrame] = {}
        self.inserted: dict[str, tuple] = {}
        self.variables: dict[str, object] = {}
        self.codec = Codec(spark)
        self.pipeline: list[Callable] = []
        self.overhead: dict[str, int] | None = None

    @staticmethod
    def over_parquet(spark: SparkSession, folder: str) -> "Engine":
        """An engine whose catalog is the folder's <name>.parquet files, opened when they are named."""
        engine = Engine(spark)
        engine.folder = folder
        return engine

    folder: str | None = None

    # -- tables ------------------------------------------------------------------

    def named(self, name: str) -> DataFrame:
        """A table of this name: saved, of the catalog, or of the folder."""
        key = name.lower()
        if key in self.saved:
            return self.saved[key]
        if key in self.catalog:
            found = self.catalog[key]
            return found() if callable(found) else found
        if self.folder is not None:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise EvaluationError(Sym(name), "there is no table of that name")

    def frame(self, e) -> DataFrame:
        """The DataFrame of a relational argument."""
        if isinstance(e, DataFrame):
            return e
        if isinstance(e, Sym):
            return self.named(e.name)
        out = self._evaluate(normalise(e))
        if not isinstance(out, DataFrame):
            raise EvaluationError(e, "a table is wanted")
        return out

    # -- evaluation ----------------------------------------------------------------

    def evaluate(self, e):
        """A DataFrame, an atom, or what is left of the expression."""
        e = normalise(e)
        for step in self.pipeline:
            e = normalise(step(e))
        out = self._evaluate(e)
        if self.overhead is not None and isinstance(out, DataFrame):
            for path, size in _control.input_bytes(out).items():
                self.overhead[path] = self.overhead.get(path, 0) + size
        return out

    def safe_evaluate(self, e):
        """Like evaluate(), but a failure becomes ErrorWhenEvaluatingExpression(expression, message)."""
        if isinstance(e, Expr) and e.head == "ErrorWhenEvaluatingExpression":
            return e
        try:
            return self.evaluate(e)
        except Exception as problem:  # noqa: BLE001  any failure is a value here
            return Expr("ErrorWhenEvaluatingExpression", (e, str(problem)))

    def _evaluate(self, e):
        if isinstance(e, Sym):
            return self.variables.get(e.name, e)
        if not isinstance(e, Expr) or e.head == "ErrorWhenEvaluatingExpression":
            return e
        if e.head in registry.control:
            return registry.control[e.head](self, e.args)
        if e.head in registry.relational:
            return registry.relational[e.head](self, e.args)
        args = tuple(self._evaluate(a) for a in e.args)
        span = e.head == "Plus" and len(args) == 1 and isinstance(args[0], Expr) and args[0].head == "List" and args[0].args
        if e.head in ATOMS and all(not isinstance(a, (Expr, Sym, DataFrame)) for a in (args[0].args if span else args)):
            return ATOMS[e.head](*args)
        return Expr(e.head, args)


def _plus(*xs):
    """The sum; of one span, the sum of its elements."""
    if len(xs) == 1 and isinstance(xs[0], Expr) and xs[0].head == "List":
        xs = xs[0].args
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total


def _times(*xs):
    total = xs[0]
    for x in xs[1:]:
        total = total * x
    return total


#: Heads that plain values can be put through without a table.
ATOMS: dict[str, Callable] = {
    "Plus": _plus,
    "Times": _times,
    "Minus": lambda a, b: a - b,
    "Divide": lambda a, b: a / b,
    "Greater": lambda a, b: a > b,
    "Less": lambda a, b: a < b,
    "Equal": lambda a, b: a == b,
    "And": lambda *xs: all(xs),
    "Or": lambda *xs: any(xs),
    "Not": lambda a: not a,
    "StringJoin": lambda *xs: "".join(map(str, xs)),
    "StringContainsQ": lambda a, b: b in a,
    "Symbol": lambda a: Sym(a),
}


def names_in(e) -> set[str]:
    """Symbols that an expression names."""
    return {x.name for x in walk(e) if isinstance(x, Sym)}
