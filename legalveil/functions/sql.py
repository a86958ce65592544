"""Expressions as SQL text, in the manner of pyspark.sql.functions.

The plan of the engine has some ten thousand expressions. Built as Columns each costs several calls
to the JVM; as text they cost one parse for each step of the plan. A string stands for a column
where it is a function's first argument, as it does there.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as _functions

_number = itertools.count()


def text_of(value) -> str:
    """SQL of a literal or an expression."""
    if isinstance(value, Expr):
        return value.sql
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"{value}D" if isinstance(value, float) else str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


class Expr:
    """A piece of SQL with the operators of a Column."""

    __slots__ = ("name", "sql")

    def __init__(self, sql: str, name: str | None = None) -> None:
        self.sql, self.name = sql, name

    def alias(self, name: str) -> Expr:
        return Expr(self.sql, name)

    def column(self) -> Column:
        return _functions.expr(self.sql)

    def __getitem__(self, field: str) -> Expr:
        return Expr(f"{self.sql}.`{field}`")

    def _with(self, op: str, other) -> Expr:
        return Expr(f"({self.sql} {op} {text_of(other)})")

    def __add__(self, other) -> Expr:
        return self._with("+", other)

    def __sub__(self, other) -> Expr:
        return self._with("-", other)

    def __mul__(self, other) -> Expr:
        return self._with("*", other)

    def __mod__(self, other) -> Expr:
        return self._with("%", other)

    def __eq__(self, other) -> Expr:  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other) -> Expr:  # type: ignore[override]
        return self._with("!=", other)

    def __lt__(self, other) -> Expr:
        return self._with("<", other)

    def __le__(self, other) -> Expr:
        return self._with("<=", other)

    def __gt__(self, other) -> Expr:
        return self._with(">", other)

    def __ge__(self, other) -> Expr:
        return self._with(">=", other)

    def __and__(self, other) -> Expr:
        return self._with("AND", other)

    def __or__(self, other) -> Expr:
        return self._with("OR", other)

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self.sql})")

    def __neg__(self) -> Expr:
        return Expr(f"(- {self.sql})")

    __hash__ = None  # type: ignore[assignment]

    def isNull(self) -> Expr:
        return Expr(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Expr:
        return Expr(f"({self.sql} IS NOT NULL)")

    def isin(self, *values) -> Expr:
        return Expr(f"({self.sql} IN ({', '.join(map(text_of, values))}))") if values else lit(False)

    def between(self, low, high) -> Expr:
        return (self >= low) & (self <= high)

    def contains(self, other) -> Expr:
        return call("contains", self, other)

    def rlike(self, pattern) -> Expr:
        return call("rlike", self, pattern)

    def cast(self, kind: str) -> Expr:
        return Expr(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Expr:
        return Expr(f"TRY_CAST({self.sql} AS {kind})")


class When(Expr):
    """CASE WHEN; NULL where nothing holds and no ``otherwise`` follows."""

    __slots__ = ("_cases",)

    def __init__(self, cases: list[tuple]) -> None:
        self._cases = cases
        super().__init__(self._text() + " END")

    def _text(self) -> str:
        return "CASE " + " ".join(f"WHEN {text_of(c)} THEN {text_of(v)}" for c, v in self._cases)

    def when(self, condition, value) -> When:
        return When([*self._cases, (condition, value)])

    def otherwise(self, value) -> Expr:
        return Expr(f"{self._text()} ELSE {text_of(value)} END")


def when(condition, value) -> When:
    return When([(condition, value)])


def lit(value) -> Expr:
    return value if isinstance(value, Expr) else Expr(text_of(value))


def col(name: str) -> Expr:
    return Expr(".".join(f"`{p}`" for p in name.split(".")))


def call(function: str, *args) -> Expr:
    """function(args): plain values are literals."""
    return Expr(f"{function}({', '.join(map(text_of, args))})")


def struct(*fields: Expr) -> Expr:
    """Fields by their alias, or that of the column they name."""
    named = ((f.name or f.sql.rpartition(".")[2].strip("`"), f.sql) for f in (col(f) if isinstance(f, str) else f for f in fields))
    return Expr("named_struct(" + ", ".join(f"'{n}', {s}" for n, s in named) + ")")


def replaced(x: Expr, fields: list[str], **new) -> Expr:
    """A struct of these fields of x, with some of them, or further ones, given anew."""
    return struct(*(lit(new.pop(f)).alias(f) if f in new else x[f].alias(f) for f in fields), *(lit(v).alias(f) for f, v in new.items()))


def _lambda(f: Callable) -> str:
    names = [f"x{next(_number)}" for p in inspect.signature(f).parameters.values() if p.default is p.empty]
    body = f(*(Expr(n) for n in names))
    return f"({', '.join(names)}) -> {text_of(body)}" if len(names) > 1 else f"{names[0]} -> {text_of(body)}"


def _higher(name: str) -> Callable[..., Expr]:
    def run(array, *args) -> Expr:
        first = col(array) if isinstance(array, str) else array
        return Expr(f"{name}({first.sql}, {', '.join(_lambda(a) if callable(a) else text_of(a) for a in args)})")

    return run


transform, filter, exists, aggregate = map(_higher, ("transform", "filter", "exists", "aggregate"))  # noqa: A001


def bound(value, kind: str, f: Callable[[Expr], Expr]) -> Expr:
    """f(value), of type ``kind``, with value computed once: a lambda that names an expression runs
    it for every element, so it is given a variable, that of a fold over one element."""
    return aggregate(call("array", value), lit(None).cast(kind), lambda _, v: f(v))


def __getattr__(name: str) -> Callable[..., Expr]:
    def run(*args) -> Expr:
        first = [col(args[0]) if isinstance(args[0], str) and name not in ("array", "concat", "concat_ws", "map") else args[0], *args[1:]] if args else []
        return call(name, *first)

    return run
