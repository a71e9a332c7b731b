"""Spark SQL expressions as text.

Page functions are trees of several thousand nodes (lambdas over token arrays).  Built
through ``pyspark.sql.functions`` each node is a call into the JVM, which took up to
15 s per query before anything ran; as text a whole column is one ``expr`` call that the
SQL parser reads in milliseconds.  ``Expr`` keeps the notation of ``Column`` and every
attribute of this module is the Spark SQL function of that name.

>>> transform(col("xs"), lambda x: upper(x) == "A").sql
"transform(xs, v0 -> (upper(v0) = 'A'))"
"""

from __future__ import annotations

import inspect
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_names = count()


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _text(value) -> str:
    if isinstance(value, Expr):
        return value.sql
    if callable(value):
        size = len(
            [p for p in inspect.signature(value).parameters.values() if p.default is p.empty]
        )
        names = [f"v{next(_names)}" for _ in range(size)]
        body = _text(value(*map(Expr, names)))
        head = names[0] if size == 1 else f"({', '.join(names)})"
        return f"{head} -> {body}"
    return literal(value)


class Expr:
    """A Spark SQL expression and, where it has one, the name it goes by."""

    __hash__ = None

    def __init__(self, sql: str, name: str | None = None):
        self.sql = sql
        self.name = name

    def col(self, name: str | None = None) -> Column:
        """The expression as a DataFrame column."""
        column = F.expr(self.sql)
        name = name or self.name
        return column.alias(name) if name else column

    def alias(self, name: str) -> Expr:
        return Expr(self.sql, name)

    def cast(self, type_name: str) -> Expr:
        return Expr(f"CAST({self.sql} AS {type_name})")

    def __getitem__(self, field: str) -> Expr:
        whole = self.sql if self.sql.replace(".", "").isidentifier() else f"({self.sql})"
        return Expr(f"{whole}.{field}", field)

    def _binary(self, operator: str, other) -> Expr:
        return Expr(f"({self.sql} {operator} {_text(other)})")

    def __eq__(self, other):
        return self._binary("=", other)

    def __ne__(self, other):
        return self._binary("<>", other)

    def __lt__(self, other):
        return self._binary("<", other)

    def __gt__(self, other):
        return self._binary(">", other)

    def __ge__(self, other):
        return self._binary(">=", other)

    def __add__(self, other):
        return self._binary("+", other)

    def __sub__(self, other):
        return self._binary("-", other)

    def __mul__(self, other):
        return self._binary("*", other)

    def __mod__(self, other):
        return self._binary("%", other)

    def __truediv__(self, other):
        return self._binary("/", other)

    def __and__(self, other):
        return self._binary("AND", other)

    def __or__(self, other):
        return self._binary("OR", other)

    def __invert__(self):
        return Expr(f"(NOT {self.sql})")

    def __neg__(self):
        return Expr(f"(- {self.sql})")

    def isNull(self) -> Expr:
        return Expr(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Expr:
        return Expr(f"({self.sql} IS NOT NULL)")

    def isin(self, *values) -> Expr:
        if len(values) == 1 and isinstance(values[0], (list, tuple)):
            values = values[0]
        return Expr(f"({self.sql} IN ({', '.join(map(_text, values))}))")

    def between(self, low, high) -> Expr:
        return Expr(f"({self.sql} BETWEEN {_text(low)} AND {_text(high)})")

    def contains(self, part) -> Expr:
        return Expr(f"contains({self.sql}, {_text(part)})")

    def startswith(self, part) -> Expr:
        return Expr(f"startswith({self.sql}, {_text(part)})")

    def endswith(self, part) -> Expr:
        return Expr(f"endswith({self.sql}, {_text(part)})")

    def rlike(self, pattern: str) -> Expr:
        return Expr(f"rlike({self.sql}, {literal(pattern)})")


class Case(Expr):
    """``CASE`` with its branches so far."""

    def __init__(self, branches: str):
        super().__init__(f"CASE {branches} END")
        self._branches = branches

    def when(self, condition, value) -> Case:
        return Case(f"{self._branches} WHEN {_text(condition)} THEN {_text(value)}")

    def otherwise(self, value) -> Expr:
        return Expr(f"CASE {self._branches} ELSE {_text(value)} END")


def col(name: str) -> Expr:
    return Expr(name, name.rsplit(".", 1)[-1])


def lit(value) -> Expr:
    return Expr(literal(value))


def when(condition, value) -> Case:
    return Case(f"WHEN {_text(condition)} THEN {_text(value)}")


def struct(*fields: Expr) -> Expr:
    parts = ", ".join(f"{literal(f.name)}, {f.sql}" for f in fields)
    return Expr(f"named_struct({parts})")


def select(df: DataFrame, *parts: str | Column | Expr) -> DataFrame:
    """``df.select`` that takes expressions too."""
    return df.select(*[p.col() if isinstance(p, Expr) else p for p in parts])


def empty(type_name: str) -> Expr:
    """Empty array of a type."""
    return Expr(f"CAST(array() AS {type_name})")


def call(name: str, *arguments) -> Expr:
    """Spark SQL function by name; callables become lambda functions."""
    return Expr(f"{name}({', '.join(map(_text, arguments))})")


def __getattr__(name: str):
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *arguments: call(name, *arguments)
