"""Queries and expressions as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields


class Expr:
    """An expression.  ``str`` gives its text, which is the name of its result column."""

    def children(self) -> Iterator[Expr]:
        for f in fields(self):
            value = getattr(self, f.name)
            for x in value if isinstance(value, tuple) else (value,):
                if isinstance(x, Expr):
                    yield x

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Star(Expr):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Name(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str | bool | None
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Paren(Expr):
    """Parentheses, kept for the text only."""

    inner: Expr

    def __str__(self) -> str:
        return f"({self.inner})"


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr

    def __str__(self) -> str:
        return f"{self.op} {self.arg}" if self.op == "NOT" else f"{self.op}{self.arg}"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.arg} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.arg} {'NOT ' * self.negated}LIKE {self.pattern}"


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool

    def __str__(self) -> str:
        return f"{self.arg} {'NOT ' * self.negated}IN ({', '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool

    def __str__(self) -> str:
        return f"{self.arg} {'NOT ' * self.negated}BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class Case(Expr):
    """Conditions and results in turn, then the default or None."""

    branches: tuple[Expr, ...]
    default: Expr | None

    def __str__(self) -> str:
        pairs = zip(self.branches[::2], self.branches[1::2])
        end = f" ELSE {self.default}" if self.default else ""
        return "CASE" + "".join(f" WHEN {c} THEN {r}" for c, r in pairs) + f"{end} END"


@dataclass(frozen=True)
class Call(Expr):
    """``shown`` is the function's name as written."""

    name: str
    args: tuple[Expr, ...]
    shown: str
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.shown}({'DISTINCT ' * self.distinct}{', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    """A select item and the name of its column."""

    expr: Expr
    alias: str | None

    @property
    def name(self) -> str:
        return self.alias if self.alias is not None else str(self.expr)


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Query:
    select: tuple[Item, ...]
    table: str
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    distinct: bool = False
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0

    def expressions(self) -> Iterator[Expr]:
        yield from (i.expr for i in self.select)
        yield from (o.expr for o in self.order_by)
        yield from self.group_by
        yield from (e for e in (self.where, self.having) if e is not None)


def bare(e: Expr) -> Expr:
    """``e`` without parentheses, and function names in one spelling, so that equal
    expressions compare equal."""
    return rebuilt(e, lambda x: x.inner if isinstance(x, Paren) else Call(x.name, x.args, x.name, x.distinct) if isinstance(x, Call) else x)


def rebuilt(e: Expr, change: Callable[[Expr], Expr]) -> Expr:
    """``e`` with ``change`` applied to every part, the innermost first."""
    values = {}
    for f in fields(e):
        value = getattr(e, f.name)
        if isinstance(value, tuple):
            value = tuple(rebuilt(x, change) if isinstance(x, Expr) else x for x in value)
        elif isinstance(value, Expr):
            value = rebuilt(value, change)
        values[f.name] = value
    return change(type(e)(**values))
