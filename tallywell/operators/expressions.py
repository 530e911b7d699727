"""Expressions as typed Spark columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import functions as F

from ..functions import aggregate, scalar
from ..functions.typed import BOOL, FLOAT, INT, NULL, SPARK, STR, Typed, common, null
from ..plans.analyzer import is_aggregate
from ..plans.ast import Between, Binary, Call, Case, Expr, In, IsNull, Like, Literal, Name, Paren, Star, Unary, bare
from ..plans.errors import QueryTypeError

_LEAST, _MOST = -(2**63), 2**63 - 1


def literal(value) -> Typed:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL)
    if isinstance(value, int):
        if not _LEAST <= value <= _MOST:
            return Typed(F.lit(float(value)), FLOAT)
        return Typed(F.lit(value).cast("long"), INT, value)
    return Typed(F.lit(value), FLOAT if isinstance(value, float) else STR)


class Compiler:
    """Compiles over ``columns``; a name that is not there is NULL.  ``given`` has what is
    computed already, by expression without parentheses: keys and aggregates."""

    def __init__(self, columns: Mapping[str, Typed], given: Mapping[Expr, Typed] | None = None, strict_counts: bool = False):
        self.columns, self.given, self.strict_counts = columns, given or {}, strict_counts

    def __call__(self, e: Expr) -> Typed:
        return self._of(bare(e))

    def _of(self, e: Expr) -> Typed:
        if (got := self.given.get(e)) is not None:
            return got
        match e:
            case Name(name):
                return self.columns.get(name) or null()
            case Literal(value, _):
                return literal(value)
            case Paren(inner):
                return self._of(inner)
            case Unary("NOT", arg):
                return scalar.negation(self._of(arg))
            case Unary(op, Literal(value, _)) if isinstance(value, (int, float)) and not isinstance(value, bool):
                return literal(-value if op == "-" else value)
            case Unary(op, arg):
                return scalar.minus(self._of(arg)) if op == "-" else self._of(arg)
            case Binary("AND" | "OR" as op, a, b):
                return scalar.logical(op, self._of(a), self._of(b))
            case Binary("=" | "<>" | "<" | "<=" | ">" | ">=" as op, a, b):
                return scalar.comparison(op, self._of(a), self._of(b))
            case Binary(op, a, b):
                return scalar.arithmetic(op, self._of(a), self._of(b))
            case IsNull(arg, negated):
                return scalar.is_null(self._of(arg), negated)
            case Like(arg, pattern, negated):
                return scalar.like(self._of(arg), _string("LIKE", pattern), negated)
            case In(arg, items, negated):
                tests = [scalar.comparison("=", self._of(arg), self._of(i)) for i in items]
                got = reduce(lambda a, b: scalar.logical("OR", a, b), tests)
                return scalar.negation(got) if negated else got
            case Between(arg, low, high, negated):
                x = self._of(arg)
                got = scalar.logical("AND", scalar.comparison(">=", x, self._of(low)), scalar.comparison("<=", x, self._of(high)))
                return scalar.negation(got) if negated else got
            case Case(branches, default):
                return self._case([self._of(b) for b in branches], self._of(default) if default else null())
            case Call("regex", (arg, pattern)):
                return scalar.regex(self._of(arg), scalar.checked_pattern(_string("REGEX", pattern)))
            case Call("cast", (arg, Literal(kind, _))):
                return scalar.cast(self._of(arg), kind)
            case Call(name, (arg,)) if name in scalar.ONE:
                return scalar.ONE[name](self._of(arg))
            case Call(name, (arg,), _, distinct) if is_aggregate(e):
                x = Typed(F.lit(1), INT) if isinstance(arg, Star) else self._of(arg)
                return aggregate.distinct(name, x) if distinct else aggregate.AGGREGATES[name](x, self.strict_counts)
        raise QueryTypeError(f"{e} can't be computed")

    def _case(self, branches: list[Typed], default: Typed) -> Typed:
        kind = common("CASE", *branches[1::2], default)
        out = None
        for condition, result in zip(branches[::2], branches[1::2]):
            if condition.kind not in (BOOL, NULL):
                raise QueryTypeError(f"WHEN does not take {condition.kind}")
            value = result.as_(kind)
            out = F.when(condition.as_(BOOL), value) if out is None else out.when(condition.as_(BOOL), value)
        return Typed(out.otherwise(default.as_(kind)), kind)


def shown(x: Typed) -> F.Column:
    """A result column, with a type that every sink takes."""
    return x.column.cast(SPARK[x.kind]) if x.kind == NULL else x.column


def _string(what: str, e: Expr) -> str:
    if not (isinstance(e, Literal) and isinstance(e.value, str)):
        raise QueryTypeError(f"{what} needs a constant pattern")
    return e.value
