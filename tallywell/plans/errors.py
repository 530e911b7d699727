"""What a query can fail with."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import PySparkException


class QueryError(Exception):
    """Any failure of a query; ``status`` is the HTTP status that stands for it."""

    status = 400


class ParseError(QueryError):
    """The text is no query."""


class QueryTypeError(QueryError):
    """An operator or function does not take values of these types."""


class Unsupported(QueryError):
    """A construct that the dialect knows of and does not have."""

    status = 501


class Overflow(QueryError):
    """Integer arithmetic left 64 bits, or divided by zero."""


class FatalError(QueryError):
    """A failure that is no fault of the query."""

    status = 500


class Canceled(QueryError):
    """The query was stopped."""


_OVERFLOWS = ("ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "BINARY_ARITHMETIC_OVERFLOW", "CAST_OVERFLOW")


@contextlib.contextmanager
def translated() -> Iterator[None]:
    """Spark's errors in the body as those of this module."""
    try:
        yield
    except QueryError:
        raise
    except PySparkException as e:
        said = str(e)
        if any(f"[{x}" in said for x in _OVERFLOWS) or "overflow" in said.lower():
            raise Overflow(said.splitlines()[0]) from e
        if "cancelled" in said or "canceled" in said:
            raise Canceled(said.splitlines()[0]) from e
        raise FatalError(said) from e
