"""Ordered reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(text: str) -> Column:
    """'name', 'name desc', 'name desc nulls first' ... as a sort column. Nulls come last unless
    stated, in either direction."""
    name, *rest = text.split()
    direction = "desc" if "desc" in rest else "asc"
    nulls = "first" if "first" in rest else "last"
    return getattr(F.col(name), f"{direction}_nulls_{nulls}")()


def report(*order: str) -> Callable:
    """Sort the result of a report; the caller may pass ``ordered=False``.

    The order ends in a unique column, so that rows with equal leading values still spread over
    several sort partitions. A global sort shuffles the result once more, after computing it a
    first time to sample its range, which a report written to files seldom needs.
    """
    def wrap(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(build)
        def run(*args, ordered: bool = True, **kwargs) -> DataFrame:
            result = build(*args, **kwargs)
            return result.orderBy(*[_order(o) for o in order]) if ordered else result
        return run
    return wrap
