"""Arrow functions that are made when they are called, so that modules load without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        return call

    return wrap


def arrow_arrays(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """The same over Arrow arrays, which need no Python object for each value."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(fn, kind)(*columns)

        return call

    return wrap
