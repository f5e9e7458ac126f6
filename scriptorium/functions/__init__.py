"""Column functions: native expressions, and Arrow UDFs where none can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF that is made when first used, so that modules can be imported without a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap


def once(value: Column) -> Column:
    """The same value behind an expression that the optimiser won't copy, for long rule chains used in several places."""
    return F.when(F.monotonically_increasing_id() >= 0, value)
