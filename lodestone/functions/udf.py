"""Pandas UDFs whose type is given as DDL, made when they are used: modules stay importable without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas_function(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*cols: Column | str) -> Column:
            return F.pandas_udf(f, ddl)(*cols)

        return call

    return wrap
