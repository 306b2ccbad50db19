"""Vector functions over array columns, all in the JVM but for raw bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import pandas_function


def dot(a: str | Column, b: str | Column) -> Column:
    """Over the shorter length, in double, left to right."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: str | Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    one = F.array(F.struct((F.col(v) if isinstance(v, str) else v).alias("v"), norm(v).alias("n")))
    return F.element_at(F.transform(one, lambda r: F.transform(r["v"], lambda x: (x.cast("double") / F.when(r["n"] == 0, 1.0).otherwise(r["n"])).cast("float"))), 1)


def similarity(distance: Column) -> Column:
    """Cosine distance to similarity."""
    return 1 - distance


@pandas_function("array<float>")
def from_bytes(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; a length that is no multiple of four is an error."""
    return raw.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))


@pandas_function("binary")
def to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
