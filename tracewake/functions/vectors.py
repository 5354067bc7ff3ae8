"""Column expressions on vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Products summed in index order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector is zero; vectors of different length are an error."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.size(a) == F.size(b)
    return F.when(~same, F.raise_error(F.lit("vectors differ in length")).cast("double")).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def is_valid(vector: Column, dimensions: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def to_bytes(vector: Column) -> Column:
    """Little-endian float32."""

    @F.pandas_udf(T.BinaryType())
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def from_bytes(data: Column) -> Column:
    """Floats of little-endian float32; a length that is no multiple of four is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(data)
