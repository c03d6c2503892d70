"""Vector arithmetic by higher-order functions, and the binary form of float32 vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


@F.pandas_udf(T.BinaryType())
def pack_floats(vectors: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_floats(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
