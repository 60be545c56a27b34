"""Vectors as blobs of little-endian 32-bit floats; Spark has no function for the bits of a float, so Arrow batches do it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))
