"""Vectors as arrays: dot products, cosine, and an offline embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From a text column to a column of vectors (arrays of floats).
Embedder = Callable[[Column], Column]


def model_embedder(encode: Callable[[list[str]], np.ndarray]) -> Embedder:
    """An embedder by a model: ``encode`` makes an array of one row for each text, and is called once for each Arrow batch."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode([t or "" for t in texts]), np.float32))) if len(texts) else pd.Series([], dtype=object)

    udf = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR)
    return lambda text: udf(text)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the angle between two vectors; 0 where one has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def hashed_embedding(text: Column, dim: int = 256, gram: int = 3) -> Column:
    """Counts of hashed character n-grams of the lower-cased text: an embedder that needs no model."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    slots = F.when(F.length(padded) >= gram, F.transform(F.sequence(F.lit(1), F.length(padded) - (gram - 1)), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(gram))), F.lit(dim)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("float"))
