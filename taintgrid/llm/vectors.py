"""Vectors shared by the nearest-neighbour and near-copy operators: which take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_each(df: DataFrame) -> DataFrame:
    """vec_id, embedding: one row for each vec_id that isn't null; of several the smallest embedding."""
    return df.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def takes_part(embedding: Column) -> Column:
    """Whether a vector is not null, has no null or non-finite component, and is not all zeros."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, dim and vec (the components as doubles, 8 bytes each) of the vectors that take part."""
    return one_each(df).where(F.coalesce(takes_part(F.col("embedding")), F.lit(False))).select(
        "vec_id", F.size("embedding").alias("dim"), F.arrow_udf(_bytes, "binary")(F.col("embedding")).alias("vec"))


def _bytes(rows: pa.Array) -> pa.Array:
    return pa.array([np.asarray(r.values, np.float64).tobytes() for r in rows], pa.binary())


def matrix(vec: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.float64).reshape(len(vec), dim)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their largest component, against overflow, and their lengths then."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def cosine(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y; the sum runs the same way for each pair, so equal vectors tie."""
    return (x * y).sum(1) / (xn * yn)
