"""Vector algebra as column expressions: dense, half-precision and sparse.

Sums run in double precision. Dense vectors are arrays, sparse ones maps from index to value. The cosine distance of
a zero vector is null; vectors of different lengths give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "l2_squared", "ip", "negative_ip", "cosine", "spherical")


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def rounded(x: Column, digits: int) -> Column:
    """Rounded as SQL engines do that keep the sign of a zero: what is below zero and rounds to it is -0.0."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def inner_product(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2_squared(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - inner_product(a, b) / n)


def spherical_distance(a, b) -> Column:
    """The angle between two vectors over pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - cosine_distance(a, b)))) / F.lit(np.pi)


def distance(metric: str, a, b) -> Column:
    """Smaller is nearer, whatever the metric."""
    return {
        "l2": l2_distance,
        "l2_squared": l2_squared,
        "ip": lambda x, y: -inner_product(x, y),
        "negative_ip": lambda x, y: -inner_product(x, y),
        "cosine": cosine_distance,
        "spherical": spherical_distance,
    }[metric](a, b)


def normalize(v) -> Column:
    """Null for a vector without length, which no index takes."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v)))


def add(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def subvector(v, start: int, length: int) -> Column:
    return F.slice(doubles(v), start, length)


def checked(v, dim: int) -> Column:
    """The vector as floats; an error if it hasn't ``dim`` elements."""
    c = F.col(v) if isinstance(v, str) else v
    return F.when(F.assert_true(F.size(c) == dim, F.lit(f"expected {dim} dimensions")).isNull(), c.cast("array<float>"))


def from_text(c) -> Column:
    return F.from_json(c, "array<float>")


def to_text(v) -> Column:
    return F.concat(F.lit("["), F.array_join(F.col(v) if isinstance(v, str) else v, ","), F.lit("]"))


def _halves(v: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float32))


def half(v) -> Column:
    """Elements rounded to half precision; beyond its range they are infinite."""
    return F.pandas_udf(_halves, "array<float>")(v)


def average(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group: partial sums by element, then one list of the vector's own length."""
    each = df.select(by, F.posexplode(doubles(vector)).alias("at", "x"))
    return (
        each.groupBy(by, "at").agg(F.avg("x").alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    )


# sparse vectors: map<int, double>


def sparse_merge(a, b) -> Column:
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def sparse_antimerge(a, b) -> Column:
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) - F.coalesce(y, zero))


def sparse_scale(v, by) -> Column:
    return F.transform_values(v, lambda _, x: x * by)


def sparse_get(v, at) -> Column:
    return F.try_element_at(v, F.lit(at))


def sparse_insert(v, at: int, value: float) -> Column:
    return F.map_concat(sparse_remove(v, at), F.create_map(F.lit(at), F.lit(float(value))))


def sparse_remove(v, at: int) -> Column:
    return F.map_filter(v, lambda k, _: k != at)


def sparse_ip(a, b) -> Column:
    return _sum(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))))


def sparse_norm(v) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(v), lambda x: x * x)))


def sparse_cosine(a, b) -> Column:
    n = sparse_norm(a) * sparse_norm(b)
    return F.when(n > 0, 1.0 - sparse_ip(a, b) / n)
