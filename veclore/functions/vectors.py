"""Column functions on ``array<float|double>`` vectors. Arithmetic is in doubles, in the order of the elements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL if either vector is zero."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def between(a: Column, b: Column, t: Column) -> Column:
    """The point at part ``t`` of the way from a to b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + (y - x) * t)


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def projected(v: Column, mean, components) -> Column:
    """(v - mean) on each of the component vectors."""
    centred = F.zip_with(doubles(v), literal(mean), lambda x, m: x - m)
    return F.array(*(total(F.zip_with(centred, literal(c), lambda x, w: x * w)) for c in components))


def without(v: Column, mean, components) -> Column:
    """v - mean without its parts along the (orthonormal) component vectors."""
    m, c = np.asarray(mean, float), np.asarray(components, float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64) - m
        return pd.Series(list(x - (x @ c.T) @ c))

    return rest(doubles(v))


@F.pandas_udf(T.StructType([T.StructField("variation", T.DoubleType()), T.StructField("norm_ratio", T.DoubleType())]))
def path_facts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of the straight path in 20 steps between two vectors: standard deviation over mean of the step lengths, and the smallest
    norm over the largest. A path that goes nowhere has neither variation nor, at the origin, a ratio."""
    if not len(a):
        return pd.DataFrame({"variation": [], "norm_ratio": []}, dtype="float64")
    x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
    t = np.arange(21)[:, None, None] / 20
    path = x[None] + (y - x)[None] * t
    steps, norms = np.linalg.norm(np.diff(path, axis=0), axis=2), np.linalg.norm(path, axis=2)
    mean, top = steps.mean(axis=0), norms.max(axis=0)
    return pd.DataFrame({"variation": np.where(mean > 0, steps.std(axis=0) / np.where(mean > 0, mean, 1), 0.0), "norm_ratio": np.where(top > 0, norms.min(axis=0) / np.where(top > 0, top, 1), np.nan)})


@F.pandas_udf(T.DoubleType())
def random_distance(i: pd.Series, j: pd.Series, draw: pd.Series) -> pd.Series:
    """Distance of two random unit vectors of 64 dimensions that depend on their ids and the draw only."""

    def unit_vectors(ids: pd.Series) -> np.ndarray:
        h = (ids.to_numpy().astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + draw.to_numpy().astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)) + np.arange(1, 129, dtype=np.uint64)[None] * np.uint64(0xA24BAED4963EE407)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
        z = np.sqrt(-2 * np.log(1 - u[:, :64])) * np.cos(2 * np.pi * u[:, 64:])
        return z / np.linalg.norm(z, axis=1, keepdims=True)

    return pd.Series(np.linalg.norm(unit_vectors(i) - unit_vectors(j), axis=1)) if len(i) else pd.Series([], dtype="float64")
