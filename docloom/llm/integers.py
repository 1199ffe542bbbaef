"""Exact integer arithmetic on quantised vectors, which the vector operators share.

Components become floor(scale * x) in double precision, held to +-2**62. Products and squared distances
are exact: by doubles where every intermediate sum is an integer below 2**53, by 64-bit integers where
these cannot overflow, and by Python's integers beyond. Results wider than a long are held to its range.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT, LONG = 1 << 62, (1 << 63) - 1
DECIMAL = pa.decimal128(38, 0)


def finite(vec: Column) -> Column:
    """Whether a vector is there and none of its components is null or not finite; the empty vector is."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)


def floor_of(c: float, scale: int) -> int:
    """One component in Python's integers, for brute-force versions."""
    return max(-LIMIT, min(LIMIT, math.floor(min(max(float(c) * scale, -1e30), 1e30))))


def matrix(col: pa.ListArray, dim: int, scale: int) -> np.ndarray:
    """Integers of vectors of any length up to dim, zeros behind the shorter ones."""
    size = np.diff(np.asarray(col.offsets))
    flat = floors(np.asarray(col.flatten()), scale)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    return max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0


def like(bound: int, *arrays: np.ndarray, doubles: bool = False) -> list[np.ndarray]:
    """The arrays in a type in which no result up to bound is rounded or overflows."""
    kind = np.float64 if doubles and bound < 1 << 53 else np.int64 if bound <= LONG else object
    return [a.astype(kind) for a in arrays]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of x (n, w) to those of y (k, w)."""
    bound = 4 * max(1, x.shape[1]) * max(1, largest(x), largest(y)) ** 2
    a, b = like(bound, x, y, doubles=True)
    out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return out.astype(np.int64) if out.dtype == np.float64 else out


def to_long(x: np.ndarray) -> np.ndarray:
    return np.array([min(int(v), LONG) if v > 0 else max(int(v), -LONG - 1) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def decimals(x: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in x], DECIMAL) if x.dtype == object else pa.array(x.astype(np.int64)).cast(pa.decimal128(19, 0)).cast(DECIMAL)


def long_sum(c: Column) -> Column:
    """A sum of longs that stops at the largest long."""
    return F.least(F.sum(c.cast("decimal(19,0)")), F.lit(LONG)).cast("long")


def group_sums(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups that occur, in order, with the sum of their rows of x and their number."""
    if not len(group):
        return np.zeros(0, np.int64), x[:0], np.zeros(0, np.int64)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0)))
    (x,) = like(len(x) * largest(x), x)
    return group[order][first], np.add.reduceat(x[order], first, axis=0), np.diff(np.append(first, len(order)))
