"""Distances between vectors given as array columns, by name."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_bytes(a: Column, b: Column) -> Column:
    """Squared distance of small-integer vectors, as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, t: s + t)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def so2(a: Column, b: Column) -> Column:
    """Distance of two angles, wrapped to [0, pi]."""
    d = F.abs(b - a)
    return F.when(d > math.pi, F.abs(d - F.lit(2 * math.pi))).otherwise(d)


#: so3 compares quaternions by their squared distance.
METRICS = {"ip": ip_distance, "l2": l2, "l1": l1, "so3": l2, "l2_bytes": l2_bytes}


def _rows(distance: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A metric of differences, a query at a time: near vectors keep their digits, and memory is a block's."""
    return lambda q, v: np.array([distance(v - row) for row in q]).reshape(len(q), len(v))


def _squares(d: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", d, d)


def _l2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances; vectors of few components are summed by component, without a loop over their rows."""
    if not 0 < v.shape[1] <= 8:
        return _rows(_squares)(q, v)
    columns = np.ascontiguousarray(v.T)
    out, d = np.zeros((len(q), len(v))), np.empty(len(v))
    for total, row in zip(out, q, strict=True):
        for column, x in zip(columns, row, strict=True):
            np.subtract(column, x, out=d)
            total += np.multiply(d, d, out=d)
    return out


def _angles(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = np.abs(v[None, :, 0] - q[:, None, 0])
    return np.where(d > np.pi, np.abs(d - 2 * np.pi), d)


#: Distances of each query row to each vector row, by name; see :func:`register_metric`.
BLOCK_METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "ip": lambda q, v: 1.0 - q @ v.T,
    "l2": _l2,
    "box": _rows(lambda d: _squares(d - np.floor(d + 0.5))),  # to nearest images in the unit box
    "l1": _rows(lambda d: np.abs(d).sum(1)),
    "so2": _angles,
    "so3": _l2,
    "l2_bytes": _l2,
}


def _gaps(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(low - row, row - high), 0.0)


def _least_l2(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _squares(_gaps(row, low, high))


def _least_angle(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """0 if the box holds the angle or the same one a turn away, else the nearer end's distance, less its rounding."""
    q, low, high = row[0], low[:, 0], high[:, 0]
    slack = 1e-14 * (np.abs(q) + np.abs(low) + np.abs(high) + 10)
    ends = _angles(np.array([[q]]), np.concatenate([low, high])[:, None]).reshape(2, -1).min(0)
    for turn in (-2 * np.pi, 0.0, 2 * np.pi):
        ends = np.where((low - slack <= q + turn) & (q + turn <= high + slack), 0.0, ends)
    return np.maximum(ends - slack, 0.0)


#: The least distance of a query to any vector between two corners, a row a box, or somewhat less, by name: where it is known,
#: a search leaves out boxes that lie too far.
LEAST: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": _least_l2,
    "l1": lambda row, low, high: _gaps(row, low, high).sum(1),
    "so2": _least_angle,
    "so3": _least_l2,
    "l2_bytes": _least_l2,
}


#: Queries and elements of differences that a task holds together.
TOGETHER, DIFFERENCES = 256, 1 << 20


class _Candidates:
    """Which vectors may be among the k nearest of queries: squared distances in single precision, and what its error leaves open."""

    def __init__(self, v: np.ndarray, k: int):
        self.k, self.middle = k, v.mean(0)
        b = v - self.middle
        b2 = np.einsum("ij,ij->i", b, b)
        self.far, self.columns = np.sqrt(b2.max()), np.vstack([-2.0 * b.T, b2[None]]).astype(np.float32)

    def of(self, q: np.ndarray) -> np.ndarray:
        a, n = q - self.middle, self.columns.shape[1]
        error = 2.4e-7 * (q.shape[1] + 8) * (np.sqrt(np.einsum("ij,ij->i", a, a)) + self.far) ** 2
        if not (error < 1e30).all() or self.k >= n:
            return np.ones((len(q), n), bool)
        rows = np.hstack([a, np.ones((len(a), 1))]).astype(np.float32)
        d = rows @ self.columns
        last = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
        return d <= (last + error).astype(np.float32)[:, None]


def nearest_l2(q: np.ndarray, v: np.ndarray, at: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance) of the k nearest vectors of each query, ties by the vectors' ids ``at``; with ``own`` not those of the query's id.

    A product of matrices finds the candidates, and their distances are then taken from differences, so the result is that of brute force.
    """
    q, v = q.astype(np.float64), v.astype(np.float64)
    order = np.unique(at, return_inverse=True)[1]
    candidates, found = _Candidates(v, k + (own is not None)), []
    for first in range(0, len(q), TOGETHER):
        part = q[first : first + TOGETHER]
        who, place = np.divmod(np.flatnonzero(candidates.of(part)), len(v))
        if own is not None:
            other = own[first + who] != at[place]
            who, place = who[other], place[other]
        d, step = np.empty(len(who)), max(1, DIFFERENCES // max(1, q.shape[1]))
        for i in range(0, len(who), step):
            d[i : i + step] = _squares(part[who[i : i + step]] - v[place[i : i + step]])
        best = np.lexsort((order[place], d, who))
        who, place, d = who[best], place[best], d[best]
        near = np.arange(len(who)) - np.searchsorted(who, who) < k
        found.append((first + who[near], place[near], d[near]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def register_metric(name: str, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], least: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """A metric for block search: a function of query rows and vector rows (doubles) that gives their distances as a matrix.

    ``least``, as in :data:`LEAST`, spares vectors of few components most meetings; it must never exceed a distance inside the box.
    """
    BLOCK_METRICS[name] = distance
    if least is None:
        LEAST.pop(name, None)
    else:
        LEAST[name] = least
