"""Probability that a noisy stay was in contact with a place.

A stay's true place lies in a disc of radius R around its noisy place, with radial density
exp(-r) / (1 - exp(-R)). The probability is the mass of the part within delta of the other place, by a left
Riemann sum of 1000 steps. Sums over whole circles are geometric series, and so are the correlated
case's sums over angles; the others are taken in Arrow batches, many pairs and all steps at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hopwise.plans.workers import importable

STEPS = 1000
#: Pairs whose steps are in memory together: 1000 steps of 8 bytes each, a few arrays of that. So few stay in a core's cache.
PAIRS_AT_ONCE = 32


def _density(r: np.ndarray, radius: np.ndarray) -> np.ndarray:
    return np.exp(-r) / -np.expm1(-radius)


def _whole(dist: np.ndarray, radius: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The mass of the circles that lie within delta as a whole: steps from 0 to delta - dist, as a geometric series."""
    step = (delta - dist) / STEPS
    return np.where(step > 0, step * np.expm1(-(delta - dist)) / np.expm1(-step) / -np.expm1(-radius), 0.0)


def _steps(dist: np.ndarray, radius: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The radii, pairs x steps, of the circles that lie within delta in part, and the steps' widths."""
    left, right = np.abs(dist - delta), np.minimum(radius, dist + delta)
    width = (right - left)[:, None] / STEPS
    return left[:, None] + np.arange(STEPS) * width, width


def _arc_share(r: np.ndarray, dist: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Share of the circle of radius r around one place that is within delta of the other."""
    d, e = dist[:, None], delta[:, None]
    share = np.arccos((r * r + d * d - e * e) / (2 * r * d)) / math.pi
    return np.where(np.isnan(share), 1.0 / STEPS, share)


def independent_values(dist: np.ndarray, radius: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """0 if disc and circle of radius delta are apart, 1 if the disc lies in it, else the integral, at most 1."""
    with np.errstate(all="ignore"):
        r, width = _steps(dist, radius, delta)
        partial = (_density(r, radius[:, None]) * _arc_share(r, dist, delta) * width).sum(axis=1)
        return _cascade(dist, radius, delta, _whole(dist, radius, delta) + partial)


def _cascade(dist: np.ndarray, radius: np.ndarray, delta: np.ndarray, value: np.ndarray) -> np.ndarray:
    apart, inside = (radius <= 0) | (dist >= delta + radius), (delta >= radius) & (dist <= delta - radius)
    return np.where(apart, 0.0, np.where(inside, 1.0, np.minimum(value, 1.0)))


def _angle(v1, v2, opposite):
    with np.errstate(all="ignore"):
        return np.degrees(np.arccos((v1 * v1 + v2 * v2 - opposite * opposite) / (2 * v1 * v2)))


def correlated_values(dist: np.ndarray, dist_p_prev: np.ndarray, dist_q_prev: np.ndarray, radius: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """As independent_values(), but directions are weighted by their angle to the way from the previous stay.

    The inner sum over angles is a geometric series on either side of 0, so a pair takes 1000 terms and
    not their square.
    """
    with np.errstate(all="ignore"):
        left, right = np.abs(dist - delta), np.minimum(radius, dist + delta)
        left, right = np.minimum(left, right), np.maximum(left, right)
        width = (right - left)[:, None] / STEPS
        r = left[:, None] + np.arange(STEPS) * width
        turn, half = _angle(dist_q_prev, dist, dist_p_prev)[:, None], _angle(r, dist[:, None], delta[:, None])
        fold = lambda a: np.where(a <= 180, a, 180 - a)
        a, b = fold(turn - half), fold(turn + half)
        low, high = np.minimum(a, b), np.maximum(a, b)
        mass = np.minimum(_angular_mass(low, (high - low) / STEPS), 1)
        partial = np.nansum(mass * _density(r, radius[:, None]) * width, axis=1)
        return _cascade(dist, radius, delta, _whole(dist, radius, delta) + partial)


def correlated_value(dist: float, dist_p_prev: float, dist_q_prev: float, radius: float, delta: float) -> float:
    return float(correlated_values(*(np.array([x], float) for x in (dist, dist_p_prev, dist_q_prev, radius, delta)))[0])


def _angular_mass(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sum of width * exp(-|low + k * width|) / (2 (1 - exp(-180))) for k in 0 .. 999."""
    with np.errstate(all="ignore"):
        n_negative = np.clip(np.ceil(-low / width), 0, STEPS)  # terms below 0

        def series(first, n):  # first * (1 + q + ... + q ** (n - 1))
            return first * np.where(width < 1e-12, n, -np.expm1(-width * n) / -np.expm1(-width))

        last = low + (n_negative - 1) * width  # the negative term nearest to 0
        negative = np.where(n_negative > 0, series(np.exp(np.minimum(last, 0)), n_negative), 0.0)
        start = low + n_negative * width
        positive = np.where(n_negative < STEPS, series(np.exp(-np.maximum(start, 0)), STEPS - n_negative), 0.0)
        return (negative + positive) * width / (2 * (1 - math.exp(-180)))


def distinct_values(values, given: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """values of each row, taken once for equal rows, and which rows have a null (as NaN); these are left at 0."""
    null = np.isnan(np.sum(given, axis=0))
    rows, of_row = np.unique(np.stack([g[~null] for g in given], axis=1), axis=0, return_inverse=True)
    found = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        found[at : at + PAIRS_AT_ONCE] = values(*rows[at : at + PAIRS_AT_ONCE].T)
    out = np.zeros(len(null))
    out[~null] = found[of_row.reshape(-1)]
    return out, null


def _batched(values, columns: tuple[Column | str, ...]) -> Column:
    """values of arrays, as a column, in Arrow batches; null where an argument is null. Equal rows of a batch, as of spreaders at one place, are taken once."""
    importable(SparkSession.getActiveSession())

    def run(*arrays: pa.Array) -> pa.Array:
        given = [a.to_numpy(zero_copy_only=False).astype(float) for a in arrays]
        out, null = distinct_values(values, given)
        return pa.array(out, mask=null)

    doubles = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    if len(columns) == 3:

        @F.arrow_udf("double")
        def of_three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

        return of_three(*doubles)

    @F.arrow_udf("double")
    def of_five(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
        return run(a, b, c, d, e)

    return of_five(*doubles)


def independent_probability(dist: Column | str, radius: Column | str, delta: Column | str) -> Column:
    return _batched(independent_values, (dist, radius, delta))


def correlated_probability(dist: Column | str, dist_p_prev: Column | str, dist_q_prev: Column | str, radius: Column | str, delta: Column | str) -> Column:
    return _batched(correlated_values, (dist, dist_p_prev, dist_q_prev, radius, delta))
