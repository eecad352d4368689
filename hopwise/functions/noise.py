"""Seeded uniforms and planar Laplace noise, as native column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopwise.functions.geo import d, offset_degrees

HALLEY_STEPS = 10


def uniform(*key: Column) -> Column:
    """In [0, 1), from integers: the same for equal keys, on any engine and in any order."""
    total = F.lit(17).cast("long")
    for k in key:
        total = (total * 1000003 + k.cast("long")) % 2147483648
    for _ in range(2):
        total = (total * 1103515245 + 12345) % 2147483648
    return total / F.lit(2147483648.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once: within a lambda, Spark evaluates an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lambert_w_minus_1(x: Column) -> Column:
    """The lower branch of Lambert's W on [-1/e, 0), by Halley's iteration."""

    def start(x: Column) -> Column:
        near = F.sqrt(F.greatest(F.lit(0.0), 2 * (1 + math.e * x)))
        return F.when(x < -0.25, -1 - near - near * near / 3).otherwise(F.log(-x) - F.log(-F.log(-x)))

    def step(w: Column, x: Column) -> Column:
        moved = lambda f, slope: F.when((F.abs(w + 1) < 1e-9) | (slope == 0), w).otherwise(w - f / slope)
        slope = lambda e, f: e * (w + 1) - (w + 2) * f / (2 * w + 2)
        return _let(F.exp(w), lambda e: _let(w * e - x, lambda f: _let(slope(e, f), lambda s: moved(f, s))))

    return _let(x, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(HALLEY_STEPS)), start(x), lambda w, _: step(w, x)))


def planar_laplace_radius(u: Column, epsilon: float) -> Column:
    """The radius in km whose cumulated probability is u, for a privacy budget per km."""
    return -(lambert_w_minus_1((u - 1) * math.exp(-1)) + 1) / epsilon


def displaced(lng, lat, angle: Column, radius: Column, compat_angle: bool = False) -> tuple[Column, Column]:
    """A point moved by a radius in km at an angle in degrees.

    compat_angle: the angle's number is taken for radians in cosine and sine, and signs are set by
    its quadrant in degrees again.
    """
    theta = angle if compat_angle else F.radians(angle)
    east, north = offset_degrees(F.cos(theta) * radius, F.sin(theta) * radius, d(lat))
    if compat_angle:
        east = F.when((angle <= 90) | (angle > 270), east).otherwise(-east)
        north = F.when(angle <= 180, north).otherwise(-north)
    return d(lng) + east, d(lat) + north
