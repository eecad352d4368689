"""Geometry on the sphere, as native column expressions. Coordinates are degrees, distances km."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius as a float32 widened to double, the region, and the grid's step in degrees.
EARTH_RADIUS_KM = 6378.13720703125
MIN_LNG, MAX_LNG, MIN_LAT, MAX_LAT = 114, 119, 38, 43
STEP = 0.01
GRID_ROWS = GRID_COLS = 500


def d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def haversine(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance, rounded to 0.01 m; 0 for equal coordinates."""
    a = F.radians(d(lng1)) - F.radians(d(lng2))
    b = F.radians(d(lat1)) - F.radians(d(lat2))
    h = F.pow(F.sin(b / 2), 2) + F.cos(F.radians(d(lat1))) * F.cos(F.radians(d(lat2))) * F.pow(F.sin(a / 2), 2)
    far = F.floor(2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h)) * 100000.0 + 0.5) / 100000.0
    return F.when((d(lng1) == d(lng2)) & (d(lat1) == d(lat2)), F.lit(0.0)).otherwise(far)


def offset_degrees(east_km: Column, north_km: Column, lat: Column) -> tuple[Column, Column]:
    """(degrees of longitude, of latitude) of an offset in km at a latitude."""
    return F.degrees(east_km / (EARTH_RADIUS_KM * F.cos(F.radians(d(lat))))), F.degrees(north_km / EARTH_RADIUS_KM)


def box(min_lng, min_lat, max_lng, max_lat) -> Column:
    names = ("min_lng", "min_lat", "max_lng", "max_lat")
    return F.struct(*(d(c).alias(n) for c, n in zip((min_lng, min_lat, max_lng, max_lat), names, strict=True)))


def circle_box(lng, lat, radius_km) -> Column:
    """The box around a circle; the point itself if the radius isn't positive."""
    east, north = offset_degrees(d(radius_km), d(radius_km), d(lat))
    wide = F.when(d(radius_km) > 0, east).otherwise(0.0)
    high = F.when(d(radius_km) > 0, north).otherwise(0.0)
    return box(d(lng) - wide, d(lat) - high, d(lng) + wide, d(lat) + high)


def inside(a: Column, b: Column) -> Column:
    """Whether box a lies in box b, edges included."""
    return (a["min_lng"] >= b["min_lng"]) & (a["max_lng"] <= b["max_lng"]) & (a["min_lat"] >= b["min_lat"]) & (a["max_lat"] <= b["max_lat"])


def contains(a: Column, b: Column) -> Column:
    return inside(b, a)


def contains_point(a: Column, lng, lat) -> Column:
    return d(lng).between(a["min_lng"], a["max_lng"]) & d(lat).between(a["min_lat"], a["max_lat"])


def intersects(a: Column, b: Column) -> Column:
    """Whether the boxes share more than edges."""
    return (a["min_lng"] < b["max_lng"]) & (b["min_lng"] < a["max_lng"]) & (a["min_lat"] < b["max_lat"]) & (b["min_lat"] < a["max_lat"])


def circle_state(a: Column, lng, lat, radius_km) -> Column:
    """1 if box a and the circle's box contain one another, 0 if they intersect, -1 if they are apart."""
    c = circle_box(lng, lat, radius_km)
    return F.when(inside(a, c) | contains(a, c), 1).when(intersects(a, c), 0).otherwise(-1)


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["min_lng"], b["min_lng"]), F.least(a["min_lat"], b["min_lat"]), F.greatest(a["max_lng"], b["max_lng"]), F.greatest(a["max_lat"], b["max_lat"]))


def perimeter(a: Column) -> Column:
    w, s, e, n = a["min_lng"], a["min_lat"], a["max_lng"], a["max_lat"]
    return haversine(w, s, w, n) + haversine(w, n, e, n) + haversine(e, s, e, n) + haversine(w, s, e, s)


def perimeter_increment(a: Column, b: Column) -> Column:
    """How much the perimeter of a grows when b is merged in."""
    return F.when(contains(a, b), F.lit(0.0)).otherwise(perimeter(union_box(a, b)) - perimeter(a))


def point_box_distance(a: Column, lng, lat) -> Column:
    """From a point to the nearest point of a box, which is the point clamped to it."""
    return haversine(lng, lat, F.greatest(F.least(d(lng), a["max_lng"]), a["min_lng"]), F.greatest(F.least(d(lat), a["max_lat"]), a["min_lat"]))


def box_distance(a: Column, b: Column) -> Column:
    """Between two boxes: over the gap, along the shorter edge of the shared stretch on an axis without one."""
    lng_a = F.when(b["max_lng"] < a["min_lng"], a["min_lng"]).when(b["min_lng"] > a["max_lng"], a["max_lng"])
    lng_b = F.when(b["max_lng"] < a["min_lng"], b["max_lng"]).when(b["min_lng"] > a["max_lng"], b["min_lng"])
    lat_a = F.when(b["max_lat"] < a["min_lat"], a["min_lat"]).when(b["min_lat"] > a["max_lat"], a["max_lat"])
    lat_b = F.when(b["max_lat"] < a["min_lat"], b["max_lat"]).when(b["min_lat"] > a["max_lat"], b["min_lat"])
    low_lng, high_lng = F.greatest(a["min_lng"], b["min_lng"]), F.least(a["max_lng"], b["max_lng"])
    low_lat, high_lat = F.greatest(a["min_lat"], b["min_lat"]), F.least(a["max_lat"], b["max_lat"])
    apart_x, apart_y = lng_a.isNotNull(), lat_a.isNotNull()
    return (
        F.when(apart_x & apart_y, haversine(lng_a, lat_a, lng_b, lat_b))
        .when(apart_x, F.least(haversine(lng_a, low_lat, lng_b, low_lat), haversine(lng_a, high_lat, lng_b, high_lat)))
        .when(apart_y, F.least(haversine(low_lng, lat_a, low_lng, lat_b), haversine(high_lng, lat_a, high_lng, lat_b)))
        .otherwise(F.lit(0.0))
    )


def in_region(lng, lat) -> Column:
    return d(lng).between(MIN_LNG, MAX_LNG) & d(lat).between(MIN_LAT, MAX_LAT)


def cell_row(lat) -> Column:
    """Rows count from the north edge."""
    return F.floor((F.lit(float(MAX_LAT)) - d(lat)) / STEP).cast("long")


def cell_col(lng) -> Column:
    return F.floor((d(lng) - float(MIN_LNG)) / STEP).cast("long")


def cell_box(row: Column, col: Column) -> Column:
    north, west = F.lit(float(MAX_LAT)) - row * STEP, F.lit(float(MIN_LNG)) + col * STEP
    return box(west, north - STEP, west + STEP, north)


def ring(row: Column, col: Column, k: int) -> Column:
    """Array of the grid cells at Chebyshev distance k, within the grid."""
    offsets = [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1) if max(abs(r), abs(c)) == k]
    cells = F.array(*(F.struct((row + F.lit(r)).cast("long").alias("row"), (col + F.lit(c)).cast("long").alias("col")) for r, c in offsets))
    return F.filter(cells, lambda x: x["row"].between(0, GRID_ROWS - 1) & x["col"].between(0, GRID_COLS - 1))


def rings(row: Column, col: Column, n: int) -> Column:
    """Array of ring, row, col of the grid cells in the first n rings."""

    def named(k: int) -> Column:
        return F.transform(ring(row, col, k), lambda c: F.struct(F.lit(k).alias("ring"), c["row"].alias("row"), c["col"].alias("col")))

    return F.flatten(F.array(*(named(k) for k in range(n))))


def cells_of_circle(lng, lat, radius_km) -> Column:
    """Array of the grid cells that the circle's box touches."""
    b = circle_box(lng, lat, radius_km)
    rows = F.sequence(cell_row(b["max_lat"]), cell_row(b["min_lat"]))
    cols = F.sequence(cell_col(b["min_lng"]), cell_col(b["max_lng"]))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def degrees_for(km: float, lat: float = max(abs(MIN_LAT), abs(MAX_LAT))) -> float:
    """An upper bound of the degrees of longitude or latitude that a distance spans in the region."""
    return math.degrees(km / (EARTH_RADIUS_KM * math.cos(math.radians(lat))))
