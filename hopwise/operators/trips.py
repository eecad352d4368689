"""Stays and trips from check-ins, the place dimension, seeds and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.functions.category import category_id
from hopwise.functions.geo import box, cell_col, cell_row, in_region
from hopwise.functions.noise import uniform
from hopwise.operators.numbering import least_rows, numbered


def collapse(rows: DataFrame, same: list[str], order: list[str], first: list[str] | None = None) -> DataFrame:
    """Merge neighbours of a trip that are equal in the columns same: first arrival, last leaving, first of first.

    Stays are numbered by seq from 0.
    """
    trip = W.partitionBy("trip_id").orderBy(*order)
    changed = F.lag(F.lit(1)).over(trip).isNull()
    for c in same:
        changed = changed | ~F.lag(c).over(trip).eqNullSafe(F.col(c))
    marked = rows.withColumn("__new", changed.cast("int")).withColumn("seq", (F.sum("__new").over(trip) - 1).cast("int"))
    firsts = [F.min_by(c, F.struct(*order)).alias(c) for c in first or []]
    return marked.groupBy("trip_id", "seq", *same).agg(F.min("arrive_ts").alias("arrive_ts"), F.max("leave_ts").alias("leave_ts"), *firsts)


def place_points(places: DataFrame) -> DataFrame:
    """poi_id, lng, lat, cell, categories (sorted array of code and category) of the places within the region.

    places: poi_id, category_code, lng, lat. Labels of a place are merged.
    """
    labels = F.struct(F.col("category_code").alias("code"), category_id(F.col("category_code")).alias("category_id"))
    return (
        places.filter(in_region("lng", "lat"))
        .groupBy("poi_id", "lng", "lat")
        .agg(F.array_sort(F.collect_set(labels)).alias("categories"))
        .select("poi_id", "lng", "lat", cell_row("lat").alias("cell_row"), cell_col("lng").alias("cell_col"), "categories")
    )


def point_dictionary(points: DataFrame, order: str) -> DataFrame:
    """point_id (dense from 1, by first occurrence), lng, lat of the distinct coordinates. order: a whole number."""
    distinct = points.groupBy("lng", "lat").agg(F.min(order).alias("first"))
    return numbered(distinct, "first", name="point_id", ties=("lng", "lat")).select(F.col("point_id").cast("long").alias("point_id"), "lng", "lat")


def stays(checkins: DataFrame, points: DataFrame, order: list[str]) -> DataFrame:
    """The stays of trips: trip_id, seq, point_id, lng, lat, arrive_ts, leave_ts, radius (0: exact)."""
    merged = collapse(checkins, ["point_id"], order)
    located = merged.join(points.select(F.col("poi_id").alias("point_id"), "lng", "lat"), "point_id")
    return located.select("trip_id", "seq", "point_id", "lng", "lat", "arrive_ts", "leave_ts", F.lit(0.0).alias("radius"))


def trips(of: DataFrame) -> DataFrame:
    """trip_id, t_start, t_end, n_stays, mbr of stays."""
    return (
        of.groupBy("trip_id")
        .agg(
            F.min("arrive_ts").alias("t_start"), F.max("leave_ts").alias("t_end"), F.count("*").alias("n_stays"),
            *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lng", "lat")),
        )
        .select("trip_id", "t_start", "t_end", "n_stays", box("min_lng", "min_lat", "max_lng", "max_lat").alias("mbr"))
    )


def first_stays(of: DataFrame) -> DataFrame:
    """The first stay of each trip."""
    return of.groupBy("trip_id").agg(F.min_by(F.struct(*(c for c in of.columns if c != "trip_id")), "seq").alias("s")).select("trip_id", "s.*")


def totals(of: DataFrame) -> DataFrame:
    """One row: n_trips, n_stays, stays_a_trip, n_starts (different times of arrival), last_end."""
    counted = of.agg(F.countDistinct("trip_id").alias("n_trips"), F.count("*").alias("n_stays"), F.countDistinct("arrive_ts").alias("n_starts"), F.max("leave_ts").alias("last_end"))
    return counted.select("n_trips", "n_stays", F.try_divide("n_stays", "n_trips").alias("stays_a_trip"), "n_starts", "last_end")


def first_trips(of: DataFrame, n: int) -> DataFrame:
    """The first n trips by start and end; all for n = 0. n is a setting: each task keeps that many rows."""
    ordered = of.orderBy("t_start", "t_end", "trip_id")
    return ordered.limit(n) if n else ordered


def sample_exactly(of: DataFrame, n: int, key: str) -> DataFrame:
    """n rows (all, if there are fewer), those with the smallest hashes of the column key."""
    hashed = of.withColumn("__u", (uniform(F.col(key)) * 2147483648).cast("long"))
    return least_rows(hashed, n, "__u", ties=(key,)).drop("__u")


def pool(of: DataFrame, seeds: DataFrame) -> DataFrame:
    """The trips that aren't seeds."""
    return of.join(seeds.select("trip_id"), "trip_id", "left_anti")
