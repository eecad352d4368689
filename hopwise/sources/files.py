"""Readers for place and check-in files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.operators.numbering import numbered
from hopwise.operators.trips import point_dictionary
from hopwise.plans.config import TracingConfig, parse_config
from hopwise.plans.lineage import cut

POI_FILE = "name string, category_code string, address string, unnamed string, lng float, lat float"
CHECKIN_FILE = (
    "seq_id string, poi_id long, start_timestamp long, end_timestamp long, start_time string, end_time string, "
    "travel_time_s string, travel_time_min string, duration_s string, duration_min string"
)


def read_config(spark: SparkSession, path: str) -> TracingConfig:
    lines = spark.read.text(path, wholetext=True).first()
    return parse_config(lines[0] if lines else "")


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """poi_id, category_code, lng, lat, row_no (file order) of a place file with a header; poi_id numbers coordinates by first occurrence."""
    read = spark.read.schema(POI_FILE).option("header", True).csv(path).filter("lng is not null and lat is not null")
    rows = cut(read.select("category_code", "lng", "lat", F.monotonically_increasing_id().alias("row_no")))
    return rows.join(point_dictionary(rows, "row_no").withColumnRenamed("point_id", "poi_id"), ["lng", "lat"]).select("poi_id", "category_code", "lng", "lat", "row_no")


def read_checkins(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """seq_id, trip_id, point_id, arrive_ts, leave_ts, row_no of a check-in file with a header; points are poi_id of read_pois().

    trip_id numbers the sequences by their first row. first: only so many sequences; all for 0.
    """
    read = spark.read.schema(CHECKIN_FILE).option("header", True).csv(path).filter("seq_id is not null and poi_id is not null")
    rows = cut(
        read.select(
            "seq_id", F.col("poi_id").alias("point_id"), F.col("start_timestamp").alias("arrive_ts"), F.col("end_timestamp").alias("leave_ts"), F.monotonically_increasing_id().alias("row_no")
        )
    )
    sequences = numbered(rows.groupBy("seq_id").agg(F.min("row_no").alias("at")), "at", name="trip_id")
    some = sequences.filter(F.col("trip_id") <= first) if first else sequences
    return rows.join(some.select("seq_id", "trip_id"), "seq_id").select("seq_id", "trip_id", "point_id", "arrive_ts", "leave_ts", "row_no")


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trip_id string, ts long, lng float, lat float").option("header", True).csv(path)
