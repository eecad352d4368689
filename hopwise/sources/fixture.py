"""Trips and places derived from the events table, for queries without files of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_POIS = 400
SEED_EVERY = 50
#: Places come in sites of ten, some 100 m apart; the last two sites reach over the region's eastern edge.
SITE, SITES, EDGE_SITES = 10, 40, 2
#: One code for each category.
CODES = ("1000", "2100", "7200", "4000", "5000", "7000", "7400", "9200", "7600", "7700", "7800", "9800", "8000", "A100", "A700", "AA00", "A982")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, point_id, arrive_ts, leave_ts of all events, before equal neighbours are merged."""
    k = F.regexp_extract("props", r'"k"\s*:\s*([0-9]+)', 1).try_cast("long")
    visits = (
        events(spark, sf_dir)
        .filter(k.isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull())
        .select(F.col("user_id").alias("trip_id"), ((k + 100 * F.floor("value")) % N_POIS + 1).alias("point_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("arrive_ts"), "ts", "event_id")
    )
    following = F.lead("arrive_ts").over(W.partitionBy("trip_id").orderBy("ts", "event_id"))
    left = F.least(F.coalesce(following, F.col("arrive_ts") + 600), F.col("arrive_ts") + 7200)
    return visits.withColumn("leave_ts", left).filter("leave_ts > arrive_ts")


def site_origin(site: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a site's first place."""
    lng = F.when(site < SITES - EDGE_SITES, F.lit(115.0) + F.lit(0.037) * site).otherwise(F.lit(118.9965))
    return lng, F.lit(39.9) + F.lit(0.0113) * site


def places(spark: SparkSession) -> DataFrame:
    """poi_id, category_code, lng, lat, row_no: raw labelled places; some have two labels."""
    place = F.col("poi_id") - 1
    lng, lat = site_origin(F.expr(f"(poi_id - 1) div {SITE}"))
    lng, lat = lng + F.lit(0.001) * (place % 5), lat + F.lit(0.001) * F.floor(place % SITE / 5)
    codes = F.array(*(F.lit(c) for c in CODES))
    code = lambda n: F.get(codes, (n % len(CODES)).cast("int"))
    one = spark.range(1, N_POIS + 1).select(F.col("id").alias("poi_id"))
    raw = one.withColumn("category_code", code(F.col("poi_id"))).withColumn("row_no", 2 * F.col("poi_id"))
    more = one.filter("poi_id % 5 = 0").withColumn("category_code", code(F.col("poi_id") + 7)).withColumn("row_no", 2 * F.col("poi_id") + 1)
    return raw.union(more).select("poi_id", "category_code", lng.cast("float").alias("lng"), lat.cast("float").alias("lat"), "row_no")


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, ts, lng, lat, event_id: positions around the user's site; every fifth user's are a cell and more beside it."""
    lng, lat = site_origin(F.col("user_id") % SITES)
    lng = lng + F.lit(0.0001) * (F.floor("value") % 30) + F.when(F.col("user_id") % 5 == 0, F.lit(-0.016)).otherwise(F.lit(0.0))
    lat = lat + F.lit(0.0001) * (F.floor(F.col("value") * 10) % 20)
    rows = events(spark, sf_dir).filter("value is not null and user_id is not null")
    return rows.select(F.col("user_id").alias("trip_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), lng.cast("float").alias("lng"), lat.cast("float").alias("lat"), "event_id")
