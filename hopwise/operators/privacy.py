"""Perturbing trips: geo-, semantic and geo-semantic indistinguishability.

Random numbers are hashes of trip, stay and draw, so a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.functions import geo
from hopwise.functions.category import label_histogram, max_weight, place_weight
from hopwise.functions.noise import displaced, planar_laplace_radius, uniform
from hopwise.operators.numbering import numbered
from hopwise.operators.places import nearest, within
from hopwise.operators.trips import collapse

STAY = ("trip_id", "seq", "arrive_ts", "leave_ts")


def noisy_points(stays: DataFrame, epsilon: float, *, seed: int = 60, compat_angle: bool = False) -> DataFrame:
    """stays with noisy_lng, noisy_lat, noisy_radius by planar Laplace noise."""
    draw = lambda k: uniform(F.lit(seed), F.col("trip_id"), F.col("seq"), F.lit(k))
    with_noise = stays.withColumns({"__angle": 360 * draw(1), "__r": planar_laplace_radius(draw(2), epsilon)})
    lng, lat = displaced("lng", "lat", F.col("__angle"), F.col("__r"), compat_angle)
    return with_noise.withColumns({"noisy_lng": lng, "noisy_lat": lat, "noisy_radius": F.col("__r")}).drop("__angle", "__r")


def as_trips(noisy: DataFrame) -> DataFrame:
    """Stays of noisy trips; neighbours at the same noisy place are merged and keep the first radius."""
    rows = noisy.select("trip_id", F.col("seq").alias("__seq"), F.col("noisy_lng").alias("lng"), F.col("noisy_lat").alias("lat"), "arrive_ts", "leave_ts", F.col("noisy_radius").alias("radius"), F.col("point_id").alias("orig_point_id"))
    merged = collapse(rows, ["lng", "lat"], ["__seq"], first=["radius", "orig_point_id"])
    return merged.select("trip_id", "seq", "lng", "lat", "arrive_ts", "leave_ts", "radius", "orig_point_id")


def snapped(noisy: DataFrame, pois: DataFrame) -> DataFrame:
    """noisy points moved to the nearest place of the cells around them, noisy_poi_id; where there is none they stay."""
    asked = noisy.select("trip_id", "seq", F.struct("trip_id", "seq").alias("__key"), F.col("noisy_lng").alias("lng"), F.col("noisy_lat").alias("lat"))
    found = nearest(asked.select("__key", "lng", "lat"), pois, "__key").select("__key.trip_id", "__key.seq", "poi_id")
    at = found.join(pois.select("poi_id", F.col("lng").alias("__x"), F.col("lat").alias("__y")), "poi_id").withColumnRenamed("poi_id", "noisy_poi_id")
    joined = noisy.join(at, ["trip_id", "seq"], "left")
    moved = {"noisy_lng": F.coalesce(F.col("__x").cast("double"), "noisy_lng"), "noisy_lat": F.coalesce(F.col("__y").cast("double"), "noisy_lat")}
    return joined.withColumns(moved).drop("__x", "__y")


def geo_ind(stays: DataFrame, epsilon: float, *, seed: int = 60, compat_angle: bool = False) -> DataFrame:
    return as_trips(noisy_points(stays, epsilon, seed=seed, compat_angle=compat_angle))


def geo_semantic_points(stays: DataFrame, pois: DataFrame, distributions: DataFrame, epsilon_geo: float, epsilon_semantic: float, *, seed: int = 60, uniform_weights: bool = False, growth_steps: int = 12) -> DataFrame:
    """stays with a noisy place sampled, by unlikeness to the original, among the places in the disc of geo noise.

    The disc grows by half its radius until it has a place, growth_steps times at most; without one the
    noisy point itself stays, and noisy_poi_id is null, by which such stays can be counted. distributions: point_id and distribution of the original places. uniform_weights: all
    places in the disc weigh the same.
    """
    noisy = noisy_points(stays, epsilon_geo, seed=seed).join(distributions.select("point_id", "distribution"), "point_id", "left")
    asked = noisy.select("trip_id", "seq", F.col("noisy_lng").alias("lng"), F.col("noisy_lat").alias("lat"), (F.col("noisy_radius") * (1 + 0.5 * growth_steps)).alias("radius"), F.col("noisy_radius").alias("r0"), F.col("distribution").alias("original"))
    near = within(asked, pois, keys=("trip_id", "seq", "r0", "original"))
    step = F.greatest(F.lit(0), F.ceil((F.col("dist") / F.col("r0") - 1) * 2 - 1e-12)).cast("int")
    stay = W.partitionBy("trip_id", "seq")
    weight = F.lit(1.0) if uniform_weights else place_weight(label_histogram(F.col("categories.category_id")), F.col("original"), epsilon_semantic)
    candidates = near.withColumn("step", step).withColumn("least", F.min("step").over(stay)).filter("step = least").withColumn("weight", F.round(weight, 9))
    order = stay.orderBy("weight", "poi_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    u = uniform(F.lit(seed), F.col("trip_id"), F.col("seq"), F.lit(3))
    picked = (
        candidates.withColumns({"upto": F.sum("weight").over(order), "all": F.sum("weight").over(stay)})
        .filter(u * F.col("all") < F.col("upto"))
        .groupBy("trip_id", "seq")
        .agg(F.min_by("poi_id", F.struct("weight", "poi_id")).alias("poi_id"))
        .join(pois.select("poi_id", F.col("lng").alias("poi_lng"), F.col("lat").alias("poi_lat")), "poi_id")
    )
    joined = noisy.join(picked, ["trip_id", "seq"], "left")
    radius = F.greatest(geo.haversine("noisy_lng", "noisy_lat", "poi_lng", "poi_lat"), geo.haversine("lng", "lat", "poi_lng", "poi_lat"))
    has = F.col("poi_lng").isNotNull()
    return joined.withColumnRenamed("poi_id", "noisy_poi_id").withColumns({
        "noisy_radius": F.when(has, radius).otherwise(F.col("noisy_radius")),
        "noisy_lng": F.when(has, F.col("poi_lng").cast("double")).otherwise(F.col("noisy_lng")),
        "noisy_lat": F.when(has, F.col("poi_lat").cast("double")).otherwise(F.col("noisy_lat")),
    })


def label_classes(pois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, classes): poi_id, lng, lat, labels, nth (from 0 in its class); labels, class_no, histogram, members.

    A class holds the places of the same categories. There are as many as ways in which places are labelled.
    """
    ids = F.array_sort(F.filter(F.col("categories.category_id"), lambda x: x.isNotNull()))
    labelled = pois.withColumn("labels", F.array_join(ids.cast("array<string>"), ",")).filter("labels <> ''")
    places = numbered(labelled.select("poi_id", "lng", "lat", "labels"), "poi_id", name="nth", keys=("labels",)).withColumn("nth", F.col("nth") - 1)
    classes = labelled.groupBy("labels").agg(F.any_value("categories").alias("c"), F.count("*").alias("members"))
    number = F.row_number().over(W.orderBy("labels")).cast("long")
    return places, classes.select("labels", number.alias("class_no"), label_histogram(F.col("c.category_id")).alias("histogram"), F.array_distinct("c.category_id").alias("ids"), "members")


def semantic_points(stays: DataFrame, pois: DataFrame, distributions: DataFrame, epsilon: float, *, seed: int = 60) -> DataFrame:
    """stays with a noisy place sampled from all places, noisy_poi_id.

    Places are visited category by category, by rising share in the original distribution, each once; the
    first is taken whose draw is at or above its weight's place between 1 and the largest possible. If none
    is, a uniform draw decides. Places of one class, the same categories, have the same weight, so a class's visit is
    one draw: it tells whether, and at which of its places, the first is taken, as single draws would. So
    neither stays nor places are crossed with places.
    """
    n, top = pois.count(), max_weight(epsilon)
    places, classes = label_classes(pois)
    shares = distributions.select("point_id", "distribution")
    turn = F.array_min(F.transform(F.filter("ids", lambda k: k.isNotNull()), lambda k: F.struct(F.get("distribution", k).alias("share"), k.alias("category"))))
    bar = F.round((place_weight(F.col("histogram"), F.col("distribution"), epsilon) - 1) / (top - 1), 9)
    visit = F.struct(turn.alias("turn"), "class_no", "labels", "members", bar.alias("bar"))
    known = classes.agg(F.collect_list(F.struct("labels", "class_no", "histogram", "ids", "members")).alias("known"))
    orders = shares.crossJoin(F.broadcast(known)).select("point_id", "distribution", F.explode("known").alias("k")).select("point_id", "distribution", "k.*")
    visits = orders.groupBy("point_id").agg(F.sort_array(F.collect_list(visit)).alias("visits"))
    draw = lambda *more: uniform(F.lit(seed), F.col("trip_id"), F.col("seq"), *more)
    nth = lambda u, v: F.when(v["bar"] <= 0, F.lit(0)).otherwise(F.floor(F.try_divide(F.log(1 - u), F.log(v["bar"]))))
    tried = F.transform("visits", lambda v: F.struct(v["labels"].alias("labels"), nth(draw(F.lit(4), v["class_no"]), v).cast("long").alias("nth"), v["members"].alias("members"), v["bar"].alias("bar")))
    taken = F.get(F.filter(tried, lambda v: (v["bar"] < 1) & (v["nth"] < v["members"])), F.lit(0))
    fallback = (F.floor(draw(F.lit(5)) * n) + 1).cast("long")
    chosen = stays.join(visits, "point_id", "left").withColumn("__v", taken).withColumn("__number", F.when(F.col("__v").isNull(), fallback)).drop("visits")
    place = [F.col("poi_id").alias("noisy_poi_id"), F.col("lng").alias("__x"), F.col("lat").alias("__y")]
    of_class = places.select("labels", "nth", *place)
    in_class = chosen.join(of_class, (F.col("__v.labels") == of_class["labels"]) & (F.col("__v.nth") == of_class["nth"])).drop("labels", "nth")
    every = numbered(pois.select("poi_id", "lng", "lat"), "poi_id", name="__at").select("__at", *place)
    anywhere = chosen.join(every, F.col("__number") == F.col("__at")).drop("__at")
    return in_class.unionByName(anywhere).select(
        *stays.columns, "noisy_poi_id", F.col("__x").cast("double").alias("noisy_lng"), F.col("__y").cast("double").alias("noisy_lat"), geo.haversine("lng", "lat", "__x", "__y").alias("noisy_radius")
    )


def points(model: str, stays: DataFrame, pois: DataFrame, distributions: DataFrame, epsilon_geo: float, epsilon_semantic: float, *, seed: int = 60) -> DataFrame:
    """stays with noisy_lng, noisy_lat, noisy_radius by the model's name (and noisy_poi_id, where places are drawn)."""
    if model == "geo":
        return noisy_points(stays, epsilon_geo, seed=seed)
    if model == "semantic":
        return semantic_points(stays, pois, distributions, epsilon_semantic, seed=seed)
    if model in ("geosemantic", "GS"):
        return geo_semantic_points(stays, pois, distributions, epsilon_geo, epsilon_semantic, seed=seed)
    raise ValueError(f"{model}: no such privacy model")


def perturb(model: str, stays: DataFrame, pois: DataFrame, distributions: DataFrame, epsilon_geo: float, epsilon_semantic: float, *, seed: int = 60) -> DataFrame:
    """Noisy trips by the model's name; the stays as they are for ground truth."""
    if model not in ("geo", "semantic", "geosemantic", "GS"):
        return stays
    return as_trips(points(model, stays, pois, distributions, epsilon_geo, epsilon_semantic, seed=seed))
