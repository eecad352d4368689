"""Registered queries of the tracing engine; their SQL equivalents are in hopwise.oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.functions import category as K
from hopwise.functions import geo
from hopwise.functions import text as X
from hopwise.functions.noise import planar_laplace_radius, uniform
from hopwise.functions.probability import correlated_probability, independent_probability
from hopwise.operators import contacts as C
from hopwise import run
from hopwise.operators import multihop, places, privacy, sinks, staypoints, trips
from hopwise.oracles import ORACLES  # noqa: F401
from hopwise.plans.config import TracingConfig, parse_config
from hopwise.sources import fixture

MIN_DURATION = 600
HOPS = 5
EPSILON = 4.0
RADIUS_KM = 0.12
MIN_PROB = 0.05

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def the_pois(spark: SparkSession) -> DataFrame:
    return trips.place_points(fixture.places(spark))


def the_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.stays(fixture.checkins(spark, sf_dir), the_pois(spark), ["arrive_ts", "event_id"])


def the_seeds(of: DataFrame) -> DataFrame:
    return of.filter(f"trip_id % {fixture.SEED_EVERY} = 0").select("trip_id").distinct()


def the_distributions(spark: SparkSession) -> DataFrame:
    """point_id, distribution of the places around each place."""
    return run.place_distributions(the_pois(spark), rings=2)


def split_sides(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Susceptible stays, and the seeds' stays over their whole trips."""
    seeds = the_seeds(of)
    spreading = of.join(seeds, "trip_id", "left_semi")
    ranges = trips.trips(spreading).select("trip_id", F.col("t_start").alias("valid_start"), F.col("t_end").alias("valid_end"))
    return of.join(seeds, "trip_id", "left_anti"), C.infectious(spreading, ranges)


@query
def stays_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(the_stays(spark, sf_dir), "lng", "lat").drop("radius")


@query
def trip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trips.trips(the_stays(spark, sf_dir)).select("trip_id", "t_start", "t_end", "n_stays", "mbr.*"), "min_lng", "min_lat", "max_lng", "max_lat")


@query
def poi_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.concat_ws("|", F.transform("categories", lambda c: F.concat_ws(":", c["code"], c["category_id"].cast("string"))))
    return rounded(the_pois(spark), "lng", "lat").withColumn("categories", labels)


@query
def point_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trips.point_dictionary(fixture.gps_points(spark, sf_dir), "event_id"), "lng", "lat")


@query
def poi_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = [*fixture.CODES, "808A", "808B", "8081", "9800", "2800", "2801", "A983", "ZZZZ"]
    return spark.createDataFrame([(c,) for c in codes], "code string").select("code", K.category_id(F.col("code")).alias("category_id"))


@query
def category_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many prefixes a category has, and how many places carry it."""
    dim = K.category_dim(spark).groupBy("category_id").agg(F.count("*").alias("n_prefixes"))
    carried = the_pois(spark).select("poi_id", F.explode("categories").alias("c")).groupBy(F.col("c.category_id").alias("category_id")).agg(F.countDistinct("poi_id").alias("n_places"))
    return dim.join(carried, "category_id", "left").select("category_id", "n_prefixes", F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places"))


@query
def first_n_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.first_trips(trips.trips(the_stays(spark, sf_dir)), 20).select("trip_id", "t_start", "t_end")


@query
def seed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_trips = trips.trips(the_stays(spark, sf_dir))
    return trips.sample_exactly(all_trips.select("trip_id"), int(all_trips.count() * 0.1), "trip_id")


@query
def susceptible_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = the_stays(spark, sf_dir)
    return trips.pool(trips.trips(of).select("trip_id", "n_stays"), the_seeds(of))


@query
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from each stay to the next."""
    before = C.with_previous(the_stays(spark, sf_dir)).filter("prev_lng is not null")
    return before.select("trip_id", "seq", F.round(geo.haversine("prev_lng", "prev_lat", "lng", "lat"), 5).alias("dist_km"))


@query
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = the_pois(spark)
    cells = pois.select("poi_id", "cell_row", "cell_col", (F.col("cell_row") * geo.GRID_COLS + F.col("cell_col")).alias("cell_id"), geo.in_region("lng", "lat").alias("covered"), geo.cell_box(F.col("cell_row"), F.col("cell_col")).alias("b"))
    return rounded(cells.select("poi_id", "cell_row", "cell_col", "cell_id", "covered", "b.*"), "min_lng", "min_lat", "max_lng", "max_lat")


@query
def circle_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = the_pois(spark).select("poi_id", geo.circle_box("lng", "lat", F.col("poi_id") % 4 * 0.25).alias("b"))
    return rounded(boxes.select("poi_id", "b.*"), "min_lng", "min_lat", "max_lng", "max_lat")


def neighbour_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a and b: the boxes of trips n and n + 1."""
    of = trips.trips(the_stays(spark, sf_dir)).select("trip_id", "mbr")
    return of.select("trip_id", F.col("mbr").alias("a")).join(of.select((F.col("trip_id") - 1).alias("trip_id"), F.col("mbr").alias("b")), "trip_id")


@query
def bbox_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return neighbour_boxes(spark, sf_dir).select(
        "trip_id", geo.contains(a, b).alias("contains"), geo.inside(a, b).alias("inside"), (~geo.inside(a, b)).alias("not_inside"), geo.intersects(a, b).alias("intersects"),
        geo.contains_point(a, F.lit(116.3045), F.lit(39.9025)).alias("has_point"), geo.circle_state(a, F.lit(116.3045), F.lit(39.9025), F.lit(0.3)).alias("circle_state"),
    )


@query
def point_box_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = geo.point_box_distance(F.col("a"), F.lit(116.0) + F.col("trip_id") % 7 * 0.1, F.lit(39.8) + F.col("trip_id") % 5 * 0.05)
    return neighbour_boxes(spark, sf_dir).select("trip_id", F.round(away, 4).alias("dist_km"))


@query
def box_box_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between a trip's box and the next one's, moved by up to two steps of 0.02 degrees."""
    east, north = F.col("trip_id") % 3 * 0.02, F.col("trip_id") % 2 * 0.02
    moved = geo.box(F.col("b.min_lng") + east, F.col("b.min_lat") + north, F.col("b.max_lng") + east, F.col("b.max_lat") + north)
    return neighbour_boxes(spark, sf_dir).withColumn("m", moved).select("trip_id", F.round(geo.box_distance(F.col("a"), F.col("m")), 4).alias("dist_km"))


@query
def box_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return neighbour_boxes(spark, sf_dir).select("trip_id", F.round(geo.perimeter(a), 4).alias("perimeter_km"), F.round(geo.perimeter_increment(a, b), 4).alias("increment_km"))


@query
def ring_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = the_pois(spark)
    rings = geo.rings(F.col("cell_row"), F.col("cell_col"), 3)
    return pois.select("poi_id", F.explode(rings).alias("c")).select("poi_id", "c.*")


@query
def pois_in_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = the_pois(spark)
    asked = pois.select(F.col("poi_id").alias("point_key"), "lng", "lat", F.lit(0.25).alias("radius"))
    return places.within(asked, pois).select("point_key", "poi_id", F.round("dist", 5).alias("dist_km"))


def gps_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.point_dictionary(fixture.gps_points(spark, sf_dir), "event_id")


@query
def nearest_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places.nearest(gps_coordinates(spark, sf_dir), the_pois(spark), "point_id")
    return found.select("point_id", "poi_id", F.round("dist", 5).alias("dist_km"), "ring")


@query
def knn_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places.k_nearest(gps_coordinates(spark, sf_dir), the_pois(spark), "point_id", k=5, max_km=0.5, rings=2)
    return found.select("point_id", "rank", "poi_id", F.round("dist", 5).alias("dist_km"))


@query
def trip_prefilter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = the_stays(spark, sf_dir)
    everyone, seeds = trips.trips(of), the_seeds(of)
    return places.trip_pairs(trips.pool(everyone, seeds), everyone.join(seeds, "trip_id", "left_semi"), 0.1)


@query
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = split_sides(the_stays(spark, sf_dir))
    return C.overlapping(q, p, C.bin_width(MIN_DURATION, 7200)).groupBy("q_trip", "i").agg(F.count("*").alias("n_overlaps"), F.sum("overlap_s").alias("overlap_s"))


@query
def long_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays that share an hour at least."""
    q, p = split_sides(the_stays(spark, sf_dir))
    return C.overlapping(q, p, C.bin_width(MIN_DURATION, 7200), least_s=3600).select("q_trip", "i", "p_trip", "j", "overlap_s")


@query
def neighbouring_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first stays of trips n and n + 1 meet in time, and whether for ten minutes."""
    of = trips.first_stays(the_stays(spark, sf_dir)).select("trip_id", "arrive_ts", "leave_ts")
    other = of.select((F.col("trip_id") - 1).alias("trip_id"), F.col("arrive_ts").alias("a2"), F.col("leave_ts").alias("l2"))
    span = [F.col(c) for c in ("arrive_ts", "leave_ts", "a2", "l2")]
    return of.join(other, "trip_id").select("trip_id", C.spans_overlap(*span).alias("meet"), C.spans_overlap(*span, least_s=600).alias("long"))


def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(*split_sides(the_stays(spark, sf_dir)), min_duration=MIN_DURATION, exact=True)


@query
def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_pairs(spark, sf_dir).select("q_trip", "i", "p_trip", "j", "start_ts", "end_ts")


@query
def contact_pairs_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = C.pairs(*split_sides(the_stays(spark, sf_dir)), d_km=RADIUS_KM, min_duration=MIN_DURATION)
    return met.select("q_trip", "i", "p_trip", "j", "start_ts", "end_ts", F.round("dist", 5).alias("dist_km"))


@query
def contact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = C.pairs(*split_sides(the_stays(spark, sf_dir)), d_km=RADIUS_KM, min_duration=MIN_DURATION)
    return C.runs(met).groupBy("q_trip", "p_trip", "run").agg(F.min("run_start").alias("run_start"), F.max("cum").alias("duration_s"), F.count("*").alias("n_pairs"))


@query
def direct_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.contacts(C.events(C.runs(exact_pairs(spark, sf_dir)), MIN_DURATION))
    return found.select("susceptible_id", "spreader_id", "cst")


def exact_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = the_stays(spark, sf_dir)
    return multihop.trace(of, the_seeds(of), hops=HOPS, min_duration=MIN_DURATION)


@query
def multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_trace(spark, sf_dir).select("susceptible_id", "spreader_id", "cst", "hop")


@query
def contacts_per_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop.per_hop(exact_trace(spark, sf_dir))


@query
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = the_distributions(spark)
    return wide.select("point_id", F.posexplode("distribution").alias("category_id", "share")).select("point_id", "category_id", F.round("share", 6).alias("share"))


@query
def category_distribution_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = the_pois(spark)
    near = places.k_nearest(pois.select(F.col("poi_id").alias("point_id"), "lng", "lat"), pois, "point_id", rings=2)
    wide = places.distributions(near, "point_id", by_distance=True)
    return wide.select("point_id", F.posexplode("distribution").alias("category_id", "share")).select("point_id", "category_id", F.round("share", 5).alias("share"))


@query
def distribution_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.transform("distribution", lambda x: F.round(x, 9))
    return the_distributions(spark).select("point_id", K.distribution_label(exact).alias("label"))


def label_pairs(spark: SparkSession) -> DataFrame:
    """Places within 0.25 km of one another, with both label histograms."""
    pois = the_pois(spark)
    asked = pois.select(F.col("poi_id").alias("point_key"), "lng", "lat", F.lit(0.25).alias("radius"), K.label_histogram(F.col("categories.category_id")).alias("a"))
    near = places.within(asked, pois, keys=("point_key", "a"))
    return near.withColumn("b", K.label_histogram(F.col("categories.category_id")))


@query
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_pairs(spark).select("point_key", "poi_id", F.round(K.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query
def poi_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_pairs(spark).select("point_key", "poi_id", F.round(K.place_weight(F.col("b"), F.col("a"), EPSILON), 6).alias("weight"))


@query
def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = the_stays(spark, sf_dir)
    return of.select("trip_id", "seq", F.round(uniform(F.lit(60), F.col("trip_id"), F.col("seq"), F.lit(1)), 9).alias("u"))


@query
def planar_laplace_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uniform(F.lit(60), F.col("trip_id"), F.col("seq"), F.lit(2))
    return the_stays(spark, sf_dir).select("trip_id", "seq", F.round(planar_laplace_radius(u, EPSILON), 6).alias("radius_km"))


def susceptible_stays(of: DataFrame) -> DataFrame:
    return of.join(the_seeds(of), "trip_id", "left_anti")


@query
def geo_ind_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = privacy.geo_ind(susceptible_stays(the_stays(spark, sf_dir)), EPSILON)
    return rounded(noisy, "lng", "lat", "radius")


@query
def geo_ind_trips_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the angle's number taken for radians and signs by its quadrant."""
    noisy = privacy.geo_ind(susceptible_stays(the_stays(spark, sf_dir)), EPSILON, compat_angle=True)
    return rounded(noisy, "lng", "lat", "radius")


@query
def semantic_ind_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = privacy.semantic_points(susceptible_stays(the_stays(spark, sf_dir)), the_pois(spark), the_distributions(spark), EPSILON)
    return rounded(privacy.as_trips(points), "lng", "lat").withColumn("radius", F.round("radius", 5))


@query
def geosemantic_ind_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = privacy.geo_semantic_points(susceptible_stays(the_stays(spark, sf_dir)), the_pois(spark), the_distributions(spark), EPSILON, EPSILON)
    return rounded(privacy.as_trips(points), "lng", "lat").withColumn("radius", F.round("radius", 5))


def probability_cases(spark: SparkSession) -> DataFrame:
    """Distances, radii and contact ranges in all relations to one another."""
    k = F.col("id")
    return spark.range(200).select(k.alias("case_id"), (k % 10 * 0.07 + 0.01).alias("dist"), (k % 7 * 0.1 + 0.05).alias("radius"), (k % 4 * 0.12 + 0.02).alias("delta"), (k % 9 * 0.05 + 0.02).alias("p_prev"), (k % 6 * 0.08 + 0.03).alias("q_prev"))


@query
def contact_prob_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_cases(spark).select("case_id", F.round(independent_probability(F.col("dist"), F.col("radius"), F.col("delta")), 5).alias("probability"))


@query
def contact_prob_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_cases(spark).select("case_id", F.round(correlated_probability("dist", "p_prev", "q_prev", "radius", "delta"), 6).alias("probability"))


def private_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy susceptible stays that meet exact seeds' stays, with the probability of contact."""
    of = the_stays(spark, sf_dir)
    _, p = split_sides(of)
    noisy = C.with_previous(privacy.geo_ind(susceptible_stays(of), EPSILON))
    return C.with_probability(C.pairs(noisy, p, d_km=RADIUS_KM, tolerance_km=run.PRIVATE_TOLERANCE_KM, min_duration=MIN_DURATION), RADIUS_KM)


@query
def pair_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_pairs(spark, sf_dir).select("q_trip", "i", "p_trip", "j", F.round("prob", 4).alias("probability"))


@query
def aggregated_contact_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.contacts(C.events(C.runs(private_pairs(spark, sf_dir)), MIN_DURATION), min_prob=1e-12)
    return found.select("susceptible_id", F.round("probability", 4).alias("probability"))


@query
def probabilistic_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.contacts(C.events(C.runs(private_pairs(spark, sf_dir)), MIN_DURATION), min_prob=MIN_PROB)
    return found.select("susceptible_id", "spreader_id", "cst", F.round("probability", 4).alias("probability"))


def private_trace(spark: SparkSession, sf_dir: str, config: TracingConfig, digits: int | None = None) -> DataFrame:
    of = the_stays(spark, sf_dir)
    return run.traced(config, of, the_seeds(of), the_pois(spark), the_distributions(spark), digits)


GEO_RUN = parse_config(f"""# a geo-indistinguishable run
privacy_model = geo
multi_hop = {HOPS}
identical_poi_dist_max = 0
contact_min_duration = {MIN_DURATION}
""")


@query
def private_multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_trace(spark, sf_dir, GEO_RUN)
    return found.select("susceptible_id", "spreader_id", "cst", "hop")


@query
def semantic_multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_trace(spark, sf_dir, replace(GEO_RUN, privacy_model="semantic")).select("susceptible_id", "spreader_id", "cst", "hop")


@query
def geosemantic_multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_trace(spark, sf_dir, replace(GEO_RUN, privacy_model="geosemantic")).select("susceptible_id", "spreader_id", "cst", "hop")


@query
def interval_search_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact run with stays joined by time alone."""
    return private_trace(spark, sf_dir, replace(GEO_RUN, privacy_model="ground_truth", search_type="interval", multi_hop=2)).select("susceptible_id", "spreader_id", "cst", "hop")


PROBABLE_RUN = replace(GEO_RUN, multi_hop=2, identical_poi_dist_max=RADIUS_KM, contact_min_prob=MIN_PROB)


def probable(found: DataFrame) -> DataFrame:
    return found.select("susceptible_id", "spreader_id", "cst", "hop", F.round("probability", 4).alias("probability"))


@query
def probabilistic_multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probable(private_trace(spark, sf_dir, PROBABLE_RUN, digits=4))


@query
def correlated_multi_hop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probable(private_trace(spark, sf_dir, replace(PROBABLE_RUN, independent_contact_prob=False), digits=4))


@query
def contact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multihop.agreement(private_trace(spark, sf_dir, GEO_RUN), exact_trace(spark, sf_dir))
    return rounded(found, "precision", "recall")


@query
def stay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(staypoints.stay_points(fixture.gps_points(spark, sf_dir)), "lng", "lat")


@query
def date_to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy.MM.dd HH:mm:ss")
    return fixture.events(spark, sf_dir).select("event_id", X.epoch_of(text).alias("epoch_s"))


@query
def day_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = trips.trips(the_stays(spark, sf_dir))
    return spans.select("trip_id", X.day_gap(F.col("t_end"), F.col("t_start")).alias("days"), X.day_gap(F.col("t_end") + 40_000_000, F.col("t_start")).alias("days_on"))


@query
def float_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(300).select("id", (F.col("id") / 8).alias("v"))
    return rows.select("id", X.float_tag(F.col("v")).alias("tag"))


@query
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = fixture.events(spark, sf_dir).select("event_id", X.tokens(F.concat_ws(",", "event_type", F.lit(""), "props"), ",").alias("t"))
    return props.select("event_id", F.size("t").cast("long").alias("n_tokens"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))


@query
def contact_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.contact_lines(exact_trace(spark, sf_dir), multi_hop=True, with_probability=False)


@query
def probability_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with a probability, rounded so that engines agree on its sixth digit."""
    found = private_trace(spark, sf_dir, PROBABLE_RUN, digits=4).withColumn("probability", F.round("probability", 4))
    return sinks.contact_lines(found, multi_hop=True, with_probability=True)


@query
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(240).select("id", (F.col("id") * F.pow(F.lit(10.0), F.col("id") % 12 - 8) / 7).alias("v"))
    return rows.select("id", sinks.number_text(F.col("v")).alias("text"))


@query
def noisy_trip_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    distributions = the_distributions(spark)
    points = privacy.semantic_points(susceptible_stays(the_stays(spark, sf_dir)), the_pois(spark), distributions, EPSILON)
    return sinks.noisy_trip_lines(run.noisy_trip_rows(points.withColumn("noisy_radius", F.round("noisy_radius", 5)), distributions))


@query
def noisy_trip_export_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy points that are no places have no distribution; coordinates rounded so that engines agree."""
    points = privacy.noisy_points(susceptible_stays(the_stays(spark, sf_dir)), EPSILON)
    return sinks.noisy_trip_lines(run.noisy_trip_rows(rounded(points, "noisy_lng", "noisy_lat", "noisy_radius"), None))


@query
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = privacy.snapped(privacy.noisy_points(susceptible_stays(the_stays(spark, sf_dir)), EPSILON), the_pois(spark))
    return rounded(noisy.select("trip_id", "seq", "noisy_poi_id", "noisy_lng", "noisy_lat"), "noisy_lng", "noisy_lat")


@query
def first_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.first_stays(the_stays(spark, sf_dir)).select("trip_id", "seq", "point_id", "arrive_ts", "leave_ts")


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trips.totals(the_stays(spark, sf_dir)), "stays_a_trip")


@query
def place_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.place_categories(the_pois(spark))


@query
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.codes_by_category(the_pois(spark)).select("category_id", F.array_join("codes", ",").alias("codes"), "n_places")


@query
def equal_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the labels of a place and of the one 17 after it have the same distribution; false for the last, which have none."""
    own = the_pois(spark).select("poi_id", K.label_histogram(F.col("categories.category_id")).alias("a"))
    other = own.select((F.col("poi_id") - 17).alias("poi_id"), F.col("a").alias("b"))
    return own.join(other, "poi_id", "left").select("poi_id", K.equal_distributions(F.col("a"), F.col("b")).alias("equal"))


@query
def point_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_pois(spark).select("poi_id", sinks.point_text("lng", "lat").alias("text"))


@query
def trip_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = the_stays(spark, sf_dir).filter("seq % 40 < 3 or seq % 40 = 20").withColumn("trip_id", F.col("trip_id") * 1000 + F.floor(F.col("seq") / 20))
    pieces = trips.trips(of)
    seeds = F.floor(F.col("trip_id") / 1000) % fixture.SEED_EVERY == 0
    return places.candidate_pairs(pieces.filter(~seeds), pieces.filter(seeds), 0.1)


@query
def run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*GEO_RUN.rendered(), ("run_name", GEO_RUN.run_name())], "key string, value string")


@query
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs of all privacy models and of probabilistic ones, from configuration texts."""
    texts = [f"privacy_model = {model}\ncontact_min_prob = {prob}\nindependent_contact_prob = {tied}\ndataset_type = {data}\ndata_total = 200" for model, prob, tied, data in RUNS]
    rows = [(k, config.mode, config.run_name()) for k, config in enumerate(map(parse_config, texts))]
    return spark.createDataFrame(rows, "case_id long, mode string, name string")


RUNS = [("geo", 0.05, "true", "Synthetic"), ("semantic", 0.05, "false", "Synthetic"), ("geosemantic", 0, "true", "Geolife"), ("GS", 0.125, "true", "Geolife"), ("ground_truth", 0.05, "true", "Synthetic")]
