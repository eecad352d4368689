"""Whole runs: from place and check-in files and a configuration to contacts, noisy trips and a log."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.operators import multihop, places, privacy, sinks, trips
from hopwise.plans.config import TracingConfig
from hopwise.plans.lineage import cut
from hopwise.sources import files

#: How far apart in km a noisy place may be taken for another, beyond its own radius.
PRIVATE_TOLERANCE_KM = 0.001
#: How stays are joined: by time bins alone, or by time bins and grid cells. All find the same contacts.
SEARCHES = {"linear": False, "interval": False, "IR": True}
COLUMNS = ["trip_id", "seq", "lng", "lat", "arrive_ts", "leave_ts", "radius"]


@dataclass(frozen=True)
class Run:
    """What a run has made; contacts and noisy_trips name trips as the files do. noisy_trips is None for exact runs."""

    name: str
    contacts: DataFrame
    noisy_trips: DataFrame | None
    log: list[str]


def noisy_points(config: TracingConfig, stays: DataFrame, pois: DataFrame, distributions: DataFrame) -> DataFrame:
    """stays with noisy_lng, noisy_lat, noisy_radius by the configuration's privacy model."""
    return privacy.points(config.privacy_model, stays, pois, distributions, config.privacy_epsilon_geo, config.privacy_epsilon_semantic)


def traced(config: TracingConfig, stays: DataFrame, seeds: DataFrame, pois: DataFrame, distributions: DataFrame, digits: int | None = None) -> DataFrame:
    """Contacts by the configuration: perturb the susceptible trips, then trace from exact seeds. digits: as for multihop.trace()."""
    if config.search_type not in SEARCHES:
        raise ValueError(f"search_type {config.search_type}: not one of {', '.join(SEARCHES)}")
    everyone = config.init_contact_ratio == 1
    susceptible = stays if everyone else stays.join(seeds.select("trip_id"), "trip_id", "left_anti")
    noisy = privacy.as_trips(noisy_points(config, susceptible, pois, distributions)) if config.is_private else susceptible
    exact = [F.col(c).cast("double").alias(c) if c in ("lng", "lat", "radius") else F.col(c) for c in COLUMNS]
    # Noisy stays to a micrometre: at the rim of a disc, where a sum begins, the last bit would decide about a whole step. Exact places stay as they are.
    doubles = exact if config.mode == "PCT" else [F.round(c, 9).alias(n) if n in ("lng", "lat", "radius") else c for c, n in zip(exact, COLUMNS, strict=True)]
    seed_stays = stays.join(seeds.select("trip_id"), "trip_id", "left_semi")
    all_stays = noisy if config.is_private or everyone else stays
    return multihop.trace(
        all_stays.select(*doubles) if config.is_private else all_stays.select(*COLUMNS), seeds, hops=config.multi_hop, d_km=config.identical_poi_dist_max,
        tolerance_km=PRIVATE_TOLERANCE_KM if config.is_private else 0.0, min_duration=config.contact_min_duration,
        min_prob=config.contact_min_prob if config.mode != "PCT" else 0.0, independent=config.independent_contact_prob,
        seed_stays=seed_stays.select(*exact) if config.is_private else seed_stays.select(*COLUMNS), seeds_too=everyone, cells=SEARCHES[config.search_type],
        digits=digits,
    )


def place_distributions(pois: DataFrame, rings: int = places.MAX_RINGS) -> DataFrame:
    """point_id, distribution of the places around each place."""
    near = places.k_nearest(pois.select(F.col("poi_id").alias("point_id"), "lng", "lat"), pois, "point_id", rings=rings)
    return places.distributions(near, "point_id")


def noisy_trip_rows(noisy: DataFrame, distributions: DataFrame | None) -> DataFrame:
    """What sinks.noisy_trip_lines() takes. noisy: as privacy.points() gives it; distributions: None for models without places."""
    rows = noisy
    none = F.lit(None).cast("array<double>")
    if distributions is None:
        rows = rows.withColumns({"distribution": none, "noisy_distribution": none})
    else:
        original = distributions.select("point_id", "distribution")
        other = distributions.select(F.col("point_id").alias("noisy_poi_id"), F.col("distribution").alias("noisy_distribution"))
        rows = rows.drop("distribution").join(original, "point_id", "left").join(other, "noisy_poi_id", "left")
    far = F.col("noisy_radius").alias("displacement")
    return rows.select("trip_id", "lng", "lat", "distribution", "noisy_lng", "noisy_lat", far, "noisy_distribution", "arrive_ts", "leave_ts")


def run(spark: SparkSession, config: TracingConfig, write: bool = True) -> Run:
    """A run over the files below config.home_path; writes contacts, noisy trips and the log there, each by the run's name."""
    if not 0 < config.init_contact_ratio <= 1:
        raise ValueError("init_contact_ratio must be in (0, 1]")
    home, began = config.home_path.rstrip("/"), time.time()
    sample = "_DS0" if config.dataset_type == "Geolife" else ""
    log = [f"{k} = {v}" for k, v in config.rendered()]
    raw = cut(files.read_pois(spark, f"{home}/RoadNetworkInfo/AllPOIs.csv"))
    pois = cut(trips.place_points(raw))
    found = pois.agg(F.count("*"), F.countDistinct("cell_row", "cell_col")).first()
    log.append(f"raw places {raw.count()}, places in the region {found[0]}, grid cells with places {found[1]}")
    checkins = cut(files.read_checkins(spark, f"{home}/inputData/{config.dataset_type}_days1{sample}.csv", first=config.data_total))
    points = raw.select("poi_id", "lng", "lat").distinct()
    stays = cut(trips.stays(checkins, points, ["arrive_ts", "row_no"]))
    read = checkins.agg(F.countDistinct("trip_id"), F.count("*")).first()
    if not read[0]:
        raise ValueError(f"{home}: no check-ins")
    totals = trips.totals(stays).first().asDict()
    log.append(f"trips {read[0]}, check-ins a trip {read[1] / read[0]:.6g}, " + ", ".join(f"{k} {v}" for k, v in totals.items()))
    n_seeds = math.floor(config.init_contact_ratio * (config.data_total or read[0]))
    every = trips.trips(stays).select("trip_id")
    seeds = cut(every if config.init_contact_ratio == 1 else trips.sample_exactly(every, n_seeds, "trip_id"))
    log.append(f"seeds {seeds.count()}")
    distributions = cut(place_distributions(pois))
    contacts = cut(traced(config, stays, seeds, pois, distributions))
    for row in multihop.per_hop(contacts).orderBy("hop").collect():
        log.append(f"hop {row['hop']}: {row['n_contacts']} contacts, the first at {row['first_cst']}")
    names = checkins.groupBy("trip_id").agg(F.min("seq_id").alias("name"))
    named = lambda x, c: x.join(names.withColumnsRenamed({"trip_id": c, "name": f"__{c}"}), c).drop(c).withColumnRenamed(f"__{c}", c)
    contacts = named(named(contacts, "susceptible_id"), "spreader_id").select("susceptible_id", "spreader_id", "cst", "hop", "probability")
    noisy = None
    if config.is_private:
        susceptible = stays if config.init_contact_ratio == 1 else stays.join(seeds, "trip_id", "left_anti")
        noisy = named(noisy_trip_rows(noisy_points(config, susceptible, pois, distributions), None if config.privacy_model == "geo" else distributions), "trip_id")
    log.append(f"seconds {time.time() - began:.1f}")
    name = config.run_name()
    if write:
        folder = "outputs_contacts" if config.is_private else "ground_truth"
        lines = sinks.contact_lines(contacts, multi_hop=config.multi_hop > 1, with_probability=config.mode != "PCT")
        sinks.write_lines(lines, f"{home}/{folder}/{name}")
        if noisy is not None:
            sinks.write_lines(sinks.noisy_trip_lines(noisy), f"{home}/outputs_noisyInd/{name}")
        sinks.write_lines(spark.createDataFrame([(line,) for line in log], "line string").coalesce(1), f"{home}/logs/{name}")
    return Run(name, contacts, noisy, log)


def main(config_path: str) -> Run:
    """A run by a configuration file, in the session there is or a new one."""
    spark = SparkSession.builder.appName("hopwise").getOrCreate()
    return run(spark, files.read_config(spark, config_path))


if __name__ == "__main__":
    import sys

    print("\n".join(main(sys.argv[1]).log))
