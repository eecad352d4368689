"""Whole runs from hand-made files, and the parts that they are made of."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopwise import run
from hopwise.functions import category
from hopwise.functions.probability import correlated_value, correlated_values, independent_values
from hopwise.operators import contacts, numbering, privacy, sinks, trips
from hopwise.plans.config import TracingConfig
from hopwise.sources import files

POIS = """name,category_code,address,unnamed,lng,lat
cafe,1000,street,,116.30,39.90
far,2100,street,,121.00,39.90
shop,7200,street,,116.31,39.90
cafe too,5000,street,,116.30,39.90
park,4000,street,,116.302,39.90
"""
HEAD = "seq_id,poi_id,start_timestamp,end_timestamp,start_time,end_time,travel_time_s,travel_time_min,duration_s,duration_min\n"


@pytest.fixture
def home(tmp_path):
    """1 is the cafe (two labels), 2 lies outside the region, 3 the shop, 4 the park."""
    rows = [("a", 1, 0, 1000), ("a", 3, 1000, 3000), ("b", 1, 0, 400), ("b", 1, 500, 1000), ("c", 3, 2000, 2700), ("d", 4, 0, 3000), ("e", 3, 2000, 2500), ("f", 2, 0, 3000)]
    for folder in ("RoadNetworkInfo", "inputData"):
        (tmp_path / folder).mkdir()
    (tmp_path / "RoadNetworkInfo" / "AllPOIs.csv").write_text(POIS)
    (tmp_path / "inputData" / "Synthetic_days1.csv").write_text(HEAD + "".join(",".join(map(str, r)) + ",,,,,,\n" for r in rows))
    return tmp_path


def lines(path):
    return sorted(line for f in path.glob("part-*") for line in f.read_text().splitlines())


def test_places_and_check_ins(spark, home):
    pois = {(r["poi_id"], r["category_code"]) for r in files.read_pois(spark, str(home / "RoadNetworkInfo" / "AllPOIs.csv")).collect()}
    assert pois == {(1, "1000"), (2, "2100"), (3, "7200"), (1, "5000"), (4, "4000")}
    read = files.read_checkins(spark, str(home / "inputData" / "Synthetic_days1.csv"), first=3).collect()
    assert {(r["seq_id"], r["trip_id"]) for r in read} == {("a", 1), ("b", 2), ("c", 3)} and len(read) == 5


def seeded(spark, monkeypatch, seed_id):
    monkeypatch.setattr(trips, "sample_exactly", lambda of, n, key: of.filter(F.col("trip_id") == seed_id).limit(n))


def test_exact_run(spark, home, monkeypatch):
    seeded(spark, monkeypatch, 1)
    config = TracingConfig(home_path=str(home), data_total=6, init_contact_ratio=0.2, multi_hop=3, identical_poi_dist_max=0.0, contact_min_duration=600)
    made = run.run(spark, config)
    assert lines(home / "ground_truth" / made.name) == ["b, a, 0,1", "c, a, 2000,1"]
    assert any("places in the region 3" in x for x in made.log) and "trips 6, check-ins a trip 1.33333" in " ".join(made.log)
    assert lines(home / "logs" / made.name) == sorted(made.log) and made.noisy_trips is None
    again = run.run(spark, TracingConfig(**{**config.__dict__, "search_type": "interval", "multi_hop": 1}))
    assert lines(home / "ground_truth" / again.name) == ["b, a, 0", "c, a, 2000"]


@pytest.mark.parametrize("model", ["geo", "semantic", "geosemantic"])
def test_private_runs(spark, home, monkeypatch, model):
    seeded(spark, monkeypatch, 1)
    config = TracingConfig(home_path=str(home), data_total=6, privacy_model=model, multi_hop=2, identical_poi_dist_max=0.2, contact_min_duration=60, contact_min_prob=0.001)
    made = run.run(spark, config)
    out = lines(home / "outputs_noisyInd" / made.name)
    assert {x.split(",")[0] for x in out} == set("bcdef") and len(out) == 5  # b's two check-ins at one place are one stay
    for line in out:
        fields = line.split(",")
        assert len(fields) == 1 + 2 + 18 + 2 + 1 + 18 + 2
        if model == "geo":
            assert fields[3:21] == fields[24:42] == ["0"] * 18
        elif fields[0] == "b":
            assert sum(map(float, fields[3:20])) == pytest.approx(1, abs=1e-4)
    for line in lines(home / "outputs_contacts" / made.name):
        name, spreader, cst = line.split(", ")
        assert name in "bcdef" and 0 < float(cst.split(",")[2]) <= 1


def test_all_are_seeds_and_reach_one_another(spark, home):
    config = TracingConfig(home_path=str(home), data_total=0, init_contact_ratio=1, multi_hop=1, identical_poi_dist_max=0.0, contact_min_duration=600)
    found = {r["susceptible_id"] for r in run.run(spark, config, write=False).contacts.collect()}
    assert found == {"a", "b", "c"}


def test_wrong_settings_are_refused(spark, home):
    with pytest.raises(ValueError, match="init_contact_ratio"):
        run.run(spark, TracingConfig(home_path=str(home), init_contact_ratio=0.0))
    with pytest.raises(ValueError, match="search_type"):
        run.run(spark, TracingConfig(home_path=str(home), data_total=6, init_contact_ratio=0.5, search_type="magic"), write=False)


def test_a_run_by_a_configuration_file(spark, home):
    (home / "config.properties").write_text(f"# a run\nhome_path = {home}/\ndata_total = 6\ninit_contact_ratio = 0.2\nmulti_hop = 2\nidentical_poi_dist_max = 0\ncontact_min_duration = 600\n")
    assert run.main(str(home / "config.properties")).name == "Synthetic_D6_QR0-2_ground_truth_FS_MH2_CD0-0_CT600_IR"


def test_numbering_and_least_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(-50, 50), "xy"[k % 2]) for k in range(300)]
    data = spark.createDataFrame(rows, "id long, at long, g string")
    for ranges in (1, 7, 4096):
        found = {r["id"]: r["number"] for r in numbering.numbered(data, "at", ties=("id",), ranges=ranges).collect()}
        assert [x for x, _ in sorted(found.items(), key=lambda x: x[1])] == [k for k, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))] and set(found.values()) == set(range(1, 301))
        by_group = numbering.numbered(data, "at", keys=("g",), ties=("id",), ranges=ranges).collect()
        assert Counter(r["number"] for r in by_group) == Counter(dict.fromkeys(range(1, 151), 2))
        for n in (0, 1, 120, 300, 900):
            some = numbering.least_rows(data, n, "at", ("id",), ranges)
            assert some.columns == data.columns and {r["id"] for r in some.collect()} == {k for k, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:n]}
    empty = data.limit(0)
    assert numbering.numbered(empty, "at").count() == 0 and numbering.least_rows(empty, 5, "at").count() == 0


def test_pairs_of_long_stays_and_mixed_radii_equal_brute_force(spark):
    rng = random.Random(9)

    def stays(first, n):
        out = []
        for k in range(n):
            start = rng.randrange(0, 400_000)
            out.append((first + k // 4, k % 4, 116.3 + rng.random() * 0.2, 39.9 + rng.random() * 0.2, start, start + rng.choice([300, 4000, 60_000, 2_000_000]), rng.choice([0.0, 0.05, 0.3, 6.0])))
        return out

    q, p = stays(1, 60), stays(1000, 60)
    schema = "trip_id long, seq int, lng double, lat double, arrive_ts long, leave_ts long, radius double"
    infectious = spark.createDataFrame(p, schema).withColumns({"valid_start": F.lit(0).cast("long"), "valid_end": F.lit(10_000_000).cast("long")})
    expected = set()
    for a in q:
        for b in p:
            u, v = math.radians(a[2] - b[2]), math.radians(a[3] - b[3])
            h = math.sin(v / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(u / 2) ** 2
            far = 2 * 6378.13720703125 * math.asin(math.sqrt(h))
            if a[4] < b[5] and b[4] < a[5] and far <= 0.5 + a[6] + b[6]:
                expected.add((a[0], a[1], b[0], b[1]))
    for cells in (True, False):
        found = contacts.pairs(spark.createDataFrame(q, schema), infectious, d_km=0.5, min_duration=600, cells=cells).collect()
        assert {(r["q_trip"], r["i"], r["p_trip"], r["j"]) for r in found} == expected and len(found) == len(expected) > 50
    fewer = contacts.pairs(spark.createDataFrame(q[:20], schema), infectious, d_km=0.5, min_duration=600).collect()
    assert {(r["q_trip"], r["i"], r["p_trip"], r["j"]) for r in fewer} == {x for x in expected if x[0] <= 5}


def test_probabilities_equal_plain_sums():
    import numpy as np

    rng = random.Random(2)
    for _ in range(30):
        d, pp, qp, radius, delta = rng.random(), rng.random(), rng.random(), rng.random() + 0.01, rng.random()
        one = independent_values(*(np.array([x]) for x in (d, radius, delta)))[0]
        tied = correlated_value(d, pp, qp, radius, delta)
        if d >= delta + radius:
            assert one == tied == 0
            continue
        if delta >= radius and d <= delta - radius:
            assert one == tied == 1
            continue
        step = abs(delta - d) / 1000
        whole = sum(math.exp(-k * step) * step for k in range(1000)) / (1 - math.exp(-radius)) if d < delta else 0.0
        left, right = abs(d - delta), min(radius, d + delta)
        width = (right - left) / 1000
        plain, angular = whole, whole
        angle = lambda a, b, c: math.degrees(math.acos((a * a + b * b - c * c) / (2 * a * b))) if abs((a * a + b * b - c * c) / (2 * a * b)) <= 1 else None
        fold = lambda x: x if x <= 180 else 180 - x
        turn = angle(qp, d, pp)
        for k in range(1000):
            r = left + k * width
            density = math.exp(-r) / (1 - math.exp(-radius))
            half = angle(r, d, delta)
            plain += density * (half / 180 if half is not None else 0.001) * width
            if half is not None and turn is not None and k % 10 == 0:  # the mass changes slowly: every tenth stands for ten
                low, high = sorted((fold(turn - half), fold(turn + half)))
                mass = sum(math.exp(-abs(low + j * (high - low) / 1000)) for j in range(1000)) * (high - low) / 1000 / (2 * (1 - math.exp(-180)))
                angular += min(mass, 1) * density * width * 10
        assert one == pytest.approx(min(plain, 1), abs=2e-3)
        assert tied == pytest.approx(min(angular, 1), abs=2e-2)
    assert correlated_values(*(np.zeros(0),) * 5).shape == (0,)


def test_semantic_places_follow_single_draws(spark):
    """Shares of sampled places against visiting places one by one with a draw each."""
    pois = spark.createDataFrame([(k, 116.30 + 0.001 * k, 39.90, [("1000", 0)] if k < 4 else [("1000", 0), ("2100", 1)] if k < 7 else [("2100", 1)]) for k in range(9)], "poi_id long, lng double, lat double, categories array<struct<code:string,category_id:int>>")
    share = [0.4, 0.6] + [0.0] * 15
    dists = spark.createDataFrame([(1, share)], "point_id long, distribution array<double>")
    n = 4000
    stays = spark.range(n).selectExpr("id AS trip_id", "0 AS seq", "1L AS point_id", "116.3D AS lng", "39.9D AS lat", "0L AS arrive_ts", "1L AS leave_ts")
    found = Counter(r["noisy_poi_id"] for r in privacy.semantic_points(stays, pois, dists, 4.0).collect())
    weight = lambda h: (math.exp(2 * (1 - sum(map(min, h, share)) / sum(map(max, h, share)))) - 1) / (math.exp(2) - 1)
    one, both, two = ([1.0, 0.0], [0.5, 0.5], [0.0, 1.0])
    order = [(k, weight(one)) for k in range(4)] + [(k, weight(both)) for k in range(4, 7)] + [(k, weight(two)) for k in (7, 8)]
    left, expected = 1.0, Counter()
    for k, bar in order:
        expected[k] += left * (1 - bar)
        left *= bar
    for k in range(9):
        expected[k] += left / 9
    assert all(abs(found[k] / n - expected[k]) < 0.03 for k in range(9))


def test_distribution_texts(spark):
    of = spark.createDataFrame([(1, None), (2, [0.25, 0.75] + [0.0] * 15), (3, [0.0] * 17)], "id int, d array<double>")
    found = {r["id"]: r["t"] for r in of.select("id", category.distribution_text(F.col("d")).alias("t")).collect()}
    assert found == {1: ",".join("0" * 18), 2: "0.25000,0.75000," + "0," * 15 + "1", 3: "0," * 17 + "0"}
    numbers = spark.createDataFrame([(x,) for x in (0.0, 1.0, 0.5, 0.123456789, 1e-5, 0.00012345678, 1234567.0)], "v double").select(sinks.number_text(F.col("v")).alias("t"))
    assert [r["t"] for r in numbers.collect()] == ["0", "1", "0.5", "0.123457", "1e-05", "0.000123457", "1.23457e+06"]


def test_snapping_and_first_stays(spark):
    pois = trips.place_points(spark.createDataFrame([(1, "1000", 116.30, 39.90), (2, "2100", 116.32, 39.90)], "poi_id long, category_code string, lng double, lat double"))
    noisy = spark.createDataFrame([(7, 0, 116.317, 39.90), (7, 1, 118.5, 42.0)], "trip_id long, seq int, noisy_lng double, noisy_lat double")
    found = {r["seq"]: r for r in privacy.snapped(noisy, pois).collect()}
    assert (found[0]["noisy_poi_id"], found[0]["noisy_lng"]) == (2, 116.32) and (found[1]["noisy_poi_id"], found[1]["noisy_lng"]) == (None, 118.5)
    assert [(r["seq"], r["noisy_lng"]) for r in trips.first_stays(noisy).collect()] == [(0, 116.317)]


def test_exact_places_are_not_rounded_where_probabilities_are_summed(spark):
    """The seed's place rounded to nine decimals is 1e-5 km nearer, which moves the probability's third decimal."""
    of = spark.createDataFrame(
        [(5131, 21, 28, 115.07599639892578, 39.92359924316406, 1704922383, 1704929583, 0.0), (250, 20, 21, 115.0739974975586, 39.92259979248047, 1704916489, 1704923689, 0.0)],
        "trip_id long, seq int, point_id long, lng float, lat float, arrive_ts long, leave_ts long, radius double",
    )
    config = TracingConfig(privacy_model="geo", multi_hop=1, identical_poi_dist_max=0.12, contact_min_duration=600, contact_min_prob=0.05)
    found = run.traced(config, of, spark.createDataFrame([(250,)], "trip_id long"), None, None).collect()
    assert [(r["susceptible_id"], round(r["probability"], 6)) for r in found] == [(5131, 0.582983)]
