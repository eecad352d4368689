"""Contact rules on hand-made stays, and against an independent two-pointer walk."""

import random

import pytest

from hopwise.operators import contacts as C
from hopwise.operators import multihop, privacy, staypoints
from hopwise.operators.trips import collapse

STAY = "trip_id long, seq int, lng double, lat double, arrive_ts long, leave_ts long, radius double"


def stays(spark, rows):
    """rows: trip, place, arrive, leave."""
    out, seq = [], {}
    for trip, place, a, b in rows:
        out.append((trip, seq.get(trip, 0), 116.3 + 0.01 * place, 39.9, a, b, 0.0))
        seq[trip] = seq.get(trip, 0) + 1
    return spark.createDataFrame(out, STAY)


def traced(spark, rows, seeds=(1,), **how):
    return {(r["susceptible_id"], r["spreader_id"], r["cst"], r["hop"]) for r in multihop.trace(stays(spark, rows), spark.createDataFrame([(s,) for s in seeds], "trip_id long"), **how).collect()}


def test_touching_intervals_are_no_contact(spark):
    assert not traced(spark, [(1, 1, 0, 1000), (2, 1, 1000, 2000)])


def test_duration_is_inclusive_and_runs_add_up(spark):
    assert traced(spark, [(1, 1, 0, 600), (2, 1, 0, 600)]) == {(2, 1, 0, 1)}
    assert not traced(spark, [(1, 1, 0, 599), (2, 1, 0, 599)])
    moves = [(1, 1, 0, 300), (1, 2, 300, 600), (2, 1, 0, 300), (2, 2, 300, 600)]  # both move at once
    assert traced(spark, moves) == {(2, 1, 0, 1)}


def test_a_far_stay_breaks_a_run(spark):
    assert not traced(spark, [(1, 1, 0, 900), (2, 1, 0, 300), (2, 5, 300, 600), (2, 1, 600, 900)])


def test_second_hop_starts_at_the_contact(spark):
    rows = [(1, 1, 1000, 2000), (2, 1, 0, 3000), (3, 1, 0, 900), (4, 1, 1500, 2600)]
    found = traced(spark, rows, hops=3)
    assert (2, 1, 1000, 1) in found
    assert not any(r[0] == 3 for r in found)  # left before 2 was reached
    assert (4, 2, 1500, 2) in found or (4, 1, 1500, 1) not in found


def walk(q, p, min_dur):
    """Two pointers over time-ordered stays (place, arrive, leave); the first run's start, or None."""
    i = j = 0
    start, total = None, 0
    while i < len(q) and j < len(p):
        a, b = max(q[i][1], p[j][1]), min(q[i][2], p[j][2])
        if a < b and q[i][0] == p[j][0]:
            if start is None:
                start, total = a, 0
            total += b - a
            if total >= min_dur:
                return start
        else:
            start = None
        if q[i][2] == p[j][2]:
            i, j = i + 1, j + 1
        elif q[i][2] < p[j][2]:
            i += 1
        else:
            j += 1
    return None


def test_runs_equal_two_pointers(spark):
    rng = random.Random(5)
    trips, rows = {}, []
    for trip in range(1, 25):
        t, path = rng.randrange(0, 300), []
        for _ in range(8):
            d = rng.randrange(1, 6) * 100
            path.append((rng.randrange(3), t, t + d))
            t += d if rng.random() < 0.8 else d + 100
        merged = [path[0]]
        for s in path[1:]:
            if s[0] == merged[-1][0]:
                merged[-1] = (s[0], merged[-1][1], s[2])
            else:
                merged.append(s)
        trips[trip] = merged
        rows += [(trip, *s) for s in merged]
    data = stays(spark, rows)
    q, p = data.filter("trip_id > 6"), data.filter("trip_id <= 6")
    from pyspark.sql import functions as F

    p = p.join(p.groupBy("trip_id").agg(F.min("arrive_ts").alias("valid_start"), F.max("leave_ts").alias("valid_end")), "trip_id")
    for exact in (True, False):
        met = C.pairs(q, p, min_duration=300, exact=exact if exact else None, tolerance_km=0.0 if exact else 0.001)
        found = {(r["q_trip"], r["p_trip"]): r["cst"] for r in C.events(C.runs(met), 300).collect()}
        expected = {(a, b): walk(trips[a], trips[b], 300) for a in range(7, 25) for b in range(1, 7)}
        assert found == {k: v for k, v in expected.items() if v is not None}


def test_collapse_merges_across_gaps(spark):
    rows = spark.createDataFrame([(1, 7, 0, 10), (1, 7, 50, 60), (1, 8, 60, 70), (1, 7, 70, 80)], "trip_id long, point_id long, arrive_ts long, leave_ts long")
    assert sorted(tuple(r) for r in collapse(rows, ["point_id"], ["arrive_ts"]).collect()) == [(1, 0, 7, 0, 60), (1, 1, 8, 60, 70), (1, 2, 7, 70, 80)]


def test_large_budget_brings_noise_near_zero(spark):
    data = stays(spark, [(1, 1, 0, 600), (2, 3, 0, 600)]).selectExpr("*", "seq + 1L as point_id")
    noisy = privacy.geo_ind(data, 1e6).collect()
    assert len(noisy) == 2 and all(r["radius"] < 1e-3 for r in noisy)


@pytest.mark.parametrize("n", [1, 2])
def test_stay_points_of_short_trips(spark, n):
    points = spark.createDataFrame([(1, 100 * k, 116.3, 39.9, k) for k in range(n)], "trip_id long, ts long, lng double, lat double, event_id long")
    assert staypoints.stay_points(points).count() == n


def test_stay_points_hold_at_an_anchor(spark):
    times = [0, 100, 1000, 2200, 2300, 2400]
    lngs = [116.30, 116.40, 116.40, 116.40, 116.50, 116.60]
    points = spark.createDataFrame([(1, t, x, 39.9, k) for k, (t, x) in enumerate(zip(times, lngs, strict=True))], "trip_id long, ts long, lng double, lat double, event_id long")
    found = [(r["arrive_ts"], r["leave_ts"]) for r in staypoints.stay_points(points).orderBy("seq").collect()]
    assert found == [(0, 100), (100, 2300), (2400, 2400)]


def test_usual_stays_touch_few_bins(spark, monkeypatch):
    """Bins of 1800 s took four or five rows for a stay of two hours."""
    made = []
    binned = C._in_bins
    monkeypatch.setattr(C, "_in_bins", lambda *a: made.append(binned(*a)) or made[-1])
    assert traced(spark, [(1, 1, 100, 7300), (2, 1, 5000, 12200)], hops=1) == {(2, 1, 5000, 1)}
    assert [x.count() for x in made] == [2, 2]


def test_earliest_contacts_equal_those_of_all_runs(spark, monkeypatch):
    """Over slices of time, with runs of short pairs, ties, late validity, radii and trips whose stays overlap one another."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "SLICED_FROM", 0)
    rng = random.Random(8)
    rows, seq = [], {}
    for trip in range(60):
        t = rng.randrange(0, 30) * 100
        for _ in range(12):
            d = rng.randrange(1, 12) * 100
            rows.append((trip, seq.get(trip, 0), 116.3 + 0.01 * rng.randrange(4), 39.9, t, t + d, 0.9 * rng.randrange(2) if trip % 3 else 0.0))
            seq[trip] = seq.get(trip, 0) + 1
            t = max(0, t + d + rng.choice([0, 0, 0, 300, -200 if trip % 7 == 0 else 0]))
    data = spark.createDataFrame(rows, STAY)
    q, p = data.filter("trip_id >= 15"), data.filter("trip_id < 15")
    ranges = p.groupBy("trip_id").agg(F.min("arrive_ts").alias("valid_start"), F.max("leave_ts").alias("valid_end"))
    p = p.join(ranges.withColumn("valid_start", F.col("valid_start") + F.col("trip_id") % 4 * 700), "trip_id")
    for least, how in ((900, {"exact": True}), (1500, {"tolerance_km": 0.001})):
        expected = C.contacts(C.events(C.runs(C.pairs(q, p, min_duration=least, **how)), least), hop=2).collect()
        assert expected and sorted(C.earliest(q, p, min_duration=least, hop=2, **how).collect()) == sorted(expected)


def test_traces_write_no_pair_of_long_stays(spark, monkeypatch):
    """Twenty spreaders meet a trip in each of its stays; only trips that meet in a short stay may have their runs numbered."""
    numbered = []
    runs = C.runs
    monkeypatch.setattr(C, "runs", lambda met: numbered.append(met.count()) or runs(met))
    rows = [(1, place, 1000 * place, 1000 * place + 900) for place in range(8)]
    rows += [(trip, place, 1000 * place, 1000 * place + 900) for trip in range(2, 22) for place in range(8)]
    assert traced(spark, rows, seeds=range(2, 22), hops=1) == {(1, 2, 0, 1)}
    assert sum(numbered) == 0


def test_probable_contacts_equal_those_of_all_runs(spark, monkeypatch):
    """Joined up to shares of the arrivals, with copies of spreaders, runs of short pairs, ties and trips whose stays overlap or are out of order."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "PREFIXED_FROM", 0)
    monkeypatch.setattr(C, "PREFIXES", (0.5,))
    rng = random.Random(9)
    rows, seq = [], {}
    for trip in range(24):
        t = rng.randrange(0, 30) * 100
        for _ in range(10):
            d = rng.randrange(1, 12) * 100
            rows.append((trip, seq.get(trip, 0), 116.3 + 0.001 * rng.randrange(4), 39.9, t, t + d, 0.02 + 0.3 * rng.random() if trip >= 8 else 0.0))
            seq[trip] = seq.get(trip, 0) + 1
            t = max(0, t + d + rng.choice([0, 0, 0, 300, -200 if trip % 7 == 0 else 0]))
    rows += [(1000 + 100 * k + r[0], *r[1:]) for r in rows if r[0] < 8 for k in range(r[0] % 3)]
    data = spark.createDataFrame(rows, STAY)
    q, p = C.with_previous(data.filter("trip_id between 8 and 23")), data.filter("trip_id < 8 or trip_id > 23")
    ranges = p.groupBy("trip_id").agg(F.min("arrive_ts").alias("valid_start"), F.max("leave_ts").alias("valid_end"))
    p = p.join(ranges.withColumn("valid_start", F.col("valid_start") + F.col("trip_id") % 4 * 700), "trip_id")
    alike = C.alike(p)
    assert alike.select("trip_id").distinct().count() < p.select("trip_id").distinct().count() and alike.filter("seq = 0").agg(F.sum("copies")).first()[0] == p.filter("seq = 0").count()
    settled = []
    real = C._settled
    monkeypatch.setattr(C, "_settled", lambda *a: settled.append(real(*a)) or settled[-1])
    for independent, hop, least in ((False, 1, 900),):
        how = dict(d_km=0.12, tolerance_km=0.001, min_duration=least, exact=False)
        all_events = C.events(C.runs(C.with_probability(C.pairs(q, p, **how), 0.12, independent)), least)
        expected = C.contacts(all_events, hop=hop, min_prob=0.05).withColumn("probability", F.round("probability", 1)).collect()
        found = C.probable(q, alike, hop=hop, min_prob=0.05, independent=independent, digits=1, **how).collect()
        assert expected and sorted(found) == sorted(expected)
    assert sum(x.count() for x in settled) > 0


def test_trips_alike_are_joined_once(spark, monkeypatch):
    """Twenty equal spreaders gave twenty pairs, each with its own sum of 1000 steps."""
    met = []
    runs = C.runs
    monkeypatch.setattr(C, "runs", lambda x: met.append(x.count()) or runs(x))
    rows = [(1, 1, 0, 900)] + [(trip, 1, 0, 900) for trip in range(2, 22)]
    data = stays(spark, rows).selectExpr("trip_id", "seq", "lng", "lat", "arrive_ts", "leave_ts", "if(trip_id = 1, 0.4D, 0D) as radius")
    seeds = spark.createDataFrame([(s,) for s in range(2, 22)], "trip_id long")
    found = multihop.trace(data, seeds, hops=1, d_km=0.12, min_prob=0.01).collect()
    one = multihop.trace(data.filter("trip_id < 3"), seeds, hops=1, d_km=0.12, min_prob=0.01).collect()
    assert met == [1, 1] and [(r["spreader_id"], r["cst"]) for r in found] == [(2, 0)]
    assert found[0]["probability"] == pytest.approx(1 - (1 - one[0]["probability"]) ** 20)


def test_equal_rows_take_one_sum(monkeypatch):
    import numpy as np

    from hopwise.functions import probability as P

    assert np.array_equal(P.distinct_values(P.independent_values, [np.array([0.2, np.nan, 0.2, 0.1]), np.full(4, 0.3), np.full(4, 0.1)])[0], np.array([P.independent_values(*np.array([[d], [0.3], [0.1]]))[0] if d else 0 for d in (0.2, 0, 0.2, 0.1)]))
    assert len(P.distinct_values(P.independent_values, [np.array([])] * 3)[0]) == 0
    sizes = []
    P.distinct_values(lambda *a: sizes.append(len(a[0])) or a[0], [np.full(100, 0.2)] * 5)
    assert sizes == [1]
