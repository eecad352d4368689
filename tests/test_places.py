"""Pairs of trips that may meet, against all pairs."""

import random

import pytest

from hopwise.operators import places

TRIP = "trip_id long, t_start long, t_end long, mbr struct<min_lng: double, min_lat: double, max_lng: double, max_lat: double>"


def trips(spark, first, n, rnd):
    """Trips of minutes to months, in boxes of metres to degrees, some of them equal."""
    out = []
    for k in range(n):
        start, lng, lat = rnd.randrange(0, 90 * 86_400), 115 + rnd.random() * 4, 39 + rnd.random() * 2
        wide, high = 10 ** rnd.uniform(-4, 0.5), 10 ** rnd.uniform(-4, 0)
        trip = (start, start + int(10 ** rnd.uniform(2, 6.8)), (lng, lat, lng + wide, lat + high))
        out.append((first + k, *(out[-1][1:] if k % 4 == 3 else trip)))
    return out, spark.createDataFrame(out, TRIP)


@pytest.fixture
def sides(spark):
    rnd = random.Random(5)
    return trips(spark, 0, 60, rnd), trips(spark, 50, 40, rnd)


def together(a, b):
    x, y = a[3], b[3]
    return a[1] <= b[2] and b[1] <= a[2], x[0] < y[2] and y[0] < x[2] and x[1] < y[3] and y[1] < x[3]


@pytest.mark.parametrize("block", [3, 2000])
def test_trip_pairs_are_those_of_all_pairs(spark, sides, monkeypatch, block):
    monkeypatch.setattr(places, "BLOCK", block)
    (q_rows, q), (p_rows, p) = sides
    every = {(a[0], b[0]): together(a, b) for a in q_rows for b in p_rows if a[0] != b[0]}
    found = [(r["q_trip"], r["p_trip"], r["in_time"], r["in_space"]) for r in places.trip_pairs(q, p, 0.0).collect()]
    assert sorted(found) == sorted((*k, *v) for k, v in every.items() if any(v))
    strict = [(r["q_trip"], r["p_trip"]) for r in places.candidate_pairs(q, p, 0.0).collect()]
    assert sorted(strict) == sorted(k for k, v in every.items() if all(v))


def test_long_trips_in_wide_boxes_touch_few_bins(spark, monkeypatch):
    """A month in a box of four degrees by half a degree took 30 days times 880 cells."""
    made = []
    joined = places._met
    monkeypatch.setattr(places, "_met", lambda *a: made.append(joined(*a)) or made[-1])
    rows = [(k, 0, 30 * 86_400, (115.0, 39.9, 118.99, 40.4)) for k in range(8)]
    of = spark.createDataFrame(rows, TRIP)
    assert places.candidate_pairs(of, of, 0.1).count() == 56
    sized = [r.count() for r in (of, made[0])]
    assert sized == [8, 64]
    assert places.trip_pairs(of, of, 0.1).count() == 56
