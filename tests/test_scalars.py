"""Scalar functions against closed forms and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from hopwise.functions import category, geo, text
from hopwise.functions.noise import lambert_w_minus_1, planar_laplace_radius
from hopwise.functions.probability import _angular_mass, correlated_value, independent_probability
from hopwise.plans.config import TracingConfig, float_tag, parse_config


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def python_haversine(lng1, lat1, lng2, lat2):
    a, b = math.radians(lng1 - lng2), math.radians(lat1 - lat2)
    h = math.sin(b / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(a / 2) ** 2
    return 2 * geo.EARTH_RADIUS_KM * math.asin(math.sqrt(h))


def test_haversine(spark):
    pairs = [(116.3, 39.9, 116.31, 39.9), (116.3, 39.9, 116.3, 39.9), (114.0, 38.0, 119.0, 43.0)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double").select(geo.haversine("a", "b", "c", "d").alias("v")).collect()
    for row, pair in zip(rows, pairs, strict=True):
        assert row["v"] == pytest.approx(python_haversine(*pair), abs=1e-5)


def test_boxes(spark):
    a, b = geo.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), geo.box(F.lit(2), F.lit(0), F.lit(3), F.lit(1))
    assert not one(spark, geo.intersects(a, b))  # edges alone
    assert one(spark, geo.contains(a, geo.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))))
    assert one(spark, geo.box_distance(a, b)) == 0
    assert one(spark, geo.point_box_distance(a, F.lit(1), F.lit(1))) == 0
    apart = geo.box(F.lit(3), F.lit(3), F.lit(4), F.lit(4))
    assert one(spark, geo.box_distance(a, apart)) == pytest.approx(python_haversine(2, 2, 3, 3), abs=1e-5)


def test_rings(spark):
    cells = one(spark, geo.rings(F.lit(0).cast("long"), F.lit(5).cast("long"), 2))
    assert {(c["ring"], c["row"], c["col"]) for c in cells} == {(0, 0, 5), (1, 0, 4), (1, 0, 6), (1, 1, 4), (1, 1, 5), (1, 1, 6)}


@pytest.mark.parametrize(("code", "expected"), [("808A", 12), ("9800", 11), ("2800", 2), ("2801", 1), ("A982", 16), ("ZZ", None), ("7100", 3)])
def test_category(spark, code, expected):
    assert one(spark, category.category_id(F.lit(code))) == expected


def test_lambert_and_laplace(spark):
    for x in (-0.36, -0.2, -0.05, -1e-6):
        w = one(spark, lambert_w_minus_1(F.lit(x)))
        assert w * math.exp(w) == pytest.approx(x, rel=1e-9) and w <= -1
    r = one(spark, planar_laplace_radius(F.lit(0.7), 4.0))
    assert 1 - (1 + 4 * r) * math.exp(-4 * r) == pytest.approx(0.7, abs=1e-9)


def test_probability_cascade(spark):
    value = lambda d, radius, delta: one(spark, independent_probability(F.lit(d), F.lit(radius), F.lit(delta)))
    assert value(0.5, 0.0, 0.1) == 0
    assert value(0.5, 0.3, 0.1) == 0
    assert value(0.1, 0.1, 0.5) == 1
    assert 0 < value(0.2, 0.3, 0.1) < value(0.1, 0.3, 0.15) <= 1


def test_angular_mass_is_its_sum():
    import numpy as np

    for low, width in ((-3.0, 0.01), (0.5, 0.002), (-10.0, 0.005)):
        k = np.arange(1000)
        plain = (np.exp(-np.abs(low + k * width)) * width / (2 * (1 - math.exp(-180)))).sum()
        assert _angular_mass(np.array([low]), np.array([width]))[0] == pytest.approx(plain, rel=1e-9)
    assert correlated_value(1.0, 0.2, 0.2, 0.0, 0.1) == 0


def test_text_helpers(spark):
    assert one(spark, text.float_tag(F.lit(0.01))) == "0-01" == float_tag(0.01)
    assert one(spark, text.float_tag(F.lit(4.0))) == "4-0" == float_tag(4.0)
    assert one(spark, text.epoch_of(F.lit("1970.01.02 00:00:01"))) == 86401
    assert one(spark, text.epoch_of(F.lit("nothing"))) is None
    assert one(spark, text.tokens(F.lit("a,,b"))) == ["a", "", "b"]


def test_config():
    config = parse_config("# comment\n\nmulti_hop = 3\nmulti_hop = 5\nprivacy_model = geo\nother = 1\ncontact_min_prob = 0.1\nindependent_contact_prob = false\n")
    assert (config.multi_hop, config.privacy_model, config.mode) == (5, "geo", "PCTc")
    assert TracingConfig().mode == "PCT"
    assert TracingConfig(privacy_model="GS").privacy_suffix() == "_GS_EG4-0_ES4-0"


def test_arrays_of_steps_fit_a_cache():
    """Arrays of 500 pairs took 4 MB each, and twice the time; values don't depend on how many are taken together."""
    import numpy as np

    from hopwise.functions import probability as P

    assert P.PAIRS_AT_ONCE * P.STEPS * 8 <= 512 * 1024
    rng = np.random.default_rng(3)
    given = [rng.uniform(0.01, 1, 70), rng.uniform(0.01, 3, 70), rng.uniform(0.01, 3, 70), rng.uniform(0.05, 1.2, 70), np.full(70, 0.12)]
    parts = [P.correlated_values(*(x[k : k + 32] for x in given)) for k in range(0, 70, 32)]
    assert np.array_equal(np.concatenate(parts), P.correlated_values(*given), equal_nan=True)
