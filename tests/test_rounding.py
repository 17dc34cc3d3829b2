"""Rounding of the exact binary value; arguments that no search answers."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from stormgrid.functions.rounding import fixed_text, round_exact, round_once
from stormgrid.operators import search as S

VALUES = [45.15, 1.005, 2.5, 0.5, 1.5, -2.5, 0.25, 0.35, 1e-9, 0.0, -0.0, 123456.789, 999999.995, 2.675, 1.45, 0.05, 1e12 + 0.5, 8.5, 9.95, 99.95]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_round_exact(spark, digits):
    rng = random.Random(digits)
    values = VALUES + [round(rng.uniform(-300, 300), digits + 1) for _ in range(400)] + [rng.uniform(-1000, 1000) for _ in range(100)]
    values += [k / 16 for k in range(-40, 40)]  # exact ties
    frame = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", round_exact(F.col("x"), digits).alias("even"), round_once(F.col("x"), digits).alias("once"), fixed_text(F.col("x"), digits).alias("text"))
    for r in frame.collect():
        assert r.even == r.once == (round(r.x, digits) if abs(r.x) < 1e9 else r.x), r
        if 0 < abs(r.x) < 1e9:
            want = str(abs(Decimal(r.x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
            assert r.text.lstrip("-") == want, r


def test_round_exact_odd_values(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),)], "x double").select(round_exact(F.col("x"), 1).alias("y"))
    got = [r.y for r in frame.collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [float("inf"), -float("inf")]


def test_rejected_sites(spark):
    rows = [(1, 0.0, 0.0, 1e5), (2, 91.0, 0.0, 1e5), (3, None, 0.0, 1e5), (4, 0.0, -180.5, 1e5), (5, 0.0, None, 1e5), (6, 0.0, 0.0, 0.0), (7, 0.0, 0.0, None),
            (8, float("nan"), 0.0, 1e5), (9, 0.0, 0.0, float("nan"))]
    sites = spark.createDataFrame(rows, "site_id long, lat double, lon double, radius_m double")
    reasons = {r.site_id: r.reject_reason for r in S.rejected_sites(sites).collect()}
    assert set(reasons) == set(range(2, 10)) and reasons[2] == "Latitude out of range: 91.0" and reasons[3] == "Latitude out of range: null"
    assert reasons[4].startswith("Longitude") and reasons[6].startswith("Radius") and reasons[9].startswith("Radius")
    assert [r.site_id for r in S.valid_sites(sites).collect()] == [1]
    assert S.checked_sites(sites.filter("site_id = 1")).collect()[0].lat == 0.0
    with pytest.raises(Exception, match="Longitude out of range: -180.5"):
        S.checked_sites(sites.filter("site_id = 4")).collect()
