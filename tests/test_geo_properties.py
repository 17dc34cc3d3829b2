"""Property tests (Hypothesis) for the distance stages, evaluated in one Spark batch."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stormgrid.functions import geo

lat = st.floats(min_value=-89.9, max_value=89.9, allow_nan=False)
lon = st.floats(min_value=-180.0, max_value=180.0, allow_nan=False)
row = st.tuples(lat, lon, lat, lon, lat, lon)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=50, max_size=120))
def test_segment_distance_bounds(spark, rows):
    df = spark.createDataFrame(rows, "lat double, lon double, a_lat double, a_lon double, "
                                     "b_lat double, b_lon double")
    stg = (geo.unit_vector_stages("p", "lat", "lon") + geo.unit_vector_stages("a", "a_lat", "a_lon")
           + geo.unit_vector_stages("b", "b_lat", "b_lon") + geo.segment_prep_stages("s", "a", "b")
           + geo.segment_distance_stages("d", "p", "s", "a", "b")
           + [("lb", geo.lower_bound_expr("p", "s", "a", "b"))])
    out = geo.apply_stages(df, stg).select("d", "d_da", "d_db", "lb").collect()
    for r in out:
        assert r.d is not None and r.d >= 0.0
        assert r.d <= r.d_da + 1e-6 and r.d <= r.d_db + 1e-6
        assert r.d <= 20_040_000.0        # never more than half a meridian
        assert r.lb <= r.d + 1e-6         # the arc lower bound is safe


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(lat, lon, lat, lon), min_size=50, max_size=120))
def test_pair_distance_and_lower_bound(spark, rows):
    df = spark.createDataFrame(rows, "lat1 double, lon1 double, lat2 double, lon2 double")
    stg = (geo.unit_vector_stages("p", "lat1", "lon1") + geo.unit_vector_stages("q", "lat2", "lon2")
           + geo.distance_stages("d", "p", "q") + geo.distance_stages("r", "q", "p")
           + [("lb", geo.lower_bound_expr("p", None, "q"))])
    for r in geo.apply_stages(df, stg).select("d", "r", "lb").collect():
        assert r.d == pytest.approx(r.r, rel=1e-9, abs=1e-6)     # symmetric
        assert r.lb <= r.d + 1e-6                                # the rejection bound is safe
