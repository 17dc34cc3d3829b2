"""Spatial properties of the distance expressions and the cell join."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.functions import geo
from stormgrid.operators import search as S


def vincenty(lat1, lon1, lat2, lon2):
    """Reference ellipsoidal distance (inverse Vincenty) for tests."""
    a, f = geo.WGS84_A, geo.WGS84_F
    b = a * (1 - f)
    L = math.radians(lon2 - lon1)
    U1 = math.atan((1 - f) * math.tan(math.radians(lat1)))
    U2 = math.atan((1 - f) * math.tan(math.radians(lat2)))
    sU1, cU1, sU2, cU2 = math.sin(U1), math.cos(U1), math.sin(U2), math.cos(U2)
    lam = L
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(cU2 * sl, cU1 * sU2 - sU1 * cU2 * cl)
        if ss == 0:
            return 0.0
        cs = sU1 * sU2 + cU1 * cU2 * cl
        sig = math.atan2(ss, cs)
        sa = cU1 * cU2 * sl / ss
        c2a = 1 - sa * sa
        c2m = cs - 2 * sU1 * sU2 / c2a if c2a else 0.0
        C = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        prev = lam
        lam = L + (1 - C) * f * sa * (sig + C * ss * (c2m + C * cs * (-1 + 2 * c2m * c2m)))
        if abs(lam - prev) < 1e-12:
            break
    u2 = c2a * (a * a - b * b) / (b * b)
    A = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    B = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    ds = B * ss * (c2m + B / 4 * (cs * (-1 + 2 * c2m * c2m) - B / 6 * c2m * (-3 + 4 * ss * ss)
                                  * (-3 + 4 * c2m * c2m)))
    return b * A * (sig - ds)


def _pair_frame(spark, pairs):
    df = spark.createDataFrame(pairs, "lat1 double, lon1 double, lat2 double, lon2 double")
    st = geo.point_prep_stages("a", "lat1", "lon1") + geo.point_prep_stages("b", "lat2", "lon2")
    return df, st


@pytest.mark.parametrize("model", ["spheroid", "sphere"])
def test_identity_and_symmetry(spark, model):
    pairs = [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 1.0), (45.0, 179.9, 45.0, -179.9),
             (89.9, 0.0, 89.9, 180.0), (-33.0, 151.0, 51.5, -0.1)]
    df, st = _pair_frame(spark, pairs)
    st += geo.distance_stages("d_ab", "a", "b", model) + geo.distance_stages("d_ba", "b", "a", model)
    rows = geo.apply_stages(df, st).select("d_ab", "d_ba").collect()
    assert rows[0]["d_ab"] == 0.0
    for r in rows:
        assert r["d_ab"] == pytest.approx(r["d_ba"], rel=1e-12, abs=1e-6)


def test_spheroid_close_to_vincenty(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(300):
        lat1, lon1 = rng.uniform(-80, 80), rng.uniform(-180, 180)
        lat2 = float(np.clip(lat1 + rng.uniform(-20, 20), -89, 89))
        lon2 = float(((lon1 + rng.uniform(-25, 25) + 180) % 360) - 180)
        pairs.append((float(lat1), float(lon1), lat2, lon2))
    df, st = _pair_frame(spark, pairs)
    st += geo.distance_stages("d", "a", "b", "spheroid")
    got = [r["d"] for r in geo.apply_stages(df, st).select("d").collect()]
    for (a, b, c, d), g in zip(pairs, got):
        ref = vincenty(a, b, c, d)
        assert abs(g - ref) <= 5.0 + 2e-6 * ref, (a, b, c, d, g, ref)


def test_degree_lengths(spark):
    df, st = _pair_frame(spark, [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0)])
    st += geo.distance_stages("d", "a", "b", "spheroid")
    d_lon, d_lat = [r["d"] for r in geo.apply_stages(df, st).collect()]
    assert d_lon == pytest.approx(111319.49, abs=1.0)   # equator, one degree of longitude
    assert d_lat == pytest.approx(110574.39, abs=2.0)   # meridian at the equator


def _segment_distance(spark, rows):
    df = spark.createDataFrame(rows, "lat double, lon double, a_lat double, a_lon double, "
                                     "b_lat double, b_lon double")
    st = (geo.unit_vector_stages("p", "lat", "lon") + geo.unit_vector_stages("a", "a_lat", "a_lon")
          + geo.unit_vector_stages("b", "b_lat", "b_lon") + geo.segment_prep_stages("s", "a", "b")
          + geo.segment_distance_stages("d", "p", "s", "a", "b"))
    out = geo.apply_stages(df, st).select("d", "d_da", "d_db", "d_in").collect()
    return out


def test_segment_distance_properties(spark):
    rows = [
        (1.0, 10.0, 0.0, 0.0, 0.0, 20.0),        # foot inside, 1 degree north of the equator
        (0.0, 30.0, 0.0, 0.0, 0.0, 20.0),        # beyond B: endpoint distance
        (0.0, 180.0, 0.5, 179.0, -0.5, -179.0),  # crosses the antimeridian; site at the midpoint
        (5.0, 5.0, 3.0, 3.0, 3.0, 3.0),          # repeated fix
    ]
    out = _segment_distance(spark, rows)
    for r in out:
        assert r["d"] <= r["d_da"] + 1e-9 and r["d"] <= r["d_db"] + 1e-9
    assert out[0]["d_in"] and out[0]["d"] == pytest.approx(110574.39 * 1.0, rel=2e-3)
    assert not out[1]["d_in"] and out[1]["d"] == pytest.approx(out[1]["d_db"])
    assert out[2]["d"] < 1.0 and out[2]["d_in"]  # the site sits on the arc
    assert out[3]["d"] == pytest.approx(out[3]["d_da"])


@pytest.mark.parametrize("salt_path", [False, True])
def test_cell_join_equals_brute_force(spark, salt_path):
    """Cell join == cross join on a fixture with poles, antimeridian and mixed radii."""
    rng = np.random.default_rng(11)
    sites = [(1, 0.0, 179.9, 300000.0), (2, 89.5, 10.0, 500000.0), (3, -89.0, -120.0, 2000000.0),
             (4, 10.0, -179.95, 100000.0), (5, 45.0, 45.0, 5000000.0), (6, 0.0, 0.0, 12000000.0),
             (40, 5.5, -179.9, 200000.0)]
    for k in range(7, 40):
        sites.append((k, float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180)),
                      float(rng.choice([50000, 100000, 200000, 500000, 2000000]))))
    segs = []
    for sid in range(60):
        lat, lon = float(rng.uniform(-88, 88)), float(rng.uniform(-180, 180))
        for seq in range(1, 8):
            lat2 = float(np.clip(lat + rng.uniform(-6, 6), -89.9, 89.9))
            lon2 = float(((lon + rng.uniform(-8, 8) + 180) % 360) - 180)
            segs.append((f"S{sid}", seq, lat, lon, lat2, lon2))
            lat, lon = lat2, lon2
    segs.append(("POLE", 1, 89.0, 0.0, 89.0, 180.0))      # over the pole
    segs.append(("DATE", 1, 5.0, 179.0, 6.0, -179.0))     # across the antimeridian
    sdf = spark.createDataFrame(sites, "site_id long, lat double, lon double, radius_m double")
    gdf = spark.createDataFrame(segs, "sid string, seq long, a_lat double, a_lon double, "
                                      "b_lat double, b_lon double")
    if salt_path:
        spark.conf.set("stormgrid.broadcastSiteCells", "0")
    try:
        got = {(r.site_id, r.sid): r.dist_m for r in
               S.segment_pairs_within(gdf, sdf).groupBy("site_id", "sid")
               .agg(F.min("dist_m").alias("dist_m")).collect()}
    finally:
        spark.conf.unset("stormgrid.broadcastSiteCells")
    cross = sdf.crossJoin(gdf)
    st = (geo.unit_vector_stages("p", "lat", "lon") + geo.unit_vector_stages("a", "a_lat", "a_lon")
          + geo.unit_vector_stages("b", "b_lat", "b_lon") + geo.segment_prep_stages("s", "a", "b")
          + geo.segment_distance_stages("dist_m", "p", "s", "a", "b"))
    ref = {(r.site_id, r.sid): r.dist_m for r in
           geo.fenced_filter(geo.apply_stages(cross, st, fence=True), F.col("dist_m") <= F.col("radius_m"))
           .groupBy("site_id", "sid")
           .agg(F.min("dist_m").alias("dist_m")).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        assert got[k] == pytest.approx(ref[k], rel=1e-12)
    assert any(k[1] == "POLE" for k in ref) and any(k[1] == "DATE" for k in ref)


def test_point_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    sites = [(1, 0.0, 179.9, 300000.0), (2, 89.5, 10.0, 800000.0), (3, -60.0, -170.0, 2500000.0)]
    sites += [(k, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180)), 700000.0)
              for k in range(4, 30)]
    pts = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(3000)]
    pts += [(5000, 0.0, -179.99), (5001, 90.0, 0.0)]
    sdf = spark.createDataFrame(sites, "site_id long, lat double, lon double, radius_m double")
    pdf = spark.createDataFrame(pts, "pid long, lat double, lon double")
    got = {(r.site_id, r.pid) for r in S.points_within(pdf, sdf, ["pid"]).collect()}
    cross = sdf.crossJoin(pdf.withColumnRenamed("lat", "q_lat").withColumnRenamed("lon", "q_lon"))
    st = (geo.point_prep_stages("p", "lat", "lon") + geo.point_prep_stages("q", "q_lat", "q_lon")
          + geo.distance_stages("d", "p", "q"))
    ref = {(r.site_id, r.pid) for r in
           geo.fenced_filter(geo.apply_stages(cross, st, fence=True), F.col("d") <= F.col("radius_m")).collect()}
    assert got == ref
    assert (1, 5000) in ref and (2, 5001) in ref
