"""Track building, ordered segments and positions (incl. a storm spread over many chunks)."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stormgrid.operators import tracks as T

SCHEMA = ("obs_id long, sid string, season int, basin string, subbasin string, name string, "
          "iso_time timestamp_ntz, nature string, lat double, lon double, wmo_wind int, "
          "wmo_pres int, dist2land int")


def _pts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def t(h):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)


def test_build_tracks_rules(spark):
    rows = [
        (1, "A", 2000, "NI", None, "UNNAMED", t(0), "TS", 10.0, 80.0, 30, 1000, 50),
        (2, "A", 2000, "NI", None, "ALPHA", t(6), "TS", 11.0, 81.0, 60, 990, -5),
        (3, "A", None, None, None, "ALPHA", t(12), "TS", 12.0, 82.0, None, None, 20),
        (4, "B", 2001, "SP", None, "BETA", t(0), "TS", -10.0, 170.0, 40, 1000, 10),   # one fix
        (5, "C", 2002, None, None, "GAMMA", t(0), "NR", 0.0, 0.0, None, None, None),
        (6, "C", 2002, None, None, "GAMMA", t(0), "NR", 0.0, 0.0, None, None, None),  # tie, same spot
    ]
    tr = {r.sid: r for r in T.build_tracks(_pts(spark, rows)).collect()}
    assert set(tr) == {"A", "C"}                    # >= 2 fixes
    a = tr["A"]
    assert a.name == "UNNAMED"                       # max() of names: 'UNNAMED' > 'ALPHA' (Q4)
    assert a.season == 2000 and a.basin == "NI"      # nulls ignored (Q5)
    assert a.point_count == 3 and a.max_wind == 60 and a.min_pressure == 990
    assert a.duration_hours == pytest.approx(12.0)
    assert (a.min_lat, a.max_lat, a.min_lon, a.max_lon) == (10.0, 12.0, 80.0, 82.0)
    assert tr["C"].duration_hours == 0.0 and tr["C"].max_wind is None


@pytest.mark.parametrize("hot_rows", [0, None])
def test_segments_and_positions_with_chunks(spark, hot_rows):
    """One hot storm with many fixes: chunked path (hot_rows=0) and plain window path."""
    rows = []
    oid = 0
    for k in range(400):   # the hot storm
        rows.append((oid, "HOT", 2000, "WP", None, "H", t(k * 0.5), "TS", 10 + k * 0.01, 130 + k * 0.02,
                     40 + k % 50, 990, 100)); oid += 1
    for s in range(20):
        for k in range(5):
            rows.append((oid, f"S{s:02d}", 2000, "EP", None, "N", t(k), "TS", float(s), float(k), 50,
                         1000, 5)); oid += 1
    rows.append((oid, "S00", 2000, "EP", None, "N", t(2), "TS", 0.0, 1.5, 50, 1000, 5))  # time tie
    pts = _pts(spark, rows)
    seq = T.sequence_points(pts, carry=["obs_id"], chunks=8, hot_rows=hot_rows)
    got = seq.select("obs_id", "sid", "k", "n", F.col("nxt.iso_time").alias("nt"),
                     F.col("nxt.lon").alias("nlon")).toPandas()
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    pdf = pdf.sort_values(["sid", "iso_time", "lon", "lat"]).reset_index(drop=True)
    pdf["k"] = pdf.groupby("sid").cumcount() + 1
    pdf["n"] = pdf.groupby("sid")["obs_id"].transform("count")
    pdf["nlon"] = pdf.groupby("sid")["lon"].shift(-1)
    m = pdf.merge(got, on="obs_id", suffixes=("", "_g"))
    assert len(m) == len(pdf)
    assert (m["k"] == m["k_g"]).all() and (m["n"] == m["n_g"]).all()
    assert ((m["nlon"] == m["nlon_g"]) | (m["nlon"].isna() & m["nlon_g"].isna())).all()
    segs = T.track_segments(pts)
    assert segs.filter("sid = 'HOT'").count() == 399
    assert segs.count() == 399 + 20 * 4 + 1


def test_obs_position_labels(spark):
    rows = [(i, "A", 2000, "NI", None, "X", t(i), "TS", 1.0, 1.0 + i, 30, 1000, 1) for i in range(3)]
    pos = {r.obs_id: r for r in T.obs_position(_pts(spark, rows)).collect()}
    assert pos[0].position_label == " (Start)" and pos[0].is_first
    assert pos[1].position_label == "" and pos[1].k == 2 and pos[1].n == 3
    assert pos[2].position_label == " (End)" and pos[2].is_last


def test_track_points_conventions(spark):
    rows = [(1, "A", 2000, "NI", None, "X", t(1), "TS", 1.0, 2.0, 0, 0, -3),
            (2, "A", 2000, "NI", None, "X", t(0), "TS", 1.0, 1.0, 45, 990, 7)]
    tp = T.track_points(_pts(spark, rows)).collect()
    assert [r.lon for r in tp] == [1.0, 2.0]                 # time order
    assert tp[1].wind_speed is None and tp[1].pressure is None and tp[1].dist2land is None
    assert tp[0].wind_speed == 45 and tp[0].dist2land == 7
