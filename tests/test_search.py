"""Search semantics on the derived tables (sf0.001) and small fixtures."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from stormgrid.functions import geo
from stormgrid.operators import results as R
from stormgrid.operators import search as S
from stormgrid.operators import stats as ST
from stormgrid.operators import tracks as T
from stormgrid.plans import views as V
from stormgrid.sources import export as EX

from sample_data import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    obs = V.observations(spark, SF_SMALL)
    return {"obs": obs, "tracks": T.build_tracks(obs), "sites": V.sites(spark, SF_SMALL),
            "events": V.tsunami_events(spark, SF_SMALL)}


def test_nearest_storm_is_global_minimum(spark, data):
    near = {r.site_id: r for r in S.nearest_storm(data["obs"], data["tracks"], data["sites"]).collect()}
    hits = {r.site_id for r in S.tracks_within(data["obs"], data["sites"]).collect()}
    assert near and not (set(near) & hits)
    seg = T.track_segments(data["obs"])
    cross = data["sites"].filter(F.col("site_id").isin(list(near))).crossJoin(seg)
    st = (geo.unit_vector_stages("p", "lat", "lon") + geo.unit_vector_stages("a", "a_lat", "a_lon")
          + geo.unit_vector_stages("b", "b_lat", "b_lon") + geo.segment_prep_stages("s", "a", "b")
          + geo.segment_distance_stages("d", "p", "s", "a", "b"))
    best = (geo.apply_stages(cross, st).groupBy("site_id")
            .agg(F.min(F.struct("d", "sid")).alias("b")).collect())
    for r in best:
        assert near[r.site_id].storm_id == r.b.sid
        assert near[r.site_id].distance_km == pytest.approx(round(r.b.d / 1000, 2))


def test_shuffle_path_equals_broadcast(spark, data):
    a = S.storms_near(data["obs"], data["tracks"], data["sites"]).collect()
    spark.conf.set("stormgrid.broadcastSiteCells", "0")
    try:
        b = S.storms_near(data["obs"], data["tracks"], data["sites"]).collect()
    finally:
        spark.conf.unset("stormgrid.broadcastSiteCells")
    assert sorted(a) == sorted(b) and len(a) > 0


def test_api_conventions_and_counts(spark, data):
    hits = S.cyclone_search(data["obs"], data["tracks"], data["sites"])
    for r in hits.limit(200).collect():
        assert r.max_wind_speed is None or r.max_wind_speed > 0
        assert r.basin != "" and r.cyclone_name
    rc = S.result_count(data["sites"], S.tracks_within(data["obs"], data["sites"]))
    assert rc.count() == data["sites"].count()
    assert rc.filter("cyclones_found = 0").count() > 0


def test_year_range_and_sorts(spark):
    df = spark.createDataFrame(
        [(1, "a", 1990, 10.0, 50), (1, "b", None, 5.0, None), (1, "c", 0, 7.0, 0), (1, "d", 2001, 1.0, 80)],
        "site_id long, storm_id string, year int, distance_km double, max_wind_speed int")
    assert R.year_range(df).count() == 4
    assert {r.storm_id for r in R.year_range(df, 1980, None).collect()} == {"a", "d"}
    assert {r.storm_id for r in R.year_range(df, 0, 2000).collect()} == {"a", "c"}
    order = [r.storm_id for r in R.sort_results(df, "windspeed").collect()]
    assert order == ["d", "a", "b", "c"]        # missing/0 last, then by distance
    ranks = {r.storm_id: r.rank for r in R.ranked_results(df, "year").collect()}
    assert ranks["d"] == 1 and ranks["a"] == 2


def test_wind_buckets_rounding(spark):
    df = spark.createDataFrame([(1, 33), (1, 34), (1, None), (1, 96), (2, None)],
                               "site_id long, max_wind_speed int")
    b = {r.site_id: r for r in ST.wind_buckets(df).collect()}
    assert (b[1].weak, b[1].moderate, b[1].strong, b[1].very_strong, b[1].na) == (1, 1, 0, 1, 1)
    assert b[1].avg_wind == 54 and b[1].max_wind == 96 and b[1].weak_pct == 25.0
    assert b[2].avg_wind is None and b[2].max_wind == 0


def test_csv_export_files(spark, data, tmpdir_path):
    hits = S.cyclone_search(data["obs"], data["tracks"], data["sites"])
    lines = EX.cyclone_csv_lines(hits, EX.track_wkt(data["obs"]))
    out = os.path.join(tmpdir_path, "cyclones")
    EX.write_csv_export(lines, EX.CYCLONE_CSV_HEADER, out, ["distance_km", "storm_id"],
                        meta=EX.cyclone_csv_meta(data["sites"], hits))
    one = sorted(glob.glob(os.path.join(out, "site_id=*", "*.txt")))[0]
    text = open(one).read().splitlines()
    assert text[0].startswith("# Search Location,Lat: ") and text[3] == ""
    assert text[4] == EX.CYCLONE_CSV_HEADER
    assert text[5].count('"LINESTRING(') == 1
    assert not glob.glob(out + "._*")


def test_events_near_validity_and_rounding(spark, data):
    ev = S.events_near(data["events"], data["sites"])
    assert ev.filter("event_validity < 2").count() == 0
    assert ev.filter("distance_km != rint(distance_km)").count() == 0
    ts = S.tsunami_search(data["events"], data["sites"])
    assert ts.filter("distance_km = 0 or earthquake_magnitude = 0").count() == 0


@pytest.mark.parametrize("hot_rows", [0, None])
def test_rank_within_hot_group(spark, hot_rows):
    from stormgrid.operators.layout import rank_within
    rows = [(1, i, float((i * 37) % 101)) for i in range(500)] + [(2, i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "site_id long, storm_id long, distance_km double")
    got = {(r.site_id, r.storm_id): r.rank for r in
           rank_within(df, "site_id", [F.asc("distance_km"), F.asc("storm_id")], hot_rows=hot_rows,
                       chunks=6).collect()}
    import pandas as pd
    p = pd.DataFrame(rows, columns=["site_id", "storm_id", "distance_km"])
    p = p.sort_values(["site_id", "distance_km", "storm_id"])
    p["rank"] = p.groupby("site_id").cumcount() + 1
    assert got == {(a, b): c for a, b, c in zip(p.site_id, p.storm_id, p["rank"])}


def test_sql_views(spark, data):
    from stormgrid.plans import sql as Q
    Q.register_tables(spark, data["obs"], data["events"], data["tracks"])
    data["sites"].createOrReplaceTempView("sites")
    spark.createDataFrame([("S8-1",), ("nope",)], "sid string").createOrReplaceTempView("storm_ids")
    spark.sql("select id from tsunami_events limit 3").createOrReplaceTempView("event_ids")
    Q.register_functions(spark)
    n = spark.sql("select count(*) from cyclones_near").first()[0]
    assert n == S.storms_near(data["obs"], data["tracks"], data["sites"]).count()
    assert spark.sql("select count(*) from tsunami_event").first()[0] == 3
    assert spark.sql("select count(*) from tsunamis_near").first()[0] >= 0
    g = spark.sql("select * from cyclone_track").collect()
    assert all(r.geojson.startswith('{"type":"LineString"') for r in g)


def test_materialized_tables(spark, data, tmpdir_path):
    from stormgrid.sources.tables import materialize_storm_tables
    t = materialize_storm_tables(data["obs"], os.path.join(tmpdir_path, "store"))
    assert t["points"].count() == data["obs"].count()
    assert t["tracks"].count() == data["tracks"].count()
    assert t["segments"].count() == T.track_segments(data["obs"]).count()
    assert os.path.isdir(os.path.join(tmpdir_path, "store", "cyclone_points"))
    assert not glob.glob(os.path.join(tmpdir_path, "store", "*._*"))
    a = sorted(S.storms_near(t["points"], t["tracks"], data["sites"], segments=t["segments"]).collect())
    b = sorted(S.storms_near(data["obs"], data["tracks"], data["sites"]).collect())
    assert a == b
