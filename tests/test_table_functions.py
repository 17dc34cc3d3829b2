"""SQL table functions: arguments, defaults, errors, plans; track lines."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sample_data import SF_SMALL
from stormgrid.operators import results as R
from stormgrid.operators import search as S
from stormgrid.operators import tracks as T
from stormgrid.plans import table_functions as TF
from stormgrid.plans import views as V
from stormgrid.sources import export as EX
from stormgrid.sources import tables as TB


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    obs, events = V.observations(spark, SF_SMALL), V.tsunami_events(spark, SF_SMALL)
    tables = TB.materialize_storm_tables(obs, str(tmp_path_factory.mktemp("functions")))
    spark.sparkContext.setJobGroup("declare", "declaring the functions")
    TF.register(spark, tables, events)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("declare")
    spark.sparkContext.setJobGroup("tests", "tests")
    return {"obs": obs, "events": events, "tables": tables, "jobs": list(jobs)}


def rows(df):
    return sorted(map(str, df.collect()))


def site(spark, lat, lon, radius):
    return spark.createDataFrame([(1, lat, lon, radius)], "site_id long, lat double, lon double, radius_m double")


def test_no_job_at_registration(data):
    assert data["jobs"] == []


@pytest.mark.parametrize("lat, lon, radius", [(10.0, 20.0, 2e6), (0.0, 180.0, 3e6), (90.0, 0.0, 5e6), (-35.5, -179.9, 9e5)])
def test_searches_with_literals(spark, data, lat, lon, radius):
    one = site(spark, lat, lon, radius)
    want = S.storms_near(data["obs"], data["tables"]["tracks"], one, segments=data["tables"]["segments"]).drop("site_id")
    got = spark.sql(f"select * from find_cyclones_near_point({lat}d, {lon}d, {radius}d)")
    assert got.columns == want.columns and rows(got) == rows(want)
    want = S.events_near(data["events"], one).drop("site_id")
    got = spark.sql(f"select * from find_tsunamis_near_point({lat}d, {lon}d, {radius}d)")
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_default_radii(spark, data):
    lat, lon = data["obs"].select("lat", "lon").first()
    got = spark.sql(f"select * from find_cyclones_near_point({lat}d, {lon}d)")
    assert rows(got) == rows(spark.sql(f"select * from find_cyclones_near_point({lat}d, {lon}d, 100000)")) and got.count() > 0
    assert rows(spark.sql("select * from find_tsunamis_near_point(10, 20)")) == rows(spark.sql("select * from find_tsunamis_near_point(10, 20, 500000)"))


def test_order_of_the_callers_query(spark, data):
    got = [r.distance_km for r in spark.sql("select * from find_tsunamis_near_point(10, 20, 3000000) order by distance_km limit 5").collect()]
    assert len(got) == 5 and got == sorted(got)


@pytest.mark.parametrize("call, message", [
    ("find_cyclones_near_point(90.5, 0)", "Latitude out of range: 90.5"), ("find_cyclones_near_point(0, -181)", "Longitude out of range: -181"),
    ("find_tsunamis_near_point(-91, 0)", "Latitude out of range"), ("find_tsunamis_near_point(0, 'NaN')", "Longitude out of range")])
def test_out_of_range_raises(spark, data, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"select * from {call}").collect()


def test_null_arguments_and_radii_find_nothing(spark, data):
    for call in ("find_cyclones_near_point(null, 0)", "find_cyclones_near_point(0, null)", "find_cyclones_near_point(0, 0, null)", "find_cyclones_near_point(0, 0, -1)",
                 "find_tsunamis_near_point(null, 0)", "find_tsunamis_near_point(0, 0, 0)", "get_cyclone_track(null)", "get_cyclone_track('none')", "get_tsunami_event(-1)"):
        assert spark.sql(f"select * from {call}").collect() == []


def test_lateral_plan_has_no_nested_loops(spark, data):
    V.sites(spark, SF_SMALL).createOrReplaceTempView("some_sites")
    for name in ("find_cyclones_near_point", "find_tsunamis_near_point"):
        df = spark.sql(f"select s.site_id, f.* from some_sites s, lateral {name}(s.lat, s.lon, s.radius_m) f")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan


def test_lookups(spark, data):
    ids = data["obs"].select("sid").distinct().limit(20)
    ids.createOrReplaceTempView("some_ids")
    got = spark.sql("select f.* from some_ids s, lateral get_cyclone_track(s.sid) f")
    assert rows(got) == rows(EX.track_geojson(data["obs"], data["tables"]["tracks"], ids))
    one = got.first()
    assert rows(spark.sql(f"select * from get_cyclone_track('{one.sid}')")) == [str(one)]
    assert json.loads(one.geojson)["type"] == "LineString"
    event = data["events"].select("id").first()[0]
    want = R.event_detail(data["events"].filter(F.col("id") == event))
    got = spark.sql(f"select * from get_tsunami_event({event})")
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_track_line_pieces(spark, data):
    """A long storm is cut at multiples of PIECE; text from stored pieces equals text from points."""
    n = 2 * T.PIECE + 7
    start = dt.datetime(2001, 1, 1)
    fixes = [("L", start + dt.timedelta(hours=k), 10 + k / 1000, 20 + k / 500) for k in range(n)] + [("M", start, 1.0, 2.0), ("M", start, None, 2.0)]
    points = spark.createDataFrame(fixes, "sid string, iso_time timestamp_ntz, lat double, lon double").repartition(5)
    lines = T.track_line(points)
    got = {(r.sid, r.piece): r for r in lines.collect()}
    assert {k: r.n_points for k, r in got.items()} == {("L", 0): T.PIECE, ("L", 1): T.PIECE, ("L", 2): 7, ("M", 0): 1}
    assert [f.iso_time for k in range(3) for f in got["L", k].line] == [start + dt.timedelta(hours=k) for k in range(n)]
    assert rows(EX.track_wkt(points, lines)) == rows(EX.track_wkt(points))
    text = EX.track_wkt(points).filter("storm_id = 'L'").first().track_wkt
    assert text == "LINESTRING(" + ", ".join(f"{20 + k / 500:.4f} {10 + k / 1000:.4f}" for k in range(n)) + ")"
    reported = EX.line_pieces(lines).filter("sid = 'L' and piece = 2").first()
    assert (reported.start_time, reported.end_time) == (start + dt.timedelta(hours=2 * T.PIECE), start + dt.timedelta(hours=n - 1))
