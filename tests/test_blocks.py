"""Counts and samples from blocks: equal to those from pairs."""

import random

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import blocks as B
from stormgrid.operators import risk as RK
from stormgrid.operators import search as S
from stormgrid.operators.tracks import track_segments


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        lat, lon = rng.uniform(-85, 85), rng.uniform(-180, 180)
        for t in range(rng.choice([1, 2, 7, 12])):
            rows.append((len(rows), f"S{k}" if k else None, t, lat, lon, rng.choice([None, 0, 20, 45, 45, 90, 999])))
            lat, lon = max(-90.0, min(90.0, lat + rng.uniform(-2, 2))), (lon + rng.uniform(-3, 3) + 180) % 360 - 180
    rows += [(9001, "far", 0, 0.0, 10.0, 50), (9002, "far", 1, 0.0, -170.0, 60), (9003, "pole", 0, 90.0, 0.0, 70), (9004, "pole", 1, 80.0, 180.0, 70), (9005, "pole", 2, None, 5.0, 99)]
    return spark.createDataFrame(rows, "obs_id long, sid string, iso_time int, lat double, lon double, wmo_wind int").withColumn(
        "iso_time", F.timestamp_seconds("iso_time")).select("*", *(F.lit(None).cast(k).alias(c) for c, k in (
            ("name", "string"), ("basin", "string"), ("subbasin", "string"), ("season", "int"), ("wmo_pres", "int")))).cache()


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(6)
    at = [(90.0, 0.0, 5e5), (-90.0, 10.0, 3e6), (0.0, 180.0, 4e5), (5.0, -180.0, 9e5), (10.0, 20.0, 2.1e7), (-60.0, 179.9, 1.2e7), (0.0, 0.0, 1e3), (20.0, 20.0, 1.7e7),
          (91.0, 0.0, 1e5), (None, 0.0, 1e5), (0.0, 0.0, -5.0), (0.0, 0.0, 3e6), (0.0, 0.0, 3e6)]
    at += [(rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(4.5, 6.6)) for _ in range(60)]
    rows = [(k if k != 12 else 11, *a) for k, a in enumerate(at)]
    rows += [(20, 1.0, 2.0, 2e6), (20, 50.0, 60.0, 2e6), (None, 10.0, 10.0, 2e6)]  # an id with several places, a missing one
    return spark.createDataFrame(rows, "site_id long, lat double, lon double, radius_m double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("model", ["spheroid"])
def test_blocks_equal_pairs(spark, points, sites, model, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ELEMENTS", 64)
    monkeypatch.setattr(B, "BUCKET_ELEMENTS", 800)
    monkeypatch.setattr(B, "TILE_SITES", 40)
    monkeypatch.setattr(B, "PIECE", 5)
    hits = S.tracks_within(points, sites, model)
    want = rows(hits.groupBy("site_id").agg(F.count(F.lit(1))))
    assert rows(B.storms_counted(points, sites, None, model).groupBy("site_id").agg(F.sum("n"))) == want and len(want) > 30
    keys = points.groupBy("sid").agg(F.max("wmo_wind").alias("key"))
    got = B.storms_counted(points, sites, keys, model).groupBy("site_id", "key").agg(F.sum("n"))
    assert rows(got) == rows(hits.join(keys, "sid").groupBy("site_id", "key").agg(F.count(F.lit(1))))
    assert rows(B.storms_met(track_segments(points), sites, model)) == rows(hits.select("sid").distinct())
    maxima = RK.storm_block_maxima(points, sites, model)
    got = B.maxima_counted(points, sites, model).groupBy("site_id", "max_wind").agg(F.sum("cnt"))
    assert rows(got) == rows(maxima.groupBy("site_id", "max_wind").agg(F.count(F.lit(1))))
    assert rows(B.maxima_pairs(points, sites, model)) == rows(maxima)
    counted = B.maxima_counted(points, sites, model)
    for f in (RK.sample_stats, RK.wind_percentiles, RK.wind_histogram):
        assert rows(f(counted)) == rows(f(maxima))


def test_no_pairs_are_shuffled(spark, points):
    """Rows that enter an exchange follow sites and storms, not their product."""
    sites = spark.createDataFrame([(k, (k % 50) * 0.1, (k // 50) * 0.1, 2e7) for k in range(2500)], "site_id long, lat double, lon double, radius_m double")
    counted = B.storms_counted(points, sites)
    storms = points.filter("sid is not null").groupBy("sid").count().filter("count > 1").count()
    assert counted.count() <= 2500
    total = S.result_count(sites, counted, weight="n").agg(F.sum("cyclones_found")).first()[0]
    assert total >= 2500 * storms * 0.9


def test_empty(spark, points, sites):
    assert B.storms_counted(points.limit(0), sites).count() == 0
    assert B.storms_counted(points, sites.limit(0)).count() == 0
    assert B.maxima_counted(points.limit(0), sites).count() == 0 and B.maxima_pairs(points.limit(0), sites).count() == 0


def test_chunks_of_whole_storms(spark, points, sites, monkeypatch):
    """Chunks as small as a storm, and parts of a tile, change nothing; a site's sample is one row that nothing exchanges."""
    want = rows(B.samples(points, sites))
    pairs = rows(B.maxima_pairs(points, sites))
    monkeypatch.setattr(B, "BUCKET_ELEMENTS", 3)
    monkeypatch.setattr(B, "TILE_SITES", 2)
    got = B.samples(points, sites)
    assert rows(got) == want and len({r[0] for r in want}) == len(want) > 30
    assert rows(B.maxima_pairs(points, sites)) == pairs
    samples = RK.site_samples(B.samples(points, sites.filter("site_id <> 20")))
    assert rows(samples) == rows(RK.site_samples(RK.storm_block_maxima(points, sites.filter("site_id <> 20"))))
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[:plan.index("MapInArrow")]


def test_sites_are_sent_once(spark, points):
    """What is exchanged for a tile: its sites once, and the pieces of storms once a tile, not once for each other's count."""
    sent = []
    for n in (1, 40):
        sites = spark.createDataFrame([(k, (k % 50) * 0.1, (k // 50) * 0.1, 2e6) for k in range(50 * n)], "site_id long, lat double, lon double, radius_m double")
        fixes = B._usable_fixes(points)
        left, owns = B._tiled(sites)
        sent.append((left.count(), owns.agg(F.sum("_parts")).first()[0]))
        assert B._pieces(B._placed_fixes(fixes), B._FIX).count() <= fixes.count()
    assert sent == [(50, 1), (2000, 1)]


@pytest.mark.parametrize("model", ["spheroid", "sphere"])
def test_tracks_near_equal_pairs(spark, points, sites, model, monkeypatch):
    """Every pair of the search by cells, with its distance, and what is told of the storm (twice where it is told twice)."""
    monkeypatch.setattr(B, "BUCKET_ELEMENTS", 100)
    about = points.groupBy(F.col("sid").alias("storm_id")).agg(F.count(F.lit(1)).alias("n"), F.max("iso_time").alias("t"))
    about = about.unionByName(about.filter("storm_id in ('S3', 'pole')"))
    near = S.tracks_within(points, sites, model)
    want = rows(near.join(about, near.sid == about.storm_id).select("site_id", F.round("dist_m", 4), "storm_id", "n", "t"))
    got = B.tracks_near(track_segments(points), sites, about, model)
    assert got.columns == ["site_id", "dist_m", "storm_id", "n", "t"]
    assert rows(got.select("site_id", F.round("dist_m", 4), "storm_id", "n", "t")) == want and len(want) > 300


def test_search_by_blocks_and_by_cells(spark, points, sites):
    """Rows, columns and exports are the same by either way; no exchange follows the pairs of the blocks."""
    from stormgrid.operators import results as R
    from stormgrid.operators.tracks import build_tracks
    from stormgrid.sources import export as EX

    pts = points.withColumn("dist2land", (F.col("obs_id") % 50 - 5).cast("int"))
    tracks, wkt = build_tracks(pts), EX.track_wkt(pts)
    found = []
    try:
        for few in ("0", "1000"):
            spark.conf.set("stormgrid.cellSites", few)
            plain = S.cyclone_search(pts, tracks, sites)
            frames = [S.storms_near(pts, tracks, sites), plain, S.cyclone_search(pts, tracks, sites, shape=R.cyclone_row), EX.cyclone_csv_found(pts, tracks, sites, wkt)]
            found.append([(f.columns, rows(f)) for f in frames])
            if few == "0":
                for f in frames:
                    assert "Exchange" not in (plan := f.filter("site_id <> 20")._jdf.queryExecution().executedPlan().toString())[:plan.index("MapInArrow")].replace("BroadcastExchange", "")
            after = [R.cyclone_row(plain), EX.cyclone_csv_lines(plain, wkt)]
            assert [(f.columns, rows(f)) for f in after] == found[-1][2:]
    finally:
        spark.conf.unset("stormgrid.cellSites")
    assert found[0] == found[1] and len(found[0][0][1]) > 200
