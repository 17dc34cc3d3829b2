"""Counts from cells: equal to counting pairs, and rows that grow with the border."""

import random

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import counts as C
from stormgrid.operators import search as S


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(13)
    at = [(90.0, 0.0, 5e5), (-90.0, 10.0, 3e6), (0.0, 180.0, 4e5), (5.0, -180.0, 9e5), (10.0, 20.0, 2.1e7), (-60.0, 179.9, 1.2e7), (0.0, 0.0, 1e3),
          (91.0, 0.0, 1e5), (None, 0.0, 1e5), (0.0, 0.0, -5.0)]
    at += [(rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(4, 6.6)) for _ in range(30)]
    return spark.createDataFrame([(k, *a) for k, a in enumerate(at)], "site_id long, lat double, lon double, radius_m double")


def counted(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("model", ["spheroid", "sphere"])
def test_counts_equal_pairs(spark, sites, model):
    rng = random.Random(14)
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(4000)] + [(rng.gauss(10, 3), rng.gauss(20, 3)) for _ in range(4000)]
    at += [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (0.0, -180.0), (None, 1.0), (95.0, 1.0), (1.0, None)]
    points = spark.createDataFrame([(k, *a) for k, a in enumerate(at)], "id long, lat double, lon double")
    want = counted(S.result_count(sites, S.points_within(points, sites, ["id"], model), "n"))
    assert counted(C.points_counted(points, sites, "n", model)) == want and sum(n for _, n in want) > 10_000
    for steps in (0,):
        assert counted(C.points_counted(points, sites, "n", model, steps=steps)) == want
    assert counted(C.points_counted(points.limit(0), sites, "n", model)) == [(i, 0) for i, _ in want]
    assert C.points_counted(points, sites.limit(0), "n", model).count() == 0


def test_cover_is_whole_or_border(spark, sites):
    """Every point within the radius lies in one cell of the cover; those of whole cells are within."""
    one = sites.filter("site_id = 14")
    cells = C.cover(one).cache()
    grid = spark.range(361 * 181).select(F.col("id"), (F.floor(F.col("id") / 361) - 90).cast("double").alias("lat"), (F.col("id") % 361 - 180).cast("double").alias("lon"))
    placed = grid.crossJoin(F.broadcast(cells.select("k").distinct())).withColumn("cell", C.place(F.col("k"), F.col("lat"), F.col("lon")))
    got = placed.join(cells.select("k", "cell", "whole"), ["k", "cell"]).groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("whole").alias("whole"))
    near = {r.id for r in S.points_within(grid, one, ["id"]).select("id").collect()}
    rows = {r.id: r for r in got.collect()}
    assert near <= set(rows) and all(r.c == 1 for r in rows.values())
    assert {i for i, r in rows.items() if r.whole} <= near


def test_rows_grow_with_the_border(spark):
    """Points deep inside all circles (some degrees from the border) hardly meet an exact distance; covers do not grow with area."""
    rng = random.Random(15)
    sites = spark.createDataFrame([(k, 0.0, 46.0 + 0.8 * k, 1e6) for k in range(10)], "site_id long, lat double, lon double, radius_m double")
    dense = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(50, 1)) for _ in range(20_000)], "lat double, lon double")
    cells = C.cover(sites)
    wide = C.cover(sites.withColumn("radius_m", F.lit(4e6)))
    assert wide.count() < 3 * cells.count()  # sixteen times the area
    border = cells.filter("not whole").select("site_id", "k", "cell")
    levels = dense.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(C.LEVELS)))))
    met = levels.withColumn("cell", C.place(F.col("k"), F.col("lat"), F.col("lon"))).join(border, ["k", "cell"]).count()
    total = sum(r.n for r in C.points_counted(dense, sites, "n").collect())
    assert total > 190_000 and met < total / 20


def test_totals_roll_up(spark):
    points = spark.createDataFrame([(1.0, 2.0)] * 5 + [(-89.9, -179.9)] * 2 + [(90.0, 180.0)], "lat double, lon double")
    rows = {(r.k, r.cell): r.total for r in C.totals(points, "lat", "lon").collect()}
    for k in range(C.LEVELS):
        got = points.select(C.place(F.lit(k), F.col("lat"), F.col("lon")).alias("cell")).groupBy("cell").count().collect()
        assert {c: n for (l, c), n in rows.items() if l == k} == {r["cell"]: r["count"] for r in got}


def test_one_row_a_site(spark, sites, monkeypatch):
    """Whatever the groups, chunks and parts, a site leaves its tile as one row, with the count of the pairs; a site that comes twice counts twice."""
    from stormgrid.operators import blocks as B

    rng = random.Random(16)
    at = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(1500)] + [(rng.gauss(0, 1), rng.gauss(180, 1)) for _ in range(1500)] + [(0.0, 179.9)] * 40 + [(-90.0, 0.0), (90.0, 7.0)]
    points = spark.createDataFrame([(k, a, (b + 180) % 360 - 180) for k, (a, b) in enumerate(at)], "id long, lat double, lon double")
    want = sorted((r.site_id, r.n) for r in S.result_count(sites, S.points_within(points, sites, ["id"]), "n").collect() if r.n)
    for chunk, piece, parts, size in ((262_144, 4096, 16_384, 2.0), (50, 7, 3, 30.0)):
        for name, v in (("BUCKET_ELEMENTS", chunk), ("PIECE", piece), ("TILE_SITES", parts)):
            monkeypatch.setattr(B, name, v)
        met = B.points_met(points, sites, F.floor(F.col("lat") / size) * 1000 + F.floor(F.col("lon") / size))
        assert counted(met) == want
    twice = C.points_counted(points, sites.union(sites.filter("site_id = 12")), "n").filter("site_id = 12").collect()
    assert [r.n for r in twice] == [2 * dict(want).get(12, 0)] * 2
