"""Dataset statistics: single-pass aggregates (partial aggregation map-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C


def cyclone_stats(tracks: DataFrame) -> DataFrame:
    """total tracks, season range, distinct basins, total observations."""
    return tracks.agg(
        F.count(F.lit(1)).alias("total_tracks"),
        F.min("season").alias("earliest_year"),
        F.max("season").alias("latest_year"),
        F.countDistinct("basin").alias("unique_basins"),
        F.sum("point_count").alias("total_observations"))


def basin_distribution(tracks: DataFrame) -> DataFrame:
    """Tracks per basin (null basin is its own group), most first, then by basin."""
    return (tracks.groupBy("basin").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("basin")))


def tsunami_stats(events: DataFrame) -> DataFrame:
    """Counts, year range, mean magnitude (2 dp), tallest wave, total deaths."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_validity") >= 3).alias("reliable_events"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.round(F.avg("earthquake_magnitude"), 2).cast("double").alias("avg_magnitude"),
        F.max("max_water_height").cast("double").alias("max_water_height"),
        F.sum("total_deaths").alias("total_deaths"),
        F.count_if(F.col("max_water_height").isNotNull()).alias("events_with_height"),
        F.count_if(F.col("total_deaths") > 0).alias("events_with_deaths"))


def tsunami_stats_api(events: DataFrame) -> DataFrame:
    """As the stats endpoint reports it: 0 averages, heights and death sums -> null."""
    s = tsunami_stats(events)
    return s.select(
        "total_events", "reliable_events", "year_min", "year_max",
        F.expr("nullif(avg_magnitude, 0)").alias("avg_magnitude"),
        F.expr("nullif(max_water_height, 0)").alias("max_water_height"),
        F.expr("nullif(total_deaths, 0)").alias("total_deaths"),
        "events_with_height", "events_with_deaths")


def top_countries(events: DataFrame, n: int = 10) -> DataFrame:
    """The n countries with most events (null excluded); ties broken by name."""
    return (events.filter(F.col("country").isNotNull()).groupBy("country")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("country")).limit(n))


def cause_distribution(events: DataFrame) -> DataFrame:
    """Events per cause code (null excluded) with the cause label."""
    return (events.filter(F.col("cause_code").isNotNull()).groupBy("cause_code")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("cause_code", C.cause_label("cause_code").alias("label"), "count")
            .orderBy(F.desc("count"), F.asc("cause_code")))


def import_summary(events: DataFrame) -> DataFrame:
    """The tsunami importer's closing summary."""
    return events.agg(
        F.min("year").alias("earliest"),
        F.max("year").alias("latest"),
        F.count_if(F.col("event_validity") >= 3).alias("reliable_events"),
        F.count_if(F.col("max_water_height").isNotNull()).alias("with_height"),
        F.count_if(F.col("total_deaths") > 0).alias("with_deaths"),
        F.round(F.avg("earthquake_magnitude"), 2).cast("double").alias("avg_magnitude"))


def verify_counts(points: DataFrame, tracks: DataFrame, events: DataFrame) -> DataFrame:
    """Post-import counts: observations, distinct storms, tracks, tsunami events."""
    p = points.agg(F.count(F.lit(1)).alias("total_points"),
                   F.countDistinct("sid").alias("unique_storms"))
    t = tracks.agg(F.count(F.lit(1)).alias("total_tracks"))
    e = events.agg(F.count(F.lit(1)).alias("total_tsunamis"))
    return p.crossJoin(t).crossJoin(e)  # three one-row aggregates


def latest_tracks(tracks: DataFrame, n: int = 5) -> DataFrame:
    """Most recent seasons first (ties by storm id)."""
    return (tracks.select("sid", "name", "season", "point_count", "start_time", "end_time")
            .orderBy(F.desc_nulls_last("season"), F.asc("sid")).limit(n))


def wind_buckets(hits: DataFrame, by: str = "site_id", weight: str | None = None) -> DataFrame:
    """Per result set: Weak/Moderate/Strong/Very strong/N/A counts, max, rounded mean.

    ``weight``: the column of ``hits`` that says for how many results a row stands (one each without it).

    ``hits`` are API rows (max_wind_speed null for no data). avg_wind is
    round-half-up of the mean, null when there is no usable wind ('N/A').
    Percent columns are the share of all results, 1 dp.
    """
    w = F.col("max_wind_speed")
    has = w.isNotNull() & (w != 0)
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    count = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0).cast("long")))
    g = hits.groupBy(by).agg(
        count(has & (w < 34)).alias("weak"),
        count(has & (w >= 34) & (w < 64)).alias("moderate"),
        count(has & (w >= 64) & (w < 96)).alias("strong"),
        count(has & (w >= 96)).alias("very_strong"),
        count(~has | w.isNull()).alias("na"),
        F.coalesce(F.max(F.when(has & (w > 0), w)), F.lit(0)).alias("max_wind"),
        F.try_divide(F.sum(F.when(has, w * n)).cast("double"), count(has).cast("double")).alias("mean_wind"),
        count(has).alias("with_data"),
        F.sum(n).alias("total"))
    avg = F.floor(F.col("mean_wind") + 0.5).cast("long")
    out = g.withColumn("avg_wind", F.when(avg > 0, avg)).drop("mean_wind")
    for c in ("weak", "moderate", "strong", "very_strong", "na"):
        out = out.withColumn(f"{c}_pct", F.round(F.col(c) * 100.0 / F.col("total"), 1))
    return out


# The post-import smoke searches (a city site at 100 km, an ocean
# site at 1000 km).
SMOKE_SITES = ((1, 19.0760, 72.8777, 100000.0), (2, 12.0, 80.0, 1000000.0))


def verify_search_smoke(points: DataFrame, events: DataFrame) -> DataFrame:
    """Storm count near the city site and tsunami count near the ocean site."""
    from . import search as S

    spark = points.sparkSession
    sites = spark.createDataFrame(list(SMOKE_SITES), "site_id long, lat double, lon double, radius_m double")
    storms = S.tracks_within(points, sites.filter("site_id = 1"))
    tsu = S.events_near(events, sites.filter("site_id = 2"))
    return (storms.agg(F.countDistinct("sid").alias("storms_near_mumbai_100km"))
            .crossJoin(tsu.agg(F.count(F.lit(1)).alias("tsunamis_near_12n80e_1000km"))))


def result_count_filtered(sites: DataFrame, hits: DataFrame, start=None, end=None, weight: str | None = None) -> DataFrame:
    """'n of m': results per site before and after the year filter (0 when none);
    bounds as in ``results.year_range`` (a null year never passes a bound).
    ``weight``: the column of ``hits`` that says for how many results a row stands (one each without it)."""
    from .search import valid_sites

    y = F.col("year")
    cond = F.lit(True)
    if start:
        cond = cond & (y >= start)
    if end:
        cond = cond & (y <= end)
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    c = hits.groupBy("site_id").agg(F.sum(n).alias("n_all"),
                                    F.sum(F.when(cond, n).otherwise(F.lit(0).cast("long"))).alias("n_kept"))
    return (valid_sites(sites).select("site_id").join(c, "site_id", "left")
            .select("site_id", F.coalesce("n_all", F.lit(0)).alias("results_total"),
                    F.coalesce("n_kept", F.lit(0)).alias("results_shown")))
