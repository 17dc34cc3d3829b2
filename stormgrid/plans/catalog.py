"""Registered queries: name -> Spark plan over the derived tables (+ DuckDB oracle).

Every query reads the driver's parquet tables through :mod:`views`, on the
whole tables. Derived inputs are memoised per call only as lazy frames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fence import fenced_filter
from ..session import scratch_path
from . import oracle as O
from . import table_functions as TF
from . import views as V
from ..operators import blocks as BL
from ..operators import counts as CN
from ..operators import results as R
from ..operators import risk as RK
from ..operators import search as S
from ..operators import stats as ST
from ..operators import tracks as T
from ..functions import classify as CL
from ..functions import dates as D
from ..sources import best_track as BT
from ..sources import export as EX
from ..sources import tables as TB
from ..sources import versions as VE
from ..sources import tsunami_tsv as TSV


class Inputs:
    """Lazy derived tables for one sf folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def _get(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    @property
    def obs(self) -> DataFrame:
        return self._get("obs", lambda: V.observations(self.spark, self.sf_dir))

    @property
    def tracks(self) -> DataFrame:
        return self._get("tracks", lambda: T.build_tracks(self.obs))

    @property
    def sites(self) -> DataFrame:
        return self._get("sites", lambda: V.sites(self.spark, self.sf_dir))

    @property
    def events(self) -> DataFrame:
        return self._get("events", lambda: V.tsunami_events(self.spark, self.sf_dir))

    @property
    def search(self) -> DataFrame:
        return self._get("search", lambda: S.cyclone_search(self.obs, self.tracks, self.sites))

    def customer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/customer.parquet")

    def requested_sids(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.customer().select(F.concat(F.lit("S"), (c % 2000).cast("string"), F.lit("-"),
                                               (c % 7).cast("string")).alias("sid")).distinct()

    def requested_event_ids(self) -> DataFrame:
        return self.customer().select((F.col("c_custkey") * 53).alias("id")).distinct()


def _fresh(i: Inputs) -> str:
    return scratch_path(i.spark, f"tables/{uuid.uuid4().hex[:12]}")


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


# ------------------------------------------------------------------ searches

@register("storms_near", O.storms_near_sql())
def q_storms_near(i: Inputs) -> DataFrame:
    return S.storms_near(i.obs, i.tracks, i.sites)


@register("cyclone_search", O.CYCLONE_SEARCH)
def q_cyclone_search(i: Inputs) -> DataFrame:
    return i.search


@register("result_count", O.RESULT_COUNT)
def q_result_count(i: Inputs) -> DataFrame:
    return S.result_count(i.sites, BL.storms_counted(i.obs, i.sites), weight="n")


@register("nearest_storm", O.nearest_sql())
def q_nearest_storm(i: Inputs) -> DataFrame:
    return S.nearest_storm(i.obs, i.tracks, i.sites)


@register("min_dist_to_land", O.MIN_DIST_TO_LAND)
def q_min_dist_to_land(i: Inputs) -> DataFrame:
    return T.min_dist_to_land(i.obs)


@register("storm_semi", O.STORM_SEMI)
def q_storm_semi(i: Inputs) -> DataFrame:
    hits = BL.storms_met(T.track_segments(i.obs), i.sites)
    return i.obs.join(hits, "sid", "left_semi").select("obs_id", "sid", "iso_time", "wmo_wind")


@register("events_near", O.events_near_sql())
def q_events_near(i: Inputs) -> DataFrame:
    return S.events_near(i.events, i.sites)


@register("obs_count", O.OBS_COUNT)
def q_obs_count(i: Inputs) -> DataFrame:
    """Observations within each site's radius, counted without pairs."""
    return CN.points_counted(i.obs, i.sites, "observations_found")


@register("tsunami_search", O.tsunami_search_sql())
def q_tsunami_search(i: Inputs) -> DataFrame:
    return S.tsunami_search(i.events, i.sites)


# ------------------------------------------------------------------ tracks

@register("build_tracks", O.BUILD_TRACKS)
def q_build_tracks(i: Inputs) -> DataFrame:
    return i.tracks


@register("track_segments", O.TRACK_SEGMENTS)
def q_track_segments(i: Inputs) -> DataFrame:
    return T.track_segments(i.obs)


@register("obs_position", O.OBS_POSITION)
def q_obs_position(i: Inputs) -> DataFrame:
    return T.obs_position(i.obs)


@register("track_points", O.TRACK_POINTS)
def q_track_points(i: Inputs) -> DataFrame:
    return T.track_points(i.obs)


@register("storm_lookup", O.STORM_LOOKUP)
def q_storm_lookup(i: Inputs) -> DataFrame:
    return T.track_points(i.obs, i.requested_sids())


@register("not_found_storms", O.NOT_FOUND_STORMS)
def q_not_found_storms(i: Inputs) -> DataFrame:
    return S.not_found(i.requested_sids(), i.tracks, "sid")


@register("not_found_events", O.NOT_FOUND_EVENTS)
def q_not_found_events(i: Inputs) -> DataFrame:
    return S.not_found(i.requested_event_ids(), i.events, "id")


@register("visible_tracks", O.VISIBLE_TRACKS)
def q_visible_tracks(i: Inputs) -> DataFrame:
    kept = R.year_range(i.tracks.select("sid", F.coalesce("season", F.lit(0)).alias("year")), 1950, 2000)
    met = BL.storms_met(T.track_segments(i.obs).join(kept, "sid", "left_semi"), i.sites)
    return R.visible_tracks(i.tracks, met.select(F.col("sid").alias("storm_id")))


# ------------------------------------------------------------------ stats

@register("cyclone_stats", O.CYCLONE_STATS)
def q_cyclone_stats(i: Inputs) -> DataFrame:
    return ST.cyclone_stats(i.tracks)


@register("basin_distribution", O.BASIN_DISTRIBUTION)
def q_basin_distribution(i: Inputs) -> DataFrame:
    return ST.basin_distribution(i.tracks)


@register("latest_tracks", O.LATEST_TRACKS)
def q_latest_tracks(i: Inputs) -> DataFrame:
    return ST.latest_tracks(i.tracks)


@register("verify_counts", O.VERIFY_COUNTS)
def q_verify_counts(i: Inputs) -> DataFrame:
    return ST.verify_counts(i.obs, i.tracks, i.events)


@register("wind_buckets", O.WIND_BUCKETS)
def q_wind_buckets(i: Inputs) -> DataFrame:
    hits = BL.storms_counted(i.obs, i.sites, i.tracks.select("sid", F.coalesce("max_wind", F.lit(0)).alias("key")))
    return ST.wind_buckets(hits.select("site_id", F.expr("nullif(key, 0)").cast("int").alias("max_wind_speed"), "n"), weight="n")


@register("tsunami_stats", O.TSUNAMI_STATS)
def q_tsunami_stats(i: Inputs) -> DataFrame:
    return ST.tsunami_stats(i.events)


@register("top_countries", O.TOP_COUNTRIES)
def q_top_countries(i: Inputs) -> DataFrame:
    return ST.top_countries(i.events)


@register("cause_distribution", O.CAUSE_DISTRIBUTION)
def q_cause_distribution(i: Inputs) -> DataFrame:
    return ST.cause_distribution(i.events)


@register("import_summary", O.IMPORT_SUMMARY)
def q_import_summary(i: Inputs) -> DataFrame:
    return ST.import_summary(i.events)


# ------------------------------------------------------------------ result shaping

@register("year_range", O.YEAR_RANGE_STORMS)
def q_year_range(i: Inputs) -> DataFrame:
    return S.cyclone_search(i.obs, i.tracks, i.sites, shape=lambda storms: R.year_range(storms, 1950, 2000))


@register("sort_results", O.SORT_STORMS_WIND)
def q_sort_results(i: Inputs) -> DataFrame:
    return R.ranked_results(i.search, "windspeed")


@register("storm_classes", O.STORM_CLASSES)
def q_storm_classes(i: Inputs) -> DataFrame:
    return S.cyclone_search(i.obs, i.tracks, i.sites, shape=R.cyclone_row)


@register("event_detail", O.EVENT_DETAIL)
def q_event_detail(i: Inputs) -> DataFrame:
    return R.event_detail(i.events, i.requested_event_ids())


@register("event_validity_filter", O.EVENT_VALIDITY_FILTER)
def q_event_validity_filter(i: Inputs) -> DataFrame:
    return i.events.filter(F.col("event_validity") >= 2).select("id", "event_validity")


# ------------------------------------------------------------------ wind risk

def _maxima(i: Inputs) -> DataFrame:
    """The samples of all sites, one row each."""
    return i._get("maxima", lambda: BL.samples(i.obs, i.sites))


@register("obs_near", O.OBS_NEAR)
def q_obs_near(i: Inputs) -> DataFrame:
    return S.obs_near_rows(i.obs, i.sites)


@register("storm_block_maxima", O.BLOCK_MAXIMA)
def q_storm_block_maxima(i: Inputs) -> DataFrame:
    return BL.maxima_pairs(i.obs, i.sites)


@register("sample_stats", O.SAMPLE_STATS)
def q_sample_stats(i: Inputs) -> DataFrame:
    return RK.sample_stats(_maxima(i))


@register("wind_percentiles", O.WIND_PERCENTILES)
def q_wind_percentiles(i: Inputs) -> DataFrame:
    return RK.wind_percentiles(_maxima(i).select("site_id", F.inline("s")))


@register("wind_histogram", O.WIND_HISTOGRAM)
def q_wind_histogram(i: Inputs) -> DataFrame:
    return RK.wind_histogram(_maxima(i))


# iterative maximum-likelihood fit: no SQL oracle (tested against simulated samples)
@register("gev_fit")
def q_gev_fit(i: Inputs) -> DataFrame:
    return RK.gev_fit(_maxima(i))


@register("fitted_pdf")
def q_fitted_pdf(i: Inputs) -> DataFrame:
    m = _maxima(i)
    return RK.fitted_pdf(m, RK.gev_fit(m))


@register("wind_analysis")
def q_wind_analysis(i: Inputs) -> DataFrame:
    return RK.wind_analysis(i.obs, i.sites)


# ------------------------------------------------------------------ ingest

def _csv_classified(i: Inputs) -> DataFrame:
    i.obs.createOrReplaceTempView("obs")
    lines = i.spark.sql(V.CSV_LINES_SQL)
    return BT.classify_best_track(BT.parse_best_track_lines(lines))


def _tsv_parsed(i: Inputs):
    """The TSV text written to files, each with its header, and read back."""
    V.tsunami_events_raw(i.spark, i.sf_dir).createOrReplaceTempView("ev_raw")
    lines = i.spark.sql(V.tsv_lines_sql())
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, so of its file
    text = lines.select(F.explode(F.when(first, F.array(F.lit(TSV.HEADER), F.col("line"))).otherwise(F.array("line"))).alias("value"))
    path = _fresh(i)
    text.write.text(path)
    return TSV.read_tsunami_tsv(i.spark, path)


@register("read_best_track_csv", O.READ_BEST_TRACK)
def q_read_best_track_csv(i: Inputs) -> DataFrame:
    c = _csv_classified(i)
    return fenced_filter(c, F.col("reject_reason").isNull()).select(*BT.POINT_COLUMNS)


@register("best_track_rejects", O.BEST_TRACK_REJECTS)
def q_best_track_rejects(i: Inputs) -> DataFrame:
    return fenced_filter(_csv_classified(i), F.col("reject_reason").isNotNull())


@register("ingest_report", O.INGEST_REPORT)
def q_ingest_report(i: Inputs) -> DataFrame:
    return BT.ingest_report(_csv_classified(i))


@register("read_tsunami_tsv", O.READ_TSUNAMI_TSV)
def q_read_tsunami_tsv(i: Inputs) -> DataFrame:
    ev, _, _ = _tsv_parsed(i)
    return ev.drop("id")  # id is a content hash (Q13); DuckDB has no xxhash64


@register("tsunami_ingest_report", O.TSUNAMI_INGEST_REPORT)
def q_tsunami_ingest_report(i: Inputs) -> DataFrame:
    return _tsv_parsed(i)[2]


# ------------------------------------------------------------------ exports

@register("track_wkt", O.TRACK_WKT)
def q_track_wkt(i: Inputs) -> DataFrame:
    return EX.track_wkt(i.obs)


@register("track_geojson", O.TRACK_GEOJSON)
def q_track_geojson(i: Inputs) -> DataFrame:
    return EX.track_geojson(i.obs, i.tracks)


@register("export_cyclone_csv", O.EXPORT_CYCLONE_CSV)
def q_export_cyclone_csv(i: Inputs) -> DataFrame:
    return EX.cyclone_csv_found(i.obs, i.tracks, i.sites, EX.track_wkt(i.obs))


@register("export_tsunami_csv", O.export_tsunami_csv_sql())
def q_export_tsunami_csv(i: Inputs) -> DataFrame:
    return EX.tsunami_csv_found(i.events, i.sites)


# ------------------------------------------------------------------ tsunami result shaping

@register("tsunami_rows", O.tsunami_rows_sql())
def q_tsunami_rows(i: Inputs) -> DataFrame:
    return S.tsunami_search(i.events, i.sites, shape=R.tsunami_row)


@register("tsunami_year_range", O.tsunami_year_range_sql())
def q_tsunami_year_range(i: Inputs) -> DataFrame:
    return S.tsunami_search(i.events, i.sites, shape=lambda events: R.year_range(events, 1700, 1900, drop_unknown_year=True))


@register("tsunami_sort", O.tsunami_sort_sql())
def q_tsunami_sort(i: Inputs) -> DataFrame:
    return R.ranked_results(S.tsunami_search(i.events, i.sites), "magnitude", tie="id")


@register("search_args", O.SEARCH_ARGS)
def q_search_args(i: Inputs) -> DataFrame:
    out = None
    for kind in ("cyclone", "wind", "tsunami"):
        good, bad = S.search_args(i.sites, kind)
        part = (good.select("site_id", F.lit(kind).alias("kind"), F.lit(True).alias("accepted"))
                .unionByName(bad.select("site_id", F.lit(kind).alias("kind"),
                                        F.lit(False).alias("accepted"))))
        out = part if out is None else out.unionByName(part)
    return out


@register("point_classes", O.POINT_CLASSES)
def q_point_classes(i: Inputs) -> DataFrame:
    pos = T.sequence_points(i.obs, carry=["obs_id", "wmo_wind", "nature"])
    return pos.select(
        "obs_id", "sid", "k", "n",
        F.when(F.col("k") == 1, F.lit(" (Start)")).when(F.col("k") == F.col("n"), F.lit(" (End)"))
         .otherwise(F.lit("")).alias("position_label"),
        CL.saffir_simpson(F.expr("nullif(wmo_wind, 0)")).alias("category"),
        CL.nature_label("nature").alias("nature_label"))


@register("tracks_for_results", O.TRACKS_FOR_RESULTS)
def q_tracks_for_results(i: Inputs) -> DataFrame:
    return R.tracks_for_results(i.search, i.tracks, i.obs)


# ------------------------------------------------------------------ sinks and API forms

@register("write_points", O.WRITE_POINTS)
def q_write_points(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, f"tables/cyclone_points_{uuid.uuid4().hex[:12]}")
    return VE.write_version(VE.dealt(i.obs, ["season"]), path, partition_by=["season"]).select(*i.obs.columns)


@register("write_events", O.WRITE_EVENTS)
def q_write_events(i: Inputs) -> DataFrame:
    return VE.write_version(i.events, scratch_path(i.spark, f"tables/tsunami_events_{uuid.uuid4().hex[:12]}"))


@register("event_detail_api", O.EVENT_DETAIL_API)
def q_event_detail_api(i: Inputs) -> DataFrame:
    return R.event_detail_api(i.events, i.requested_event_ids())


@register("tsunami_stats_api", O.TSUNAMI_STATS_API)
def q_tsunami_stats_api(i: Inputs) -> DataFrame:
    return ST.tsunami_stats_api(i.events)


@register("verify_search_smoke", O.verify_search_smoke_sql())
def q_verify_search_smoke(i: Inputs) -> DataFrame:
    return ST.verify_search_smoke(i.obs, i.events)


@register("result_count_filtered", O.RESULT_COUNT_FILTERED)
def q_result_count_filtered(i: Inputs) -> DataFrame:
    hits = BL.storms_counted(i.obs, i.sites, i.tracks.select("sid", F.col("season").alias("key")))
    return ST.result_count_filtered(i.sites, hits.select("site_id", F.coalesce("key", F.lit(0)).alias("year"), "n"), 1950, 2000, weight="n")


@register("tsunami_result_count", O.tsunami_result_count_sql())
def q_tsunami_result_count(i: Inputs) -> DataFrame:
    return CN.events_counted(i.events, i.sites)


@register("order_by_distance", O.ORDER_BY_DISTANCE)
def q_order_by_distance(i: Inputs) -> DataFrame:
    return R.ranked_results(i.search, "distance")


@register("track_coordinates", O.TRACK_COORDINATES)
def q_track_coordinates(i: Inputs) -> DataFrame:
    return EX.geojson_coordinates(EX.track_geojson(i.obs, i.tracks))


@register("storms_near_stored", O.storms_near_sql())
def q_storms_near_stored(i: Inputs) -> DataFrame:
    """storms_near over tables written once (points, tracks, segments)."""
    return TB.storms_near_stored(TB.materialize_storm_tables(i.obs, _fresh(i)), i.sites)


@register("obs_near_stored", O.OBS_NEAR)
def q_obs_near_stored(i: Inputs) -> DataFrame:
    return TB.obs_near_stored(TB.store_points_by_place(i.obs, _fresh(i)), i.sites)


@register("events_near_stored", O.events_near_sql())
def q_events_near_stored(i: Inputs) -> DataFrame:
    return TB.events_near_stored(TB.store_events_by_place(i.events, _fresh(i)), i.sites)


@register("track_line", O.TRACK_LINE)
def q_track_line(i: Inputs) -> DataFrame:
    """Pieces of the ordered lines, stored and read back."""
    return EX.line_pieces(VE.write_version(VE.dealt(T.track_line(i.obs), ["sid"]), _fresh(i)))


@register("sql_find_cyclones_near_point", O.storms_near_sql())
def q_sql_find_cyclones(i: Inputs) -> DataFrame:
    TF.register(i.spark, TB.materialize_storm_tables(i.obs, _fresh(i)))
    i.sites.createOrReplaceTempView("sites")
    return i.spark.sql("select s.site_id, f.* from sites s, lateral find_cyclones_near_point(s.lat, s.lon, s.radius_m) f")


@register("sql_find_tsunamis_near_point", O.events_near_sql())
def q_sql_find_tsunamis(i: Inputs) -> DataFrame:
    TF.register(i.spark, events=i.events)
    i.sites.createOrReplaceTempView("sites")
    return i.spark.sql("select s.site_id, f.* from sites s, lateral find_tsunamis_near_point(s.lat, s.lon, s.radius_m) f")


@register("sql_get_cyclone_track", O.TRACKS_BY_FUNCTION)
def q_sql_get_track(i: Inputs) -> DataFrame:
    TF.register(i.spark, TB.materialize_storm_tables(i.obs, _fresh(i)))
    i.requested_sids().createOrReplaceTempView("storm_ids")
    return i.spark.sql("select f.* from storm_ids s, lateral get_cyclone_track(s.sid) f")


@register("sql_get_tsunami_event", O.EVENT_DETAIL)
def q_sql_get_event(i: Inputs) -> DataFrame:
    TF.register(i.spark, events=i.events)
    i.requested_event_ids().createOrReplaceTempView("event_ids")
    return i.spark.sql("select f.* from event_ids s, lateral get_tsunami_event(s.id) f")


# closed-form levels from the fitted parameters (no oracle: parameters come from the fit)
@register("return_levels")
def q_return_levels(i: Inputs) -> DataFrame:
    return RK.return_levels(RK.gev_fit(_maxima(i)))


@register("track_iso_times", O.TRACK_ISO_TIMES)
def q_track_iso_times(i: Inputs) -> DataFrame:
    """Start and end of every track as the API writes them."""
    return i.tracks.select("sid", D.iso_text("start_time").alias("start_date"), D.iso_text("end_time").alias("end_date"))


@register("wind_level_classes", O.WIND_LEVEL_CLASSES)
def q_wind_level_classes(i: Inputs) -> DataFrame:
    """Short classes of each site's mean and strongest wind."""
    stats = RK.sample_stats(_maxima(i))
    return stats.select("site_id", CL.saffir_simpson_short("wind_mean").alias("mean_class"), CL.saffir_simpson_short("wind_max").alias("max_class"))


@register("rejected_sites", O.REJECTED_SITES)
def q_rejected_sites(i: Inputs) -> DataFrame:
    """Requests derived from all customers, some of them with bad arguments: those that no search answers."""
    k = F.col("site_id")
    asked = i.sites.select("site_id", F.when(k % 11 == 0, F.col("lat") + 200).when(k % 13 != 0, F.col("lat")).alias("lat"),
                           F.when(k % 17 == 0, F.col("lon") - 400).otherwise(F.col("lon")).alias("lon"),
                           F.when(k % 19 == 0, -F.col("radius_m")).otherwise(F.col("radius_m")).alias("radius_m"))
    return S.rejected_sites(asked).select("site_id", F.regexp_extract("reject_reason", "^[^:]*", 0).alias("reject_reason"))


def _given_fits(i: Inputs) -> DataFrame:
    """Parameters by site number, in place of a fit: what follows a fit can then be checked."""
    c = F.col("c_custkey")
    given = i.customer().select(c.alias("site_id"), ((c % 7 - 3) * F.lit(0.05)).alias("shape"), (F.lit(40.0) + c % 23).alias("loc"), (F.lit(5.0) + c % 11).alias("scale"))
    return given.select("*", RK.return_level(0.98).alias("w50"), RK.return_level(0.99).alias("w100"), F.lit(False).alias("gev_fallback"), F.lit("gev").alias("fit_method"))


@register("return_levels_given", O.RETURN_LEVELS_GIVEN)
def q_return_levels_given(i: Inputs) -> DataFrame:
    return RK.return_levels(_given_fits(i))


@register("fitted_pdf_given", O.FITTED_PDF_GIVEN)
def q_fitted_pdf_given(i: Inputs) -> DataFrame:
    return RK.fitted_pdf(_maxima(i), _given_fits(i))


@register("wind_analysis_given", O.WIND_ANALYSIS_GIVEN)
def q_wind_analysis_given(i: Inputs) -> DataFrame:
    """The scalar columns of the analysis from given parameters (histogram and curve have keys of their own)."""
    r = RK.wind_analysis_given(i.obs, i.sites, _given_fits(i))
    return r.select("site_id", "sample_count", "storm_count", "insufficient_data", "message", "wind_mean", "wind_std", "wind_min", "wind_max", "wind_median",
                    F.col("gev_params.shape").alias("shape"), F.col("return_levels.w50").alias("w50"), F.col("return_levels.w100").alias("w100"), "distance_km")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, _f=f: _f(Inputs(spark, sf_dir))) for k, f in QUERIES.items()}
