"""Storm tracks: per-storm summaries, ordered segments, observation positions.

Ordering within a storm is by (iso_time, lon, lat); the tie-break keeps the
order total so results are deterministic.

Skew: a single storm may hold a large share of all observations, so ordered
operations never put one storm into one task. Points are range-partitioned on
(sid, time) -- a hot storm spreads over many chunks -- windowed inside each
chunk, and chunk boundaries are stitched with a per-chunk summary whose size is
bounded by the number of chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fence import fence, fenced_filter
from .layout import hot_key_rows, spread

ORDER = ("iso_time", "lon", "lat")


def valid_points(points: DataFrame) -> DataFrame:
    """Rows that can be placed on a map (non-null, in-range coordinates).

    Fenced: over derived points (parsed text, a view), Catalyst would push the four comparisons
    below the derivation and repeat it in each, before any redistribution. Filters on
    stored columns belong below this one (scans by place or id do that).
    """
    return fenced_filter(fence(points), F.col("lat").isNotNull() & F.col("lon").isNotNull()
                         & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def duration_hours(start: str, end: str):
    micros = F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")
    return micros.cast("double") / F.lit(3600000000.0).cast("double")


def build_tracks(points: DataFrame) -> DataFrame:
    """One row per storm with >= 2 mapped fixes (cyclone_tracks without the line).

    Pure hash aggregation: partial aggregates are combined map-side, so a hot
    storm costs one row per task before the shuffle. The line itself lives in
    :func:`track_segments` / :func:`track_wkt` (ordered, built without a
    per-storm collect).
    """
    g = (valid_points(points).groupBy("sid").agg(
        F.max("name").alias("name"),
        F.max("basin").alias("basin"),
        F.max("subbasin").alias("subbasin"),
        F.max("season").alias("season"),
        F.min("iso_time").alias("start_time"),
        F.max("iso_time").alias("end_time"),
        F.count(F.lit(1)).alias("n"),
        F.max("wmo_wind").alias("max_wind"),
        F.min("wmo_pres").alias("min_pressure"),
        F.max("lat").alias("max_lat"),
        F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"),
        F.min("lon").alias("min_lon"),
    ).filter(F.col("n") >= 2))
    return g.select(
        "sid", "name", "basin", "subbasin", "season", "start_time", "end_time",
        duration_hours("start_time", "end_time").alias("duration_hours"),
        F.col("n").cast("int").alias("point_count"),
        "max_wind", "min_pressure", "max_lat", "min_lat", "max_lon", "min_lon")


def _chunk_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sequence_points(points: DataFrame, carry: list[str] | tuple = (),
                    chunks: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Each mapped fix with its successor in storm order and its rank k of n.

    Output: sid, iso_time, lon, lat, carry..., k, n, and ``nxt`` =
    struct(iso_time, lon, lat, carry...) of the next fix (null for the last).

    One aggregate finds the largest storm. When no storm has more than
    ``hot_rows`` fixes (conf ``stormgrid.hotKeyRows``), a window per storm over a
    user-numbered shuffle is enough. Otherwise the chunked path runs: the
    range-partitioned frame is checkpointed to the shared checkpoint folder so
    chunk ids stay fixed even if a stage is recomputed.
    """
    carry = list(carry)
    cols = ["sid", *ORDER, *carry]
    n_chunks = chunks or _chunk_count(points)
    if hot_rows is None:
        hot_rows = hot_key_rows(points.sparkSession)
    valid = valid_points(points).select(*cols)
    largest = valid.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
    fix = F.struct(*[F.col(c) for c in (*ORDER, *carry)])
    if largest <= hot_rows:
        w = Window.partitionBy("sid").orderBy(*ORDER)
        seq = (valid.repartition(n_chunks, "sid")
               .withColumn("k", F.row_number().over(w).cast("long"))
               .withColumn("nxt", F.lead(fix).over(w))
               .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sid")).cast("long")))
        return seq.select(*cols, "k", "n", "nxt")
    ranged = (spread(valid)
              .repartitionByRange(n_chunks, "sid", *ORDER)
              .withColumn("chunk", F.spark_partition_id())
              .checkpoint(eager=True))
    w = Window.partitionBy("sid", "chunk").orderBy(*ORDER)
    # explicit count: AQE keeps it, so the CPU-heavy consumers downstream keep
    # n_chunks-way parallelism even when the rows are few bytes
    seq = (ranged.repartition(n_chunks, "sid", "chunk")
           .withColumn("rn", F.row_number().over(w))
           .withColumn("nxt_in", F.lead(fix).over(w)))
    summary = seq.groupBy("sid", "chunk").agg(
        F.min(fix).alias("first_fix"), F.count(F.lit(1)).alias("cn"))
    ws = Window.partitionBy("sid").orderBy("chunk")
    summary = (summary
               .withColumn("next_first", F.lead("first_fix").over(ws))
               .withColumn("offset", F.coalesce(
                   F.sum("cn").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("cn").over(Window.partitionBy("sid")))
               .select("sid", "chunk", "next_first", "offset", "n"))
    out = seq.join(summary, ["sid", "chunk"])
    return out.select(
        *cols,
        (F.col("offset") + F.col("rn")).cast("long").alias("k"),
        F.col("n").cast("long").alias("n"),
        F.coalesce("nxt_in", "next_first").alias("nxt"))


def track_segments(points: DataFrame) -> DataFrame:
    """Consecutive fix pairs of every storm; the class comes from the start fix."""
    s = sequence_points(points, carry=["wmo_wind"])
    return (s.filter(F.col("nxt").isNotNull())
            .select("sid", F.col("k").alias("seq"),
                    F.col("iso_time").alias("a_time"), F.col("lat").alias("a_lat"),
                    F.col("lon").alias("a_lon"), F.col("wmo_wind").alias("a_wind"),
                    F.col("nxt.iso_time").alias("b_time"), F.col("nxt.lat").alias("b_lat"),
                    F.col("nxt.lon").alias("b_lon")))


#: Fixes in one piece of a track line.
PIECE = 512


def track_line(points: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """The ordered line of every storm, in pieces: sid, piece (from 0), n_points, line.

    ``line`` is an array of structs (iso_time, lon, lat, carry...) of ``PIECE`` fixes (the last
    piece has the rest), cut at the fixes' numbers in storm order; a storm of any length
    is spread over its pieces, never collected whole.
    """
    names = [*ORDER, *carry]
    s = sequence_points(points, carry=list(carry)).withColumn("piece", F.floor((F.col("k") - 1) / PIECE))
    fixes = F.array_sort(F.collect_list(F.struct("k", *names)))
    pieces = s.groupBy("sid", "piece").agg(fixes.alias("fixes"))
    line = F.transform("fixes", lambda e: F.struct(*(e[c].alias(c) for c in names)))
    return pieces.select("sid", "piece", F.size("fixes").alias("n_points"), line.alias("line"))


def obs_position(points: DataFrame) -> DataFrame:
    """Observation k of n with first/last flags and the (Start)/(End) label."""
    s = sequence_points(points, carry=["obs_id"])
    return s.select(
        "obs_id", "sid", "iso_time", "k", "n",
        (F.col("k") == 1).alias("is_first"),
        (F.col("k") == F.col("n")).alias("is_last"),
        F.when(F.col("k") == 1, F.lit(" (Start)"))
         .when(F.col("k") == F.col("n"), F.lit(" (End)")).otherwise(F.lit(""))
         .alias("position_label"))


def track_points(points: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Observations of the requested storms, API conventions (Q8, Q15).

    ``ids``: frame with a ``sid`` column (None = all storms). Sorted by
    (storm, time) with a global range sort, never per-storm collects.
    """
    p = points if ids is None else points.join(ids.select("sid").distinct(), "sid", "left_semi")
    p = p.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return p.select(
        F.col("sid").alias("storm_id"), "lat", "lon", "iso_time",
        F.expr("nullif(wmo_wind, 0)").alias("wind_speed"),
        F.expr("nullif(wmo_pres, 0)").alias("pressure"),
        "nature",
        F.when(F.col("dist2land") >= 0, F.col("dist2land")).alias("dist2land"),
    ).orderBy("storm_id", *ORDER)


def min_dist_to_land(points: DataFrame) -> DataFrame:
    """Per storm, the smallest non-negative distance to land over all its fixes."""
    return points.groupBy("sid").agg(
        F.min(F.when(F.col("dist2land") >= 0, F.col("dist2land"))).alias("min_dist_to_land"))
