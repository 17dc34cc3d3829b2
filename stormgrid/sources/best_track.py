"""Best-track CSV ingest: read as text, null tokens, coerce, split kept / rejected.

Nothing is inferred: every cell is read as a string and converted with
``try_cast``, so one bad cell nulls that value instead of failing the job.
Rows are classified with a reason, and the kept and rejected frames come out of
the same plan (one scan of the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fence import fence, fenced_filter

# Columns taken from the best-track file.
BEST_TRACK_COLUMNS = ("SID", "SEASON", "NUMBER", "BASIN", "SUBBASIN", "NAME", "ISO_TIME",
                      "NATURE", "LAT", "LON", "WMO_WIND", "WMO_PRES", "DIST2LAND", "LANDFALL")

# Cells read as missing (pandas' default NA strings plus " ", "NA", "NaN").
# Note "NA" is also the North Atlantic basin code, so that basin reads as missing (Q1).
DEFAULT_NULL_TOKENS = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                       "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                       "nan", "null")

INTEGER_COLUMNS = ("SEASON", "NUMBER", "WMO_WIND", "WMO_PRES", "DIST2LAND", "LANDFALL")

RAW_SCHEMA = ", ".join(f"{c} string" for c in BEST_TRACK_COLUMNS)


def read_best_track_csv(spark: SparkSession, path: str,
                        null_tokens=DEFAULT_NULL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(kept points, rejected rows) from a best-track CSV file or folder."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("mode", "PERMISSIVE").csv(path))
    return clean_best_track(raw.select(*BEST_TRACK_COLUMNS), null_tokens)


def parse_best_track_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Raw string columns from CSV text lines (same layout as the file)."""
    p = lines.select(F.from_csv(F.col(col), RAW_SCHEMA).alias("r"))
    return p.select(*[F.col(f"r.{c}").alias(c) for c in BEST_TRACK_COLUMNS])


def _null_tokens(c: str, tokens) -> Column:
    x = F.col(c)
    return F.when(x.isNull() | x.isin(list(tokens)), F.lit(None).cast("string")).otherwise(x)


def _trunc_int(c: Column) -> Column:
    """Numeric parse, then truncation to int (the importer's ``int(float(x))``)."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 2147483648.0), F.lit(None)).otherwise(d).try_cast("int")


def classify_best_track(raw: DataFrame, null_tokens=DEFAULT_NULL_TOKENS) -> DataFrame:
    """Typed columns plus ``reject_reason`` (null = kept)."""
    r = raw.select(*[_null_tokens(c, null_tokens).alias(c) for c in BEST_TRACK_COLUMNS])
    lat = F.col("LAT").try_cast("double")
    lon = F.col("LON").try_cast("double")
    t_columns = (
        F.col("SID").alias("sid"),
        _trunc_int(F.col("SEASON")).alias("season"),
        _trunc_int(F.col("NUMBER")).alias("number"),
        F.col("BASIN").alias("basin"),
        F.col("SUBBASIN").alias("subbasin"),
        F.coalesce(F.col("NAME"), F.lit("UNNAMED")).alias("name"),
        F.col("ISO_TIME").try_cast("timestamp_ntz").alias("iso_time"),
        F.col("NATURE").alias("nature"),
        F.when(~F.isnan(lat), lat).alias("lat"),
        F.when(~F.isnan(lon), lon).alias("lon"),
        _trunc_int(F.col("WMO_WIND")).alias("wmo_wind"),
        _trunc_int(F.col("WMO_PRES")).alias("wmo_pres"),
        _trunc_int(F.col("DIST2LAND")).alias("dist2land"),
        _trunc_int(F.col("LANDFALL")).alias("landfall"))
    # an integer beyond its column is reported with its row, not read as missing
    too_big = F.lit(False)
    for c in INTEGER_COLUMNS:
        d = F.col(c).try_cast("double")
        too_big = too_big | F.coalesce(~F.isnan(d) & (F.abs(d) >= 2147483648.0), F.lit(False))
    t = r.select(*t_columns, too_big.alias("too_big"))
    reason = (F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit("no position"))
              .when(F.col("iso_time").isNull(), F.lit("bad time"))
              .when(F.col("sid").isNull(), F.lit("no storm id"))
              .when(~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)),
                    F.lit("position out of range"))
              .when(F.col("too_big"), F.lit("value does not fit its column")))
    return fence(t.withColumn("reject_reason", reason).drop("too_big"))


POINT_COLUMNS = ("sid", "season", "number", "basin", "subbasin", "name", "iso_time", "nature",
                 "lat", "lon", "wmo_wind", "wmo_pres", "dist2land", "landfall")


def clean_best_track(raw: DataFrame, null_tokens=DEFAULT_NULL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). Kept rows get ``obs_id`` = stable hash of their content (Q13)."""
    c = classify_best_track(raw, null_tokens)
    kept = fenced_filter(c, F.col("reject_reason").isNull()).select(
        F.xxhash64("sid", "iso_time", "lat", "lon", "wmo_wind", "wmo_pres").alias("obs_id"),
        *POINT_COLUMNS)
    rejected = fenced_filter(c, F.col("reject_reason").isNotNull())
    return kept, rejected


def ingest_report(classified: DataFrame) -> DataFrame:
    """Rows read / kept / removed, distinct storms and season range of kept rows."""
    ok = F.col("reject_reason").isNull()
    return classified.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(ok).alias("rows_kept"),
        F.count_if(~ok).alias("rows_removed"),
        F.countDistinct(F.when(ok, F.col("sid"))).alias("unique_storms"),
        F.min(F.when(ok, F.col("season"))).alias("season_min"),
        F.max(F.when(ok, F.col("season"))).alias("season_max"))
