"""Tsunami TSV ingest: tab-separated text -> cleaned, typed tsunami_events rows.

Reading: cells may be quoted; a quoted cell may hold tabs, doubled quotes and line breaks, and
header names may be quoted. A file is one record stream (``multi_line``), so that a line
break in a cell is part of the cell; folders are read file by file in parallel. Each file's
header is checked against the first one's; ``header_per_file`` reads files of other column
orders by their own headers.

Row rules (Q21): empty lines are ignored; a row with more cells than the header is skipped;
missing cells at the end are empty; rows whose Year is missing, blank or contains ``[`` (the
search-parameter row) are dropped; cells that are a missing-value token, quoted or not, read as missing
(a Year ``NA`` drops its row); then surrounding double quotes and spaces are stripped from
every cell.
Cell rules (Q22, Q25): integers parse as integers only (``5.0`` -> null), decimals are rounded
to the column scale. A row with a text longer than its column holds, or a number that
overflows it, goes to the rejected frame whole, with its line and the columns' names
(``strict=True`` raises instead, like the all-or-nothing import; ``reject_overflow=False`` nulls such
values and names them in ``overflow``). Rows need an in-range position; BC years are
kept without a datetime (Q24).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import event_datetime
from ..functions.fence import fence, fenced_filter
from .best_track import DEFAULT_NULL_TOKENS

#: Whole raw cells that read as missing; a single space isn't one of them here.
MISSING_CELLS = tuple(t for t in DEFAULT_NULL_TOKENS if t != " ")

# File header -> column, kind. kind: int | (p, s) decimal | str length | coord
FIELDS = (
    ("Year", "year", "int"), ("Mo", "month", "int"), ("Dy", "day", "int"),
    ("Hr", "hour", "int"), ("Mn", "minute", "int"), ("Sec", "second", (5, 1)),
    ("Tsunami Event Validity", "event_validity", "int"),
    ("Tsunami Cause Code", "cause_code", "int"),
    ("Earthquake Magnitude", "earthquake_magnitude", (4, 1)),
    ("Country", "country", 100), ("Location Name", "location_name", 255),
    ("Latitude", "latitude", "coord"), ("Longitude", "longitude", "coord"),
    ("Maximum Water Height (m)", "max_water_height", (8, 2)),
    ("Number of Runups", "num_runups", "int"),
    ("Tsunami Magnitude (Abe)", "tsunami_magnitude_abe", (5, 2)),
    ("Tsunami Magnitude (Iida)", "tsunami_magnitude_iida", (5, 2)),
    ("Tsunami Intensity", "tsunami_intensity", (5, 2)),
    ("Deaths", "deaths", "int"), ("Death Description", "death_description", "int"),
    ("Missing", "missing", "int"), ("Missing Description", "missing_description", "int"),
    ("Injuries", "injuries", "int"), ("Injuries Description", "injuries_description", "int"),
    ("Damage ($Mil)", "damage_mil", (12, 2)), ("Damage Description", "damage_description", "int"),
    ("Houses Destroyed", "houses_destroyed", "int"),
    ("Houses Destroyed Description", "houses_destroyed_desc", "int"),
    ("Houses Damaged", "houses_damaged", "int"),
    ("Houses Damaged Description", "houses_damaged_desc", "int"),
    ("Total Deaths", "total_deaths", "int"),
    ("Total Death Description", "total_death_description", "int"),
    ("Total Missing", "total_missing", "int"),
    ("Total Missing Description", "total_missing_desc", "int"),
    ("Total Injuries", "total_injuries", "int"),
    ("Total Injuries Description", "total_injuries_desc", "int"),
    ("Total Damage ($Mil)", "total_damage_mil", (12, 2)),
    ("Total Damage Description", "total_damage_desc", "int"),
    ("Total Houses Destroyed", "total_houses_destroyed", "int"),
    ("Total Houses Destroyed Description", "total_houses_dest_desc", "int"),
    ("Total Houses Damaged", "total_houses_damaged", "int"),
    ("Total Houses Damaged Description", "total_houses_dam_desc", "int"),
)
HEADER = "\t".join(h for h, _, _ in FIELDS)


#: Columns that tell a header from a row where files may have different ones.
HEADER_MARKS = ("Year", "Latitude", "Longitude")
_CSV = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _schema(n: int) -> str:
    return ", ".join(f"c{k} string" for k in range(n)) + ", _corrupt string"


def read_tsunami_tsv(spark: SparkSession, path: str, strict: bool = False, reject_overflow: bool = True,
                     multi_line: bool = True, header_per_file: bool = False):
    """(events, rejected, report) from a tab-separated file or folder of them.

    Without ``multi_line`` large files are split over tasks, and line breaks in cells aren't
    understood. ``header_per_file`` costs a scan for headers; otherwise a file whose header
    differs from the first one's fails the read.
    """
    reader = spark.read.options(**_CSV).option("header", True).option("multiLine", multi_line).option("columnPruning", False)
    if header_per_file:
        layouts = _layouts(spark, path)
    else:
        layouts = [(tuple(reader.csv(path).columns), path)]
    parsed = None
    for names, files in layouts:
        raw = reader.option("enforceSchema", header_per_file).schema(", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", _corrupt string").csv(files)
        cells = raw.toDF(*(f"c{k}" for k in range(len(names))), "_corrupt")
        text = F.concat_ws("\t", *(F.coalesce(f"c{k}", F.lit("")) for k in range(len(names))))
        one = _classified(cells.withColumn("line", F.coalesce("_corrupt", text)), names, strict, reject_overflow)
        parsed = one if parsed is None else parsed.unionByName(one)
    return _results(parsed)


def _layouts(spark: SparkSession, path: str) -> list[tuple[tuple, list[str]]]:
    """The distinct headers of the files, each with its files (a row for each file reaches the driver, as in any file listing)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    marked = lines.filter(F.forall(F.array(*(F.lit(m) for m in HEADER_MARKS)), lambda m: F.contains(F.col("value"), m))).distinct()
    found: dict[str, list[str]] = {}
    for r in marked.collect():
        found.setdefault(r["value"], []).append(r["file"])
    split = lambda line: tuple(c[1:-1].replace('""', '"') if len(c) > 1 and c[0] == c[-1] == '"' else c for c in line.split("\t"))
    return [(split(line), sorted(files)) for line, files in sorted(found.items())]


def _known(c: Column) -> Column:
    """A raw cell, or null where it reads as missing."""
    return F.when(~c.isin(list(MISSING_CELLS)), c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c, F.lit('"')), r"^\s+|\s+$", "")


def _cells(cells: dict[str, Column]) -> Column:
    """The stripped cells of all FIELDS in order, null where missing or empty.

    Lambdas over arrays: expressions of their own for each column would make the generated
    code too large for the JIT compiler.
    """
    none = F.lit(None).cast("string")
    stripped = F.transform(F.array(*(cells.get(h, none) for h, _, _ in FIELDS)), lambda c: F.when(_known(c) != "", _strip(c)))
    return F.transform(stripped, lambda c: F.when(c != "", c))


def _typed(as_type: str, kinds: dict[str, Column]) -> Column:
    """The cells as numbers of one type."""
    return F.transform(F.array(*kinds.values()), lambda c: c.try_cast(as_type))


def _too_big(cells: dict[str, Column]) -> Column:
    """Names of the integer columns whose cell is a number that no int holds.

    One lambda over an array: a test for each column would make the generated code too large.
    """
    ints = F.array(*[F.struct(F.lit(c).alias("c"), cells[h].alias("v")) for h, c, k in FIELDS if k == "int" and h in cells])

    def beyond(s: Column) -> Column:
        d = _strip(s["v"]).try_cast("double")
        return (F.length(s["v"]) >= 10) & ~F.isnan(d) & (F.abs(d) >= 2147483648.0)  # such a number has ten digits or more

    return F.transform(F.filter(ints, beyond), lambda s: s["c"])


def _valued(kind, name: str) -> Column:
    """The value that the column holds, from the typed columns."""
    raw = F.col(f"{name}__raw")
    if kind in ("int", "coord"):
        return F.col(name)
    return (F.when(F.length(raw) <= kind, raw) if isinstance(kind, int) else raw.try_cast(f"decimal({kind[0]},{kind[1]})")).alias(name)


def _overflows(kind, name: str) -> Column:
    """Whether a text or decimal is there that the column doesn't hold."""
    raw = F.col(f"{name}__raw")
    return raw.isNotNull() & F.col(name).isNull() & (F.lit(True) if isinstance(kind, int) else ~F.isnan(raw))


def parse_tsunami_lines(lines: DataFrame, col: str = "line", header: tuple | None = None,
                        strict: bool = False, reject_overflow: bool = True):
    """Parse TSV text, one record a row (header already removed). Returns (events, rejected, report)."""
    names = list(header) if header else [h for h, _, _ in FIELDS]
    rows = lines.filter(F.col(col) != "").select(F.col(col).alias("line"), F.from_csv(F.col(col), _schema(len(names)), _CSV).alias("r"))
    return _results(_classified(rows.select("line", "r.*"), tuple(names), strict, reject_overflow))


def _cell_count(line: Column) -> Column:
    """Cells of a record: its tabs outside of quoted cells, and one."""
    unquoted = F.regexp_replace(line, r'(^|\t)"[^"]*+(?:""[^"]*+)*+"(?=\t|$)', "$1")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit("\t"), F.lit(""))) + 1


def _classified(rows: DataFrame, names: tuple, strict: bool, reject_overflow: bool) -> DataFrame:
    """Typed columns, reject_reason and overflow of records (line, c0.., _corrupt: set where the cells aren't as many as the names)."""
    cells = {h: F.col(f"c{k}") for k, h in enumerate(names)}
    read_ok = F.col("_corrupt").isNull() | (_cell_count(F.col("line")) <= len(names))
    year_raw = _known(cells["Year"])
    year_ok = year_raw.isNotNull() & (year_raw != "") & ~year_raw.contains("[") \
        & (F.trim(year_raw) != "")
    a = rows.withColumn("stage", F.when(~read_ok, F.lit("too many cells"))
                        .when(~F.coalesce(year_ok, F.lit(False)), F.lit("no year")))
    t = a.select("line", "stage", _too_big(cells).alias("too_big"), _cells(cells).alias("cells"))
    own = {c: (F.col("cells")[k], kind) for k, (_, c, kind) in enumerate(FIELDS)}
    ints = {c: v for c, (v, kind) in own.items() if kind == "int"}
    doubles = {c: v for c, (v, kind) in own.items() if kind == "coord" or isinstance(kind, tuple)}
    t = t.select("line", "stage", "too_big", "cells", _typed("int", ints).alias("ints"), _typed("double", doubles).alias("doubles"))
    value = {c: F.col("ints")[k] for k, c in enumerate(ints)} | {c: F.col("doubles")[k] for k, c in enumerate(doubles)}
    t = t.select("line", "stage", "too_big", *[value.get(c, v).alias(c if kind in ("int", "coord") else f"{c}__raw") for c, (v, kind) in own.items()])
    checked = [(c, kind) for _, c, kind in FIELDS if kind not in ("int", "coord")]
    t = t.select("line", "stage", "too_big", *(_valued(kind, c) for _, c, kind in FIELDS), *(f"{c}__raw" for c, _ in checked))
    flags = [F.when(_overflows(kind, c), F.lit(c)) for c, kind in checked]
    t = t.select("line", "stage", *(c for _, c, _ in FIELDS), F.concat_ws(",", "too_big", *flags).alias("overflow"))
    lat, lon = F.col("latitude"), F.col("longitude")
    coords_ok = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    t = t.withColumn("reject_reason", F.coalesce(
        F.col("stage"), F.when(~coords_ok, F.lit("no coordinates"))))
    over = F.col("reject_reason").isNull() & (F.col("overflow") != "")
    t = t.withColumn("over", over)
    if reject_overflow:
        t = t.withColumn("reject_reason", F.when(
            F.col("over"), F.concat(F.lit("value does not fit its column: "), F.col("overflow"))).otherwise(F.col("reject_reason")))
    if strict:
        t = t.withColumn("overflow", F.when(
            F.col("overflow") == "", F.col("overflow")).otherwise(
            F.raise_error(F.concat(F.lit("value does not fit its column: "), F.col("overflow")))))
    return t


def _results(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, rejected, report) of classified rows."""
    lat, lon = F.col("latitude"), F.col("longitude")
    t = fence(t)
    events = fenced_filter(t, F.col("reject_reason").isNull()).select(
        F.xxhash64("line").alias("id"),
        *[F.col(c) for _, c, _ in FIELDS[:6]],
        event_datetime("year", "month", "day", "hour", "minute", "second").alias("event_datetime"),
        *[F.col(c) for _, c, k in FIELDS[6:] if k != "coord"][:5],
        lat.cast("decimal(8,5)").alias("latitude"), lon.cast("decimal(8,5)").alias("longitude"),
        *[F.col(c) for _, c, _ in FIELDS[13:]],
        lat.alias("lat_d"), lon.alias("lon_d"),
        F.when(F.col("overflow") != "", F.col("overflow")).alias("overflow"))
    rejected = fenced_filter(t, F.col("reject_reason").isNotNull()).select("line", "reject_reason")
    report = t.agg(
        F.count_if(F.col("stage").isNull() | (F.col("stage") == "no year")).alias("rows_loaded"),
        F.count_if(F.col("stage").isNull()).alias("rows_after_cleaning"),
        F.count_if(F.col("reject_reason").isNull()).alias("records_built"),
        F.count_if(F.col("stage").isNull() & (F.col("reject_reason") == "no coordinates"))
         .alias("skipped_no_coords"),
        F.count_if(F.col("reject_reason").isNull() & (F.col("year") <= 0)).alias("bc_events"),
        F.count_if("over").alias("overflow_rows"))
    return events, rejected, report
