"""Derived hazard tables over the driver's parquet tables.

The driver's tables hold no storms or tsunamis, so these views map
``events`` -> storm observations (``obs``), ``orders`` -> tsunami events (``ev``)
and ``customer`` -> search sites (``sites``). Each text is valid in both Spark
SQL and DuckDB; Spark registers them over ``spark.read.parquet`` so the scan
keeps projection and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# storm observations: one row per (storm, time) fix, cyclone_points schema
OBS_SQL = """
with e as (
  select event_id, user_id, event_type, value, ts,
         cast(extract(day from ts) as int) as d,
         cast(extract(hour from ts) as int) as h,
         cast(extract(minute from ts) as int) as mi
  from events),
k as (
  select *, cast(floor((d-1)/5.0) as int) as seg,
         cast(user_id*31 + cast(floor((d-1)/5.0) as int) as bigint) as k,
         (cast((d-1) - 5*cast(floor((d-1)/5.0) as int) as int)*1440 + h*60 + mi) as m
  from e),
g as (
  select *,
         cast((k*37)%100 - 50 as double)
           + (case when k%2=0 then 1 else -1 end)*m*0.0009765625 as lat,
         cast((k*73)%360 - 180 as double) + m*0.001953125 as lon0
  from k)
select event_id as obs_id,
       concat('S', cast(user_id as string), '-', cast(seg as string)) as sid,
       cast(1900 + k%120 as int) as season,
       cast(k%40 as int) as number,
       case cast(k%7 as int) when 0 then 'NI' when 1 then 'NA' when 2 then 'SI'
            when 3 then 'EP' when 4 then 'WP' when 5 then 'SP' else null end as basin,
       case cast(k%7 as int) when 0 then 'BB' when 1 then 'CS' when 2 then 'WA'
            when 3 then 'CP' when 4 then 'MM' when 5 then 'EA' else null end as subbasin,
       case when k%5=0 then 'UNNAMED'
            else concat('NAME', cast(k%97 as string)) end as name,
       ts as iso_time,
       case event_type when 'error' then 'TS' when 'click' then 'NR'
            when 'view' then 'ET' when 'signup' then 'MX' else null end as nature,
       lat,
       case when lon0 > 180 then lon0 - 360 else lon0 end as lon,
       case when event_id%7=0 then null when event_id%211=0 then 999
            when event_id%53=0 then 0
            else 15 + cast(floor(value) as int)%150 end as wmo_wind,
       case when event_id%5=0 then null
            else 1010 - cast(floor(value) as int)%120 end as wmo_pres,
       case when event_id%11=0 then null
            else cast((event_id*13)%900 as int) - 5 end as dist2land,
       case when event_id%13=0 then 1 else 0 end as landfall
from g
"""

# tsunami events: tsunami_events schema (45 columns incl. double lat/lon copies).
# Decimal values are built as integer/100.0 so they carry exactly two decimals:
# no half-cent ties, which Spark and DuckDB would round differently.
EV_SQL = """
with o as (
  select o_orderkey, o_custkey, o_totalprice,
         case when o_orderkey%97=0 then null
              when o_orderkey%89=0 then -1 - cast(o_orderkey%2000 as int)
              else 1500 + cast((o_orderkey*17)%520 as int) end as year,
         case when o_orderkey%13=0 then null else 1 + cast(o_orderkey%12 as int) end as month,
         case when o_orderkey%19=0 then null else 1 + cast(o_orderkey%31 as int) end as day,
         case when o_orderkey%17=0 then null else cast((o_orderkey*7)%24 as int) end as hour,
         case when o_orderkey%29=0 then null else cast((o_orderkey*11)%60 as int) end as minute,
         case when o_orderkey%31=0 then null
              else cast(cast((o_orderkey*13)%600 as int)/10.0 as decimal(5,1)) end as second,
         case substring(o_orderpriority,1,1) when '1' then 4 when '2' then 3
              when '3' then 2 when '4' then 1 else null end as event_validity,
         case when o_orderkey%23=0 then null
              else 1 + cast((o_orderkey*7)%12 as int) end as cause_code,
         case when o_orderkey%4=0 then null
              else cast(5 + cast((o_orderkey*3)%45 as int)/10.0 as decimal(4,1)) end as earthquake_magnitude,
         case when o_custkey%31=0 then null
              else concat('COUNTRY_', cast(o_custkey%25 as string)) end as country,
         case when o_orderkey%37=0 then null
              else concat('PLACE_', cast(o_custkey%400 as string)) end as location_name,
         cast((o_orderkey*53)%140 - 70 as double) + cast(o_custkey%64 as double)*0.015625 as lat_d,
         cast((o_orderkey*101)%360 - 180 as double) + cast(o_custkey%32 as double)*0.03125 as lon_d,
         case when o_orderkey%3=0 then null
              else cast(cast((o_orderkey*29)%4000 as int)/100.0 as decimal(8,2)) end as max_water_height,
         case when o_orderkey%5=0 then null else cast(o_orderkey%40 as int) end as num_runups,
         case when o_orderkey%7=0 then cast(cast((o_orderkey*3)%90 as int)/10.0 as decimal(5,2)) else null end as tsunami_magnitude_abe,
         case when o_orderkey%9=0 then cast(cast((o_orderkey*5)%60 as int)/10.0 - 1 as decimal(5,2)) else null end as tsunami_magnitude_iida,
         case when o_orderkey%11=0 then cast(cast((o_orderkey*7)%50 as int)/10.0 as decimal(5,2)) else null end as tsunami_intensity,
         case when o_orderkey%6=0 then cast((o_custkey*11)%3000 as int) else null end as deaths,
         case when o_orderkey%6=0 then 1 + cast(o_custkey%4 as int) else null end as death_description,
         case when o_orderkey%14=0 then cast((o_custkey*3)%200 as int) else null end as missing,
         case when o_orderkey%14=0 then 1 + cast(o_custkey%3 as int) else null end as missing_description,
         case when o_orderkey%8=0 then cast((o_custkey*7)%5000 as int) else null end as injuries,
         case when o_orderkey%8=0 then 1 + cast(o_custkey%4 as int) else null end as injuries_description,
         case when o_orderkey%12=0 then cast(cast((o_custkey*37 + o_orderkey)%100000 as int)/100.0 as decimal(12,2))
              when o_orderkey%12=1 then cast(0 as decimal(12,2)) else null end as damage_mil,
         case when o_orderkey%12=0 then 1 + cast(o_custkey%4 as int) else null end as damage_description,
         case when o_orderkey%15=0 then cast((o_custkey*13)%8000 as int) else null end as houses_destroyed,
         case when o_orderkey%15=0 then 1 + cast(o_custkey%4 as int) else null end as houses_destroyed_desc,
         case when o_orderkey%16=0 then cast((o_custkey*17)%9000 as int) else null end as houses_damaged,
         case when o_orderkey%16=0 then 1 + cast(o_custkey%4 as int) else null end as houses_damaged_desc,
         case when o_orderkey%10=0 then cast((o_custkey*11)%3000 as int) + 5
              when o_orderkey%10=1 then 0 else null end as total_deaths,
         case when o_orderkey%10=0 then 1 + cast(o_custkey%4 as int) else null end as total_death_description,
         case when o_orderkey%18=0 then cast((o_custkey*3)%300 as int) else null end as total_missing,
         case when o_orderkey%18=0 then 1 + cast(o_custkey%3 as int) else null end as total_missing_desc,
         case when o_orderkey%20=0 then cast((o_custkey*7)%6000 as int) else null end as total_injuries,
         case when o_orderkey%20=0 then 1 + cast(o_custkey%4 as int) else null end as total_injuries_desc,
         case when o_orderkey%24=0 then cast(cast((o_custkey*53 + o_orderkey)%200000 as int)/100.0 as decimal(12,2))
              when o_orderkey%24=5 then cast(0 as decimal(12,2)) else null end as total_damage_mil,
         case when o_orderkey%24=0 then 1 + cast(o_custkey%4 as int) else null end as total_damage_desc,
         case when o_orderkey%25=0 then cast((o_custkey*19)%9000 as int) else null end as total_houses_destroyed,
         case when o_orderkey%25=0 then 1 + cast(o_custkey%4 as int) else null end as total_houses_dest_desc,
         case when o_orderkey%26=0 then cast((o_custkey*23)%9900 as int) else null end as total_houses_damaged,
         case when o_orderkey%26=0 then 1 + cast(o_custkey%4 as int) else null end as total_houses_dam_desc
  from orders)
select o_orderkey as id, year, month, day, hour, minute, second,
       event_validity, cause_code, earthquake_magnitude, country, location_name,
       cast(lat_d as decimal(8,5)) as latitude, cast(lon_d as decimal(8,5)) as longitude,
       max_water_height, num_runups, tsunami_magnitude_abe, tsunami_magnitude_iida,
       tsunami_intensity, deaths, death_description, missing, missing_description,
       injuries, injuries_description, damage_mil, damage_description,
       houses_destroyed, houses_destroyed_desc, houses_damaged, houses_damaged_desc,
       total_deaths, total_death_description, total_missing, total_missing_desc,
       total_injuries, total_injuries_desc, total_damage_mil, total_damage_desc,
       total_houses_destroyed, total_houses_dest_desc, total_houses_damaged,
       total_houses_dam_desc, lat_d, lon_d
from o
"""

# search sites: every customer is a site (no subset)
SITES_SQL = """
select c_custkey as site_id,
       cast((c_custkey*41)%120 - 60 as double) + 0.3 as lat,
       cast((c_custkey*67)%360 - 180 as double) + 0.7 as lon,
       cast(case cast(c_custkey%4 as int) when 0 then 100000 when 1 then 200000
            when 2 then 500000 else 2000000 end as double) as radius_m
from customer
"""

SOURCE_TABLES = ("events", "orders", "customer")


def register_sources(spark: SparkSession, sf_dir: str, tables=SOURCE_TABLES) -> None:
    """Temp views over the parquet tables; a scan with fewer splits than cores is
    spread so the derivations above it do not run in one task (no-op at scale)."""
    from ..operators.layout import spread

    for t in tables:
        spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")).createOrReplaceTempView(t)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("events",))
    return spark.sql(OBS_SQL)


def tsunami_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` without ``event_datetime`` (added by :func:`tsunami_events`)."""
    register_sources(spark, sf_dir, ("orders",))
    return spark.sql(EV_SQL)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("customer",))
    return spark.sql(SITES_SQL)


def duck_with(**views: str) -> str:
    """``with a as (...), b as (...)`` prefix for oracle SQL."""
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in views.items()) + "\n"


def tsunami_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tsunami_events: ``ev`` plus event_datetime built from its parts (Q23)."""
    from ..functions.dates import event_datetime

    raw = tsunami_events_raw(spark, sf_dir)
    dt = event_datetime("year", "month", "day", "hour", "minute", "second").alias("event_datetime")
    cols = raw.columns
    i = cols.index("second") + 1
    return raw.select(*cols[:i], dt, *cols[i:])


# Best-track CSV text built from obs (valid in both engines), with dirty cells:
# blank times, unparsable latitudes, longitudes beyond 180, blank names,
# 'NA' basins (read as missing), blank and 'NaN' numbers.
CSV_LINES_SQL = """
select concat_ws(',', sid, cast(season as string), cast(number as string),
  coalesce(basin, ''), coalesce(subbasin, ''),
  case when name = 'UNNAMED' then '' else name end,
  case when obs_id % 83 = 0 then ' ' else
    concat(cast(year(iso_time) as string), '-', lpad(cast(month(iso_time) as string), 2, '0'), '-',
           lpad(cast(day(iso_time) as string), 2, '0'), ' ', lpad(cast(hour(iso_time) as string), 2, '0'), ':',
           lpad(cast(minute(iso_time) as string), 2, '0'), ':',
           lpad(cast(cast(floor(second(iso_time)) as int) as string), 2, '0')) end,
  coalesce(nature, ''),
  case when obs_id % 97 = 0 then 'abc' else printf('%.10f', lat) end,
  case when obs_id % 89 = 0 then printf('%.10f', lon + 360) else printf('%.10f', lon) end,
  coalesce(cast(wmo_wind as string), ' '), coalesce(cast(wmo_pres as string), ''),
  coalesce(cast(dist2land as string), 'NaN'), cast(landfall as string)) as line
from obs
"""


def _tsv_cell(col: str, kind) -> str:
    if col == "year":
        return "case when id % 101 = 0 then '[\"Year >= 1970\"]' else coalesce(cast(year as string), '') end"
    if col == "earthquake_magnitude":
        return ("case when id % 127 = 0 then '12345.6'"
                " else coalesce(cast(earthquake_magnitude as string), '') end")
    if col == "country":
        return ("case when id % 137 = 0 then repeat('C', 101) when id % 43 = 0 then 'NA'"
                " when country is null then '' else concat(' ', country, ' ') end")
    if col == "location_name":
        return ("case when location_name is null then '' when id % 61 = 0 then concat('\"', location_name, ' \"\"X\"\"', chr(9), 'EAST\"')"
                " when id % 67 = 0 then concat('\"', location_name, chr(10), 'NORTH\"') else concat('\"', location_name, '\"') end")
    if col == "injuries":
        return "case when id % 131 = 0 then '2147483649' else coalesce(cast(injuries as string), '') end"
    if col == "latitude":
        return "case when id % 113 = 0 then '91.5' else printf('%.6f', lat_d) end"
    if col == "longitude":
        return "printf('%.6f', lon_d)"
    if col == "deaths":
        return ("case when id % 109 = 0 and deaths is not null then concat(cast(deaths as string), '.0')"
                " else coalesce(cast(deaths as string), '') end")
    return f"coalesce(cast({col} as string), '')"


def tsv_lines_sql() -> str:
    """Tsunami TSV text built from ev (valid in both engines), with a search-parameter
    row marker, quoted and padded cells, quoted tabs, quotes and line breaks, 'NA' countries, '5.0' integers, an
    overflowing magnitude, integer and text, latitudes beyond 90 and lines with an extra cell."""
    from ..sources.tsunami_tsv import FIELDS

    cells = ",\n  ".join(_tsv_cell(c, k) for _, c, k in FIELDS)
    return (f"select concat_ws(chr(9),\n  {cells})"
            f" || case when id % 107 = 0 then concat(chr(9), 'extra') else '' end as line\nfrom ev_raw")
