"""DuckDB SQL for the correctness oracle.

Written independently of the Spark plans: no grid cells, no chunking -- plain
cross joins and window functions over the same derived views. The distance
arithmetic comes from the shared stage text in :mod:`stormgrid.functions.geo`
so both engines evaluate the same formula.
"""

from __future__ import annotations

from ..functions import geo
from . import views

EV_DUCK = """
select * exclude (mo_, dd_, hh_, mi_, ss_),
       case when year is not null and year > 0 and year <= 9999
            and dd_ <= day(last_day(make_date(year, mo_, 1)))
            then make_timestamp(year, mo_, dd_, hh_, mi_, ss_) end as event_datetime
from (select *, greatest(1, least(12, coalesce(nullif(month, 0), 1))) as mo_,
             greatest(1, least(31, coalesce(nullif(day, 0), 1))) as dd_,
             greatest(0, least(23, coalesce(hour, 0))) as hh_,
             greatest(0, least(59, coalesce(minute, 0))) as mi_,
             floor(greatest(0, least(59.9, coalesce(cast(second as double), 0)))) as ss_
      from ev_raw) r"""

VIEWS = views.duck_with(obs=views.OBS_SQL, ev_raw=views.EV_SQL, ev=EV_DUCK, sites=views.SITES_SQL)

VALID_OBS = ("select * from obs where lat is not null and lon is not null"
             " and lat between -90 and 90 and lon between -180 and 180")

TRACKS = f"""
select sid, max(name) as name, max(basin) as basin, max(subbasin) as subbasin,
       max(season) as season, min(iso_time) as start_time, max(iso_time) as end_time,
       cast(datediff('microsecond', min(iso_time), max(iso_time)) as double)
         / cast(3600000000 as double) as duration_hours,
       cast(count(*) as integer) as point_count, max(wmo_wind) as max_wind,
       min(wmo_pres) as min_pressure, max(lat) as max_lat, min(lat) as min_lat,
       max(lon) as max_lon, min(lon) as min_lon
from ({VALID_OBS}) v group by sid having count(*) >= 2"""

SEGMENTS = f"""
select sid, seq, a_lat, a_lon, b_lat, b_lon from (
  select sid, row_number() over w as seq, lat as a_lat, lon as a_lon,
         lead(lat) over w as b_lat, lead(lon) over w as b_lon
  from ({VALID_OBS}) v
  window w as (partition by sid order by iso_time, lon, lat)) x
where b_lat is not null"""

VALID_SITES = ("select * from sites where lat between -90 and 90 and lon between -180 and 180"
               " and radius_m > 0")


def _site_segment_distances(model: str = "spheroid", sites_sql: str = VALID_SITES) -> str:
    src = (f"select s.site_id, s.lat, s.lon, s.radius_m, g.sid, g.seq, g.a_lat, g.a_lon,"
           f" g.b_lat, g.b_lon from ({sites_sql}) s, ({SEGMENTS}) g")
    st = (geo.unit_vector_stages("p", "lat", "lon") + geo.unit_vector_stages("a", "a_lat", "a_lon")
          + geo.unit_vector_stages("b", "b_lat", "b_lon") + geo.segment_prep_stages("s", "a", "b")
          + geo.segment_distance_stages("dist_m", "p", "s", "a", "b", model))
    return geo.stages_sql(src, st)


def hits_sql(model: str = "spheroid") -> str:
    """(site_id, sid, dist_m) for tracks within radius, brute force."""
    d = _site_segment_distances(model)
    return (f"select site_id, sid, min(dist_m) as dist_m from ({d}) d"
            f" where dist_m <= radius_m group by site_id, sid")


def storms_near_sql(model: str = "spheroid") -> str:
    return VIEWS + f"""
, tracks as ({TRACKS})
, hits as ({hits_sql(model)})
select h.site_id, h.sid as storm_id, coalesce(t.name, 'UNNAMED') as cyclone_name,
       t.season as year, t.basin, t.start_time as start_date, t.end_time as end_date,
       round(h.dist_m / 1000.0, 2) as distance_km, t.point_count as num_observations,
       coalesce(t.max_wind, 0) as max_wind_speed, coalesce(t.min_pressure, 0) as min_pressure,
       coalesce(t.duration_hours, 0.0) as duration_hours
from hits h join tracks t on h.sid = t.sid"""


def event_distances_sql(model: str = "spheroid", min_validity: int = 2) -> str:
    src = ("select s.site_id, s.lat, s.lon, s.radius_m, e.* from (" + VALID_SITES + ") s,"
           f" (select * from ev where event_validity >= {min_validity} and lat_d is not null"
           " and lon_d is not null and lat_d between -90 and 90 and lon_d between -180 and 180) e")
    st = geo.point_prep_stages("p", "lat", "lon") + geo.point_prep_stages("q", "lat_d", "lon_d") \
        + geo.distance_stages("dist_m", "p", "q", model)
    return (f"select * from ({geo.stages_sql(src, st)}) d where dist_m <= radius_m")


# ------------------------------------------------------------------ cyclones

def _storm_rows(model: str = "spheroid") -> str:
    return f"""
tracks as ({TRACKS}),
hits as ({hits_sql(model)}),
rows_ as (
  select h.site_id, h.sid as storm_id, coalesce(t.name, 'UNNAMED') as cyclone_name,
         t.season as year, t.basin, t.start_time as start_date, t.end_time as end_date,
         round(h.dist_m / 1000.0, 2) as distance_km, t.point_count as num_observations,
         coalesce(t.max_wind, 0) as max_wind_speed, coalesce(t.min_pressure, 0) as min_pressure,
         coalesce(t.duration_hours, 0.0) as duration_hours
  from hits h join tracks t on h.sid = t.sid),
api as (
  select site_id, storm_id,
         coalesce(nullif(cyclone_name, ''), 'UNNAMED') as cyclone_name,
         coalesce(nullif(year, 0), 0) as year,
         coalesce(nullif(basin, ''), 'Unknown') as basin,
         start_date, end_date, coalesce(distance_km, 0.0) as distance_km, num_observations,
         nullif(max_wind_speed, 0) as max_wind_speed, nullif(min_pressure, 0) as min_pressure,
         nullif(duration_hours, 0.0) as duration_hours
  from rows_),
d2l as (
  select sid as storm_id, min(case when dist2land >= 0 then dist2land end) as min_dist_to_land
  from obs where sid in (select storm_id from api) group by sid),
search as (select a.*, d.min_dist_to_land from api a left join d2l d using (storm_id))
"""


def with_storms(body: str, model: str = "spheroid") -> str:
    return VIEWS + ", " + _storm_rows(model) + body


CYCLONE_SEARCH = with_storms("select * from search")

RESULT_COUNT = with_storms("""
select s.site_id, coalesce(c.n, 0) as cyclones_found
from (""" + VALID_SITES + """) s
left join (select site_id, count(*) as n from hits group by site_id) c using (site_id)""")

MIN_DIST_TO_LAND = VIEWS + """
select sid, min(case when dist2land >= 0 then dist2land end) as min_dist_to_land
from obs group by sid"""

STORM_SEMI = with_storms("""
select obs_id, sid, iso_time, wmo_wind from obs where sid in (select sid from hits)""")


def nearest_sql(model: str = "spheroid") -> str:
    d = _site_segment_distances(model, VALID_SITES + " and site_id not in (select site_id from hits)")
    return with_storms(f"""
, best as (
  select site_id, sid, dist_m from (
    select site_id, sid, dist_m,
           row_number() over (partition by site_id order by dist_m, sid) as rn
    from ({d}) x) y where rn = 1)
select b.site_id, b.sid as storm_id, coalesce(t.name, 'UNNAMED') as cyclone_name,
       t.season as year, round(b.dist_m / 1000.0, 2) as distance_km
from best b join tracks t using (sid)""")


BUILD_TRACKS = VIEWS + TRACKS

TRACK_SEGMENTS = VIEWS + f"""
select sid, seq, a_time, a_lat, a_lon, a_wind, b_time, b_lat, b_lon from (
  select sid, row_number() over w as seq, iso_time as a_time, lat as a_lat, lon as a_lon,
         wmo_wind as a_wind, lead(iso_time) over w as b_time, lead(lat) over w as b_lat,
         lead(lon) over w as b_lon
  from ({VALID_OBS}) v
  window w as (partition by sid order by iso_time, lon, lat)) x
where b_lat is not null"""

OBS_POSITION = VIEWS + f"""
select obs_id, sid, iso_time, k, n, k = 1 as is_first, k = n as is_last,
       case when k = 1 then ' (Start)' when k = n then ' (End)' else '' end as position_label
from (select obs_id, sid, iso_time,
             row_number() over (partition by sid order by iso_time, lon, lat) as k,
             count(*) over (partition by sid) as n
      from ({VALID_OBS}) v) x"""

TRACK_POINTS_SEL = """
select sid as storm_id, lat, lon, iso_time, nullif(wmo_wind, 0) as wind_speed,
       nullif(wmo_pres, 0) as pressure, nature,
       case when dist2land >= 0 then dist2land end as dist2land
from obs where lat is not null and lon is not null"""

TRACK_POINTS = VIEWS + TRACK_POINTS_SEL

# storm ids requested by lookups: derived from customer keys (some exist, some not)
REQUESTED_SIDS = ("select distinct concat('S', cast(c_custkey % 2000 as string), '-',"
                  " cast(c_custkey % 7 as string)) as sid from customer")
REQUESTED_EVENT_IDS = "select distinct c_custkey * 53 as id from customer"

STORM_LOOKUP = VIEWS + TRACK_POINTS_SEL + f" and sid in ({REQUESTED_SIDS})"

NOT_FOUND_STORMS = VIEWS + f", tracks as ({TRACKS})\n" + \
    f"select sid from ({REQUESTED_SIDS}) r where sid not in (select sid from tracks)"

NOT_FOUND_EVENTS = VIEWS + f"select id from ({REQUESTED_EVENT_IDS}) r where id not in (select id from ev)"

CYCLONE_STATS = VIEWS + f""", tracks as ({TRACKS})
select count(*) as total_tracks, min(season) as earliest_year, max(season) as latest_year,
       count(distinct basin) as unique_basins, sum(point_count) as total_observations
from tracks"""

BASIN_DISTRIBUTION = VIEWS + f""", tracks as ({TRACKS})
select basin, count(*) as count from tracks group by basin"""

LATEST_TRACKS = VIEWS + f""", tracks as ({TRACKS})
select sid, name, season, point_count, start_time, end_time from tracks
order by season desc nulls last, sid limit 5"""

VERIFY_COUNTS = VIEWS + f""", tracks as ({TRACKS})
select (select count(*) from obs) as total_points,
       (select count(distinct sid) from obs) as unique_storms,
       (select count(*) from tracks) as total_tracks,
       (select count(*) from ev) as total_tsunamis"""

WIND_BUCKETS = with_storms("""
select site_id,
  count(*) filter (where max_wind_speed is not null and max_wind_speed <> 0 and max_wind_speed < 34) as weak,
  count(*) filter (where max_wind_speed >= 34 and max_wind_speed < 64) as moderate,
  count(*) filter (where max_wind_speed >= 64 and max_wind_speed < 96) as strong,
  count(*) filter (where max_wind_speed >= 96) as very_strong,
  count(*) filter (where max_wind_speed is null or max_wind_speed = 0) as na,
  coalesce(max(case when max_wind_speed > 0 then max_wind_speed end), 0) as max_wind,
  case when floor(avg(case when max_wind_speed <> 0 then max_wind_speed end) + 0.5) > 0
       then cast(floor(avg(case when max_wind_speed <> 0 then max_wind_speed end) + 0.5) as bigint) end as avg_wind,
  count(*) filter (where max_wind_speed is not null and max_wind_speed <> 0) as with_data,
  count(*) as total,
  round(count(*) filter (where max_wind_speed is not null and max_wind_speed <> 0 and max_wind_speed < 34) * 100.0 / count(*), 1)::double as weak_pct,
  round(count(*) filter (where max_wind_speed >= 34 and max_wind_speed < 64) * 100.0 / count(*), 1)::double as moderate_pct,
  round(count(*) filter (where max_wind_speed >= 64 and max_wind_speed < 96) * 100.0 / count(*), 1)::double as strong_pct,
  round(count(*) filter (where max_wind_speed >= 96) * 100.0 / count(*), 1)::double as very_strong_pct,
  round(count(*) filter (where max_wind_speed is null or max_wind_speed = 0) * 100.0 / count(*), 1)::double as na_pct
from search group by site_id""")

YEAR_RANGE_STORMS = with_storms("select * from search where year >= 1950 and year <= 2000")

SORT_STORMS_WIND = with_storms("""
select *, row_number() over (partition by site_id order by
          case when max_wind_speed > 0 then 0 else 1 end, coalesce(max_wind_speed, 0) desc,
          distance_km, storm_id) as rank
from search""")

STORM_CLASSES = with_storms("""
select *,
  case when max_wind_speed is null or max_wind_speed <= 0 then 'N/A'
       when max_wind_speed < 34 then 'Tropical Depression' when max_wind_speed < 64 then 'Tropical Storm'
       when max_wind_speed < 83 then 'Hurricane Cat 1' when max_wind_speed < 96 then 'Hurricane Cat 2'
       when max_wind_speed < 113 then 'Hurricane Cat 3' when max_wind_speed < 137 then 'Hurricane Cat 4'
       else 'Hurricane Cat 5' end as category,
  case when max_wind_speed is null or max_wind_speed <= 0 then ''
       when max_wind_speed >= 64 then 'high' when max_wind_speed >= 34 then 'medium' else 'low' end as wind_class,
  case when max_wind_speed is null or max_wind_speed = 0 then 'N/A'
       when max_wind_speed < 34 then 'Weak' when max_wind_speed < 64 then 'Moderate'
       when max_wind_speed < 96 then 'Strong' else 'Very strong' end as wind_bucket
from search""")

VISIBLE_TRACKS = with_storms("""
select * from tracks where sid in (select storm_id from search where year >= 1950 and year <= 2000)""")


# ------------------------------------------------------------------ tsunamis

def events_near_sql(model: str = "spheroid") -> str:
    cols = ("id, year, month, day, event_datetime, event_validity, cause_code, earthquake_magnitude,"
            " country, location_name, latitude, longitude, max_water_height, num_runups, deaths,"
            " total_deaths, damage_mil, total_damage_mil, houses_destroyed, total_houses_destroyed")
    return VIEWS + f"""
select site_id, {cols}, round_even(dist_m / 1000.0, 0) as distance_km
from ({event_distances_sql(model)}) d"""


def tsunami_search_sql(model: str = "spheroid") -> str:
    return VIEWS + f"""
, near as (select site_id, round_even(dist_m / 1000.0, 0) as distance_km, * exclude (site_id)
           from ({event_distances_sql(model)}) d)
select site_id, id, year, month, day, event_validity, cause_code,
       nullif(cast(earthquake_magnitude as double), 0) as earthquake_magnitude,
       country, location_name,
       nullif(cast(latitude as double), 0) as latitude, nullif(cast(longitude as double), 0) as longitude,
       nullif(cast(max_water_height as double), 0) as max_water_height, num_runups, deaths, total_deaths,
       nullif(cast(damage_mil as double), 0) as damage_mil,
       nullif(cast(total_damage_mil as double), 0) as total_damage_mil,
       houses_destroyed, total_houses_destroyed, nullif(cast(distance_km as double), 0) as distance_km
from near"""


TSUNAMI_STATS = VIEWS + """
select count(*) as total_events, count(*) filter (where event_validity >= 3) as reliable_events,
       min(year) as year_min, max(year) as year_max,
       cast(round(avg(earthquake_magnitude), 2) as double) as avg_magnitude,
       cast(max(max_water_height) as double) as max_water_height,
       sum(total_deaths) as total_deaths,
       count(*) filter (where max_water_height is not null) as events_with_height,
       count(*) filter (where total_deaths > 0) as events_with_deaths
from ev"""

TOP_COUNTRIES = VIEWS + """
select country, count(*) as count from ev where country is not null
group by country order by count desc, country limit 10"""

CAUSE_LABEL_CASE = """case cause_code when 1 then 'Earthquake' when 2 then 'Earthquake + Landslide'
  when 3 then 'Earthquake + Volcano' when 4 then 'Earthquake + Landslide + Volcano'
  when 5 then 'Volcano' when 6 then 'Volcano + Earthquake' when 7 then 'Volcano + Landslide'
  when 8 then 'Landslide' when 9 then 'Meteorological' when 10 then 'Explosion'
  when 11 then 'Astronomical Tide' else 'Unknown' end"""

CAUSE_DISTRIBUTION = VIEWS + f"""
select cause_code, {CAUSE_LABEL_CASE} as label, count(*) as count
from ev where cause_code is not null group by cause_code"""

IMPORT_SUMMARY = VIEWS + """
select min(year) as earliest, max(year) as latest,
       count(*) filter (where event_validity >= 3) as reliable_events,
       count(*) filter (where max_water_height is not null) as with_height,
       count(*) filter (where total_deaths > 0) as with_deaths,
       cast(round(avg(earthquake_magnitude), 2) as double) as avg_magnitude
from ev"""

EVENT_DETAIL = VIEWS + f"""
select id, year, month, day, hour, minute, event_datetime, event_validity, cause_code,
       earthquake_magnitude, country, location_name, latitude, longitude, max_water_height,
       num_runups, tsunami_magnitude_abe, tsunami_magnitude_iida, deaths, missing, injuries,
       damage_mil, houses_destroyed, houses_damaged, total_deaths, total_missing, total_injuries,
       total_damage_mil, total_houses_destroyed, total_houses_damaged
from ev where id in ({REQUESTED_EVENT_IDS})"""

EVENT_VALIDITY_FILTER = VIEWS + "select id, event_validity from ev where event_validity >= 2"


# ------------------------------------------------------------------ wind risk

def obs_distances_sql(model: str = "spheroid", where: str = "true") -> str:
    src = ("select s.site_id, s.lat, s.lon, s.radius_m, o.obs_id, o.sid, o.wmo_wind,"
           " o.lat as o_lat, o.lon as o_lon from (" + VALID_SITES + ") s,"
           f" (select * from ({VALID_OBS}) v where {where}) o")
    st = geo.point_prep_stages("p", "lat", "lon") + geo.point_prep_stages("q", "o_lat", "o_lon") \
        + geo.distance_stages("dist_m", "p", "q", model)
    return f"select * from ({geo.stages_sql(src, st)}) d where dist_m <= radius_m"


USABLE = "wmo_wind is not null and wmo_wind > 0 and wmo_wind <= 250"

MAXIMA_CTE = f""",
maxima as (
  select o.site_id, o.sid, max(o.wmo_wind) as max_wind
  from ({obs_distances_sql(where=USABLE)}) o
  where (o.site_id, o.sid) in (select site_id, sid from hits)
  group by o.site_id, o.sid)
"""

OBS_NEAR = VIEWS + (f"select site_id, obs_id, sid, wmo_wind, round(dist_m / 1000.0, 2) as distance_km"
                    f" from ({obs_distances_sql()}) d")

OBS_COUNT = VIEWS + f"""
select s.site_id, coalesce(c.n, 0) as observations_found
from ({VALID_SITES}) s left join (select site_id, count(*) as n from ({obs_distances_sql()}) d group by site_id) c using (site_id)"""

BLOCK_MAXIMA = with_storms(MAXIMA_CTE + "select * from maxima")

def binary_round(x: str, digits: int) -> str:
    """Rounding of the exact binary value: correctly rounded text, read back."""
    return f"cast(printf('%.{digits}f', cast({x} as double)) as double)"


SAMPLE_STATS_SEL = f"""
select site_id, count(*) as sample_count, {binary_round("avg(cast(max_wind as double))", 1)} as wind_mean,
       {binary_round("stddev_pop(cast(max_wind as double))", 1)} as wind_std, {binary_round("min(max_wind)", 1)} as wind_min,
       {binary_round("max(max_wind)", 1)} as wind_max, {binary_round("quantile_cont(cast(max_wind as double), 0.5)", 1)} as wind_median
from maxima group by site_id"""
SAMPLE_STATS = with_storms(MAXIMA_CTE + SAMPLE_STATS_SEL)

WIND_PERCENTILES = with_storms(MAXIMA_CTE + """
select site_id, quantile_cont(cast(max_wind as double), cast(0.98 as double)) as p98,
       quantile_cont(cast(max_wind as double), cast(0.99 as double)) as p99
from maxima group by site_id""")

WIND_HISTOGRAM = with_storms(MAXIMA_CTE + """,
rng as (
  select site_id, case when mn = mx then mn - 0.5 else mn end as lo,
         case when mn = mx then mx + 0.5 else mx end as hi
  from (select site_id, cast(min(max_wind) as double) as mn, cast(max(max_wind) as double) as mx
        from maxima group by site_id) r),
edges as (
  select site_id, b as bin, lo + b * ((hi - lo) / 25) as e0, lo + (b + 1) * ((hi - lo) / 25) as e1, hi
  from rng, (select unnest(generate_series(0, 24)) as b) g)
select e.site_id, e.bin, """ + binary_round("(e.e0 + e.e1) / 2", 1) + """ as bin_center,
       (select count(*) from maxima m where m.site_id = e.site_id
          and cast(m.max_wind as double) >= e.e0
          and (cast(m.max_wind as double) < e.e1 or (e.bin = 24 and cast(m.max_wind as double) <= e.hi))
       ) as bin_count
from edges e""")


def _iso(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({ts}) % 1000000 = 0 then '' else strftime({ts}, '.%f') end, '')"


TRACK_ISO_TIMES = VIEWS + f", tracks as ({TRACKS})\nselect sid, {_iso('start_time')} as start_date, {_iso('end_time')} as end_date from tracks"


def _short_class(x: str) -> str:
    return (f"case when {x} < 34 then 'TD' when {x} < 64 then 'TS' when {x} < 83 then 'Cat 1' when {x} < 96 then 'Cat 2'"
            f" when {x} < 113 then 'Cat 3' when {x} < 137 then 'Cat 4' else 'Cat 5' end")


WIND_LEVEL_CLASSES = with_storms(MAXIMA_CTE + f", stats as ({SAMPLE_STATS_SEL})\n"
                                 f"select site_id, {_short_class('wind_mean')} as mean_class, {_short_class('wind_max')} as max_class from stats")

REJECTED_SITES = VIEWS + """
select site_id, case when site_id % 11 = 0 or site_id % 13 = 0 then 'Latitude out of range' when site_id % 17 = 0 then 'Longitude out of range'
                     else 'Radius must be positive' end as reject_reason
from sites where site_id % 11 = 0 or site_id % 13 = 0 or site_id % 17 = 0 or site_id % 19 = 0"""

# Given parameters: no fit, so everything after it can be checked.
GIVEN_FITS = """
given as (
  select c_custkey as site_id, (c_custkey % 7 - 3) * 0.05e0 as shape, 40e0 + c_custkey % 23 as loc, 5e0 + c_custkey % 11 as scale
  from customer),
levels as (
  select *, case when shape = 0 then loc - scale * ln(-ln(0.98e0)) else loc + scale * (1 - pow(-ln(0.98e0), shape)) / shape end as w50,
         case when shape = 0 then loc - scale * ln(-ln(0.99e0)) else loc + scale * (1 - pow(-ln(0.99e0), shape)) / shape end as w100
  from given)"""

RETURN_LEVELS_GIVEN = f"""with {GIVEN_FITS}
select site_id, 'gev' as fit_method, {binary_round("w50", 1)} as w50, {binary_round("w100", 1)} as w100 from levels"""

PDF_CTE = f"""
ends as (
  select site_id, count(*) as n, cast(min(max_wind) as double) as mn, cast(max(max_wind) as double) as mx,
         case when min(max_wind) = max(max_wind) then 1e0 / 25 else (cast(max(max_wind) as double) - min(max_wind)) / 25 end as width
  from maxima group by site_id),
grid as (
  select e.*, g.i, case when g.i = 299 then mx * 1.15e0 else greatest(0e0, mn - width) + g.i * ((mx * 1.15e0 - greatest(0e0, mn - width)) / 299) end as x
  from ends e, (select unnest(generate_series(0, 299)) as i) g),
curve as (
  select *, case when shape = 0 then exp(-(x - loc) / scale - exp(-(x - loc) / scale)) / scale
                 when 1 - shape * (x - loc) / scale > 0
                 then pow(1 - shape * ((x - loc) / scale), 1 / shape - 1) * exp(-pow(1 - shape * ((x - loc) / scale), 1 / shape)) / scale else 0 end as density
  from grid join levels using (site_id))"""

FITTED_PDF_GIVEN = with_storms(MAXIMA_CTE + "," + GIVEN_FITS + "," + PDF_CTE + f"""
select site_id, i, {binary_round("x", 1)} as x, {binary_round("density * width * n", 2)} as y from curve""")

WIND_ANALYSIS_GIVEN = with_storms(MAXIMA_CTE + "," + GIVEN_FITS + f""",
stats as ({SAMPLE_STATS_SEL}),
found as (select site_id, count(*) as storm_count from hits group by site_id),
r as (select s.site_id, s.radius_m, coalesce(f.storm_count, 0) as sc, coalesce(t.sample_count, 0) as n, t.*  exclude (site_id, sample_count), g.* exclude (site_id)
      from ({VALID_SITES}) s left join found f using (site_id) left join stats t using (site_id) left join levels g using (site_id))
select site_id, n as sample_count, sc as storm_count, sc = 0 or n < 5 as insufficient_data,
       case when sc = 0 then 'No storms pass within this radius — try a larger search radius.'
            when n < 5 then 'Only ' || n || ' storms have wind data inside the radius — need ≥5 for a reliable GEV fit.' end as message,
       case when n >= 5 then wind_mean end as wind_mean, case when n >= 5 then wind_std end as wind_std, case when n >= 5 then wind_min end as wind_min,
       case when n >= 5 then wind_max end as wind_max, case when n >= 5 then wind_median end as wind_median,
       case when n >= 5 then {binary_round("shape", 4)} end as shape, case when n >= 5 then {binary_round("w50", 1)} end as w50,
       case when n >= 5 then {binary_round("w100", 1)} end as w100, cast(floor(radius_m / 1000) as bigint) as distance_km
from r""")


# ------------------------------------------------------------------ ingest

def _tokens_sql() -> str:
    from ..sources.best_track import DEFAULT_NULL_TOKENS
    return ", ".join("'" + t.replace("'", "''") + "'" for t in DEFAULT_NULL_TOKENS)


def best_track_classified_sql() -> str:
    from ..sources.best_track import BEST_TRACK_COLUMNS
    tok = _tokens_sql()
    cells = ",\n  ".join(
        f"case when l[{i + 1}] is null or l[{i + 1}] in ({tok}) then null else l[{i + 1}] end as {c}"
        for i, c in enumerate(BEST_TRACK_COLUMNS))

    def ti(c):
        d = f"try_cast({c} as double)"
        return (f"case when isnan({d}) or abs({d}) >= 2147483648 then null"
                f" else cast(trunc({d}) as integer) end")

    return f"""
lines as ({views.CSV_LINES_SQL}),
cells as (select {cells} from (select string_split(line, ',') as l from lines) s),
typed as (
  select SID as sid, {ti('SEASON')} as season, {ti('NUMBER')} as number, BASIN as basin,
         SUBBASIN as subbasin, coalesce(NAME, 'UNNAMED') as name,
         try_cast(ISO_TIME as timestamp) as iso_time, NATURE as nature,
         case when isnan(try_cast(LAT as double)) then null else try_cast(LAT as double) end as lat,
         case when isnan(try_cast(LON as double)) then null else try_cast(LON as double) end as lon,
         {ti('WMO_WIND')} as wmo_wind, {ti('WMO_PRES')} as wmo_pres,
         {ti('DIST2LAND')} as dist2land, {ti('LANDFALL')} as landfall
  from cells),
classified as (
  select *, case when lat is null or lon is null then 'no position'
                 when iso_time is null then 'bad time'
                 when sid is null then 'no storm id'
                 when not (lat between -90 and 90 and lon between -180 and 180)
                   then 'position out of range' end as reject_reason
  from typed)
"""


READ_BEST_TRACK = VIEWS + ", " + best_track_classified_sql() + """
select sid, season, number, basin, subbasin, name, iso_time, nature, lat, lon, wmo_wind,
       wmo_pres, dist2land, landfall from classified where reject_reason is null"""

BEST_TRACK_REJECTS = VIEWS + ", " + best_track_classified_sql() + """
select * from classified where reject_reason is not null"""

INGEST_REPORT = VIEWS + ", " + best_track_classified_sql() + """
select count(*) as rows_read, count(*) filter (where reject_reason is null) as rows_kept,
       count(*) filter (where reject_reason is not null) as rows_removed,
       count(distinct case when reject_reason is null then sid end) as unique_storms,
       min(case when reject_reason is null then season end) as season_min,
       max(case when reject_reason is null then season end) as season_max
from classified"""


# What the text of views.tsv_lines_sql must read as, from the rows it was written from: no
# text is parsed here.
TSV_ROWS = """
tsv_rows as (
  select *, id % 107 <> 0 as loaded, id % 107 <> 0 and id % 101 <> 0 and year is not null as cleaned,
         id % 113 <> 0 as placed, not (id % 127 = 0 or id % 131 = 0 or id % 137 = 0) as fits
  from ev)
"""

READ_TSUNAMI_TSV = VIEWS + ", " + TSV_ROWS + """
select * exclude (id, loaded, cleaned, placed, fits)
       replace (case when id % 43 <> 0 then country end as country,
                case when id % 61 = 0 then location_name || ' "X"' || chr(9) || 'EAST'
                     when id % 67 = 0 then location_name || chr(10) || 'NORTH' else location_name end as location_name,
                case when id % 109 <> 0 then deaths end as deaths),
       cast(null as varchar) as overflow
from tsv_rows where cleaned and placed and fits"""

TSUNAMI_INGEST_REPORT = VIEWS + ", " + TSV_ROWS + """
select count(*) filter (where loaded) as rows_loaded, count(*) filter (where cleaned) as rows_after_cleaning,
       count(*) filter (where cleaned and placed and fits) as records_built,
       count(*) filter (where cleaned and not placed) as skipped_no_coords,
       count(*) filter (where cleaned and placed and fits and year <= 0) as bc_events,
       count(*) filter (where cleaned and placed and not fits) as overflow_rows
from tsv_rows"""


# ------------------------------------------------------------------ exports

def fx(x: str, d: int) -> str:
    """toFixed(d): half away from zero on the value, as text."""
    return f"printf('%.{d}f', round(cast({x} as double) * 1e{d}) / 1e{d})"


def jsnum(x: str) -> str:
    return (f"regexp_replace(regexp_replace(cast(cast({x} as decimal(38,10)) as varchar),"
            f" '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")


def q(x: str) -> str:
    return f"concat('\"', replace({x}, '\"', '\"\"'), '\"')"


def gj(x: str) -> str:
    return (f"regexp_replace(regexp_replace(printf('%.9f', round(cast({x} as double) * 1e9) / 1e9),"
            f" '0+$', ''), '\\.$', '')")


WKT_CTE = f""",
wkt as (
  select sid as storm_id,
         concat('LINESTRING(', string_agg(concat({fx('lon', 4)}, ' ', {fx('lat', 4)}), ', '
                order by iso_time, lon, lat), ')') as track_wkt
  from ({VALID_OBS}) v group by sid)
"""

TRACK_WKT = VIEWS + WKT_CTE + "select * from wkt"

# pieces of 512 fixes
TRACK_LINE = VIEWS + f"""
select sid, (k - 1) // 512 as piece, cast(count(*) as integer) as n_points, min(iso_time) as start_time, max(iso_time) as end_time,
       string_agg(concat({fx('lon', 4)}, ' ', {fx('lat', 4)}), ', ' order by k) as coordinates
from (select sid, lon, lat, iso_time, row_number() over (partition by sid order by iso_time, lon, lat) as k from ({VALID_OBS}) v) x
group by sid, (k - 1) // 512"""

TRACK_GEOJSON = VIEWS + f""", tracks as ({TRACKS}),
gj as (
  select sid, concat('{{"type":"LineString","coordinates":[',
         string_agg(concat('[', {gj('lon')}, ',', {gj('lat')}, ']'), ',' order by iso_time, lon, lat),
         ']}}') as geojson
  from ({VALID_OBS}) v group by sid)
select t.sid, coalesce(t.name, 'UNNAMED') as name, t.season, g.geojson
from tracks t join gj g using (sid)"""

EXPORT_CYCLONE_CSV = with_storms(WKT_CTE + f"""
select s.site_id, s.storm_id, s.distance_km,
  concat_ws(',', {q('s.cyclone_name')}, cast(s.year as varchar), {q("coalesce(s.basin, 'N/A')")},
    {fx('s.distance_km', 2)},
    coalesce(cast(nullif(s.max_wind_speed, 0) as varchar), 'N/A'),
    coalesce(cast(nullif(s.min_pressure, 0) as varchar), 'N/A'),
    coalesce(cast(s.min_dist_to_land as varchar), 'N/A'),
    strftime(s.start_date, '%Y-%m-%d'), strftime(s.end_date, '%Y-%m-%d'),
    case when s.duration_hours is not null and s.duration_hours <> 0
         then {fx('s.duration_hours', 1)} else 'N/A' end,
    case when w.track_wkt is not null then {q('w.track_wkt')} else 'N/A' end) as csv_line
from search s left join wkt w using (storm_id)""")


def export_tsunami_csv_sql() -> str:
    def truthy(c):
        return f"({c} is not null and {c} <> 0)"
    return tsunami_search_sql().replace("\nselect site_id, id, year,", "\n, ts as (select site_id, id, year,", 1) \
        + f""")
select site_id, id, distance_km,
  concat_ws(',', {q("coalesce(nullif(location_name, ''), 'Unknown')")},
    {q("coalesce(nullif(country, ''), 'N/A')")},
    case when {truthy('year')} then cast(year as varchar) else 'N/A' end,
    case when {truthy('distance_km')} then {fx('distance_km', 2)} else 'N/A' end,
    case when {truthy('max_water_height')} then {fx('max_water_height', 2)} else 'N/A' end,
    case when {truthy('earthquake_magnitude')} then {jsnum('earthquake_magnitude')} else 'N/A' end,
    coalesce(cast(nullif(total_deaths, 0) as varchar), cast(nullif(deaths, 0) as varchar), 'N/A'),
    coalesce(case when {truthy('total_damage_mil')} then {jsnum('total_damage_mil')} end,
             case when {truthy('damage_mil')} then {jsnum('damage_mil')} end, 'N/A')) as csv_line
from ts"""


# ------------------------------------------------------------------ tsunami result rows

def tsunami_rows_sql() -> str:
    months = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
    return tsunami_search_sql().replace("\nselect site_id, id, year,", "\n, ts as (select site_id, id, year,", 1) \
        + f""")
select *,
  case when country is not null and country <> ''
       then concat_ws(', ', coalesce(location_name, 'Unknown'), country)
       else coalesce(location_name, 'Unknown') end as full_location,
  case when year is null or year = 0 then 'Unknown' else
    concat_ws(' ', case when day is not null and day <> 0 then cast(day as varchar) end,
              case when month between 1 and 12 then {months}[month] end, cast(year as varchar)) end as date_label,
  case when year is null or year = 0 then 'Unknown' else
    concat(cast(year as varchar),
           coalesce(case when month is not null and month <> 0 then concat('-', lpad(cast(month as varchar), 2, '0')) end, ''),
           coalesce(case when day is not null and day <> 0 then concat('-', lpad(cast(day as varchar), 2, '0')) end, '')) end as date_iso,
  {CAUSE_LABEL_CASE} as cause_label,
  case event_validity when 1 then 'Very Doubtful' when 2 then 'Questionable' when 3 then 'Probable'
       when 4 then 'Definite' end as validity_label,
  case when max_water_height is not null and max_water_height <> 0 and max_water_height >= 10 then 'catastrophic'
       when max_water_height is not null and max_water_height <> 0 and max_water_height >= 5 then 'major'
       when max_water_height is not null and max_water_height <> 0 and max_water_height >= 2 then 'moderate'
       else 'minor' end as height_class,
  case when max_water_height is null or max_water_height = 0 then 'unknown'
       when max_water_height >= 30 then 'catastrophic' when max_water_height >= 10 then 'severe'
       when max_water_height >= 5 then 'major' when max_water_height >= 2 then 'moderate'
       else 'minor' end as height_class_detailed,
  coalesce(nullif(total_deaths, 0), nullif(deaths, 0)) as deaths_shown,
  coalesce(nullif(cast(total_damage_mil as double), 0), nullif(cast(damage_mil as double), 0)) as damage_shown
from ts"""


def tsunami_year_range_sql() -> str:
    return tsunami_search_sql().replace("\nselect site_id, id, year,", "\n, ts as (select site_id, id, year,", 1) \
        + """)
select * from ts where year is not null and year <> 0 and year >= 1700 and year <= 1900"""


def tsunami_sort_sql() -> str:
    return tsunami_search_sql().replace("\nselect site_id, id, year,", "\n, ts as (select site_id, id, year,", 1) \
        + """)
select *, row_number() over (partition by site_id order by
          case when max_water_height > 0 then 0 else 1 end, coalesce(max_water_height, 0) desc,
          coalesce(distance_km, 0) asc, id) as rank
from ts"""


SEARCH_ARGS = VIEWS + """
select site_id, k.kind,
       coalesce(lat between -90 and 90 and lon between -180 and 180 and radius_m between k.lo and k.hi,
                false) as accepted
from sites, (values ('cyclone', 1000, 1000000), ('wind', 10000, 2000000),
                    ('tsunami', 10000, 5000000)) k(kind, lo, hi)"""

POINT_CLASSES = VIEWS + f"""
select obs_id, sid, k, n,
  case when k = 1 then ' (Start)' when k = n then ' (End)' else '' end as position_label,
  case when wind_speed is null or wind_speed <= 0 then 'N/A'
       when wind_speed < 34 then 'Tropical Depression' when wind_speed < 64 then 'Tropical Storm'
       when wind_speed < 83 then 'Hurricane Cat 1' when wind_speed < 96 then 'Hurricane Cat 2'
       when wind_speed < 113 then 'Hurricane Cat 3' when wind_speed < 137 then 'Hurricane Cat 4'
       else 'Hurricane Cat 5' end as category,
  case when nature is null then 'N/A' when nature = 'TS' then 'Tropical Storm'
       when nature = 'HU' then 'Hurricane' when nature = 'TD' then 'Tropical Depression'
       when nature = 'ET' then 'Extratropical' when nature = 'SD' then 'Sub-tropical Depr.'
       when nature = 'SS' then 'Sub-tropical Storm' when nature = 'NR' then 'Not Reported'
       when nature = 'MX' then 'Mixed' else nature end as nature_label
from (select obs_id, sid, nature, nullif(wmo_wind, 0) as wind_speed,
             row_number() over (partition by sid order by iso_time, lon, lat) as k,
             count(*) over (partition by sid) as n
      from ({VALID_OBS}) v) x"""

TRACKS_FOR_RESULTS = with_storms("""
select s.site_id, s.storm_id, o.obs_id, o.iso_time, o.lat, o.lon, nullif(o.wmo_wind, 0) as wind_speed
from search s join tracks t on t.sid = s.storm_id join obs o on o.sid = t.sid""")


# ------------------------------------------------------------------ more shaping / sinks

WRITE_POINTS = VIEWS + "select * from obs"

WRITE_EVENTS = VIEWS + "select * from ev"

EVENT_DETAIL_API = VIEWS + f"""
select id, year, month, day, hour, minute, event_validity, cause_code,
       nullif(cast(earthquake_magnitude as double), 0) as earthquake_magnitude, country, location_name,
       nullif(cast(latitude as double), 0) as latitude, nullif(cast(longitude as double), 0) as longitude,
       nullif(cast(max_water_height as double), 0) as max_water_height, num_runups,
       nullif(cast(tsunami_magnitude_abe as double), 0) as tsunami_magnitude_abe,
       nullif(cast(tsunami_magnitude_iida as double), 0) as tsunami_magnitude_iida,
       deaths, missing, injuries, nullif(cast(damage_mil as double), 0) as damage_mil,
       houses_destroyed, houses_damaged, total_deaths, total_missing, total_injuries,
       nullif(cast(total_damage_mil as double), 0) as total_damage_mil,
       total_houses_destroyed, total_houses_damaged
from ev where id in ({REQUESTED_EVENT_IDS})"""

TSUNAMI_STATS_API = VIEWS + """
select total_events, reliable_events, year_min, year_max, nullif(avg_magnitude, 0) as avg_magnitude,
       nullif(max_water_height, 0) as max_water_height, nullif(total_deaths, 0) as total_deaths,
       events_with_height, events_with_deaths
from (""" + TSUNAMI_STATS.replace(VIEWS, "", 1) + ") s"

# fixed smoke parameters of the post-import check
SMOKE_SITES = ("select * from (values (1, 19.0760, 72.8777, 100000.0), (2, 12.0, 80.0, 1000000.0))"
               " v(site_id, lat, lon, radius_m)")


def verify_search_smoke_sql() -> str:
    seg_d = _site_segment_distances("spheroid", "select site_id, cast(lat as double) as lat,"
                                    " cast(lon as double) as lon, cast(radius_m as double) as radius_m"
                                    " from (" + SMOKE_SITES + ") s where site_id = 1")
    src = ("select s.site_id, s.lat, s.lon, s.radius_m, e.* from (select site_id, cast(lat as double) as lat,"
           " cast(lon as double) as lon, cast(radius_m as double) as radius_m from (" + SMOKE_SITES +
           ") s0 where site_id = 2) s, (select * from ev where event_validity >= 2 and lat_d is not null"
           " and lon_d is not null) e")
    st = geo.point_prep_stages("p", "lat", "lon") + geo.point_prep_stages("q", "lat_d", "lon_d") \
        + geo.distance_stages("dist_m", "p", "q")
    return VIEWS + f"""
select (select count(distinct sid) from ({seg_d}) d where dist_m <= radius_m) as storms_near_mumbai_100km,
       (select count(*) from ({geo.stages_sql(src, st)}) d where dist_m <= radius_m) as tsunamis_near_12n80e_1000km"""


RESULT_COUNT_FILTERED = with_storms("""
select s.site_id, coalesce(a.n_all, 0) as results_total, coalesce(a.n_kept, 0) as results_shown
from (""" + VALID_SITES + """) s left join (
  select site_id, count(*) as n_all,
         count(*) filter (where year >= 1950 and year <= 2000) as n_kept
  from search group by site_id) a using (site_id)""")


def tsunami_result_count_sql() -> str:
    return VIEWS + f"""
select s.site_id, coalesce(c.n, 0) as tsunamis_found
from ({VALID_SITES}) s left join (
  select site_id, count(*) as n from ({event_distances_sql()}) d group by site_id) c using (site_id)"""


ORDER_BY_DISTANCE = with_storms("""
select *, row_number() over (partition by site_id order by distance_km, storm_id) as rank from search""")

TRACK_COORDINATES = VIEWS + f""", tracks as ({TRACKS})
select v.sid, cast(row_number() over (partition by v.sid order by iso_time, lon, lat) - 1 as integer) as idx,
       cast({gj('lon')} as double) as lon, cast({gj('lat')} as double) as lat
from ({VALID_OBS}) v where v.sid in (select sid from tracks)"""

TRACKS_BY_FUNCTION = TRACK_GEOJSON + f" where t.sid in ({REQUESTED_SIDS})"
