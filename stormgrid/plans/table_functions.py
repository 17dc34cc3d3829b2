"""The four SQL table functions, as SQL functions of their arguments.

    select * from find_cyclones_near_point(19.076, 72.8777, 100000) order by distance_km
    select s.site_id, f.* from sites s, lateral find_tsunamis_near_point(s.lat, s.lon, s.radius_m) f
    select * from get_cyclone_track('2019063S18038')
    select * from get_tsunami_event(4711)

``register`` only declares temporary views and functions; no job runs. The searches need tables
that are stored once (:mod:`stormgrid.sources.tables`): points, tracks, segments and track lines.

The arguments enter a body in one place, a one-row projection, and everything after it refers
to that row's columns. Over a table of sites (LATERAL), Spark therefore turns the arguments into
a distinct table of its own, and the join with the stored cells stays an equi-join on (level, cell),
as in :mod:`stormgrid.operators.search`; with literals it is one site's handful of cells.

Defined results: a latitude or longitude out of range raises; a null argument, or a radius that is
not positive, finds nothing; an unknown or null id returns no row. Rows are unordered (ORDER BY
belongs to the query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import search as S

#: Default radii in metres.
CYCLONE_RADIUS, TSUNAMI_RADIUS = 100000, 500000

_EVENT_DETAIL = ("id", "year", "month", "day", "hour", "minute", "event_datetime", "event_validity", "cause_code", "earthquake_magnitude", "country",
                 "location_name", "latitude", "longitude", "max_water_height", "num_runups", "tsunami_magnitude_abe", "tsunami_magnitude_iida",
                 "deaths", "missing", "injuries", "damage_mil", "houses_destroyed", "houses_damaged", "total_deaths", "total_missing",
                 "total_injuries", "total_damage_mil", "total_houses_destroyed", "total_houses_damaged")


def register(spark: SparkSession, tables: dict[str, DataFrame] | None = None, events: DataFrame | None = None, model: str = "spheroid") -> None:
    """Declare the views and functions over stored storm tables, over the event table, or both."""
    levels, views, functions = list(S.LEVELS), {}, []
    if tables is not None:
        segments = S.segment_cells(S.prepare_segments(tables["segments"]), levels, ["sid", "seq", *S.SEG_KEEP])
        views |= {"cyclone_points": tables["points"], "cyclone_tracks": tables["tracks"], "cyclone_track_lines": tables["lines"], "cyclone_segment_cells": segments}
        functions += [_cyclones(model), _track()]
    if events is not None:
        placed = events.filter((F.col("event_validity") >= 2) & F.col("lat_d").between(-90, 90) & F.col("lon_d").between(-180, 180)).select("id", "lat_d", "lon_d")
        placed = geo.apply_stages(placed, geo.unit_vector_stages("q", "lat_d", "lon_d"))
        cells = S.point_cells(placed, levels, ["id", "q_latr", "q_lonr", "q_beta", "q_x", "q_y", "q_z"], "lat_d", "lon_d")
        views |= {"tsunami_events": events, "tsunami_event_cells": cells}
        functions += [_tsunamis(events, model), _event(events)]
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    for text in functions:
        spark.sql(text)


def _kinds(frame: DataFrame, names: tuple | list) -> str:
    return ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names)


def _argument_cells(function: str, lat: str, lon: str, distance: str) -> str:
    """SQL of the cells around a function's point: radius_m, p_... columns, lvl and cell."""
    def within(name: str, bound: int, title: str) -> str:
        x = f"{function}.{name}"
        return f"case when {x} < -{bound} or {x} > {bound} then raise_error(concat('{title} out of range: ', {x})) else {x} end"

    args = f"select {within(lat, 90, 'Latitude')} as lat, {within(lon, 180, 'Longitude')} as lon, cast({function}.{distance} as double) as radius_m"
    reach = geo.lat_reach_deg("radius_m")
    grid = " ".join(f"when {reach} <= {2 * g} then {geo.lit(g)}" for g in S.LEVELS[:-1])
    point = geo.stages_sql(f"select * from ({args}) where radius_m > 0 and lat is not null and lon is not null", geo.unit_vector_stages("p", "lat", "lon"))
    lat_reach, lon_reach = geo.lat_reach_deg("radius_m"), geo.lon_reach_deg("lat", "radius_m")
    stages = [("lvl", f"case {grid} else {geo.lit(S.LEVELS[-1])} end"), ("nrows", "cast(180e0 / lvl as bigint)"), ("ncols", "cast(360e0 / lvl as bigint)"),
              ("dlon", lon_reach), ("c0", "cast(floor((lon - dlon + 180) / lvl) as bigint)"), ("c1", "cast(floor((lon + dlon + 180) / lvl) as bigint)"),
              ("round", "dlon is null or c1 - c0 + 1 >= ncols"),
              ("row", f"explode(sequence(greatest(cast(floor((lat - ({lat_reach}) + 90) / lvl) as bigint), 0L),"
                      f" least(cast(floor((lat + ({lat_reach}) + 90) / lvl) as bigint), nrows - 1)))"),
              ("col", "explode(sequence(if(round, 0L, c0), if(round, ncols - 1, c1)))")]
    keep = ", ".join(c for c in S.SITE_KEEP if c != "site_id")
    return f"select {keep}, lvl, row * ncols + pmod(col, ncols) as cell from ({geo.stages_sql(point, stages, 'c')}) as cells"


def _cyclones(model: str) -> str:
    name = "find_cyclones_near_point"
    pairs = f"select * from ({_argument_cells(name, 'clicked_lat', 'clicked_lon', 'distance_meters')}) a join cyclone_segment_cells using (lvl, cell)"
    distances = geo.stages_sql(pairs, geo.segment_distance_stages("dist_m", "p", "s", "a", "b", model), "d")
    return f"""
create or replace temporary function {name}(clicked_lat double, clicked_lon double, distance_meters double default {CYCLONE_RADIUS})
returns table (storm_id string, cyclone_name string, year int, basin string, start_date timestamp_ntz, end_date timestamp_ntz, distance_km double,
               num_observations int, max_wind_speed int, min_pressure int, duration_hours double)
return select t.sid, coalesce(t.name, 'UNNAMED'), t.season, t.basin, t.start_time, t.end_time, round(h.dist_m / 1000e0, 2), t.point_count,
              coalesce(t.max_wind, 0), coalesce(t.min_pressure, 0), coalesce(t.duration_hours, 0e0)
from (select sid, min(dist_m) as dist_m from ({distances}) as pairs group by sid, radius_m having min(dist_m) <= radius_m) h
join cyclone_tracks t on t.sid = h.sid"""


def _tsunamis(events: DataFrame, model: str) -> str:
    name = "find_tsunamis_near_point"
    pairs = f"select * from ({_argument_cells(name, 'p_lat', 'p_lon', 'p_distance_m')}) a join tsunami_event_cells using (lvl, cell)"
    stages = [("lb_m", geo.lower_bound_expr("p", None, "q")), *geo.distance_stages("dist_m", "p", "q", model, guard="lb_m <= radius_m")]
    columns = list(S.EVENT_NEAR_COLS)
    # the distance goes through a one-element array: a filter on it then stays above its many stages
    return f"""
create or replace temporary function {name}(p_lat double, p_lon double, p_distance_m double default {TSUNAMI_RADIUS})
returns table ({_kinds(events, columns)}, distance_km double)
return select {", ".join(f"e.{c}" for c in columns)}, rint(h.metres / 1000e0)
from (select id, metres from ({geo.stages_sql(pairs, stages, "d")}) as pairs lateral view inline(array(named_struct('metres', dist_m))) one as metres
      where metres <= radius_m) h
join tsunami_events e on e.id = h.id"""


def _track() -> str:
    number = "regexp_replace(regexp_replace(format_string('%.9f', {}), '0+$', ''), r'\\.$', '')"
    point = f"concat('[', {number.format('p.lon')}, ',', {number.format('p.lat')}, ']')"
    return f"""
create or replace temporary function get_cyclone_track(storm_id string)
returns table (sid string, name string, season int, geojson string)
return select t.sid, coalesce(t.name, 'UNNAMED'), t.season, concat('{{"type":"LineString","coordinates":[', l.line, ']}}')
from cyclone_tracks t
join (select sid, array_join(transform(array_sort(collect_list(struct(piece, part))), x -> x.part), ',') as line
      from (select sid, piece, array_join(transform(line, p -> {point}), ',') as part from cyclone_track_lines where sid = get_cyclone_track.storm_id) pieces
      group by sid) l on l.sid = t.sid
where t.sid = get_cyclone_track.storm_id"""


def _event(events: DataFrame) -> str:
    return f"""
create or replace temporary function get_tsunami_event(p_id bigint)
returns table ({_kinds(events, _EVENT_DETAIL)})
return select {", ".join(_EVENT_DETAIL)} from tsunami_events where id = get_tsunami_event.p_id"""
