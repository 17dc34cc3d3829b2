"""Distance searches: whole tables of sites against storms, fixes and events.

Plan shape (a range join written as an equi-join):

  sites  -> level + cells of the site's lat/lon box  ---+
                                                        +-- join on (level, cell)
  tracks -> segments -> cells of each segment's box ----+      -> exact distance
                                                                -> <= radius
                                                                -> min per (site, storm)

Levels: each site picks a grid size from its radius (1, 4, 15 or 45 degrees), so
a site covers a handful of cells whatever its radius; segments and points are
placed in the cells of every level some site uses.

Join strategy: the exploded site-cell frame is counted first; when it is below
``stormgrid.broadcastSiteCells`` rows it is broadcast and the large side is never
shuffled for the join. Otherwise both sides shuffle on (level, cell, salt): the
large side gets a salt from its own key and the site side is replicated over all
salts, so one crowded cell is spread over ``stormgrid.joinSalt`` tasks (AQE skew
handling stays on as well).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.fence import fence, fenced_filter
from .layout import spread
from .tracks import track_segments

# Grid sizes (degrees); each divides 180 and 360.
LEVELS = (1.0, 4.0, 15.0, 45.0)
DEFAULT_BROADCAST_SITE_CELLS = 2_000_000
DEFAULT_SALT = 8

SITE_KEEP = ("site_id", "radius_m", "p_x", "p_y", "p_z", "p_latr", "p_lonr", "p_beta")


def _conf_int(spark, key: str, default: int) -> int:
    v = spark.conf.get(key, None)
    return int(v) if v else default


# ------------------------------------------------------------------ sites

def valid_sites(sites: DataFrame) -> DataFrame:
    """Sites that can be searched; :func:`rejected_sites` has the others."""
    return sites.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
                        & (F.col("radius_m") > 0) & ~F.isnan("radius_m"))


def _site_fault():
    """Why a site can't be searched (null: it can)."""
    def out(c: str, bound: int, title: str):
        return F.when(F.col(c).isNull() | ~F.col(c).between(-bound, bound), F.concat(F.lit(f"{title} out of range: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))

    radius = F.when(F.col("radius_m").isNull() | ~(F.col("radius_m") > 0) | F.isnan("radius_m"), F.concat(F.lit("Radius must be positive: "), F.coalesce(F.col("radius_m").cast("string"), F.lit("null"))))
    return F.coalesce(out("lat", 90, "Latitude"), out("lon", 180, "Longitude"), radius)


def rejected_sites(sites: DataFrame) -> DataFrame:
    """The sites that the searches and counts leave out, with ``reject_reason``."""
    return sites.withColumn("reject_reason", _site_fault()).filter(F.col("reject_reason").isNotNull())


def checked_sites(sites: DataFrame) -> DataFrame:
    """``sites`` for a strict search: reading a row that can't be searched raises its reason."""
    fault = _site_fault()
    return sites.withColumn("lat", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("lat")))


def search_args(sites: DataFrame, kind: str = "cyclone") -> tuple[DataFrame, DataFrame]:
    """Split sites into (good, bad) by the API's argument bounds.

    Fixed values: cyclone radius 1 km..1000 km; wind analysis 10 km..2000 km;
    tsunami 10 km..5000 km; latitude -90..90; longitude -180..180.
    """
    lo, hi = {"cyclone": (1000, 1000000), "wind": (10000, 2000000),
              "tsunami": (10000, 5000000)}[kind]
    ok = (F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
          & F.col("radius_m").between(lo, hi))
    ok = F.coalesce(ok, F.lit(False))
    return sites.filter(ok), sites.filter(~ok)


def _level_expr():
    reach = F.expr(geo.lat_reach_deg("radius_m"))
    e = None
    for g in LEVELS[:-1]:
        cond = reach <= 2 * g
        e = F.when(cond, F.lit(g)) if e is None else e.when(cond, F.lit(g))
    return e.otherwise(F.lit(LEVELS[-1]))


def prepare_sites(sites: DataFrame) -> DataFrame:
    s = valid_sites(sites).withColumn("lvl", _level_expr())
    s = geo.apply_stages(s, geo.unit_vector_stages("p", "lat", "lon"))
    return s


def site_cells(prepped: DataFrame) -> DataFrame:
    """Explode each site to the cells of its circle's bounding box at its level."""
    g = F.col("lvl")
    nrows = (F.lit(180.0) / g).cast("long")
    ncols = (F.lit(360.0) / g).cast("long")
    dlat = F.expr(geo.lat_reach_deg("radius_m"))
    dlon = F.expr(geo.lon_reach_deg("lat", "radius_m"))
    r0 = F.greatest(F.floor((F.col("lat") - dlat + 90) / g), F.lit(0)).cast("long")
    r1 = F.least(F.floor((F.col("lat") + dlat + 90) / g), nrows - 1).cast("long")
    c0 = F.floor((F.col("lon") - dlon + 180) / g).cast("long")
    c1 = F.floor((F.col("lon") + dlon + 180) / g).cast("long")
    all_lon = dlon.isNull() | (c1 - c0 + 1 >= ncols)
    s = prepped.select(*SITE_KEEP, "lvl", r0.alias("r0"), r1.alias("r1"),
                       F.when(all_lon, F.lit(0)).otherwise(c0).alias("c0"),
                       F.when(all_lon, ncols - 1).otherwise(c1).alias("c1"),
                       ncols.alias("ncols"))
    s = s.withColumn("row", F.explode(F.sequence("r0", "r1")))
    s = s.withColumn("col", F.explode(F.sequence("c0", "c1")))
    return s.select(*SITE_KEEP, "lvl",
                    (F.col("row") * F.col("ncols") + F.pmod("col", "ncols")).alias("cell"))


def used_levels(prepped: DataFrame) -> list[float]:
    """Grid levels in use (at most len(LEVELS) rows reach the driver)."""
    return sorted(r[0] for r in prepped.select("lvl").distinct().collect())


# ------------------------------------------------------------- segments

SEG_KEEP = ("a_latr", "a_lonr", "a_beta", "b_latr", "b_lonr", "b_beta",
            "s_nx", "s_ny", "s_nz", "s_nn", "s_ux", "s_uy", "s_uz", "s_vx", "s_vy", "s_vz")


def prepare_segments(segments: DataFrame) -> DataFrame:
    s = geo.apply_stages(segments, geo.unit_vector_stages("a", "a_lat", "a_lon")
                         + geo.unit_vector_stages("b", "b_lat", "b_lon")
                         + geo.segment_prep_stages("s", "a", "b"))
    # Latitude range of the great-circle arc: endpoints, plus a vertex if the
    # arc passes through it.
    vx = F.expr("-s_nz * s_nx")
    vy = F.expr("-s_nz * s_ny")
    vz = F.expr("s_nn - s_nz * s_nz")
    du = F.col("s_ux") * vx + F.col("s_uy") * vy + F.col("s_uz") * vz
    dv = F.col("s_vx") * vx + F.col("s_vy") * vy + F.col("s_vz") * vz
    arc = F.col("s_nn") > geo.NN_MIN
    vlat = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("s_nz") / F.sqrt("s_nn"))))
    lat_hi = F.greatest("a_lat", "b_lat", F.when(arc & (du >= 0) & (dv >= 0), vlat))
    lat_lo = F.least("a_lat", "b_lat", F.when(arc & (du <= 0) & (dv <= 0), -vlat))
    dl = F.col("b_lon") - F.col("a_lon")
    dl = F.when(dl > 180, dl - 360).when(dl < -180, dl + 360).otherwise(dl)
    return (s.withColumn("lat_hi", lat_hi + 1e-9).withColumn("lat_lo", lat_lo - 1e-9)
            .withColumn("dlon", dl)
            .withColumn("lon_lo", F.when(F.col("dlon") >= 0, F.col("a_lon"))
                        .otherwise(F.col("a_lon") + F.col("dlon")) - 1e-9)
            .withColumn("lon_span", F.abs("dlon") + 2e-9))


def _explode_levels(df: DataFrame, levels: list[float]) -> DataFrame:
    return df.withColumn("lvl", F.explode(F.array(*[F.lit(float(g)) for g in levels])))


def segment_cells(prepped: DataFrame, levels: list[float], keep: list[str]) -> DataFrame:
    s = _explode_levels(prepped, levels)
    g = F.col("lvl")
    nrows = (F.lit(180.0) / g).cast("long")
    ncols = (F.lit(360.0) / g).cast("long")
    all_lon = (F.col("lon_span") >= 179.999) | (F.col("lat_hi") >= 89.99999) | (F.col("lat_lo") <= -89.99999)
    c0 = F.floor((F.col("lon_lo") + 180) / g).cast("long")
    c1 = F.floor((F.col("lon_lo") + F.col("lon_span") + 180) / g).cast("long")
    all_lon = all_lon | (c1 - c0 + 1 >= ncols)
    s = s.select(*keep, "lvl", ncols.alias("ncols"),
                 F.greatest(F.floor((F.col("lat_lo") + 90) / g), F.lit(0)).cast("long").alias("r0"),
                 F.least(F.floor((F.col("lat_hi") + 90) / g), nrows - 1).cast("long").alias("r1"),
                 F.when(all_lon, F.lit(0)).otherwise(c0).alias("c0"),
                 F.when(all_lon, ncols - 1).otherwise(c1).alias("c1"))
    s = s.withColumn("row", F.explode(F.sequence("r0", "r1")))
    s = s.withColumn("col", F.explode(F.sequence("c0", "c1")))
    return s.select(*keep, "lvl", (F.col("row") * F.col("ncols") + F.pmod("col", "ncols")).alias("cell"))


def point_cells(prepped: DataFrame, levels: list[float], keep: list[str],
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A point lies in exactly one cell per level."""
    s = _explode_levels(prepped.select(*keep, lat, lon), levels)
    g = F.col("lvl")
    nrows = (F.lit(180.0) / g).cast("long")
    ncols = (F.lit(360.0) / g).cast("long")
    row = F.least(F.floor((F.col(lat) + 90) / g), nrows - 1).cast("long")
    col = F.pmod(F.floor((F.col(lon) + 180) / g).cast("long"), ncols)
    return s.select(*keep, "lvl", (row * ncols + col).alias("cell"))


# ------------------------------------------------------------- the join

def cell_join(sites_cells: DataFrame, other_cells: DataFrame, salt_key: str) -> DataFrame:
    """Equi-join on (lvl, cell): broadcast sites when their size is proven small."""
    spark = sites_cells.sparkSession
    limit = _conf_int(spark, "stormgrid.broadcastSiteCells", DEFAULT_BROADCAST_SITE_CELLS)
    n_site_cells = sites_cells.count()
    if n_site_cells <= limit:
        return other_cells.join(F.broadcast(sites_cells), ["lvl", "cell"])
    salt = _conf_int(spark, "stormgrid.joinSalt", DEFAULT_SALT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lvl", "cell", "salt"]
    o = other_cells.withColumn("salt", F.pmod(F.xxhash64(salt_key), F.lit(salt)))
    s = sites_cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    # user-numbered on both sides: the join reuses the layout, and AQE does not
    # coalesce these few-bytes-but-CPU-heavy partitions into a handful of tasks
    return o.repartition(parts, *keys).join(s.repartition(parts, *keys), keys).drop("salt")


def segment_pairs_within(segments: DataFrame, sites: DataFrame, model: str = "spheroid",
                         carry: tuple = ("sid",)) -> DataFrame:
    """(site, segment) pairs whose arc comes within the site's radius, with distance_m."""
    ps = prepare_sites(sites)
    levels = used_levels(ps)
    sc = site_cells(ps)
    seg = prepare_segments(segments)
    keep = [*carry, "seq", *SEG_KEEP]
    segc = segment_cells(seg, levels, keep)
    pairs = cell_join(sc, segc, "sid")
    # no lower-bound guard here: with it the generated code for this stage grows
    # past what the JIT compiles and runs ~6x slower (measured); points use it
    st = geo.segment_distance_stages("dist_m", "p", "s", "a", "b", model)
    pairs = geo.apply_stages(pairs, st, fence=True)
    return geo.fenced_filter(pairs, F.col("dist_m") <= F.col("radius_m"))


def tracks_within(points: DataFrame, sites: DataFrame, model: str = "spheroid",
                  segments: DataFrame | None = None) -> DataFrame:
    """(site_id, sid, dist_m): storms whose track passes within each site's radius."""
    seg = segments if segments is not None else track_segments(points)
    pairs = segment_pairs_within(seg, sites, model)
    return pairs.groupBy("site_id", "sid").agg(F.min("dist_m").alias("dist_m"))


def points_within(points: DataFrame, sites: DataFrame, keep: list[str], model: str = "spheroid",
                  lat: str = "lat", lon: str = "lon", salt_key: str | None = None) -> DataFrame:
    """(site, point) pairs within the site's radius; keeps ``keep`` point columns + dist_m."""
    ps = prepare_sites(sites)
    levels = used_levels(ps)
    sc = site_cells(ps)
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    pts = geo.apply_stages(fenced_filter(fence(spread(points)), placed), geo.unit_vector_stages("q", lat, lon))
    pc = point_cells(pts, levels, [*keep, "q_latr", "q_lonr", "q_beta", "q_x", "q_y", "q_z"], lat, lon)
    pairs = cell_join(sc, pc, salt_key or keep[0])
    lb = [("lb_m", geo.lower_bound_expr("p", None, "q"))]
    pairs = geo.apply_stages(pairs, lb + geo.distance_stages("dist_m", "p", "q", model,
                                                              guard="lb_m <= radius_m"), fence=True)
    return geo.fenced_filter(pairs, F.col("dist_m") <= F.col("radius_m"))


# ------------------------------------------------------------- cyclones

STORM_FIELDS = ("storm_id", "cyclone_name", "year", "basin", "start_date", "end_date", "distance_km", "num_observations",
                "max_wind_speed", "min_pressure", "duration_hours")
#: Up to so many sites are searched by cells, more by blocks.
DEFAULT_CELL_SITES = 1000


def _storm_facts(tracks: DataFrame) -> DataFrame:
    """What a result row says of its storm alone."""
    return tracks.select(
        F.col("sid").alias("storm_id"),
        F.coalesce("name", F.lit("UNNAMED")).alias("cyclone_name"),
        F.col("season").alias("year"),
        "basin",
        F.col("start_time").alias("start_date"),
        F.col("end_time").alias("end_date"),
        F.col("point_count").alias("num_observations"),
        F.coalesce("max_wind", F.lit(0)).alias("max_wind_speed"),
        F.coalesce("min_pressure", F.lit(0)).alias("min_pressure"),
        F.coalesce("duration_hours", F.lit(0.0)).alias("duration_hours"))


def _storm_hits(points: DataFrame, sites: DataFrame, about: DataFrame, model: str, segments: DataFrame | None) -> DataFrame:
    """site_id, dist_m and the columns of ``about`` (storm_id and others) for each site and storm within its radius.

    Many sites go through :func:`.blocks.tracks_near`, which exchanges no pairs; few (a click) through the cells.
    """
    from . import blocks

    few = _conf_int(sites.sparkSession, "stormgrid.cellSites", DEFAULT_CELL_SITES)
    if len(sites.select("site_id").take(few + 1)) > few:
        return blocks.tracks_near(segments if segments is not None else track_segments(points), sites, about, model)
    hits = tracks_within(points, sites, model, segments)
    return hits.withColumnRenamed("sid", "storm_id").join(about, "storm_id")


def storms_near(points: DataFrame, tracks: DataFrame, sites: DataFrame,
                model: str = "spheroid", segments: DataFrame | None = None) -> DataFrame:
    """find_cyclones_near_point for every site: 11 columns + site_id.

    distance_km = ROUND(numeric, 2); coalesce(max_wind, min_pressure,
    duration_hours, 0) like the SQL function. Unordered: a global sort of every
    hit is presentation work, done by ``results.sort_results`` when wanted.
    """
    hits = _storm_hits(points, sites, _storm_facts(tracks), model, segments)
    return hits.withColumn("distance_km", F.round(F.col("dist_m") / 1000.0, 2)).select("site_id", *STORM_FIELDS)


def attach_dist2land(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Add min_dist_to_land of each matched storm over all its fixes (Q15).

    With whole tables of sites most storms match somewhere, so the per-storm
    minimum is one partial aggregate over the points (one row per storm) joined
    to the hits -- the hits are not evaluated twice to find the matched ids.
    """
    d2l = (points.groupBy("sid")
           .agg(F.min(F.when(F.col("dist2land") >= 0, F.col("dist2land"))).alias("min_dist_to_land")))
    return hits.join(d2l.withColumnRenamed("sid", "storm_id"), "storm_id", "left")


def cyclone_search(points: DataFrame, tracks: DataFrame, sites: DataFrame,
                   model: str = "spheroid", segments: DataFrame | None = None,
                   shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The /cyclones-near rows: SQL rows + API conventions (Q8) + min_dist_to_land.

    ``shape`` is what is asked or said of a storm alone, as a step on its reported fields (all but
    site_id and distance_km): done once a storm, not once a (site, storm) pair. It keeps storm_id;
    columns that it adds go to the end.
    """
    about = _storm_facts(tracks).select(
        "storm_id",
        F.coalesce(F.expr("nullif(cyclone_name, '')"), F.lit("UNNAMED")).alias("cyclone_name"),
        F.coalesce(F.expr("nullif(year, 0)"), F.lit(0)).alias("year"),
        F.coalesce(F.expr("nullif(basin, '')"), F.lit("Unknown")).alias("basin"),
        "start_date", "end_date", "num_observations",
        F.expr("nullif(max_wind_speed, 0)").alias("max_wind_speed"),
        F.expr("nullif(min_pressure, 0)").alias("min_pressure"),
        F.expr("nullif(duration_hours, 0.0)").alias("duration_hours"))
    about = attach_dist2land(about, points)
    if shape is not None:
        about = shape(about)
    hits = _storm_hits(points, sites, about, model, segments)
    hits = hits.withColumn("distance_km", F.coalesce(F.round(F.col("dist_m") / 1000.0, 2), F.lit(0.0)))
    own = [c for c in STORM_FIELDS[1:] if c == "distance_km" or c in about.columns]
    return hits.select("storm_id", "site_id", *own, *(c for c in about.columns if c not in STORM_FIELDS))


def result_count(sites: DataFrame, hits: DataFrame, name: str = "cyclones_found", weight: str | None = None) -> DataFrame:
    """Number of results per site; sites without a hit get 0.

    ``weight``: the column of ``hits`` that says for how many results a row stands (one each without it).
    """
    c = hits.groupBy("site_id").agg(F.sum(F.lit(1).cast("long") if weight is None else F.col(weight)).alias(name))
    return (valid_sites(sites).select("site_id").join(c, "site_id", "left")
            .select("site_id", F.coalesce(F.col(name), F.lit(0)).alias(name)))


#: Degrees of the cells of the occupancy summary: 69 352 rows at most, whatever the tracks.
OCCUPANCY = (1.0, 4.0, 12.0, 36.0, 180.0)


def _occupancy_cell(lvl: Column, row: Column, col: Column) -> Column:
    return (row * (360 / lvl) + F.pmod(col, 360 / lvl)).cast("int")


def _row_of(lat: Column, lvl: Column) -> Column:
    return F.least(F.floor((lat + 90) / lvl), 180 / lvl - 1)


def occupied_cells(segments: DataFrame) -> DataFrame:
    """lvl, cell, q_lat and q_lon: one track fix of each occupied cell of each level."""
    lvl = F.lit(OCCUPANCY[0])
    own = _occupancy_cell(lvl, _row_of(F.col("a_lat"), lvl), F.floor((F.col("a_lon") + 180) / lvl))
    finest = segments.groupBy(own.alias("cell")).agg(F.min(F.struct("a_lat", "a_lon")).alias("fix"))
    lvl = F.col("lvl")
    placed = _explode_levels(finest.select("fix"), list(OCCUPANCY))
    cell = _occupancy_cell(lvl, _row_of(F.col("fix.a_lat"), lvl), F.floor((F.col("fix.a_lon") + 180) / lvl))
    return (placed.groupBy("lvl", cell.alias("cell")).agg(F.min("fix").alias("fix"))
            .select("lvl", "cell", F.col("fix.a_lat").alias("q_lat"), F.col("fix.a_lon").alias("q_lon")))


def nearest_bound(sites: DataFrame, segments: DataFrame, model: str = "spheroid") -> DataFrame:
    """The sites (one row a site_id) with ``bound_m``: the distance to some track fix, so that
    the nearest storm is no further.

    A site looks at the fixes of its own cell and the eight around it, on each level up to
    the half globe, and takes the distance to the one at the smallest angle: 45 looks at most, an
    equi-join with a broadcast summary. Sites are missing where there are no tracks at all.
    """
    lvl = F.col("lvl")
    looks = _explode_levels(geo.apply_stages(sites, geo.unit_vector_stages("p", "lat", "lon")), list(OCCUPANCY))
    row, col = _row_of(F.col("lat"), lvl), F.floor((F.col("lon") + 180) / lvl)
    looks = looks.withColumn("_row", F.explode(F.sequence(F.greatest(row - 1, F.lit(0)).cast("int"), F.least(row + 1, 180 / lvl - 1).cast("int"))))
    # two columns at the top: the one beside is the one on the other side
    looks = looks.withColumn("_col", F.explode(F.sequence((col - 1).cast("int"), F.when(lvl < 180, col + 1).otherwise(col).cast("int"))))
    looks = looks.withColumn("cell", _occupancy_cell(lvl, F.col("_row"), F.col("_col")))
    met = looks.join(F.broadcast(occupied_cells(segments)), ["lvl", "cell"])
    met = geo.apply_stages(met, geo.unit_vector_stages("q", "q_lat", "q_lon"))
    dot = F.col("q_x") * F.col("p_x") + F.col("q_y") * F.col("p_y") + F.col("q_z") * F.col("p_z")
    near = met.groupBy("site_id").agg(F.max(F.struct(dot.alias("dot"), "q_lat", "q_lon", "lat", "lon", "radius_m")).alias("x"))
    near = near.select("site_id", "x.lat", "x.lon", "x.radius_m", "x.q_lat", "x.q_lon")
    near = geo.apply_stages(near, geo.point_prep_stages("p", "lat", "lon") + geo.point_prep_stages("q", "q_lat", "q_lon")
                            + geo.distance_stages("bound_m", "p", "q", model))
    return near.select("site_id", "lat", "lon", "radius_m", "bound_m")


def nearest_storm(points: DataFrame, tracks: DataFrame, sites: DataFrame,
                  model: str = "spheroid", segments: DataFrame | None = None) -> DataFrame:
    """For sites with no storm inside their radius: the single nearest storm.

    Branch and bound in one pass: an occupancy summary bounds each site's nearest distance
    from above (:func:`nearest_bound`). A site whose bound lies within its radius has a
    storm there and is not asked; each other one is searched once, exactly, with its bound
    as the radius, which holds its nearest storm and few others. Sites whose nearest storm
    turns out to lie within their radius drop out at the end. No cross join, no rounds.
    """
    # read twice (summary, search): written once to the shared checkpoint folder
    seg = segments if segments is not None else track_segments(points).checkpoint(eager=True)
    asked = nearest_bound(valid_sites(sites).select("site_id", "lat", "lon", "radius_m"), seg, model)
    asked = asked.filter(F.col("bound_m") > F.col("radius_m")).checkpoint(eager=True)
    reach = F.col("bound_m") * (1 + 1e-9) + 0.01
    near = segment_pairs_within(seg, asked.withColumn("radius_m", reach), model)
    best = (near.groupBy("site_id").agg(F.min(F.struct("dist_m", "sid")).alias("b"))
            .select("site_id", F.col("b.sid").alias("sid"), F.col("b.dist_m").alias("dist_m")))
    found = best.join(asked.select("site_id", "radius_m"), "site_id").filter("dist_m > radius_m")
    t = tracks.select("sid", "name", "season")
    return found.join(t, "sid").select(
        "site_id", F.col("sid").alias("storm_id"),
        F.coalesce("name", F.lit("UNNAMED")).alias("cyclone_name"),
        F.col("season").alias("year"),
        F.round(F.col("dist_m") / 1000.0, 2).alias("distance_km"))


def not_found(ids: DataFrame, tracks: DataFrame, key: str = "sid") -> DataFrame:
    """Requested ids with no row (the API's 404)."""
    return ids.select(key).distinct().join(tracks.select(key), key, "left_anti")


def obs_near(points: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """(site, observation) pairs within the site's radius."""
    keep = ["obs_id", "sid", "wmo_wind"]
    pairs = points_within(points, sites, keep, model, salt_key="obs_id")
    return pairs.select("site_id", "obs_id", "sid", "wmo_wind", "dist_m")


def obs_near_rows(points: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """obs_near as reported: distance in km, 2 dp."""
    return obs_near(points, sites, model).select(
        "site_id", "obs_id", "sid", "wmo_wind", F.round(F.col("dist_m") / 1000.0, 2).alias("distance_km"))


# ------------------------------------------------------------- tsunamis

EVENT_NEAR_COLS = ("id", "year", "month", "day", "event_datetime", "event_validity",
                   "cause_code", "earthquake_magnitude", "country", "location_name",
                   "latitude", "longitude", "max_water_height", "num_runups", "deaths",
                   "total_deaths", "damage_mil", "total_damage_mil", "houses_destroyed",
                   "total_houses_destroyed")


def events_near(events: DataFrame, sites: DataFrame, model: str = "spheroid",
                min_validity: int = 2) -> DataFrame:
    """find_tsunamis_near_point for every site: site_id + 20 columns + distance_km.

    Events need a position and validity >= ``min_validity`` (Q26);
    distance_km = whole km, half to even (Q10).
    """
    ev = events.filter(F.col("event_validity") >= min_validity)
    pairs = points_within(ev, sites, list(EVENT_NEAR_COLS), model, lat="lat_d", lon="lon_d",
                          salt_key="id")
    return pairs.select("site_id", *EVENT_NEAR_COLS,
                        F.rint(F.col("dist_m") / 1000.0).alias("distance_km"))


TSUNAMI_FIELDS = ("id", "year", "month", "day", "event_validity", "cause_code", "earthquake_magnitude", "country",
                  "location_name", "latitude", "longitude", "max_water_height", "num_runups", "deaths", "total_deaths",
                  "damage_mil", "total_damage_mil", "houses_destroyed", "total_houses_destroyed")
_ZERO_AS_NULL = ("earthquake_magnitude", "latitude", "longitude", "max_water_height", "damage_mil", "total_damage_mil")


def tsunami_search(events: DataFrame, sites: DataFrame, model: str = "spheroid",
                   shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The /tsunamis-near rows: drops event_datetime, numeric 0 -> null (Q9).

    ``shape`` is what is asked or said of an event alone, as a step on its reported fields
    (all but site_id and distance_km): done once an event, not once a (site, event) pair. It keeps
    lat_d and lon_d; columns that it adds go to the end.
    """
    def z(c, t="double"):
        return F.expr(f"nullif(cast({c} as {t}), 0)").alias(c)

    ev = events.filter(F.col("event_validity") >= 2)
    ev = ev.select(*(z(c) if c in _ZERO_AS_NULL else F.col(c) for c in TSUNAMI_FIELDS), "lat_d", "lon_d")
    if shape is not None:
        ev = shape(ev)
    own = [c for c in ev.columns if c not in ("lat_d", "lon_d")]
    pairs = points_within(ev, sites, own, model, lat="lat_d", lon="lon_d", salt_key="id")
    pairs = pairs.withColumn("distance_km", F.rint(F.col("dist_m") / 1000.0))
    return pairs.select("site_id", *(c for c in own if c in TSUNAMI_FIELDS), z("distance_km"),
                        *(c for c in own if c not in TSUNAMI_FIELDS))
