"""Counts per site without pairs: whole cells by their totals, border cells in detail.

Points are grouped by cells so small that each holds about ENOUGH of them (at LEVELS - 1 at the finest). A group that
lies wholly within a site's radius counts by its size, one wholly outside not at all, and only points
of groups that the border crosses meet the exact distance (:class:`.blocks._Points`): what is compared one by one grows with
the border. Sites and points pass in tiles (:mod:`.blocks`), so that neither a cell of a site nor a pair is ever a row.

:func:`cover` gives the same as rows: each site's circle covered by cells of nested grids (each level halves
the cell); one that the border crosses is cut into four, ``STEPS`` times at most.

Whether a cell is whole is decided by bounds that hold for every model: a geodesic is between
K_LOW and K_HIGH times the angle between the geodetic unit vectors, and a cell's points are
within half its height plus half its width at the centre of its centre.

Totals are summed at the finest level first (at most 8 388 608 rows), and rolled up from
there. One number is collected: the density of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.fence import fence, fenced_filter
from .layout import spread
from .search import valid_sites

#: Degrees of the coarsest cell, and levels (each halves it).
COARSEST, LEVELS = 45.0, 10
STEPS, ENOUGH = 5, 16
#: The level (1.4 degrees) at which the density of points is taken: 32 768 cells at most.
DENSITY_LEVEL = 5
K_LOW = geo.R_MERID_MIN * 0.999
#: Largest radius of curvature on the ellipsoid: of the meridian at the pole.
K_HIGH = geo.WGS84_A ** 2 / geo.WGS84_B * 1.001
#: Radians from a site beyond which no cell counts as whole (formulas are weak near the antipode).
FAR = 2.5


def _size(k: Column) -> Column:
    return F.lit(COARSEST) / F.pow(F.lit(2.0), k)


def _cell(k: Column, row: Column, col: Column) -> Column:
    """Number of a cell within its level."""
    ncols = (F.lit(360.0) / _size(k)).cast("long")
    return row * ncols + F.pmod(col, ncols)


def place(k: Column, lat: Column, lon: Column) -> Column:
    """Number of a position's cell at level ``k``."""
    g = _size(k)
    row = F.least(F.floor((lat + 90) / g), (F.lit(180.0) / g).cast("long") - 1).cast("long")
    return _cell(k, row, F.floor((lon + 180) / g).cast("long"))


def _classed(cells: DataFrame) -> DataFrame:
    """Cells with ``whole``; those that lie outside go. Cells that are whole already stay so."""
    g = _size(F.col("k"))
    lat, lon = F.radians((F.col("row") + 0.5) * g - 90), F.radians((F.col("col") + 0.5) * g - 180)
    cells = cells.withColumn("_latr", lat).withColumn("_lonr", lon)
    dot = (F.cos("_latr") * (F.cos("_lonr") * F.col("p_x") + F.sin("_lonr") * F.col("p_y")) + F.sin("_latr") * F.col("p_z"))
    cells = cells.withColumn("_angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    cells = cells.withColumn("_half", F.radians(g / 2) * (F.lit(1.0) + F.cos("_latr")) + 1e-9)
    whole = F.col("whole") | ((F.col("_angle") + F.col("_half") < FAR) & ((F.col("_angle") + F.col("_half")) * K_HIGH <= F.col("radius_m")))
    cells = fence(cells.withColumn("whole", whole))
    near = F.col("whole") | ((F.col("_angle") - F.col("_half")) * K_LOW <= F.col("radius_m"))
    return fenced_filter(cells, near).drop("_latr", "_lonr", "_angle", "_half")


def deepest_level(cells: DataFrame) -> int:
    """The finest level whose cells hold ENOUGH points on average over the points themselves (of :func:`totals`)."""
    n = F.col("total").cast("double")
    seen = cells.filter(F.col("k") == DENSITY_LEVEL).agg(F.sum(n * n) / F.sum(n)).first()[0] or 0.0
    return max([k for k in range(LEVELS) if seen * 4.0 ** (DENSITY_LEVEL - k) >= ENOUGH], default=-1)


def cover(sites: DataFrame, steps: int = STEPS, deepest: int = LEVELS - 1) -> DataFrame:
    """The cells of each site's circle: site columns, k, cell and whole; none below level ``deepest`` is cut out of another."""
    s = geo.apply_stages(valid_sites(sites).select("site_id", "lat", "lon", "radius_m"), geo.unit_vector_stages("p", "lat", "lon"))
    reach, dlon = F.expr(geo.lat_reach_deg("radius_m")), F.expr(geo.lon_reach_deg("lat", "radius_m"))
    first = F.floor(F.log2(F.lit(COARSEST) / reach))
    s = s.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1 - steps), first)).cast("int"))
    g = _size(F.col("k"))
    nrows, ncols = (F.lit(180.0) / g).cast("long"), (F.lit(360.0) / g).cast("long")
    low, high = F.floor((F.col("lat") - reach + 90) / g), F.floor((F.col("lat") + reach + 90) / g)
    west, east = F.floor((F.col("lon") - dlon + 180) / g), F.floor((F.col("lon") + dlon + 180) / g)
    around = dlon.isNull() | (east - west + 1 >= ncols)
    s = s.withColumn("row", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.least(high.cast("long"), nrows - 1))))
    s = s.withColumn("col", F.explode(F.sequence(F.when(around, 0).otherwise(west).cast("long"), F.when(around, ncols - 1).otherwise(east).cast("long"))))
    cells = _classed(s.withColumn("whole", F.lit(False)))
    for _ in range(steps):
        part = lambda dk, dr, dc: F.struct((F.col("k") + dk).cast("int").alias("k"), (F.col("row") * (1 + dk) + dr).alias("row"), (F.col("col") * (1 + dk) + dc).alias("col"))
        quarters = F.array(*(part(1, r, c) for r in (0, 1) for c in (0, 1)))
        cells = cells.withColumn("_part", F.explode(F.when(F.col("whole") | (F.col("k") >= deepest), F.array(part(0, 0, 0))).otherwise(quarters)))
        cells = cells.withColumns({c: F.col(f"_part.{c}") for c in ("k", "row", "col")}).drop("_part")
        cells = _classed(cells)
    return cells.withColumn("cell", _cell(F.col("k"), F.col("row"), F.col("col"))).drop("row", "col")


def totals(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """k, cell and total of every cell that holds points."""
    finest = F.lit(LEVELS - 1)
    own = points.groupBy(place(finest, F.col(lat), F.col(lon)).alias("_finest")).agg(F.count(F.lit(1)).alias("n"))
    ncols = int(360 / (COARSEST / 2 ** (LEVELS - 1)))
    rolled = own.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(LEVELS)))))
    cut = F.pow(F.lit(2.0), F.lit(LEVELS - 1) - F.col("k"))
    cell = _cell(F.col("k"), F.floor(F.floor(F.col("_finest") / ncols) / cut).cast("long"), F.floor((F.col("_finest") % ncols) / cut).cast("long"))
    return rolled.groupBy("k", cell.alias("cell")).agg(F.sum("n").alias("total"))


def points_counted(points: DataFrame, sites: DataFrame, name: str, model: str = "spheroid", lat: str = "lat", lon: str = "lon",
                   steps: int = STEPS) -> DataFrame:
    """site_id and ``name``: how many points lie within each site's radius (0 without any).

    Points without a valid position count nowhere; sites without one, or without a positive
    radius, have no row (see ``search.rejected_sites``). No row of a site and cell leaves a task
    (:func:`.blocks.points_met`); ``steps``: how often the cells of level LEVELS - 1 - STEPS are cut, at most.
    """
    from . import blocks

    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    pts = fenced_filter(fence(spread(points)), placed).select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).checkpoint(eager=True)  # read four times
    level = max(0, min(deepest_level(totals(pts, "lat", "lon")), LEVELS - 1 - STEPS + steps))
    counts = blocks.points_met(pts, sites, place(F.lit(level), F.col("lat"), F.col("lon")), model).groupBy("site_id").agg(F.sum("n").alias("n"))
    return (valid_sites(sites).select("site_id").join(counts, "site_id", "left")
            .select("site_id", F.coalesce("n", F.lit(0)).cast("long").alias(name)))


def events_counted(events: DataFrame, sites: DataFrame, model: str = "spheroid", min_validity: int = 2, name: str = "tsunamis_found") -> DataFrame:
    """The number of rows that ``search.events_near`` has for each site."""
    return points_counted(events.filter(F.col("event_validity") >= min_validity), sites, name, model, "lat_d", "lon_d")
