"""Results per site without an exchange of (site, storm) pairs.

Whether a storm counts for a site depends on all its fixes or segments, so counts of distinct
storms, and of their strongest winds, do not add up over cells. Here every site stays in one
tile (a cell of ``TILES`` degrees by class of radius, cut where it holds more than ``TILE_SITES``). A tile's
sites come once, followed by all storms that its circles may reach, in the order of their ids; they pass in
chunks of whole storms, and what a chunk adds is kept by site or leaves as rows. What is shuffled
are the sites, once, and the pieces of storms (the parts that begin in one cell of ``HOME`` degrees), once for
each tile whose box they meet; no pair and no part of a site's result is ever shuffled.

In a block, dot products of unit vectors settle most pairs by bounds that hold for every model
(K_LOW and K_HIGH of :mod:`.counts`); the others get the exact distance, by the formulas
of :mod:`stormgrid.functions.geo`. Sites whose id has several places go through pairs, as their
results are those of all places together.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import ship_package
from . import search as S
from .counts import FAR, K_HIGH, K_LOW
from .tracks import track_segments, valid_points

#: Degrees of the tiles for sites of each grid level (some times the reach of their circles), and of the cells of pieces.
TILES, HOME = {1.0: 15.0, 4.0: 15.0, 15.0: 45.0, 45.0: 90.0}, 15.0
#: The most sites of a tile, and the elements (segments, fixes) of a chunk, unless one storm has more.
TILE_SITES, BUCKET_ELEMENTS = 16384, 262_144
#: Elements in one piece of a storm, on average.
PIECE = 4096
#: Sites and elements in one block.
BLOCK_SITES, BLOCK_ELEMENTS = 64, 8192
#: Rows (or pairs) of one output batch, about.
BATCH = 32768
#: Beyond what dots and angles of doubles err.
_DOT, _ANGLE = 1e-14, 1e-7


# ------------------------------------------------------------- layout

def _single(sites: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Valid sites, one row each, and those whose id has several places (None without any)."""
    s = S.valid_sites(sites).select("site_id", "lat", "lon", "radius_m").distinct()
    many = s.groupBy("site_id").count().filter("count > 1").select(F.col("site_id").alias("_id"))
    if many.isEmpty():
        return s, None
    same = F.col("site_id").eqNullSafe(F.col("_id"))
    return s.join(many, same, "left_anti"), s.join(many, same, "left_semi")


def _row_col(lat: Column, lon: Column, size: Column) -> tuple[Column, Column]:
    return F.least(F.floor((lat + 90) / size), 180 / size - 1).cast("int"), F.least(F.floor((lon + 180) / size), 360 / size - 1).cast("int")


def _tiled(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites with ``tile``, one row for each cell of sites: the box of their circles and its tiles)."""
    s = sites.withColumn("lvl", S._level_expr())
    size = F.element_at(F.create_map(*(F.lit(x) for pair in TILES.items() for x in pair)), F.col("lvl"))
    row, col = _row_col(F.col("lat"), F.col("lon"), size)
    s = s.withColumn("_own", F.col("lvl").cast("int") * 10_000 + row * 100 + col)
    dlat, dlon = F.expr(geo.lat_reach_deg("radius_m")), F.expr(geo.lon_reach_deg("lat", "radius_m"))
    # a few hundred rows at most, whatever the sites
    owns = s.groupBy("_own").agg(F.ceil(F.count(F.lit(1)) / TILE_SITES).alias("_parts"), F.min(F.col("lat") - dlat).alias("_south"), F.max(F.col("lat") + dlat).alias("_north"),
                                 F.min(F.col("lon") - dlon).alias("_west"), F.max(F.col("lon") + dlon).alias("_east"), F.max(dlon.isNull()).alias("_round"))
    s = s.join(F.broadcast(owns.select("_own", "_parts")), "_own")
    return s.select("site_id", "lat", "lon", "radius_m", _tile(F.pmod(F.xxhash64("site_id", "lat", "lon"), F.col("_parts"))).alias("tile")), owns


def _tile(part: Column) -> Column:
    return F.col("_own").cast("long") * (1 << 32) + part


def _pieces(elements: DataFrame, columns: list[str]) -> DataFrame:
    """One row a storm, home and piece with its elements as arrays, and their box."""
    largest = elements.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
    piece = F.pmod(F.xxhash64(*columns), F.lit(max(1, math.ceil(largest / PIECE))))
    rows = elements.groupBy("sid", "key", "home", piece.alias("_piece")).agg(
        F.collect_list(F.struct(*columns)).alias("e"), F.min("south").alias("south"), F.max("north").alias("north"),
        F.min("west").alias("west"), F.max("east").alias("east"), F.max("round").alias("round"))
    return rows.select("sid", "key", *(F.col(f"e.{c}").alias(c) for c in columns), "south", "north", "west", "east", "round")


def _placed_segments(segments: DataFrame, columns: list[str]) -> DataFrame:
    """Segments with home and box (west and east go on beyond 180 degrees, all around near a pole)."""
    row, col = _row_col(F.col("a_lat"), F.col("a_lon"), F.lit(HOME))
    p = S.prepare_segments(segments)
    around = (F.col("lon_span") >= 179.999) | (F.col("lat_hi") >= 89.99999) | (F.col("lat_lo") <= -89.99999)
    return p.select(*columns, (row * 100 + col).alias("home"), F.col("lat_lo").alias("south"), F.col("lat_hi").alias("north"),
                    F.col("lon_lo").alias("west"), (F.col("lon_lo") + F.col("lon_span")).alias("east"), around.alias("round"))


def _placed_fixes(fixes: DataFrame) -> DataFrame:
    row, col = _row_col(F.col("lat"), F.col("lon"), F.lit(HOME))
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return fixes.select("*", (row * 100 + col).alias("home"), lat.alias("south"), lat.alias("north"), lon.alias("west"), lon.alias("east"), F.lit(False).alias("round"))


def _blocks(elements: DataFrame, columns: list[str], sites: DataFrame, make, schema, about: DataFrame | None = None) -> DataFrame:
    """What ``make(sites of a tile)`` says of the storms that it meets: see :func:`_run`.

    ``about``: storm_id and columns; storms that it lacks are left out, and key is then the list of its rows.
    """
    spark = sites.sparkSession
    ship_package(spark)
    placed, owns = _tiled(sites)
    pieces = _pieces(elements, columns)
    if about is not None:
        facts = about.groupBy(F.col("storm_id").alias("sid")).agg(F.collect_list(F.struct(*about.columns)).alias("key"))
        pieces = pieces.drop("key").join(facts, "sid")
    width, span = F.col("_east") - F.col("_west"), F.col("east") - F.col("west")
    beside = (F.pmod(F.col("west") - F.col("_west"), F.lit(360.0)) <= width) | (F.pmod(F.col("_west") - F.col("west"), F.lit(360.0)) <= span)
    meets = (F.col("south") <= F.col("_north")) & (F.col("north") >= F.col("_south")) & (F.col("round") | F.col("_round") | beside)
    right = pieces.join(F.broadcast(owns), meets).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    right = right.select(_tile(F.col("_part")).alias("tile"), F.lit(1).alias("kind"), "sid", "key", *(F.col(c).alias(f"e_{c}") for c in columns))
    left = placed.withColumn("kind", F.lit(0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # user-numbered: few bytes but much work, which AQE would merge into few tasks
    rows = left.unionByName(right, allowMissingColumns=True).repartition(parts, "tile").sortWithinPartitions("tile", "kind", "sid")
    return rows.mapInArrow(_run(make, columns, BUCKET_ELEMENTS), schema)


def _run(make, columns: list[str], chunk: int):
    """Rows by tile (its sites, then its storms by id): ``make(sites)`` gives what gets chunks of whole
    storms by ``meet`` and is asked for the rest by ``end``; both yield record batches."""
    def run(batches):
        tile, sites, state, held, size = None, [], None, [], 0

        def chunks(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            if not last:  # the last storm may go on
                code = np.asarray(table["sid"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
                cut = int(np.argmax(code == code[-1]))
                rest = table.slice(cut).to_batches()
                table, held = table.slice(0, cut), rest
                size = sum(_elements(x, columns) for x in rest)
            else:
                held, size = [], 0
            if table.num_rows:
                yield from state.meet(_Storms(table, columns))

        def end():
            nonlocal sites, state
            if sites and state is None:
                state = make(_Sites(pa.Table.from_batches(sites)))
            if state is not None:
                if held:
                    yield from chunks(True)
                yield from state.end()
            sites, state = [], None

        for batch in batches:
            tiles, kinds = (np.asarray(batch.column(c)) for c in ("tile", "kind"))
            starts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])]) if len(tiles) else []
            for k, to in zip(starts, [*starts[1:], len(tiles)]):
                if tiles[k] != tile:
                    yield from end()
                    tile = tiles[k]
                part = batch.slice(k, to - k)
                if kinds[k] == 0:
                    sites.append(part)
                elif sites:
                    if state is None:
                        state = make(_Sites(pa.Table.from_batches(sites)))
                    rows = max(1, part.num_rows * chunk // max(1, _elements(part, columns)))
                    for at in range(0, part.num_rows, rows):
                        held.append(part.slice(at, rows))
                        size += _elements(held[-1], columns)
                        if size >= chunk:
                            yield from chunks(False)
        yield from end()

    return run


def _elements(batch: pa.RecordBatch, columns: list[str]) -> int:
    offsets = batch.column(f"e_{columns[0]}").offsets
    return offsets[-1].as_py() - offsets[0].as_py()


# ------------------------------------------------------------- numbers of one block

def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _at(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Latitude, longitude (radians, given in degrees) and reduced latitude as columns."""
    lat = np.radians(lat)
    return np.column_stack([lat, np.radians(lon), _reduced(lat)])


def _reduced(lat: np.ndarray) -> np.ndarray:
    return np.arctan((1.0 - geo.WGS84_F) * np.tan(lat))


def _metres(a: np.ndarray, b: np.ndarray, model: str) -> np.ndarray:
    """``geo.distance_stages`` of pairs of positions as :func:`_at` gives them."""
    if model == "sphere":
        hav = np.sin((b[:, 0] - a[:, 0]) / 2) ** 2 + np.cos(a[:, 0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[:, 1]) / 2) ** 2
        return 2 * geo.R_MEAN * np.arcsin(np.sqrt(np.minimum(1.0, hav)))
    u, v = a[:, 2], b[:, 2]
    sg = 2 * np.arcsin(np.sqrt(np.minimum(1.0, np.sin((v - u) / 2) ** 2 + np.cos(u) * np.cos(v) * np.sin((b[:, 1] - a[:, 1]) / 2) ** 2)))
    p, q = (u + v) / 2, (v - u) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (sg - np.sin(sg)) * np.sin(p) ** 2 * np.cos(q) ** 2 / np.cos(sg / 2) ** 2
        y = (sg + np.sin(sg)) * np.cos(p) ** 2 * np.sin(q) ** 2 / np.sin(sg / 2) ** 2
        out = geo.WGS84_A * (sg - geo.WGS84_F / 2.0 * (x + y))
    return np.where(sg == 0, 0.0, np.where(np.cos(sg / 2) < 1e-7, geo.R_MEAN * sg, out))


class _Sites:
    """A tile's sites in blocks of neighbours."""

    def __init__(self, table: pa.Table):
        lat, lon, radius = (table[c].to_numpy() for c in ("lat", "lon", "radius_m"))
        side = max(math.sqrt(BLOCK_SITES / max(1, len(lat))) * float(np.ptp(lat)), 0.1) if len(lat) else 1.0
        row = np.floor(lat / side)
        order = np.lexsort((np.where(row % 2 == 0, lon, -lon), row, np.ceil(2 * np.log2(radius))))
        self.ids = table["site_id"].take(pa.array(order))
        self.at, self.radius = _at(lat[order], lon[order]), radius[order]
        self.unit = _unit(lat[order], lon[order])
        self.low = np.minimum(self.radius / K_LOW, math.pi)  # out beyond this angle
        self.high = np.minimum(self.radius / K_HIGH, FAR)  # in up to this angle

    def blocks(self):
        return (slice(k, min(k + BLOCK_SITES, len(self.radius))) for k in range(0, len(self.radius), BLOCK_SITES))

    def around(self, b: slice) -> tuple[np.ndarray, float]:
        """Centre of a block and the angle within which everything near its sites lies."""
        c = self.unit[b].sum(axis=0)
        norm = math.sqrt(float(c @ c))
        if norm < 1e-6:
            return np.array([0.0, 0.0, 1.0]), math.pi
        c /= norm
        return c, float(np.max(np.arccos(np.clip(self.unit[b] @ c, -1, 1)) + self.low[b])) + _ANGLE


class _Storms:
    """A bucket's storms: elements as columns, ordered by storm, and the storm of each."""

    def __init__(self, table: pa.Table, columns: list[str]):
        table = table.combine_chunks()
        sid = table["sid"].combine_chunks().dictionary_encode(null_encoding="encode") if table.num_rows else None
        code = np.zeros(0, dtype=np.int64) if sid is None else np.asarray(sid.indices)
        self.sids = None if sid is None else sid.dictionary
        lists = [table[f"e_{c}"].combine_chunks() for c in columns]
        sizes = np.diff(np.asarray(lists[0].offsets)) if table.num_rows else np.zeros(0, dtype=np.int64)
        storm = np.repeat(code, sizes)
        order = np.argsort(storm, kind="stable")
        self.storm = storm[order]
        self.values = {c: np.asarray(x.flatten())[order] for c, x in zip(columns, lists)}
        # the key is the same in all pieces of a storm
        first = np.zeros(len(self.sids) if sid is not None else 0, dtype=np.int64)
        first[code] = np.arange(len(code))
        self.keys = table["key"].take(pa.array(first))

    def near(self, unit: np.ndarray, half: np.ndarray | None, centre: np.ndarray, angle: float):
        """Blocks of the elements that may lie within ``angle`` of ``centre``; no storm is cut. ``half``: cosine and sine of what each reaches."""
        if angle >= math.pi:
            kept = np.arange(len(self.storm))
        elif half is None:
            kept = np.flatnonzero(unit @ centre >= math.cos(angle) - _DOT)
        else:
            far = math.cos(angle) * half[0] - math.sin(angle) * half[1]
            # the sum of both angles goes beyond pi where its sine is negative
            kept = np.flatnonzero((unit @ centre >= far - _DOT) | (math.sin(angle) * half[0] + math.cos(angle) * half[1] <= 0))
        storm = self.storm[kept]
        if not len(kept):
            return
        starts = np.flatnonzero(np.r_[True, storm[1:] != storm[:-1]])
        cut = 0
        while cut < len(starts):
            to = max(cut + 1, int(np.searchsorted(starts, starts[cut] + BLOCK_ELEMENTS, "right")) - 1)
            end = len(kept) if to >= len(starts) - 1 and len(kept) - starts[cut] <= BLOCK_ELEMENTS else None
            to = len(starts) if end is not None else to
            last = len(kept) if to >= len(starts) else int(starts[to])
            yield kept[starts[cut]:last], starts[cut:to] - starts[cut], storm[starts[cut:to]]
            cut = to


def _vector_at(c: np.ndarray) -> np.ndarray:
    """:func:`_at` of vectors of any length."""
    lat = np.arctan2(c[:, 2], np.sqrt(c[:, 0] * c[:, 0] + c[:, 1] * c[:, 1]))
    return np.column_stack([lat, np.arctan2(c[:, 1], c[:, 0]), _reduced(lat)])


def _segments_within(sites: _Sites, at: np.ndarray, seg: np.ndarray, geom: dict, model: str) -> np.ndarray:
    """Whether each pair (site ``at``, segment ``seg``) is within the site's radius."""
    p = sites.unit[at]
    a, b, n, nn = geom["a"][seg], geom["b"][seg], geom["n"][seg], geom["nn"][seg]
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    inside = (nn > geo.NN_MIN) & (dot(geom["u"][seg], p) >= 0) & (dot(geom["v"][seg], p) >= 0)
    pn = dot(p, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        foot = np.arcsin(np.minimum(1.0, np.abs(pn) / np.sqrt(nn)))
    ends = np.arccos(np.clip(np.maximum(dot(p, a), dot(p, b)), -1, 1))
    angle = np.where(inside, foot, ends)
    radius = sites.radius[at]
    within = (angle + _ANGLE <= sites.high[at])
    open_ = np.flatnonzero(~within & ((angle - _ANGLE) * K_LOW <= radius))
    if len(open_):
        site, inside = sites.at[at[open_]], inside[open_]
        best = np.fmin(*(_metres(site, geom[f"{e}_at"][seg[open_]], model) for e in ("a", "b")))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = p[open_] - (pn[open_] / nn[open_])[:, None] * n[open_]
        best = np.where(inside, np.fmin(best, _metres(site, _vector_at(c), model)), best)
        within[open_] = best <= radius[open_]
    return within


def _segment_geometry(v: dict) -> dict:
    """``geo.segment_prep_stages`` of a bucket's segments, with middle and half length of each arc."""
    a, b = _unit(v["a_lat"], v["a_lon"]), _unit(v["b_lat"], v["b_lon"])
    n = np.cross(a, b)
    middle = a + b
    norm = np.sqrt(np.einsum("ij,ij->i", middle, middle))
    flat = norm < 1e-6  # ends opposite each other: the arc may lie anywhere
    middle = np.where(flat[:, None], a, middle / np.where(flat, 1.0, norm)[:, None])
    half = np.where(flat, math.pi, np.arccos(np.clip(np.einsum("ij,ij->i", middle, a), -1, 1)) + _ANGLE)
    return {"a": a, "b": b, "n": n, "nn": np.einsum("ij,ij->i", n, n), "u": np.cross(n, a), "v": np.cross(b, n), "middle": middle, "half": half, "flat": flat,
            "cos_sin": (np.cos(half), np.sin(half)), "a_at": _at(v["a_lat"], v["a_lon"]), "b_at": _at(v["b_lat"], v["b_lon"])}


def _tracks_met(sites: _Sites, storms: _Storms, model: str):
    """Block of sites, storms and whether the track of each passes within the radius of each."""
    geom = _segment_geometry(storms.values)
    wide = np.column_stack([geom["middle"], *geom["cos_sin"]])
    for b in sites.blocks():
        centre, angle = sites.around(b)
        unit, low = sites.unit[b], sites.low[b]
        # one product says how far the dot lies above the cosine of (angle out + half length)
        reach = np.column_stack([unit, -np.cos(low), np.sin(low)])
        sure = np.cos(sites.high[b])[:, None] + _DOT
        for seg, starts, which in storms.near(geom["middle"], geom["cos_sin"], centre, angle):
            dots = unit @ geom["middle"][seg].T
            if geom["flat"][seg].any():
                dots[:, geom["flat"][seg]] = -2.0
            met = np.maximum.reduceat(dots, starts, axis=1) >= sure
            open_ = (reach @ wide[seg].T) >= -_DOT
            open_ |= low[:, None] + geom["half"][seg] >= math.pi
            sizes = np.diff(np.r_[starts, len(seg)])
            open_ &= ~np.repeat(met, sizes, axis=1)
            s, e = np.nonzero(open_)
            if len(s):
                within = _segments_within(sites, s + b.start, seg[e], geom, model)
                met[s[within], np.repeat(np.arange(len(starts)), sizes)[e[within]]] = True
            yield b, which, met


def _tracks_measured(sites: _Sites, storms: _Storms, model: str):
    """As :func:`_tracks_met`, with the distances of the storms in metres (infinite beyond the radius).

    Angles to all arcs say which of a storm's segments may be the nearest one (within K_HIGH / K_LOW of the smallest
    angle); these few get the exact distance.
    """
    geom = _segment_geometry(storms.values)
    arc = geom["nn"] > geo.NN_MIN
    normal = np.where(arc[:, None], geom["n"] / np.sqrt(np.where(arc, geom["nn"], 1.0))[:, None], 0.0)
    for b in sites.blocks():
        centre, angle = sites.around(b)
        unit, low = sites.unit[b], sites.low[b][:, None]
        for seg, starts, which in storms.near(geom["middle"], geom["cos_sin"], centre, angle):
            ends = [unit @ geom[e][seg].T for e in ("a", "b")]
            off = unit @ normal[seg].T
            inside = (unit @ geom["u"][seg].T >= 0) & (unit @ geom["v"][seg].T >= 0) & arc[seg]
            near = np.where(inside, np.sqrt(np.maximum(0.0, 1.0 - off * off)), np.maximum(*ends))
            least = np.arccos(np.clip(np.maximum.reduceat(near, starts, axis=1), -1, 1))
            most = (least + _ANGLE) * (K_HIGH / K_LOW) + _ANGLE
            bound = np.where((least + _ANGLE >= FAR) | (most >= math.pi), -2.0, np.cos(np.minimum(most, math.pi)) - _DOT)
            bound[least - _ANGLE > low] = 2.0  # out
            sizes = np.diff(np.r_[starts, len(seg)])
            limit = np.repeat(bound, sizes, axis=1)
            s, e = np.nonzero(near >= limit)
            found = np.full(bound.shape, np.inf)
            if len(s):
                at, which_seg, limit, best = s + b.start, seg[e], limit[s, e], np.full(len(s), np.inf)
                for end, dots in zip(("a_at", "b_at"), ends):
                    k = np.flatnonzero(dots[s, e] >= limit)
                    best[k] = np.fmin(best[k], _metres(sites.at[at[k]], geom[end][which_seg[k]], model))
                k = np.flatnonzero(inside[s, e])
                foot = sites.unit[at[k]] - off[s[k], e[k]][:, None] * normal[which_seg[k]]
                best[k] = np.fmin(best[k], _metres(sites.at[at[k]], _vector_at(foot), model))
                best[best > sites.radius[at]] = np.inf
                storm = s * len(starts) + np.repeat(np.arange(len(starts)), sizes)[e]  # ascending
                first = np.flatnonzero(np.r_[True, storm[1:] != storm[:-1]])
                found.reshape(-1)[storm[first]] = np.minimum.reduceat(best, first)
            yield b, which, found


def _winds_met(sites: _Sites, storms: _Storms, model: str):
    """Block of sites, storms and the strongest wind of each one's fixes within the radius of each (0: none)."""
    v = storms.values
    unit, wind = _unit(v["lat"], v["lon"]), v["wind"].astype(np.int16)
    at = _at(v["lat"], v["lon"])
    for b in sites.blocks():
        centre, angle = sites.around(b)
        sure, out = np.cos(sites.high[b])[:, None] + _DOT, np.cos(sites.low[b])[:, None] - _DOT
        for fix, starts, which in storms.near(unit, None, centre, angle):
            dots = sites.unit[b] @ unit[fix].T
            inside = dots >= sure
            s, e = np.nonzero((dots >= out) & ~inside)
            if len(s):
                inside[s, e] = _metres(sites.at[s + b.start], at[fix[e]], model) <= sites.radius[s + b.start]
            yield b, which, np.maximum.reduceat(inside * wind[fix], starts, axis=1)


# ------------------------------------------------------------- what is kept of a tile

class _Counts:
    """site_id, key and n: how many storms with the key a site has met. Rows of a site and key add up."""

    #: Numbers (sites times keys) that are kept.
    KEPT = 1 << 22

    def __init__(self, model: str, sites: _Sites):
        self.model, self.sites, self.keys, self.total = model, sites, {}, np.zeros((0, len(sites.radius)), dtype=np.int64)

    def meet(self, storms: _Storms):
        distinct = storms.keys.combine_chunks().dictionary_encode(null_encoding="encode")
        names = distinct.dictionary.to_pylist()
        known = len(self.keys) + sum(k not in self.keys for k in names)
        if self.keys and known * len(self.sites.radius) > self.KEPT:
            yield from self.end()
        number = np.array([self.keys.setdefault(k, len(self.keys)) for k in names], dtype=np.int64)[np.asarray(distinct.indices)]
        self.total = np.vstack([self.total, np.zeros((len(self.keys) - len(self.total), len(self.sites.radius)), dtype=np.int64)])
        for b, which, met in _tracks_met(self.sites, storms, self.model):
            keys, back = np.unique(number[which], return_inverse=True)
            if len(keys) == 1:
                self.total[keys[0], b] += met.sum(axis=1)
            else:
                s, t = np.nonzero(met)
                width = met.shape[0]
                self.total[keys, b] += np.bincount(back[t] * width + s, minlength=len(keys) * width).reshape(len(keys), width)

    def end(self):
        names = pa.array(list(self.keys), pa.int64())
        for k in range(0, len(self.sites.radius), 4096):
            part = self.total[:, k:k + 4096]
            key, site = np.nonzero(part)
            if len(key):
                yield pa.RecordBatch.from_arrays([self.sites.ids.take(pa.array(site + k)).combine_chunks(), names.take(pa.array(key)), pa.array(part[key, site])], names=["site_id", "key", "n"])
        self.keys, self.total = {}, np.zeros((0, len(self.sites.radius)), dtype=np.int64)


class _Met:
    """sid of the storms that some site has met."""

    def __init__(self, model: str, sites: _Sites):
        self.model, self.sites = model, sites

    def meet(self, storms: _Storms):
        met = np.zeros(len(storms.sids), dtype=bool)
        for _, which, found in _tracks_met(self.sites, storms, self.model):
            met[which] |= found.any(axis=0)
        if met.any():
            yield pa.RecordBatch.from_arrays([storms.sids.filter(pa.array(met))], names=["sid"])

    def end(self):
        return iter(())


class _Samples:
    """site_id and s: the strongest winds of the storms that a site has met, as (max_wind, cnt) by wind."""

    def __init__(self, model: str, top: int, sites: _Sites):
        self.model, self.sites, self.total = model, sites, np.zeros((len(sites.radius), top + 1), dtype=np.int64)

    def meet(self, storms: _Storms):
        width = self.total.shape[1]
        for b, _, best in _winds_met(self.sites, storms, self.model):
            flat = (best + np.arange(0, len(best) * width, width)[:, None]).ravel()
            self.total[b] += np.bincount(flat, minlength=len(best) * width).reshape(len(best), width)
        yield from ()

    def end(self):
        self.total[:, 0] = 0  # storms without a fix within the radius
        for k in range(0, len(self.total), 1024):
            site, wind = np.nonzero(self.total[k:k + 1024])
            if not len(site):
                continue
            met, starts = np.unique(site, return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(wind.astype(np.int32)), pa.array(self.total[k + site, wind])], names=["max_wind", "cnt"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(site)].astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([self.sites.ids.take(pa.array(met + k)).combine_chunks(), lists], names=["site_id", "s"])


class _Pairs:
    """sid (or key) and hits: the sites that have met the storm, each with a number. A storm has many rows."""

    def __init__(self, model: str, measured: bool, sites: _Sites):
        self.model, self.sites, self.measured = model, sites, measured

    def _rows(self, storms: _Storms, waiting: list) -> pa.RecordBatch:
        storm, starts, site, value = (np.concatenate(x) for x in zip(*waiting))
        ids = self.sites.ids.take(pa.array(site)).combine_chunks()
        number, name = (pa.array(value), "dist_m") if self.measured else (pa.array(value.astype(np.int32)), "max_wind")
        hits = pa.ListArray.from_arrays(pa.array(np.r_[np.cumsum(starts) - starts, len(site)].astype(np.int32)), pa.StructArray.from_arrays([ids, number], names=["site_id", name]))
        told = (storms.keys if self.measured else storms.sids).take(pa.array(storm))
        return pa.RecordBatch.from_arrays([told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told, hits], names=["key" if self.measured else "sid", "hits"])

    def meet(self, storms: _Storms):
        waiting, size = [], 0
        for b, which, found in (_tracks_measured if self.measured else _winds_met)(self.sites, storms, self.model):
            t, s = np.nonzero(found.T < np.inf if self.measured else found.T)
            if not len(t):
                continue
            sizes = np.bincount(t, minlength=len(which))
            some = np.flatnonzero(sizes)
            waiting.append((which[some], sizes[some], s + b.start, found[s, t]))
            size += len(t)
            if size >= BATCH:
                yield self._rows(storms, waiting)
                waiting, size = [], 0
        if waiting:
            yield self._rows(storms, waiting)

    def end(self):
        return iter(())


class _Points:
    """site_id and n: how many points lie within the radius. Points come in groups (cells) in place of storms: a group that
    lies wholly within the radius counts by its size, only groups that the border may cross are looked at point by point."""

    #: Points of border groups that are compared at once.
    AT_ONCE = 1 << 19

    def __init__(self, model: str, sites: _Sites):
        self.model, self.sites, self.total = model, sites, np.zeros(len(sites.radius), dtype=np.int64)

    def meet(self, groups: _Storms):
        v, sites = groups.values, self.sites
        unit, at = _unit(v["lat"], v["lon"]), _at(v["lat"], v["lon"])
        starts = np.flatnonzero(np.r_[True, groups.storm[1:] != groups.storm[:-1]])
        sizes = np.diff(np.r_[starts, len(unit)])
        middle = np.add.reduceat(unit, starts, axis=0)
        norm = np.sqrt(np.einsum("ij,ij->i", middle, middle))
        flat = norm < 1e-6 * sizes  # all around the globe
        middle = np.where(flat[:, None], unit[starts], middle / np.where(flat, 1.0, norm)[:, None])
        away = np.arccos(np.clip(np.einsum("ij,ij->i", unit, np.repeat(middle, sizes, axis=0)), -1, 1))
        half = np.where(flat, math.pi, np.maximum.reduceat(away, starts) + _ANGLE)
        wide = np.column_stack([middle, np.cos(half), np.sin(half)])
        for b in sites.blocks():
            centre, angle = sites.around(b)
            near = np.flatnonzero(np.arccos(np.clip(middle @ centre, -1, 1)) <= angle + half)
            if not len(near):
                continue
            low, high = sites.low[b], sites.high[b]
            met = wide[near].T
            whole = (np.column_stack([sites.unit[b], -np.cos(high), -np.sin(high)]) @ met >= _DOT) & (half[near] + _ANGLE < high[:, None])
            border = (np.column_stack([sites.unit[b], -np.cos(low), np.sin(low)]) @ met >= -_DOT) | (low[:, None] + half[near] >= math.pi)
            self.total[b] += whole @ sizes[near]
            s, g = np.nonzero(border & ~whole)
            g = near[g]
            ends = np.cumsum(sizes[g])
            cut = 0
            while cut < len(g):
                to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + self.AT_ONCE, "right")))
                self._looked_at(b, s[cut:to], starts[g[cut:to]], sizes[g[cut:to]], unit, at)
                cut = to
        yield from ()

    def _looked_at(self, b: slice, s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, unit: np.ndarray, at: np.ndarray):
        """Count the points of groups (start, size) for site ``s`` of a block each."""
        sites = self.sites
        site = np.repeat(s + b.start, sizes)
        point = np.arange(len(site)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        dots = np.einsum("ij,ij->i", sites.unit[site], unit[point])
        inside = dots >= (np.cos(sites.high) + _DOT)[site]
        k = np.flatnonzero((dots >= (np.cos(sites.low) - _DOT)[site]) & ~inside)
        inside[k] = _metres(sites.at[site[k]], at[point[k]], self.model) <= sites.radius[site[k]]
        self.total += np.bincount(site[inside], minlength=len(self.total))

    def end(self):
        some = np.flatnonzero(self.total)
        if len(some):
            yield pa.RecordBatch.from_arrays([self.sites.ids.take(pa.array(some)).combine_chunks(), pa.array(self.total[some])], names=["site_id", "n"])


# ------------------------------------------------------------- results

_SEGMENT, _FIX = ["a_lat", "a_lon", "b_lat", "b_lon"], ["lat", "lon", "wind"]


def storms_counted(points: DataFrame, sites: DataFrame, keys: DataFrame | None = None, model: str = "spheroid",
                   segments: DataFrame | None = None) -> DataFrame:
    """(site_id, key, n): how many storms with that ``key`` have a track within the radius.

    ``keys`` is sid and key (long); storms that it lacks don't count. Without it, all storms have
    the key null. Rows of a site and key add up.
    """
    seg = segments if segments is not None else track_segments(points)
    seg = seg.select("sid", "seq", *_SEGMENT)
    seg = seg.withColumn("key", F.lit(None).cast("long")) if keys is None else seg.join(keys.select("sid", F.col("key").cast("long").alias("key")), "sid")
    seg = seg.checkpoint(eager=True)  # read twice (sizes, pieces), after an ordered numbering
    alone, many = _single(sites)
    site = sites.schema["site_id"].dataType.simpleString()
    out = _blocks(_placed_segments(seg, ["sid", "key", *_SEGMENT]), _SEGMENT, alone, partial(_Counts, model), f"site_id {site}, key long, n long")
    if many is not None:
        pairs = S.segment_pairs_within(seg, many, model, ("sid", "key")).groupBy("site_id", "sid", "key").agg(F.lit(1))
        out = out.unionByName(pairs.groupBy("site_id", "key").agg(F.count(F.lit(1)).alias("n")))
    return out


def storms_met(segments: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """sid of every storm whose track passes within the radius of some site, once."""
    seg = segments.select("sid", "seq", *_SEGMENT).withColumn("key", F.lit(None).cast("long")).checkpoint(eager=True)
    places = S.valid_sites(sites).select("site_id", "lat", "lon", "radius_m").distinct()
    return _blocks(_placed_segments(seg, ["sid", "key", *_SEGMENT]), _SEGMENT, places, partial(_Met, model), f"sid {segments.schema['sid'].dataType.simpleString()}").distinct()


def tracks_near(segments: DataFrame, sites: DataFrame, about: DataFrame, model: str = "spheroid") -> DataFrame:
    """site_id, dist_m and the columns of ``about`` (storm_id and others) for every site and storm
    whose track passes within the radius: ``search.tracks_within`` joined with ``about``, without an exchange of pairs."""
    seg = segments.select("sid", "seq", *_SEGMENT).withColumn("key", F.lit(None).cast("long")).checkpoint(eager=True)
    alone, many = _single(sites)
    kind = lambda f, n: T.StructField(n, f.schema[n].dataType)
    hits = T.ArrayType(T.StructType([kind(sites, "site_id"), T.StructField("dist_m", T.DoubleType())]))
    told = T.ArrayType(T.StructType([kind(about, c) for c in about.columns]))
    schema = T.StructType([T.StructField("key", told), T.StructField("hits", hits)])
    out = _blocks(_placed_segments(seg, ["sid", "key", *_SEGMENT]), _SEGMENT, alone, partial(_Pairs, model, True), schema, about)
    out = out.select("hits", F.inline("key")).select(F.inline("hits"), *about.columns)
    if many is not None:
        near = S.segment_pairs_within(seg, many, model).groupBy("site_id", "sid").agg(F.min("dist_m").alias("dist_m"))
        out = out.unionByName(near.join(about, near["sid"] == about["storm_id"]).drop("sid"))
    return out


def _usable_fixes(points: DataFrame) -> DataFrame:
    """sid, lat, lon and wind of the usable fixes of storms that have a track (two placed fixes or more)."""
    from .risk import usable_wind
    from .tracks import build_tracks

    fixes = valid_points(usable_wind(points).select("sid", "lat", "lon", F.col("wmo_wind").cast("int").alias("wind")))
    return fixes.join(build_tracks(points).select("sid"), "sid", "left_semi").withColumn("key", F.lit(None).cast("long"))


def samples(points: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """(site_id, s): the sample of ``risk.storm_block_maxima`` as (max_wind, cnt) by wind, one row a site."""
    from .risk import WIND_MAX

    site = sites.schema["site_id"].dataType.simpleString()
    return _maxima(points, sites, model, partial(_Samples, model, WIND_MAX), f"site_id {site}, s array<struct<max_wind:int,cnt:bigint>>", lambda pairs: (
        pairs.groupBy("site_id", "max_wind").agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("max_wind", "cnt"))).alias("s"))))


def maxima_counted(points: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """(site_id, max_wind, cnt): :func:`samples` as rows."""
    return samples(points, sites, model).select("site_id", F.inline("s"))


def maxima_pairs(points: DataFrame, sites: DataFrame, model: str = "spheroid") -> DataFrame:
    """(site_id, sid, max_wind) of every site and storm with a usable fix within the radius."""
    site, sid = (f.schema[c].dataType.simpleString() for f, c in ((sites, "site_id"), (points, "sid")))
    out = _maxima(points, sites, model, partial(_Pairs, model, False), f"sid {sid}, hits array<struct<site_id:{site},max_wind:int>>", lambda pairs: (
        pairs.select("sid", F.array(F.struct("site_id", "max_wind")).alias("hits"))))
    return out.select("sid", F.inline("hits")).select("site_id", "sid", "max_wind")


def _maxima(points: DataFrame, sites: DataFrame, model: str, make, schema: str, shaped) -> DataFrame:
    fixes = _usable_fixes(points).checkpoint(eager=True)  # read twice (sizes, pieces)
    alone, many = _single(sites)
    out = _blocks(_placed_fixes(fixes), _FIX, alone, make, schema)
    if many is not None:
        pairs = S.points_within(fixes, many, ["sid", "wind"], model).groupBy("site_id", "sid").agg(F.max("wind").alias("max_wind"))
        out = out.unionByName(shaped(pairs))
    return out


def points_met(points: DataFrame, sites: DataFrame, group: Column, model: str = "spheroid") -> DataFrame:
    """site_id and n (over 0): how many points (lat, lon) lie within the radius of each row of ``sites``. Points of one
    ``group`` (a number), which should lie close together, are counted together. ``points`` are read three times."""
    pts = points.select("lat", "lon", group.cast("long").alias("_group"))
    largest = pts.groupBy("_group").count().agg(F.max("count")).first()[0] or 0
    n = max(1, math.ceil(largest / PIECE))  # a crowded group is several
    pts = pts.select((F.col("_group") * n + F.pmod(F.xxhash64("lat", "lon"), F.lit(n))).alias("sid"), F.lit(None).cast("long").alias("key"), "lat", "lon")
    places = S.valid_sites(sites).select("site_id", "lat", "lon", "radius_m")
    return _blocks(_placed_fixes(pts), ["lat", "lon"], places, partial(_Points, model), f"site_id {sites.schema['site_id'].dataType.simpleString()}, n long")
