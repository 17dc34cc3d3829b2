"""Geodesic distance as plain column arithmetic.

Every formula is produced as SQL expression text over column names, as a list of
``(name, expr)`` *stages* where a stage may use the names of earlier stages.
Spark applies the stages as projections (whole-stage codegen, no UDF); the DuckDB
oracle nests them as sub-selects, so both engines evaluate identical arithmetic.

Distance models
  * ``sphere``   haversine on the mean-radius sphere.
  * ``spheroid`` Lambert's long-line formula on WGS84 (default; within a few
                 metres of the exact ellipsoidal geodesic at search radii).

Point-to-segment distance takes the closest point of the great-circle arc
(unit-vector algebra, no special case at the antimeridian), then measures
site -> closest point with the chosen model.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fence import fence as _fence
from .fence import fenced_filter  # noqa: F401  (re-exported for callers)

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
R_MEAN = (2.0 * WGS84_A + WGS84_B) / 3.0
_E2 = WGS84_F * (2.0 - WGS84_F)
# Meridional radius of curvature at the equator: the smallest on the ellipsoid,
# so it gives the fewest metres per degree and therefore safe (wide) boxes.
R_MERID_MIN = WGS84_A * (1.0 - _E2)
M_PER_DEG_LAT_MIN = R_MERID_MIN * math.pi / 180.0

MODELS = ("spheroid", "sphere")

Stages = list[tuple[str, str]]


def lit(x: float) -> str:
    """A double literal that both Spark SQL and DuckDB read as DOUBLE."""
    s = repr(float(x))
    return s if ("e" in s or "E" in s) else s + "e0"


def apply_stages(df: DataFrame, stages: Stages, fence: bool = False) -> DataFrame:
    """Apply stages as projections.

    ``fence=True`` ends with a column Catalyst treats as non-deterministic, so a
    later filter on the result is evaluated once, here, instead of being pushed
    below the projections with every stage inlined into a join condition.
    """
    for name, expr in stages:
        df = df.withColumn(name, F.expr(expr))
    return _fence(df) if fence else df


def stages_sql(source_sql: str, stages: Stages, alias: str = "t") -> str:
    """Render stages as nested sub-selects over ``source_sql`` (DuckDB side)."""
    sql = source_sql
    for i, (name, expr) in enumerate(stages):
        sql = f"select *, {expr} as {name} from ({sql}) as {alias}{i}"
    return sql


# ---------------------------------------------------------------- per point

def unit_vector_stages(p: str, lat: str, lon: str) -> Stages:
    """Radians, reduced latitude and the unit vector of a lat/lon column pair."""
    return [
        (f"{p}_latr", f"radians({lat})"),
        (f"{p}_lonr", f"radians({lon})"),
        (f"{p}_beta", f"atan({lit(1.0 - WGS84_F)} * tan({p}_latr))"),
        (f"{p}_x", f"cos({p}_latr) * cos({p}_lonr)"),
        (f"{p}_y", f"cos({p}_latr) * sin({p}_lonr)"),
        (f"{p}_z", f"sin({p}_latr)"),
    ]


def point_prep_stages(p: str, lat: str, lon: str) -> Stages:
    """What a distance needs from one point: radians and reduced latitude."""
    return [
        (f"{p}_latr", f"radians({lat})"),
        (f"{p}_lonr", f"radians({lon})"),
        (f"{p}_beta", f"atan({lit(1.0 - WGS84_F)} * tan({p}_latr))"),
    ]


# ------------------------------------------------------------- pair distance

def _guarded(expr: str, guard: str | None) -> str:
    return expr if guard is None else f"case when {guard} then {expr} end"


def distance_stages(out: str, a: str, b: str, model: str = "spheroid",
                    guard: str | None = None) -> Stages:
    """Distance in metres between prepared points ``a`` and ``b``.

    ``a``/``b`` are prefixes for which ``{p}_latr``, ``{p}_lonr`` and
    ``{p}_beta`` exist (see :func:`point_prep_stages`). With ``guard`` (a SQL
    condition) the formula is evaluated only where it holds, else NULL.
    """
    if model not in MODELS:
        raise ValueError(f"unknown distance model {model!r}")
    if model == "sphere":
        hav = (f"power(sin(({b}_latr - {a}_latr) / 2), 2) + cos({a}_latr) * cos({b}_latr)"
               f" * power(sin(({b}_lonr - {a}_lonr) / 2), 2)")
        return [(out, _guarded(f"{lit(2.0 * R_MEAN)} * asin(sqrt(least({lit(1.0)}, {hav})))", guard))]
    sg = f"{out}_sg"
    hav = (f"power(sin(({b}_beta - {a}_beta) / 2), 2) + cos({a}_beta) * cos({b}_beta)"
           f" * power(sin(({b}_lonr - {a}_lonr) / 2), 2)")
    p_ = f"(({a}_beta + {b}_beta) / 2)"
    q_ = f"(({b}_beta - {a}_beta) / 2)"
    x_ = (f"({sg} - sin({sg})) * power(sin({p_}), 2) * power(cos({q_}), 2)"
          f" / power(cos({sg} / 2), 2)")
    y_ = (f"({sg} + sin({sg})) * power(cos({p_}), 2) * power(sin({q_}), 2)"
          f" / power(sin({sg} / 2), 2)")
    lam = f"{lit(WGS84_A)} * ({sg} - {lit(WGS84_F / 2.0)} * (({x_}) + ({y_})))"
    return [
        (sg, _guarded(f"2 * asin(sqrt(least({lit(1.0)}, {hav})))", guard)),
        (out, f"case when {sg} is null then null when {sg} = 0 then {lit(0.0)}"
              f" when cos({sg} / 2) < {lit(1e-7)} then {lit(R_MEAN)} * {sg}"
              f" else {lam} end"),
    ]


# ----------------------------------------------------------- segment geometry

def segment_prep_stages(seg: str, a: str, b: str) -> Stages:
    """Per-segment constants: n = A x B, u = n x A, v = B x n, |n|^2.

    ``a``/``b`` are unit-vector prefixes (see :func:`unit_vector_stages`).
    """
    s = seg
    return [
        (f"{s}_nx", f"{a}_y * {b}_z - {a}_z * {b}_y"),
        (f"{s}_ny", f"{a}_z * {b}_x - {a}_x * {b}_z"),
        (f"{s}_nz", f"{a}_x * {b}_y - {a}_y * {b}_x"),
        (f"{s}_nn", f"{s}_nx * {s}_nx + {s}_ny * {s}_ny + {s}_nz * {s}_nz"),
        (f"{s}_ux", f"{s}_ny * {a}_z - {s}_nz * {a}_y"),
        (f"{s}_uy", f"{s}_nz * {a}_x - {s}_nx * {a}_z"),
        (f"{s}_uz", f"{s}_nx * {a}_y - {s}_ny * {a}_x"),
        (f"{s}_vx", f"{b}_y * {s}_nz - {b}_z * {s}_ny"),
        (f"{s}_vy", f"{b}_z * {s}_nx - {b}_x * {s}_nz"),
        (f"{s}_vz", f"{b}_x * {s}_ny - {b}_y * {s}_nx"),
    ]


NN_MIN = 1e-18  # |A x B|^2 below this = repeated fix, treat as a point


def lower_bound_expr(p: str, seg: str | None, a: str, b: str | None = None) -> str:
    """A cheap lower bound (m) on the model distance from unit-vector dot products.

    On WGS84 the metric in geodetic coordinates is ds^2 = M^2 dphi^2 +
    N^2 cos^2(phi) dlambda^2 with M, N >= M_eq, so any path -- the geodesic
    included -- is at least M_eq times the spherical angle between the geodetic
    unit vectors; the factor 0.999 covers the formula's own error (< 1e-5).
    For an arc the angle is to its closest point (foot inside, else an end).
    """
    k = lit(R_MERID_MIN * 0.999)
    ca = f"({p}_x * {a}_x + {p}_y * {a}_y + {p}_z * {a}_z)"
    if b is None:
        return f"{k} * acos(greatest({lit(-1.0)}, least({lit(1.0)}, {ca})))"
    cb = f"({p}_x * {b}_x + {p}_y * {b}_y + {p}_z * {b}_z)"
    dot_u = f"({seg}_ux * {p}_x + {seg}_uy * {p}_y + {seg}_uz * {p}_z)"
    dot_v = f"({seg}_vx * {p}_x + {seg}_vy * {p}_y + {seg}_vz * {p}_z)"
    inside = f"{seg}_nn > {lit(NN_MIN)} and {dot_u} >= 0 and {dot_v} >= 0"
    foot = (f"asin(least({lit(1.0)}, abs({p}_x * {seg}_nx + {p}_y * {seg}_ny + {p}_z * {seg}_nz)"
            f" / sqrt({seg}_nn)))")
    ends = f"acos(greatest({lit(-1.0)}, least({lit(1.0)}, greatest({ca}, {cb}))))"
    return f"{k} * (case when {inside} then {foot} else {ends} end)"


def segment_distance_stages(out: str, p: str, seg: str, a: str, b: str,
                            model: str = "spheroid", within: str | None = None) -> Stages:
    """Distance (m) from prepared site ``p`` to the arc ``a``-``b``.

    ``p`` needs unit-vector and prep columns; ``seg`` the segment constants.
    With ``within`` (a radius column) the exact formula runs only where the
    lower bound does not already exceed the radius; elsewhere the result is
    NULL, which no radius filter keeps -- matches are unchanged.
    """
    c = f"{out}_c"
    dot_u = f"({seg}_ux * {p}_x + {seg}_uy * {p}_y + {seg}_uz * {p}_z)"
    dot_v = f"({seg}_vx * {p}_x + {seg}_vy * {p}_y + {seg}_vz * {p}_z)"
    t = f"{out}_t"
    st: Stages = [
        (f"{out}_in", f"{seg}_nn > {lit(NN_MIN)} and {dot_u} >= 0 and {dot_v} >= 0"),
        (t, f"case when {out}_in then ({p}_x * {seg}_nx + {p}_y * {seg}_ny"
            f" + {p}_z * {seg}_nz) / {seg}_nn end"),
        (f"{c}_x", f"{p}_x - {t} * {seg}_nx"),
        (f"{c}_y", f"{p}_y - {t} * {seg}_ny"),
        (f"{c}_z", f"{p}_z - {t} * {seg}_nz"),
        (f"{c}_latr", f"atan2({c}_z, sqrt({c}_x * {c}_x + {c}_y * {c}_y))"),
        (f"{c}_lonr", f"atan2({c}_y, {c}_x)"),
        (f"{c}_beta", f"atan({lit(1.0 - WGS84_F)} * tan({c}_latr))"),
    ]
    guard = None
    if within is not None:
        st.insert(0, (f"{out}_lb", lower_bound_expr(p, seg, a, b)))
        guard = f"{out}_lb <= {within}"
    st += distance_stages(f"{out}_da", p, a, model, guard)
    st += distance_stages(f"{out}_db", p, b, model, guard)
    st += distance_stages(f"{out}_dc", p, c, model, guard)
    st.append((out, f"least({out}_da, {out}_db, case when {out}_in then {out}_dc end)"))
    return st


def stage_names(stages: Stages) -> list[str]:
    return [n for n, _ in stages]


# ------------------------------------------------------------- spatial boxes

def lat_reach_deg(radius_m: str) -> str:
    """Latitude half-width (deg) of a circle of radius ``radius_m`` metres, +1 %."""
    return f"({radius_m}) / {lit(M_PER_DEG_LAT_MIN)} * {lit(1.01)} + {lit(1e-6)}"


def lon_reach_deg(lat: str, radius_m: str) -> str:
    """Longitude half-width (deg) of the circle, or NULL when it spans all longitudes."""
    ang = f"(({radius_m}) / {lit(R_MERID_MIN)})"
    s = f"(sin({ang}) / cos(radians({lat})))"
    return (f"case when {ang} >= {lit(math.pi / 2)} or abs({lat}) + {lat_reach_deg(radius_m)} >= 90"
            f" or {s} >= {lit(0.999999)} then null"
            f" else degrees(asin({s})) * {lit(1.01)} + {lit(1e-6)} end")
