"""SQL access: the stored tables and the four table functions as temp views.

The original exposes search, track and event lookups as SQL table functions
taking one point or one id. Here they become views over whole request tables:
register a ``sites`` view (site_id, lat, lon, radius_m) or an ``event_ids`` /
``storm_ids`` view, then query

    select * from cyclones_near where site_id = 7 order by distance_km
    select * from tsunamis_near order by site_id, distance_km
    select * from cyclone_track      -- sid, name, season, geojson
    select * from tsunami_event      -- 30 detail columns

Views are lazy: each query plans the same DataFrame operators as the Python API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import results as R
from ..operators import search as S
from ..operators import tracks as T
from ..sources import export as EX


def register_tables(spark: SparkSession, points: DataFrame, events: DataFrame,
                    tracks: DataFrame | None = None) -> DataFrame:
    """cyclone_points, cyclone_tracks, tsunami_events temp views; returns tracks."""
    tr = tracks if tracks is not None else T.build_tracks(points)
    points.createOrReplaceTempView("cyclone_points")
    tr.createOrReplaceTempView("cyclone_tracks")
    events.createOrReplaceTempView("tsunami_events")
    return tr


def register_functions(spark: SparkSession) -> None:
    """Search / lookup views over the registered tables and request views.

    Needs ``cyclone_points``, ``cyclone_tracks``, ``tsunami_events`` and the
    request views that are present: ``sites`` for the searches, ``storm_ids``
    (sid) for tracks, ``event_ids`` (id) for event details.
    """
    points = spark.table("cyclone_points")
    tracks = spark.table("cyclone_tracks")
    events = spark.table("tsunami_events")
    names = {t.name for t in spark.catalog.listTables()}
    if "sites" in names:
        sites = spark.table("sites")
        S.storms_near(points, tracks, sites).createOrReplaceTempView("cyclones_near")
        S.events_near(events, sites).createOrReplaceTempView("tsunamis_near")
    if "storm_ids" in names:
        EX.track_geojson(points, tracks, spark.table("storm_ids")).createOrReplaceTempView("cyclone_track")
    if "event_ids" in names:
        R.event_detail(events, spark.table("event_ids")).createOrReplaceTempView("tsunami_event")
