"""Events on routes: points and stretches given by their place along a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import native as N
from ..layer import set_srid, srid_of, with_bbox


def locate_events(routes: DataFrame, events: DataFrame, route_id: str, at: str, offset: float = 0.0, unit: str = "fraction") -> DataFrame:
    """Point per event at column ``at`` of its route (a fraction, or a distance with unit='length')."""
    r = routes.select(route_id, F.col("geom").alias("_line"))
    j = events.join(r, route_id)
    f = F.col(at) if unit == "fraction" else F.try_divide(F.col(at), N.length(F.col("_line")))
    out = j.withColumn("geom", N.line_interpolate(F.col("_line"), f, offset)).drop("_line")
    return set_srid(with_bbox(out), srid_of(routes))


def locate_stretches(routes: DataFrame, events: DataFrame, route_id: str, start: str, end: str) -> DataFrame:
    """Sub-line per event between two fractions of its route."""
    r = routes.select(route_id, F.col("geom").alias("_line"))
    out = events.join(r, route_id).withColumn("geom", N.line_substring(F.col("_line"), F.col(start), F.col(end))).drop("_line")
    return set_srid(with_bbox(out), srid_of(routes))


def measure_points(routes: DataFrame, points: DataFrame, route_id: str) -> DataFrame:
    """Fraction along its route, and distance from it, for each point of an event layer."""
    r = routes.select(route_id, F.col("geom").alias("_line"))
    v = N.vertices(F.col("geom"))[0]
    j = points.join(r, route_id)
    return (j.withColumn("fraction", N.line_locate(F.col("_line"), v["x"], v["y"]))
            .withColumn("dist", N.segment_distance(F.col("_line"), v["x"], v["y"])).drop("_line"))
