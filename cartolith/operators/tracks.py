"""Tracks: ordered points of a key as lines and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import native as N
from ..plans.scan import windowed
from .aggregate import make_lines


def track_steps(points: DataFrame, by: str, ts: str, tie: str | None = None) -> DataFrame:
    """Step length, seconds and speed from the point before, per key in time order.

    Keys with very many points are cut along time, so no key is one task's work."""
    order = [ts] + ([tie] if tie else [])
    v = N.vertices(F.col("geom"))[0]
    d = points.withColumn("_x", v["x"]).withColumn("_y", v["y"])
    d = windowed(d, [by], order, {"_px": lambda w: F.lag("_x").over(w), "_py": lambda w: F.lag("_y").over(w), "_pt": lambda w: F.lag(ts).over(w)}, before=1)
    secs = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_pt").cast("timestamp"))) / 1e6
    step = F.hypot(F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py"))
    out = d.withColumn("step", step).withColumn("seconds", secs).withColumn("speed", F.when(F.col("seconds") > 0, F.col("step") / F.col("seconds")))
    return out.drop("_x", "_y", "_px", "_py", "_pt")


def track_lines(points: DataFrame, by: str, ts: str, piece: str | None = None) -> DataFrame:
    """Line per key through its points in time order; ``piece`` (say '1 day') cuts long tracks by time."""
    if piece is None:
        return make_lines(points, [by], [ts])
    cut = points.withColumn("piece", F.window(ts, piece)["start"])
    return make_lines(cut, [by, "piece"], [ts])
