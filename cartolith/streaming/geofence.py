"""Streams of points against a static zone layer, and change streams into history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import native as N
from ..layer import ensure_bbox
from ..plans.grid import BROADCAST_BYTES, cell_array, own_level, row_bytes
from ..sources.history_store import HistoryStore

STREAM_FLOOR = -20   # level of stream points: finer than any zone


def zone_cells(zones: DataFrame, zone_id: str, cols: list[str] = ()) -> tuple[DataFrame, tuple[int, ...], int]:
    """Cells of the static zones, the levels they use, and their measured bytes (one small job)."""
    z = ensure_bbox(zones).where(F.col("bbox").isNotNull()).select(zone_id, *cols, "geom", "bbox")
    row = z.agg(F.collect_set(own_level(F.col("bbox"), STREAM_FLOOR + 1)).alias("l"), F.sum(row_bytes(z)).alias("b")).first()
    levels = tuple(sorted(row["l"] or ()))
    cells = cell_array(F.col("bbox"), levels, (STREAM_FLOOR,), STREAM_FLOOR + 1, 1)
    out = z.withColumn("_c", F.explode(cells)).select(
        *[F.col(c).alias("zone_" + c if c != zone_id else zone_id) for c in (zone_id, *cols)], F.col("geom").alias("_zone"),
        F.col("bbox").alias("_zbox"), F.col("_c.level").alias("_l"), F.col("_c.cx").alias("_x"), F.col("_c.cy").alias("_y"))
    return out, levels, row["b"] or 0


def geofence(points: DataFrame, zones: DataFrame, zone_id: str, x: Column | str = "x", y: Column | str = "y", cols: list[str] = ()) -> DataFrame:
    """Each point with the zones that cover it (border included); works on streams and tables.

    A point goes to one cell per level of the zones, so the join is an equi-join with a static side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    cells, levels, size = zone_cells(zones, zone_id, cols)
    if size * 9 <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    spots = F.array(*[F.struct(F.lit(l).alias("l"), F.floor(x / 4.0 ** l).alias("cx"), F.floor(y / 4.0 ** l).alias("cy")) for l in levels])
    p = points.withColumns({"_px": x, "_py": y}).withColumn("_s", F.explode(spots))
    j = p.join(cells, (F.col("_s.l") == F.col("_l")) & (F.col("_s.cx") == F.col("_x")) & (F.col("_s.cy") == F.col("_y")))
    b = F.col("_zbox")
    near = (F.col("_px") >= b["xmin"]) & (F.col("_px") <= b["xmax"]) & (F.col("_py") >= b["ymin"]) & (F.col("_py") <= b["ymax"])
    hit = j.where(near & (N.point_location(F.col("_zone"), F.col("_px"), F.col("_py")) >= 0))
    return hit.drop("_s", "_l", "_x", "_y", "_zone", "_zbox", "_px", "_py")


def zone_counts(points: DataFrame, zones: DataFrame, zone_id: str, ts: str, length: str, slide: str | None = None, late: str | None = None,
                x="x", y="y", value: str | None = None) -> DataFrame:
    """Points per zone and time window (tumbling, or sliding with ``slide``); ``late`` sets the watermark."""
    p = points.withWatermark(ts, late) if late else points
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = geofence(p, zones, zone_id, x, y).groupBy(w, zone_id).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), zone_id, *[a for a in ("n", "total") if a in out.columns])


def zone_sessions(points: DataFrame, zones: DataFrame, zone_id: str, key: str, ts: str, gap: str, late: str | None = None, x="x", y="y") -> DataFrame:
    """Visits: events of one key in one zone with gaps shorter than ``gap``."""
    p = points.withWatermark(ts, late) if late else points
    out = geofence(p, zones, zone_id, x, y).groupBy(F.session_window(ts, gap), key, zone_id).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, zone_id, "n")


def visit_events(points: DataFrame, zones: DataFrame, zone_id: str, key: str, ts: str, gap: str, late: str | None = None, x="x", y="y") -> DataFrame:
    """When a key enters and leaves a zone: ``event`` (enter, leave), ``at`` and ``n``, the points of the visit.

    A visit ends when the key is not seen in the zone for ``gap``; ``leave`` carries the last time it was seen.  As a stream (append mode) both events come out
    once the watermark has passed the end of the visit, so points up to ``late`` behind still join or bridge visits; state is one row per open visit."""
    p = points.withWatermark(ts, late) if late else points
    v = geofence(p, zones, zone_id, x, y).groupBy(F.session_window(ts, gap), key, zone_id).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    two = F.array(*[F.struct(F.lit(e).alias("event"), F.col(c).alias("at")) for e, c in (("enter", "first"), ("leave", "last"))])
    return v.select(key, zone_id, "n", F.explode(two).alias("e")).select(key, zone_id, "e.event", "e.at", "n")


def history_sink(path: str, empty: DataFrame, key: str, seq: list[str] = (), user: str | None = None, buckets: int = 64):
    """A foreachBatch function that keeps a history table in buckets under ``path``.

    A batch rewrites the buckets it touches; a repeated batch is recognised, and a failed one leaves the state before it intact."""
    def run(changes: DataFrame, batch: int) -> None:
        HistoryStore(changes.sparkSession, path, empty, key, seq, user, buckets).apply(changes, batch)

    return run
