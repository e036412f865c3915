"""Queries over history tables, files, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import native as N
from ..layer import srid_of
from ..operators import history as H
from ..operators.aggregate import checkpoint_dir
from ..sources import vector as SV
from ..sources.history_store import HistoryStore
from ..streaming import geofence as G
from .registry import query

_HISTORY = """, d AS (SELECT *, last_value(CASE WHEN op <> 'U' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM changes),
    live AS (SELECT * FROM d WHERE op = 'I' OR state = 'I'),
    v AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS valid_to FROM live),
    h AS (SELECT key, priority, total, ts AS valid_from, valid_to FROM v WHERE op <> 'D') """


def _history(spark, sf):
    log = fx.changes(spark, sf)
    empty = log.where(F.lit(False)).select("key", "priority", "total")
    return H.apply_changes(H.init_history(empty, "key"), log, "key", seq=["seq"], user="loader")


def _secs(c):
    return F.floor(F.unix_micros(F.col(c)) / 1_000_000)


@query("history_init", "SELECT c_custkey, c_name, true AS open, NULL::VARCHAR AS changed_by FROM customer")
def history_init(spark, sf):
    h = H.init_history(fx.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return h.select("c_custkey", "c_name", F.col("valid_to").isNull().alias("open"), "changed_by")


@query("history_versions", _HISTORY + "SELECT key, priority, total, epoch(valid_from)::BIGINT AS f, epoch(valid_to)::BIGINT AS t FROM h", "changes")
def history_versions(spark, sf):
    return _history(spark, sf).select("key", "priority", "total", _secs("valid_from").alias("f"), _secs("valid_to").alias("t"))


@query("history_current", _HISTORY + "SELECT key, total FROM h WHERE valid_to IS NULL", "changes")
def history_current(spark, sf):
    return H.current(_history(spark, sf)).select("key", "total")


@query("history_at_time", _HISTORY + "SELECT key, total FROM h WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-01')", "changes")
def history_at_time(spark, sf):
    return H.at_time(_history(spark, sf), "1996-06-01 00:00:00").select("key", "total")


@query("history_two_batches", _HISTORY + "SELECT key, priority, total, epoch(valid_from)::BIGINT AS f, epoch(valid_to)::BIGINT AS t FROM h", "changes")
def history_two_batches(spark, sf):
    """The change log in two batches gives the same table as in one."""
    log = fx.changes(spark, sf)
    empty = log.where(F.lit(False)).select("key", "priority", "total")
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp")
    first = H.apply_changes(H.init_history(empty, "key"), log.where(F.col("ts") < cut), "key", seq=["seq"])
    second = H.apply_changes(first, log.where(F.col("ts") >= cut), "key", seq=["seq"])
    return second.select("key", "priority", "total", _secs("valid_from").alias("f"), _secs("valid_to").alias("t"))


@query("history_changes_between", _HISTORY + """, a AS (SELECT key, valid_from FROM h WHERE valid_from <= TIMESTAMP '1995-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-01-01')),
    b AS (SELECT key, valid_from FROM h WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01'))
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'inserted' WHEN b.key IS NULL THEN 'deleted' ELSE 'updated' END AS change
    FROM a FULL JOIN b ON a.key = b.key WHERE a.valid_from IS DISTINCT FROM b.valid_from""", "changes")
def history_changes_between(spark, sf):
    return H.changes_between(_history(spark, sf), "1995-01-01 00:00:00", "1997-01-01 00:00:00", "key")


@query("history_changes_null_keys", _HISTORY + """, n AS (SELECT nullif(key, 7) AS key, valid_from, valid_to FROM h), a AS (SELECT key, valid_from FROM n WHERE valid_from <= TIMESTAMP '1995-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-01-01')),
    b AS (SELECT key, valid_from FROM n WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01'))
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.valid_from IS NULL THEN 'inserted' WHEN b.valid_from IS NULL THEN 'deleted' ELSE 'updated' END AS change
    FROM a FULL JOIN b ON a.key IS NOT DISTINCT FROM b.key WHERE a.valid_from IS DISTINCT FROM b.valid_from""", "changes")
def history_changes_null_keys(spark, sf):
    """One customer's key is NULL."""
    h = _history(spark, sf)
    return H.changes_between(h.withColumn("key", F.when(F.col("key") != 7, F.col("key"))), "1995-01-01 00:00:00", "1997-01-01 00:00:00", "key")


# ---------------------------------------------------------------- files

def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _trip(fmt, **read):
    def run(spark, sf):
        path = _folder(spark, "layer-" + fmt)
        SV.export_layer(fx.parcels(spark, sf).select("parcel_id", "p_brand", "geom", *(["bbox"] if fmt in ("parquet", "orc") else [])), path, fmt)
        back = SV.read_layer(spark, path, fmt, srid=fx.SRID, **read)
        if fmt == "geojsonl":
            back = SV.spread_properties(back, {"parcel_id": "long", "p_brand": "string"})
        return back.select(F.col("parcel_id").cast("long"), "p_brand", F.round(N.area(F.col("geom")), 6).alias("area"), F.lit(srid_of(back)).alias("srid"))

    return run


_TRIP_SQL = "SELECT parcel_id, p_brand, round((xmax - xmin) * (ymax - ymin), 6) AS area, 3857 AS srid FROM parcels"
for _fmt, _read in {"parquet": {}, "orc": {}, "csv": {"geom": "geom", "header": True}, "json": {"geom": "geom"}, "geojsonl": {}}.items():
    query("file_" + _fmt, _TRIP_SQL, "parcels")(_trip(_fmt, **_read))


@query("normalized_layer", "SELECT c_custkey AS old_id, c_name AS name, 'POINT' AS gtype FROM customer")
def normalized_layer(spark, sf):
    """Import options on a layer with an ID column and mixed-case names."""
    s = fx.sites(spark, sf).join(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), "c_name"), "site_id")
    raw = s.select(F.col("site_id").alias("ID"), F.col("c_name").alias("Name"), F.col("geom").alias("Shape"))
    n = SV.normalize_layer(raw, "Shape", force_singlepart=True)
    return n.select("old_id", "name", F.col("geom")["gtype"].alias("gtype"))


@query("stamped_geometry_column", "SELECT s_suppkey, x, y, 4326 AS srid FROM (SELECT s_suppkey, s_suppkey % 90 + 0.5::DOUBLE AS x, s_suppkey % 45 + 0.25::DOUBLE AS y FROM supplier)")
def stamped_geometry_column(spark, sf):
    from ..layer import add_geometry_column
    d = fx.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 + 0.5).alias("x"), (F.col("s_suppkey") % 45 + 0.25).alias("y"))
    d = add_geometry_column(d, "shape", "POINT", 4326, "x", "y")
    return d.select("s_suppkey", N.point_x(F.col("shape")).alias("x"), N.point_y(F.col("shape")).alias("y"), F.lit(srid_of(d, "shape")).alias("srid"))


# ---------------------------------------------------------------- streams

def _event_stream(spark, sf):
    """The event table as a stream of files."""
    schema = fx.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.expr("CAST((event_id * 37L) % 101L AS DOUBLE)").alias("x"), F.expr("CAST((event_id * 53L) % 103L AS DOUBLE)").alias("y"))


def _drain(stream, spark, name, mode="append"):
    """Run a stream over all that is there, into a folder, and read it back."""
    path = _folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", path + "/data").option("checkpointLocation", path + "/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/data")


@query("stream_geofence", "SELECT event_id, zone_id FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax", "track_points zones")
def stream_geofence(spark, sf):
    return _drain(G.geofence(_event_stream(spark, sf), fx.zones(spark, sf), "zone_id").select("event_id", "zone_id"), spark, "geofence")


@query("zone_windows", "SELECT zone_id, epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 2) AS total FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1, 2", "track_points zones")
def zone_windows(spark, sf):
    """Daily counts per zone (the batch form of the stream)."""
    e = fx.track_points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    c = G.zone_counts(e, fx.zones(spark, sf), "zone_id", "ts", "1 day", value="value")
    return c.select("zone_id", _secs("start").alias("start"), "n", F.round("total", 2).alias("total"))


@query("zone_sliding_windows", """SELECT zone_id, s AS start, count(*) AS n FROM (SELECT zone_id, unnest([epoch(date_trunc('hour', ts))::BIGINT, epoch(date_trunc('hour', ts))::BIGINT - 3600]) AS s FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) GROUP BY 1, 2""", "track_points zones")
def zone_sliding_windows(spark, sf):
    """Two-hour windows that start every hour."""
    e = fx.track_points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return G.zone_counts(e, fx.zones(spark, sf), "zone_id", "ts", "2 hours", "1 hour").select("zone_id", _secs("start").alias("start"), "n")


@query("zone_visits", """, e AS (SELECT user_id, zone_id, ts, lag(ts) OVER (PARTITION BY user_id, zone_id ORDER BY ts) AS p FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, zone_id ORDER BY ts) AS k FROM e) SELECT user_id, zone_id, count(*) AS n FROM s GROUP BY user_id, zone_id, k""", "track_points zones")
def zone_visits(spark, sf):
    """Visits of a user to a zone with gaps under six hours."""
    e = fx.track_points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return G.zone_sessions(e, fx.zones(spark, sf), "zone_id", "user_id", "ts", "6 hours").select("user_id", "zone_id", "n")


@query("stream_zone_windows", """SELECT zone_id, date_trunc('day', ts) AS start, count(*) AS n FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax
    AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM track_points) GROUP BY 1, 2""", "track_points zones")
def stream_zone_windows(spark, sf):
    """Daily counts per zone from the stream, closed by the watermark."""
    c = G.zone_counts(_event_stream(spark, sf), fx.zones(spark, sf), "zone_id", "ts", "1 day", late="1 hour")
    return _drain(c.select("zone_id", "start", "n"), spark, "zone-windows")


@query("stream_history", _HISTORY + "SELECT key, total FROM h WHERE valid_to IS NULL", "changes")
def stream_history(spark, sf):
    """The change log as a stream into a history table; current rows."""
    path = _folder(spark, "history")
    fx.changes(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path + "/log")
    log = spark.read.parquet(path + "/log")
    empty = H.init_history(log.where(F.lit(False)).select("key", "priority", "total"), "key")
    stream = spark.readStream.schema(log.schema).parquet(path + "/log")
    q = stream.writeStream.foreachBatch(G.history_sink(path + "/table", empty, "key", ["seq"])).option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return HistoryStore(spark, path + "/table", empty, "key").open_versions().select("key", "total")


@query("history_many_batches", _HISTORY + "SELECT key, priority, total, valid_from::DATE AS since, valid_to::DATE AS until, 1 AS repeated FROM h", "changes")
def history_many_batches(spark, sf):
    """The change log in five batches by year, one of them sent twice, into a table in buckets; every version."""
    log = fx.changes(spark, sf).withColumn("batch", F.least(F.greatest(F.year("ts") - 1993, F.lit(0)), F.lit(4)))
    path = _folder(spark, "store")
    log.write.partitionBy("batch").parquet(path + "/log")
    log = spark.read.parquet(path + "/log")
    empty = H.init_history(log.where(F.lit(False)).select("key", "priority", "total"), "key")
    store = HistoryStore(spark, path + "/table", empty, "key", ["seq"], "loader", buckets=8)
    done = [store.apply(log.where(F.col("batch") == i).drop("batch"), i) for i in (0, 1, 2, 2, 3, 4)]
    store.vacuum()
    return store.read().select("key", "priority", "total", F.to_date("valid_from").alias("since"), F.to_date("valid_to").alias("until"), F.lit(done.count(False)).alias("repeated"))


_VISITS = """, e AS (SELECT user_id, zone_id, ts, lag(ts) OVER (PARTITION BY user_id, zone_id ORDER BY ts) AS p FROM track_points, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, zone_id ORDER BY ts) AS k FROM e),
    v AS (SELECT user_id, zone_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, zone_id, k),
    closed AS (SELECT * FROM v WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM track_points)) """


@query("stream_zone_visits", _VISITS + "SELECT user_id, zone_id, first AS start, n FROM closed", "track_points zones")
def stream_zone_visits(spark, sf):
    """Visits as a stream: those that the watermark has closed."""
    v = G.zone_sessions(_event_stream(spark, sf), fx.zones(spark, sf), "zone_id", "user_id", "ts", "6 hours", late="1 hour")
    return _drain(v.select("user_id", "zone_id", "start", "n"), spark, "zone-visits")


@query("stream_visit_events", _VISITS + "SELECT user_id, zone_id, 'enter' AS event, first AS at, n FROM closed UNION ALL SELECT user_id, zone_id, 'leave', last, n FROM closed", "track_points zones")
def stream_visit_events(spark, sf):
    """Entering and leaving, told when a visit is closed."""
    v = G.visit_events(_event_stream(spark, sf), fx.zones(spark, sf), "zone_id", "user_id", "ts", "6 hours", late="1 hour")
    return _drain(v, spark, "visit-events")
