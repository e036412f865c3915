"""Visits as a stream in several batches: late points join visits, and each visit is told once."""

import datetime as dt

from pyspark.sql import functions as F

from cartolith.layer import as_layer, make_box
from cartolith.streaming import geofence as G

DAY = dt.datetime(2024, 1, 1)


def test_late_points_bridge_visits(spark, tmp_path):
    zones = as_layer(spark.createDataFrame([(1, 0.0), (2, 10.0)], "zone_id int, x0 double"), make_box(F.col("x0"), F.lit(0.0), F.col("x0") + 10, F.lit(10.0))).select("zone_id", "geom", "bbox")
    schema = "user long, x double, y double, ts timestamp"
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[(1, 5.0, 5.0, at(0)), (1, 5.0, 5.0, at(3)), (2, 15.0, 5.0, at(0))],
               [(1, 5.0, 5.0, at(1.5)), (1, 50.0, 5.0, at(4))],                        # 1.5 bridges 0 and 3, which are 3 hours apart
               [(1, 15.0, 5.0, at(10)), (1, 5.0, 5.0, at(10))],
               [(3, 5.0, 5.0, at(60))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "b=*"))
        v = G.visit_events(stream, zones, "zone_id", "user", "ts", "2 hours", late="4 hours")
        v.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["user"], r["zone_id"], r["event"], (r["at"] - DAY).total_seconds() / 3600, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, "enter", 0, 3), (1, 1, "enter", 10, 1), (1, 1, "leave", 3, 3), (1, 1, "leave", 10, 1), (1, 2, "enter", 10, 1), (1, 2, "leave", 10, 1), (2, 2, "enter", 0, 1), (2, 2, "leave", 0, 1)]
