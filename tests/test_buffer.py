"""Buffers of many lines: plan, results of mixed batches, areas in batches."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cartolith.functions import exact as X, native as N
from cartolith.layer import GEOM, set_srid, with_bbox
from cartolith.operators import transform as TR
from cartolith.suite import vectors

POLY32 = 16 * math.sin(math.pi / 16)


def wkt(spark, rows):
    df = spark.createDataFrame(rows, "id long, w string")
    return set_srid(with_bbox(df.withColumn("geom", N.from_wkt(F.col("w"))).drop("w")), 3857)


def test_routes_are_spread_before_they_are_lines(spark, tmp_path):
    spark.createDataFrame([(k, 100 + k) for k in range(1, 6)] + [(6, None), (None, 7)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    items = [(k, line, k + line) for k in range(1, 7) for line in (1, 2)] + [(1, 1, 2), (None, 1, 3), (2, 3, None)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = vectors.buffer_lines(spark, str(tmp_path))
    rows = [(r.order_id, r.line_no, r.area) for r in df.collect()]
    at = lambda k, a, b: (k * a % b) / (b / 100)
    want = [(k, line, None if s is None or k == 6 else round(2 * math.hypot(at(100 + k, 7919, 10007) - at(s, 7919, 10007), at(100 + k, 104729, 10009) - at(s, 15485863, 10009)) + POLY32, 5))
            for k, line, s in items if k is not None]
    assert sorted(rows, key=str) == sorted(want, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert "site_id" in moved and "gtype" not in moved                       # keys are moved, not geometries
    assert not re.search("ATAN2", plan) and plan.count("ArrowEvalPython") == 1   # no corner is an expression read anew for each, and area takes buffers as they are made


def test_mixed_batch_of_buffers(spark):
    rows = [(1, "LINESTRING(0 0,3 4)"), (2, "LINESTRING(0 0,10 0,10 10)"), (3, "LINESTRING(5 5,5 5)"), (4, None), (5, "POINT(1 1)"), (6, "POLYGON((0 0,2 0,2 1,0 1,0 0))"),
            (7, "LINESTRING EMPTY"), (8, "MULTILINESTRING((0 0,1 0),(5 5,6 5))"), (9, "LINESTRING(7 7,7 -7)"), (10, "POLYGON((0 0,4 0,0 3,0 0))")]
    b = TR.buffer(wkt(spark, rows), 1.0).coalesce(1)
    got = {r.id: (r.geom, r.a) for r in b.select("id", "geom", N.area(F.col("geom")).alias("a")).collect()}
    want = {1: 10 + POLY32, 3: POLY32, 5: POLY32, 6: 2 + 6 + POLY32, 7: 0.0, 9: 28 + POLY32}
    assert {k: got[k][1] for k in want} == pytest.approx(want)
    assert got[4] == (None, None) and got[8][1] == pytest.approx(4 + 2 * POLY32) and len(got[8][0].parts) == 2
    assert 40 < got[2][1] < 40 + POLY32 and 6 + 12 < got[10][1] <= 6 + 12 + math.pi
    ring = got[1][0].parts[0][0]
    assert got[1][0].gtype == "POLYGON" and len(ring) == 35 and ring[0] == ring[-1]
    assert (ring[0].x, ring[0].y) == pytest.approx((3 + 4 / 5, 4 - 3 / 5))   # from the right side of the far end, counter-clockwise
    shrunk = TR.buffer(wkt(spark, rows[:1]), -1.0).select(N.is_empty(F.col("geom"))).first()[0]
    assert shrunk
    assert TR.buffer(wkt(spark, [(1, None), (2, None)]), 1.0).where("geom IS NULL").count() == 2


def test_lines_with_null_coordinates(spark):
    lines = ["array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', CAST(NULL AS DOUBLE), 'y', 1D))))", "array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D))))"]
    df = spark.range(2).withColumn("geom", F.expr(f"named_struct('gtype', 'LINESTRING', 'parts', CASE WHEN id = 0 THEN {lines[0]} ELSE {lines[1]} END)").cast(GEOM)).coalesce(1)
    b = df.select("id", X.buffer(F.col("geom"), 1.0).alias("geom"))
    rows = {r.id: (r.v, r.a, r.n) for r in b.select("id", N.vertices(F.col("geom"))[0].alias("v"), X.area(F.col("geom")).alias("a"), N.area(F.col("geom")).alias("n")).collect()}
    assert tuple(rows[0][0]) == (None, None) and rows[0][1:] == (None, None)
    assert rows[1][1] == rows[1][2] == pytest.approx(10 + POLY32)


def test_area_in_batches_is_the_native_one(spark):
    rows = [(1, "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4),(1 1,1 2,2 2,1 1))"), (2, "MULTIPOLYGON(((20 0,22 0,22 2,20 2,20 0)),((30.1 0,33 0.7,33 3,30 3,30.1 0),(31 1,32 1,32 2,31 1)))"),
            (3, "POLYGON EMPTY"), (4, None), (5, "LINESTRING(0 0,1 1,2 0,0 0)"), (6, "POINT(1 1)"), (7, "POLYGON((1000000.1 3,1000000.7 3.3,1000000.2 9.9,1000000.1 3))")]
    d = wkt(spark, rows).coalesce(1)
    holed = "CASE WHEN id % 3 = 0 THEN CAST(NULL AS array<array<array<struct<x:double,y:double>>>>) WHEN id % 3 = 1 THEN array(CAST(NULL AS array<array<struct<x:double,y:double>>>)) ELSE array(array(array(named_struct('x', 1D, 'y', 2D), named_struct('x', CAST(NULL AS DOUBLE), 'y', 2D)), CAST(array() AS array<struct<x:double,y:double>>))) END"
    odd = spark.range(10, 16).select("id", F.expr(f"named_struct('gtype', CASE WHEN id < 13 THEN 'POLYGON' ELSE 'LINESTRING' END, 'parts', {holed})").cast(GEOM).alias("geom"))
    for layer in (d.select("id", "geom"), odd.coalesce(1), d.select("id", "geom").unionByName(odd).coalesce(1), d.where("id IN (3, 4)").select("id", "geom")):
        got = layer.select("id", X.area(F.col("geom")).alias("a"), N.area(F.col("geom")).alias("n")).collect()
        assert [r.a for r in got] == [r.n for r in got]
