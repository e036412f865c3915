"""Readers and table moves that the query suite does not reach."""

import pytest
from pyspark.sql import functions as F

from cartolith.functions import exact as X, native as N
from cartolith.operators import raster as R
from cartolith.sources import raster as SR, tables as ST, vector as SV
from tests.test_operators import wkt_layer


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    r = SR.read_ascii_grid(spark, str(tmp_path / "g.asc"), 3857)
    assert R.grid_of(r) == R.Grid(10.0, 24.0, 2.0, -2.0, 3, 2, 3857)
    assert {(p.col, p.row): p.value for p in r.collect()} == {(0, 0): 1.0, (1, 0): 2.0, (2, 0): 3.0, (0, 1): 4.0, (1, 1): None, (2, 1): 6.0}


def test_import_and_move(spark):
    d = wkt_layer(spark, [(1, "POINT(0 0)"), (2, "POINT(1 1)")], srid=4326)
    spark.sql("DROP TABLE IF EXISTS imported")
    name = SV.import_layer(d, "imported", target_srid=3857, where="id = 2", comment="it's a test")
    row = spark.table(name).first()
    assert row.old_id == 2 and row.geom["parts"][0][0][0]["x"] == pytest.approx(111319.49, abs=0.01)
    spark.sql("CREATE DATABASE IF NOT EXISTS other_db")
    spark.sql("DROP TABLE IF EXISTS other_db.imported")
    moved = ST.move_table(spark, name, "other_db")
    assert spark.table(moved).count() == 1 and not spark.catalog.tableExists("default.imported")
    spark.sql(f"DROP TABLE {moved}")
    with pytest.raises(ValueError, match="shp"):
        SV.read_layer(spark, "x", "shp")


def test_geojson_collection(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"a":1,"b":"x"}},'
                                     '{"type":"Feature","geometry":null,"properties":{"a":2,"b":null}}]}')
    d = SV.spread_properties(SV.read_layer(spark, str(tmp_path / "c.json"), "geojson"), {"a": "int", "b": "string"})
    got = {r.a: (r.b, r.s) for r in d.select("a", "b", N.area(F.col("geom")).alias("s")).collect()}
    assert got == {1: ("x", 0.5), 2: (None, None)}


def test_exact_measures(spark):
    p = wkt_layer(spark, [(1, "POLYGON((0 0,1 0,1 1,0 1,0 0))")]).crossJoin(wkt_layer(spark, [(1, "LINESTRING(3 0,3 1)")]).select(F.col("geom").alias("h")))
    g, h = F.col("geom"), F.col("h")
    r = p.select(X.hausdorff_distance(g, h).alias("hd"), N.length(X.shortest_line(g, h)).alias("sl"), N.point_x(X.closest_point(g, h)).alias("cx"),
                 N.area(X.sym_difference(g, g)).alias("sd"), N.area(X.convex_hull(g)).alias("ch")).first()
    assert (r.hd, r.sl, r.cx, r.sd, r.ch) == (pytest.approx(3.0), pytest.approx(2.0), pytest.approx(1.0), 0.0, pytest.approx(1.0))
