"""Triangles and concave hulls: tiles and rounds give what one task gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import native as N
from cartolith.functions.delaunay import delaunay, in_circle, turn
from cartolith.layer import make_point, with_bbox
from cartolith.operators import aggregate as A, hulls as H


def layer(spark, rows, names="k string, x double, y double"):
    return with_bbox(spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], names).withColumn("geom", make_point("x", "y")).drop("x", "y"))


def shapes(tri, *by):
    v = F.sort_array(F.slice(F.col("geom")["parts"][0][0], 1, 3))
    return sorted((*(r[c] for c in by), tuple(map(tuple, r["v"]))) for r in tri.select(*by, v.alias("v")).collect())


@pytest.mark.parametrize("kind", ["random", "grid", "circle", "lines"])
def test_delaunay(kind):
    rng = np.random.default_rng(3)
    p = {"random": rng.random((150, 2)), "grid": np.array([(x, y) for x in range(12) for y in range(9)], float), "circle": np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 6, 70)]),
         "lines": np.array([(x, y) for x in range(40) for y in (0, 1)], float)}[kind]
    t = delaunay(p)
    q = [tuple(map(float, v)) for v in p]
    e = {(a, b) for a, b in H.directed(t).tolist()}
    assert len(e) == 3 * len(t) == 3 * (2 * len(p) - len([x for x in e if x[::-1] not in e]) - 2)
    assert all(turn(q[a], q[b], q[c]) > 0 and all(in_circle(q[a], q[b], q[c], q[d]) < 0 for d in range(len(q)) if d not in (a, b, c)) for a, b, c in t.tolist())
    assert len(delaunay(np.array([(i, 3 * i) for i in range(20)], float))) == 0


def points():
    rng = np.random.default_rng(5)
    dense = 0.3 + 0.01 * rng.random((300, 2))                                   # a third of a group in one spot
    rows = [("a", *v) for v in np.concatenate([rng.random((600, 2)), dense])] + [(None, x, y) for x in range(20) for y in range(17)]
    return rows + [("flat", i / 7, i / 7) for i in range(90)] + [("one", 1, 1)] * 3 + [("two", 0, 0), ("two", 1, 0)]


def test_tiles_give_the_same_triangles(spark, monkeypatch):
    df = layer(spark, points())
    whole = shapes(H.delaunay_triangles(df, ["k"]).where("k IS NOT NULL"), "k") + shapes(H.delaunay_triangles(df, ["k"]).where("k IS NULL"))
    monkeypatch.setattr(H, "POINTS", 64)
    tri = H.delaunay_triangles(df, ["k"])
    assert shapes(tri.where("k IS NOT NULL"), "k") + shapes(tri.where("k IS NULL")) == whole
    assert {r["k"]: r["n"] for r in tri.groupBy("k").agg(F.sum("outer").alias("n")).collect()}[None] == 2 * (19 + 16)


def hulls(df, ratio, holes):
    return {r["k"]: (r["type"], r["area"]) for r in H.polygon_from_points(df, ratio, holes, ["k"]).select("k", F.col("geom")["gtype"].alias("type"), N.area(F.col("geom")).alias("area")).collect()}


@pytest.mark.parametrize("holes", [False, True])
def test_rounds_keep_the_promises(spark, monkeypatch, holes):
    df = layer(spark, points())
    small = hulls(df, 0.15, holes)
    monkeypatch.setattr(H, "POINTS", 64)
    monkeypatch.setattr(H, "TRIANGLES", 150)
    large = hulls(df, 0.15, holes)
    assert large.keys() == small.keys() and {k: v[0] for k, v in large.items() if k not in ("a", None)} == {k: v[0] for k, v in small.items() if k not in ("a", None)} == {"flat": "LINESTRING", "one": "POINT", "two": "LINESTRING"}
    convex = {r["k"]: r["area"] for r in A.convex_hull(df, ["k"]).select("k", N.area(F.col("geom")).alias("area")).collect()}
    if not holes:      # a grid has diagonals to open
        assert large[None][1] == small[None][1] == 19 * 16
    assert 0.3 < large["a"][1] < convex["a"] and abs(large["a"][1] - small["a"][1]) < 0.15
    hull = H.polygon_from_points(df, 0.15, holes, ["k"]).where("k = 'a'").select(F.col("geom").alias("hull"))
    far = df.where("k = 'a'").join(hull).agg(F.max(N.point_to_geometry(F.col("hull"), F.col("bbox.xmin"), F.col("bbox.ymin"))).alias("d")).first()["d"]
    assert far < 1e-9


def test_a_notch_is_eroded_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "POINTS", 100)
    monkeypatch.setattr(H, "TRIANGLES", 120)
    df = layer(spark, [("c", x, y) for x in range(30) for y in range(24) if not (x >= 8 and 7 <= y < 17)])
    cells = sum(1 for x in range(29) for y in range(23) if not (x + 1 >= 8 and 6 <= y < 17))
    assert hulls(df, 0.01, False)["c"] == ("POLYGON", cells)


def test_refusals(spark):
    df = layer(spark, [("a", 0, 0)])
    with pytest.raises(ValueError):
        H.polygon_from_points(df, 1.5)
    with pytest.raises(ValueError):
        H.polygon_from_points(df.withColumn("geom", F.struct(F.lit("POLYGON").alias("gtype"), F.col("geom")["parts"].alias("parts"))), 0.5)
    assert H.polygon_from_points(df.where("false"), 0.5, by=["k"]).collect() == []


def test_straight_sides_stay_behind():
    """A tile in the middle of a long grid hands on what lies at its open ends only."""
    p = np.array([(x, y) for x in range(5) for y in range(40)], float)
    tri, on, ground, rim = H.tile_triangles(p, np.empty((0, 4)), (-1.0, -0.5, 41.0, 39.5), (0.0, -100.0, 4.0, 100.0))
    assert len(tri) and len(on) < 40 and {v for v in on[:, 1] if 10 < v < 30} == set()
    assert {(a, c) for a, _, c, _ in rim.tolist()} == {(0.0, 0.0), (4.0, 4.0)}


def test_only_long_triangles_are_eroded(spark, monkeypatch):
    notch = [("g", x, y) for x in range(30) for y in range(30) if not (x > 8 and 10 <= y < 20)]
    monkeypatch.setattr(H, "POINTS", 64)
    seen, eroded = [], H._eroded
    monkeypatch.setattr(H, "_eroded", lambda tri, holes: seen.append(tri.count()) or eroded(tri, holes))
    assert [r["a"] for r in H.polygon_from_points(layer(spark, notch), 0.05, False, ["k"]).select(N.area(F.col("geom")).alias("a")).collect()] == [29 * 29 - 21 * 11 + 1]   # half a cell stays in each corner of the notch
    assert 0 < seen[0] < 100
