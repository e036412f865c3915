"""Nearest pixels with data, and smallest circles, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import kernel as K
from cartolith.layer import make_point, with_bbox
from cartolith.operators import aggregate as A, joins as J, raster as R, tiles as T


def slow_circle(xy):
    """Smallest of all circles through two or three points that hold the rest."""
    best = (*xy[0], 0.0) if len(xy) == 1 else None
    for n in (2, 3):
        for on in itertools.combinations(range(len(xy)), n):
            c = K._through([xy[i] for i in on])
            if (np.hypot(xy[:, 0] - c[0], xy[:, 1] - c[1]) <= c[2] * (1 + 1e-9) + 1e-12).all() and (best is None or c[2] < best[2]):
                best = c
    return best


@pytest.mark.parametrize("seed", range(12))
def test_smallest_circle(seed):
    rng = np.random.default_rng(seed)
    xy = rng.integers(0, 6, (rng.integers(1, 14), 2)).astype(float) if seed % 2 else rng.normal(size=(rng.integers(1, 14), 2)) + 1000
    if seed % 4 == 3:
        xy[:, 1] = 2 * xy[:, 0]      # on one line
    got, want = K.smallest_circle(xy), slow_circle(np.unique(xy, axis=0))
    assert got == pytest.approx(want, abs=1e-6)


def test_bounding_circles_of_groups(spark):
    rng = np.random.default_rng(1)
    many = rng.normal(size=(3000, 2))
    rows = [("many", *map(float, p)) for p in many] + [("one", 3.0, 4.0)] * 5 + [("line", float(i), 2.0 * i) for i in range(50)] + [(None, 0.0, 0.0), (None, 2.0, 0.0), ("bare", None, None)]
    d = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    d = with_bbox(d.withColumn("geom", F.when(F.col("x").isNotNull(), make_point("x", "y"))).drop("x", "y"))
    got = {r["k"]: r for r in A.bounding_circles(d, ["k"]).collect()}
    assert (got["many"]["x"], got["many"]["y"], got["many"]["radius"]) == pytest.approx(K.smallest_circle(many))
    assert (got["one"]["x"], got["one"]["y"], got["one"]["radius"], got["one"]["geom"]["gtype"]) == (3, 4, 0, "POINT")
    assert got["line"]["radius"] == pytest.approx(np.hypot(49, 98) / 2)
    assert (got[None]["x"], got[None]["radius"]) == pytest.approx((1, 1))
    assert "bare" not in got or got["bare"]["radius"] is None
    assert A.bounding_circles(d.where("false"), ["k"]).count() == 0


def raster(spark, values, w, split):
    """Pixels of an array, in tiles of ``split`` columns."""
    h = len(values) // w
    rows = [((i % w) // split, 1, i % w, i // w, v) for i, v in enumerate(values)]
    return R.stamp_grid(spark.createDataFrame(rows, "rid long, band int, col int, row int, value double"), R.Grid(0.0, float(h), 1.0, -1.0, w, h))


@pytest.mark.parametrize("share,tiled", [(0.03, True), (0.5, False), (0.97, True)])
def test_fill_nearest_equals_brute_force(spark, share, tiled):
    rng = np.random.default_rng(int(share * 100))
    w, h = 23, 17
    values = [float(i) if rng.random() < share else None for i in range(w * h)]
    r = raster(spark, values, w, 5)
    r = R.to_tiles(r) if tiled else r
    has = [(i % w, i // w) for i, v in enumerate(values) if v is not None]
    want = {(c, q): values[(lambda b: b[1] * w + b[0])(min(has, key=lambda p: ((p[0] - c) ** 2 + (p[1] - q) ** 2, p[1], p[0])))] for c in range(w) for q in range(h)}
    assert {(x["col"], x["row"]): x["value"] for x in R.fill_nearest(r).collect()} == want
    spots = spark.createDataFrame([(-7.5, 3.2), (40.0, 40.0), (11.5, 8.5), (11.5, 8.5), (None, None)], "x double, y double")
    spots = with_bbox(spots.withColumn("geom", F.when(F.col("x").isNotNull(), make_point("x", "y"))))
    got = R.nearest_values(r, spots).select("x", "y", "value").collect()
    assert len(got) == 5 and [g["value"] for g in got if g["x"] is None] == [None]
    for g in got:
        if g["x"] is not None:
            c, q = int(np.floor(g["x"])), int(np.floor(h - g["y"]))
            assert g["value"] == values[(lambda b: b[1] * w + b[0])(min(has, key=lambda p: ((p[0] - c) ** 2 + (p[1] - q) ** 2, p[1], p[0])))]


def test_rims_and_rows_of_values(spark):
    r = R.to_tiles(raster(spark, [float(i) for i in range(48)], 8, 3))
    rim = T.to_pixels(T.rim(r)).where("value IS NOT NULL AND NOT isnan(value)")
    assert {(x["col"], x["row"]) for x in rim.collect()} == {(c, q) for c in range(8) for q in range(6) if c in (0, 7) or q in (0, 5)}
    dumped = {(x["row"], x["col"]): x["values"] for x in R.dump_values(r).collect()}
    assert dumped[2, 3] == [19.0, 20.0, 21.0] and len(dumped) == 18 and dumped[0, 6] == [6.0, 7.0]
    assert [tuple(x) for x in R.pixels_of_value(r, [20.0, 99.0]).collect()] == [(20.0, 4, 2)]


def test_a_raster_without_data(spark):
    r = raster(spark, [None] * 12, 4, 2)
    assert {x["value"] for x in R.fill_nearest(r).collect()} == {None}


@pytest.mark.parametrize("near", [(4, 2), (5, 30), (128, 32)])
def test_fill_nearest_over_wide_gaps(spark, monkeypatch, near):
    """Gaps wider than the windows, windows wider than the raster, and ties between rows and columns."""
    monkeypatch.setattr(T, "NEAR", near)
    w, h = 37, 11
    values = [float(i) if (i % w < 3 or i % w > 34) and i % 4 else float("nan") if i % 5 == 0 else None for i in range(w * h)]
    has = [(i % w, i // w) for i, v in enumerate(values) if v is not None and v == v]
    want = {(c, q): values[(lambda b: b[1] * w + b[0])(min(has, key=lambda p: ((p[0] - c) ** 2 + (p[1] - q) ** 2, p[1], p[0])))] for c in range(w) for q in range(h)}
    got = R.fill_nearest(raster(spark, values, w, 10)).collect()
    assert len(got) == w * h and {(x["col"], x["row"]): x["value"] for x in got} == want


def test_nearest_search_sends_nothing_to_the_driver_by_an_estimate(spark, monkeypatch, capsys):
    """Files that look small hold many rows: only sides that were measured are broadcast, and here none is."""
    monkeypatch.setattr("cartolith.plans.grid.BROADCAST_BYTES", -1)
    r = raster(spark, [float(i) if i % 3 else None for i in range(600)], 30, 7)
    p = with_bbox(spark.range(50).select("id", make_point(F.col("id") * 7.0 % 31, F.col("id") * 3.0 % 17).alias("geom")))
    for df in (R.fill_nearest(r), R.nearest_values(r, p), J.knn_join(p, p, 2, "id", "id")):
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out
