"""Rasters in tile form: no block leaves its task but where it must, and odd tilings give what one tile gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import raster as R, tiles as T


def tiles(spark, a, cuts_x, cuts_y, flat=True):
    """A raster (bands, height, width) cut at uneven places."""
    rows, rid = [], 0
    for r0, r1 in zip(cuts_y, cuts_y[1:]):
        for c0, c1 in zip(cuts_x, cuts_x[1:]):
            b = a[:, r0:r1, c0:c1]
            rows.append((rid, c0, r0, c1 - c0, r1 - r0, [[None if np.isnan(v) else float(v) for v in band.ravel()] for band in b]))
            rid += 1
    return T.stamp(spark.createDataFrame(rows, T.TILES).repartition(5), R.Grid(0.0, float(a.shape[1]), 1.0, -1.0, a.shape[2], a.shape[1], 3857), flat)


def array(t, shape):
    out = np.full(shape, np.nan)
    seen = 0
    for p in T.to_pixels(t).collect():
        out[p.band - 1, p.row, p.col] = np.nan if p.value is None else p.value
        seen += 1
    assert seen == out.size       # every place once
    return out


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(2)
    a = rng.random((2, 41, 53)) * 100
    a[0][rng.random((41, 53)) < 0.2] = np.nan
    return a


@pytest.fixture(scope="module")
def uneven(spark, raster):
    return tiles(spark, raster, [0, 1, 3, 20, 21, 40, 53], [0, 2, 17, 40, 41])


def whole(fn, a, radius):
    return fn(np.pad(a, radius, constant_values=np.nan))


@pytest.mark.parametrize("radius", [1, 3])
@pytest.mark.parametrize("kind", ["mean", "stddev", "distinct", "invdist", "count"])
def test_focal(uneven, raster, kind, radius, monkeypatch):
    monkeypatch.setattr(T, "CELL", 16)
    got = array(T.focal(uneven, kind, radius, 1), (1, 41, 53))[0]
    np.testing.assert_allclose(got, whole(T.focal_function(kind, radius), raster[0], radius), rtol=1e-12)


def test_terrain_and_retile(uneven, raster):
    got = array(T.terrain(uneven, "slope", 2), (1, 41, 53))[0]
    np.testing.assert_allclose(got, whole(T.terrain_function("slope", 1, -1, 315, 45, 1), raster[1], 1), rtol=1e-12)
    np.testing.assert_array_equal(array(T.retile(uneven, 10, 7), raster.shape), raster)
    one = T.whole_tiles(T.focal(uneven, "max", 1, 2))
    assert one.count() == uneven.count()


def test_neighbourhoods_shuffle_strips_only(spark):
    """A slope over four tiles of 400 x 400: what crosses the shuffle is the strips along the borders."""
    a = np.random.default_rng(1).random((1, 800, 800))
    t = tiles(spark, a, [0, 400, 800], [0, 400, 800])
    out = T.terrain(t, "slope")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ti") == 1 and "hashpartitioning(rid" not in plan
    rings = 4 * (4 * 400 * 2)                       # values in strips two pixels wide
    sent = sum((w * h) for b in [T._frame(0, 0, 400, 400, 2)] for _, _, w, h in b) * 4
    assert sent < rings < a.size / 40


def test_algebra_has_no_shuffle_and_no_python(uneven, raster):
    out = T.algebra(uneven, "b1 + 2 * b2", (1, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan.replace("ArrowEval", "Arrow") and "hashpartitioning" not in plan
    np.testing.assert_allclose(array(out, (1, 41, 53))[0], raster[0] + 2 * raster[1])


def test_overlaps(spark, raster):
    t = tiles(spark, raster, [0, 30, 53], [0, 41], flat=False)
    over = spark.createDataFrame([(99, 25, 10, 10, 5, [[None if i % 2 else 7.0 for i in range(50)], [8.0] * 50])], T.TILES)
    both = T.stamp(t.select(*T.NAMES).unionByName(over), T.grid_of(t))
    assert R.has_overlap(both) and not R.has_overlap(t)
    want = raster.copy()
    v = want[0, 10:15, 25:35].ravel()
    v[::2] = 7.0
    want[0, 10:15, 25:35] = v.reshape(5, 10)
    want[1, 10:15, 25:35] = 8.0
    np.testing.assert_array_equal(array(R.mosaic(both), raster.shape), want)


def test_covered():
    square = np.array([(1, 1), (4, 1), (4, 3), (1, 3), (1, 1)], float)
    xs, ys = np.arange(6.0), np.arange(5.0)
    assert T.covered([square], xs, ys).sum() == 12                      # borders count
    hole = np.array([(1.5, 1.5), (1.5, 2.5), (3.5, 2.5), (3.5, 1.5), (1.5, 1.5)])
    assert T.covered([square, hole], xs, ys).sum() == 10
    tri = np.array([(0, 0), (4, 0), (2, 4), (0, 0)], float)
    assert T.covered([tri], xs, ys).tolist()[4] == [False, False, True, False, False, False]


def test_burn_takes_the_highest_order(spark):
    from tests.test_operators import wkt_layer
    d = wkt_layer(spark, [(1, "POLYGON((0 0,10 0,10 10,0 10,0 0))"), (2, "POLYGON((2 2,5 2,5 5,2 5,2 2))"), (3, "POLYGON((4 4,6 4,5 6,4 4))")])
    g = R.Grid(0.0, 10.0, 1.0, -1.0, 10, 10, None)
    t = R.burn(d.withColumn("v", F.col("id") * 10), g, "v", "id", tiles=True)
    a = array(t, (1, 10, 10))[0]
    assert (a == 10).sum() + (a == 20).sum() + (a == 30).sum() == 100 and (a == 20).sum() == 8 and a[5, 4] == 30 or a[5, 5] == 30


def test_empty(spark, uneven):
    none = T.stamp(uneven.where("false"), T.grid_of(uneven), True)
    for out in (R.focal(none, "mean"), R.terrain(none, "slope"), R.resample(none, 2.0, "Cubic"), R.retile(none, 5, 5), R.map_algebra(none, "b1", (1,)), R.overviews(none, (2,))):
        assert out.collect() == []
    assert R.raster_summary(none).first()["count"] == 0
