"""Quantiles by selection of ranks and line work cut where lines meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import native as N
from cartolith.operators import topology as TP
from cartolith.plans import ranks
from tests.test_operators import wkt_layer


@pytest.mark.parametrize("bins,small", [(1024, 4096), (32, 16)])
def test_quantiles(spark, monkeypatch, bins, small):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "SMALL", small)
    rng = np.random.default_rng(8)
    groups = {"a": np.round(rng.normal(size=700), 2), "b": 2.0 ** rng.integers(-40, 40, 200), "tied": np.repeat([1.0, 1.0, 5.0], 60), "one": np.array([3.5]), None: rng.random(50) * 1e300 * np.sign(rng.random(50) - 0.5)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    qs = (0.0, 0.25, 0.3, 0.5, 0.999, 1.0)
    got = {(r.k, r.quantile): r.value for r in ranks.exact_quantiles(df, ["k"], "x", qs).collect()}
    low = {(r.k, r.quantile): r.value for r in ranks.exact_quantiles(df, ["k"], "x", qs, discrete=True).collect()}
    assert got.keys() == low.keys() == {(k, q) for k in groups for q in qs}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(groups[k] / 2, q) * 2, rel=1e-9), (k, q)
        assert low[k, q] == np.quantile(groups[k], q, method="inverted_cdf")
    assert ranks.exact_quantiles(df.where("false"), [], "x", (0.5,)).collect() == []


def noded(spark, *wkt):
    out = TP.node_lines(wkt_layer(spark, list(enumerate(wkt))))
    v = N.vertices(F.col("geom"))
    return sorted((r.a.x, r.a.y, r.b.x, r.b.y) for r in out.select(v[0].alias("a"), v[1].alias("b")).collect())


def test_noding(spark):
    assert noded(spark, "LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)") == [(0, 0, 2, 2), (0, 4, 2, 2), (2, 2, 4, 0), (2, 2, 4, 4)]
    assert noded(spark, "LINESTRING(0 0,4 0)", "LINESTRING(2 0,2 3)") == [(0, 0, 2, 0), (2, 0, 2, 3), (2, 0, 4, 0)]                  # touches
    assert noded(spark, "LINESTRING(0 0,4 0)", "LINESTRING(1 0,6 0)", "LINESTRING(3 0,2 0)") == [(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 3, 0), (3, 0, 4, 0), (4, 0, 6, 0)]   # overlaps
    assert noded(spark, "LINESTRING(0 0,4 0)", "LINESTRING(0 1,4 1)", "LINESTRING(7 7,7 8)") == [(0, 0, 4, 0), (0, 1, 4, 1), (7, 7, 7, 8)]
    star = [f"LINESTRING({np.cos(a)} {np.sin(a)},{-np.cos(a)} {-np.sin(a)})" for a in np.linspace(0.1, 3, 9)]
    spokes = noded(spark, *star)
    assert len(spokes) == 18 and len({s[:2] for s in spokes} & {s[2:] for s in spokes}) == 1                                       # all through one node


def test_polygons_from_crossing_lines(spark):
    lines = ["LINESTRING(-1 0,5 0)", "LINESTRING(-1 4,5 4)", "LINESTRING(0 -1,0 5)", "LINESTRING(4 -1,4 5)", "LINESTRING(0 2,2 2,2 9)", "LINESTRING(9 9,9 12)"]
    p = TP.polygonize(wkt_layer(spark, list(enumerate(lines))), node=True)
    assert sorted(round(r.a, 9) for r in p.select(N.area(F.col("geom")).alias("a")).collect()) == [4.0, 12.0]
    assert TP.polygonize(wkt_layer(spark, [(1, "LINESTRING(0 0,1 1)")]), node=True).collect() == []
