"""SQL names against the column functions and known shapes."""

import pytest
from pyspark.sql import functions as F

from cartolith.functions import native as N
from cartolith.functions.register import register

TEXTS = ["POINT(1 2)", "point ( -1.5e2   .25 )", "LINESTRING(0 0,3 4,3 10)", "MULTIPOINT((1 2),(3 4))", "MULTIPOINT(1 2,3 4)", "MULTILINESTRING((0 0,1 1),(2 2,-.5 3))",
         "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "SRID=4326;POINT(7 8)", "POLYGON EMPTY", None]


@pytest.fixture(scope="module")
def texts(spark):
    register(spark)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    d.createOrReplaceTempView("sql_texts")
    return d


def test_text_both_ways(spark, texts):
    want = {r["i"]: r for r in texts.select("i", N.from_wkt(F.col("t")).alias("g"), N.as_geojson(N.from_wkt(F.col("t"))).alias("j"), N.as_wkt(N.centroid(N.from_wkt(F.col("t")))).alias("c"),
                                            N.n_points(N.segmentize(N.from_wkt(F.col("t")), 0.7)).alias("n")).collect()}
    got = spark.sql("SELECT i, st_geomfromtext(t) AS g, st_asgeojson(st_geomfromtext(t)) AS j, st_centroid(st_geomfromtext(t)) AS c, st_npoints(st_segmentize(st_geomfromtext(t), 0.7)) AS n FROM sql_texts").collect()
    for r in got:
        w = want[r["i"]]
        if TEXTS[r["i"]] is not None and ".25" not in TEXTS[r["i"]] and "-.5" not in TEXTS[r["i"]]:
            assert r["g"] == w["g"], TEXTS[r["i"]]
        assert (r["g"] is None) == (TEXTS[r["i"]] is None)
        if TEXTS[r["i"]] and "EMPTY" not in TEXTS[r["i"]] and "." not in TEXTS[r["i"]]:
            assert r["j"] == w["j"] and r["n"] == w["n"], TEXTS[r["i"]]
            assert N is not None and r["c"]["gtype"] == "POINT"
    odd = {TEXTS[r["i"]]: r["g"]["parts"] for r in got if r["g"] is not None}
    assert odd[TEXTS[1]][0][0][0].asDict() == {"x": -150.0, "y": 0.25} and odd[TEXTS[5]][1][0][1].asDict() == {"x": -0.5, "y": 3.0}
    with pytest.raises(Exception, match="unsupported geometry type: CIRCLE"):
        spark.sql("SELECT st_geomfromtext('CIRCLE(1 1,2)')").collect()


def one(spark, text):
    return spark.sql("SELECT " + text + " AS v").first()["v"]


def test_places_on_lines(spark, texts):
    line = "st_geomfromtext('LINESTRING(0 0,3 4,3 14)')"
    assert one(spark, f"st_astext(st_line_interpolate_point({line}, 0.5))") == "POINT(3 6.5)"
    assert one(spark, f"st_line_locate_point({line}, st_point(9, 9))") == pytest.approx(10 / 15)
    assert one(spark, f"st_line_locate_point({line}, st_point(-5, -5))") == 0
    assert one(spark, f"st_length(st_line_substring({line}, 0.2, 0.9))") == pytest.approx(10.5)
    assert one(spark, f"st_geometrytype(st_line_substring({line}, 0.2, 0.2))") == "POINT"
    assert one(spark, f"st_line_interpolate_point({line}, 1.5)") is None
    assert one(spark, "st_line_interpolate_point(CAST(NULL AS " + "struct<gtype:string,parts:array<array<array<struct<x:double,y:double>>>>>), 0.5)") is None


def test_simple_and_rings(spark, texts):
    facts = {"LINESTRING(0 0,2 2,2 0,0 2)": (False, False), "LINESTRING(0 0,1 0,1 1,0 0)": (True, True), "LINESTRING(0 0,5 5)": (True, False), "POLYGON((0 0,1 0,1 1,0 0))": (True, False), "MULTIPOINT(1 1,1 1)": (False, False)}
    for t, want in facts.items():
        assert (one(spark, f"st_issimple(st_geomfromtext('{t}'))"), one(spark, f"st_isring(st_geomfromtext('{t}'))")) == want, t


def test_centroids(spark, texts):
    for t, want in {"POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1))": (2, 2), "POLYGON((0 0,0 4,4 4,4 0,0 0),(0 0,2 0,2 2,0 2,0 0))": (28 / 12, 28 / 12), "LINESTRING(0 0,2 0,2 2)": (1.5, 0.5), "MULTIPOINT(0 0,3 9)": (1.5, 4.5)}.items():
        c = one(spark, f"st_centroid(st_geomfromtext('{t}'))")["parts"][0][0][0]
        assert (c["x"], c["y"]) == pytest.approx(want), t
    assert one(spark, "st_centroid(st_geomfromtext('POLYGON EMPTY'))") is None


def test_lines_of_two_vertices_are_worked_off_by_the_batch(spark, monkeypatch):
    """Same results as line by line, and no geometry of such a line is unpacked."""
    import numpy as np
    import pyarrow as pa
    from cartolith.functions import register as G
    from cartolith.functions.codec import encode
    rng = np.random.default_rng(5)
    line = lambda *v: ("LINESTRING", [[np.array(v, float)]])
    straight = [line(*rng.uniform(-9, 9, (2, 2))) for _ in range(50)] + [line((0, 0), (0, 5)), line((3, 1), (-2, 1))]
    odd = [None, line((1, 1), (1, 1)), line((0, 0), (3, 4), (3, 14)), line((0, 0), (2, 2), (2, 0), (0, 2)), line((1e9, 1e9), (1e9 + 1, 1e9)), line((0, 0), (1, 0), (1, 1), (0, 0)),
           ("POINT", [[np.array([[1.0, 2.0]])]]), ("LINESTRING", []), line((float("nan"), 0), (1, 1))]
    point = lambda x, y: ("POINT", [[np.array([[x, y]], float)]])

    def check(lines, least, most):
        n = len(lines)
        at = [None if i % 17 == 3 else (0.0, 1.0, 0.25, 1.5, 0.3)[i % 5] for i in range(n)] if n > 52 else [(0.0, 1.0, 0.25)[i % 3] for i in range(n)]
        spots = [point(*rng.uniform(-9, 9, 2)) for _ in range(n)]
        a, f, p, lo, hi = encode(lines), pa.array(at, pa.float64()), encode(spots), pa.array([least] * n), pa.array([most] * n)
        return a, at, spots, (G._interpolate_all, (a, f)), (G._locate_all, (a, p)), (G._substring_all, (a, lo, hi)), (G._simple_all, (a,)), (G._ring_all, (a,))

    def plain(lines, at, spots, least, most):
        n = len(lines)
        return [encode(G._each(G._interpolated)(lines, at)), pa.array(G._each(G._located)(lines, spots), pa.float64()), encode(G._each(G._between)(lines, [least] * n, [most] * n)),
                pa.array(G._each(G._simple)(lines), pa.bool_()), pa.array(G._each(G._ring)(lines), pa.bool_())]

    def same(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return x == pytest.approx(y, abs=1e-12, nan_ok=True)
        if isinstance(x, dict):
            return x.keys() == y.keys() and all(same(x[k], y[k]) for k in x)
        return len(x) == len(y) and all(map(same, x, y)) if isinstance(x, list) and isinstance(y, list) else x == y

    usable = [g for g in odd if g is None or g[1]]   # an empty line has no place at all
    for lines, least, most in ((straight + usable, 0.25, 0.75), (straight + usable, 0.5, 0.5), (straight, 0.0, 1.0)):
        _, at, spots, *calls = check(lines, least, most)
        for want, (fn, args) in zip(plain(lines, at, spots, least, most), calls):
            assert same(fn(*args).to_pylist(), want.to_pylist()), fn
    assert G._simple_all(encode(odd)).to_pylist()[7] is True
    _, at, spots, *calls = check(straight, 0.25, 0.75)
    want = plain(straight, at, spots, 0.25, 0.75)
    monkeypatch.setattr(G, "decode", lambda *_: pytest.fail("unpacked"))
    for w, (fn, args) in zip(want, calls):
        assert same(fn(*args).to_pylist(), w.to_pylist()), fn
    assert {"st_issimple", "st_line_substring"} <= set(register(spark))
    assert one(spark, "st_length(st_geomfromtext('LINESTRING(0 0,3 4)'))") == 5 and one(spark, "st_length(st_geomfromtext('MULTILINESTRING((0 0,3 4),(1 1,1 2))'))") == 6
    assert one(spark, "st_length(st_geomfromtext('LINESTRING EMPTY'))") == 0 and one(spark, "st_length(st_point(1, 2))") == 0
