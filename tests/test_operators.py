"""Operators: edge cases, laws, plans and skew."""

import math

import pytest
from pyspark.sql import functions as F

from cartolith import fixtures as fx
from cartolith.functions import exact as X, native as N
from cartolith.layer import SridError, as_layer, empty, set_srid, srid_of, with_bbox
from cartolith.operators import aggregate as A, history as H, joins as J, points as P, profile as PR, raster as R, tables as T, transform as TR
from cartolith.plans import grid as G, scan as S
from cartolith.sources import tables as ST, vector as SV


def wkt_layer(spark, rows, names="id long", srid=3857):
    df = spark.createDataFrame(rows, names + ", w string")
    return set_srid(with_bbox(df.withColumn("geom", N.from_wkt(F.col("w"))).drop("w")), srid)


@pytest.fixture(scope="module")
def shapes(spark):
    """Hole, two parts, bow-tie, empty and NULL."""
    return wkt_layer(spark, [(1, "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), (2, "MULTIPOLYGON(((20 0,22 0,22 2,20 2,20 0)),((30 0,33 0,33 3,30 3,30 0)))"),
                             (3, "POLYGON EMPTY"), (4, None)])


def test_predicates_on_edges(spark, shapes):
    pts = wkt_layer(spark, [(1, "POINT(5 5)"), (2, "POINT(4 5)"), (3, "POINT(1 1)"), (4, "POINT(0 0)"), (5, "POINT(21 1)"), (6, "POINT(25 1)")])
    hits = {p: {(r.a_id, r.b_id) for r in J.spatial_join(pts, shapes, p).collect()} for p in ("intersects", "within", "touches", "coveredby")}
    assert hits["intersects"] == {(2, 1), (3, 1), (4, 1), (5, 2)} == hits["coveredby"]
    assert hits["within"] == {(3, 1), (5, 2)}
    assert hits["touches"] == {(2, 1), (4, 1)}


def test_general_predicates(spark, shapes):
    other = wkt_layer(spark, [(1, "POLYGON((1 1,3 1,2 3,1 1))"), (2, "POLYGON((9 9,12 9,10 12,9 9))"), (3, "LINESTRING(-1 5,11 5)"), (4, "POLYGON((4 4,6 4,6 6,4 6,4 4))")])
    got = {p: {(r.a_id, r.b_id) for r in J.spatial_join(shapes, other, p).collect()} for p in ("contains", "overlaps", "crosses", "touches")}
    assert got == {"contains": {(1, 1)}, "overlaps": {(1, 2)}, "crosses": {(1, 3)}, "touches": {(1, 4)}}


def test_overlay_rows(spark, shapes):
    mask = wkt_layer(spark, [(7, "POLYGON((5 -1,40 -1,40 1,5 1,5 -1))")])
    area = lambda d: {r.id: r.a for r in d.select("id", N.area(F.col("geom")).alias("a")).collect()}
    assert area(J.clip(shapes, mask)) == pytest.approx({1: 5.0, 2: 5.0})
    d = J.difference(shapes, mask, "id")
    got = area(d)
    assert got[1] == pytest.approx(91.0) and got[2] == pytest.approx(8.0) and got[3] == 0.0 and got[4] is None
    none = J.difference(shapes, mask.where("id < 0"), "id")
    assert area(none)[1] == pytest.approx(96.0)     # an empty second layer changes nothing
    covered = wkt_layer(spark, [(1, "POLYGON((0 0,1 0,1 1,0 0))")])
    assert J.difference(covered, wkt_layer(spark, [(1, "POLYGON((-1 -1,5 -1,5 5,-1 5,-1 -1))")]), "id").select(N.is_empty(F.col("geom"))).first()[0]
    singles = J.clip(shapes, mask, single=True)
    assert {r[0] for r in singles.select(F.col("geom")["gtype"]).distinct().collect()} == {"POLYGON"} and singles.count() == 3


def test_dissolve_nulls(spark):
    d = wkt_layer(spark, [(None, None, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (None, "b", "POLYGON((1 0,2 0,2 1,1 1,1 0))"), ("k", None, "POLYGON((5 5,6 5,6 6,5 6,5 5))"),
                          ("k", None, "POLYGON((5 5,6 5,6 6,5 6,5 5))")], "k string, t string")
    rows = {r.k: (r.t, r.a, r.n) for r in A.dissolve(d, "k").select("k", "t", N.area(F.col("geom")).alias("a"), N.n_parts(F.col("geom")).alias("n")).collect()}
    assert rows == {None: ("b", pytest.approx(2.0), 1), "k": (None, pytest.approx(1.0), 1)}
    assert A.dissolve(d.drop("t"), "k").columns == ["k", "geom", "bbox"]


def test_srids(spark, shapes):
    geo = set_srid(wkt_layer(spark, [(1, "POINT(0.00001 0.00001)")]), 4326)
    assert srid_of(geo) == 4326
    with pytest.raises(SridError):
        J.spatial_join(geo, shapes, "intersects")
    assert J.spatial_join(geo, shapes, "intersects", align_srid=True).count() == 1
    with pytest.raises(SridError, match="2180"):
        TR.reproject(geo, 2180)
    assert set_srid(geo, None) is geo


def test_utm_known_point(spark):
    p = wkt_layer(spark, [(1, "POINT(3 0)"), (2, "POINT(9 45)")], srid=4326)
    out = {r.id: r.geom["parts"][0][0][0] for r in TR.reproject(p, 32631).collect()}
    assert out[1]["x"] == pytest.approx(500000, abs=1e-6) and out[1]["y"] == pytest.approx(0, abs=1e-6)
    back = TR.reproject(TR.reproject(p, 32632), 4326).where("id = 2").first().geom["parts"][0][0][0]
    assert back["x"] == pytest.approx(9, abs=1e-9) and back["y"] == pytest.approx(45, abs=1e-9)
    assert TR.reproject(p, 32632).where("id = 2").first().geom["parts"][0][0][0]["y"] == pytest.approx(4982950.400, abs=0.01)


def test_text_forms(spark):
    texts = ["POINT(1 2)", "LINESTRING(0 0,1 1.5)", "POLYGON((0 0,1 0,1 1,0 0))", "MULTIPOINT((1 1),(2 2))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "POLYGON EMPTY"]
    d = wkt_layer(spark, [(i, t) for i, t in enumerate(texts)])
    g = F.col("geom")
    assert [r[0] for r in d.orderBy("id").select(N.as_wkt(g)).collect()] == texts
    back = d.where("id < 6").select((X.from_wkb(X.as_wkb(g)) == g).alias("b"), (N.from_geojson(N.as_geojson(g)) == g).alias("j"))
    assert all(r.b and r.j for r in back.collect())
    with pytest.raises(Exception, match="unsupported geometry type"):
        wkt_layer(spark, [(1, "CIRCULARSTRING(0 0,1 1,1 0)")]).collect()


def test_join_plans_and_cells(spark, sf):
    """No nested loops without broadcast, and the same rows as with it."""
    s, z, d = fx.sites(spark, sf), fx.zones(spark, sf), fx.depots(spark, sf)
    with_broadcast = J.spatial_join(s, z, "within").count(), J.within_distance_join(s, d, 7.0).count()
    old, G.BROADCAST_BYTES = G.BROADCAST_BYTES, -1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [J.spatial_join(s, z, "within"), J.within_distance_join(s, d, 7.0)]
        for j in joins:
            plan = j._jdf.queryExecution().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert tuple(j.count() for j in joins) == with_broadcast
    finally:
        G.BROADCAST_BYTES = old
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixed_sizes_match_brute_force(spark):
    """Boxes from tiny to huge on both sides: every meeting pair once."""
    import random
    rng = random.Random(3)

    def layer(n):
        rows = []
        for i in range(n):
            w, h = 4 ** rng.uniform(-5, 6), 4 ** rng.uniform(-5, 6)
            x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
            rows.append((i, x, y, x + w, y + h))
        return rows

    a, b = layer(150), layer(150)
    from cartolith.layer import make_bbox, make_box
    mk = lambda rows: spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select(
        "id", make_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("geom"), make_bbox(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"))
    got = [(r.a_id, r.b_id) for r in J.spatial_join(mk(a), mk(b), "intersects").select("a_id", "b_id").collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_cell_is_salted(spark):
    """A third of the rows at one place: the cell is found and split, and no pair is lost or doubled."""
    pts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") % 97).cast("double").alias("y"))
    pts = as_layer(pts, __import__("cartolith.layer", fromlist=["make_point"]).make_point("x", "y"))
    zones = wkt_layer(spark, [(i, f"POLYGON(({x} 0,{x + 10} 0,{x + 10} 100,{x} 100,{x} 0))") for i, x in enumerate(range(0, 100, 10))], srid=None)
    old = G.BROADCAST_BYTES, G.SALT_ROWS
    try:
        want = sorted(map(tuple, J.spatial_join(pts, zones, "intersects").select("a_id", "b_id").collect()))
        G.BROADCAST_BYTES, G.SALT_ROWS = -1, 100
        pairs, plan = G.candidate_pairs(pts, zones)
        assert plan.hot and max(h[4] for h in plan.hot) >= 5
        got = sorted(map(tuple, J.spatial_join(pts, zones, "intersects").select("a_id", "b_id").collect()))
    finally:
        G.BROADCAST_BYTES, G.SALT_ROWS = old
    assert got == want


def test_knn_with_copies(spark):
    """Half of the targets share one place; ties go to the smallest key."""
    from cartolith.layer import make_point
    b = as_layer(spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 50.0).otherwise(F.col("id") * 7 % 100).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, 50.0).otherwise(F.col("id") * 13 % 100).cast("double").alias("y")), make_point("x", "y"))
    a = as_layer(spark.range(60).select("id", (F.col("id") * 17 % 100).cast("double").alias("x"), (F.col("id") * 29 % 100).cast("double").alias("y")), make_point("x", "y"))
    got = {}
    for r in J.knn_join(a, b, 4, "id", "id").orderBy("a_id", "rank").collect():
        got.setdefault(r.a_id, []).append(r.b_id)
    rows_b = [(r.id, r.x, r.y) for r in b.collect()]
    for r in a.collect():
        want = [i for _, i in sorted((math.sqrt((x - r.x) ** 2 + (y - r.y) ** 2), i) for i, x, y in rows_b)[:4]]
        assert got[r.id] == want


def test_scan_matches_plain_windows(spark):
    """Blocks and chunks give what one window per key gives, for a key that owns most rows."""
    from pyspark.sql import Window
    d = spark.range(2000).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("k"), (F.col("id") * 37 % 211).alias("v"))
    w = Window.partitionBy("k").orderBy("v")
    u = Window.partitionBy("k").orderBy("v", "id")
    want = d.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "cume_dist": F.cume_dist().over(w)})
    got = S.ranked(d, ["k"], ["v"], "rank", "dense_rank", "cume_dist")
    assert want.exceptAll(got.select(want.columns)).isEmpty()
    want = d.withColumns({"a": F.lag("id").over(u), "b": F.sum("v").over(u.rowsBetween(-3, 2))})
    got = S.windowed(d, ["k"], ["v", "id"], {"a": lambda w: F.lag("id").over(w), "b": lambda w: F.sum("v").over(w.rowsBetween(-3, 2))}, before=3, after=2, chunk=50)
    assert want.exceptAll(got).isEmpty()
    down = S.ranked(d, ["k"], ["-v", "id"], "row_number")
    assert d.withColumn("row_number", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id"))).exceptAll(down).isEmpty()


def test_history_rules(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    h = H.init_history(base, "k")
    log = spark.createDataFrame([(1, "x", "2020-01-02", "U"), (1, None, "2020-01-03", "D"), (1, "z", "2020-01-04", "U"), (3, "n", "2020-01-02", "I")], "k long, v string, t string, op string").withColumn("ts", F.col("t").cast("timestamp"))
    out = H.apply_changes(h, log, "k", user="me")
    rows = sorted((r.k, r.v, r.valid_to is None) for r in out.collect())
    assert rows == [(1, "a", False), (1, "x", False), (2, "b", True), (3, "n", True)]   # the update after the delete is ignored
    assert sorted(r.k for r in H.at_time(out, "2020-01-02 12:00:00").collect()) == [1, 2, 3]
    assert H.current(out).exceptAll(H.at_time(out, "2999-01-01 00:00:00")).isEmpty()
    assert {(r.k, r.change) for r in H.changes_between(out, "2020-01-01 00:00:00", "2020-02-01 00:00:00", "k").collect()} == {(1, "deleted"), (3, "inserted")}
    with pytest.raises(ValueError):
        H.init_history(base, ["k", "v"])


def test_raster_laws(spark, sf):
    h = fx.heat(spark, sf)
    assert R.mosaic(R.retile(h, 30, 7)).select("band", "col", "row", "value").exceptAll(h.select("band", "col", "row", "value")).isEmpty()
    assert R.must_tile(R.Grid(0, 0, 1, 1, 10000, 10000), 1) and not R.must_tile(R.Grid(0, 0, 1, 1, 100, 100), 1)
    flat = R.map_algebra(h, "7D", (2,))
    for alg in R.ALGORITHMS:
        r = R.resample(flat, 3.0, alg).agg(F.min("value"), F.max("value")).first()
        assert r[0] == pytest.approx(7.0) and r[1] == pytest.approx(7.0)
    with pytest.raises(ValueError):
        R.resample(h, 2.0, "Magic")


def test_random_points(spark, shapes):
    one = P.generate_points(shapes.where("id = 2"), 300, seed=4)
    inside = J.spatial_join(one.select("geom", "bbox"), shapes, "within")
    assert one.count() == 300 == inside.count()
    assert P.generate_points(shapes.where("id = 2"), 300, seed=4).exceptAll(one).isEmpty()
    assert P.generate_points(shapes, 25, multipoint=True).select(N.n_parts(F.col("geom"))).first()[0] == 25
    stacked = shapes.where("id = 1").select("geom").union(wkt_layer(spark, [(i, f"POLYGON((0 0,{9 + i} 0,{9 + i} 10,0 10,0 0))") for i in range(8)]).select("geom"))
    assert P.generate_points(with_bbox(stacked), 100).count() == 100


def test_repair_methods(spark):
    bow = wkt_layer(spark, [(1, "POLYGON((0 0,2 2,2 0,0 2,0 0))"), (2, "POLYGON((0 0,4 0,4 3,0 3,0 0))")])
    a = {r.id: r.a for r in TR.make_valid(bow, "ST_MakeValid").select("id", N.area(F.col("geom")).alias("a")).collect()}
    assert a == pytest.approx({1: 2.0, 2: 12.0})
    b = {r.id: r.a for r in TR.make_valid(bow).select("id", N.area(F.col("geom")).alias("a")).collect()}
    assert b[2] == pytest.approx(12.0, abs=1e-2)
    with pytest.raises(ValueError):
        TR.make_valid(bow, "magic")


def test_merge_layers(spark, shapes, sf):
    with pytest.raises(ValueError, match="different geometry types"):
        T.merge_layers([shapes.select("id", "geom"), fx.sites(spark, sf).select("site_id", "geom")])
    twice = T.merge_layers([shapes, shapes])
    assert twice.count() == shapes.count()
    assert T.merge_layers([shapes, shapes], distinct=False, single=True).count() == 6


def test_tables(spark, sf, shapes):
    assert ST.clean_name("My out-put łąka (1)!") == "Myoutputka1"
    name = ST.save_table(shapes.drop("bbox"), "Shapes one", overwrite=True)
    assert name == "`default`.`Shapesone`" and spark.table(name).count() == 4
    ST.save_table(shapes.drop("bbox").limit(1), "Shapes one")          # exists: left alone
    assert spark.table(name).count() == 4 and srid_of(spark.table(name)) == 3857
    assert {r.name: r.kind for r in PR.catalog(spark).collect()}["shapesone"] == "vector"
    mv = ST.create_materialized(spark, f"SELECT count(*) AS n FROM {name}", "shape_count")
    ST.truncate(spark, name)
    ST.refresh_materialized(spark, mv)
    assert spark.table(mv).first().n == 0
    PR.run_logged(spark, f"SELECT * FROM {mv}", "query_log_t")
    assert PR.query_log(spark, "query_log_t").first().n_rows == 1
    PR.save_query(spark, "saved_t", "one", "SELECT 1 AS x")
    assert PR.load_query(spark, "saved_t", "one").first().x == 1
    PR.delete_query(spark, "saved_t", "one")
    assert PR.saved_queries(spark, "saved_t").isEmpty()
    for t in (name, mv, "query_log_t", "saved_t"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_import_options(spark):
    d = wkt_layer(spark, [(1, "MULTIPOINT((1 1),(2 2))")], "ID long").withColumnRenamed("geom", "Shape").drop("bbox")
    n = SV.normalize_layer(d, "Shape", force_singlepart=True)
    assert n.columns == ["id", "old_id", "geom", "bbox"] and n.count() == 2 and srid_of(n) == 3857


def test_sql_functions(spark, shapes):
    from cartolith.functions.register import register
    register(spark)
    shapes.createOrReplaceTempView("shapes_v")
    r = spark.sql("SELECT st_area(geom) a, st_npoints(geom) n, st_numinteriorrings(geom) h, st_xmax(geom) x FROM shapes_v WHERE id = 1").first()
    assert (r.a, r.n, r.h, r.x) == (pytest.approx(96.0), 10, 1, 10.0)
    assert spark.sql("SELECT count(*) n FROM shapes_v, LATERAL st_dump(geom) d").first().n == 3
    assert spark.sql("SELECT st_isvalid(geom) v, st_contains(geom, st_makepoint(1D, 1D)) c FROM shapes_v WHERE id = 1").first().asDict() == {"v": True, "c": True}


def test_bbox_filter_reaches_the_scan(spark, sf, tmp_path):
    T.spatial_sort(fx.parcels(spark, sf)).write.parquet(str(tmp_path / "p"))
    plan = J.bbox_filter(spark.read.parquet(str(tmp_path / "p")), 1, 1, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.range(1).select(F.lit(500).cast("long").alias("u"), F.lit(501).cast("long").alias("v")))
    nodes = spark.range(n).unionByName(spark.range(500, 503))
    got = {r.id: r.component for r in A.connected_components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[501] == 500 and got[502] == 502


def test_clean_sql():
    assert T.clean_sql("SELECT 1 -- one; 'two\n  , '-- \"no' AS `--x` ;\n;") == "SELECT 1   , '-- \"no' AS `--x`"
    assert T.clean_sql("SELECT 'it''s' || 'a\nb\\'--' -- end") == "SELECT 'it''s' || 'a\nb\\'--'"
    assert T.clean_sql(" ;; ") == ""
