"""Joins whose layers are larger than they look, and tests of boxes and segments without Python."""

import pytest
from pyspark.sql import functions as F

from cartolith.functions import exact as X, native as N
from cartolith.layer import make_box, make_line, make_point, set_srid, vertex, with_bbox
from cartolith.operators import joins as J
from cartolith.plans import grid


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    return with_bbox(df.select("id", make_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom")))


def lines(spark, rows):
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    return with_bbox(df.select("id", make_line(F.array(vertex("x0", "y0"), vertex("x1", "y1"))).alias("geom")))


ROWS = [(i, float(i % 7), float(i * 3 % 5), float(i % 7 + 1 + i % 3), float(i * 3 % 5 + 1 + i % 2)) for i in range(60)] + [(60, 0.0, 0.0, 1.0, 1.0), (60, 0.0, 0.0, 1.0, 1.0)]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_estimate_makes_no_broadcast(spark, monkeypatch):
    """Beyond the measured bound no side of a join goes through the driver, however small its file is."""
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 0)
    a = boxes(spark, ROWS)
    pairs, _ = grid.candidate_pairs(a, a)
    assert "BroadcastHashJoin" not in plan_text(pairs)


def test_rows_with_a_pair_are_not_broadcast(spark, monkeypatch):
    """Rows that have a pair may be nearly all rows, so looking them up shuffles: semi, anti, left and a difference of points."""
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 0)
    rows = [(1, 0.5, 0.5), (None, 1.5, 0.5), (None, 9.0, 9.0), (2, 9.0, 9.0), (2, 0.5, 0.5), (2, 0.5, 0.5)]
    p = with_bbox(spark.createDataFrame(rows, "id int, x double, y double").select("id", make_point(F.col("x"), F.col("y")).alias("geom")))
    a = boxes(spark, [(0, 0.0, 0.0, 2.0, 1.0), (1, 1.0, 0.0, 3.0, 1.0)])
    semi, anti, left = (J.spatial_join(p, a, "intersects", how, "id") for how in ("semi", "anti", "left"))
    gone = J.difference(p, a, "id")
    for df in (semi, anti, left, gone):
        assert "BroadcastHashJoin" not in plan_text(df)
    key = lambda v: (v[0] is None, v)
    assert sorted(((r["id"], r["bbox"]["xmin"]) for r in semi.collect()), key=key) == [(1, 0.5), (2, 0.5), (2, 0.5), (None, 1.5)]
    assert sorted(((r["id"], r["bbox"]["xmin"]) for r in anti.collect()), key=key) == [(2, 9.0), (None, 9.0)]
    assert sorted((str(r["a_id"]), str(r["b_id"])) for r in left.collect()) == sorted([("1", "0"), ("2", "0"), ("2", "0"), ("None", "0"), ("None", "1"), ("2", "None"), ("None", "None")])
    assert sum(not r["geom"]["parts"] for r in gone.collect()) == 4


def test_finer_cells_find_the_same_pairs(spark, monkeypatch):
    """Dense layers meet on finer cells, and busy cells are split by their hash."""
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 0)
    a = boxes(spark, ROWS)
    want = sorted((p[0], q[0]) for p in ROWS for q in ROWS if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    monkeypatch.setattr(grid, "SALT_ROWS", 5)
    for fine in (0, 1, 2):
        monkeypatch.setattr(grid, "_fineness", lambda rows, floor, fine=fine: fine)
        pairs, plan = grid.candidate_pairs(a, a)
        assert plan.hot and plan.fine == fine and plan.left.levels == (0 - fine, 1 - fine)
        assert sorted((r["a_id"], r["b_id"]) for r in pairs.select("a_id", "b_id").collect()) == want


def test_cells_are_finer_where_rows_lie_dense():
    side = lambda tag, n, level, w: {"tag": tag, "n": n, "level": level, "w": w, "h": w, "x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 100.0}
    assert grid._fineness([side(0, 900, -300, 0.0), side(1, 600, 2, 10.0)], -18) == 0
    assert grid._fineness([side(0, 900_000, -300, 0.0), side(1, 60_000, 2, 10.0)], -18) > 0


def test_radius_of_pairs(spark):
    """The closest pairs lie within a radius far below the largest one, and copies of a place are counted each."""
    points = lambda rows: with_bbox(spark.createDataFrame(rows, "id int, x double, y double").select("id", make_point(F.col("x"), F.col("y")).alias("geom")))
    spots = [(i, float(i * 37 % 101), float(i * 53 % 103)) for i in range(400)]
    others = [(i, x + 0.1 + i * 0.001, y) for i, x, y in spots]
    r = J.radius_of_pairs(points(spots), points(others), 5, 50.0)
    apart = sorted(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 for p in spots for q in others)
    assert apart[4] <= r < 5
    assert J.radius_of_pairs(points(spots), points(others), 400 * 400 + 1, 50.0) == 50.0
    assert J.radius_of_pairs(points(spots[:0]), points(others), 5, 50.0) == 50.0


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_boxes_that_touch_or_are_equal(spark, monkeypatch, bound):
    monkeypatch.setattr(grid, "BROADCAST_BYTES", bound)
    a = boxes(spark, ROWS)
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    open_ = lambda p, q: p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
    want = {"touches": lambda p, q: meet(p, q) and not open_(p, q), "equals": lambda p, q: p[1:] == q[1:]}
    for name, holds in want.items():
        expected = sorted((p[0], q[0]) for p in ROWS for q in ROWS if holds(p, q))
        for j in (J.mbr_join(a, a, name), J.spatial_join(a, a, name)):
            assert sorted((r["a_id"], r["b_id"]) for r in j.collect()) == expected
        touched = {p[0] for p in ROWS for q in ROWS if holds(p, q)}
        for j in (J.mbr_join(a, a, name, "semi", "id"), J.spatial_join(a, a, name, "semi", "id")):
            assert sorted(r["id"] for r in j.collect()) == sorted(p[0] for p in ROWS if p[0] in touched)


def test_touching_boxes_meet_by_their_border(spark):
    a = boxes(spark, ROWS)
    assert "__border" in plan_text(J.mbr_join(a, a, "touches"))
    assert "__cell" not in plan_text(J.mbr_join(a, a, "equals"))


SEGMENTS = [(0, -1.0, 1.0, 3.0, 1.0), (1, 0.5, 0.5, 1.5, 1.5), (2, 0.0, 0.0, 2.0, 0.0), (3, -1.0, 0.0, 3.0, 0.0), (4, -1.0, 1.0, 0.0, 1.0), (5, -1.0, 1.0, 1.0, 3.0), (6, -1.0, 1.0, 1.0, 3.5),
            (7, 1.0, 1.0, 5.0, 1.0), (8, 1.0, -1.0, 1.0, 5.0), (9, 2.0, 2.0, 3.0, 3.0), (10, 0.0, 0.0, 2.0, 2.0), (11, 0.0, 1.0, 1.0, 1.0), (12, 1.0, 2.0, 1.0, 2.5)]


def test_segments_and_rectangles_without_python(spark):
    """Same answers as the kernel's matrix and overlay, also along borders and through corners."""
    a, b = lines(spark, SEGMENTS), boxes(spark, [(0, 0.0, 0.0, 2.0, 2.0)])
    pairs, plan = grid.candidate_pairs(a, b)
    assert plan.left.segments
    matrix = X.relate(F.col("a_geom"), F.col("b_geom"))
    for name in X.SEGMENT_RECT:
        j = J.spatial_join(a, b, name)
        assert "Python" not in plan_text(j) and "ArrowEval" not in plan_text(j)
        want = pairs.where(X.predicate_from_matrix(matrix, name, F.lit(1), F.lit(2)))
        assert sorted(r["a_id"] for r in j.collect()) == sorted(r["a_id"] for r in want.collect()), name
    cut = J.intersection(a, b, ["id"])
    assert "ArrowEval" not in plan_text(cut)
    key = lambda g: (g["gtype"], sorted((round(v["x"], 9), round(v["y"], 9)) for p in g["parts"] for r in p for v in r))
    slow = pairs.select(F.col("a_id").alias("id"), X.intersection(F.col("a_geom"), F.col("b_geom")).alias("geom")).where(F.size("geom.parts") > 0)
    assert sorted((r["id"], *key(r["geom"])) for r in cut.collect()) == sorted((r["id"], *key(r["geom"])) for r in slow.collect())


def test_farthest_places_of_points_and_boxes_without_python(spark):
    from cartolith.layer import make_point
    p = with_bbox(spark.range(3).select("id", make_point(F.col("id").cast("double"), F.lit(0.5)).alias("geom")))
    j = J.within_distance_join(boxes(spark, [(0, 0.0, 0.0, 1.0, 1.0)]), p, 2.0, fully=True)
    assert "ArrowEval" not in plan_text(j)
    got = {r["b_id"]: r["dist"] for r in j.collect()}
    assert got == pytest.approx({0: 1.25 ** 0.5, 1: 1.25 ** 0.5})


def test_rectangles_united_in_tiles(spark, monkeypatch):
    """Tiles give the shapes that rounds of unions give: overlaps, islands, holes, copies, keys without a geometry."""
    from cartolith.functions import native as N
    from cartolith.operators import aggregate as A
    rows = ROWS + [(100 + i, *r) for i, r in enumerate([(20.0, 0.0, 26.0, 1.0), (20.0, 5.0, 26.0, 6.0), (20.0, 0.0, 21.0, 6.0), (25.0, 0.0, 26.0, 6.0), (40.3, 40.3, 40.4, 40.6)])]
    a = boxes(spark, rows).select((F.col("id") % 3).alias("k"), "geom")
    a = a.unionByName(a.limit(1).select(F.lit(9).alias("k"), F.lit(None).cast(a.schema["geom"].dataType).alias("geom")))
    facts = lambda d: sorted((r["k"], None if r["area"] is None else round(r["area"], 9), None if r["around"] is None else round(r["around"], 9), r["parts"]) for r in d.select(
        "k", N.area(F.col("geom")).alias("area"), N.perimeter(F.col("geom")).alias("around"), F.size("geom.parts").alias("parts")).collect())
    slow = facts(A.dissolve(a, "k"))
    whole = A.union_layer(a.select("geom")).select(F.lit(0).alias("k"), "geom")
    slow_whole = facts(whole)
    monkeypatch.setattr(A, "TILED_ROWS", 0)
    assert facts(A.dissolve(a, "k")) == slow
    assert facts(A.union_layer(a.select("geom")).select(F.lit(0).alias("k"), "geom")) == slow_whole
    z = boxes(spark, [(0, 0.0, 0.0, 10.0, 10.0), (1, 19.0, -1.0, 30.0, 7.0), (2, 50.0, 50.0, 51.0, 51.0)])
    monkeypatch.setattr(A, "TILED_ROWS", 1 << 40)
    cut = J.difference(z, boxes(spark, rows), "id").withColumnRenamed("id", "k")
    want = facts(cut)
    monkeypatch.setattr(A, "TILED_ROWS", 0)
    assert facts(J.difference(z, boxes(spark, rows), "id").withColumnRenamed("id", "k")) == want


def test_triangles_of_a_layer_of_several_tiles(spark, monkeypatch):
    """The whole layer as one group, beyond one tile."""
    from cartolith.layer import make_point
    from cartolith.operators import hulls
    monkeypatch.setattr(hulls, "POINTS", 64)
    p = with_bbox(spark.range(300).select(make_point(F.expr("double(id * 7919 % 307)"), F.expr("double(id * id % 311)")).alias("geom")))
    n = p.select("bbox.xmin", "bbox.ymin").distinct().count()
    t = hulls.delaunay_triangles(p).agg(F.count(F.lit(1)).alias("n"), F.sum("outer").alias("outer")).first()
    assert t["n"] == 2 * n - t["outer"] - 2


def test_neighbours_within_narrowed_radii(spark, monkeypatch):
    """Radii are narrowed without losing a neighbour: ties, copies on both sides, fewer neighbours than asked for."""
    from cartolith.layer import make_point
    at = lambda n, x, y: with_bbox(spark.range(n).select("id", make_point(F.expr(f"double({x})"), F.expr(f"double({y})")).alias("geom")))
    a, b = at(200, "id * 17 % 41", "id * 29 % 37"), at(60, "id * 13 % 43 div 2 * 2", "id * 7 % 31")
    a, few = a.unionByName(a.where("id % 9 = 0")), at(2, "id * 5", "3")
    rows = lambda d: sorted((r["a_id"], r["b_id"], r["dist"], r["rank"]) for r in d.collect())
    cases = [(b, 1), (b, 3), (few, 3)]
    want = [rows(J.knn_join(a, n, k, "id", "id")) for n, k in cases]
    calls, narrowed = [], J._narrowed
    monkeypatch.setattr(J, "_narrowed", lambda *args: calls.append(1) or narrowed(*args))
    monkeypatch.setattr(J, "NARROWED_ROWS", 0)
    assert [rows(J.knn_join(a, n, k, "id", "id")) for n, k in cases] == want and len(calls) == 3


def test_pieces_that_fill_their_box_need_no_union(spark, monkeypatch):
    from cartolith.operators import joins as J
    united = []
    real = J.united
    monkeypatch.setattr(J, "united", lambda df, keys, *a: united.append(df.count()) or real(df, keys, *a))
    box = lambda rows: with_bbox(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select("id", make_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("geom")))
    quarters = box([(i, 10.0 * (i % 2), 10.0 * (i // 2), 10.0 * (i % 2) + 10, 10.0 * (i // 2) + 10) for i in range(4)])
    area = lambda a, b: {r["id"]: r["a"] for r in J.difference(a, b, "id").select("id", N.area(F.col("geom")).alias("a")).collect()}
    assert area(box([(1, 5.0, 5.0, 15.0, 15.0), (2, 15.0, 15.0, 25.0, 18.0), (3, 30.0, 0.0, 31.0, 1.0)]), quarters) == {1: 0.0, 2: 15.0, 3: 1.0}
    assert not united
    # a hole in the middle of the box, and a corner that is missing
    ring = box([(0, 0.0, 0.0, 3.0, 1.0), (1, 0.0, 2.0, 3.0, 3.0), (2, 0.0, 0.0, 1.0, 3.0), (3, 2.0, 0.0, 3.0, 3.0), (4, 10.0, 0.0, 12.0, 1.0), (5, 10.0, 0.0, 11.0, 2.0)])
    assert area(box([(1, 0.0, 0.0, 3.0, 3.0), (2, 10.0, 0.0, 12.0, 2.0)]), ring) == {1: 1.0, 2: 1.0}
    assert united == [6]
