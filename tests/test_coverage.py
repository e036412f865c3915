"""Coverages: cancelled borders and shared arcs on small layers that plain arithmetic can check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import kernel as K, native as N
from cartolith.layer import GEOM, with_bbox
from cartolith.operators import aggregate as A, coverage as C
from cartolith.operators.joins import spatial_join

KEYED = f"k string, geom {GEOM}"


def layer(spark, rows):
    """Rows of (key, list of rings)."""
    def verts(r):
        return [(float(x), float(y)) for x, y in [*r, r[0]]]
    return with_bbox(spark.createDataFrame([(k, ("POLYGON", [[verts(r) for r in rings]]) if rings is not None else None) for k, rings in rows], KEYED))


def square(x, y, s=1):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def facts(df, key="k"):
    g = F.col("geom")
    return {r[0]: (round(r[1], 9), round(r[2], 9), r[3], r[4]) for r in df.select(key, N.area(g), N.perimeter(g), N.n_parts(g), N.n_interior_rings(g)).collect()}


def test_dissolve_keys_holes_and_matching(spark):
    ring_of_cells = [("a", [square(x, y)]) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = ring_of_cells + [(None, [square(1, 1)]), (None, [square(5, 5)]), ("wide", [[(0, 3), (3, 3), (3, 4), (0, 4)]]), ("wide", [square(0, 4)]), ("wide", [square(1, 4)]), ("none", None)]
    rows.append(("turned", [square(10, 0)[::-1], square(10.25, 0.25, 0.5)]))   # clockwise shell, anticlockwise hole
    got = facts(A.dissolve(layer(spark, rows), "k", coverage=True))
    assert got["a"] == (8.0, 16.0, 1, 1)
    assert got[None] == (2.0, 8.0, 2, 0)
    assert got["wide"] == (5.0, 10.0, 1, 0)
    assert got["turned"] == (0.75, 6.0, 1, 1)
    assert got["none"][:2] == (0.0, 0.0)
    assert A.dissolve(layer(spark, rows).where("false"), "k", coverage=True).count() == 0


def test_dissolve_equals_the_union_of_random_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.integers(3)), [square(x / 3, y / 3, 1 / 3)]) for x in range(12) for y in range(12)]
    d = layer(spark, rows)
    fast, slow = facts(A.dissolve(d, "k", coverage=True)), facts(A.dissolve(d, "k"))
    assert fast.keys() == slow.keys()
    assert all(fast[k][:2] == pytest.approx(slow[k][:2]) for k in slow)


def circle(n, r, cx=0.0, cy=0.0):
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_islands_are_simplified_on_both_sides(spark):
    shore = circle(200, 2.0, 5, 5)
    d = layer(spark, [("sea", [square(0, 0, 10), shore[::-1]]), ("land", [shore])])
    got = facts(C.simplify_coverage(d, "k", 0.05))
    assert got["sea"][0] + got["land"][0] == pytest.approx(100)
    assert got["sea"][3] == 1 and 0 < got["land"][0] < math.pi * 4
    tiny = facts(C.simplify_coverage(d, "k", 50.0))   # an island does not collapse
    assert tiny["land"][0] > 0 and tiny["sea"][0] + tiny["land"][0] == pytest.approx(100, abs=100)


def test_arcs_that_would_meet_keep_their_vertices(spark):
    """A bay with an islet in it: cutting the bay off would swallow the islet."""
    coast = [(0, 5), (0, 0), (10, 0), (10, 5), (5.5, 5), (5.5, 3), (4.5, 3), (4.5, 5)]
    d = layer(spark, [("land", [coast]), ("islet", [square(4.8, 4.0, 0.4)])])
    s = A.save_step(C.simplify_coverage(d, "k", 2.5), "s")
    assert facts(s)["land"][:2] == facts(d)["land"][:2]
    assert spatial_join(s, s, "relate", pattern="T********").where("a_k < b_k").count() == 0


def test_random_terrain_has_no_gaps_or_overlaps(spark):
    """Cells with jagged borders: the total area stays when the outer border does, and interiors stay apart."""
    rng = np.random.default_rng(4)
    n, steps = 4, 8
    node = {(i, j): (i + (0 < i < n) * rng.uniform(-.2, .2), j + (0 < j < n) * rng.uniform(-.2, .2)) for i in range(n + 1) for j in range(n + 1)}
    line = {}
    for (i, j) in node:
        for di, dj in ((1, 0), (0, 1)):
            if (i + di, j + dj) in node:
                p, q = np.array(node[i, j]), np.array(node[i + di, j + dj])
                outer = (di and j in (0, n)) or (dj and i in (0, n))
                mid = [p + (q - p) * t / steps + (0 if outer else 1) * rng.uniform(-.08, .08, 2) for t in range(1, steps)]
                line[(i, j), (i + di, j + dj)] = [tuple(p), *map(tuple, mid), tuple(q)]
    rows = [(f"{i}-{j}", [(line[(i, j), (i + 1, j)][:-1] + line[(i + 1, j), (i + 1, j + 1)][:-1] + line[(i, j + 1), (i + 1, j + 1)][::-1][:-1] + line[(i, j), (i, j + 1)][::-1][:-1])]) for i in range(n) for j in range(n)]
    d = layer(spark, rows)
    s = A.save_step(C.simplify_coverage(d, "k", 0.1, keep_outer=True), "s")
    assert s.count() == n * n
    assert sum(v[0] for v in facts(s).values()) == pytest.approx(n * n)
    points = lambda x: x.agg(F.sum(N.n_points(F.col("geom")))).first()[0]
    assert points(s) < points(d) / 2
    assert spatial_join(with_bbox(s), with_bbox(s), "relate", pattern="T********").where("a_k < b_k").count() == 0
    whole = A.union_layer(s, coverage=True).select(N.area(F.col("geom"))).first()[0]
    assert whole == pytest.approx(n * n)


def test_empty_and_foreign_rows(spark):
    d = layer(spark, [("x", None)])
    assert C.simplify_coverage(d, "k", 1.0).count() == 0
    assert K.simplify_chain(np.array([[0., 0], [1, 0.01], [2, 0]]), 0.1).tolist() == [[0, 0], [2, 0]]


def test_arcs_that_meet_at_ends_only(spark):
    from cartolith.functions.native import from_wkt
    from cartolith.layer import bbox_of
    from cartolith.operators.coverage import _only_ends_meet
    rows = [("LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 1 1)", True), ("LINESTRING (0 0, 1 0)", "LINESTRING (1 -1, 1 1)", False), ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 1 1)", False),
            ("LINESTRING (0 0, 1 1)", "LINESTRING (0 1, 1 1)", False), ("LINESTRING (0 0, 1 0, 1 1, 0 0)", "LINESTRING (0 0, -1 -1)", False)]
    d = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", from_wkt(F.col("a")).alias("a_geom"), from_wkt(F.col("b")).alias("b_geom"))
    d = d.withColumns({"a_bbox": bbox_of(F.col("a_geom")), "b_bbox": bbox_of(F.col("b_geom"))})
    assert all(r["want"] == r["got"] for r in d.select("want", _only_ends_meet().alias("got")).collect())


@pytest.mark.parametrize("sides,wider", [(20, 2), (60, 16), (10_000, 16)])
def test_borders_traced_cell_by_cell(spark, monkeypatch, sides, wider):
    """The same polygons as from one task per key: pieces over many cells, islands in holes, corners that touch, NULL keys."""
    rng = np.random.default_rng(11)
    rows = [(("a", "b", None)[int(rng.choice(3, p=[0.55, 0.3, 0.15]))], [square(x, y)]) for x in range(18) for y in range(18)]
    rows += [("a", [square(30, 0, 20), square(31, 1, 18)[::-1]]), ("a", [square(33, 3, 14), square(35, 5, 10)[::-1]]), ("a", [square(38, 8, 3)]), ("none", None)]   # rings in rings
    d = layer(spark, rows)

    def parts():
        got = A.dissolve(d, "k", coverage=True).collect()
        ring = lambda r: min(tuple(t[i:] + t[:i]) for t in [[tuple(v) for v in r[:-1]]] for i in range(len(t)))
        return {r["k"]: (r["geom"]["gtype"], sorted((ring(p[0]), sorted(map(ring, p[1:]))) for p in r["geom"]["parts"])) for r in got}

    want = parts()
    monkeypatch.setattr(C, "TRACED_SIDES", 0)
    monkeypatch.setattr(C, "CELL_SIDES", sides)
    monkeypatch.setattr(C, "WIDER", wider)
    monkeypatch.setattr(C, "_assemble", lambda: pytest.fail("a whole border went into one task"))
    got = parts()
    assert got.keys() == want.keys() == {"a", "b", None, "none"}
    for k in want:
        assert got[k][0] == want[k][0] and [p[0] for p in got[k][1]] == [p[0] for p in want[k][1]], k
    area = lambda w: sum(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2 * s for shell, holes in w[1] for r, s in [(shell, 1), *[(h, -1) for h in holes]])
    for k in want:
        assert area(got[k]) == pytest.approx(area(want[k])) and sum(len(p[1]) for p in got[k][1]) == sum(len(p[1]) for p in want[k][1]), k
    assert got["a"] == want["a"] and got["b"] == want["b"] and got[None] == want[None]
