"""Geometry kernel against JTS (on the driver, test only) and against its own laws."""

import numpy as np
import pytest

from cartolith.functions import kernel as K


def box(x0, y0, x1, y1):
    return ("POLYGON", [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]])


def area(g):
    return sum(abs(K.ring_area(p[0])) - sum(abs(K.ring_area(h)) for h in p[1:]) for p in g[1]) if K.dim(g) == 2 else 0.0


def star(rng, n=12, hole=False):
    t = np.sort(rng.random(n)) * 2 * np.pi
    t = 2 * np.pi * np.arange(n) / n
    r = 1 + 4 * rng.random(n)
    c = rng.random(2) * 6
    ring = np.column_stack([np.cos(t) * r, np.sin(t) * r]) + c
    ring = np.vstack([ring, ring[:1]])
    part = [ring]
    if hole:
        h = np.column_stack([np.cos(t[::-1]), np.sin(t[::-1])]) * 0.5 + c
        part.append(np.vstack([h, h[:1]]))
    return ("POLYGON", [part])


def wkt(g):
    ring = lambda r: "(" + ",".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")"
    part = lambda p: "(" + ",".join(map(ring, p)) + ")"
    if g[0] == "LINESTRING":
        return "LINESTRING" + ring(g[1][0][0])
    if not g[1]:
        return "POLYGON EMPTY"
    return "MULTIPOLYGON(" + ",".join(map(part, g[1])) + ")"


@pytest.fixture(scope="module")
def jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    return lambda g: reader.read(wkt(g))


def test_overlay_against_jts(jts):
    rng = np.random.default_rng(5)
    a, b = [star(rng, hole=i % 2 == 0) for i in range(120)], [star(rng, 9) for _ in range(120)]
    for op, name in (("intersection", "intersection"), ("difference", "difference"), ("union", "union"), ("symdifference", "symDifference")):
        for x, y, got in zip(a, b, K.overlay_many(a, b, op)):
            want = getattr(jts(x), name)(jts(y))
            assert area(got) == pytest.approx(want.getArea(), abs=1e-7)
            if got[1] and K.dim(got) == 2:
                assert jts(got).symDifference(want).getArea() < 1e-6


def test_relate_against_jts(jts):
    rng = np.random.default_rng(6)
    shapes = [star(rng, hole=i % 3 == 0) for i in range(40)] + [box(i, i, i + 3, i + 2) for i in range(6)]
    lines = [("LINESTRING", [[rng.random((4, 2)) * 10]]) for _ in range(40)] + [("LINESTRING", [[np.array([[0.0, 0.0], [3.0, 0.0], [3.0, 2.0]])]])]
    pairs = [(shapes[i], shapes[j]) for i in range(0, 46, 3) for j in range(0, 46, 5)] + [(l, s) for l in lines for s in shapes[::9]] + list(zip(lines, lines[1:]))
    got = K.relate_many([p[0] for p in pairs], [p[1] for p in pairs])
    for (x, y), m in zip(pairs, got):
        assert m == jts(x).relate(jts(y)).toString()


def test_buffer_against_jts(jts):
    rng = np.random.default_rng(7)
    for g in [star(rng, 8) for _ in range(15)] + [("LINESTRING", [[rng.random((5, 2)) * 10]]) for _ in range(10)]:
        assert area(K.buffer(g, 0.7)) == pytest.approx(jts(g).buffer(0.7, 8).getArea(), rel=5e-3)
    for g in [box(0, 0, 4, 5), star(rng, 6)]:
        assert area(K.buffer(g, -0.3)) == pytest.approx(jts(g).buffer(-0.3, 8).getArea(), rel=2e-2)


def test_area_laws():
    rng = np.random.default_rng(8)
    a, b = [star(rng) for _ in range(60)], [star(rng) for _ in range(60)]
    cut, rest, both = (K.overlay_many(a, b, op) for op in ("intersection", "difference", "union"))
    for x, y, i, d, u in zip(a, b, cut, rest, both):
        assert area(i) + area(d) == pytest.approx(area(x), abs=1e-8)
        assert area(u) == pytest.approx(area(x) + area(y) - area(i), abs=1e-8)
    assert area(K.union_all([K.union_all(a[:30]), K.union_all(a[30:])])) == pytest.approx(area(K.union_all(a)), abs=1e-7)


def test_boundary_contact():
    a = box(0, 0, 2, 2)
    assert K.overlay(a, box(2, 0, 3, 2), "intersection")[0] == "LINESTRING"
    assert K.overlay(a, box(2, 2, 3, 3), "intersection")[0] == "POINT"
    assert K.overlay(a, box(5, 5, 6, 6), "intersection") == ("POLYGON", [])
    assert K.overlay(a, a, "difference")[1] == []
    assert len(K.overlay(box(0, 0, 9, 9), box(1, 1, 2, 2), "difference")[1][0]) == 2


def test_validity_and_repair(jts):
    bow = ("POLYGON", [[np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)]])
    assert K.valid_reason(bow) == "Self-intersection"
    fixed = K.make_valid(bow)
    assert area(fixed) == pytest.approx(2.0) and K.valid_reason(fixed) == "Valid Geometry"
    assert K.valid_reason(box(0, 0, 1, 1)) == "Valid Geometry"
    hole_outside = ("POLYGON", [[box(0, 0, 1, 1)[1][0][0], box(5, 5, 6, 6)[1][0][0]]])
    assert K.valid_reason(hole_outside) == "Hole lies outside shell"
    assert K.valid_reason(("MULTIPOLYGON", [box(0, 0, 9, 9)[1][0], box(1, 1, 2, 2)[1][0]])) == "Nested shells"
    rng = np.random.default_rng(9)
    for _ in range(30):
        ring = rng.random((7, 2)) * 10
        g = ("POLYGON", [[np.vstack([ring, ring[:1]])]])
        got = K.make_valid(g)
        assert jts(got).isValid()


def test_simplify_and_hull(jts):
    rng = np.random.default_rng(10)
    line = ("LINESTRING", [[np.cumsum(rng.random((50, 2)) - 0.3, axis=0)]])
    got = K.simplify(line, 0.5)
    assert 2 <= len(got[1][0][0]) < 50
    pts = rng.random((200, 2))
    h = K.hull(pts)
    assert area(h) == pytest.approx(jts(("LINESTRING", [[pts]])).convexHull().getArea())


def test_concave_hull():
    from cartolith.operators.hulls import concave_hull, delaunay
    rng = np.random.default_rng(11)
    p = rng.random((300, 2))
    t = delaunay(p)
    assert 0.5 * K.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]).sum() == pytest.approx(area(K.hull(p)), rel=1e-6)
    ring = p[np.hypot(*(p - 0.5).T) > 0.3]
    small, with_hole = concave_hull(ring, 0.3, False), concave_hull(ring, 0.2, True)
    assert area(with_hole) < area(small) <= area(K.hull(ring)) + 1e-12
    assert K.valid_reason(small) == "Valid Geometry"


def test_distances(jts):
    a, b = box(0, 0, 1, 1), box(3, 4, 5, 6)
    assert K.shortest_line(a, b)[0] == pytest.approx(np.hypot(2, 3))
    assert K.max_distance(a, b) == pytest.approx(np.hypot(5, 6))
    assert K.shortest_line(a, box(0.5, 0.5, 2, 2))[0] == 0
    spot = K.point_on_surface(("POLYGON", [[box(0, 0, 9, 9)[1][0][0], box(1, 1, 8, 8)[1][0][0]]]))
    assert 0 < spot[0] < 9 and not (1 < spot[0] < 8 and 1 < spot[1] < 8)
