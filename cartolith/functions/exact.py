"""Arrow-batched geometry functions for what column expressions cannot say.

The functions are pure, but marked nondeterministic: that keeps the optimizer from
copying a costly call into a filter and running it twice.  Only ``buffer`` is not, so
that ``area`` of a buffer is taken in the pass that makes it.

Every function takes and returns columns.  Rows whose inputs are NULL cost
nothing, so callers pass NULL for rows that a native expression has answered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from ..layer import GEOM, PARTS, POLYGONAL, geometry, make_box
from . import kernel as K
from .codec import GEOM_T, boxes_of_rings, decode, encode, flat, from_wkb as _from_wkb, one_ring_polygons, points_and_segments, to_wkb as _to_wkb
from .native import is_rect, let


STEP = 2000   # geometries handed to the kernel together


def _steps(run_many, *cols):
    out = []
    for i in range(0, len(cols[0]), STEP):
        out += run_many(*[c[i:i + STEP] for c in cols])
    return out


def _each(fn):
    """Row function as a batch function that passes NULL through."""
    return lambda *cols: [None if any(v is None for v in row) else fn(*row) for row in zip(*cols)]


def _arrow(run_many, returns: str, second: str | None = None):
    """Arrow UDF over (geometry), (geometry, geometry) or (geometry, number)."""
    def pack(vals):
        return encode(vals) if returns == "geom" else pa.array(vals, {"double": pa.float64(), "string": pa.string()}[returns])

    if second is None:
        def run(a: pa.Array) -> pa.Array:
            return pack(_steps(run_many, decode(a)))
    elif second == "geom":
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pack(_steps(run_many, decode(a), decode(b)))
    else:
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pack(_steps(run_many, decode(a), b.to_pylist()))
    return arrow_udf(run, GEOM if returns == "geom" else returns).asNondeterministic()


def _buffers(a: pa.Array, d: pa.Array, rect: pa.Array) -> pa.Array:
    """Buffers of a batch: points, lines of two vertices and rectangles each by one array expression, the others by the kernel, none for NULL."""
    n = len(a)
    if a.null_count == n:
        return pa.nulls(n, GEOM_T)
    by, place, out, done = d.to_numpy(zero_copy_only=False), np.full(n, -1), [], 0
    found = points_and_segments(a)
    boxes = np.flatnonzero(np.asarray(rect) & ~np.asarray(a.is_null()))
    for rings, rows, at, null in ((K.circles, *found["points"]), (K.capsules, *found["segments"]), (K.round_boxes, boxes, boxes_of_rings(a, boxes), np.zeros((len(boxes), 2), bool))):
        grows = by[rows] > 0
        rows, at, null = rows[grows], at[grows], null[grows]
        if len(rows):
            if rings is K.capsules:     # the direction of a line needs all four
                null = np.repeat(null.any(axis=1)[:, None], 2, axis=1)
            out.append(one_ring_polygons(*rings(at, by[rows]), null[:, 0], null[:, 1]))
            place[rows] = done + np.arange(len(rows))
            done += len(rows)
            if len(rows) == n:
                return out[0]
    rest = np.flatnonzero((place < 0) & ~np.asarray(a.is_null()))
    if len(rest):
        place[rest] = done + np.arange(len(rest))
        out.append(encode(_steps(K.buffer_many, decode(a.take(pa.array(rest))), d.take(pa.array(rest)).to_pylist())))
    return pa.concat_arrays(out).take(pa.array(place, mask=place < 0))


def _areas(a: pa.Array) -> pa.Array:
    """``native.area`` of a batch: NULL where a polygon has a NULL in it, 0 for what is no polygon."""
    gtype, parts = a.flatten()
    po, ro, vo, _, x, y = flat(a)
    gone = np.asarray(parts.is_null())
    rings = parts.values
    if rings.null_count or rings.values.null_count or np.isnan(x).any() or np.isnan(y).any():
        xs, ys = rings.values.values.flatten()
        bad = np.cumsum(np.concatenate([[0], np.asarray(xs.is_null()) | np.asarray(ys.is_null())]))
        bad = np.cumsum(np.concatenate([[0], np.diff(bad[vo]) + np.asarray(rings.values.is_null())]))
        bad = np.cumsum(np.concatenate([[0], np.diff(bad[ro]) + np.asarray(rings.is_null())]))
        gone = gone | (np.diff(bad[po]) > 0)
    polygon = np.asarray(pc.fill_null(pc.is_in(gtype, pa.array(POLYGONAL)), False))
    return pa.array(np.where(polygon, K.areas(po, ro, vo, x, y), 0.0), mask=(polygon & gone) | np.asarray(a.is_null()))


def _filled(fn):
    """Pair function that is NULL for empty geometries."""
    return lambda a, b: fn(a, b) if a[1] and b[1] else None


@lru_cache(None)
def _udf(name: str):
    """UDFs are made on first use, when a session exists."""
    if name in ("intersection", "difference", "union", "symdifference"):
        return _arrow(lambda a, b: K.overlay_many(a, b, name), "geom", "geom")
    return {
        "relate": lambda: _arrow(K.relate_many, "string", "geom"),
        "distance": lambda: _arrow(_each(_filled(lambda a, b: K.shortest_line(a, b)[0])), "double", "geom"),
        "max_distance": lambda: _arrow(_each(_filled(K.max_distance)), "double", "geom"),
        "hausdorff": lambda: _arrow(_each(_filled(K.hausdorff)), "double", "geom"),
        "shortest_line": lambda: _arrow(_each(_filled(_shortest)), "geom", "geom"),
        "closest_point": lambda: _arrow(_each(_filled(_closest)), "geom", "geom"),
        "buffer": lambda: arrow_udf(_buffers, GEOM),
        "area": lambda: arrow_udf(_areas, "double").asNondeterministic(),
        "grow_and_shrink": lambda: _arrow(K.grow_and_shrink_many, "geom", "number"),
        "simplify": lambda: _arrow(_each(K.simplify), "geom", "number"),
        "simplify_preserve": lambda: _arrow(_each(lambda g, t: K.simplify(g, t, True)), "geom", "number"),
        "make_valid": lambda: _arrow(K.make_valid_many, "geom"),
        "hull": lambda: _arrow(_each(lambda g: K.hull(_all_vertices(g))), "geom"),
        "surface_point": lambda: _arrow(_each(_surface), "geom"),
        "self_union": lambda: _arrow(lambda a: [None if g is None else u for g, u in zip(a, K.union_many([[g] for g in a]))], "geom"),
        "valid_reason": lambda: _arrow(K.valid_reason_many, "string"),
    }[name]()


def _all_vertices(g):
    import numpy as np
    return np.concatenate([r for p in g[1] for r in p]) if g[1] else np.empty((0, 2))


def _point(p):
    return ("POINT", [[p.reshape(1, 2)]])


def _shortest(a, b):
    import numpy as np
    _, p, q = K.shortest_line(a, b)
    return ("LINESTRING", [[np.vstack([p, q])]])


def _closest(a, b):
    return _point(K.shortest_line(a, b)[1])


def _surface(g):
    p = K.point_on_surface(g)
    return None if p is None else _point(p)


# ---------------------------------------------------------------- overlay

def rect_intersection(abox: Column, bbox: Column) -> Column:
    """Intersection of two axis-aligned rectangles of positive size that touch at least."""
    x0, x1 = F.greatest(abox["xmin"], bbox["xmin"]), F.least(abox["xmax"], bbox["xmax"])
    y0, y1 = F.greatest(abox["ymin"], bbox["ymin"]), F.least(abox["ymax"], bbox["ymax"])

    flat_x, flat_y = x0 == x1, y0 == y1
    name = F.when(flat_x & flat_y, "POINT").when(flat_x | flat_y, "LINESTRING").otherwise("POLYGON")
    box = make_box(x0, y0, x1, y1)["parts"][0][0]
    ring = F.when(flat_x & flat_y, F.slice(box, 1, 1)).when(flat_x | flat_y, F.array(box[0], box[2])).otherwise(box)
    apart = (x0 > x1) | (y0 > y1)
    return geometry(F.when(apart, "POLYGON").otherwise(name), F.when(apart, F.array().cast(PARTS)).otherwise(F.array(F.array(ring))))


def _unless(done: Column, geom: Column) -> Column:
    return F.when(~done, geom)


def intersection(a: Column, b: Column, abox: Column | None = None, bbox: Column | None = None, quick: Column | bool | None = None) -> Column:
    """Intersection; rectangles are answered by column arithmetic when boxes are given.

    ``quick`` tells which rows are pairs of rectangles (True: all of them)."""
    if abox is None or bbox is None:
        return _udf("intersection")(a, b)
    if quick is True:
        return rect_intersection(abox, bbox)
    if quick is None:
        quick = is_rect(a, abox) & is_rect(b, bbox)
    return F.when(quick, rect_intersection(abox, bbox)).otherwise(_udf("intersection")(_unless(quick, a), _unless(quick, b)))


def difference(a: Column, b: Column) -> Column:
    return _udf("difference")(a, b)


def union(a: Column, b: Column) -> Column:
    return _udf("union")(a, b)


def sym_difference(a: Column, b: Column) -> Column:
    return _udf("symdifference")(a, b)


def relate(a: Column, b: Column) -> Column:
    """DE-9IM matrix text."""
    return _udf("relate")(a, b)


# DE-9IM patterns of the named predicates (OGC Simple Features).
# Keys that depend on the dimensions list one pattern set per pair of dimensions.
PATTERNS = {
    "intersects": ["T********", "*T*******", "***T*****", "****T****"],
    "disjoint": ["FF*FF****"],
    "contains": ["T*****FF*"],
    "within": ["T*F**F***"],
    "covers": ["T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"],
    "coveredby": ["T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"],
    "containsproperly": ["T**FF*FF*"],
    "equals": ["T*F**FFF*"],
    "touches": ["FT*******", "F**T*****", "F***T****"],
}


def pattern_regex(pattern: str) -> str:
    return "^" + pattern.upper().replace("*", ".").replace("T", "[012]") + "$"


def matches(matrix: Column, pattern: str) -> Column:
    return matrix.rlike(pattern_regex(pattern))


def predicate_from_matrix(matrix: Column, name: str, da: Column, db: Column) -> Column:
    def any_of(patterns):
        out = F.lit(False)
        for p in patterns:
            out = out | matches(matrix, p)
        return out

    if name == "overlaps":
        same = F.when(da == 1, matches(matrix, "1*T***T**")).otherwise(matches(matrix, "T*T***T**"))
        return F.when(da == db, same).otherwise(F.lit(False))
    if name == "crosses":
        return (F.when(da < db, matches(matrix, "T*T******")).when(da > db, matches(matrix, "T*****T**"))
                .when(da == 1, matches(matrix, "0********")).otherwise(F.lit(False)))
    if name == "touches":
        return F.when((da == 0) & (db == 0), F.lit(False)).otherwise(any_of(PATTERNS[name]))
    return any_of(PATTERNS[name])


def rect_predicate(name: str, a: Column, b: Column) -> Column:
    """Named predicate on two rectangles of positive size."""
    meet = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    open_ = (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])

    def has(p, q):
        return (p["xmin"] <= q["xmin"]) & (p["xmax"] >= q["xmax"]) & (p["ymin"] <= q["ymin"]) & (p["ymax"] >= q["ymax"])

    strict = (a["xmin"] < b["xmin"]) & (a["xmax"] > b["xmax"]) & (a["ymin"] < b["ymin"]) & (a["ymax"] > b["ymax"])
    return {"intersects": meet, "disjoint": ~meet, "contains": has(a, b), "covers": has(a, b), "within": has(b, a),
            "coveredby": has(b, a), "containsproperly": strict, "equals": has(a, b) & has(b, a),
            "touches": meet & ~open_, "overlaps": open_ & ~has(a, b) & ~has(b, a), "crosses": F.lit(False)}[name]


def _pair_eps(a: Column, b: Column) -> Column:
    """The kernel's tolerance for a pair, from its boxes."""
    x0, y0, x1, y1 = (f(a[k], b[k]) for f, k in ((F.least, "xmin"), (F.least, "ymin"), (F.greatest, "xmax"), (F.greatest, "ymax")))
    big = F.greatest(*[F.abs(v) for v in (x0, y0, x1, y1)])
    return F.greatest(x1 - x0, y1 - y0, big * 1e-4, F.lit(1e-290)) * K.REL_EPS


def _stretch(s: Column, by: Column) -> tuple[Column, Column]:
    """Shares of a segment between which it lies in a box grown by ``by``; the first is larger when it misses it."""
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for k in "xy":
        at, to, least, most = s["p"][k], s["q"][k], s["box"][k + "min"] - by, s["box"][k + "max"] + by
        u, v = (least - at) / F.nullif(to - at, F.lit(0.0)), (most - at) / F.nullif(to - at, F.lit(0.0))
        lo.append(F.when(to == at, F.when((at >= least) & (at <= most), 0.0).otherwise(2.0)).otherwise(F.least(u, v)))
        hi.append(F.when(to == at, F.lit(1.0)).otherwise(F.greatest(u, v)))
    return F.greatest(*lo), F.least(*hi)


def _segment_and_rect(line: Column, lbox: Column, box: Column) -> Column:
    v = line["parts"][0][0]
    return F.struct(v[0].alias("p"), v[1].alias("q"), lbox.alias("lbox"), box.alias("box"), _pair_eps(lbox, box).alias("eps"))


SEGMENT_RECT = ("crosses", "intersects", "touches", "within", "coveredby")


def segment_rect_predicate(name: str, line: Column, lbox: Column, box: Column) -> Column:
    """Named predicate of a line of two vertices and a rectangle: what lies deeper than the tolerance counts as inside or outside."""
    def test(s):
        l, b, eps = s["lbox"], s["box"], s["eps"]
        meets, enters = (lambda t: t[0] <= t[1])(_stretch(s, eps)), (lambda t: t[0] < t[1])(_stretch(s, -eps))
        leaves = (l["xmin"] < b["xmin"] - eps) | (l["ymin"] < b["ymin"] - eps) | (l["xmax"] > b["xmax"] + eps) | (l["ymax"] > b["ymax"] + eps)
        return {"crosses": leaves & enters, "intersects": meets, "touches": meets & ~enters, "within": enters & ~leaves, "coveredby": ~leaves}[name]

    return let(_segment_and_rect(line, lbox, box), test)


def segment_rect_intersection(line: Column, lbox: Column, box: Column) -> Column:
    """Part of a line of two vertices in a rectangle: a line, a point where it is no longer than the tolerance, or nothing."""
    v = line["parts"][0][0]
    s, p, q, eps = {"p": v[0], "q": v[1], "box": box}, v[0], v[1], _pair_eps(lbox, box)
    (near0, near1), (t0, t1) = _stretch(s, eps), _stretch(s, F.lit(0.0))
    place = lambda t: F.when(t <= 0, p).when(t >= 1, q).otherwise(F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")))
    long = (t1 - t0) * F.hypot(q["x"] - p["x"], q["y"] - p["y"]) > eps
    ring = F.when(long, F.array(place(t0), place(t1))).otherwise(F.array(place((near0 + near1) / 2)))
    miss = near0 > near1
    return geometry(F.when(long | miss, "LINESTRING").otherwise("POINT"), F.when(miss, F.array().cast(PARTS)).otherwise(F.array(F.array(ring))))


def point_polygon_predicate(name: str, loc: Column, point_first: bool) -> Column:
    """Named predicate of a point and a polygon from the location of the point."""
    no, on_or_in = F.lit(False), loc >= 0
    if name in ("intersects", "disjoint", "touches"):
        return {"intersects": on_or_in, "disjoint": ~on_or_in, "touches": loc == 0}[name]
    if point_first:
        return {"within": loc == 1, "coveredby": on_or_in}.get(name, no)
    return {"contains": loc == 1, "covers": on_or_in, "containsproperly": loc == 1}.get(name, no)


def rect_point_location(box: Column, x: Column, y: Column) -> Column:
    outside = (x < box["xmin"]) | (x > box["xmax"]) | (y < box["ymin"]) | (y > box["ymax"])
    inside = (x > box["xmin"]) & (x < box["xmax"]) & (y > box["ymin"]) & (y < box["ymax"])
    return F.when(outside, -1).when(inside, 1).otherwise(0)


# ---------------------------------------------------------------- measures

def box_distance(p: Column, q: Column) -> Column:
    """Distance of points and rectangles by their boxes."""
    gap = lambda k: F.greatest(F.lit(0.0), p[k + "min"] - q[k + "max"], q[k + "min"] - p[k + "max"])
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))


def box_max_distance(p: Column, q: Column) -> Column:
    """Distance of the farthest places of points and rectangles by their boxes."""
    return F.sqrt(F.pow(F.greatest(p["xmax"] - q["xmin"], q["xmax"] - p["xmin"]), 2) + F.pow(F.greatest(p["ymax"] - q["ymin"], q["ymax"] - p["ymin"]), 2))


def distance(a: Column, b: Column, points_only: bool = False, abox: Column | None = None, bbox: Column | None = None, quick: bool = False) -> Column:
    """Distance; two points are answered natively, and by their boxes what ``quick`` tells to be points and rectangles in all rows."""
    if quick:
        return box_distance(abox, bbox)
    from .native import point_distance, vertices
    both = F.coalesce((a["gtype"] == "POINT") & (b["gtype"] == "POINT") & (F.size(a["parts"]) == 1) & (F.size(b["parts"]) == 1), F.lit(False))
    va, vb = vertices(a), vertices(b)
    native = point_distance(va[0]["x"], va[0]["y"], vb[0]["x"], vb[0]["y"])
    if points_only:
        return F.when(both, native)
    return F.when(both, native).otherwise(_udf("distance")(_unless(both, a), _unless(both, b)))


def max_distance(a: Column, b: Column, abox: Column | None = None, bbox: Column | None = None, quick: bool = False) -> Column:
    return box_max_distance(abox, bbox) if quick else _udf("max_distance")(a, b)


def hausdorff_distance(a: Column, b: Column) -> Column:
    return _udf("hausdorff")(a, b)


def shortest_line(a: Column, b: Column) -> Column:
    return _udf("shortest_line")(a, b)


def closest_point(a: Column, b: Column) -> Column:
    """Point of ``a`` that is nearest to ``b``."""
    return _udf("closest_point")(a, b)


def area(geom: Column) -> Column:
    """``native.area`` by array arithmetic on batches: the same numbers, for many rows of long rings."""
    return _udf("area")(geom)


# ---------------------------------------------------------------- shapes

def buffer(geom: Column, d, box: Column | None = None) -> Column:
    """Round buffer, by array arithmetic on batches for points, lines of two vertices and, when a box is given, rectangles."""
    d = d if isinstance(d, Column) else F.lit(float(d))
    return _udf("buffer")(geom, d.cast("double"), is_rect(geom, box) if box is not None else F.lit(False))


def grow_and_shrink(geom: Column, d: float = 0.001) -> Column:
    return _udf("grow_and_shrink")(geom, F.lit(float(d)))


def make_valid(geom: Column) -> Column:
    return _udf("make_valid")(geom)


def valid_reason(geom: Column) -> Column:
    return _udf("valid_reason")(geom)


def is_valid(geom: Column) -> Column:
    return valid_reason(geom) == "Valid Geometry"


def simplify(geom: Column, tolerance: float, preserve: bool = False) -> Column:
    return _udf("simplify_preserve" if preserve else "simplify")(geom, F.lit(float(tolerance)))


def convex_hull(geom: Column) -> Column:
    return _udf("hull")(geom)


def point_on_surface(geom: Column) -> Column:
    return _udf("surface_point")(geom)


def self_union(geom: Column) -> Column:
    """Dissolve the parts of one geometry (node lines, merge polygons)."""
    return _udf("self_union")(geom)


@lru_cache(None)
def _wkb_udfs():
    def enc(a: pa.Array) -> pa.Array:
        return pa.array([_to_wkb(g) for g in decode(a)], pa.binary())

    def dec(a: pa.Array) -> pa.Array:
        return encode([_from_wkb(b) for b in a.to_pylist()])

    return arrow_udf(enc, "binary"), arrow_udf(dec, GEOM)


def as_wkb(geom: Column) -> Column:
    return _wkb_udfs()[0](geom)


def from_wkb(data: Column) -> Column:
    return _wkb_udfs()[1](data)
