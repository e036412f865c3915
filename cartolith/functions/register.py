"""SQL names for the geometry functions.

Functions with a short expression become SQL-language functions, which Spark
inlines into the plan; the others are Arrow functions.  ``st_dump`` is a table
function."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from ..layer import GEOM, RING
from . import kernel as K
from .codec import GEOM_T, VERTEX_T, decode, encode, from_wkb, points_and_segments, to_wkb
from .exact import PATTERNS, _all_vertices, _closest, _each, _filled, _shortest, _steps, _surface, pattern_regex

_V = "flatten(flatten(g.parts))"
_RING_AREA = ("aggregate(r, named_struct('s', 0D, 'px', r[0].x, 'py', r[0].y), (a, v) -> named_struct('s', a.s + (a.px - r[0].x) * (v.y - r[0].y) "
              "- (v.x - r[0].x) * (a.py - r[0].y), 'px', v.x, 'py', v.y), a -> abs(a.s) / 2)")
_LINE = ("aggregate(r, named_struct('s', 0D, 'px', r[0].x, 'py', r[0].y), (a, v) -> named_struct('s', a.s + hypot(v.x - a.px, v.y - a.py), "
         "'px', v.x, 'py', v.y), a -> a.s)")

_TWO = "size(g.parts) = 1 AND size(get(g.parts, 0)) = 1 AND size(get(get(g.parts, 0), 0)) = 2"   # one line of two vertices, which needs no loop
_X1, _Y1, _X2, _Y2 = (f"get(get(get(g.parts, 0), 0), {i}).{k}" for i in (0, 1) for k in "xy")


def _point(x, y):
    return f"named_struct('x', {x}, 'y', {y})"


def _moved(x, y):
    """Every vertex v moved to (x, y)."""
    return f"CASE WHEN g IS NOT NULL THEN named_struct('gtype', g.gtype, 'parts', transform(g.parts, p -> transform(p, r -> transform(r, v -> {_point(x, y)})))) END"


def _rings(body):
    """Every ring r changed."""
    return f"CASE WHEN g IS NOT NULL THEN named_struct('gtype', g.gtype, 'parts', transform(g.parts, p -> transform(p, r -> {body}))) END"


def _spot(v):
    """A vertex as a point; NULL stays."""
    return f"CASE WHEN {v} IS NOT NULL THEN named_struct('gtype', 'POINT', 'parts', array(array(array({v})))) END"


_LINE_V = "CASE WHEN g.gtype = 'LINESTRING' THEN g.parts[0][0] END"
_ENVELOPE = ("named_struct('gtype', 'POLYGON', 'parts', array(array(array(" + ", ".join(
    _point(f"array_{a}(transform({_V}, v -> v.x))", f"array_{b}(transform({_V}, v -> v.y))") for a, b in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min"))) + "))))")
_TEXT_V = "concat(regexp_replace(CAST(v.x AS STRING), '[.]0$', ''), ' ', regexp_replace(CAST(v.y AS STRING), '[.]0$', ''))"
_TEXT_R = f"concat('(', array_join(transform(r, v -> {_TEXT_V}), ','), ')')"
_TEXT = (f"CASE WHEN g IS NULL THEN NULL WHEN size(g.parts) = 0 THEN concat(g.gtype, ' EMPTY') "
         f"WHEN g.gtype = 'MULTIPOLYGON' THEN concat(g.gtype, '(', array_join(transform(g.parts, p -> concat('(', array_join(transform(p, r -> {_TEXT_R}), ','), ')')), ','), ')') "
         f"WHEN g.gtype = 'POLYGON' THEN concat(g.gtype, '(', array_join(transform(g.parts[0], r -> {_TEXT_R}), ','), ')') "
         f"WHEN g.gtype LIKE 'MULTI%' THEN concat(g.gtype, '(', array_join(transform(flatten(g.parts), r -> {_TEXT_R}), ','), ')') "
         f"ELSE concat(g.gtype, {_TEXT_R.replace('(r,', '(g.parts[0][0],')}) END")
_TYPE = "regexp_extract(regexp_replace(upper(trim(t)), r'^SRID=\d+;\s*', ''), '^([A-Z]+)', 1)"
_BODY = "regexp_replace(regexp_replace(upper(trim(t)), r'^SRID=\d+;\s*', ''), r'^[A-Z]+\s*', '')"
_NUMBER = r"(-?[0-9.]+(?:E[-+]?[0-9]+)?)"
_NESTED = rf"regexp_replace(translate(regexp_replace({_BODY}, r'{_NUMBER}\s+{_NUMBER}', '[$1,$2]'), '()', '[]'), r'(?<=[\[,-])\.', '0.')"   # WKT as nested JSON arrays
_V_OF_C = "c -> named_struct('x', c[0], 'y', c[1])"
_FROM_TEXT = (f"CASE WHEN t IS NULL THEN NULL WHEN {_TYPE} NOT IN ('POINT', 'MULTIPOINT', 'LINESTRING', 'MULTILINESTRING', 'POLYGON', 'MULTIPOLYGON') THEN raise_error('unsupported geometry type: ' || {_TYPE}) "
              f"ELSE named_struct('gtype', {_TYPE}, 'parts', CASE WHEN {_BODY} = 'EMPTY' THEN CAST(array() AS array<array<{RING}>>) "
              f"WHEN {_TYPE} IN ('POINT', 'LINESTRING') THEN array(array(transform(from_json({_NESTED}, 'array<array<double>>'), {_V_OF_C}))) "
              rf"WHEN {_TYPE} = 'MULTIPOINT' THEN transform(regexp_extract_all({_NESTED}, r'\[([^\[\],]+,[^\[\],]+)\]', 1), w -> array(array(named_struct('x', CAST(split(w, ',')[0] AS DOUBLE), 'y', CAST(split(w, ',')[1] AS DOUBLE))))) "
              f"WHEN {_TYPE} = 'MULTILINESTRING' THEN transform(from_json({_NESTED}, 'array<array<array<double>>>'), r -> array(transform(r, {_V_OF_C}))) "
              f"WHEN {_TYPE} = 'POLYGON' THEN array(transform(from_json({_NESTED}, 'array<array<array<double>>>'), r -> transform(r, {_V_OF_C}))) "
              f"ELSE transform(from_json({_NESTED}, 'array<array<array<array<double>>>>'), p -> transform(p, r -> transform(r, {_V_OF_C}))) END) END")
_PAIR = "v -> array(v.x, v.y)"
# The type names of GeoJSON.
_JSON_NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
_JSON = ("CASE WHEN g IS NOT NULL THEN concat('{\"type\":\"', CASE g.gtype " + " ".join(f"WHEN '{n.upper()}' THEN '{n}'" for n in _JSON_NAMES) + " END, '\",\"coordinates\":', CASE WHEN size(g.parts) = 0 THEN '[]' "
         f"WHEN g.gtype = 'POINT' THEN to_json(transform(g.parts[0][0], {_PAIR})[0]) WHEN g.gtype IN ('LINESTRING', 'MULTIPOINT') THEN to_json(transform({_V}, {_PAIR})) "
         f"WHEN g.gtype = 'MULTIPOLYGON' THEN to_json(transform(g.parts, p -> transform(p, r -> transform(r, {_PAIR})))) ELSE to_json(transform(flatten(g.parts), r -> transform(r, {_PAIR}))) END, '}}') END").replace("'}}'", "'}'")
_LAST = "element_at(s, -1)"
_PIECES = f"greatest(CAST(ceil(hypot(v.x - {_LAST}.x, v.y - {_LAST}.y) / d) AS INT), 1)"
_STEP = "CASE WHEN i = n THEN v ELSE " + _point(f"{_LAST}.x + (v.x - {_LAST}.x) * i / n", f"{_LAST}.y + (v.y - {_LAST}.y) * i / n") + " END"
_SEGMENTIZED = f"aggregate(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1), (s, v) -> concat(s, flatten(transform(array({_PIECES}), n -> transform(sequence(1, n), i -> {_STEP})))))"

# name -> (parameters, result type, expression)
INLINE = {
    "st_geometrytype": (f"g {GEOM}", "STRING", "g.gtype"),
    "st_npoints": (f"g {GEOM}", "INT", f"size({_V})"),
    "st_numgeometries": (f"g {GEOM}", "INT", "size(g.parts)"),
    "st_numinteriorrings": (f"g {GEOM}", "INT", "size(flatten(g.parts)) - size(g.parts)"),
    "st_isempty": (f"g {GEOM}", "BOOLEAN", "size(g.parts) = 0"),
    "st_x": (f"g {GEOM}", "DOUBLE", "CASE WHEN g.gtype = 'POINT' THEN g.parts[0][0][0].x END"),
    "st_y": (f"g {GEOM}", "DOUBLE", "CASE WHEN g.gtype = 'POINT' THEN g.parts[0][0][0].y END"),
    "st_xmin": (f"g {GEOM}", "DOUBLE", f"array_min(transform({_V}, v -> v.x))"),
    "st_xmax": (f"g {GEOM}", "DOUBLE", f"array_max(transform({_V}, v -> v.x))"),
    "st_ymin": (f"g {GEOM}", "DOUBLE", f"array_min(transform({_V}, v -> v.y))"),
    "st_ymax": (f"g {GEOM}", "DOUBLE", f"array_max(transform({_V}, v -> v.y))"),
    "st_area": (f"g {GEOM}", "DOUBLE", "CASE WHEN g.gtype LIKE '%POLYGON' THEN aggregate(g.parts, 0D, (t, p) -> t + 2 * "
                + _RING_AREA.replace("r[0]", "p[0][0]").replace("aggregate(r,", "aggregate(p[0],")
                + " - aggregate(p, 0D, (u, r) -> u + " + _RING_AREA + ")) WHEN g IS NOT NULL THEN 0D END"),
    "st_length": (f"g {GEOM}", "DOUBLE", f"CASE WHEN g.gtype LIKE '%LINESTRING' AND {_TWO} THEN hypot({_X2} - {_X1}, {_Y2} - {_Y1}) "
                  "WHEN g.gtype LIKE '%LINESTRING' THEN aggregate(flatten(g.parts), 0D, (t, r) -> t + " + _LINE + ") WHEN g IS NOT NULL THEN 0D END"),
    "st_perimeter": (f"g {GEOM}", "DOUBLE", "CASE WHEN g.gtype LIKE '%POLYGON' THEN aggregate(flatten(g.parts), 0D, (t, r) -> t + " + _LINE + ") WHEN g IS NOT NULL THEN 0D END"),
    "st_makepoint": ("px DOUBLE, py DOUBLE", GEOM, f"named_struct('gtype', 'POINT', 'parts', array(array(array({_point('px', 'py')}))))"),
    "st_makeenvelope": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", GEOM,
                        "named_struct('gtype', 'POLYGON', 'parts', array(array(array(" + ", ".join(
                            _point(*c) for c in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))) + "))))"),
    "st_makeline": (f"pts {RING}", GEOM, "named_struct('gtype', 'LINESTRING', 'parts', array(array(pts)))"),
    "st_startpoint": (f"g {GEOM}", GEOM, _spot(f"get({_LINE_V}, 0)")),
    "st_endpoint": (f"g {GEOM}", GEOM, _spot(f"get({_LINE_V}, size({_LINE_V}) - 1)")),
    "st_pointn": (f"g {GEOM}, n INT", GEOM, _spot(f"get({_LINE_V}, n - 1)")),
    "st_isclosed": (f"g {GEOM}", "BOOLEAN", "CASE WHEN g.gtype LIKE '%LINESTRING' THEN forall(flatten(g.parts), r -> r[0] = element_at(r, -1)) WHEN g IS NOT NULL THEN true END"),
    "st_envelope": (f"g {GEOM}", GEOM, f"CASE WHEN size(g.parts) > 0 THEN {_ENVELOPE} END"),
    "st_exteriorring": (f"g {GEOM}", GEOM, "CASE WHEN g.gtype = 'POLYGON' AND size(g.parts) > 0 THEN named_struct('gtype', 'LINESTRING', 'parts', array(array(g.parts[0][0]))) END"),
    "st_translate": (f"g {GEOM}, dx DOUBLE, dy DOUBLE", GEOM, _moved("v.x + dx", "v.y + dy")),
    "st_scale": (f"g {GEOM}, fx DOUBLE, fy DOUBLE", GEOM, _moved("v.x * fx", "v.y * fy")),
    "st_rotate": (f"g {GEOM}, angle DOUBLE", GEOM, _moved("v.x * cos(angle) - v.y * sin(angle)", "v.x * sin(angle) + v.y * cos(angle)")),
    "st_affine": (f"g {GEOM}, a DOUBLE, b DOUBLE, d DOUBLE, e DOUBLE, xoff DOUBLE, yoff DOUBLE", GEOM, _moved("v.x * a + v.y * b + xoff", "v.x * d + v.y * e + yoff")),
    "st_reverse": (f"g {GEOM}", GEOM, _rings("reverse(r)")),
    "st_snaptogrid": (f"g {GEOM}, size DOUBLE", GEOM, _rings(
        "aggregate(transform(r, v -> " + _point("rint(v.x / size) * size", "rint(v.y / size) * size") + f"), CAST(array() AS {RING}), (s, v) -> CASE WHEN get(s, size(s) - 1) <=> v THEN s ELSE concat(s, array(v)) END)")),
    "st_multi": (f"g {GEOM}", GEOM, "CASE WHEN g.gtype LIKE 'MULTI%' THEN g WHEN g IS NOT NULL THEN named_struct('gtype', concat('MULTI', g.gtype), 'parts', g.parts) END"),
    "st_azimuth": (f"a {GEOM}, b {GEOM}", "DOUBLE", "CASE WHEN a.parts[0][0][0] <> b.parts[0][0][0] THEN pmod(atan2(b.parts[0][0][0].x - a.parts[0][0][0].x, b.parts[0][0][0].y - a.parts[0][0][0].y), 2 * pi()) END"),
    "st_geomfromtext": ("t STRING", GEOM, _FROM_TEXT),
    "st_asgeojson": (f"g {GEOM}", "STRING", _JSON),
    "st_segmentize": (f"g {GEOM}, d DOUBLE", GEOM, "CASE WHEN g.gtype LIKE '%POINT' THEN g ELSE " + _rings(_SEGMENTIZED) + " END"),
    "st_astext": (f"g {GEOM}", "STRING", _TEXT),
    "st_point": ("px DOUBLE, py DOUBLE", GEOM, f"named_struct('gtype', 'POINT', 'parts', array(array(array({_point('px', 'py')}))))"),
    "st_distance_sphere": (f"a {GEOM}, b {GEOM}", "DOUBLE",
                           "2 * 6371008.7714150598D * asin(least(1D, sqrt(pow(sin(radians(b.parts[0][0][0].y - a.parts[0][0][0].y) / 2), 2) "
                           "+ cos(radians(a.parts[0][0][0].y)) * cos(radians(b.parts[0][0][0].y)) * pow(sin(radians(b.parts[0][0][0].x - a.parts[0][0][0].x) / 2), 2))))"),
}

# Older spellings that differ by more than letter case (Spark names ignore case).
ALIASES = {"st_cisjoint": "st_disjoint"}


def _pairs(fn_many, t):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        vals = _steps(fn_many, decode(a), decode(b))
        return encode(vals) if t is None else pa.array(vals, t)

    return run


def _ones(fn_many, t):
    def run(a: pa.Array) -> pa.Array:
        vals = _steps(fn_many, decode(a))
        return encode(vals) if t is None else pa.array(vals, t)

    return run


def _numbered(fn_many):
    def run(a: pa.Array, d: pa.Array) -> pa.Array:
        return encode(_steps(fn_many, decode(a), d.cast(pa.float64()).to_pylist()))   # a literal such as 0.5 is a decimal

    return run


def _predicate(name):
    tests = [re.compile(pattern_regex(p)) for p in PATTERNS[name]]
    return lambda a, b: [None if m is None else any(t.match(m) for t in tests) for m in K.relate_many(a, b)]


# Patterns of the predicates that depend on the dimensions (first lower, first higher, two lines, else).
BY_DIMENSION = {"overlaps": (None, None, "1*T***T**", "T*T***T**"), "crosses": ("T*T******", "T*****T**", "0********", None)}


def _relation(name):
    lower, higher, lines, same = BY_DIMENSION[name]

    def one(m, da, db):
        pattern = lower if da < db else higher if da > db else lines if da == 1 else same
        return pattern is not None and bool(re.match(pattern_regex(pattern), m))

    return lambda a, b: [None if m is None else one(m, K.dim(x), K.dim(y)) for m, x, y in zip(K.relate_many(a, b), a, b)]


def _centroid(g):
    """Weighted by area, else by length, else by points."""
    if not g[1]:
        return None
    w = total = 0.0
    if K.dim(g) == K.POLY:
        for part in g[1]:
            for i, r in enumerate(part):
                a, b = r[:-1] - r[0], r[1:] - r[0]
                c = K.cross(a, b)
                side = (1 if c.sum() > 0 else -1) * (-1 if i else 1)
                w, total = w + side * c.sum() / 2, total + side * ((a + b) * c[:, None]).sum(axis=0) / 6 + side * c.sum() / 2 * r[0]
    elif K.dim(g) == K.LINE:
        for part in g[1]:
            n = np.hypot(*np.diff(part[0], axis=0).T)
            w, total = w + n.sum(), total + ((part[0][:-1] + part[0][1:]) / 2 * n[:, None]).sum(axis=0)
    if w == 0:
        v = _all_vertices(g)
        w, total = len(v), v.sum(axis=0)
    return ("POINT", [[np.array([total / w])]])


def _simple(g):
    """Points that differ; a line whose noded form is one chain of its length; any polygon."""
    if K.dim(g) == K.POINT:
        v = _all_vertices(g)
        return len(np.unique(v, axis=0)) == len(v)
    if K.dim(g) == K.POLY or not g[1]:
        return True
    if len(g[1]) == 1 and len(g[1][0][0]) == 2:   # two vertices apart leave no room for a crossing
        v = g[1][0][0]
        if np.hypot(*(v[1] - v[0])) > 1e-6 * np.abs(v).max():
            return True
    u = K.union_many([[g]])[0]
    size = lambda h: sum(float(np.hypot(*np.diff(r, axis=0).T).sum()) for p in h[1] for r in p)
    return len(u[1]) == len(g[1]) and abs(size(u) - size(g)) <= 1e-9 * max(size(g), 1e-300)


def _along(line):
    """Distance of each vertex from the start."""
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])


def _at(line, m, where):
    return np.array([np.interp(where, m, line[:, 0]), np.interp(where, m, line[:, 1])])


def _interpolated(g, f):
    line = g[1][0][0] if g[0] == "LINESTRING" and g[1] else None
    return None if line is None or not 0 <= f <= 1 else ("POINT", [[_at(line, _along(line), f * _along(line)[-1])[None]]])


def _located(g, p):
    """Share of the line's length at the place nearest to the point (the first of several)."""
    if g[0] != "LINESTRING" or p[0] != "POINT":
        return None
    line, q, m = g[1][0][0], p[1][0][0][0], _along(g[1][0][0])
    a, d = line[:-1], np.diff(line, axis=0)
    n = (d * d).sum(axis=1)
    t = np.clip(((q - a) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
    k = int(np.argmin(np.hypot(*(a + t[:, None] * d - q).T)))
    return float((m[k] + t[k] * (m[k + 1] - m[k])) / m[-1]) if m[-1] > 0 else 0.0


def _between(g, lo, hi):
    if g[0] != "LINESTRING" or not 0 <= lo <= hi <= 1:
        return None
    line, m = g[1][0][0], _along(g[1][0][0])
    a, b = lo * m[-1], hi * m[-1]
    if a == b:
        return ("POINT", [[_at(line, m, a)[None]]])
    return ("LINESTRING", [[np.vstack([_at(line, m, a), line[(m > a) & (m < b)], _at(line, m, b)])]])


def _straight(g: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of two vertices in a batch: their rows, their coordinates (x1, y1, x2, y2), all finite, and their lengths above 0."""
    rows, v, no = points_and_segments(g)["segments"]
    n = np.hypot(v[:, 2] - v[:, 0], v[:, 3] - v[:, 1])
    keep = np.isfinite(v).all(axis=1) & np.isfinite(n) & (n > 0) & ~no.any(axis=1)
    return rows[keep], v[keep], n[keep]


def _with_rest(g: pa.Array, rows: np.ndarray, made: pa.Array, slow, *args: pa.Array) -> pa.Array:
    """Results ``made`` for the rows named, none for NULL geometries, those of ``slow`` for the others."""
    todo = np.asarray(g.is_valid())
    todo[rows] = False
    rest = np.flatnonzero(todo)
    if len(rows) == len(g):
        return made
    other = slow(*[a.take(pa.array(rest)) for a in (g, *args)]) if len(rest) else made[:0]
    at = np.full(len(g), -1)
    at[np.concatenate([rows, rest])] = np.arange(len(rows) + len(rest))
    return pa.concat_arrays([made, other]).take(pa.array(at, mask=at < 0))


def _place(v: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Places at the distance m along lines of two vertices, as ``_at``."""
    there = (v[:, 2:] - v[:, :2]) / n[:, None] * m[:, None] + v[:, :2]
    return np.where((m >= n)[:, None], v[:, 2:], there)


def _as_lines(gtype: str, xy: np.ndarray) -> pa.Array:
    """Geometries of as many vertices each as the second axis of ``xy`` has."""
    k, m = xy.shape[:2]
    v = pa.StructArray.from_arrays([pa.array(xy[:, :, i].ravel()) for i in (0, 1)], fields=list(VERTEX_T))
    each = pa.array(np.arange(k + 1), pa.int32())
    parts = pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * m, pa.int32()), v)))
    return pa.StructArray.from_arrays([pa.array([gtype] * k, pa.string()), parts], fields=list(GEOM_T))


def _numbers(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)   # a literal such as 0.5 is a decimal


def _interpolate_all(g: pa.Array, f: pa.Array) -> pa.Array:
    """``_interpolated`` for a batch: lines of two vertices by array arithmetic."""
    rows, v, n = _straight(g)
    at = _numbers(f)[rows]
    ok = (at >= 0) & (at <= 1)
    xy = _place(v[ok], n[ok], at[ok] * n[ok])
    return _with_rest(g, rows[ok], _as_lines("POINT", xy[:, None, :]), _numbered(_each(_interpolated)), f)


def _locate_all(g: pa.Array, p: pa.Array) -> pa.Array:
    """``_located`` for a batch."""
    rows, v, n = _straight(g)
    spots, q, no = points_and_segments(p)["points"]
    q = q[np.isfinite(q).all(axis=1) & ~no.any(axis=1)], spots[np.isfinite(q).all(axis=1) & ~no.any(axis=1)]
    both, i, j = np.intersect1d(rows, q[1], assume_unique=True, return_indices=True)
    a, d, n = v[i, :2], v[i, 2:] - v[i, :2], n[i]
    size = (d * d).sum(axis=1)
    t = np.clip(((q[0][j] - a) * d).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
    return _with_rest(g, both, pa.array(t * n / n, pa.float64()), _pairs(_each(_located), pa.float64()), p)


def _substring_all(g: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """``_between`` for a batch."""
    def slow(g: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        return encode(_each(_between)(decode(g), lo.cast(pa.float64()).to_pylist(), hi.cast(pa.float64()).to_pylist()))

    rows, v, n = _straight(g)
    one, two = _numbers(lo)[rows], _numbers(hi)[rows]
    ok = (one >= 0) & (one <= two) & (two <= 1) & (one * n < two * n)
    rows, v, n, one, two = rows[ok], v[ok], n[ok], one[ok], two[ok]
    return _with_rest(g, rows, _as_lines("LINESTRING", np.stack([_place(v, n, one * n), _place(v, n, two * n)], axis=1)), slow, lo, hi)


def _ring(g):
    return g[0] == "LINESTRING" and bool(g[1]) and bool((g[1][0][0][0] == g[1][0][0][-1]).all()) and _simple(g)


def _simple_all(g: pa.Array) -> pa.Array:
    """``_simple`` for a batch."""
    rows, v, n = _straight(g)
    rows = rows[n > 1e-6 * np.abs(v).max(axis=1)] if len(rows) else rows   # as in _simple
    return _with_rest(g, rows, pa.array(np.ones(len(rows), bool)), _ones(_each(_simple), pa.bool_()))


def _ring_all(g: pa.Array) -> pa.Array:
    """``_ring`` for a batch."""
    rows = _straight(g)[0]   # two vertices apart
    return _with_rest(g, rows, pa.array(np.zeros(len(rows), bool)), _ones(_each(_ring), pa.bool_()))


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL; returns their names."""
    names = []
    for name, (params, returns, body) in INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
        names.append(name)

    def add(name, fn, returns):
        spark.udf.register(name, arrow_udf(fn, returns))
        names.append(name)

    for op in ("intersection", "difference", "union", "symdifference"):
        add("st_" + op, _pairs(lambda a, b, op=op: K.overlay_many(a, b, op), None), GEOM)
    for p in PATTERNS:
        add("st_" + p, _pairs(_predicate(p), pa.bool_()), "boolean")
    for p in ("overlaps", "crosses"):
        add("st_" + p, _pairs(_relation(p), pa.bool_()), "boolean")
    add("st_relate", _pairs(K.relate_many, pa.string()), "string")
    add("st_distance", _pairs(_each(_filled(lambda a, b: K.shortest_line(a, b)[0])), pa.float64()), "double")
    add("st_hausdorffdistance", _pairs(_each(_filled(K.hausdorff)), pa.float64()), "double")
    add("st_maxdistance", _pairs(_each(_filled(K.max_distance)), pa.float64()), "double")
    add("st_makevalid", _ones(K.make_valid_many, None), GEOM)
    add("st_isvalidreason", _ones(K.valid_reason_many, pa.string()), "string")
    add("st_isvalid", _ones(lambda a: [None if r is None else r == "Valid Geometry" for r in K.valid_reason_many(a)], pa.bool_()), "boolean")
    add("st_asbinary_xy", _ones(_each(to_wkb), pa.binary()), "binary")

    def wkb(a: pa.Array) -> pa.Array:
        return encode([from_wkb(b) for b in a.to_pylist()])

    add("st_buffer", _numbered(K.buffer_many), GEOM)
    add("st_simplify", _numbered(_each(K.simplify)), GEOM)
    add("st_geomfromwkb_xy", wkb, GEOM)

    # one row per part, in the engine's own generator
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION st_dump(g {GEOM}) RETURNS TABLE (path INT, geom {GEOM})
        RETURN SELECT pos + 1, named_struct('gtype', replace(g.gtype, 'MULTI', ''), 'parts', array(col)) FROM (SELECT posexplode(g.parts))""")
    names.append("st_dump")
    add("st_convexhull", _ones(_each(lambda g: K.hull(_all_vertices(g))), None), GEOM)
    add("st_pointonsurface", _ones(_each(_surface), None), GEOM)
    add("st_shortestline", _pairs(_each(_filled(_shortest)), None), GEOM)
    add("st_closestpoint", _pairs(_each(_filled(_closest)), None), GEOM)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION st_dwithin(a {GEOM}, b {GEOM}, d DOUBLE) RETURNS BOOLEAN RETURN st_distance(a, b) <= d")
    names.append("st_dwithin")
    add("st_centroid", _ones(_each(_centroid), None), GEOM)
    add("st_issimple", _simple_all, "boolean")
    add("st_isring", _ring_all, "boolean")
    add("st_line_interpolate_point", _interpolate_all, GEOM)
    add("st_line_locate_point", _locate_all, "double")
    add("st_line_substring", _substring_all, GEOM)
    for old, new in ALIASES.items():
        add(old, _pairs(_predicate(new[3:]), pa.bool_()), "boolean")
    return names
