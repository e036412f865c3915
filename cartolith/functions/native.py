"""Geometry functions that are pure column expressions (no Python at run time)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..layer import LINEAR, PARTS, POLYGONAL, PUNTAL, bbox_of, empty, geometry, make_bbox, make_box, vertex



def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def vertices(geom: Column) -> Column:
    return F.flatten(rings(geom))


def is_polygonal(geom: Column) -> Column:
    return geom["gtype"].isin(*POLYGONAL)


def is_linear(geom: Column) -> Column:
    return geom["gtype"].isin(*LINEAR)


def is_puntal(geom: Column) -> Column:
    return geom["gtype"].isin(*PUNTAL)


def is_empty(geom: Column) -> Column:
    return F.size(geom["parts"]) == 0


def dimension(geom: Column) -> Column:
    return F.when(is_polygonal(geom), 2).when(is_linear(geom), 1).when(is_puntal(geom), 0)


def geometry_type(geom: Column) -> Column:
    return geom["gtype"]


# ---------------------------------------------------------------- measures

def _ring_moments(ring: Column) -> Column:
    """(twice the signed area, x moment, y moment) relative to the first vertex."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"),
                    F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))

    def step(s, v):
        x, y = v["x"] - ox, v["y"] - oy
        c = s["px"] * y - x * s["py"]
        return F.struct((s["a"] + c).alias("a"), (s["mx"] + c * (s["px"] + x)).alias("mx"),
                        (s["my"] + c * (s["py"] + y)).alias("my"), x.alias("px"), y.alias("py"))

    return F.aggregate(ring, zero, step)


def ring_area(ring: Column) -> Column:
    """Signed area of a ring: positive when counter-clockwise."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))

    def step(s, v):
        x, y = v["x"] - ox, v["y"] - oy
        return F.struct((s["a"] + s["px"] * y - x * s["py"]).alias("a"), x.alias("px"), y.alias("py"))

    return F.aggregate(ring, zero, step, lambda s: s["a"] / 2)


def area(geom: Column) -> Column:
    """Area of a polygonal geometry, 0 for the other types."""
    def part_area(part):
        return F.aggregate(part, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")),
                           lambda s, r: F.struct((s["s"] + F.abs(ring_area(r)) * F.when(s["i"] == 0, 1.0).otherwise(-1.0)).alias("s"),
                                                 (s["i"] + 1).alias("i")), lambda s: s["s"])

    total = F.aggregate(geom["parts"], F.lit(0.0), lambda s, p: s + part_area(p))
    return F.when(geom.isNull(), None).when(is_polygonal(geom), total).otherwise(F.lit(0.0))


def line_length(line: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("d"), line[0]["x"].alias("px"), line[0]["y"].alias("py"))
    return F.aggregate(line, zero, lambda s, v: F.struct(
        (s["d"] + F.hypot(v["x"] - s["px"], v["y"] - s["py"])).alias("d"), v["x"].alias("px"), v["y"].alias("py")),
        lambda s: s["d"])


def _total_length(geom: Column) -> Column:
    return F.aggregate(rings(geom), F.lit(0.0), lambda s, r: s + line_length(r))


def length(geom: Column) -> Column:
    """Length of a linear geometry, 0 for the other types."""
    return F.when(geom.isNull(), None).when(is_linear(geom), _total_length(geom)).otherwise(F.lit(0.0))


def perimeter(geom: Column) -> Column:
    return F.when(geom.isNull(), None).when(is_polygonal(geom), _total_length(geom)).otherwise(F.lit(0.0))


def _weighted(total: Column) -> Column:
    return let(total, lambda t: F.when(t["w"] != 0, vertex(t["x"] / t["w"], t["y"] / t["w"])))


def _acc(w, x, y) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"))


def _polygon_centroid(geom: Column) -> Column:
    """Rings flattened to (ring, is hole), so each ring's moments are computed once."""
    flat = F.flatten(F.transform(geom["parts"], lambda p: F.transform(p, lambda r, i: F.struct(r.alias("r"), (i > 0).alias("hole")))))

    def moments(z):
        r = z["r"]
        return let(_ring_moments(r), lambda m: let(F.signum(m["a"]) * F.when(z["hole"], -1.0).otherwise(1.0), lambda sign: _acc(
            m["a"] / 2 * sign, m["mx"] * sign / 6 + m["a"] / 2 * sign * r[0]["x"], m["my"] * sign / 6 + m["a"] / 2 * sign * r[0]["y"])))

    return _weighted(F.aggregate(F.transform(flat, moments), _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
                                 lambda s, m: _acc(s["w"] + m["w"], s["x"] + m["x"], s["y"] + m["y"])))


def _line_centroid(geom: Column) -> Column:
    def line(s, r):
        zero = F.struct(s["w"].alias("w"), s["x"].alias("x"), s["y"].alias("y"),
                        r[0]["x"].alias("px"), r[0]["y"].alias("py"))

        def step(a, v):
            d = F.hypot(v["x"] - a["px"], v["y"] - a["py"])
            return F.struct((a["w"] + d).alias("w"), (a["x"] + d * (v["x"] + a["px"]) / 2).alias("x"),
                            (a["y"] + d * (v["y"] + a["py"]) / 2).alias("y"), v["x"].alias("px"), v["y"].alias("py"))

        return F.aggregate(r, zero, step, lambda a: _acc(a["w"], a["x"], a["y"]))

    return _weighted(F.aggregate(rings(geom), _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0)), line))


def _point_centroid(geom: Column) -> Column:
    return _weighted(F.aggregate(vertices(geom), _acc(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
                                 lambda s, v: _acc(s["w"] + 1, s["x"] + v["x"], s["y"] + v["y"])))


def centroid(geom: Column) -> Column:
    """Centre of mass as a point: by area, by length or by vertex count."""
    v = (F.when(is_polygonal(geom), _polygon_centroid(geom)).when(is_linear(geom), _line_centroid(geom))
         .otherwise(_point_centroid(geom)))
    return let(v, lambda c: F.when(c.isNotNull(), geometry("POINT", F.array(F.array(F.array(c))))))


def envelope(geom: Column) -> Column:
    b = bbox_of(geom)
    return F.when(b.isNotNull(), make_box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def n_points(geom: Column) -> Column:
    return F.when(geom.isNotNull(), F.size(vertices(geom)))


def n_parts(geom: Column) -> Column:
    return F.when(geom.isNotNull(), F.size(geom["parts"]))


def n_rings(geom: Column) -> Column:
    return F.when(geom.isNotNull(), F.when(is_polygonal(geom), F.size(rings(geom))).otherwise(0))


def n_interior_rings(geom: Column) -> Column:
    return F.when(is_polygonal(geom), F.size(rings(geom)) - F.size(geom["parts"])).otherwise(0)


def point_x(geom: Column) -> Column:
    return F.when(geom["gtype"] == "POINT", F.get(vertices(geom), F.lit(0))["x"])


def point_y(geom: Column) -> Column:
    return F.when(geom["gtype"] == "POINT", F.get(vertices(geom), F.lit(0))["y"])


def _as_point(v: Column) -> Column:
    return F.when(v.isNotNull(), geometry("POINT", F.array(F.array(F.array(v)))))


def start_point(geom: Column) -> Column:
    return F.when(is_linear(geom), _as_point(F.get(vertices(geom), F.lit(0))))


def end_point(geom: Column) -> Column:
    return F.when(is_linear(geom), _as_point(F.try_element_at(vertices(geom), F.lit(-1))))


def point_n(geom: Column, n) -> Column:
    """n-th vertex, counted from 1 (negative: from the end)."""
    return _as_point(F.try_element_at(vertices(geom), n if isinstance(n, Column) else F.lit(n)))


def exterior_ring(geom: Column) -> Column:
    return F.when(geom["gtype"] == "POLYGON", geometry("LINESTRING", F.array(F.array(F.flatten(F.slice(geom["parts"], 1, 1))[0]))))


def is_closed(geom: Column) -> Column:
    return F.when(is_linear(geom), F.forall(rings(geom), lambda r: r[0] == F.element_at(r, -1))).otherwise(F.lit(True))


def azimuth(x1, y1, x2, y2) -> Column:
    """Clockwise angle from north in radians, 0 .. 2 pi; NULL for equal points."""
    a = F.atan2(x2 - x1, y2 - y1)
    return F.when((x1 == x2) & (y1 == y2), None).when(a < 0, a + 2 * math.pi).otherwise(a)


def is_rect(geom: Column, box: Column) -> Column:
    """True for one-ring polygons whose four corners are those of the bounding box, walked in turn."""
    ring = geom["parts"][0][0]
    corners = F.forall(ring, lambda v: v["x"].isin(box["xmin"], box["xmax"]) & v["y"].isin(box["ymin"], box["ymax"]))
    cond = (F.size(F.array_distinct(ring)) == 4) & (ring[0] == ring[4]) & (ring[0]["x"] != ring[2]["x"]) & (ring[0]["y"] != ring[2]["y"]) & corners
    one = (geom["gtype"].isin(*POLYGONAL) & (F.size(geom["parts"]) == 1) & (F.size(F.flatten(geom["parts"])) == 1)
           & (F.size(F.flatten(F.flatten(geom["parts"]))) == 5))
    return F.coalesce(F.when(one, cond), F.lit(False))


def is_segment(geom: Column) -> Column:
    """True for lines of two vertices at different places."""
    line = F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))
    one = (geom["gtype"] == "LINESTRING") & (F.size(geom["parts"]) == 1) & (F.size(line) == 2)
    return F.coalesce(F.when(one, line[0] != line[1]), F.lit(False))


# ---------------------------------------------------------------- points

def point_location(geom: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside (ray casting over all rings)."""
    def ring(s, r):
        zero = F.struct(s["inside"].alias("inside"), s["on"].alias("on"), r[0]["x"].alias("px"), r[0]["y"].alias("py"))

        def step(a, v):
            cross = (v["x"] - a["px"]) * (y - a["py"]) - (x - a["px"]) * (v["y"] - a["py"])
            hit = (((a["py"] <= y) & (v["y"] > y) & (cross > 0)) | ((a["py"] > y) & (v["y"] <= y) & (cross < 0)))
            on = ((cross == 0) & (x >= F.least(a["px"], v["x"])) & (x <= F.greatest(a["px"], v["x"]))
                  & (y >= F.least(a["py"], v["y"])) & (y <= F.greatest(a["py"], v["y"])))
            return F.struct((a["inside"] != hit).alias("inside"), (a["on"] | on).alias("on"),
                            v["x"].alias("px"), v["y"].alias("py"))

        return F.aggregate(r, zero, step, lambda a: F.struct(a["inside"].alias("inside"), a["on"].alias("on")))

    zero = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("on"))
    return F.aggregate(rings(geom), zero, ring, lambda s: F.when(s["on"], 0).when(s["inside"], 1).otherwise(-1))


def segment_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest vertex or segment of a geometry."""
    def ring(best, r):
        zero = F.struct(best.alias("d"), r[0]["x"].alias("px"), r[0]["y"].alias("py"))

        def step(s, v):
            dx, dy = v["x"] - s["px"], v["y"] - s["py"]
            n = dx * dx + dy * dy
            dot = (x - s["px"]) * dx + (y - s["py"]) * dy
            u = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / n))).otherwise(F.lit(0.0))
            ex, ey = x - s["px"] - u * dx, y - s["py"] - u * dy
            return F.struct(F.least(s["d"], F.sqrt(ex * ex + ey * ey)).alias("d"), v["x"].alias("px"), v["y"].alias("py"))

        return F.aggregate(r, zero, step, lambda s: s["d"])

    return F.aggregate(rings(geom), F.lit(float("inf")), ring)


def point_to_geometry(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to any geometry; 0 inside a polygon, NULL for an empty one."""
    v = vertices(geom)
    one = (geom["gtype"] == "POINT") & (F.size(geom["parts"]) == 1)
    many = F.aggregate(v, F.lit(float("inf")), lambda s, p: F.least(s, point_distance(p["x"], p["y"], x, y)))
    d = (F.when(one, point_distance(v[0]["x"], v[0]["y"], x, y)).when(is_puntal(geom), many)
         .when(is_linear(geom), segment_distance(geom, x, y))
         .when(point_location(geom, x, y) >= 0, F.lit(0.0)).otherwise(segment_distance(geom, x, y)))
    return F.when(F.size(geom["parts"]) > 0, d)


def point_distance(x1, y1, x2, y2) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


EARTH_RADIUS = 6371008.7714150598  # fixed value: mean radius of the WGS 84 ellipsoid in metres


def sphere_distance(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# ---------------------------------------------------------------- editors

def map_vertices(geom: Column, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every vertex."""
    def move(v):
        x, y = fn(v["x"], v["y"])
        return vertex(x, y)

    parts = F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, move)))
    return F.when(geom.isNotNull(), geometry(geom["gtype"], parts))


def _map_rings(geom: Column, fn) -> Column:
    parts = F.transform(geom["parts"], lambda p: F.transform(p, fn))
    return F.when(geom.isNotNull(), geometry(geom["gtype"], parts))


def affine(geom: Column, a, b, d, e, xoff, yoff) -> Column:
    """x' = a x + b y + xoff ; y' = d x + e y + yoff."""
    return map_vertices(geom, lambda x, y: (x * a + y * b + xoff, x * d + y * e + yoff))


def translate(geom: Column, dx, dy) -> Column:
    return map_vertices(geom, lambda x, y: (x + dx, y + dy))


def scale(geom: Column, fx, fy) -> Column:
    return map_vertices(geom, lambda x, y: (x * fx, y * fy))


def rotate(geom: Column, angle: float, cx: float = 0.0, cy: float = 0.0) -> Column:
    """Counter-clockwise rotation by ``angle`` radians around (cx, cy)."""
    c, s = math.cos(angle), math.sin(angle)
    return map_vertices(geom, lambda x, y: (cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c))


def snap_to_grid(geom: Column, size: float) -> Column:
    """Round vertices to a grid and drop repeated vertices that follow each other."""
    def snap(r):
        pts = F.transform(r, lambda v: vertex(F.rint(v["x"] / size) * size, F.rint(v["y"] / size) * size))
        return F.aggregate(pts, F.slice(pts, 1, 1),
                           lambda s, v: F.when(F.element_at(s, -1) == v, s).otherwise(F.concat(s, F.array(v))))

    return _map_rings(geom, snap)


def reverse(geom: Column) -> Column:
    return _map_rings(geom, lambda r: F.reverse(r))


def force_2d(geom: Column) -> Column:
    """Geometry is always two-dimensional here, so this is the identity."""
    return geom


def shift_longitude(geom: Column) -> Column:
    """Move longitudes between -180..180 and 0..360."""
    return map_vertices(geom, lambda x, y: (F.when(x < 0, x + 360).when(x > 180, x - 360).otherwise(x), y))


def segmentize(geom: Column, max_length: float) -> Column:
    """Split every segment longer than ``max_length`` into equal pieces."""
    def ring(r):
        def step(s, v):
            p = F.element_at(s, -1)
            n = F.ceil(F.hypot(v["x"] - p["x"], v["y"] - p["y"]) / max_length).cast("int")
            mid = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: vertex(
                p["x"] + (v["x"] - p["x"]) * i / F.greatest(n, F.lit(1)), p["y"] + (v["y"] - p["y"]) * i / F.greatest(n, F.lit(1))))
            return F.when(n > 1, F.concat(s, mid, F.array(v))).otherwise(F.concat(s, F.array(v)))

        return F.aggregate(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1), step)

    return F.when(is_puntal(geom), geom).otherwise(_map_rings(geom, ring))


def add_point(line: Column, x: Column, y: Column) -> Column:
    return F.when(line["gtype"] == "LINESTRING",
                  geometry("LINESTRING", F.array(F.array(F.concat(vertices(line), F.array(vertex(x, y)))))))


def set_point(line: Column, index: int, x: Column, y: Column) -> Column:
    """Replace the vertex at ``index`` (counted from 0)."""
    pts = F.transform(vertices(line), lambda v, i: F.when(i == index, vertex(x, y)).otherwise(v))
    return F.when(line["gtype"] == "LINESTRING", geometry("LINESTRING", F.array(F.array(pts))))


def remove_point(line: Column, index: int) -> Column:
    pts = F.filter(vertices(line), lambda v, i: i != index)
    return F.when(line["gtype"] == "LINESTRING", geometry("LINESTRING", F.array(F.array(pts))))


def to_multi(geom: Column) -> Column:
    g = geom["gtype"]
    return F.when(geom.isNotNull(), geometry(F.when(g.startswith("MULTI"), g).otherwise(F.concat(F.lit("MULTI"), g)), geom["parts"]))


def single_type(geom: Column) -> Column:
    return F.regexp_replace(geom["gtype"], "^MULTI", "")


def dump_parts(geom: Column) -> Column:
    """Array of one-part geometries."""
    return F.transform(geom["parts"], lambda p: geometry(single_type(geom), F.array(p)))


def dump_rings(geom: Column) -> Column:
    return F.transform(rings(geom), lambda r: geometry("POLYGON", F.array(F.array(r))))


def dump_points(geom: Column) -> Column:
    return F.transform(vertices(geom), lambda v: geometry("POINT", F.array(F.array(F.array(v)))))


def dump_segments(geom: Column) -> Column:
    return F.flatten(F.transform(rings(geom), lambda r: F.zip_with(
        F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))),
        lambda a, b: geometry("LINESTRING", F.array(F.array(F.array(a, b)))))))


def expand_box(box: Column, d) -> Column:
    return make_bbox(box["xmin"] - d, box["ymin"] - d, box["xmax"] + d, box["ymax"] + d)


def _closed(ring: Column) -> Column:
    return let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))


def circle_ring(x: Column, y: Column, d: Column, quad_segs: int = 8) -> Column:
    """Closed counter-clockwise ring with ``4 * quad_segs`` corners."""
    n = 4 * quad_segs
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * (2 * math.pi / n))
    c = F.struct(x.alias("x"), y.alias("y"))
    return _closed(let(c, lambda c: F.transform(at, lambda t: vertex(c["x"] + d * F.cos(t), c["y"] + d * F.sin(t)))))


# ---------------------------------------------------------------- text forms

def _num(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def as_wkt(geom: Column) -> Column:
    def ring(r):
        return F.concat(F.lit("("), F.concat_ws(",", F.transform(r, lambda v: F.concat_ws(" ", _num(v["x"]), _num(v["y"])))), F.lit(")"))

    def part(p):
        return F.concat(F.lit("("), F.concat_ws(",", F.transform(p, ring)), F.lit(")"))

    g = geom["gtype"]
    poly = F.transform(geom["parts"], part)
    flat = F.transform(rings(geom), ring)
    body = (F.when(g == "MULTIPOLYGON", F.concat(F.lit("("), F.concat_ws(",", poly), F.lit(")")))
            .when(g == "POLYGON", F.concat_ws(",", poly))
            .when(g.isin("MULTILINESTRING", "MULTIPOINT"), F.concat(F.lit("("), F.concat_ws(",", flat), F.lit(")")))
            .otherwise(F.concat_ws(",", flat)))
    return F.when(geom.isNull(), None).when(is_empty(geom), F.concat(g, F.lit(" EMPTY"))).otherwise(F.concat(g, body))


def _from_coords(gtype: Column, text: Column) -> Column:
    """Geometry from a type name and its coordinates as nested JSON arrays."""
    def v(c):
        return vertex(c[0], c[1])

    def read(depth):
        t = "double"
        for _ in range(depth):
            t = f"array<{t}>"
        return F.from_json(text, t)

    point = F.array(F.array(F.array(v(read(1)))))
    line = F.array(F.array(F.transform(read(2), v)))
    mpoint = F.transform(read(2), lambda c: F.array(F.array(v(c))))
    mline = F.transform(read(3), lambda r: F.array(F.transform(r, v)))
    poly = F.array(F.transform(read(3), lambda r: F.transform(r, v)))
    mpoly = F.transform(read(4), lambda p: F.transform(p, lambda r: F.transform(r, v)))
    parts = (F.when(gtype == "POINT", point).when(gtype == "LINESTRING", line).when(gtype == "MULTIPOINT", mpoint)
             .when(gtype == "MULTILINESTRING", mline).when(gtype == "POLYGON", poly).when(gtype == "MULTIPOLYGON", mpoly))
    known = gtype.isin(*PUNTAL, *LINEAR, *POLYGONAL)
    bad = F.raise_error(F.concat(F.lit("unsupported geometry type: "), gtype))
    return F.when(gtype.isNull(), None).when(known, geometry(gtype, parts)).otherwise(bad)


def from_wkt(text: Column) -> Column:
    """Geometry from WKT (points, lines, polygons and their multi types, XY)."""
    t = F.regexp_replace(F.upper(F.trim(text)), r"^SRID=\d+;", "")
    gtype = F.regexp_extract(t, r"^([A-Z]+)", 1)
    body = F.regexp_replace(t, r"^[A-Z]+\s*", "")
    num = r"(-?[0-9.]+(?:E[-+]?[0-9]+)?)"
    pairs = F.regexp_replace(body, num + r"\s+" + num, "[$1,$2]")
    js = F.translate(pairs, "()", "[]")
    js = F.when(gtype == "POINT", F.regexp_replace(js, r"^\[\s*(.*)\s*\]$", "$1")).when(
        gtype == "MULTIPOINT", F.regexp_replace(js, r"\[\s*(\[[^\[\]]*\])\s*\](?=\s*[,\]])", "$1")).otherwise(js)
    js = F.regexp_replace(js, r"(?<=[\[,])\.", "0.")
    return (F.when(text.isNull(), None).when(body == "EMPTY", geometry(gtype, F.array().cast(PARTS)))
            .otherwise(_from_coords(gtype, js)))


def from_geojson(text: Column) -> Column:
    j = F.from_json(text, "type string, coordinates string")
    return F.when(j["type"].isNotNull(), _from_coords(F.upper(j["type"]), j["coordinates"]))


def as_geojson(geom: Column) -> Column:
    pt = lambda v: F.array(v["x"], v["y"])
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint",
             "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    g = geom["gtype"]
    name = F.coalesce(*[F.when(g == k, F.lit(v)) for k, v in names.items()])
    nested = F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, pt)))
    lines = F.transform(rings(geom), lambda r: F.transform(r, pt))
    points = F.transform(vertices(geom), pt)
    body = (F.when(g == "MULTIPOLYGON", F.to_json(nested)).when(g == "POLYGON", F.to_json(F.flatten(nested)))
            .when(g == "MULTILINESTRING", F.to_json(lines)).when(g == "LINESTRING", F.to_json(points))
            .when(g == "MULTIPOINT", F.to_json(points)).otherwise(F.to_json(F.get(points, F.lit(0)))))
    return F.when(geom.isNotNull(), F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), F.coalesce(body, F.lit("[]")), F.lit("}")))


# ---------------------------------------------------------------- keys

GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the geohash base-32 alphabet


def morton(cx: Column, cy: Column, bits: int = 20) -> Column:
    """Interleave two non-negative integers (x in the even bits)."""
    def spread(v):
        v = v.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(cx).bitwiseOR(F.shiftleft(spread(cy), 1))


def geohash(lon: Column, lat: Column, precision: int = 8) -> Column:
    """Geohash text of a longitude / latitude pair."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    ix = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1))
    iy = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1))
    if bits % 2:  # odd: the last bit belongs to x
        code = morton(ix, iy, max(nx, ny))
    else:         # even: y holds the lowest bit
        code = morton(iy, ix, max(nx, ny))
    chars = [F.substring(F.lit(GEOHASH_ALPHABET), F.shiftright(code, 5 * (precision - 1 - i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
             for i in range(precision)]
    return F.concat(*chars)


# ---------------------------------------------------------------- linear referencing

def _measured_vertices(v: Column) -> Column:
    """Vertices of a line with their distance from the start: array of (x, y, m)."""
    zero = F.array(F.struct(v[0]["x"].alias("x"), v[0]["y"].alias("y"), F.lit(0.0).alias("m")))

    def step(s, p):
        q = F.element_at(s, -1)
        return F.concat(s, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["m"] + F.hypot(p["x"] - q["x"], p["y"] - q["y"])).alias("m"))))

    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), zero, step)


def _at_measure(line: Column, m: Column, offset=0.0) -> Column:
    """Vertex at a distance along the line, moved ``offset`` to the left."""
    return let(F.struct(vertices(line).alias("v"), m.alias("m")), lambda z: _walk_to(z["v"], z["m"], offset))


def _walk_to(v: Column, m: Column, offset) -> Column:
    zero = F.struct(F.lit(0.0).alias("d"), v[0]["x"].alias("px"), v[0]["y"].alias("py"), F.lit(None).cast("struct<x:double,y:double>").alias("o"))

    def step(s, p):
        dx, dy = p["x"] - s["px"], p["y"] - s["py"]
        n = F.hypot(dx, dy)
        u = (m - s["d"]) / F.when(n > 0, n).otherwise(1.0)
        here = vertex(s["px"] + u * dx - offset * dy / F.when(n > 0, n).otherwise(1.0), s["py"] + u * dy + offset * dx / F.when(n > 0, n).otherwise(1.0))
        hit = s["o"].isNull() & (n > 0) & (m <= s["d"] + n)
        return F.struct((s["d"] + n).alias("d"), p["x"].alias("px"), p["y"].alias("py"), F.when(hit, here).otherwise(s["o"]).alias("o"))

    return F.coalesce(F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), zero, step, lambda s: s["o"]), F.element_at(v, -1))


def line_interpolate(line: Column, fraction: Column, offset=0.0) -> Column:
    """Point at a fraction (0 .. 1) of the length of a line."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    return F.when(line["gtype"] == "LINESTRING", _as_point(_at_measure(line, f * length(line), offset)))


def line_locate(line: Column, x: Column, y: Column) -> Column:
    """Fraction of the length at the place of the line nearest to a point."""
    v = vertices(line)
    zero = F.struct(F.lit(0.0).alias("d"), v[0]["x"].alias("px"), v[0]["y"].alias("py"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("m"))

    def step(s, p):
        dx, dy = p["x"] - s["px"], p["y"] - s["py"]
        n = dx * dx + dy * dy
        u = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - s["px"]) * dx + (y - s["py"]) * dy) / F.when(n > 0, n).otherwise(1.0)))).otherwise(F.lit(0.0))
        away = F.hypot(x - s["px"] - u * dx, y - s["py"] - u * dy)
        size = F.sqrt(n)
        near = away < s["best"]
        return F.struct((s["d"] + size).alias("d"), p["x"].alias("px"), p["y"].alias("py"), F.least(s["best"], away).alias("best"),
                        F.when(near, s["d"] + u * size).otherwise(s["m"]).alias("m"))

    r = F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), zero, step, lambda s: F.when(s["d"] > 0, s["m"] / s["d"]).otherwise(F.lit(0.0)))
    return F.when(line["gtype"] == "LINESTRING", r)


def line_substring(line: Column, start: Column, end: Column) -> Column:
    """Part of a line between two fractions of its length."""
    def cut(z):
        mid = F.transform(F.filter(_measured_vertices(z["v"]), lambda p: (p["m"] > z["a"]) & (p["m"] < z["b"])), lambda p: vertex(p["x"], p["y"]))
        return F.concat(F.array(_walk_to(z["v"], z["a"], 0.0)), mid, F.array(_walk_to(z["v"], z["b"], 0.0)))

    def spot(z):
        return let(F.struct(z["v"].alias("v"), (start * z["n"]).alias("a"), (end * z["n"]).alias("b")), cut)

    pts = let(F.struct(vertices(line).alias("v"), length(line).alias("n")), spot)
    return F.when((line["gtype"] == "LINESTRING") & (start <= end), geometry("LINESTRING", F.array(F.array(pts))))
