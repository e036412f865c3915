"""Topology layers: faces, seeds, nodes and edges; polygons and merged lines from line work."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import exact as X, kernel as K, native as N
from ..functions.codec import decode, encode
from ..layer import GEOM, geometry, make_point, set_srid, srid_of, with_bbox
from .aggregate import connected_components, save_step
from .joins import spatial_join


@lru_cache(None)
def _assemble():
    """Directed lines with the face on the left -> polygon."""
    def one(g):
        if g is None:
            return None
        chains = [r for p in g[1] for r in p]
        a = np.concatenate([c[:-1] for c in chains])
        b = np.concatenate([c[1:] for c in chains])
        keys, first = K._same_place(np.vstack([a, b]))
        xy = np.vstack([a, b])[first]
        parts = K.build_polygons(xy, keys[:len(a)], keys[len(a):], K.REL_EPS * max(np.ptp(xy, axis=0).max(), 1e-300))
        return ("POLYGON" if len(parts) <= 1 else "MULTIPOLYGON", parts)

    def run(arr: pa.Array) -> pa.Array:
        return encode([one(g) for g in decode(arr)])

    return arrow_udf(run, GEOM).asNondeterministic()


def _gather(df: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """All line parts of a key as one multi line (the ring of one face, so bounded by the result)."""
    flat = F.flatten(F.collect_list(parts))
    return df.groupBy(*keys).agg(geometry("MULTILINESTRING", flat).alias("geom"))


def face_polygons(edges: DataFrame, left: str = "left_face", right: str = "right_face") -> DataFrame:
    """Polygon of every face above 0 from edges that know the face on either side."""
    g = F.col("geom")
    sides = F.array(F.struct(F.col(left).alias("face_id"), g["parts"].alias("parts")),
                    F.struct(F.col(right).alias("face_id"), N.reverse(g)["parts"].alias("parts")))
    lines = edges.where(F.col(left) != F.col(right)).select(F.explode(sides).alias("s")).select("s.*").where("face_id > 0")
    out = _gather(lines, ["face_id"], F.col("parts")).withColumn("geom", _assemble()(F.col("geom")))
    return set_srid(with_bbox(out), srid_of(edges))


def face_seeds(edges: DataFrame, left: str = "left_face", right: str = "right_face") -> DataFrame:
    """A point inside every face."""
    f = face_polygons(edges, left, right)
    return set_srid(with_bbox(f.withColumn("geom", X.point_on_surface(F.col("geom")))), srid_of(edges))


def face_boxes(edges: DataFrame, left: str = "left_face", right: str = "right_face") -> DataFrame:
    """Bounding box of every face, straight from its edges."""
    b = with_bbox(edges)
    lines = b.select(F.explode(F.array(left, right)).alias("face_id"), "bbox").where("face_id > 0")
    return lines.groupBy("face_id").agg(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct end points of the edges with their degree."""
    v = N.vertices(F.col("geom"))
    ends = edges.select(F.explode(F.array(v[0], F.element_at(v, -1))).alias("p"))
    n = ends.groupBy("p").agg(F.count(F.lit(1)).alias("degree"))
    return set_srid(with_bbox(n.select(F.xxhash64("p.x", "p.y").alias("node_id"), "degree", geometry("POINT", F.array(F.array(F.array("p")))).alias("geom"))), srid_of(edges))


def edge_links(edges: DataFrame, id: str, following: str) -> DataFrame:
    """Each edge with the geometry of its next edge (next-left or next-right; the sign is the direction)."""
    nxt = edges.select(F.col(id).alias("_n"), F.col("geom").alias("next_geom"))
    return edges.join(nxt, F.abs(F.col(following)) == F.col("_n"), "left").drop("_n")


# ---------------------------------------------------------------- line work

def _segments(lines: DataFrame) -> DataFrame:
    """Distinct undirected segments (x1, y1) < (x2, y2)."""
    s = lines.select(F.explode(N.dump_segments(F.col("geom"))).alias("g")).select(N.vertices(F.col("g")).alias("v"))
    a, b = F.col("v")[0], F.col("v")[1]
    s = s.where(a != b).select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct()
    return s.select(F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def _segment_parts() -> Column:
    return F.array(F.array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))))


def node_lines(lines: DataFrame, grid: float | None = None) -> DataFrame:
    """Line work cut at every place where lines meet, as single segments without copies.

    A grid join pairs segments whose boxes meet; each pair gives the places on the first one where the second crosses, touches or overlaps it; the
    places of a segment, in order, part it.  Both segments of a pair get the very same place: it is computed from the lesser one, moved to an end of
    either if it is that near, else to a lattice of ``grid`` (default: about 1e-10 of the coordinates), so that lines through one point share a node.
    A segment with very many crossings is ordered in blocks."""
    from ..plans.grid import candidate_pairs
    from ..plans.scan import windowed
    s = save_step(_segments(lines), "segments")
    e = s.agg(F.max(F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")]))).first()[0]
    if e is None:
        return lines.select("geom").where(F.lit(False))
    grid = grid or 2.0 ** np.floor(np.log2(max(e, 1e-300) * 1e-10))
    b = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("xmin", "ymin", "xmax", "ymax"))])
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxed = s.withColumn("bbox", b(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))
    pairs, _ = candidate_pairs(boxed, boxed, grow_b=4 * grid, ageom=None, bgeom=None)
    names = ("x1", "y1", "x2", "y2")
    mine, its = F.struct(*[F.col("a_" + c).alias(c) for c in names]), F.struct(*[F.col("b_" + c).alias(c) for c in names])
    pairs = pairs.select(mine.alias("s"), its.alias("o")).where(F.col("s") != F.col("o")).withColumns({"p": F.least("s", "o"), "q": F.greatest("s", "o")})
    p, q = F.col("p"), F.col("q")
    rx, ry, sx, sy = p["x2"] - p["x1"], p["y2"] - p["y1"], q["x2"] - q["x1"], q["y2"] - q["y1"]
    d, wx, wy = rx * sy - ry * sx, q["x1"] - p["x1"], q["y1"] - p["y1"]
    flat = F.abs(d) <= 1e-12 * F.hypot(rx, ry) * F.hypot(sx, sy)
    t, u = F.try_divide(wx * sy - wy * sx, d), F.try_divide(wx * ry - wy * rx, d)
    near_p, near_q = 2 * grid / F.hypot(rx, ry), 2 * grid / F.hypot(sx, sy)
    cx, cy = p["x1"] + t * rx, p["y1"] + t * ry
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = [place(v[a], v[c]) for v in (p, q) for a, c in (("x1", "y1"), ("x2", "y2"))]
    snapped = F.coalesce(*[F.when((F.abs(v["x"] - cx) <= 2 * grid) & (F.abs(v["y"] - cy) <= 2 * grid), v) for v in ends], place(F.round(cx / grid) * grid, F.round(cy / grid) * grid))
    crossing = F.when(~flat & t.between(-near_p, 1 + near_p) & u.between(-near_q, 1 + near_q), F.array(snapped))
    # parallel segments on one line: the ends of the other one
    m, o = F.col("s"), F.col("o")
    mx, my = m["x2"] - m["x1"], m["y2"] - m["y1"]
    length = F.hypot(mx, my)
    off = lambda v: F.abs((v["x"] - m["x1"]) * my - (v["y"] - m["y1"]) * mx) / length <= 2 * grid
    over = F.when(flat, F.filter(F.array(place(o["x1"], o["y1"]), place(o["x2"], o["y2"])), off))
    met = pairs.select("s", F.explode(F.coalesce(crossing, over, F.array().cast("array<struct<x:double,y:double>>"))).alias("v"))
    own = s.select(F.struct(*names).alias("s")).select("s", F.explode(F.array(place(F.col("s.x1"), F.col("s.y1")), place(F.col("s.x2"), F.col("s.y2")))).alias("v"))
    along = lambda c: ((F.col("v.x") - c["x1"]) * (c["x2"] - c["x1"]) + (F.col("v.y") - c["y1"]) * (c["y2"] - c["y1"])) / ((c["x2"] - c["x1"]) ** 2 + (c["y2"] - c["y1"]) ** 2)
    spots = own.unionByName(met).select("s.*", "v", along(F.col("s")).alias("t")).where("t >= -1e-9 AND t <= 1 + 1e-9").select(*names, F.col("v.x").alias("x"), F.col("v.y").alias("y"), "t").distinct()
    spots = save_step(spots, "nodes")
    cut = windowed(spots, list(names), ["t", "x", "y"], {"to": lambda w: F.lead(F.struct("x", "y")).over(w)}, after=1)
    here = F.struct("x", "y")
    pieces = cut.where(F.col("to").isNotNull() & (here != F.col("to"))).select(F.least(here, F.col("to")).alias("a"), F.greatest(here, F.col("to")).alias("b")).distinct()
    return set_srid(with_bbox(pieces.select(geometry("LINESTRING", F.array(F.array(F.array("a", "b")))).alias("geom"))), srid_of(lines))


def without_dangles(lines: DataFrame) -> DataFrame:
    """Noded single segments without those that lead nowhere: what hangs on a node of its own goes, round by round."""
    now = save_step(lines.select("geom"), "dangles")
    while True:
        v = N.vertices(F.col("geom"))
        ends = now.select(F.explode(F.array(v[0], v[1])).alias("p")).groupBy("p").count().where("count = 1").select(F.struct("p.x", "p.y").alias("loose"))
        a, b = F.struct(v[0]["x"].alias("x"), v[0]["y"].alias("y")), F.struct(v[1]["x"].alias("x"), v[1]["y"].alias("y"))
        left = now.withColumns({"_a": a, "_b": b}).join(ends, F.col("_a") == F.col("loose"), "left_anti").join(ends, F.col("_b") == F.col("loose"), "left_anti").select("geom")
        after = save_step(left, "dangles")
        if after.count() == now.count():
            return set_srid(with_bbox(now), srid_of(lines))
        now = after


def polygonize(lines: DataFrame, node: bool = False) -> DataFrame:
    """Polygons bounded by line work whose lines meet only at vertices; with ``node`` any line work, which is cut where lines meet and freed of dangles first.

    Every segment becomes two half edges; the next half edge around the face on the
    left is the clockwise neighbour at its end node.  Cycles of that relation are
    connected components, and each component is one ring.  A ring that runs clockwise
    is the outline of a connected piece of line work; it is cut out of the smallest
    face around it."""
    if node:
        lines = without_dangles(node_lines(lines))
    s = _segments(lines)
    half = s.unionByName(s.select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    half = save_step(half.withColumn("id", F.xxhash64("x1", "y1", "x2", "y2")), "half-edges")
    at = Window.partitionBy("x1", "y1").orderBy(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    whole = Window.partitionBy("x1", "y1")
    last = F.max_by(F.struct("x2", "y2"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))).over(whole)
    prev = F.coalesce(F.lag(F.struct("x2", "y2")).over(at), last)
    # arriving at (x1, y1) from (x2, y2), go on to the neighbour that precedes the way back
    step = half.select(F.xxhash64("x2", "y2", "x1", "y1").alias("u"), F.xxhash64("x1", "y1", prev["x2"], prev["y2"]).alias("v"))
    comp = connected_components(step, half.select("id"))
    ring = half.join(comp, "id")
    rings = _gather(ring, ["component"], _segment_parts())
    rings = save_step(rings.select("component", _assemble()(F.col("geom")).alias("geom"), _assemble()(N.reverse(F.col("geom"))).alias("outline")), "rings")
    faces = with_bbox(rings.where(F.size(F.col("geom")["parts"]) > 0).select(F.col("component").alias("face_id"), "geom"))
    islands = rings.where((F.size(F.col("geom")["parts"]) == 0) & (F.size(F.col("outline")["parts"]) > 0))
    ring = F.get(F.get(F.col("outline")["parts"], F.lit(0)), F.lit(0))
    first = F.get(ring, F.lit(0))
    spots = islands.select("component", F.reverse(ring).alias("hole"), make_point(first["x"], first["y"]).alias("geom"))
    around = spatial_join(with_bbox(spots), faces, "within")   # an outline meets no face that is not its own, so any vertex tells
    owner = around.groupBy("a_component").agg(F.min_by(F.struct("b_face_id", "a_hole"), F.struct(N.area(F.col("b_geom")), "b_face_id")).alias("o"))
    holes = owner.groupBy(F.col("o.b_face_id").alias("hole_in")).agg(F.collect_list("o.a_hole").alias("holes"))
    cut = F.when(F.col("holes").isNull(), F.col("geom")).otherwise(geometry("POLYGON", F.array(F.concat(F.get(F.col("geom")["parts"], F.lit(0)), F.col("holes")))))
    out = faces.join(holes, F.col("face_id") == F.col("hole_in"), "left").select("face_id", cut.alias("geom"))
    return set_srid(with_bbox(out), srid_of(lines))


def merge_lines(lines: DataFrame) -> DataFrame:
    """Join segments that meet at nodes of degree two into maximal lines."""
    s = save_step(_segments(lines).withColumn("id", F.xxhash64("x1", "y1", "x2", "y2")), "segments")
    ends = s.select("id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    pairs = ends.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("u"), F.max("id").alias("v")).where("n = 2").select("u", "v")
    comp = connected_components(pairs, s.select("id"))
    seg = s.join(comp, "id")
    one = _gather(seg, ["component"], _segment_parts())
    out = one.select(F.col("component").alias("line_id"), X.self_union(F.col("geom")).alias("geom"))
    return set_srid(with_bbox(out), srid_of(lines))


def zone_grid_edges(zones: DataFrame, zone_id: str) -> DataFrame:
    """Borders of a layer of box zones as edges that know the face on either side (id + 1; 0 = outside)."""
    s = zones.select((F.col(zone_id) + 1).alias("f"), F.explode(N.dump_segments(F.col("geom"))).alias("g")).select("f", N.vertices(F.col("g")).alias("v"))
    a, b = F.col("v")[0], F.col("v")[1]
    # counter-clockwise rings have their face on the left
    d = s.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.when(a < b, F.col("f")).alias("l"), F.when(b < a, F.col("f")).alias("r"))
    e = d.groupBy("p", "q").agg(F.coalesce(F.max("l"), F.lit(0)).alias("left_face"), F.coalesce(F.max("r"), F.lit(0)).alias("right_face"))
    out = e.select(F.xxhash64("p.x", "p.y", "q.x", "q.y").alias("edge_id"), "left_face", "right_face", geometry("LINESTRING", F.array(F.array(F.array("p", "q")))).alias("geom"))
    return set_srid(with_bbox(out), srid_of(zones))
