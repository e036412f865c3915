"""Delaunay triangles and concave hulls of point layers of any size.

Triangles: points lie in tiles that hold at most POINTS of them. A triangle whose circle lies inside its tile is final, whatever lies elsewhere; only
the corners of the other triangles go on to the tile four times as wide, with the edges that part final ground from the rest. Every triangle that a wider
tile has to find has all of its corners among those (a circle that leaves the tile and touches a point makes one of the point's own circles leave it, too),
so the wider tile's triangles are right outside the final ground, and those inside it are dropped. What goes on grows with the borders of tiles, not
with the points.

Hulls: long border edges are eroded (Duckham et al. 2008), longest first inside a task. Only triangles with a long edge can go, so all others stay where they
are; the border of what is left follows from the outer edges and the triangles taken away. A task holds a stretch of the long triangles along a
space-filling curve and takes away only those whose far corner is not at the border and has all of its long triangles in the task. Stretches
shift from round to round until no triangle anywhere can go.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kernel as K, native as N
from ..functions.codec import encode
from ..functions.delaunay import circles, delaunay
from ..layer import GEOM, PUNTAL, make_polygon, set_srid, srid_of, vertex, with_bbox
from .aggregate import save_step

POINTS = 4096         # of a tile; a larger group is cut into tiles
TRIANGLES = 1 << 15   # long ones, of a task while borders are eroded
FEW_GROUPS = 10_000   # up to here one row per group may be broadcast
CORNERS = ["ax", "ay", "bx", "by", "cx", "cy"]
FLAGS = ["h0", "h1", "h2"]   # whether the edge ab, bc, ca is at the border
RIM = ["r0", "r1", "r2"]     # whether the corner a, b, c is at the border
DEGREE = ["d0", "d1", "d2"]  # how many long triangles the corner a, b, c has


# ---------------------------------------------------------------- triangles

def directed(t: np.ndarray) -> np.ndarray:
    return t[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)


def outside(t: np.ndarray, final_edges: set[tuple[int, int]]) -> np.ndarray:
    """Which triangles do not lie on final ground, whose border edges have it on their left."""
    owner = {(a, b): k // 3 for k, (a, b) in enumerate(directed(t).tolist())}
    inside = np.zeros(len(t), bool)
    todo = [owner[e] for e in final_edges if e in owner]
    while todo:
        k = todo.pop()
        if inside[k]:
            continue
        inside[k] = True
        a, b, c = t[k].tolist()
        for e in ((a, b), (b, c), (c, a)):
            back = (e[1], e[0])
            if e not in final_edges and back not in final_edges and back in owner:
                todo.append(owner[back])
    return ~inside


def tile_triangles(p: np.ndarray, edges: np.ndarray, box: tuple[float, float, float, float] | None, whole: tuple[float, float, float, float]):
    """(final triangles, points that go on, edges that go on, border edges of the whole) of a tile; without a box it is the last one and all is final.

    Edges on the sides of ``whole``, the box of all points, have nothing behind them: they are border edges as soon as their triangle is final, and points
    that have no other open edge stay behind, so the straight sides of a grid do not pile up in the last tile."""
    t = delaunay(p)
    if not len(t):
        return np.empty((0, 3, 2)), (p if box else p[:0]), (edges if box else edges[:0]), (edges[:0] if box else edges)
    number = {v: i for i, v in enumerate(map(tuple, p.tolist()))}
    known = {(number[a, b], number[c, d]) for a, b, c, d in edges.tolist()}
    new = t[outside(t, known)] if known else t
    rim = {(a, b) for a, b in directed(t).tolist()}
    rim = [e for e in rim if (e[1], e[0]) not in rim]
    if box is None:
        open_ = known | {(a, b) for a, b in directed(new).tolist()}   # other rims run over ground whose border edges are known
        return p[new], p[:0], edges[:0], np.array([[*p[a], *p[b]] for a, b in rim if (a, b) in open_]).reshape(-1, 4)
    centre, radius = circles(p[new[:, 0]], p[new[:, 1]], p[new[:, 2]])
    reach = radius * (1 + 1e-6) + 1e-9 * max(box[2] - box[0], box[3] - box[1], abs(box[0]), abs(box[1]))
    final = (centre[:, 0] - reach > box[0]) & (centre[:, 1] - reach > box[1]) & (centre[:, 0] + reach < box[2]) & (centre[:, 1] + reach < box[3])
    ground = known | {(a, b) for a, b in directed(new[final]).tolist()}
    ground = [e for e in ground if (e[1], e[0]) not in ground]
    place = p.tolist()
    ends = {e for e in rim if any(place[e[0]][i % 2] == whole[i] == place[e[1]][i % 2] for i in range(4))}
    done = ends.intersection(ground)
    ground = [e for e in ground if e not in done]
    on = np.unique(np.concatenate([new[~final].ravel(), np.array([e for e in rim if e not in ends] + ground, np.int64).reshape(-1)]))
    of = lambda es: np.array([[*p[a], *p[b]] for a, b in es]).reshape(-1, 4)
    return p[new[final]], p[on], of(ground), of(done)


def _keyed(first: pa.Array, n: int) -> pa.Array:
    return first.take(pa.array(np.zeros(n, np.int64)))


def _group_of(table: pa.Table) -> pa.Array:
    """The group of a table's rows, with fields that may be null as in ``_with_group``: a constant's field may not, until it went through a file."""
    first = table.column("_g").slice(0, 1).combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    return pa.StructArray.from_arrays(first.flatten(), fields=[pa.field(f.name, f.type) for f in first.type])


def _with_group(pts: DataFrame, ddl: str) -> T.StructType:
    group = T.StructType([T.StructField(f.name, f.dataType) for f in pts.schema["_g"].dataType.fields])
    return T.StructType([T.StructField("_g", group), *T.StructType.fromDDL(ddl).fields])


def _points_of(points: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (_g, x, y) of a point layer; _g holds the group's columns."""
    if points.where(~F.col("geom")["gtype"].isin(*PUNTAL)).limit(1).count():
        raise ValueError("only point layers can be turned into triangles and polygons")
    g = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("_none"))
    return points.select(g.alias("_g"), F.explode(N.vertices(F.col("geom"))).alias("v")).select("_g", "v.x", "v.y").distinct()


def _mesh(pts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(_g, corners) of all triangles and (_g, x1, y1, x2, y2) of their outer edges; ``most`` is the size of the largest group."""
    e = pts.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    whole = (e["x0"], e["y0"], e["x1"], e["y1"])
    x0, y0, extent = e["x0"], e["y0"], max(e["x1"] - e["x0"], e["y1"] - e["y0"], 1e-300) * (1 + 1e-9)
    steps = min(15, max(1, math.ceil(math.log(most / POINTS, 16))) + 4)       # four steps finer than even density asks for
    finest, levels = 2 * steps, [2 * i for i in range(steps + 1)]               # level l has 2^l tiles a side
    cell = lambda v, v0: F.least(F.floor((F.col(v) - v0) / (extent / 2 ** finest)), F.lit(2 ** finest - 1)).cast("int")
    pts = pts.withColumns({"cx": cell("x", x0), "cy": cell("y", y0)})
    at = lambda c: F.expr(f"shiftright({c}, {finest} - level)")
    cells = pts.groupBy("_g", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    ladder = save_step(cells, "cells").withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    fits = ladder.groupBy("_g", "level", at("cx").alias("tx"), at("cy").alias("ty")).agg(F.sum("n").alias("n")).where(F.col("n") <= POINTS).drop("n")
    leaf = (ladder.withColumns({"tx": at("cx"), "ty": at("cy")}).join(fits, ["_g", "level", "tx", "ty"]).groupBy(F.col("_g").alias("_lg"), F.col("cx").alias("_lx"), F.col("cy").alias("_ly")).agg(F.min("level").alias("level")))
    placed = pts.join(leaf, (F.col("_g") == F.col("_lg")) & (F.col("cx") == F.col("_lx")) & (F.col("cy") == F.col("_ly")), "left").withColumn("level", F.coalesce("level", F.lit(finest)))
    none = [F.lit(None).cast("double").alias(c) for c in ("x2", "y2", "x3", "y3")]
    placed = save_step(placed.select("_g", F.lit("p").alias("kind"), "level", at("cx").alias("tx"), at("cy").alias("ty"), F.col("x").alias("x1"), F.col("y").alias("y1"), *none), "points")
    used = {r["level"] for r in placed.select("level").distinct().collect()}    # 16 numbers at most
    names = ["_g", "kind", "tx", "ty", "x1", "y1", "x2", "y2", "x3", "y3"]
    schema = _with_group(pts, "kind string, tx int, ty int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")

    def work(level: int):
        side = extent / 2 ** level

        def run(table: pa.Table) -> pa.Table:
            kind = np.array(table.column("kind").to_pylist())
            num = np.column_stack([table.column(c).to_numpy() for c in names[4:]])
            tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
            box = None if level == 0 else (x0 + tx * side, y0 + ty * side, x0 + (tx + 1) * side, y0 + (ty + 1) * side)
            tri, on, ground, rim = tile_triangles(np.unique(num[kind == "p", :2], axis=0), num[kind == "e", :4], box, whole)
            wide = lambda a: np.column_stack([a, np.full((len(a), 6 - a.shape[1]), np.nan)])
            rows = np.concatenate([tri.reshape(-1, 6), wide(on.reshape(-1, 2)), wide(ground), wide(rim)])
            kinds = ["t"] * len(tri) + ["p"] * len(on) + ["e"] * len(ground) + ["h"] * len(rim)
            first = _group_of(table)
            up = [pa.array(np.full(len(rows), v >> 2), pa.int32()) for v in (tx, ty)]
            return pa.table([_keyed(first, len(rows)), pa.array(kinds, pa.string()), *up, *[pa.array(rows[:, i], pa.float64()) for i in range(6)]], names)

        return run

    made, carried = [], None
    for level in reversed(levels):
        here = placed.where(F.col("level") == level).drop("level") if level in used else None
        rows = here if carried is None else carried if here is None else here.unionByName(carried)
        if rows is None:
            continue
        done = save_step(rows.groupBy("_g", "tx", "ty").applyInArrow(work(level), schema), "tiles")
        made.append(done)
        carried = done.where("kind IN ('p', 'e')")
    tri = hull = None
    for done in made:
        t, h = done.where("kind = 't'").select("_g", *[F.col(c).alias(n) for c, n in zip(names[4:], CORNERS)]), done.where("kind = 'h'").select("_g", "x1", "y1", "x2", "y2")
        tri, hull = (t, h) if tri is None else (tri.unionByName(t), hull.unionByName(h))
    return tri, hull


def _sides(tri: DataFrame, *cols: str) -> DataFrame:
    """The three directed edges of each triangle, with their number ``i`` and the columns named."""
    e = [F.struct(F.lit(i).alias("i"), *[F.col(c).alias(n) for c, n in zip((a + "x", a + "y", b + "x", b + "y"), ("x1", "y1", "x2", "y2"))]) for i, (a, b) in enumerate(("ab", "bc", "ca"))]
    return tri.select("_g", *cols, F.explode(F.array(*e)).alias("e")).select("_g", *cols, "e.*")


def _flagged(tri: DataFrame, hull: DataFrame) -> DataFrame:
    """(_g, corners, further columns, flags): which edges are among those of ``hull``."""
    outer = _sides(tri, *CORNERS).join(hull, ["_g", "x1", "y1", "x2", "y2"]).groupBy("_g", *CORNERS).agg(*[F.max(F.col("i") == i).alias(h) for i, h in enumerate(FLAGS)])
    return tri.join(outer, ["_g", *CORNERS], "left").select(*tri.columns, *[F.coalesce(h, F.lit(False)).alias(h) for h in FLAGS])


def _triangulated(pts: DataFrame) -> DataFrame:
    """(_g, corners, flags) for distinct points (_g, x, y); flags tell the outer edges."""
    most = pts.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    schema = _with_group(pts, ", ".join([f"{c} double" for c in CORNERS] + [f"{c} boolean" for c in FLAGS]))
    if most <= POINTS:
        def whole(table: pa.Table) -> pa.Table:
            p = np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()])
            t = delaunay(p)
            e = list(map(tuple, directed(t).tolist()))
            have = set(e)
            flags = np.array([(b, a) not in have for a, b in e], bool).reshape(-1, 3)
            first = _group_of(table)
            xy = p[t].reshape(-1, 6)
            return pa.table([_keyed(first, len(t)), *[pa.array(xy[:, i]) for i in range(6)], *[pa.array(flags[:, i]) for i in range(3)]], ["_g", *CORNERS, *FLAGS])

        return pts.groupBy("_g").applyInArrow(whole, schema)
    tri, hull = _mesh(pts, most)
    return _flagged(tri, hull)


def delaunay_triangles(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """Layer of the Delaunay triangles of each group of a point layer, with ``outer``, the number of edges at the group's border.

    Copies of a point count once; a group on one line has none. Of several ways to cut points on one circle one is taken, the same whatever the tiles."""
    tri = _triangulated(_points_of(points, list(by)))
    ring = F.array(*[vertex(F.col(c + "x"), F.col(c + "y")) for c in "abc"])
    out = tri.select(*[F.col("_g")[c].alias(c) for c in by], sum((F.col(h).cast("int") for h in FLAGS[1:]), F.col(FLAGS[0]).cast("int")).alias("outer"), make_polygon(ring).alias("geom"))
    return set_srid(with_bbox(out), srid_of(points))


# ---------------------------------------------------------------- concave hulls

def erode(tri: np.ndarray, flags: np.ndarray, limit: float, holes: bool, rim: np.ndarray | None = None, degree: np.ndarray | None = None) -> np.ndarray:
    """Which triangles (n, 3, 2) of one group stay; ``flags`` (n, 3), the border edges, are brought up to date for those.

    Where not all triangles are there, ``rim`` (n, 3) tells the corners at the border, kept up to date as well, and ``degree`` (n, 3) how many triangles
    that can go meet in a corner; corners that have some of them elsewhere are left alone."""
    vertices, t = np.unique(tri.reshape(-1, 2), axis=0, return_inverse=True)
    t = t.reshape(-1, 3)
    e = directed(t)
    length = np.hypot(*(vertices[e[:, 0]] - vertices[e[:, 1]]).T).reshape(-1, 3)
    owner = {(a, b): k for k, (a, b) in enumerate(e.tolist())}
    border, cut = np.zeros(len(vertices), bool), np.zeros(len(vertices), bool)
    border[e[flags.ravel()].ravel()] = True
    if rim is not None:
        border[t[rim]] = True
        most = np.zeros(len(vertices), np.int64)
        np.maximum.at(most, t.ravel(), degree.ravel())
        cut = np.bincount(t.ravel(), minlength=len(vertices)) < most
    alive = np.ones(len(t), bool)
    heap = [(-length[k, i], k, i) for k, i in zip(*np.nonzero(flags & (length > limit)))]
    heapq.heapify(heap)

    def take(k):
        # a corner stays at the border once it is there
        alive[k] = False
        corners = t[k].tolist()
        border[corners] = True
        for i in range(3):
            other = None if flags[k, i] else owner.get((corners[(i + 1) % 3], corners[i]))
            if other is not None:
                j, side = divmod(other, 3)
                flags[j, side] = True
                if length[j, side] > limit:
                    heapq.heappush(heap, (-length[j, side], j, side))

    def outer():
        while heap:
            _, k, i = heapq.heappop(heap)
            apex = t[k, (i + 2) % 3]
            if alive[k] and not border[apex] and not cut[apex]:
                take(k)

    outer()
    if holes:
        longest = length.max(axis=1)
        for k in np.argsort(-longest, kind="stable"):
            if longest[k] <= limit:
                break
            if alive[k] and not border[t[k]].any() and not cut[t[k]].any():
                take(k)
                outer()
    if rim is not None:
        rim[:] = border[t]
    return alive


def _rings(x1, y1, x2, y2):
    p, at = np.unique(np.column_stack([np.concatenate([x1, x2]), np.concatenate([y1, y2])]), axis=0, return_inverse=True)
    at = at.reshape(2, -1)
    parts = K.build_polygons(p, at[0], at[1], K.REL_EPS * np.ptp(p, axis=0).max())
    return "POLYGON" if len(parts) <= 1 else "MULTIPOLYGON", parts


def concave_hull(points: np.ndarray, ratio: float, holes: bool):
    """The hull of one small set of points."""
    p = np.unique(points, axis=0)
    t = delaunay(p)
    if not len(t):
        return K.hull(p)
    e = list(map(tuple, directed(t).tolist()))
    have = set(e)
    flags = np.array([(b, a) not in have for a, b in e], bool).reshape(-1, 3)
    length = np.hypot(*(p[directed(t)[:, 0]] - p[directed(t)[:, 1]]).T)
    alive = erode(p[t], flags, length.min() + ratio * (length.max() - length.min()), holes)
    k, i = np.nonzero(flags & alive[:, None])
    a, b = p[t[k, i]], p[t[k, (i + 1) % 3]]
    return _rings(a[:, 0], a[:, 1], b[:, 0], b[:, 1])


def _lengths() -> list[Column]:
    return [F.hypot(F.col(a + "x") - F.col(b + "x"), F.col(a + "y") - F.col(b + "y")) for a, b in ("ab", "bc", "ca")]


def _long_triangles(tri: DataFrame, hull: DataFrame, lim: DataFrame) -> DataFrame:
    """The triangles that may go, those with an edge longer than their group's limit, with their flags and what ``erode`` asks to know of their corners."""
    n = _lengths()
    tri = tri.join(lim, F.col("_g") == F.col("_lg")).drop("_lg").where((n[0] > F.col("lim")) | (n[1] > F.col("lim")) | (n[2] > F.col("lim")))
    tri = save_step(_flagged(tri, hull), "long")
    corners = F.explode(F.array(*[F.struct(F.col(c + "x").alias("x"), F.col(c + "y").alias("y")) for c in "abc"]))
    degree = tri.select("_g", corners.alias("v")).groupBy("_g", "v.x", "v.y").agg(F.count(F.lit(1)).cast("int").alias("d"))
    rim = hull.select("_g", F.explode(F.array(*[F.struct(F.col("x" + i).alias("x"), F.col("y" + i).alias("y")) for i in "12"])).alias("v")).select("_g", "v.x", "v.y").distinct().withColumn("r", F.lit(True))
    facts = save_step(degree.join(rim, ["_g", "x", "y"], "left").withColumn("r", F.coalesce("r", F.lit(False))), "corners")
    for i, c in enumerate("abc"):
        tri = tri.join(facts.withColumnsRenamed({"x": c + "x", "y": c + "y", "d": DEGREE[i], "r": RIM[i]}), ["_g", c + "x", c + "y"])
    return save_step(tri.select("_g", *CORNERS, *FLAGS, "lim", *RIM, *DEGREE), "long")


def _can_go(tri: DataFrame, holes: bool) -> bool:
    """Whether a triangle anywhere can still be taken away."""
    long = [n > F.col("lim") for n in _lengths()]
    go = F.lit(False)
    for h, far, apex in zip(FLAGS, long, (RIM[2], RIM[0], RIM[1])):
        go = go | (F.col(h) & far & ~F.col(apex))
    if holes:
        go = go | ((long[0] | long[1] | long[2]) & ~F.col(RIM[0]) & ~F.col(RIM[1]) & ~F.col(RIM[2]))
    return not tri.where(go).isEmpty()


def _eroded(tri: DataFrame, holes: bool) -> DataFrame:
    """(_g, corners) of the long triangles taken away, in rounds over stretches of a Morton curve; where a round takes nothing although something can go,
    stretches grow."""
    middle = {v: (F.col("a" + v) + F.col("b" + v) + F.col("c" + v)) / 3 for v in "xy"}
    e = tri.agg(F.count(F.lit(1)).alias("n"), *[f(middle[v]).alias(v + i) for v in "xy" for f, i in ((F.min, "0"), (F.max, "1"))]).first()
    if not e["n"]:
        return tri.select("_g", *CORNERS)
    cell = max(e["x1"] - e["x0"], e["y1"] - e["y0"], 1e-300) / (1 << 20)
    names, gone = tri.columns, []
    kind = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in tri.schema.fields] + ["gone boolean"])
    left, tasks, turn = e["n"], math.ceil(e["n"] / TRIANGLES), 0
    for inner in (False, True) if holes else (False,):
        while True:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                batches = list(batches)
                if not batches:
                    return
                table = pa.Table.from_batches(batches).combine_chunks()
                groups: dict = {}
                for i, g in enumerate(table.column("_g").to_pylist()):
                    groups.setdefault(tuple(g.values()), []).append(i)
                bits = lambda names: np.column_stack([table.column(c).to_numpy() for c in names])
                xy, flags, rim, degree, lim = bits(CORNERS).reshape(-1, 3, 2), bits(FLAGS), bits(RIM), bits(DEGREE), table.column("lim").to_numpy()
                for rows in groups.values():
                    own, at = flags[rows], rim[rows]
                    alive = erode(xy[rows], own, lim[rows[0]], inner, at, degree[rows])
                    part = table.take(pa.array(rows))
                    for cols, now in ((FLAGS, own), (RIM, at)):
                        for i, c in enumerate(cols):
                            part = part.set_column(part.column_names.index(c), c, pa.array(now[:, i]))
                    yield from part.append_column("gone", pa.array(~alive)).to_batches()

            # the curve starts elsewhere in every round, so its stretches end elsewhere
            off = (turn * 0.6180339887498949) % 1
            c = [F.floor((middle[v] - e[v + "0"]) / cell + off * (1 << 20)) for v in "xy"]
            where = N.morton(c[0], c[1], 22)
            spread = tri.withColumn("_z", where).repartitionByRange(tasks, "_g", "_z").select(*names) if tasks > 1 else tri.coalesce(1)
            done = save_step(spread.mapInArrow(run, kind), "eroded")
            gone.append(done.where("gone").select("_g", *CORNERS))
            tri = done.where("NOT gone").drop("gone")
            turn += 1
            if tasks == 1 or not _can_go(tri, inner):
                break
            now = tri.count()
            if now == left:
                tasks = -(-tasks // 2)
            left = now
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def polygon_from_points(df: DataFrame, ratio: float = 0.4, holes: bool = True, by: list[str] = ()) -> DataFrame:
    """Concave hull per group of a point layer; ``ratio`` 1 gives the convex hull, 0 erodes as far as it goes.

    Border edges longer than the shortest edge plus ``ratio`` times the range of edge lengths are opened, as long as every point stays covered and
    the border simple; ``holes`` opens such triangles inside as well. Copies of a point count once; a group on one line or in one place gives that.
    Groups may have any size. Which of two long edges goes first depends on the tasks where a group has more than one, so hulls of large groups may
    differ in detail between runs of different size; what is said here holds for each."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be between 0 and 1")
    by = list(by)
    if ratio == 1:
        from .aggregate import convex_hull
        return convex_hull(df.select(*by, "geom"), by)
    pts = save_step(_points_of(df, by), "distinct-points")
    sizes = pts.groupBy("_g").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    most = sizes["most"] or 0
    schema = _with_group(pts, f"geom {GEOM}")

    def grouped(geometry_of):
        def run(table: pa.Table) -> pa.Table:
            return pa.table([_group_of(table), encode([geometry_of(table)])], ["_g", "geom"])

        return run

    def small(table):
        return concave_hull(np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()]), ratio, holes)

    def large(table):
        return _rings(*[table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])

    if most <= POINTS:
        out = pts.groupBy("_g").applyInArrow(grouped(small), schema)
    else:
        per_group = F.broadcast if sizes["groups"] <= FEW_GROUPS else (lambda d: d)   # large groups meet their one row without a shuffle
        tri, hull = _mesh(pts, most)
        n = _lengths()
        lim = tri.groupBy(F.col("_g").alias("_lg")).agg(F.min(F.least(*n)).alias("lo"), F.max(F.greatest(*n)).alias("hi")).select("_lg", (F.col("lo") + ratio * (F.col("hi") - F.col("lo"))).alias("lim"))
        lim = save_step(lim, "limits")
        gone = _eroded(_long_triangles(tri, hull, per_group(lim)), holes)
        # what is left has the outer edges as its border, less those of the triangles that went and plus their other ones
        ends = [F.struct(F.col("x" + i).alias("x"), F.col("y" + i).alias("y")) for i in "12"]
        sides = hull.withColumn("net", F.lit(1)).unionByName(_sides(gone).drop("i").withColumn("net", F.lit(-1)))
        sides = sides.select("_g", F.least(*ends).alias("p"), F.greatest(*ends).alias("q"), F.when(ends[0] < ends[1], F.col("net")).otherwise(-F.col("net")).alias("net"))
        net = sides.groupBy("_g", "p", "q").agg(F.sum("net").alias("net")).where("net <> 0")
        one, two = F.when(F.col("net") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("net") > 0, F.col("q")).otherwise(F.col("p"))
        edges = net.select("_g", one["x"].alias("x1"), one["y"].alias("y1"), two["x"].alias("x2"), two["y"].alias("y2"))
        out = save_step(edges.groupBy("_g").applyInArrow(grouped(large), schema), "hulls")   # a group's border is its result
        from .aggregate import convex_hull
        flat = pts.join(per_group(lim.select(F.col("_lg").alias("_g"))), "_g", "left_anti").select("_g", F.struct(F.lit("POINT").alias("gtype"), F.array(F.array(F.array(vertex("x", "y")))).alias("parts")).alias("geom"))
        out = out.unionByName(convex_hull(flat, ["_g"]).select("_g", "geom"))
    return set_srid(with_bbox(out.select(*[F.col("_g")[c].alias(c) for c in by], "geom")), srid_of(df))
