"""Aggregations of layers: dissolve, hulls, extents, inventories, bins, clusters."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import kernel as K, native as N
from ..functions.codec import decode
from ..layer import attribute_columns, ensure_bbox, geometry, make_box, make_line, set_srid, srid_of, vertex, with_bbox
from ..plans.reduce import merge_by_key


def _same(df_keys: list[str], l: str = "l", r: str = "r") -> list[Column]:
    return [F.col(f"{l}.`{k}`").eqNullSafe(F.col(f"{r}.`{k}`")) for k in df_keys]


def dissolve(df: DataFrame, by: str, geom: str = "geom", coverage: bool = False) -> DataFrame:
    """Union the geometries of each key; other attributes become their distinct values as text.

    Columns: attributes, key, geom, bbox.  A NULL key is a group of its own.  ``coverage`` promises polygons that do not overlap within
    a key: then shared borders cancel in one aggregate, without rounds of unions."""
    from .coverage import dissolved_shapes
    cols = [c for c in attribute_columns(df) if c != by]
    lists = [F.expr(f"listagg(DISTINCT CAST(`{c}` AS STRING), ', ') WITHIN GROUP (ORDER BY CAST(`{c}` AS STRING))").alias(c) for c in cols]
    shapes = dissolved_shapes(df, by, geom) if coverage else united(df, [by], geom)
    if not cols:
        out = shapes
    else:
        text = df.groupBy(by).agg(*lists)
        out = (text.alias("l").join(shapes.alias("r"), _same([by])).select(*[F.col(f"l.`{c}`") for c in cols], F.col(f"l.`{by}`"), F.col("r.geom")))
    return set_srid(with_bbox(out), srid_of(df, geom))


def union_layer(df: DataFrame, geom: str = "geom", coverage: bool = False) -> DataFrame:
    """One row: the union of a whole layer (``coverage`` as in ``dissolve``; an empty layer then gives no row)."""
    one = df.select(F.lit(0).alias("_k"), F.col(geom).alias("geom"))
    if coverage:
        from .coverage import dissolved_shapes
        return set_srid(with_bbox(dissolved_shapes(one, "_k").drop("_k")), srid_of(df, geom))
    return set_srid(with_bbox(united(one, ["_k"]).drop("_k")), srid_of(df, geom))


TILED_ROWS = 20_000   # from here on rectangles are united in tiles
COPIES = 64           # copies of a rectangle, one per tile it meets, on average at most
ROW_COPIES = 100_000  # and of any one


def _tile_side(w: Column, h: Column, df: DataFrame) -> float | None:
    """Side of the tiles for a layer of rectangles, a power of two that keeps the copies within their bounds; None for other layers."""
    g, b = F.col("geom"), F.col("bbox")
    e = df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(N.is_rect(g, b)).alias("rects"), F.sum(w * h).alias("area"), F.sum(w + h).alias("around"), F.max(w).alias("w"), F.max(h).alias("h"),
               F.max(F.greatest(*[F.abs(b[k]) for k in ("xmin", "ymin", "xmax", "ymax")])).alias("reach")).first()
    if e["n"] < TILED_ROWS or not e["rects"]:
        return None
    side = 2.0 ** math.ceil(math.log2(e["reach"] / 2.0 ** 40))
    while e["area"] / side ** 2 + e["around"] / side + e["n"] > COPIES * e["n"] or (e["w"] / side + 1) * (e["h"] / side + 1) > ROW_COPIES:
        side *= 2
    return side


def united(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """One row per key with the union of its geometries.

    A large layer of rectangles is cut at the lines of a grid, which moves no corner. A tile that one rectangle covers is done, whatever else lies in it; the
    pieces in other tiles are united tile by tile, and the tiles of a key are a coverage, whose inner borders cancel. So the work grows with the
    rectangles, not with how many lie over each other. Other layers are merged in rounds."""
    work = df.select(*keys, F.col(geom).alias("geom"))
    some = ensure_bbox(work.where(F.size("geom.parts") > 0))
    b = F.col("bbox")
    side = _tile_side(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"], some)
    if side is None:
        return merge_by_key(work, keys, "geom", K.union_many, K.union_one)
    from .coverage import dissolved_shapes
    numbers = lambda k: F.sequence(F.floor(b[k + "min"] / side), F.floor(b[k + "max"] / side))
    cells = some.select(F.struct(*keys).alias("_key"), "bbox", F.explode(numbers("x")).alias("cx")).select("_key", "bbox", "cx", F.explode(numbers("y")).alias("cy"))
    lo, hi = {k: F.col("c" + k) * side for k in "xy"}, {k: (F.col("c" + k) + 1) * side for k in "xy"}
    cut = cells.select("_key", "cx", "cy", *[F.greatest(b[k + "min"], lo[k]).alias(k + "0") for k in "xy"], *[F.least(b[k + "max"], hi[k]).alias(k + "1") for k in "xy"]).where("x0 < x1 AND y0 < y1")
    whole = (F.col("x0") == lo["x"]) & (F.col("x1") == hi["x"]) & (F.col("y0") == lo["y"]) & (F.col("y1") == hi["y"])
    at = ["_key", "cx", "cy"]
    full = save_step(cut.where(whole).select(*at).distinct(), "full-tiles")
    rest = cut.where(~whole).distinct().join(full, at, "left_anti")
    pieces = merge_by_key(rest.select(*at, make_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom")), at, "geom", K.union_many, K.union_one)
    tiles = full.select("_key", make_box(lo["x"], lo["y"], hi["x"], hi["y"]).alias("geom")).unionByName(pieces.select("_key", "geom"))
    shapes = dissolved_shapes(save_step(tiles, "tiles"), "_key").select(*[F.col("_key")[k].alias(k) for k in keys], "geom")
    # keys without a geometry have a NULL
    return work.select(*keys).distinct().alias("l").join(shapes.alias("r"), _same(keys), "left").select(*[F.col(f"l.`{k}`") for k in keys], F.col("r.geom"))


def _hull_merge(groups):
    return [K.hull(np.concatenate([r for g in geoms for p in g[1] for r in p])) for geoms in groups]


def convex_hull(df: DataFrame, by: list[str] = (), geom: str = "geom") -> DataFrame:
    """Convex hull per group, from hulls of pieces."""
    keys = list(by) or ["_k"]
    src = df if by else df.withColumn("_k", F.lit(0))
    out = merge_by_key(src, keys, geom, _hull_merge)
    return set_srid(with_bbox(out if by else out.drop("_k")), srid_of(df, geom))


@lru_cache(None)
def _circle():
    def run(arr: pa.Array) -> pa.Array:
        found = [None if g is None else K.smallest_circle(np.concatenate([r for p in g[1] for r in p])) if g[1] else None for g in decode(arr)]
        return pa.array([None if c is None else dict(zip(("x", "y", "radius"), c)) for c in found], pa.struct([(n, pa.float64()) for n in ("x", "y", "radius")]))

    return arrow_udf(run, "struct<x:double,y:double,radius:double>").asNondeterministic()


def bounding_circles(df: DataFrame, by: list[str] = (), geom: str = "geom", quad_segs: int = 48) -> DataFrame:
    """Smallest circle around each group: centre, radius, and the circle as a polygon of ``4 * quad_segs`` corners.

    The circle of a group is that of its convex hull, which is merged from hulls of pieces, so no task holds a group's vertices.  A group of one place has
    radius 0 and its point as ``geom``; a group without a place has NULLs."""
    c = F.col("_c")
    out = convex_hull(df, list(by), geom).select(*by, _circle()(F.col("geom")).alias("_c"))
    round_ = geometry("POLYGON", F.array(F.array(N.circle_ring(c["x"], c["y"], c["radius"], quad_segs))))
    shape = F.when(c["radius"] > 0, round_).when(c.isNotNull(), geometry("POINT", F.array(F.array(F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")))))))
    return set_srid(with_bbox(out.select(*by, c["x"].alias("x"), c["y"].alias("y"), c["radius"].alias("radius"), shape.alias("geom"))), srid_of(df, geom))


def collect_points(df: DataFrame, by: list[str], order: list[str], geom: str = "geom") -> DataFrame:
    """Gather the parts of a group into one multi geometry (a row of the result is one value, so it must fit a row)."""
    g = F.col(geom)
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, g.alias("_g")))), lambda s: s["_g"]["parts"]))
    kind = F.max(N.single_type(g))
    out = df.where(g.isNotNull()).groupBy(*by).agg(geometry(F.concat(F.lit("MULTI"), kind), parts).alias("geom"))
    return set_srid(with_bbox(out), srid_of(df, geom))


def make_lines(df: DataFrame, by: list[str], order: list[str], geom: str = "geom") -> DataFrame:
    """Line per group through its points in the given order."""
    v = N.vertices(F.col(geom))[0]
    pts = F.transform(F.array_sort(F.collect_list(F.struct(*order, v.alias("_v")))), lambda s: s["_v"])
    return set_srid(with_bbox(df.where(F.col(geom).isNotNull()).groupBy(*by).agg(pts.alias("_p")).select(*by, make_line(F.col("_p")).alias("geom"))),
                    srid_of(df, geom))


def centroid_of_group(df: DataFrame, by: list[str] = (), geom: str = "geom") -> DataFrame:
    """Centroid per group from weighted sums (area, else length, else count)."""
    g = F.col(geom)
    c = N.vertices(N.centroid(g))[0]
    w = F.when(N.is_polygonal(g), N.area(g)).when(N.is_linear(g), N.length(g)).otherwise(F.size(N.vertices(g)).cast("double"))
    top = df.where(g.isNotNull() & ~N.is_empty(g)).select(*by, N.dimension(g).alias("_d"), w.alias("_w"), c["x"].alias("_x"), c["y"].alias("_y"))
    per = top.groupBy(*by, "_d").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_x")).alias("_x"), F.sum(F.col("_w") * F.col("_y")).alias("_y"))
    best = per.groupBy(*by).agg(F.max_by(F.struct("_w", "_x", "_y"), "_d").alias("_m"))   # highest dimension counts
    out = best.select(*by, geometry("POINT", F.array(F.array(F.array(vertex(F.col("_m._x") / F.col("_m._w"), F.col("_m._y") / F.col("_m._w")))))).alias("geom"))
    return set_srid(with_bbox(out), srid_of(df, geom))


# ---------------------------------------------------------------- extents and counts

def extent(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Exact extent of a layer (or of each group)."""
    b = ensure_bbox(df).select(*by, "bbox")
    return b.groupBy(*by).agg(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"),
                              F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))


def estimated_extent(df: DataFrame, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Extent of a sample: cheap and never larger than the exact one."""
    return extent(df.sample(fraction=fraction, seed=seed))


def row_counts(df: DataFrame, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Exact and estimated row count, and whether the estimate is off by more than one row and twofold."""
    pick = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in attribute_columns(df)], F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(pick) / fraction).cast("long").alias("estimated"))
    return out.withColumn("mismatch", bad_estimate(F.col("n"), F.col("estimated")))


def bad_estimate(n: Column, est: Column) -> Column:
    return (F.abs(n - est) > 1) & ((n > 2 * est) | (est > 2 * n))


def type_inventory(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Rows and one sample geometry per geometry type."""
    g = F.col(geom)
    out = (df.where(g.isNotNull()).groupBy(g["gtype"].alias("gtype"))
           .agg(F.count(F.lit(1)).alias("n"), F.min(N.as_wkt(g)).alias("sample")))
    return out.withColumn("srid", F.lit(srid_of(df, geom)).cast("int"))


# Order of preference, multi types before single, polygons before lines before points.
TYPE_RANK = ("MULTIPOLYGON", "POLYGON", "MULTILINESTRING", "LINESTRING", "MULTIPOINT", "POINT")


def main_type(df: DataFrame, geom: str = "geom") -> DataFrame:
    inv = type_inventory(df, geom).select("gtype", "n")
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_RANK]), F.col("gtype"))
    return inv.orderBy(rank).limit(1)


def layer_tuning(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Average box size, extent and type mix of a layer."""
    b, g = F.col("bbox"), F.col("geom")
    return ensure_bbox(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(b["xmax"] - b["xmin"]).alias("avg_width"), F.avg(b["ymax"] - b["ymin"]).alias("avg_height"),
        F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"),
        F.count_if(N.is_puntal(g)).alias("points"), F.count_if(N.is_linear(g)).alias("lines"), F.count_if(N.is_polygonal(g)).alias("polygons"))


# ---------------------------------------------------------------- bins and clusters

def bin_layer(df: DataFrame, size: float, measures: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Counts and sums on a square grid, by box centre."""
    b = F.col("bbox")
    cx = F.floor((b["xmin"] + b["xmax"]) / 2 / float(size)).alias("bin_x")
    cy = F.floor((b["ymin"] + b["ymax"]) / 2 / float(size)).alias("bin_y")
    return ensure_bbox(df).where(b.isNotNull()).groupBy(*by, cx, cy).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures])


def tiled_aggregates(zones: DataFrame, df: DataFrame, zone_id: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of ``df`` over the zones that meet each row (columns of ``df`` carry the prefix ``b_``)."""
    from .joins import spatial_join
    pairs = spatial_join(zones.select(zone_id, "geom", *(["bbox"] if "bbox" in zones.columns else [])), df, "intersects")
    return pairs.groupBy(F.col("a_" + zone_id).alias(zone_id)).agg(*[c.alias(n) for n, c in aggs.items()])


def checkpoint_dir(spark) -> str:
    """Shared folder for cut lineage: the one the cluster names; a local session may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def save_step(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iterative job by a written table in the shared folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)   # steps go with the session
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node id of the component of every node; ``edges(u, v)``, ``nodes(id)``.

    Alternating large-star and small-star steps: work per round is linear in the
    edges, hub nodes are handled by grouped minima (map-side combined), and the
    number of rounds grows with the logarithm of the component size."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = save_step(e, "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the minimum of u
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u go to the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = save_step(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")), nodes["id"] == F.col("u"), "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def dense_cells(df: DataFrame, size: float, min_points: int) -> DataFrame:
    """Clusters of neighbouring grid cells that hold at least ``min_points`` rows each.

    Rows are counted per cell first, so the iterative part works on cells."""
    cells = bin_layer(df, size).where(F.col("n") >= min_points)
    if cells.isEmpty():
        return cells.withColumn("cluster", F.lit(None).cast("long")).select("bin_x", "bin_y", "n", "cluster")
    key = F.xxhash64("bin_x", "bin_y")
    cells = save_step(cells.withColumn("id", key), "cells")
    near = cells.select(F.col("id").alias("u"), F.explode(F.array(*[F.struct((F.col("bin_x") + dx).alias("x"), (F.col("bin_y") + dy).alias("y"))
                                                                    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))])).alias("p"))
    other = cells.select(F.col("id").alias("v"), F.col("bin_x").alias("x"), F.col("bin_y").alias("y"))
    edges = near.select("u", "p.x", "p.y").join(other, ["x", "y"]).select("u", "v")
    comp = connected_components(edges, cells.select("id"))
    return cells.join(comp, "id").select("bin_x", "bin_y", "n", F.col("component").alias("cluster"))


def spatial_clusters(df: DataFrame, size: float, min_points: int) -> DataFrame:
    """One row per cluster of dense cells: cells, rows and extent."""
    d = dense_cells(df, size, min_points)
    x, y = F.col("bin_x"), F.col("bin_y")
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), (F.min(x) * size).alias("xmin"), (F.min(y) * size).alias("ymin"),
                                    ((F.max(x) + 1) * size).alias("xmax"), ((F.max(y) + 1) * size).alias("ymax"))
