"""Layers made from points, and points made from layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import native as N
from ..layer import ensure_bbox, geometry, make_point, set_srid, srid_of, with_bbox
from ..plans.grid import candidate_pairs
from .aggregate import save_step
from .transform import force_single


def _uniform(key: Column, i: Column, stream: int) -> Column:
    """Reproducible uniform number in (0, 1) from a row key and a counter."""
    return (F.pmod(F.xxhash64(key, i, F.lit(stream)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def generate_points(df: DataFrame, n: int = 1, seed: int = 0, by: tuple[str, ...] = (), multipoint: bool = False) -> DataFrame:
    """``n`` random points inside the union of the polygons (of each group of ``by``).

    Every polygon part scatters points over its box at one common density and keeps
    those inside.  Where parts overlap, only the part with the smallest key keeps a
    point, so the union is covered evenly.  Then the n smallest hash values win.
    When heavy overlap leaves too few points the density goes up and the same plan
    runs again.  The result is a function of the layer, n and seed."""
    if n < 1:
        raise ValueError("the number of points must be 1 or more")
    by = list(by)
    srid = srid_of(df)
    polys = df.where(N.is_polygonal(F.col("geom"))).select(*by, "geom")
    parts = ensure_bbox(force_single(polys)).withColumn("_key", F.xxhash64(*by, F.col("geom"), F.lit(seed)))
    parts = parts.withColumn("_area", N.area(F.col("geom"))).where(F.col("_area") > 0).dropDuplicates([*by, "_key"])
    total = parts.groupBy(*by).agg(F.sum("_area").alias("_total"))
    if by:
        l, r = parts.alias("l"), total.alias("r")
        parts = l.join(r, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]).select("l.*", "r._total")
    else:
        parts = parts.withColumn("_total", total.select("_total").scalar())
    want = n + 10 * math.sqrt(n) + 20
    for _ in range(40):
        picked = save_step(_scatter(parts, by, want), "points")   # a little over n rows per group
        got = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
        if by:   # groups without any accepted point count as zero
            got = total.alias("l").join(got.alias("r"), [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by], "left").select("r.c")
        low = got.agg(F.min(F.coalesce("c", F.lit(0))).alias("low")).first()["low"]
        if low is None or low >= n:
            break
        if not by and total.first()["_total"] is None:
            break
        want *= max(2.0, 1.3 * n / low) if low else 4.0
    else:
        raise RuntimeError("some polygons are too small for points to fall inside")
    if by:
        w = Window.partitionBy(*by).orderBy("_rank")
        picked = picked.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    else:
        picked = picked.orderBy("_rank").limit(n)
    if not multipoint:
        return set_srid(with_bbox(picked.select(*by, make_point("_x", "_y").alias("geom"))), srid)
    # at most n points per group
    pts = F.array_sort(F.collect_list(F.struct(F.col("_rank"), F.col("_x"), F.col("_y"))))
    geom = geometry("MULTIPOINT", F.transform(F.col("_p"), lambda p: F.array(F.array(F.struct(p["_x"].alias("x"), p["_y"].alias("y"))))))
    return set_srid(with_bbox(picked.groupBy(*by).agg(pts.alias("_p")).select(*by, geom.alias("geom"))), srid)


def _scatter(parts: DataFrame, by: list[str], want: float) -> DataFrame:
    box, key = F.col("bbox"), F.col("_key")
    mean = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"]) * want / F.col("_total")
    count = (F.floor(mean) + (_uniform(key, F.lit(0), 0) < mean - F.floor(mean)).cast("long"))
    drawn = (parts.withColumn("_count", count).where(F.col("_count") > 0)
             .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_count"))))
             .withColumn("_x", box["xmin"] + _uniform(key, F.col("_i"), 1) * (box["xmax"] - box["xmin"]))
             .withColumn("_y", box["ymin"] + _uniform(key, F.col("_i"), 2) * (box["ymax"] - box["ymin"]))
             .where(N.point_location(F.col("geom"), F.col("_x"), F.col("_y")) == 1))
    pts = with_bbox(drawn.select(*by, "_key", "_i", "_x", "_y", make_point("_x", "_y").alias("geom")))
    pairs, _ = candidate_pairs(pts, parts.select(*by, "_key", "geom", "bbox"))
    same = F.lit(True)
    for c in by:
        same = same & F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    covered = pairs.where(same & (N.point_location(F.col("b_geom"), F.col("a_bbox.xmin"), F.col("a_bbox.ymin")) == 1))
    first = covered.groupBy(*[F.col("a_" + c).alias(c) for c in by], F.col("a__key").alias("_key"), F.col("a__i").alias("_i"),
                            F.col("a__x").alias("_x"), F.col("a__y").alias("_y")).agg(F.min("b__key").alias("_first"))
    return first.where(F.col("_first") == F.col("_key")).withColumn("_rank", F.xxhash64("_key", "_i"))
