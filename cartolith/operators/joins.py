"""Spatial joins: predicates, distances, nearest neighbours, overlay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import exact as X, native as N
from ..layer import LINEAR, PARTS, POLYGONAL, PUNTAL, SridError, attribute_columns, bbox_of, empty, ensure_bbox, geometry, make_box, set_srid, srid_of, with_bbox
from ..plans.grid import GridPlan, both_rects, boxes_only, candidate_pairs, rows_with_pair, spread, tidy
from .aggregate import save_step, united
from .transform import reproject

PREDICATES = ("intersects", "contains", "containsproperly", "within", "covers", "coveredby", "overlaps", "crosses",
              "touches", "equals", "disjoint")


def align(a: DataFrame, b: DataFrame, align_srid: bool = True, geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """Bring ``b`` to the SRID of ``a``, or raise when that is not wanted."""
    sa, sb = srid_of(a, geom), srid_of(b, geom)
    if sa is None or sb is None or sa == sb:
        return a, b
    if not align_srid:
        raise SridError(f"layers have different SRIDs: {sa} and {sb}")
    return a, reproject(b, sa)


def _kind(types) -> int | None:
    """Common dimension of all geometry types, None when mixed."""
    kinds = {2 if t in POLYGONAL else 1 if t in LINEAR else 0 for t in types}
    return kinds.pop() if len(kinds) == 1 else None


def _only_points(types) -> bool:
    return tuple(types) == ("POINT",)


def _corner(box: Column) -> dict[str, Column]:
    return {"x": box["xmin"], "y": box["ymin"]}


def pair_predicate(name: str, plan: GridPlan, pattern: str | None = None) -> Column:
    """Exact predicate on candidate pairs, native where the geometry types allow."""
    a, b, abox, bbox = F.col("a_geom"), F.col("b_geom"), F.col("a_bbox"), F.col("b_bbox")
    lk, rk = _kind(plan.left.types), _kind(plan.right.types)
    # a point is its box, and a box is a plain field (lambdas would unpack the geometry at every step)
    va, vb = _corner(abox), _corner(bbox)
    if name == "relate":
        if lk == rk == 2 and pattern[0] in "T012t":   # interiors of polygons meet in an area or not at all, so flat common boxes need no matrix
            deep = (F.greatest(va["x"], vb["x"]) < F.least(abox["xmax"], bbox["xmax"])) & (F.greatest(va["y"], vb["y"]) < F.least(abox["ymax"], bbox["ymax"]))
            return F.coalesce(X.matches(X.relate(F.when(deep, a), F.when(deep, b)), pattern), F.lit(False))
        return X.matches(X.relate(a, b), pattern)
    if _only_points(plan.left.types) and _only_points(plan.right.types):
        same = (va["x"] == vb["x"]) & (va["y"] == vb["y"])
        return F.lit(False) if name in ("touches", "overlaps", "crosses") else same
    if _only_points(plan.left.types) and rk == 2:
        loc = _location(b, bbox, va, plan.right.rects, "b__rect")
        return X.point_polygon_predicate(name, loc, True)
    if lk == 2 and _only_points(plan.right.types):
        loc = _location(a, abox, vb, plan.left.rects, "a__rect")
        return X.point_polygon_predicate(name, loc, False)
    rect = both_rects(plan)
    if rect is True:
        return X.rect_predicate(name, abox, bbox)
    if plan.left.segments and plan.right.rects and name in X.SEGMENT_RECT:
        return X.segment_rect_predicate(name, a, abox, bbox)
    matrix = X.relate(F.when(~rect, a), F.when(~rect, b))
    general = X.predicate_from_matrix(matrix, name, N.dimension(a), N.dimension(b))
    return F.when(rect, X.rect_predicate(name, abox, bbox)).otherwise(general)


def _location(polygon: Column, box: Column, v: Column, all_rects: bool, flag: str) -> Column:
    quick = X.rect_point_location(box, v["x"], v["y"])
    return quick if all_rects else F.when(F.col(flag), quick).otherwise(N.point_location(polygon, v["x"], v["y"]))


def spatial_join(a: DataFrame, b: DataFrame, predicate: str = "intersects", how: str = "inner", id: str | None = None,
                 pattern: str | None = None, align_srid: bool = False, plan: GridPlan | None = None) -> DataFrame:
    """Join two layers on a named predicate (or ``relate`` with a DE-9IM pattern).

    inner and left return both sides with the prefixes ``a_`` and ``b_``; semi and
    anti return rows of ``a``.  left, semi and anti need ``id``, a key of ``a``.
    ``disjoint`` is the complement of intersects, so it is offered as semi / anti."""
    predicate = predicate.lower()
    if predicate not in PREDICATES and predicate != "relate":
        raise ValueError(f"unknown predicate {predicate!r}")
    if predicate == "disjoint":
        flip = {"semi": "anti", "anti": "semi"}.get(how)
        if flip is None:
            raise ValueError("disjoint pairs are nearly all pairs; use how='semi' (disjoint from every row of b) or 'anti'")
        return spatial_join(a, b, "intersects", flip, id, align_srid=align_srid, plan=plan)
    a, b = align(a, b, align_srid)
    a, b = ensure_bbox(a), ensure_bbox(b)
    pairs, plan = candidate_pairs(a, b, plan=plan, only=predicate)
    test = pair_predicate(predicate, plan, pattern)
    hits = rows_with_pair(_marked(a, id), b, test, plan) if how != "inner" and id is not None and predicate != "relate" and boxes_only(plan) else None
    return finish_join(a, b, pairs.where(test), how, id, hits)


def content_mark(a: DataFrame, prefix: str = "") -> Column:
    """128 bits that tell rows of ``a`` apart by what they hold, whatever their key is; rows that hold the same share it."""
    plain = [c for c in a.columns if a.schema[c].dataType.typeName() not in ("map", "variant")]
    return F.struct(*[F.xxhash64(F.lit(seed), *[F.col(f"`{prefix}{c}`") for c in plain]).alias(f"h{seed}") for seed in (1, 2)])


def _marked(a: DataFrame, id: str) -> DataFrame:
    """What a search for rows with a pair needs of ``a``: key, content and box."""
    return a.select(F.col(f"`{id}`").alias("_hit_id"), content_mark(a).alias("_hit"), "bbox")


def finish_join(a: DataFrame, b: DataFrame, pairs: DataFrame, how: str, id: str | None, hits: DataFrame | None = None) -> DataFrame:
    """Rows of ``a`` that have a pair are known by their key and their content, so a NULL or repeated key neither hides a row nor doubles it.

    ``hits`` are such rows when something cheaper than the pairs tells them (``_marked`` under the prefix ``a_``).  They can be nearly all rows of ``a``,
    whatever the size of its file says, so they are told to shuffle and never go through the driver."""
    pairs = tidy(pairs)
    if how == "inner":
        return pairs
    if id is None:
        raise ValueError(f"how={how!r} needs the key column of the first layer")
    if hits is None:
        hit = pairs.select(F.col(f"`a_{id}`").alias("_hit_id"), content_mark(a, "a_").alias("_hit")).distinct()
    else:
        hit = hits.select(F.col("a__hit_id").alias("_hit_id"), F.col("a__hit").alias("_hit")).distinct()
    hit = hit.hint("merge")
    same = F.col(f"`{id}`").eqNullSafe(F.col("_hit_id")) & (content_mark(a) == F.col("_hit"))
    if how in ("semi", "anti"):
        return a.join(hit, same, "left_" + how)
    if how != "left":
        raise ValueError(f"unknown how {how!r}")
    rest = a.join(hit, same, "left_anti").select(*[F.col(f"`{c}`").alias("a_" + c) for c in a.columns])
    return pairs.unionByName(rest, allowMissingColumns=True)


MBR_TESTS = ("intersects", "equals", "touches", "within", "contains", "overlaps", "disjoint")


def mbr_join(a: DataFrame, b: DataFrame, test: str = "intersects", how: str = "inner", id: str | None = None,
             plan: GridPlan | None = None) -> DataFrame:
    """Join on bounding boxes only; all column arithmetic."""
    if test not in MBR_TESTS:
        raise ValueError(f"unknown box test {test!r}")
    if test == "disjoint":
        if how not in ("semi", "anti"):
            raise ValueError("disjoint boxes are nearly all pairs; use how='semi' or 'anti'")
        return mbr_join(a, b, "intersects", "anti" if how == "semi" else "semi", id, plan)
    a, b = ensure_bbox(a), ensure_bbox(b)
    pairs, plan = candidate_pairs(a, b, ageom=None, bgeom=None, plan=plan, only=test)
    holds = X.rect_predicate(test, F.col("a_bbox"), F.col("b_bbox"))
    hits = rows_with_pair(_marked(a, id), b, holds, plan) if how != "inner" and id is not None else None
    return finish_join(a, b, pairs.where(holds), how, id, hits)


def only_rects(df: DataFrame, geom: str = "geom") -> bool:
    """Whether every geometry of a layer is an axis-aligned rectangle (one small job)."""
    return bool(ensure_bbox(df, geom).agg(F.bool_and(N.is_rect(F.col(geom), F.col("bbox"))).alias("all")).first()["all"])


def bbox_filter(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, geom: str = "geom") -> DataFrame:
    """Rows whose box meets a rectangle; on stored layers the test reaches the Parquet scan."""
    b = F.col("bbox")
    return ensure_bbox(df, geom).where((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))


# ---------------------------------------------------------------- distances

def _pair_distance(plan: GridPlan) -> Column:
    a, b = F.col("a_geom"), F.col("b_geom")
    va, vb = _corner(F.col("a_bbox")), _corner(F.col("b_bbox"))
    if _only_points(plan.left.types) and _only_points(plan.right.types):
        return N.point_distance(va["x"], va["y"], vb["x"], vb["y"])
    if (plan.left.rects or plan.left.points) and (plan.right.rects or plan.right.points):
        return X.box_distance(F.col("a_bbox"), F.col("b_bbox"))   # points and rectangles are their boxes
    if _only_points(plan.right.types):
        return N.point_to_geometry(a, vb["x"], vb["y"])
    if _only_points(plan.left.types):
        return N.point_to_geometry(b, va["x"], va["y"])
    return X.distance(a, b)


def within_distance_join(a: DataFrame, b: DataFrame, d: float, how: str = "inner", id: str | None = None, fully: bool = False,
                         plan: GridPlan | None = None) -> DataFrame:
    """Pairs at most ``d`` apart with column ``dist``; ``fully`` asks the same of the farthest points."""
    a, b = align(a, b)
    a, b = ensure_bbox(a), ensure_bbox(b)
    pairs, plan = candidate_pairs(a, b, grow_b=float(d), plan=plan)
    if fully:
        far = X.box_max_distance(F.col("a_bbox"), F.col("b_bbox"))
        points = _only_points(plan.left.types) and _only_points(plan.right.types)
        rect = both_rects(plan)
        dist = _pair_distance(plan) if points else far if boxes_only(plan) else F.when(rect, far).otherwise(
            X.max_distance(F.when(~rect, F.col("a_geom")), F.when(~rect, F.col("b_geom"))))
    else:
        dist = _pair_distance(plan)
    pairs = pairs.withColumn("dist", dist).where(F.col("dist") <= float(d))
    return finish_join(a, b, pairs, how, id)


def radius_of_pairs(a: DataFrame, b: DataFrame, k: int, d: float) -> float:
    """A distance up to ``d`` within which all of the ``k`` closest pairs at most ``d`` apart lie: the first of growing ones with k pairs.

    The search starts where a few times k pairs are to be expected of rows that lie evenly, so it looks at about as many as it asks for, not at all pairs."""
    a, b = align(a, b)
    a, b = ensure_bbox(a), ensure_bbox(b)
    box, spots = F.col("bbox"), []
    for df in (a, b):
        spots.append(df.agg(F.count(box["xmin"]).alias("n"), F.min(box["xmin"]).alias("x0"), F.min(box["ymin"]).alias("y0"), F.max(box["xmax"]).alias("x1"), F.max(box["ymax"]).alias("y1")).first())
    if not spots[0]["n"] or not spots[1]["n"]:
        return d
    x, y = (max(s[c + "1"] for s in spots) - min(s[c + "0"] for s in spots) for c in "xy")
    r = math.sqrt(4 * k * x * y / (math.pi * spots[0]["n"] * spots[1]["n"]))
    while 0 < r < d:
        if within_distance_join(a.select("geom", "bbox"), b.select("geom", "bbox"), r).limit(k).count() >= k:
            return r
        r *= 4
    return d


def distance_band_join(a: DataFrame, points: DataFrame, max_d: float, min_d: float | None = None, point_id: str | None = None,
                       single: bool = False) -> DataFrame:
    """One row of ``a`` per point whose distance lies in the band.

    Without a minimum (None or 0) points inside ``a`` count too, at distance 0.
    Returns the columns of ``a``, ``dist`` and, when named, the point key."""
    a, points = align(a, points)
    a, points = ensure_bbox(a), ensure_bbox(points)
    pairs, plan = candidate_pairs(a, points, grow_b=float(max_d))
    pairs = pairs.withColumn("dist", _pair_distance(plan)).where(F.col("dist") <= float(max_d))
    if min_d:
        pairs = pairs.where(F.col("dist") >= float(min_d))
    keep = [F.col("a_" + c).alias(c) for c in a.columns] + ([F.col("b_" + point_id).alias(point_id)] if point_id else []) + ["dist"]
    out = set_srid(pairs.select(*keep), srid_of(a))
    if single:
        from .transform import force_single
        out = force_single(out)
    return out


NARROWED_ROWS = 20_000   # from here on radii are narrowed before neighbours are gathered


def _narrowed(ac: DataFrame, a: DataFrame, pts: DataFrame, k: int, b_id: str) -> DataFrame:
    """Smaller radii ``_r`` that still hold k neighbours: with the neighbours dealt out to k classes, the farthest of the classes' nearest ones bounds the
    k-th distance.  The nearest ones are k minima per row, summed up before the shuffle, so only pairs within the new radius are ever written."""
    number = F.pmod(F.xxhash64(b_id), F.lit(k))
    seen = set_srid(ac.select(content_mark(a).alias("m"), "geom", "bbox", "_r"), srid_of(a))
    pairs, plan = candidate_pairs(pts.select(number.alias("class"), "geom", "bbox"), seen, grow_b=F.col("_r"))
    pairs = pairs.withColumn("dist", _pair_distance(plan)).where(F.col("dist") <= F.col("b__r"))
    least = pairs.groupBy("b_m.h1", "b_m.h2").agg(*[F.min(F.when(F.col("a_class") == i, F.col("dist"))).alias(f"d{i}") for i in range(k)])
    every = F.lit(True)
    for i in range(k):
        every = every & F.col(f"d{i}").isNotNull()
    far = F.greatest(*[F.col(f"d{i}") for i in range(k)], F.lit(0.0)) * (1 + 1e-9)
    bound = least.where(every).select(F.struct("h1", "h2").alias("_m"), far.alias("_far"))
    out = ac.join(bound.hint("merge"), content_mark(a) == F.col("_m"), "left")
    return out.select(*a.columns, F.least("_r", F.coalesce("_far", "_r")).alias("_r"))


def knn_join(a: DataFrame, b: DataFrame, k: int, a_id: str, b_id: str, cell0: float | None = None) -> DataFrame:
    """The ``k`` nearest features of ``b`` for every feature of ``a``; ties by ``b_id``. A row of ``a`` counts for itself, also under a NULL or repeated key.

    The search radius of a row comes from counts of one vertex per feature of ``b``
    on a ladder of grids: the finest cell around a vertex of the row that holds k of
    them bounds the k-th distance by its diagonal.  So dense places search small
    circles and empty places large ones; boxes within the radius are then measured
    exactly.  Of points at one place only the k smallest keys can be results, so
    copies are cut to k before the search (this changes no result)."""
    a, b = align(a, b)
    a, b = ensure_bbox(a), ensure_bbox(b)
    shape = F.when(F.col("geom")["gtype"] != "POINT", F.col(b_id))   # only points at one place are copies of each other
    place = Window.partitionBy("_x", "_y", "_shape").orderBy(b_id)
    bb, one = F.col("bbox"), F.get(F.get(F.get(F.col("geom")["parts"], F.lit(0)), F.lit(0)), F.lit(0))   # a vertex stands for its feature
    pts = (b.where(bb.isNotNull()).withColumn("_x", one["x"]).withColumn("_y", one["y"]).withColumn("_shape", shape)
           .withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n", "_shape"))
    box = lambda d: (F.min(d["bbox"]["xmin"]), F.min(d["bbox"]["ymin"]), F.max(d["bbox"]["xmax"]), F.max(d["bbox"]["ymax"]))
    e = b.agg(F.count(bb["xmin"]).alias("n"), *[c.alias(n) for c, n in zip(box(b), "pqrs")]).first()
    f = a.agg(F.count(F.col("bbox")["xmin"]).alias("n"), *[c.alias(n) for c, n in zip(box(a), "pqrs")]).first()
    if not e["n"] or f["p"] is None:
        cols = [F.col(c).alias("a_" + c) for c in a.columns]
        return (a.select(*cols).join(b.select(*[F.col(c).alias("b_" + c) for c in b.columns]).where(F.lit(False)), F.lit(False))
                .withColumn("dist", F.lit(0.0)).withColumn("rank", F.lit(1)).where(F.lit(False)))
    x0, y0 = min(e["p"], f["p"]), min(e["q"], f["q"])
    extent = max(e["r"] - x0, e["s"] - y0, f["r"] - x0, f["s"] - y0, 1e-9) * 1.0000001
    # about k points per cell on average over the extent, then on to places a million times denser
    top = math.ceil(math.log2(max(math.sqrt(e["n"] / k), 2))) + 10
    levels = list(range(0, min(top, 30) + 1, 2))   # cell numbers stay below 2^31; beyond, doubles of such an extent differ by little more

    def cell(level, x, y):
        size = extent / 2 ** level
        return F.floor((x - x0) / size).alias("cx"), F.floor((y - y0) / size).alias("cy")

    finest = levels[-1]
    counts = pts.groupBy(*cell(finest, F.col("_x"), F.col("_y"))).agg(F.count(F.lit(1)).alias("n"))
    homes = a.where(bb.isNotNull()).select(*cell(finest, one["x"], one["y"])).distinct()
    ladder = counts.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    full = (ladder.groupBy("level", F.expr(f"shiftright(cx, {finest} - level)").alias("ux"), F.expr(f"shiftright(cy, {finest} - level)").alias("uy"))
            .agg(F.sum("n").alias("n")).where(F.col("n") >= min(k, e["n"]))).select("level", "ux", "uy")
    asked = (homes.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
             .withColumn("ux", F.expr(f"shiftright(cx, {finest} - level)")).withColumn("uy", F.expr(f"shiftright(cy, {finest} - level)")))
    # cells, bounds and copies may be nearly as many as the rows, whatever the sizes of files and compressed shuffles say: no such side reaches the driver
    radius = asked.join(full.hint("merge"), ["level", "ux", "uy"]).groupBy("cx", "cy").agg(F.max("level").alias("level"))
    cx, cy = cell(finest, one["x"], one["y"])
    ac = a.where(bb.isNotNull()).withColumn("_cx", cx).withColumn("_cy", cy)
    # one row per cell on the right, so the adaptive join can split a busy cell
    ac = ac.join(radius.select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("level").alias("_level")).hint("merge"), ["_cx", "_cy"], "left")
    reach = F.coalesce(extent / F.pow(F.lit(2.0), F.col("_level")), F.lit(extent)) * (math.sqrt(2) * (1 + 1e-9))
    ac = ac.select(*a.columns, reach.alias("_r"))
    if f["n"] >= NARROWED_ROWS:
        ac = _narrowed(ac, a, pts, k, b_id)
    pairs, plan = candidate_pairs(pts.drop("_x", "_y"), ac, grow_b=F.col("_r"))
    # candidate_pairs puts the grown side second: a_ is the neighbour here, b_ the searching row
    pairs = pairs.withColumn("dist", _pair_distance(plan)).where(F.col("dist") <= F.col("b__r"))
    swap = [F.col("b_" + c).alias("a_" + c) for c in a.columns] + [F.col("a_" + c).alias("b_" + c) for c in b.columns]
    pairs = pairs.select(*swap, "dist")
    # rows that hold the same share a mark, so each neighbour shows up once for each of them; such rows are rare and one aggregate finds them
    more = a.groupBy(content_mark(a).alias("_same")).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    pairs = pairs.withColumn("_mark", content_mark(a, "a_")).join(more.hint("merge"), F.col("_mark") == F.col("_same"), "left")
    w = Window.partitionBy("_mark").orderBy("dist", "b_" + b_id)
    nth = F.ceil(F.row_number().over(w) / F.coalesce(F.col("_copies"), F.lit(1))).cast("int")
    return pairs.withColumn("rank", nth).where(F.col("rank") <= k).drop("_mark", "_same", "_copies")


# ---------------------------------------------------------------- overlay

def _parts_only(g: Column) -> Column:
    return F.size(g["parts"]) > 0


def _layer(pairs: DataFrame, cols: list[str], geom: Column, srid: int | None) -> DataFrame:
    out = pairs.withColumn("_g", geom).where(_parts_only(F.col("_g")))
    return set_srid(with_bbox(out.select(*[F.col("a_" + c).alias(c) for c in cols], F.col("_g").alias("geom"))), srid)


def intersection(a: DataFrame, mask: DataFrame, cols: list[str] | None = None, align_srid: bool = False,
                 mask_cols: list[str] = (), plan: GridPlan | None = None, where: str | Column | None = None) -> DataFrame:
    """Intersection geometry of every pair that meets (a boundary touch counts).

    Keeps ``cols`` of ``a`` (default all attributes) and ``mask_cols`` of the mask; ``where`` chooses rows of ``a`` before the join."""
    a = a if where is None else a.where(where)
    a, mask = align(a, mask, align_srid)
    a, mask = ensure_bbox(a), ensure_bbox(mask)
    pairs, plan = candidate_pairs(a, mask, plan=plan)
    cols = attribute_columns(a) if cols is None else list(cols)
    pairs, geom = _pair_intersection(pairs, plan)
    pairs = pairs.withColumns({"a_" + c: F.col("b_" + c) for c in mask_cols if c not in cols})
    return _layer(pairs, cols + [c for c in mask_cols if c not in cols], geom, srid_of(a))


def _pair_intersection(pairs: DataFrame, plan: GridPlan) -> tuple[DataFrame, Column]:
    if _only_points(plan.left.types) and _kind(plan.right.types) == 2:
        return pairs.where(pair_predicate("intersects", plan)), F.col("a_geom")
    if _kind(plan.left.types) == 2 and _only_points(plan.right.types):
        return pairs.where(pair_predicate("intersects", plan)), F.col("b_geom")
    if plan.left.segments and plan.right.rects:
        return pairs, X.segment_rect_intersection(F.col("a_geom"), F.col("a_bbox"), F.col("b_bbox"))
    return pairs, X.intersection(F.col("a_geom"), F.col("b_geom"), F.col("a_bbox"), F.col("b_bbox"), both_rects(plan))


def split_by_type(layer: DataFrame) -> dict[str, DataFrame]:
    """One layer per dimension, as a map of lazy filters."""
    g = F.col("geom")["gtype"]
    return {"point": layer.where(g.isin(*PUNTAL)), "line": layer.where(g.isin(*LINEAR)), "polygon": layer.where(g.isin(*POLYGONAL))}


def clip(layer: DataFrame, mask: DataFrame, single: bool = False, rule: str = "reference") -> DataFrame:
    """Part of each feature inside each mask feature, one row per pair.

    rule "reference": the pair must contain, overlap or be within; "interior" adds
    lines that cross the mask.  Parts of the highest dimension are kept."""
    if rule not in ("reference", "interior"):
        raise ValueError(f"unknown rule {rule!r}")
    a, b = align(layer, mask)
    a, b = ensure_bbox(a), ensure_bbox(b)
    pairs, plan = candidate_pairs(a, b)
    lk, rk = _kind(plan.left.types), _kind(plan.right.types)
    cols, srid = attribute_columns(a), srid_of(a)
    if _only_points(plan.left.types) and rk == 2:
        out = _layer(pairs.where(pair_predicate("within", plan)), cols, F.col("a_geom"), srid)
    else:
        dim_a = N.dimension(F.col("a_geom"))
        if lk == 2 and rk == 2:
            # two polygons contain, overlap or are within exactly when they share area
            pass
        elif rule == "reference":
            pairs = pairs.where(pair_predicate("contains", plan) | pair_predicate("overlaps", plan) | pair_predicate("within", plan))
        pairs, geom = _pair_intersection(pairs, plan)
        pairs = pairs.withColumn("_cut", geom).where(N.dimension(F.col("_cut")) == F.least(dim_a, N.dimension(F.col("b_geom"))))
        out = _layer(pairs, cols, F.col("_cut"), srid)
    from .transform import force_multi, force_single
    return force_single(out) if single else force_multi(out)


FEW_PIECES = 8   # so many rectangles are looked at together, more are united in rounds or tiles


def _covers(pieces: DataFrame, rects: bool) -> DataFrame:
    """``h1``, ``h2`` and the union of the pieces under them; few rectangles that fill their common box are that box, which most rows have."""
    keys = ["h1", "h2"]
    if not rects:
        return united(pieces, keys)
    few = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FEW_PIECES).drop("n")
    boxes = pieces.join(few.hint("merge"), keys).select(*keys, bbox_of(F.col("geom")).alias("b")).groupBy(*keys).agg(F.collect_list("b").alias("bs"))
    bs = F.col("bs")
    each = lambda k: F.transform(bs, lambda b: b[k])
    lows, highs = [F.array_min(each(k)) for k in ("xmin", "ymin")], [F.array_max(each(k)) for k in ("xmax", "ymax")]
    at = lambda lo, hi: F.array_sort(F.array_distinct(F.concat(each(lo), each(hi))))

    def filled(xs, ys):
        """Every cell between neighbouring sides lies in a piece."""
        cell = lambda i, j: F.exists(bs, lambda b: (b["xmin"] <= xs[i]) & (b["xmax"] >= xs[i + 1]) & (b["ymin"] <= ys[j]) & (b["ymax"] >= ys[j + 1]))
        return F.forall(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.forall(F.sequence(F.lit(0), F.size(ys) - 2), lambda j: cell(i, j)))

    boxes = boxes.withColumns({"xs": at("xmin", "xmax"), "ys": at("ymin", "ymax")})
    done = boxes.where((F.size(bs) == 1) | filled(F.col("xs"), F.col("ys"))).select(*keys, make_box(*lows, *highs).alias("geom"))
    done = save_step(done, "covers")
    rest = save_step(pieces.join(done.select(*keys).hint("merge"), keys, "left_anti"), "pieces")
    return done if rest.isEmpty() else done.unionByName(united(rest, keys).select(*keys, "geom"))


def difference(a: DataFrame, b: DataFrame, id: str, single: bool = False, drop_empty: bool = False) -> DataFrame:
    """Each feature of ``a`` minus everything in ``b``.

    Only the pieces of ``b`` that lie inside a feature are united for it, in
    rounds (no union of the whole layer).  Covered features stay with an empty
    geometry unless ``drop_empty``.  Features are told apart by what they hold, so
    NULL and repeated keys are cut like any other."""
    a, b = align(a, b)
    a, b = ensure_bbox(a), ensure_bbox(b)
    pairs, plan = candidate_pairs(a, b)
    lk, rk = _kind(plan.left.types), _kind(plan.right.types)
    if _only_points(plan.left.types) and rk == 2:
        if boxes_only(plan):
            hit = rows_with_pair(a.select(content_mark(a).alias("_m"), "bbox"), b, pair_predicate("intersects", plan), plan).select(F.col("a__m").alias("_gone")).distinct()
        else:
            hit = pairs.where(pair_predicate("intersects", plan)).select(content_mark(a, "a_").alias("_gone")).distinct()
        gone = F.col("_gone").isNotNull()
        out = a.join(hit.hint("merge"), content_mark(a) == F.col("_gone"), "left")   # no estimate may send the hits through the driver
        out = out.withColumn("geom", F.when(gone, geometry("POINT", F.array().cast(PARTS)))
                             .otherwise(F.col("geom"))).drop("_gone")
    else:
        # a cut needs at least the dimension of the feature, so drop lower-dimensional contact early
        pairs, geom = _pair_intersection(pairs, plan)
        cut = (pairs.withColumn("_cut", geom).where(_parts_only(F.col("_cut")) & (N.dimension(F.col("_cut")) >= N.dimension(F.col("a_geom"))))
               .select(content_mark(a, "a_").alias("_m"), F.col("_cut").alias("geom")).select("_m.h1", "_m.h2", "geom"))
        cover = _covers(save_step(cut, "pieces"), both_rects(plan) is True).select(F.struct("h1", "h2").alias("_m"), F.col("geom").alias("_cover"))
        out = spread(a, plan.left).join(cover, content_mark(a) == F.col("_m"), "left")
        g, c = F.col("geom"), F.col("_cover")
        gone = F.coalesce(X.is_rect(g, F.col("bbox")) & X.is_rect(c, F.col("bbox")), F.lit(False))   # a rectangle under itself
        cut = ~gone & c.isNotNull()
        out = out.withColumn("geom", F.when(gone, empty()).when(cut, X.difference(F.when(cut, g), c)).otherwise(g)).drop("_cover")
    out = set_srid(with_bbox(out.select(*a.columns)), srid_of(a))
    if drop_empty:
        out = out.where(_parts_only(F.col("geom")))
    from .transform import force_multi, force_single
    return force_single(out, keep_empty=not drop_empty) if single else force_multi(out)


def area_weighted(zones: DataFrame, data: DataFrame, zone_id: str, measures: list[str], plan: GridPlan | None = None) -> DataFrame:
    """Sum of each measure of ``data`` per zone, weighted by the share of its area in the zone."""
    a, b = align(zones, data)
    a, b = ensure_bbox(a), ensure_bbox(b)
    a = a.select(zone_id, "geom", "bbox")
    b = b.select(*measures, "geom", "bbox").withColumn("_area", N.area(F.col("geom")))
    pairs, plan = candidate_pairs(a, b, plan=plan)
    pairs, geom = _pair_intersection(pairs, plan)
    share = F.when(F.col("b__area") > 0, N.area(F.col("_cut")) / F.col("b__area")).otherwise(F.lit(0.0))
    pairs = pairs.withColumn("_cut", geom).withColumn("_share", share).where(F.col("_share") > 0)
    return pairs.groupBy(F.col("a_" + zone_id).alias(zone_id)).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("b_" + m) * F.col("_share")).alias(m) for m in measures])


def colocated(a: DataFrame, b: DataFrame, a_type: str, b_type: str, d: float) -> DataFrame:
    """Counts of pairs of feature classes at most ``d`` apart."""
    pairs = within_distance_join(a.select(a_type, "geom", *(["bbox"] if "bbox" in a.columns else [])),
                                 b.select(b_type, "geom", *(["bbox"] if "bbox" in b.columns else [])), d)
    return pairs.groupBy(F.col("a_" + a_type).alias("type_a"), F.col("b_" + b_type).alias("type_b")).agg(F.count(F.lit(1)).alias("n"))
