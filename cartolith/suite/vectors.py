"""Queries over the derived vector layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import exact as X, native as N
from ..layer import make_bbox, make_box, set_srid, vertex
from ..operators import aggregate as A, joins as J, linear as L, points as P, tables as T, topology as TP, tracks as TR, transform as X8
from .registry import query


def r6(c):
    return F.round(c, 6)


def g():
    return F.col("geom")


# ---------------------------------------------------------------- predicate joins

@query("sites_per_zone", """SELECT zone_id, n_name, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM sites, zones
    WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY zone_id, n_name""", "sites zones")
def sites_per_zone(spark, sf):
    j = J.spatial_join(fx.sites(spark, sf).select("c_acctbal", "geom", "bbox"), fx.zones(spark, sf), "within")
    return j.groupBy(F.col("b_zone_id").alias("zone_id"), F.col("b_n_name").alias("n_name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("a_c_acctbal"), 4).alias("avg_balance"))


def _pairs(a, b, predicate, ida, idb, **kw):
    j = J.spatial_join(a.select(ida, "geom", "bbox"), b.select(idb, "geom", "bbox"), predicate, **kw)
    return j.select(F.col("a_" + ida).alias("a_id"), F.col("b_" + idb).alias("b_id"))


@query("join_intersects", "SELECT site_id AS a_id, zone_id AS b_id FROM sites, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax", "sites zones")
def join_intersects(spark, sf):
    return _pairs(fx.sites(spark, sf), fx.zones(spark, sf), "intersects", "site_id", "zone_id")


@query("join_contains", "SELECT parcel_id AS a_id, site_id AS b_id FROM parcels, sites WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax", "sites parcels")
def join_contains(spark, sf):
    return _pairs(fx.parcels(spark, sf), fx.sites(spark, sf), "contains", "parcel_id", "site_id")


@query("join_covers", "SELECT zone_id AS a_id, site_id AS b_id FROM zones, sites WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax", "sites zones")
def join_covers(spark, sf):
    return _pairs(fx.zones(spark, sf), fx.sites(spark, sf), "covers", "zone_id", "site_id")


_MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
_OPEN = "a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax"
_AHASB = "a.xmin <= b.xmin AND a.xmax >= b.xmax AND a.ymin <= b.ymin AND a.ymax >= b.ymax"
_BHASA = "b.xmin <= a.xmin AND b.xmax >= a.xmax AND b.ymin <= a.ymin AND b.ymax >= a.ymax"


@query("join_within", f"SELECT a.parcel_id AS a_id, b.zone_id AS b_id FROM parcels a, zones b WHERE {_BHASA}", "parcels zones")
def join_within(spark, sf):
    return _pairs(fx.parcels(spark, sf), fx.zones(spark, sf), "within", "parcel_id", "zone_id")


@query("join_coveredby", f"SELECT a.parcel_id AS a_id, b.zone_id AS b_id FROM parcels a, zones b WHERE {_BHASA}", "parcels zones")
def join_coveredby(spark, sf):
    return _pairs(fx.parcels(spark, sf), fx.zones(spark, sf), "coveredby", "parcel_id", "zone_id")


@query("join_containsproperly", """SELECT b.zone_id AS a_id, a.parcel_id AS b_id FROM parcels a, zones b
    WHERE a.xmin > b.xmin AND a.xmax < b.xmax AND a.ymin > b.ymin AND a.ymax < b.ymax""", "parcels zones")
def join_containsproperly(spark, sf):
    return _pairs(fx.zones(spark, sf), fx.parcels(spark, sf), "containsproperly", "zone_id", "parcel_id")


@query("join_overlaps", f"SELECT a.parcel_id AS a_id, b.parcel_id AS b_id FROM parcels a, parcels b WHERE a.parcel_id < b.parcel_id AND {_OPEN} AND NOT ({_AHASB}) AND NOT ({_BHASA})", "parcels")
def join_overlaps(spark, sf):
    p = fx.parcels(spark, sf)
    return _pairs(p, p, "overlaps", "parcel_id", "parcel_id").where("a_id < b_id")


@query("join_touches", f"SELECT a.zone_id AS a_id, b.zone_id AS b_id FROM zones a, zones b WHERE {_MEET} AND NOT ({_OPEN})", "zones")
def join_touches(spark, sf):
    z = fx.zones(spark, sf)
    return _pairs(z, z, "touches", "zone_id", "zone_id")


@query("join_equals", f"SELECT a.parcel_id AS a_id, b.parcel_id AS b_id FROM parcels a, parcels b WHERE {_AHASB} AND {_BHASA}", "parcels")
def join_equals(spark, sf):
    p = fx.parcels(spark, sf)
    return _pairs(p, p, "equals", "parcel_id", "parcel_id")


@query("join_crosses", """SELECT zone_id, count(*) AS n FROM (
    SELECT zone_id, greatest(0::DOUBLE, tx0, ty0) AS t0, least(1::DOUBLE, tx1, ty1) AS t1 FROM (
        SELECT zone_id,
            CASE WHEN x2 <> x1 THEN least((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)) WHEN x1 > xmin AND x1 < xmax THEN 0 ELSE 2 END AS tx0,
            CASE WHEN x2 <> x1 THEN greatest((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)) ELSE 1 END AS tx1,
            CASE WHEN y2 <> y1 THEN least((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1)) WHEN y1 > ymin AND y1 < ymax THEN 0 ELSE 2 END AS ty0,
            CASE WHEN y2 <> y1 THEN greatest((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1)) ELSE 1 END AS ty1 FROM routes, zones))
    WHERE t1 - t0 > 1e-9 AND t1 - t0 < 1 - 1e-9 GROUP BY 1""", "routes zones")
def join_crosses(spark, sf):
    """Per zone, the routes that cross it: partly inside, partly outside."""
    j = J.spatial_join(fx.routes(spark, sf), fx.zones(spark, sf), "crosses")
    return j.groupBy(F.col("b_zone_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("n"))


@query("join_relate", f"SELECT a.zone_id AS a_id, b.zone_id AS b_id FROM zones a, zones b WHERE {_MEET} AND NOT ({_OPEN}) AND ((a.xmax = b.xmin OR b.xmax = a.xmin) <> (a.ymax = b.ymin OR b.ymax = a.ymin))", "zones")
def join_relate(spark, sf):
    """Zones that share a border line: the boundaries meet in dimension one and the interiors do not."""
    z = fx.zones(spark, sf)
    return _pairs(z, z, "relate", "zone_id", "zone_id", pattern="F***1****")


@query("join_left", """SELECT s.site_id, p.parcel_id FROM sites s LEFT JOIN parcels p ON x > xmin AND x < xmax AND y > ymin AND y < ymax""", "sites parcels")
def join_left(spark, sf):
    j = J.spatial_join(fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), "within", "left", id="site_id")
    return j.select(F.col("a_site_id").alias("site_id"), F.col("b_parcel_id").alias("parcel_id"))


@query("join_semi", "SELECT site_id FROM sites WHERE EXISTS (SELECT 1 FROM parcels WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)", "sites parcels")
def join_semi(spark, sf):
    return J.spatial_join(fx.sites(spark, sf), fx.parcels(spark, sf), "intersects", "semi", id="site_id").select("site_id")


@query("join_disjoint", "SELECT site_id FROM sites WHERE NOT EXISTS (SELECT 1 FROM parcels WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)", "sites parcels")
def join_disjoint(spark, sf):
    """Sites disjoint from every parcel."""
    return J.spatial_join(fx.sites(spark, sf), fx.parcels(spark, sf), "disjoint", "semi", id="site_id").select("site_id")


def _mbr(test, sql):
    @query("mbr_" + test, f"SELECT a.parcel_id AS a_id, b.zone_id AS b_id FROM parcels a, zones b WHERE {sql}", "parcels zones")
    def run(spark, sf):
        j = J.mbr_join(fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), fx.zones(spark, sf).select("zone_id", "geom", "bbox"), test)
        return j.select(F.col("a_parcel_id").alias("a_id"), F.col("b_zone_id").alias("b_id"))


_mbr("intersects", _MEET)
_mbr("within", _BHASA)
_mbr("overlaps", f"{_OPEN} AND NOT ({_AHASB}) AND NOT ({_BHASA})")


def _boxed(df, *c):
    c = [F.col(x) if isinstance(x, str) else x for x in c]
    return df.withColumns({"geom": make_box(*c), "bbox": make_bbox(*c)})


def _cores(spark, sf):
    """The middle of each zone, two units wide."""
    return _boxed(fx.zones(spark, sf).select("zone_id", "bbox"), F.col("bbox.xmin") + 9, F.col("bbox.ymin") + 9, F.col("bbox.xmax") - 9, F.col("bbox.ymax") - 9)


_CORES = "(SELECT zone_id, xmin + 9 AS xmin, ymin + 9 AS ymin, xmax - 9 AS xmax, ymax - 9 AS ymax FROM zones)"


@query("mbr_contains", f"SELECT a.parcel_id AS a_id, b.zone_id AS b_id FROM parcels a, {_CORES} b WHERE {_AHASB}", "parcels zones")
def mbr_contains(spark, sf):
    """Parcels that hold the middle of a zone."""
    return J.mbr_join(fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), _cores(spark, sf), "contains").select(F.col("a_parcel_id").alias("a_id"), F.col("b_zone_id").alias("b_id"))


@query("mbr_touches", f"SELECT a.parcel_id AS a_id, b.parcel_id AS b_id FROM parcels a, (SELECT parcel_id, xmax AS xmin, ymin, xmax + 1 AS xmax, ymax FROM parcels) b WHERE {_MEET} AND NOT ({_OPEN})", "parcels")
def mbr_touches(spark, sf):
    """Parcels and the strips right of them."""
    p = fx.parcels(spark, sf).select("parcel_id", "geom", "bbox")
    right = _boxed(p, "bbox.xmax", "bbox.ymin", F.col("bbox.xmax") + 1, "bbox.ymax")
    return J.mbr_join(p, right, "touches").select(F.col("a_parcel_id").alias("a_id"), F.col("b_parcel_id").alias("b_id"))


@query("mbr_equals", f"SELECT a.parcel_id AS a_id, b.parcel_id AS b_id FROM parcels a, parcels b WHERE {_AHASB} AND {_BHASA}", "parcels")
def mbr_equals(spark, sf):
    p = fx.parcels(spark, sf).select("parcel_id", "geom", "bbox")
    return J.mbr_join(p, p, "equals").select(F.col("a_parcel_id").alias("a_id"), F.col("b_parcel_id").alias("b_id"))


@query("mbr_disjoint", f"SELECT a.parcel_id FROM parcels a WHERE NOT EXISTS (SELECT 1 FROM {_CORES} b WHERE {_MEET})", "parcels zones")
def mbr_disjoint(spark, sf):
    return J.mbr_join(fx.parcels(spark, sf), _cores(spark, sf), "disjoint", "semi", id="parcel_id").select("parcel_id")


@query("bbox_window", "SELECT parcel_id FROM parcels WHERE xmin <= 60 AND xmax >= 40 AND ymin <= 55 AND ymax >= 45", "parcels")
def bbox_window(spark, sf):
    return J.bbox_filter(fx.parcels(spark, sf), 40, 45, 60, 55).select("parcel_id")


# ---------------------------------------------------------------- distance joins

_DIST = "sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y))"


@query("within_distance", f"SELECT site_id, depot_id, round({_DIST}, 6) AS dist FROM sites s, depots d WHERE {_DIST} <= 5", "sites depots")
def within_distance(spark, sf):
    j = J.within_distance_join(fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.depots(spark, sf).select("depot_id", "geom", "bbox"), 5.0)
    return j.select(F.col("a_site_id").alias("site_id"), F.col("b_depot_id").alias("depot_id"), r6("dist").alias("dist"))


@query("fully_within_distance", """SELECT parcel_id, depot_id FROM parcels p, depots d WHERE
    sqrt(greatest(xmax - x, x - xmin) * greatest(xmax - x, x - xmin) + greatest(ymax - y, y - ymin) * greatest(ymax - y, y - ymin)) <= 4""", "parcels depots")
def fully_within_distance(spark, sf):
    d = fx.depots(spark, sf)
    p = fx.parcels(spark, sf).select("parcel_id", "geom", "bbox")
    j = J.within_distance_join(p, d.select("depot_id", "geom", "bbox"), 4.0, fully=True)
    return j.select(F.col("a_parcel_id").alias("parcel_id"), F.col("b_depot_id").alias("depot_id"))


@query("distance_band", f"SELECT site_id, depot_id, round({_DIST}, 6) AS dist FROM sites s, depots d WHERE {_DIST} BETWEEN 2 AND 5", "sites depots")
def distance_band(spark, sf):
    j = J.distance_band_join(fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.depots(spark, sf).select("depot_id", "geom", "bbox"), 5.0, 2.0, "depot_id")
    return j.select("site_id", "depot_id", r6("dist").alias("dist"))


_BOXD = "sqrt(power(greatest(xmin - x, 0, x - xmax), 2) + power(greatest(ymin - y, 0, y - ymax), 2))"


@query("distance_band_boxes", f"SELECT parcel_id, depot_id, round({_BOXD}, 6) AS dist FROM parcels, depots WHERE {_BOXD} <= 1.5", "parcels depots")
def distance_band_boxes(spark, sf):
    """No minimum: depots inside a parcel count at distance 0."""
    j = J.distance_band_join(fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), fx.depots(spark, sf).select("depot_id", "geom", "bbox"), 1.5, None, "depot_id")
    return j.select("parcel_id", "depot_id", r6("dist").alias("dist"))


@query("nearest_depots", f"""SELECT site_id, depot_id, round(dist, 6) AS dist, rank FROM (SELECT site_id, depot_id, {_DIST} AS dist,
    row_number() OVER (PARTITION BY site_id ORDER BY {_DIST}, depot_id) AS rank FROM sites s, depots d) WHERE rank <= 3""", "sites depots")
def nearest_depots(spark, sf):
    j = J.knn_join(fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.depots(spark, sf).select("depot_id", "geom", "bbox"), 3, "site_id", "depot_id")
    return j.select(F.col("a_site_id").alias("site_id"), F.col("b_depot_id").alias("depot_id"), r6("dist").alias("dist"), "rank")


@query("colocated_classes", f"""SELECT c_mktsegment AS type_a, 'class ' || (depot_id % 3) AS type_b, count(*) AS n FROM sites s, depots d WHERE {_DIST} <= 4 GROUP BY 1, 2""", "sites depots")
def colocated_classes(spark, sf):
    d = fx.depots(spark, sf).withColumn("class", F.concat(F.lit("class "), (F.col("depot_id") % 3).cast("string")))
    return J.colocated(fx.sites(spark, sf), d, "c_mktsegment", "class", 4.0)


# ---------------------------------------------------------------- overlay

_CUT = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"


@query("parcel_zone_intersection", f"SELECT a.parcel_id, b.zone_id, round({_CUT}, 6) AS area FROM parcels a, zones b WHERE {_MEET}", "parcels zones")
def parcel_zone_intersection(spark, sf):
    i = J.intersection(fx.parcels(spark, sf), fx.zones(spark, sf), ["parcel_id"], mask_cols=["zone_id"])
    return i.select("parcel_id", "zone_id", r6(N.area(g())).alias("area"))


@query("intersection_by_type", f"""SELECT CASE WHEN a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax THEN 'polygon'
    WHEN (a.xmax = b.xmin OR b.xmax = a.xmin) AND (a.ymax = b.ymin OR b.ymax = a.ymin) THEN 'point' ELSE 'line' END AS kind, count(*) AS n
    FROM zones a, zones b WHERE {_MEET} GROUP BY 1""", "zones")
def intersection_by_type(spark, sf):
    """Zones with themselves: areas, shared border lines and shared corner points."""
    z = fx.zones(spark, sf)
    out = None
    for kind, layer in J.split_by_type(J.intersection(z, z, ["zone_id"])).items():
        one = layer.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("clip_parcels", f"SELECT a.parcel_id, count(*) AS pieces, round(sum({_CUT}), 6) AS area FROM parcels a, zones b WHERE {_OPEN} GROUP BY 1", "parcels zones")
def clip_parcels(spark, sf):
    c = J.clip(fx.parcels(spark, sf), fx.zones(spark, sf))
    return c.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("pieces"), r6(F.sum(N.area(g()))).alias("area"))


@query("clip_sites", "SELECT site_id, count(*) AS n FROM sites, parcels WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY 1", "sites parcels")
def clip_sites(spark, sf):
    return J.clip(fx.sites(spark, sf), fx.parcels(spark, sf), single=True).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))




@query("clip_routes", """SELECT b.zone_id, count(*) AS n, round(sum(len * (t1 - t0)), 4) AS length FROM (
    SELECT zone_id, len, greatest(0::DOUBLE, tx0, ty0) AS t0, least(1::DOUBLE, tx1, ty1) AS t1 FROM (
        SELECT zone_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len,
            CASE WHEN x2 <> x1 THEN least((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)) WHEN x1 BETWEEN xmin AND xmax THEN 0 ELSE 2 END AS tx0,
            CASE WHEN x2 <> x1 THEN greatest((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)) ELSE 1 END AS tx1,
            CASE WHEN y2 <> y1 THEN least((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1)) WHEN y1 BETWEEN ymin AND ymax THEN 0 ELSE 2 END AS ty0,
            CASE WHEN y2 <> y1 THEN greatest((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1)) ELSE 1 END AS ty1
        FROM routes, zones)) b
    WHERE t1 - t0 > 1e-9 GROUP BY 1""", "routes zones")
def clip_routes(spark, sf):
    """Length of the routes inside each zone (lines that cross the border included)."""
    i = J.intersection(fx.routes(spark, sf), fx.zones(spark, sf), ["site_id"], mask_cols=["zone_id"])
    lines = i.where(N.is_linear(g()))
    return lines.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(N.length(g())), 4).alias("length"))


@query("difference_parcels", f"""SELECT a.parcel_id, round((a.xmax - a.xmin) * (a.ymax - a.ymin) - coalesce(sum({_CUT}), 0), 6) AS area
    FROM parcels a LEFT JOIN zones b ON {_OPEN} GROUP BY a.parcel_id, a.xmin, a.xmax, a.ymin, a.ymax""", "parcels zones")
def difference_parcels(spark, sf):
    """Part of each parcel outside all zones; covered parcels stay with area 0."""
    d = J.difference(fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), fx.zones(spark, sf), "parcel_id")
    return set_srid(d, fx.SRID).select("parcel_id", F.abs(r6(N.area(g()))).alias("area"))


@query("difference_sites", """SELECT site_id, EXISTS (SELECT 1 FROM parcels WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) AS gone FROM sites""", "sites parcels")
def difference_sites(spark, sf):
    d = J.difference(fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.parcels(spark, sf), "site_id")
    return d.select("site_id", N.is_empty(g()).alias("gone"))


@query("difference_zones", """SELECT zone_id, round(400 - covered, 4) AS area FROM zones JOIN (SELECT zone_id AS z, sum(w * len) AS covered FROM (
    SELECT zone_id, x1 - x0 AS w, sum(greatest(0, ymax - greatest(ymin, coalesce(prev, ymin)))) AS len FROM (
        SELECT s.zone_id, s.x0, s.x1, c.ymin, c.ymax, max(c.ymax) OVER (PARTITION BY s.zone_id, s.x0 ORDER BY c.ymin, c.ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM slabs s JOIN cuts c ON c.zone_id = s.zone_id AND c.xmin <= s.x0 AND c.xmax >= s.x1) GROUP BY zone_id, x0, x1) GROUP BY zone_id) ON z = zone_id""".replace(
    "SELECT zone_id, round(400", """, cuts AS (SELECT b.zone_id, greatest(a.xmin, b.xmin) AS xmin, least(a.xmax, b.xmax) AS xmax, greatest(a.ymin, b.ymin) AS ymin, least(a.ymax, b.ymax) AS ymax
        FROM parcels a, zones b WHERE """ + _OPEN + """),
    slabs AS (SELECT * FROM (SELECT zone_id, x AS x0, lead(x) OVER (PARTITION BY zone_id ORDER BY x) AS x1 FROM (SELECT zone_id, xmin AS x FROM cuts UNION SELECT zone_id, xmax FROM cuts)) WHERE x1 IS NOT NULL)
    SELECT zone_id, round(400""", 1), "parcels zones")
def difference_zones(spark, sf):
    """Zones minus all parcels: many pieces per feature."""
    d = J.difference(fx.zones(spark, sf).select("zone_id", "geom", "bbox"), fx.parcels(spark, sf).select("geom", "bbox"), "zone_id")
    return d.select("zone_id", F.round(N.area(g()), 4).alias("area"))


@query("area_weighted_sum", f"""SELECT zone_id, count(*) AS n, round(sum((1 + parcel_id % 10) * {_CUT} / ((a.xmax - a.xmin) * (a.ymax - a.ymin))), 5) AS weight
    FROM parcels a, zones b WHERE {_OPEN} GROUP BY 1""", "parcels zones")
def area_weighted_sum(spark, sf):
    p = fx.parcels(spark, sf).withColumn("weight", (1 + F.col("parcel_id") % 10).cast("double"))
    return J.area_weighted(fx.zones(spark, sf), p, "zone_id", ["weight"]).select("zone_id", "n", F.round("weight", 5).alias("weight"))


# ---------------------------------------------------------------- aggregates of layers

@query("dissolve_zones", """SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS n_name, round(sum((xmax - xmin) * (ymax - ymin)), 6) AS area
    FROM zones GROUP BY 1""", "zones")
def dissolve_zones(spark, sf):
    d = A.dissolve(fx.zones(spark, sf).select("n_name", "n_regionkey", "geom"), "n_regionkey")
    return d.select("n_regionkey", "n_name", r6(N.area(g())).alias("area"))


_UNION_AREA = """, slabs AS (SELECT * FROM (SELECT k, x AS x0, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1 FROM (SELECT k, xmin AS x FROM src UNION SELECT k, xmax FROM src)) WHERE x1 IS NOT NULL),
    cover AS (SELECT s.k, s.x0, s.x1, c.ymin, c.ymax, max(c.ymax) OVER (PARTITION BY s.k, s.x0 ORDER BY c.ymin, c.ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM slabs s JOIN src c ON c.k = s.k AND c.xmin <= s.x0 AND c.xmax >= s.x1),
    areas AS (SELECT k, sum((x1 - x0) * greatest(0, ymax - greatest(ymin, coalesce(prev, ymin)))) AS area FROM cover GROUP BY k) """


@query("dissolve_parcels", ", src AS (SELECT p_brand AS k, * FROM parcels)" + _UNION_AREA +
       "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS p_type, (SELECT round(area, 4) FROM areas WHERE k = p_brand) AS area FROM parcels GROUP BY 1", "parcels")
def dissolve_parcels(spark, sf):
    """Overlapping boxes by brand: the area of the union, not the sum of areas."""
    d = A.dissolve(fx.parcels(spark, sf).select("p_brand", "p_type", "geom"), "p_brand")
    return d.select("p_brand", "p_type", F.round(N.area(g()), 4).alias("area"))


@query("union_of_parcels", ", src AS (SELECT 0 AS k, * FROM parcels)" + _UNION_AREA + "SELECT round(area, 3) AS area FROM areas", "parcels")
def union_of_parcels(spark, sf):
    return A.union_layer(fx.parcels(spark, sf).select("geom")).select(F.round(N.area(g()), 3).alias("area"))


@query("layer_extent", "SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM parcels", "parcels")
def layer_extent(spark, sf):
    return A.extent(fx.parcels(spark, sf))


@query("extent_by_brand", "SELECT p_brand, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM parcels GROUP BY 1", "parcels")
def extent_by_brand(spark, sf):
    return A.extent(fx.parcels(spark, sf), ["p_brand"])


@query("estimated_extent")
def estimated_extent(spark, sf):
    return A.estimated_extent(fx.parcels(spark, sf), 0.2)


@query("row_count_check")
def row_count_check(spark, sf):
    return A.row_counts(fx.sites(spark, sf), 0.1)


@query("type_inventory", """SELECT 'POLYGON' AS gtype, count(*) AS n, 3857 AS srid FROM parcels UNION ALL SELECT 'POINT', count(*), 3857 FROM sites""", "parcels sites")
def type_inventory(spark, sf):
    both = fx.parcels(spark, sf).select("geom").unionByName(fx.sites(spark, sf).select("geom"))
    return A.type_inventory(set_srid(both, fx.SRID)).select("gtype", "n", "srid")


@query("main_type", "SELECT 'POLYGON' AS gtype, count(*) AS n FROM part")
def main_type(spark, sf):
    return A.main_type(fx.parcels(spark, sf).select("geom").unionByName(fx.sites(spark, sf).select("geom")))


@query("layer_tuning", """SELECT p_brand, count(*) AS n, round(avg(xmax - xmin), 6) AS avg_width, round(avg(ymax - ymin), 6) AS avg_height, count(*) AS polygons, 0::BIGINT AS lines, 0::BIGINT AS points
    FROM parcels GROUP BY 1""", "parcels")
def layer_tuning(spark, sf):
    t = A.layer_tuning(fx.parcels(spark, sf), ["p_brand"])
    return t.select("p_brand", "n", r6("avg_width").alias("avg_width"), r6("avg_height").alias("avg_height"), "polygons", "lines", "points")


@query("convex_hull_extent", "SELECT c_mktsegment, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM sites GROUP BY 1", "sites")
def convex_hull_extent(spark, sf):
    """Convex hull per segment, compared by its extent (tests compare the shape)."""
    h = A.convex_hull(fx.sites(spark, sf).select("c_mktsegment", "geom"), ["c_mktsegment"])
    return h.select("c_mktsegment", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


@query("concave_hulls")
def concave_hulls(spark, sf):
    """Concave hull of the depots in each zone."""
    from ..operators.hulls import polygon_from_points
    d = J.spatial_join(fx.sites(spark, sf), fx.zones(spark, sf), "within").select(F.col("b_zone_id").alias("zone_id"), F.col("a_geom").alias("geom"))
    return polygon_from_points(set_srid(d, fx.SRID), 0.4, True, by=["zone_id"]).select("zone_id", r6(N.area(g())).alias("area"))


@query("group_centroids", """SELECT p_brand, round(sum(w * (xmin + xmax) / 2) / sum(w), 5) AS x, round(sum(w * (ymin + ymax) / 2) / sum(w), 5) AS y
    FROM (SELECT *, (xmax - xmin) * (ymax - ymin) AS w FROM parcels) GROUP BY 1""", "parcels")
def group_centroids(spark, sf):
    c = A.centroid_of_group(fx.parcels(spark, sf), ["p_brand"])
    return c.select("p_brand", F.round(N.point_x(g()), 5).alias("x"), F.round(N.point_y(g()), 5).alias("y"))


@query("collected_points", "SELECT c_mktsegment, count(*) AS n, round(sum(x), 4) AS sx FROM sites GROUP BY 1", "sites")
def collected_points(spark, sf):
    c = A.collect_points(fx.sites(spark, sf), ["c_mktsegment"], ["site_id"])
    return c.select("c_mktsegment", N.n_parts(g()).cast("long").alias("n"),
                    F.round(F.aggregate(N.vertices(g()), F.lit(0.0), lambda s, v: s + v["x"]), 4).alias("sx"))


@query("point_bins", "SELECT floor(x / 10)::BIGINT AS bin_x, floor(y / 10)::BIGINT AS bin_y, count(*) AS n, round(sum(c_acctbal), 2) AS c_acctbal FROM sites GROUP BY 1, 2", "sites")
def point_bins(spark, sf):
    return A.bin_layer(fx.sites(spark, sf), 10.0, ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("tiled_aggregates", "SELECT zone_id, count(*) AS n, max(c_acctbal) AS top FROM sites, zones WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1", "sites zones")
def tiled_aggregates(spark, sf):
    return A.tiled_aggregates(fx.zones(spark, sf), fx.sites(spark, sf), "zone_id", {"n": F.count(F.lit(1)), "top": F.max("b_c_acctbal")})


@query("dense_clusters", """, bins AS (SELECT floor(x / 5)::BIGINT AS bx, floor(y / 5)::BIGINT AS gy, count(*) AS n, (floor(x / 5) * 1000 + floor(y / 5))::BIGINT AS id FROM sites GROUP BY 1, 2, 4
        HAVING count(*) >= (SELECT count(*) / 300.0 FROM sites)),
    reach AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM bins UNION SELECT b.id, r.root FROM r JOIN bins a ON a.id = r.id JOIN bins b ON abs(a.bx - b.bx) <= 1 AND abs(a.gy - b.gy) <= 1)
        SELECT id, min(root) AS c FROM r GROUP BY id)
    SELECT count(*) AS cells, sum(n)::BIGINT AS n, min(bx) * 5.0::DOUBLE AS xmin, min(gy) * 5.0::DOUBLE AS ymin, (max(bx) + 1) * 5.0::DOUBLE AS xmax, (max(gy) + 1) * 5.0::DOUBLE AS ymax
    FROM reach JOIN bins USING (id) GROUP BY c""", "sites")
def dense_clusters(spark, sf):
    s = fx.sites(spark, sf)
    limit = -(-s.count() // 300)
    return A.spatial_clusters(s, 5.0, limit).select("cells", "n", "xmin", "ymin", "xmax", "ymax")


# ---------------------------------------------------------------- row transforms

_POLY32 = "16 * sin(pi() / 16)"


@query("buffer_points", f"SELECT depot_id, round({_POLY32} * 2.5 * 2.5, 6) AS area FROM depots", "depots")
def buffer_points(spark, sf):
    return X8.buffer(fx.depots(spark, sf), 2.5, ["depot_id"]).select("depot_id", r6(N.area(g())).alias("area"))


@query("buffer_boxes", f"SELECT parcel_id, round((xmax - xmin) * (ymax - ymin) + 2 * 0.5 * (xmax - xmin + ymax - ymin) + {_POLY32} * 0.25, 6) AS area FROM parcels", "parcels")
def buffer_boxes(spark, sf):
    return X8.buffer(fx.parcels(spark, sf), 0.5, ["parcel_id"]).select("parcel_id", r6(N.area(g())).alias("area"))


@query("buffer_lines", f"SELECT order_id, line_no, round(2 * 1 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + {_POLY32}, 5) AS area FROM routes", "routes")
def buffer_lines(spark, sf):
    """Routes as capsules."""
    r = fx.routes(spark, sf, spread=True).select("order_id", "line_no", "geom", "bbox")
    return X8.buffer(r, 1.0, ["order_id", "line_no"]).select("order_id", "line_no", F.round(X.area(g()), 5).alias("area"))


@query("repair_valid", "SELECT parcel_id, true AS is_valid, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM parcels", "parcels")
def repair_valid(spark, sf):
    p = fx.parcels(spark, sf).select("parcel_id", "geom", "bbox").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "parcel_id")
    return X8.with_validity(X8.make_valid(p, "ST_MakeValid")).select("parcel_id", "is_valid", r6(N.area(g())).alias("area"))


@query("repair_bowties", "SELECT parcel_id, round((xmax - xmin) * (ymax - ymin) / 2, 6) AS area, 'Self-intersection' AS reason FROM parcels", "parcels")
def repair_bowties(spark, sf):
    """Parcels drawn as bow-ties: the two triangles hold half of the box."""
    b = F.col("bbox")
    ring = F.array(vertex(b["xmin"], b["ymin"]), vertex(b["xmax"], b["ymax"]), vertex(b["xmax"], b["ymin"]), vertex(b["xmin"], b["ymax"]), vertex(b["xmin"], b["ymin"]))
    p = fx.parcels(spark, sf).select("parcel_id", "bbox").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "parcel_id")
    p = p.withColumn("geom", F.struct(F.lit("POLYGON").alias("gtype"), F.array(F.array(ring)).alias("parts")))
    p = p.withColumn("reason", X.valid_reason(g()))
    return X8.make_valid(p, "ST_MakeValid").select("parcel_id", r6(N.area(g())).alias("area"), "reason")


@query("random_points", "SELECT n_regionkey, 50::BIGINT AS n, true AS inside FROM nation GROUP BY 1")
def random_points(spark, sf):
    """Fifty points per region, all inside a zone of that region."""
    z = fx.zones(spark, sf)
    pts = P.generate_points(z, 50, seed=7, by=("n_regionkey",)).withColumn("id", F.monotonically_increasing_id())
    pts = pts.select("n_regionkey", "geom", "bbox")
    j = J.spatial_join(pts, z.select(F.col("n_regionkey").alias("zr"), "geom", "bbox"), "within")
    j = j.where(F.col("a_n_regionkey") == F.col("b_zr"))
    return j.groupBy(F.col("a_n_regionkey").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("inside"))


@query("single_and_multi", "SELECT c_mktsegment, count(*) AS n, 'MULTIPOINT' AS multi, 'POINT' AS single FROM sites GROUP BY 1", "sites")
def single_and_multi(spark, sf):
    m = A.collect_points(fx.sites(spark, sf), ["c_mktsegment"], ["site_id"])
    m = m.withColumn("multi", F.col("geom")["gtype"])
    s = X8.force_single(m)
    return s.groupBy("c_mktsegment", "multi", g()["gtype"].alias("single")).agg(F.count(F.lit(1)).alias("n"))


@query("reproject_sites", """SELECT site_id, round(x * 0.8 * pi() / 180 * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + y * 0.8 * pi() / 360)) * 6378137, 3) AS my FROM sites""", "sites")
def reproject_sites(spark, sf):
    """Coordinates read as longitude and latitude (scaled into range), to web Mercator."""
    s = X8.edit(fx.sites(spark, sf).select("site_id", "geom"), "scale", 0.8, 0.8)
    s = X8.reproject(s, 3857, source=4326)
    return s.select("site_id", F.round(N.point_x(g()), 3).alias("mx"), F.round(N.point_y(g()), 3).alias("my"))


@query("reproject_there_and_back", "SELECT site_id, round(x * 0.06, 6) AS x, round(y * 0.5, 6) AS y FROM sites", "sites")
def reproject_there_and_back(spark, sf):
    """4326 to UTM zone 31 and 3857 and back; the plane is drawn together so that all sites lie in the zone."""
    s = X8.edit(fx.sites(spark, sf).select("site_id", "geom"), "scale", 0.06, 0.5)
    s = X8.reproject(X8.reproject(X8.reproject(set_srid(s, 4326), 32631), 3857), 4326)
    return s.select("site_id", F.abs(r6(N.point_x(g()))).alias("x"), F.abs(r6(N.point_y(g()))).alias("y"))


@query("parcel_metrics", """SELECT parcel_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * (xmax - xmin + ymax - ymin), 6) AS perimeter,
    round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy, 5 AS n_points, 1 AS n_parts, 1 AS n_rings, 2 AS dimension, false AS is_empty,
    round(xmin, 6) AS xmin, round(ymax, 6) AS ymax FROM parcels""", "parcels")
def parcel_metrics(spark, sf):
    m = X8.with_metrics(fx.parcels(spark, sf), "area", "perimeter", "centroid", "n_points", "n_parts", "n_rings", "dimension", "is_empty", "xmin", "ymax")
    c = F.col("centroid")
    return m.select("parcel_id", r6("area").alias("area"), r6("perimeter").alias("perimeter"), r6(N.point_x(c)).alias("cx"), r6(N.point_y(c)).alias("cy"),
                    "n_points", "n_parts", "n_rings", "dimension", "is_empty", r6("xmin").alias("xmin"), r6("ymax").alias("ymax"))


@query("route_metrics", """SELECT order_id, line_no, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS length, round(x1, 6) AS sx, round(y2, 6) AS ey,
    round(CASE WHEN x1 = x2 AND y1 = y2 THEN NULL WHEN atan2(x2 - x1, y2 - y1) < 0 THEN atan2(x2 - x1, y2 - y1) + 2 * pi() ELSE atan2(x2 - x1, y2 - y1) END, 6) AS azimuth FROM routes""", "routes")
def route_metrics(spark, sf):
    m = X8.with_metrics(fx.routes(spark, sf), "length", "start_point", "end_point", "azimuth")
    return m.select("order_id", "line_no", r6("length").alias("length"), r6(N.point_x(F.col("start_point"))).alias("sx"),
                    r6(N.point_y(F.col("end_point"))).alias("ey"), r6("azimuth").alias("azimuth"))


@query("built_boxes", "SELECT parcel_id, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM parcels", "parcels")
def built_boxes(spark, sf):
    """Polygons from rings and from four numbers agree."""
    b = F.col("bbox")
    ring = F.array(vertex(b["xmin"], b["ymin"]), vertex(b["xmin"], b["ymax"]), vertex(b["xmax"], b["ymax"]), vertex(b["xmax"], b["ymin"]))
    from ..layer import make_polygon
    p = fx.parcels(spark, sf).select("parcel_id", "bbox", make_polygon(ring).alias("a"), make_box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]).alias("b"))
    return p.select("parcel_id", r6((N.area(F.col("a")) + N.area(F.col("b"))) / 2).alias("area"))


@query("edited_sites", """SELECT site_id, round(x + 3, 6) AS tx, round(y * 2, 6) AS sy, round(-y, 6) + 0.0 AS rx, round(2 * x + y + 1, 6) AS ax, round(round_even(x / 0.5, 0) * 0.5, 6) AS gx FROM sites""", "sites")
def edited_sites(spark, sf):
    import math
    p = g()
    return fx.sites(spark, sf).select(
        "site_id", r6(N.point_x(N.translate(p, 3.0, 0.0))).alias("tx"), r6(N.point_y(N.scale(p, 1.0, 2.0))).alias("sy"),
        (r6(N.point_x(N.rotate(p, math.pi / 2))) + 0.0).alias("rx"), r6(N.point_x(N.affine(p, 2.0, 1.0, 0.0, 1.0, 1.0, 0.0))).alias("ax"),
        r6(N.point_x(N.snap_to_grid(p, 0.5))).alias("gx"))


@query("edited_lines", """SELECT order_id, line_no, round(x2, 6) AS reversed_start, CASE WHEN x1 = x2 AND y1 = y2 THEN 2 ELSE greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 10))::INT + 1 END AS pieces,
    3 AS added, 1 AS removed FROM routes""", "routes")
def edited_lines(spark, sf):
    p = g()
    return fx.routes(spark, sf).select(
        "order_id", "line_no", r6(N.point_x(N.start_point(N.reverse(p)))).alias("reversed_start"), N.n_points(N.segmentize(p, 10.0)).alias("pieces"),
        N.n_points(N.add_point(p, F.lit(0.0), F.lit(0.0))).alias("added"), N.n_points(N.remove_point(N.set_point(p, 0, F.lit(1.0), F.lit(1.0)), 1)).alias("removed"))


@query("simplified_tracks", """SELECT user_id, 'LINESTRING' AS gtype FROM events GROUP BY 1""")
def simplified_tracks(spark, sf):
    s = X8.simplify(TR.track_lines(fx.track_points(spark, sf), "user_id", "ts"), 20.0)
    return s.select("user_id", g()["gtype"].alias("gtype"))


@query("dumped_points", "SELECT parcel_id, path, round(CASE WHEN path IN (1, 4, 5) THEN xmin ELSE xmax END, 6) AS x, round(CASE WHEN path IN (1, 2, 5) THEN ymin ELSE ymax END, 6) AS y FROM parcels, (SELECT unnest([1, 2, 3, 4, 5])::INT AS path)", "parcels")
def dumped_points(spark, sf):
    d = X8.dump(fx.parcels(spark, sf).select("parcel_id", "geom"), "points")
    return d.select("parcel_id", "path", r6(N.point_x(g())).alias("x"), r6(N.point_y(g())).alias("y"))


@query("dumped_segments", "SELECT zone_id, count(*) AS n, 80.0::DOUBLE AS length FROM zones, (SELECT unnest([1, 2, 3, 4])) GROUP BY 1", "zones")
def dumped_segments(spark, sf):
    d = X8.dump(fx.zones(spark, sf).select("zone_id", "geom"), "segments")
    return d.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.sum(N.length(g())).alias("length"))


@query("pair_measures", f"""SELECT site_id, depot_id, round({_DIST}, 6) AS dist,
    round(2 * 6371008.7714150598 * asin(least(1, sqrt(power(sin(radians(d.y * 0.9 - s.y * 0.9) / 2), 2) + cos(radians(s.y * 0.9)) * cos(radians(d.y * 0.9)) * power(sin(radians(d.x * 0.9 - s.x * 0.9) / 2), 2)))), 2) AS sphere
    FROM sites s, depots d WHERE {_DIST} <= 3""", "sites depots")
def pair_measures(spark, sf):
    j = J.within_distance_join(fx.sites(spark, sf), fx.depots(spark, sf), 3.0)
    c = lambda n: F.col(n) * 0.9
    return j.select(F.col("a_site_id").alias("site_id"), F.col("b_depot_id").alias("depot_id"), r6("dist").alias("dist"),
                    F.round(N.sphere_distance(c("a_x"), c("a_y"), c("b_x"), c("b_y")), 2).alias("sphere"))


@query("pair_measures_boxes", f"""SELECT a.parcel_id AS a_id, b.parcel_id AS b_id, round(sqrt(power(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + power(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2)), 5) AS dist,
    round(sqrt(power(greatest(a.xmax - b.xmin, b.xmax - a.xmin), 2) + power(greatest(a.ymax - b.ymin, b.ymax - a.ymin), 2)), 5) AS far
    FROM parcels a, parcels b WHERE a.parcel_id < b.parcel_id AND a.xmin - 0.5 <= b.xmax AND b.xmin - 0.5 <= a.xmax AND a.ymin - 0.5 <= b.ymax AND b.ymin - 0.5 <= a.ymax""", "parcels")
def pair_measures_boxes(spark, sf):
    """Smallest and largest distance of near parcels."""
    from ..layer import make_bbox
    p = fx.parcels(spark, sf).withColumn("box", F.col("bbox"))
    quick = J.only_rects(p)
    wide = p.withColumn("bbox", make_bbox(F.col("bbox.xmin") - 0.5, F.col("bbox.ymin") - 0.5, F.col("bbox.xmax") + 0.5, F.col("bbox.ymax") + 0.5))
    j = J.mbr_join(wide, p, "intersects").where(F.col("a_parcel_id") < F.col("b_parcel_id"))
    if not quick:
        j = j.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a_parcel_id", "b_parcel_id")
    a, b, boxes = F.col("a_geom"), F.col("b_geom"), {"abox": F.col("a_box"), "bbox": F.col("b_box"), "quick": quick}
    return j.select(F.col("a_parcel_id").alias("a_id"), F.col("b_parcel_id").alias("b_id"), F.round(X.distance(a, b, **boxes), 5).alias("dist"), F.round(X.max_distance(a, b, **boxes), 5).alias("far"))


@query("events_on_routes", """SELECT order_id, line_no, round(x1 + (x2 - x1) * 0.25, 6) AS x, round(y1 + (y2 - y1) * 0.25, 6) AS y FROM routes""", "routes")
def events_on_routes(spark, sf):
    r = fx.routes(spark, sf).withColumn("route", F.concat_ws("-", "site_id", "depot_id"))
    e = r.select("route", "order_id", "line_no", F.lit(0.25).alias("at"))
    out = L.locate_events(r.select("route", "geom").dropDuplicates(["route"]), e, "route", "at")
    return out.select("order_id", "line_no", r6(N.point_x(g())).alias("x"), r6(N.point_y(g())).alias("y"))


@query("stretches_of_routes", """SELECT order_id, line_no, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 0.3, 6) AS length FROM routes""", "routes")
def stretches_of_routes(spark, sf):
    r = fx.routes(spark, sf)
    return r.select("order_id", "line_no", r6(N.length(N.line_substring(g(), F.lit(0.2), F.lit(0.5)))).alias("length"))


@query("grid_keys", """SELECT site_id, bx.z AS z FROM (SELECT site_id, floor(x / 12.5)::BIGINT AS a, floor(y / 12.5)::BIGINT AS b FROM sites),
    LATERAL (SELECT (a & 1) + 2 * (b & 1) + 4 * ((a >> 1) & 1) + 8 * ((b >> 1) & 1) + 16 * ((a >> 2) & 1) + 32 * ((b >> 2) & 1) AS z) bx""", "sites")
def grid_keys(spark, sf):
    return T.with_zkey(fx.sites(spark, sf), 12.5).select("site_id", "z")


@query("geohash_cells", "SELECT count(*) AS n, 6 AS length FROM customer")
def geohash_cells(spark, sf):
    h = fx.sites(spark, sf).select(N.geohash(F.col("x"), F.col("y") * 0.9, 6).alias("h"))
    return h.groupBy(F.length("h").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("polygonized_grid", "SELECT count(*) AS n, round(sum((xmax - xmin) * (ymax - ymin)), 6) AS area FROM zones", "zones")
def polygonized_grid(spark, sf):
    f = TP.polygonize(TP.zone_grid_edges(fx.zones(spark, sf), "zone_id"))
    return f.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(N.area(g()))).alias("area"))


@query("merged_lines", "SELECT 4 * (sqrt(count(*)) * (sqrt(count(*)) + 1) / 2 - 1)::BIGINT AS n, 2 * sqrt(count(*)) * (sqrt(count(*)) + 1) * 20 AS length FROM nation")
def merged_lines(spark, sf):
    m = TP.merge_lines(TP.zone_grid_edges(fx.zones(spark, sf), "zone_id"))
    return m.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(N.length(g()))).alias("length"))


@query("face_polygons", "SELECT zone_id + 1 AS face_id, (xmax - xmin) * (ymax - ymin) AS area FROM zones", "zones")
def face_polygons(spark, sf):
    f = TP.face_polygons(TP.zone_grid_edges(fx.zones(spark, sf), "zone_id"))
    return f.select("face_id", r6(N.area(g())).alias("area"))


@query("face_seeds", "SELECT zone_id + 1 AS face_id, true AS inside FROM zones", "zones")
def face_seeds(spark, sf):
    z = fx.zones(spark, sf)
    s = TP.face_seeds(TP.zone_grid_edges(z, "zone_id"))
    j = J.spatial_join(s, z, "within")
    return j.select(F.col("a_face_id").alias("face_id"), (F.col("a_face_id") == F.col("b_zone_id") + 1).alias("inside"))


@query("face_boxes", "SELECT zone_id + 1 AS face_id, xmin, ymin, xmax, ymax FROM zones", "zones")
def face_boxes(spark, sf):
    return TP.face_boxes(TP.zone_grid_edges(fx.zones(spark, sf), "zone_id"))


@query("topology_nodes", "SELECT x, y, count(DISTINCT k)::BIGINT AS degree FROM (SELECT x, y, unnest(CASE WHEN c THEN [dx] ELSE [dy] END) AS k FROM (SELECT DISTINCT * FROM (SELECT zone_id, xmin AS x, ymin AS y, 1 AS dx, 2 AS dy FROM zones UNION ALL SELECT zone_id, xmax, ymin, 3, 2 FROM zones UNION ALL SELECT zone_id, xmax, ymax, 3, 4 FROM zones UNION ALL SELECT zone_id, xmin, ymax, 1, 4 FROM zones)), (SELECT unnest([true, false]) AS c)) GROUP BY 1, 2", "zones")
def topology_nodes(spark, sf):
    n = TP.nodes(TP.zone_grid_edges(fx.zones(spark, sf), "zone_id"))
    return n.select(N.point_x(g()).alias("x"), N.point_y(g()).alias("y"), "degree")


@query("next_edges", "SELECT count(*) AS n, count(*) AS linked FROM zones, (SELECT unnest([1, 2, 3, 4]) AS k)", "zones")
def next_edges(spark, sf):
    """Each zone border segment linked to the next one of its zone."""
    z = fx.zones(spark, sf)
    d = X8.dump(z.select("zone_id", "geom"), "segments")
    d = d.withColumn("edge_id", F.col("zone_id") * 4 + F.col("path")).withColumn("next_left", F.col("zone_id") * 4 + F.col("path") % 4 + 1)
    l = TP.edge_links(d, "edge_id", "next_left")
    ok = N.vertices(F.col("geom"))[1] == N.vertices(F.col("next_geom"))[0]
    return l.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("linked"))


# ---------------------------------------------------------------- tables around layers

@query("merged_layers", "SELECT id, x, y FROM (SELECT site_id AS id, x, y FROM sites UNION SELECT depot_id, x, y FROM depots)", "sites depots")
def merged_layers(spark, sf):
    m = T.merge_layers([fx.sites(spark, sf).select("site_id", "geom"), fx.depots(spark, sf).select("depot_id", "geom")])
    return m.select(F.col("site_id").alias("id"), N.point_x(g()).alias("x"), N.point_y(g()).alias("y"))


@query("spatially_sorted", "SELECT count(*) AS n, round(sum(x), 4) AS sx, 0::BIGINT AS falls, 0::BIGINT AS shared, true AS near FROM sites", "sites")
def spatially_sorted(spark, sf):
    """In storage order keys never fall, tasks share no key range, and neighbours in that order lie nearer than in the given one."""
    from pyspark.sql import Window
    s = fx.sites(spark, sf)
    e = s.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    keyed = lambda d: T.with_zkey(d, max(e[2] - e[0], e[3] - e[1]) / (1 << 16), e[0], e[1])
    d = keyed(T.spatial_sort(s, 4)).select("x", "y", "z", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"))
    d = A.save_step(d, "sorted")
    w = Window.partitionBy("part").orderBy("i")
    steps = d.select("part", "x", "z", (F.col("z") < F.lag("z").over(w)).alias("fall"), F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step"))
    given = s.withColumn("i", F.col("site_id")).withColumn("part", F.expr("site_id div 400"))
    far = given.select(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step")).agg(F.avg("step").alias("before"))
    ranges = d.groupBy("part").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))   # 4 rows
    both = ranges.alias("a").join(ranges.alias("b"), F.expr("a.part < b.part AND a.hi > b.lo")).agg(F.count(F.lit(1)).alias("shared"))
    out = steps.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.count_if("fall").alias("falls"), F.avg("step").alias("after"))
    return out.join(both).join(far).select("n", "sx", "falls", "shared", (F.col("after") < F.col("before") / 4).alias("near"))


@query("track_steps", """SELECT event_id, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 6) AS step, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE, 6) AS seconds
    FROM track_points WINDOW w AS (PARTITION BY user_id ORDER BY ts)""", "track_points")
def track_steps(spark, sf):
    t = TR.track_steps(fx.track_points(spark, sf), "user_id", "ts")
    return t.select("event_id", r6("step").alias("step"), F.round("seconds", 6).alias("seconds"))


@query("track_lengths", """SELECT user_id, count(*)::INT AS n, round(sum(step), 5) AS length FROM (SELECT user_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step
    FROM track_points WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY 1""", "track_points")
def track_lengths(spark, sf):
    t = TR.track_lines(fx.track_points(spark, sf), "user_id", "ts")
    return t.select("user_id", N.n_points(g()).alias("n"), F.round(N.length(g()), 5).alias("length"))


@query("top_k_by_distance", f"SELECT site_id, depot_id, round({_DIST}, 6) AS dist FROM sites s, depots d WHERE {_DIST} <= 5 ORDER BY {_DIST}, site_id, depot_id LIMIT 20", "sites depots")
def top_k_by_distance(spark, sf):
    s, d = fx.sites(spark, sf).select("site_id", "geom", "bbox"), fx.depots(spark, sf).select("depot_id", "geom", "bbox")
    j = J.within_distance_join(s, d, J.radius_of_pairs(s, d, 20, 5.0))
    j = j.select(F.col("a_site_id").alias("site_id"), F.col("b_depot_id").alias("depot_id"), "dist")
    return j.orderBy("dist", "site_id", "depot_id").limit(20).withColumn("dist", r6("dist"))
