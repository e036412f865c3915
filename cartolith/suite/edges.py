"""Queries for the edges of the operators: NULL and repeated keys, gaps, overlaps, islands, large values, properties of estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import table as t
from ..functions import native as N, scalars as SC
from ..layer import make_bbox, make_box, make_line, set_srid, with_bbox
from ..operators import aggregate as A, joins as J, raster as R, tables as T, topology as TP
from .registry import query

_GAP = "sqrt(power(greatest(0, p.xmin - z.xmax, z.xmin - p.xmax), 2) + power(greatest(0, p.ymin - z.ymax, z.ymin - p.ymax), 2))"


@query("nearest_zones_of_parcels", f"""SELECT parcel_id, zone_id, round(d, 6) AS dist, rank FROM (SELECT parcel_id, zone_id, {_GAP} AS d, row_number() OVER (PARTITION BY parcel_id ORDER BY {_GAP}, zone_id) AS rank FROM parcels p, zones z)
    WHERE rank <= 3""", "parcels zones")
def nearest_zones_of_parcels(spark, sf):
    """Neighbours between boxes."""
    j = J.knn_join(fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), fx.zones(spark, sf).select("zone_id", "geom", "bbox"), 3, "parcel_id", "zone_id")
    return j.select(F.col("a_parcel_id").alias("parcel_id"), F.col("b_zone_id").alias("zone_id"), F.round("dist", 6).alias("dist"), "rank")


_NULLED = "CASE WHEN site_id % 3 > 0 THEN site_id // 7 END"


def _nulled(spark, sf):
    """Sites under a key that is NULL for a third of them and repeats for the rest."""
    return fx.sites(spark, sf).withColumn("k", F.when(F.col("site_id") % 3 > 0, F.expr("site_id div 7"))).select("k", "site_id", "geom", "bbox")


@query("join_left_null_keys", f"SELECT {_NULLED} AS k, s.site_id, p.parcel_id FROM sites s LEFT JOIN parcels p ON x > xmin AND x < xmax AND y > ymin AND y < ymax", "sites parcels")
def join_left_null_keys(spark, sf):
    j = J.spatial_join(_nulled(spark, sf), fx.parcels(spark, sf).select("parcel_id", "geom", "bbox"), "within", "left", id="k")
    return j.select(F.col("a_k").alias("k"), F.col("a_site_id").alias("site_id"), F.col("b_parcel_id").alias("parcel_id"))


@query("join_anti_null_keys", f"SELECT {_NULLED} AS k, site_id FROM sites WHERE NOT EXISTS (SELECT 1 FROM parcels WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)", "sites parcels")
def join_anti_null_keys(spark, sf):
    return J.spatial_join(_nulled(spark, sf), fx.parcels(spark, sf), "intersects", "anti", id="k").select("k", "site_id")


@query("difference_null_ids", """SELECT CASE WHEN parcel_id % 3 > 0 THEN parcel_id // 7 END AS k, round((a.xmax - a.xmin) * (a.ymax - a.ymin) - coalesce(sum((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))), 0), 6) AS area
    FROM parcels a LEFT JOIN zones b ON a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin GROUP BY parcel_id, a.xmin, a.xmax, a.ymin, a.ymax""", "parcels zones")
def difference_null_ids(spark, sf):
    """Parcels under a key that is NULL for a third of them and repeats for the rest."""
    p = fx.parcels(spark, sf).select(F.when(F.col("parcel_id") % 3 > 0, F.expr("parcel_id div 7")).alias("k"), "geom", "bbox")
    return J.difference(p, fx.zones(spark, sf), "k").select("k", F.abs(F.round(N.area(F.col("geom")), 6)).alias("area"))


_APART = "sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y))"


@query("nearest_repeated_ids", f"""SELECT CASE WHEN site_id % 3 > 0 THEN site_id // 7 END AS k, depot_id, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT s.site_id, depot_id, {_APART} AS dist,
    row_number() OVER (PARTITION BY s.site_id ORDER BY {_APART}, depot_id) AS rank FROM sites s, depots d), (SELECT unnest([1, 2]) AS copy) WHERE rank <= 2 AND (copy = 1 OR site_id % 5 = 0)""", "sites depots")
def nearest_repeated_ids(spark, sf):
    """NULL keys, keys of several sites, and every fifth site twice with all it holds."""
    s = fx.sites(spark, sf).select("site_id", F.when(F.col("site_id") % 3 > 0, F.expr("site_id div 7")).alias("k"), "geom", "bbox")
    twice = s.unionByName(s.where("site_id % 5 = 0")).drop("site_id")
    j = J.knn_join(set_srid(twice, fx.SRID), fx.depots(spark, sf).select("depot_id", "geom", "bbox"), 2, "k", "depot_id")
    return j.select(F.col("a_k").alias("k"), F.col("b_depot_id").alias("depot_id"), F.round("dist", 6).alias("dist"), "rank")


@query("raster_values_under_overlaps", "SELECT site_id, CASE WHEN rid = 0 THEN b1 + 1 ELSE b1 END AS value FROM sites LEFT JOIN heat ON floor(x) = col AND floor(h - y) = row", "heat sites")
def raster_values_under_overlaps(spark, sf):
    """Tile 0 lies under a copy with higher values, which wins."""
    h = fx.heat(spark, sf).where("band = 1")
    both = R.stamp_grid(h.unionByName(h.where("rid = 0").withColumn("rid", F.lit(1000).cast("long")).withColumn("value", F.col("value") + 1)), R.grid_of(h))
    return R.values_at(both, fx.sites(spark, sf).select("site_id", "bbox"), 1).select("site_id", "value")


@query("sparse_tiles_and_back", "SELECT rid, 1 AS band, col, row, b1 AS value FROM heat WHERE b1 IS NOT NULL AND (col + row) % 3 > 0 UNION ALL SELECT rid, 2, col, row, b2 FROM heat WHERE (col * row) % 5 > 0", "heat")
def sparse_tiles_and_back(spark, sf):
    """Pixels with gaps, differing by band, into tiles and back."""
    h = fx.heat(spark, sf)
    some = h.where("(band = 1 AND value IS NOT NULL AND (col + row) % 3 > 0) OR (band = 2 AND (col * row) % 5 > 0)")
    return R.from_tiles(R.to_tiles(R.stamp_grid(some, R.grid_of(h)))).where("value IS NOT NULL").select("rid", "band", "col", "row", "value")


@query("overviews_all_levels", "SELECT level, band, (ceil(100 / level) * ceil(any_value(h) / level))::BIGINT AS pixels FROM heat, (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048])::DOUBLE AS level), (SELECT unnest([1, 2]) AS band) GROUP BY level, band", "heat")
def overviews_all_levels(spark, sf):
    """Every level, also those beyond the raster, which are one pixel; from the pixel form (values: raster_overviews_lanczos)."""
    o = R.overviews(fx.heat(spark, sf))
    return o.groupBy("level", "band").agg(F.count(F.lit(1)).alias("pixels")).select(F.col("level").cast("double").alias("level"), "band", "pixels")


_WINDOW = """, n AS (SELECT c.col, c.row, v.b2 AS v FROM heat c, (SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy), heat v WHERE v.col = c.col + ox AND v.row = c.row + oy)
    SELECT col, row, round(stddev_pop(v), 1) AS value FROM n GROUP BY 1, 2"""


@query("focal_stddev_large_values", "SELECT * FROM (WITH q AS (SELECT 1) " + _WINDOW + ")", "heat")
def focal_stddev_large_values(spark, sf):
    """Values far from zero don't change a deviation."""
    h = fx.heat(spark, sf)
    far = R.stamp_grid(h.withColumn("value", F.col("value") + 1e9), R.grid_of(h))   # in pixel form
    return R.focal(far, "stddev", 1, 2).select("col", "row", F.round("value", 1).alias("value"))


@query("polygonized_islands", "SELECT 300.0::DOUBLE AS area, count(*) AS n FROM zones UNION ALL SELECT 96.0, count(*) FROM zones UNION ALL SELECT 4.0, count(*) FROM zones", "zones")
def polygonized_islands(spark, sf):
    """Each zone holds an island, and each island another one."""
    b = F.col("bbox")
    inner = lambda z, d: with_bbox(z.select("zone_id", make_box(b["xmin"] + d, b["ymin"] + d, b["xmax"] - d, b["ymax"] - d).alias("geom")))
    z = fx.zones(spark, sf)
    lines = None
    for layer in (z, inner(z, 5.0), inner(z, 9.0)):
        one = TP.zone_grid_edges(layer, "zone_id").select("geom")
        lines = one if lines is None else lines.unionByName(one)
    return TP.polygonize(set_srid(lines, fx.SRID)).groupBy(F.round(N.area(F.col("geom")), 6).alias("area")).agg(F.count(F.lit(1)).alias("n"))


_BORDERS = """, h AS (SELECT DISTINCT y, xmin AS a, xmax AS b FROM (SELECT *, unnest([ymin, ymax]) AS y FROM parcels)), v AS (SELECT DISTINCT x, ymin AS a, ymax AS b FROM (SELECT *, unnest([xmin, xmax]) AS x FROM parcels)),
    ch AS (SELECT any_value(h.b - h.a) AS len, count(DISTINCT v.x) AS cuts FROM h LEFT JOIN v ON v.x > h.a AND v.x < h.b AND h.y BETWEEN v.a AND v.b GROUP BY h.y, h.a, h.b),
    cv AS (SELECT any_value(v.b - v.a) AS len, count(DISTINCT h.y) AS cuts FROM v LEFT JOIN h ON h.y > v.a AND h.y < v.b AND v.x BETWEEN h.a AND h.b GROUP BY v.x, v.a, v.b)"""


@query("noded_lines", _BORDERS + " SELECT sum(cuts + 1)::BIGINT AS pieces, round(sum(len), 3) AS length FROM (SELECT * FROM ch UNION ALL SELECT * FROM cv)", "parcels")
def noded_lines(spark, sf):
    """The borders of all parcels, cut where they cross."""
    s = TP.node_lines(fx.parcels(spark, sf).select("geom"))
    return s.agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(N.length(F.col("geom"))), 3).alias("length"))


@query("polygonized_crossings", "SELECT CASE WHEN xmin = ymin THEN 200.0 ELSE 400.0 END::DOUBLE AS area, xmin, ymin, CASE WHEN xmin = ymin THEN 2 ELSE 1 END::BIGINT AS n FROM zones", "zones")
def polygonized_crossings(spark, sf):
    """Lines through all borders of the zones and beyond, and one across, which passes through nodes of two others."""
    z = fx.zones(spark, sf)
    line = lambda *xy: make_line(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy]))
    at = z.select(F.explode(F.array(F.col("bbox.xmin"), F.col("bbox.xmax"))).alias("c")).distinct()
    lo, hi, c = F.lit(-3), F.lit(103), F.col("c")
    lines = at.select(line((c, lo), (c, hi)).alias("geom")).unionByName(at.select(line((lo, c), (hi, c)).alias("geom"))).unionByName(z.agg(F.min("bbox.xmin").alias("c")).select(line((lo, lo), (hi, hi)).alias("geom")))
    p = TP.polygonize(set_srid(lines, fx.SRID), node=True)
    return p.groupBy(F.round(N.area(F.col("geom")), 6).alias("area"), F.col("bbox.xmin").alias("xmin"), F.col("bbox.ymin").alias("ymin")).agg(F.count(F.lit(1)).alias("n"))


@query("not_in_with_nulls", """SELECT 'nulls' AS list, count(*) AS n FROM customer WHERE CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END NOT IN (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT 'plain', count(*) FROM customer WHERE CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT 'empty', count(*) FROM customer WHERE CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 99)""")
def not_in_with_nulls(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("k"))
    n = t(spark, sf, "nation")
    lists = {"nulls": n.where("n_regionkey = 1").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("v")), "plain": n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("v")),
             "empty": n.where("n_regionkey = 99").select(F.col("n_nationkey").alias("v"))}
    out = None
    for name, values in lists.items():
        one = T.not_in(c, "k", values, "v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("regexp_places", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '[A-M]$') THEN length(p_type) ELSE 0 END::INT AS place, regexp_matches(p_brand, '^Brand#[^1-3]$') AS other FROM part")
def regexp_places(spark, sf):
    """Where a pattern matches, not where its text occurs first; an inverted set."""
    return t(spark, sf, "part").select("p_partkey", SC.regexp_match(F.col("p_type"), "[A-M]$").alias("place"), T.glob("p_brand", "Brand#[^1-3]").alias("other"))


@query("time_texts", "SELECT event_id, strftime(ts, 'day %d of %Y-%mT%H:%M, 100%%') AS text FROM events")
def time_texts(spark, sf):
    return t(spark, sf, "events").select("event_id", SC.strftime("day %d of %Y-%mT%H:%M, 100%%", F.col("ts")).alias("text"))


def _zone_boxes(test, sql):
    @query("mbr_zones_" + test, f"SELECT a.zone_id AS a_id, b.zone_id AS b_id FROM zones a, zones b WHERE {sql}", "zones")
    def run(spark, sf):
        z = fx.zones(spark, sf).select("zone_id", "geom", "bbox")
        return J.mbr_join(z, z, test).select(F.col("a_zone_id").alias("a_id"), F.col("b_zone_id").alias("b_id"))


_zone_boxes("contains", "a.xmin <= b.xmin AND a.xmax >= b.xmax AND a.ymin <= b.ymin AND a.ymax >= b.ymax")
_zone_boxes("equals", "a.xmin = b.xmin AND a.xmax = b.xmax AND a.ymin = b.ymin AND a.ymax = b.ymax")
_zone_boxes("touches", """a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin
    AND NOT (a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin)""")


@query("mbr_disjoint_parcels", """SELECT a.parcel_id FROM parcels a WHERE NOT EXISTS (SELECT 1 FROM (SELECT xmin + 4 AS xmin, ymin + 4 AS ymin, xmax - 4 AS xmax, ymax - 4 AS ymax FROM zones) b
    WHERE a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin)""", "parcels zones")
def mbr_disjoint_parcels(spark, sf):
    """All zones, drawn in so that there is room between them."""
    b = F.col("bbox")
    z = fx.zones(spark, sf).withColumn("bbox", make_bbox(b["xmin"] + 4, b["ymin"] + 4, b["xmax"] - 4, b["ymax"] - 4))
    return J.mbr_join(fx.parcels(spark, sf), z, "disjoint", "semi", id="parcel_id").select("parcel_id")


# The codes of the five segments, worked out by the letters' classes.
_CODES = {"AUTOMOBILE": "A351", "BUILDING": "B435", "FURNITURE": "F653", "HOUSEHOLD": "H243", "MACHINERY": "M256"}


@query("soundex_of_segments", "SELECT c_custkey, CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END AS code FROM customer")
def soundex_of_segments(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.soundex("c_mktsegment").alias("code"))


@query("common_parts_of_words", """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'ARD' WHEN 'LARGE' THEN 'AR' WHEN 'ECONOMY' THEN 'C' WHEN 'MEDIUM' THEN 'D' WHEN 'PROMO' THEN 'R' WHEN 'SMALL' THEN 'S' END AS common FROM part""")
def common_parts_of_words(spark, sf):
    return t(spark, sf, "part").select("p_partkey", SC.longest_common_substring(F.col("p_type"), F.lit("CARDS")).alias("common"))


@query("wrapped_lines", """SELECT doc_id, length(replace(replace(text, ' ', ''), chr(10), '')) AS letters, true AS fits FROM documents""")
def wrapped_lines(spark, sf):
    """Wrapping keeps every letter, and a line is longer than 60 only if it is a single word."""
    lines = F.split("wrapped", "\n")
    d = t(spark, sf, "documents").select("doc_id", SC.wordwrap(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 60).alias("wrapped"))
    return d.select("doc_id", F.length(F.replace(F.replace("wrapped", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))).cast("long").alias("letters"),
                    F.forall(lines, lambda x: (F.length(x) <= 60) | (F.instr(F.trim(x), " ") == 0)).alias("fits"))


@query("estimates_within_bounds", "SELECT 'extent' AS estimate, true AS holds FROM (SELECT count(*) FROM part) UNION ALL SELECT 'rows', true FROM (SELECT count(*) FROM customer)")
def estimates_within_bounds(spark, sf):
    """A sampled extent lies inside the exact one; a sampled count is within a fifth of the exact one."""
    p = fx.parcels(spark, sf)
    some, whole = A.estimated_extent(p, 0.2), A.extent(p).select(*[F.col(c).alias("e_" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    inside = some.join(whole, (F.col("xmin") >= F.col("e_xmin")) & (F.col("ymin") >= F.col("e_ymin")) & (F.col("xmax") <= F.col("e_xmax")) & (F.col("ymax") <= F.col("e_ymax")), "left")
    rows = A.row_counts(fx.sites(spark, sf), 0.5)
    return (inside.select(F.lit("extent").alias("estimate"), F.col("e_xmin").isNotNull().alias("holds"))
            .unionByName(rows.select(F.lit("rows").alias("estimate"), (F.abs(F.col("n") - F.col("estimated")) <= 0.2 * F.col("n")).alias("holds"))))


_BANDS = 1024   # strips by y in which points meet the sides of hulls


def _farthest(points, hulls, by=()):
    """Keys and ``far``, the largest distance of a key's points from its ``hull``, 0 for points inside.

    A point meets only the sides in its own strip, which tell whether it is inside; the few points that are not are measured against the whole hull."""
    by = list(by)
    points = points.select(*by, F.col("bbox.xmin").alias("x"), F.col("bbox.ymin").alias("y"))
    line = hulls.where(N.is_polygonal(F.col("hull"))).select(*by, F.explode(N.rings(F.col("hull"))).alias("r"))
    pairs = F.transform(F.slice("r", 1, F.size("r") - 1), lambda v, i: F.struct(v.alias("p"), F.get(F.col("r"), i + 1).alias("q")))
    line = line.where(F.size("r") > 1).select(*by, F.explode(pairs).alias("s"))
    e = line.agg(F.min(F.least("s.p.y", "s.q.y")).alias("y0"), F.max(F.greatest("s.p.y", "s.q.y")).alias("y1")).first()
    y0, step = e["y0"] or 0.0, _BANDS / max((e["y1"] or 0.0) - (e["y0"] or 0.0), 1e-300)
    band = lambda y: F.floor((y - y0) * step)
    ends = [band(F.col("s.p.y")), band(F.col("s.q.y"))]
    bands = line.select(*by, F.explode(F.sequence(F.least(*ends), F.greatest(*ends))).alias("band"), "s").groupBy(*by, "band").agg(F.collect_list("s").alias("sides"))
    met = points.withColumn("band", band(F.col("y"))).join(A.save_step(bands, "bands"), [*by, "band"], "left")

    def crossed(inside, s):
        p, q, x, y = s["p"], s["q"], F.col("x"), F.col("y")
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        return inside != (((p["y"] <= y) & (q["y"] > y) & (cross > 0)) | ((p["y"] > y) & (q["y"] <= y) & (cross < 0)))

    inside = F.coalesce(F.aggregate("sides", F.lit(False), crossed), F.lit(False))
    open_ = A.save_step(met.where(~inside).select(*by, "x", "y"), "not-inside")
    open_ = open_.join(hulls, by) if by else open_.join(F.broadcast(hulls))   # one hull, held next to the points: the other way round it is copied for all points in one task
    far = open_.groupBy(*by).agg(F.max(N.point_to_geometry(F.col("hull"), F.col("x"), F.col("y"))).alias("far"))
    if not by:
        return far.select(F.coalesce("far", F.lit(0.0)).alias("far"))
    return hulls.select(*by).join(far, by, "left").select(*by, F.coalesce("far", F.lit(0.0)).alias("far"))


@query("hulls_between_points_and_convex", "SELECT zone_id, true AS covers, true AS within_convex FROM zones", "zones")
def hulls_between_points_and_convex(spark, sf):
    """A concave hull holds all its points and is no larger than the convex hull."""
    from ..operators.hulls import polygon_from_points
    d = J.spatial_join(fx.sites(spark, sf), fx.zones(spark, sf), "within").select(F.col("b_zone_id").alias("zone_id"), F.col("a_geom").alias("geom"), F.col("a_bbox").alias("bbox"))
    d = A.save_step(d, "sites-of-zones")
    hull = polygon_from_points(set_srid(d.select("zone_id", "geom"), fx.SRID), 0.4, False, by=["zone_id"]).select("zone_id", F.col("geom").alias("hull"))
    hull = A.save_step(hull, "hulls-of-zones")   # read from files, their size is known and the joins below follow it
    spots = _farthest(d, hull, ["zone_id"]).select("zone_id", (F.col("far") <= 1e-6).alias("covers"))
    convex = A.convex_hull(set_srid(d, fx.SRID), ["zone_id"]).select("zone_id", N.area(F.col("geom")).alias("most"))
    return hull.join(convex, "zone_id").join(spots, "zone_id").select("zone_id", "covers", (N.area(F.col("hull")) <= F.col("most") * (1 + 1e-9)).alias("within_convex"))


def _hull_facts(spark, layer, hull):
    """Whether one hull covers all points of a layer, and its share of the convex hull."""
    hull = A.save_step(hull, "hull")
    far = _farthest(fx.over_tasks(layer), hull.select(F.col("geom").alias("hull")))
    return far.join(hull.select(N.area(F.col("geom")).alias("area"))).join(A.convex_hull(layer).select(N.area(F.col("geom")).alias("most")))


@query("concave_hull_of_layer", "SELECT unnest([0.1::DOUBLE, 1.0]) AS ratio, true AS covers, unnest([false, true]) AS convex, count(*) AS points FROM customer")
def concave_hull_of_layer(spark, sf):
    """All sites at once: the hull covers them, is smaller than the convex hull, and with ratio 1 is the convex hull."""
    from ..operators.hulls import polygon_from_points
    s = fx.sites(spark, sf).select("geom", "bbox")
    out = None
    for ratio in (0.1, 1.0):
        facts = _hull_facts(spark, s, polygon_from_points(s, ratio, False))
        one = facts.join(s.agg(F.count(F.lit(1)).alias("points"))).select(F.lit(ratio).alias("ratio"), (F.col("far") <= 1e-6).alias("covers"), (F.col("area") > F.col("most") * (1 - 1e-9)).alias("convex"), "points")
        out = one if out is None else out.unionByName(one)
    return out


_NOTCH = "NOT (col >= 30 AND row * 3 >= h AND row * 3 < 2 * h)"


@query("concave_hull_of_grid", f"""SELECT count(*)::DOUBLE AS area FROM (SELECT * FROM heat WHERE {_NOTCH}) a JOIN (SELECT * FROM heat WHERE {_NOTCH}) b ON b.col = a.col + 1 AND b.row = a.row
    JOIN (SELECT * FROM heat WHERE {_NOTCH}) c ON c.col = a.col AND c.row = a.row + 1 JOIN (SELECT * FROM heat WHERE {_NOTCH}) d ON d.col = a.col + 1 AND d.row = a.row + 1""", "heat")
def concave_hull_of_grid(spark, sf):
    """A grid of points with a notch, all on common circles: the hull follows the notch, so its area is that of the grid's cells."""
    from ..operators.hulls import polygon_from_points
    h = fx.heat(spark, sf)
    p = R.pixel_centers(h.where("band = 1").withColumn("h", F.lit(R.grid_of(h).height)).where(_NOTCH)).select("geom", "bbox")
    return polygon_from_points(set_srid(p, fx.SRID), 0.001, False).select(F.round(N.area(F.col("geom")), 6).alias("area"))


@query("triangles_of_sites", "SELECT true AS tiled, true AS counted, count(*) AS points FROM (SELECT DISTINCT x, y FROM sites)", "sites")
def triangles_of_sites(spark, sf):
    """Triangles fill the convex hull, and there are two per point but for the border."""
    from ..operators.hulls import delaunay_triangles
    s = fx.sites(spark, sf).select("geom", "bbox")
    t = A.save_step(delaunay_triangles(s).select("outer", N.area(F.col("geom")).alias("area")), "triangles").agg(F.count(F.lit(1)).alias("n"), F.sum("outer").alias("outer"), F.sum("area").alias("area"))
    whole = A.convex_hull(s).select(N.area(F.col("geom")).alias("most"))
    points = s.select("bbox.xmin", "bbox.ymin").distinct().agg(F.count(F.lit(1)).alias("points"))
    return t.join(whole).join(points).select((F.abs(F.col("area") / F.col("most") - 1) < 1e-9).alias("tiled"), (F.col("n") == 2 * F.col("points") - F.col("outer") - 2).alias("counted"), "points")


def _sql(spark, text: str, **layers):
    from ..functions.register import register
    register(spark)
    return spark.sql(text, **layers)


@query("sql_metrics", """SELECT parcel_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(2 * (xmax - xmin + ymax - ymin), 6) AS around, 5 AS points, xmin, ymax, true AS closed, round((xmax - xmin) * (ymax - ymin), 6) AS hull, true AS seat FROM parcels""", "parcels")
def sql_metrics(spark, sf):
    return _sql(spark, """SELECT parcel_id, round(st_area(geom), 6) AS area, round(st_perimeter(geom), 6) AS around, st_npoints(geom) AS points, st_xmin(geom) AS xmin, st_ymax(geom) AS ymax, st_isclosed(geom) AS closed,
        round(st_area(st_convexhull(geom)), 6) AS hull, st_contains(geom, st_pointonsurface(geom)) AS seat FROM {p}""", p=fx.over_tasks(fx.parcels(spark, sf), "parcel_id"))


@query("sql_edits", """SELECT parcel_id, round(xmin + 3, 6) AS moved, round(4 * (xmax - xmin) * (ymax - ymin), 5) AS scaled, round(-ymax, 6) AS turned, round_even(xmin, 0) AS snapped, round(xmin, 6) AS first_x, round(xmax, 6) AS third_x, 'MULTIPOLYGON' AS gtype FROM parcels""", "parcels")
def sql_edits(spark, sf):
    return _sql(spark, """SELECT parcel_id, round(st_xmin(st_translate(geom, 3, 1)), 6) AS moved, round(st_area(st_scale(geom, 2, -2)), 5) AS scaled, round(st_xmin(st_rotate(geom, pi() / 2)), 6) AS turned,
        st_xmin(st_snaptogrid(geom, 1)) + 0D AS snapped, round(st_x(st_startpoint(st_exteriorring(geom))), 6) AS first_x, round(st_x(st_pointn(st_reverse(st_exteriorring(geom)), 3)), 6) AS third_x, st_geometrytype(st_multi(geom)) AS gtype FROM {p}""", p=fx.parcels(spark, sf))


@query("sql_text_forms", """SELECT zone_id, 'POLYGON((' || xmin::INT || ' ' || ymin::INT || ',' || xmax::INT || ' ' || ymin::INT || ',' || xmax::INT || ' ' || ymax::INT || ',' || xmin::INT || ' ' || ymax::INT || ',' || xmin::INT || ' ' || ymin::INT || '))' AS text,
    'POINT(' || xmin::INT || ' ' || ymin::INT || ')' AS corner, round(pi() / 4, 6) AS angle, 1 AS parts FROM zones""", "zones")
def sql_text_forms(spark, sf):
    return _sql(spark, """SELECT zone_id, st_astext(z.geom) AS text, st_astext(st_startpoint(st_exteriorring(z.geom))) AS corner, round(st_azimuth(st_point(st_xmin(z.geom), st_ymin(z.geom)), st_point(st_xmax(z.geom), st_ymax(z.geom))), 6) AS angle,
        d.path AS parts FROM {z} AS z, LATERAL st_dump(z.geom) d""", z=fx.zones(spark, sf))


@query("sql_spatial_join", "SELECT n_regionkey AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM sites s JOIN zones z ON x > xmin AND x < xmax AND y > ymin AND y < ymax WHERE c_mktsegment <> 'BUILDING' GROUP BY 1", "sites zones")
def sql_spatial_join(spark, sf):
    """A spatial predicate in the query builder runs as a grid join."""
    spec = T.QuerySpec(["z.n_regionkey AS region", "count(*) AS n", "round(sum(s.c_acctbal), 2) AS balance"], {"s": fx.sites(spark, sf), "z": fx.zones(spark, sf)},
                       "st_within(s.geom, z.geom) AND s.c_mktsegment <> 'BUILDING'", ["z.n_regionkey"])
    return spec.to_df(spark)


@query("bounding_circles", """SELECT parcel_id::VARCHAR AS of, round((xmin + xmax) / 2, 6) AS x, round((ymin + ymax) / 2, 6) AS y, round(sqrt(power(xmax - xmin, 2) + power(ymax - ymin, 2)) / 2, 6) AS radius FROM parcels
    UNION ALL SELECT c_mktsegment, 50, 50, round(max(sqrt(power(x - 50, 2) + power(y - 50, 2))), 6) FROM sites GROUP BY c_mktsegment""", "parcels sites")
def bounding_circles(spark, sf):
    """Around each parcel, and around the sites of a segment with their mirror images, whose circle stands in the middle."""
    s = fx.sites(spark, sf).select("c_mktsegment", "geom")
    both = s.unionByName(s.withColumn("geom", N.translate(N.scale(F.col("geom"), -1.0, -1.0), 100.0, 100.0)))
    one = A.bounding_circles(fx.over_tasks(fx.parcels(spark, sf), "parcel_id"), ["parcel_id"]).select(F.col("parcel_id").cast("string").alias("of"), "x", "y", "radius")
    rows = one.unionByName(A.bounding_circles(both, ["c_mktsegment"]).select(F.col("c_mktsegment").alias("of"), "x", "y", "radius"))
    return rows.select("of", *[F.round(c, 6).alias(c) for c in ("x", "y", "radius")])


@query("sql_texts_in_and_out", """SELECT parcel_id, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy, round((xmax - xmin) * (ymax - ymin), 6) AS area, true AS same, '{"type":"Point","coordinates":[' || round(xmin, 3)::VARCHAR || ',' || parcel_id || '.0]}' AS json,
    (4 * greatest(1, ceil((xmax - xmin) / 0.75)) / 2 + 4 * greatest(1, ceil((ymax - ymin) / 0.75)) / 2 + 1)::INT AS points FROM parcels""", "parcels")
def sql_texts_in_and_out(spark, sf):
    return _sql(spark, """SELECT parcel_id, round(st_x(st_centroid(geom)), 6) AS cx, round(st_y(st_centroid(geom)), 6) AS cy, round(st_area(st_geomfromtext(st_astext(geom))), 6) AS area, st_geomfromtext('SRID=3857; ' || lower(st_astext(geom))) = geom AS same,
        st_asgeojson(st_point(round(st_xmin(geom), 3), parcel_id)) AS json, st_npoints(st_segmentize(geom, 0.75)) AS points FROM {p}""", p=fx.over_tasks(fx.parcels(spark, sf), "parcel_id"))


@query("sql_places_on_lines", """SELECT order_id, line_no, round(x1 + (x2 - x1) * 0.25, 6) AS x, 0.75 AS share, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) / 2, 6) AS half, true AS simple, false AS ring FROM routes WHERE x1 <> x2 OR y1 <> y2""", "routes")
def sql_places_on_lines(spark, sf):
    return _sql(spark, """SELECT order_id, line_no, round(st_x(st_line_interpolate_point(geom, 0.25)), 6) AS x, round(st_line_locate_point(geom, st_line_interpolate_point(geom, 0.75)), 6) AS share, round(st_length(st_line_substring(geom, 0.25, 0.75)), 6) AS half,
        st_issimple(geom) AS simple, st_isring(geom) AS ring FROM {r} WHERE st_length(geom) > 0""", r=fx.routes(spark, sf))
