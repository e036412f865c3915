"""Queries over the event raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import native as N
from ..operators import raster as R, tiles as TL
from ..sources import raster as SR
from .registry import query


_LONG = """, px AS (SELECT rid, 1 AS band, col, row, b1 AS value, h FROM heat UNION ALL SELECT rid, 2, col, row, b2, h FROM heat)"""


@query("raster_summary", "SELECT count(b1) AS count, round(sum(b1), 3) AS sum, round(avg(b1), 6) AS mean, round(stddev_pop(b1), 6) AS stddev, min(b1) AS min, max(b1) AS max, round(max(b1) - min(b1), 6) AS range FROM heat", "heat")
def raster_summary(spark, sf):
    s = R.raster_summary(fx.heat_tiles(spark, sf), 1)
    return s.select("count", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "min", "max", F.round("range", 6).alias("range"))


@query("raster_summary_band2", "SELECT count(b2) AS count, sum(b2) AS sum, round(avg(b2), 6) AS mean, min(b2) AS min, max(b2) AS max FROM heat", "heat")
def raster_summary_band2(spark, sf):
    return R.raster_summary(fx.heat(spark, sf), 2).select("count", "sum", F.round("mean", 6).alias("mean"), "min", "max")


def _px(t, *cols):
    """Pixel rows of tiles, for comparison."""
    return R.from_tiles(t).select("band", "col", "row", *(cols or ["value"]))


def _r(digits):
    return F.round("value", digits).alias("value")


@query("raster_mosaic", _LONG + " SELECT band, col, row, round(CASE WHEN row < 25 AND col < 25 THEN value + 1 ELSE value END, 6) AS value FROM px", "heat")
def raster_mosaic(spark, sf):
    """Raster with a shifted copy of tile 0 on top: the copy wins."""
    h = fx.heat_tiles(spark, sf)
    top = h.where("rid = 0").withColumn("rid", F.lit(1000).cast("long")).withColumn("bands", F.transform("bands", lambda b: F.transform(b, lambda v: v + 1)))
    return _px(R.mosaic(TL.stamp(h.unionByName(top), R.grid_of(h))), _r(6))


@query("raster_retile", _LONG + " SELECT (row // 30) * 3 + col // 40 AS rid, band, count(*) AS pixels, round(coalesce(sum(value), 0), 3) AS total FROM px GROUP BY 1, 2", "heat")
def raster_retile(spark, sf):
    t = R.from_tiles(R.retile(fx.heat_tiles(spark, sf), 40, 30))
    return t.groupBy("rid", "band").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 3).alias("total"))


@query("raster_retile_pixels", _LONG + " SELECT (row // 30) * 3 + col // 40 AS rid, band, count(*) AS pixels, round(coalesce(sum(value), 0), 3) AS total FROM px GROUP BY 1, 2", "heat")
def raster_retile_pixels(spark, sf):
    """The same from the pixel form."""
    return R.retile(fx.heat(spark, sf), 40, 30).groupBy("rid", "band").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 3).alias("total"))


@query("raster_tiles", """SELECT rid, min(col)::INT AS tx, min(row)::INT AS ty, (max(col) - min(col) + 1)::INT AS width, (max(row) - min(row) + 1)::INT AS height, 2 AS bands, min(col)::DOUBLE AS ulx, (min(h) - min(row))::DOUBLE AS uly,
    round(sum(b2), 3) AS total FROM heat GROUP BY rid""", "heat")
def raster_tiles(spark, sf):
    t = R.to_tiles(fx.heat(spark, sf))
    return t.select("rid", "tx", "ty", "width", "height", F.size("bands").alias("bands"), "ulx", "uly",
                    F.round(F.aggregate(F.col("bands")[1], F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@query("raster_tiles_and_back", _LONG + " SELECT rid, band, col, row, value FROM px", "heat")
def raster_tiles_and_back(spark, sf):
    return R.from_tiles(R.to_tiles(fx.heat(spark, sf)))


@query("resample_nearest", _LONG + " SELECT band, col // 2 AS col, row // 2 AS row, value FROM px WHERE col % 2 = 1 AND row % 2 = 1", "heat")
def resample_nearest(spark, sf):
    return _px(R.resample(fx.heat_tiles(spark, sf), 2.0, "NearestNeighbor"))


@query("resample_nearest_up", _LONG + " SELECT band, col * 2 + a AS col, row * 2 + b AS row, value FROM px, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)", "heat")
def resample_nearest_up(spark, sf):
    return _px(R.resample(fx.heat_tiles(spark, sf), 0.5, "NearestNeighbor"))


def _weights_sql(weight, levels, digits):
    """Two-dimensional weighted mean over the source pixels around each target, pixel size by level (the kernel stretched alike), axis by axis."""
    distance = lambda t, c: f"abs(({t} + 0.5) * level - ({c} + 0.5)) / level::DOUBLE"
    return _LONG + f""", levels AS (SELECT unnest([{levels}]) AS level), size AS (SELECT max(h) AS h FROM heat),
    tc AS (SELECT level, unnest(generate_series(0, ceil(100 / level::DOUBLE)::BIGINT - 1)) AS tc FROM levels), tr AS (SELECT level, unnest(generate_series(0, ceil(h / level::DOUBLE)::BIGINT - 1)) AS tr FROM levels, size),
    wc AS (SELECT * FROM (SELECT level, tc, c, ({weight.replace('$', 'd')}) AS w FROM (SELECT level, tc, c, {distance('tc', 'c')} AS d FROM tc, (SELECT DISTINCT col AS c FROM heat))) WHERE w <> 0),
    wr AS (SELECT * FROM (SELECT level, tr, r, ({weight.replace('$', 'd')}) AS w FROM (SELECT level, tr, r, {distance('tr', 'r')} AS d FROM tr, (SELECT DISTINCT row AS r FROM heat))) WHERE w <> 0),
    mid AS (SELECT level, band, tc, row, sum(w * value) AS s, sum(w) AS w FROM px JOIN wc ON c = col WHERE value IS NOT NULL GROUP BY ALL),
    made AS (SELECT mid.level, band, tc AS col, tr AS row, sum(wr.w * s) AS s, sum(wr.w * mid.w) AS w FROM mid JOIN wr ON wr.level = mid.level AND r = row GROUP BY ALL)
    SELECT level, band, col, row, round(CASE WHEN abs(w) > 1e-12 THEN s / w END, {digits}) AS value FROM made"""


_KERNELS = {"Bilinear": "greatest(0, 1 - $)", "Cubic": "CASE WHEN $ <= 1 THEN 1.5 * $ * $ * $ - 2.5 * $ * $ + 1 WHEN $ < 2 THEN -0.5 * $ * $ * $ + 2.5 * $ * $ - 4 * $ + 2 ELSE 0 END",
            "CubicSpline": "CASE WHEN $ <= 1 THEN (3 * $ * $ * $ - 6 * $ * $ + 4) / 6 WHEN $ < 2 THEN (2 - $) * (2 - $) * (2 - $) / 6 ELSE 0 END",
            "Lanczos": "CASE WHEN $ = 0 THEN 1 WHEN $ < 3 THEN sin(pi() * $) / (pi() * $) * sin(pi() * $ / 3) / (pi() * $ / 3) ELSE 0 END"}


def _resample(name, alg):
    @query("resample_" + name, _weights_sql(_KERNELS[alg], "2", 9).replace("SELECT level, band, col, row, round", "SELECT band, col, row, round"), "heat")
    def run(spark, sf):
        return _px(R.resample(fx.heat_tiles(spark, sf), 2.0, alg), _r(9))


for _name, _alg in {"bilinear": "Bilinear", "cubic": "Cubic", "spline": "CubicSpline", "lanczos": "Lanczos"}.items():
    _resample(_name, _alg)

_INSIDE = "EXISTS (SELECT 1 FROM zones WHERE n_regionkey = 1 AND col + 0.5 BETWEEN xmin AND xmax AND h - row - 0.5 BETWEEN ymin AND ymax)"


@query("raster_clip", _LONG + f""", c AS (SELECT *, {_INSIDE} AS hit FROM px) SELECT rid, band, count(*) AS pixels, count(CASE WHEN hit THEN value END) AS n, round(coalesce(sum(CASE WHEN hit THEN value END), 0), 3) AS total FROM c
    WHERE EXISTS (SELECT 1 FROM zones WHERE n_regionkey = 1 AND (c.rid % 4) * 25 < xmax AND (c.rid % 4) * 25 + 25 > xmin AND c.h - (c.rid // 4) * 25 > ymin AND c.h - least((c.rid // 4) * 25 + 25, c.h) < ymax) GROUP BY 1, 2""", "heat zones")
def raster_clip(spark, sf):
    """Tiles that meet the mask stay whole, with nodata outside of it."""
    c = R.from_tiles(R.raster_clip(fx.heat_tiles(spark, sf), fx.zones(spark, sf).where("n_regionkey = 1")))
    return c.groupBy("rid", "band").agg(F.count(F.lit(1)).alias("pixels"), F.count("value").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 3).alias("total"))


@query("raster_clip_extent", _LONG + " SELECT band, count(*) AS pixels, round(sum(value), 3) AS total FROM px GROUP BY 1", "heat")
def raster_clip_extent(spark, sf):
    """Clip by the extent of a raster keeps all of it."""
    h = fx.heat(spark, sf)
    return R.raster_clip(h, R.extent_layer(h)).groupBy("band").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("value"), 3).alias("total"))


@query("raster_reproject", _LONG + " SELECT band, count(*) AS pixels, count(value) AS n, round(sum(value), 3) AS total FROM px GROUP BY 1", "heat")
def raster_reproject(spark, sf):
    """From web Mercator metres to degrees and the count of pixels."""
    r = R.from_tiles(R.reproject_raster(fx.heat_tiles(spark, sf), 4326))
    return r.groupBy("band").agg(F.count(F.lit(1)).alias("pixels"), F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("raster_overviews", _LONG + """ SELECT level, band, tc AS col, tr AS row, value FROM (SELECT level, band, col // level AS tc, row // level AS tr, value, col, row, h FROM px, (SELECT unnest([2, 4, 8]) AS level))
    WHERE col = least((tc * 2 + 1) * level // 2, 99) AND row = least((tr * 2 + 1) * level // 2, h - 1)""", "heat")
def raster_overviews(spark, sf):
    o = R.overviews(fx.heat_tiles(spark, sf), (2, 4, 8), "NearestNeighbor")
    return R._like(TL.to_pixels(o, ("level",)), R.grid_of(o), ("level",)).select("level", "band", "col", "row", "value")


@query("raster_overviews_lanczos", _weights_sql(_KERNELS["Lanczos"], "2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048", 5), "heat")
def raster_overviews_lanczos(spark, sf):
    """All levels, also those beyond the raster, which are one pixel; every value is compared."""
    o = R.overviews(fx.heat_tiles(spark, sf))
    return R._like(TL.to_pixels(o, ("level",)), R.grid_of(o), ("level",)).select("level", "band", "col", "row", _r(5))


_RULES = "['srid', 'scale_x', 'scale_y', 'blocksize_x', 'blocksize_y', 'same_alignment', 'regular_blocking', 'num_bands', 'pixel_types', 'nodata_values', 'out_db', 'extent']"


@query("raster_constraints", f"""SELECT 'kept' AS wanted, unnest({_RULES}) AS rule, true AS passed FROM (SELECT count(*) FROM events) UNION ALL
    SELECT 'others', unnest({_RULES}), unnest([false, false, true, false, h <= 20, false, false, false, true, count(b1) = count(*), true, true]) FROM heat GROUP BY h""", "heat")
def raster_constraints(spark, sf):
    """What holds, and what would be asked of it in vain."""
    h = fx.heat_tiles(spark, sf)
    kept, others = R.check_constraints(h, 25, 25, 2, fx.SRID, (1.0, -1.0)), R.check_constraints(h, 20, 20, 3, 4326, (2.0, -1.0), nodata=False)
    return kept.select(F.lit("kept").alias("wanted"), "rule", "passed").unionByName(others.select(F.lit("others").alias("wanted"), "rule", "passed"))


@query("raster_constraints_pixels", f"SELECT unnest({_RULES}) AS rule, true AS passed FROM (SELECT count(*) FROM events)")
def raster_constraints_pixels(spark, sf):
    return R.check_constraints(fx.heat(spark, sf), 25, 25, 2, fx.SRID)


@query("raster_profile", "SELECT count(DISTINCT rid) AS tiles, 2::BIGINT AS bands, 2 * count(*) AS pixels, count(*) - count(b1) AS nodata, 99 AS col_max, max(row)::INT AS row_max, 3857 AS srid FROM heat", "heat")
def raster_profile(spark, sf):
    return R.raster_profile(fx.heat_tiles(spark, sf)).select("tiles", "bands", "pixels", "nodata", "col_max", "row_max", "srid")


@query("raster_values_at_points", "SELECT site_id, b1 AS value FROM sites LEFT JOIN heat ON floor(x) = col AND floor(h - y) = row", "heat sites")
def raster_values_at_points(spark, sf):
    return R.values_at(fx.heat(spark, sf), fx.sites(spark, sf).select("site_id", "bbox"), 1).select("site_id", "value")


@query("raster_value_counts", "SELECT b2 AS value, count(*) AS n FROM heat GROUP BY 1", "heat")
def raster_value_counts(spark, sf):
    return R.value_count(fx.heat_tiles(spark, sf), 2)


@query("raster_histogram", "SELECT least(floor(b1 / 50)::BIGINT + 1, 10) AS bin, count(*) AS n FROM heat WHERE b1 BETWEEN 0 AND 500 GROUP BY 1", "heat")
def raster_histogram(spark, sf):
    return R.histogram(fx.heat_tiles(spark, sf), 1, 10, 0.0, 500.0)


@query("raster_quantiles", "SELECT q AS quantile, round(v, 6) AS value FROM (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS q, unnest(quantile_cont(b1, [0.0, 0.25, 0.5, 0.75, 1.0])) AS v FROM heat WHERE b1 IS NOT NULL)", "heat")
def raster_quantiles(spark, sf):
    return R.quantiles(fx.heat_tiles(spark, sf), 1).select("quantile", F.round("value", 6).alias("value"))


@query("zonal_statistics", """SELECT zone_id, count(b1) AS count, round(sum(b1), 3) AS sum, round(avg(b1), 6) AS mean, round(stddev_pop(b1), 6) AS stddev, min(b1) AS min, max(b1) AS max FROM heat, zones
    WHERE b1 IS NOT NULL AND col + 0.5 BETWEEN xmin AND xmax AND h - row - 0.5 BETWEEN ymin AND ymax GROUP BY 1""", "heat zones")
def zonal_statistics(spark, sf):
    z = R.zonal_stats(fx.heat_tiles(spark, sf), fx.zones(spark, sf), "zone_id", 1)
    return z.select("zone_id", "count", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "min", "max")


@query("map_algebra", "SELECT col, row, round(b1 * 2 + b2 / 10, 6) AS value FROM heat", "heat")
def map_algebra(spark, sf):
    return _px(R.map_algebra(fx.heat_tiles(spark, sf), "b1 * 2 + b2 / 10", (1, 2)), _r(6)).drop("band")


@query("raster_reclass", "SELECT 1 AS band, col, row, CASE WHEN b1 >= 0 AND b1 < 50 THEN 1.0::DOUBLE WHEN b1 >= 50 AND b1 < 200 THEN 2.0 END AS value FROM heat UNION ALL SELECT 2, col, row, b2 FROM heat", "heat")
def raster_reclass(spark, sf):
    """One band gets classes, the other stays."""
    return _px(R.reclass(fx.heat_tiles(spark, sf), [(0, 50, 1), (50, 200, 2)], 1))


@query("raster_grayscale", "SELECT col, row, round(0.2989 * b1 + 0.5870 * b2 + 0.1140 * b1, 6) AS value FROM heat", "heat")
def raster_grayscale(spark, sf):
    h = fx.heat_tiles(spark, sf)
    return _px(R.grayscale(R.add_band(h, h, 3)), _r(6)).drop("band")


@query("raster_drop_band", "SELECT 1 AS band, count(*) AS pixels, sum(b2) AS total FROM heat", "heat")
def raster_drop_band(spark, sf):
    return R.from_tiles(R.drop_band(fx.heat_tiles(spark, sf), 1)).groupBy("band").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("total"))


_FOCAL = """, n AS (SELECT c.col, c.row, v.b1 AS v, v.col - c.col AS dx, v.row - c.row AS dy FROM heat c, (SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy), heat v WHERE v.col = c.col + ox AND v.row = c.row + oy)"""


def _focal(kind, sql):
    @query("focal_" + kind, _FOCAL + f"SELECT col, row, round({sql}, 5) AS value FROM n GROUP BY 1, 2", "heat")
    def run(spark, sf):
        return _px(R.focal(fx.heat_tiles(spark, sf), kind, 1, 1), _r(5)).drop("band")


for _kind, _sql in {"count": "count(v)::DOUBLE", "sum": "sum(v)", "mean": "avg(v)", "stddev": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "range": "max(v) - min(v)", "distinct": "count(DISTINCT v)::DOUBLE",
                    "invdist": "coalesce(max(CASE WHEN dx = 0 AND dy = 0 THEN v END), sum(CASE WHEN dx <> 0 OR dy <> 0 THEN v / sqrt(dx * dx + dy * dy) END) / sum(CASE WHEN (dx <> 0 OR dy <> 0) AND v IS NOT NULL THEN 1 / sqrt(dx * dx + dy * dy) END))"}.items():
    _focal(_kind, _sql)

_TERRAIN = """, n AS (SELECT c.col, c.row, v.b2 AS v, v.col - c.col AS dx, v.row - c.row AS dy FROM heat c, (SELECT unnest([-1, 0, 1]) AS ox), (SELECT unnest([-1, 0, 1]) AS oy), heat v WHERE v.col = c.col + ox AND v.row = c.row + oy),
    g AS (SELECT col, row, count(*) = 9 AS whole, sum(dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * v) / 8 AS gx, sum(dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) * v) / 8 AS gy, max(v) - min(v) AS rough,
        max(CASE WHEN dx = 0 AND dy = 0 THEN v END) AS c, sum(CASE WHEN dx <> 0 OR dy <> 0 THEN v END) AS around, list(v) AS l FROM n GROUP BY 1, 2),
    a AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS s, CASE WHEN gx = 0 AND gy = 0 THEN NULL WHEN atan2(-gx, gy) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END AS asp FROM g) """


def _terrain(kind, sql):
    @query("terrain_" + kind, _TERRAIN + f"SELECT col, row, CASE WHEN whole THEN round({sql}, 5) END AS value FROM a", "heat")
    def run(spark, sf):
        return _px(R.terrain(fx.heat_tiles(spark, sf), kind, 2), _r(5)).drop("band")


for _kind, _sql in {"slope": "degrees(s)", "aspect": "asp", "hillshade": "greatest(0, 255 * (cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(315) - radians(coalesce(asp, 0)))))",
                    "roughness": "rough", "tpi": "c - around / 8", "tri": "list_sum(list_transform(l, lambda x: abs(x - c))) / 8"}.items():
    _terrain(_kind, _sql)


@query("burned_parcels", """SELECT col, row, arg_max(value, parcel_id) AS value FROM (SELECT c AS col, r AS row, parcel_id, (1 + parcel_id % 9)::DOUBLE AS value FROM parcels, (SELECT unnest(generate_series(0, 99)) AS c), (SELECT unnest(generate_series(0, 99)) AS r)
    WHERE c + 0.5 BETWEEN xmin AND xmax AND 100 - r - 0.5 BETWEEN ymin AND ymax) GROUP BY 1, 2""", "parcels")
def burned_parcels(spark, sf):
    p = fx.parcels(spark, sf).withColumn("v", (1 + F.col("parcel_id") % 9).cast("double"))
    return R.burn(p, R.Grid(0.0, 100.0, 1.0, -1.0, 100, 100, fx.SRID), "v", "parcel_id").select("col", "row", "value")


@query("pixel_polygons", "SELECT count(*) AS n, count(*)::DOUBLE AS area, round(sum(b1), 3) AS total FROM heat WHERE b1 IS NOT NULL", "heat")
def pixel_polygons(spark, sf):
    return R.pixel_polygons(fx.heat_tiles(spark, sf), 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(N.area(F.col("geom"))), 6).alias("area"), F.round(F.sum("value"), 3).alias("total"))


@query("raster_vector_intersection", """SELECT zone_id, count(*) AS n, round(sum(greatest(0, least(col + 1, xmax) - greatest(col, xmin)) * greatest(0, least(h - row, ymax) - greatest(h - row - 1, ymin)) * b1), 3) AS total
    FROM heat, zones WHERE b1 IS NOT NULL AND col < xmax AND col + 1 > xmin AND h - row - 1 < ymax AND h - row > ymin GROUP BY 1""", "heat zones")
def raster_vector_intersection(spark, sf):
    """Pixel boxes cut by the zones, weighted by area."""
    from ..operators import joins as J
    px = R.pixel_polygons(fx.heat(spark, sf), 1)
    i = J.intersection(px, fx.zones(spark, sf), ["value"], mask_cols=["zone_id"]).where(N.is_polygonal(F.col("geom")))
    return i.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(N.area(F.col("geom")) * F.col("value")), 3).alias("total"))


@query("georeference", _LONG + " SELECT band, col, row, col::DOUBLE AS ulx, (h - row)::DOUBLE AS uly, col + 0.5::DOUBLE AS cx, h - row - 0.5::DOUBLE AS cy FROM px", "heat")
def georeference(spark, sf):
    return R.georeference(fx.heat_tiles(spark, sf)).select("band", "col", "row", "ulx", "uly", "cx", "cy")


@query("stored_raster", "SELECT level, count(DISTINCT (row // level // 50) * 1000 + col // level // 50) AS tiles, 2 * count(DISTINCT (row // level) * 1000 + col // level) AS pixels FROM heat, (SELECT unnest([1, 2]) AS level) GROUP BY 1", "heat")
def stored_raster(spark, sf):
    """Written as tiles with one overview level, and read back."""
    import uuid
    from ..operators.aggregate import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/raster-{uuid.uuid4().hex}"
    SR.import_raster(fx.heat_tiles(spark, sf), path, True, 50, 50, (2,))
    out = None
    for folder, level in ((0, 1), (2, 2)):
        r = SR.read_raster(spark, f"{path}/level={folder}")
        one = r.agg(F.countDistinct("rid").alias("tiles"), F.count(F.lit(1)).alias("pixels")).select(F.lit(level).alias("level"), "tiles", "pixels")
        out = one if out is None else out.unionByName(one)
    return out


# every fourth diagonal and a block of columns have no data
_GAPS = "SELECT col, row, CASE WHEN (col + row) % 4 > 0 AND col NOT BETWEEN 40 AND 60 THEN b1 END AS v FROM heat"


def _gappy(spark, sf):
    h = fx.heat(spark, sf).where("band = 1")
    keep = "(col + row) % 4 > 0 AND col NOT BETWEEN 40 AND 60"
    return R.stamp_grid(h.withColumn("value", F.when(F.expr(keep), F.col("value"))), R.grid_of(h))


@query("raster_nearest_values", f"""SELECT site_id, (SELECT arg_min(v, (power(col - floor(x), 2) + power(row - floor(tall - y), 2), row, col)) FROM ({_GAPS}) WHERE v IS NOT NULL) AS value FROM sites, (SELECT max(h) AS tall FROM heat)""", "heat sites")
def raster_nearest_values(spark, sf):
    """Each site's nearest value, also over gaps and outside of the raster."""
    return R.nearest_values(_gappy(spark, sf), fx.sites(spark, sf).select("site_id", "bbox"), 1).select("site_id", "value")


@query("raster_gaps_filled", f""", g AS ({_GAPS})
    SELECT col, row, coalesce(v, (SELECT arg_min(d.v, (power(d.col - g.col, 2) + power(d.row - g.row, 2), d.row, d.col)) FROM g d WHERE d.v IS NOT NULL)) AS value FROM g""", "heat")
def raster_gaps_filled(spark, sf):
    """A band without gaps."""
    return R.fill_nearest(_gappy(spark, sf), 1)


@query("raster_pixels_of_value", "SELECT b2 AS value, col, row FROM heat WHERE b2 IN (3, 7, 11)", "heat")
def raster_pixels_of_value(spark, sf):
    return R.pixels_of_value(fx.heat_tiles(spark, sf), [3, 7, 11], 2)


@query("raster_dump_values", "SELECT row, col // 25 * 25 AS col, count(*) AS places, round(sum(b2), 4) AS total, min_by(b2, col) AS first_value FROM heat GROUP BY row, col // 25", "heat")
def raster_dump_values(spark, sf):
    """Rows of values per tile: how many, their sum and the first one."""
    v = F.filter("values", lambda x: x.isNotNull() & ~F.isnan(x))
    return R.dump_values(fx.heat_tiles(spark, sf), 2).select("row", "col", F.size(v).alias("places"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.get("values", F.lit(0)).alias("first_value")).where("places > 0")
