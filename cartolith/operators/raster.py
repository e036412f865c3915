"""Raster operators, on the tile form (see ``tiles``) and on the pixel form (rid, band, col, row, value).

``col`` and ``row`` count from the upper-left corner of one common grid, so
tiles line up by integer arithmetic.  NULL is nodata.  The grid itself (origin,
pixel size, size in pixels, SRID) travels in the metadata of ``value`` or ``bands``.
An operator gives back the form it gets.  The work is done on tiles; the pixel form
is for joins and SQL by pixel, and is gathered into tiles where an operator needs them.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from . import tiles as T
from ..functions import native as N
from ..functions.kernel import union_many, union_one
from ..layer import ensure_bbox, make_bbox, make_box, make_point, set_srid, srid_of, with_bbox
from ..plans.grid import candidate_pairs
from ..plans.ranks import exact_quantiles
from ..plans.reduce import merge_by_key
from .tiles import is_tiles
from .transform import reproject, transform_xy

MAX_UNTILED_BYTES = 104857600   # fixed value: larger rasters must be tiled
TILE = 256                      # fixed values: import tile and retile sizes
RETILE = 100
OVERVIEW_LEVELS = tuple(2 ** i for i in range(1, 12))   # 2 .. 2048


@dataclass(frozen=True)
class Grid:
    ulx: float
    uly: float
    sx: float
    sy: float
    width: int
    height: int
    srid: int | None = None

    def to_world(self, col, row):
        """World position of a pixel position (0.5 = centre of the first pixel)."""
        return self.ulx + col * self.sx, self.uly + row * self.sy

    def to_pixel(self, x, y):
        return (x - self.ulx) / self.sx, (y - self.uly) / self.sy

    @property
    def extent(self):
        x1, y1 = self.ulx + self.width * self.sx, self.uly + self.height * self.sy
        return min(self.ulx, x1), min(self.uly, y1), max(self.ulx, x1), max(self.uly, y1)


def stamp_grid(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withMetadata("value", {"grid": {k: v for k, v in asdict(grid).items() if v is not None}})


def grid_of(r: DataFrame) -> Grid:
    if is_tiles(r):
        return T.grid_of(r)
    meta = r.schema["value"].metadata.get("grid")
    if meta is None:
        raise ValueError("the raster carries no grid; stamp it first")
    return Grid(**meta)


def _like(out: DataFrame, grid: Grid, extra: tuple[str, ...] = ()) -> DataFrame:
    return stamp_grid(out.select(*extra, F.col("rid").cast("long"), F.col("band").cast("int"), F.col("col").cast("int"),
                                 F.col("row").cast("int"), F.col("value").cast("double")), grid)


# ---------------------------------------------------------------- mosaic, tiles

def tile_boxes(r: DataFrame) -> DataFrame:
    """Pixel box of every tile."""
    if is_tiles(r):
        return r.select("rid", F.col("tx").alias("c0"), (F.col("tx") + F.col("width") - 1).alias("c1"), F.col("ty").alias("r0"), (F.col("ty") + F.col("height") - 1).alias("r1"))
    return r.groupBy("rid").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))


def has_overlap(r: DataFrame) -> bool:
    """Whether two tiles share pixels; works on one row per tile. Tiles that an operator has made disjoint say so themselves."""
    if is_tiles(r):
        return not T.is_flat(r) and T.has_overlap(r)
    t = tile_boxes(r).select("rid", make_bbox(F.col("c0") + 0.25, F.col("r0") + 0.25, F.col("c1") + 0.75, F.col("r1") + 0.75).alias("bbox"))
    pairs, _ = candidate_pairs(t, t, ageom=None, bgeom=None)
    return not pairs.where("a_rid < b_rid").isEmpty()


def mosaic(r: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """One value per pixel: the highest ``rid`` with data wins.

    Tiles that do not overlap need no shuffle; ``overlaps`` skips the check."""
    if overlaps is None:
        overlaps = has_overlap(r)
    if not overlaps:
        return r
    if is_tiles(r):
        return T.mosaic(r, True, TILE)
    out = r.groupBy("band", "col", "row").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("rid"))).alias("value"), F.max("rid").alias("rid"))
    return _like(out, grid_of(r))


def as_tiles(r: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """Tile form without overlaps."""
    m = mosaic(r, overlaps)
    return m if is_tiles(m) else T.from_pixels(m, grid_of(m))


def _back(r: DataFrame, t: DataFrame, grid: Grid | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tiles ``t`` in the form of ``r``."""
    return t if is_tiles(r) else _like(T.to_pixels(t, extra), grid or T.grid_of(t), extra)


def retile(r: DataFrame, w: int = RETILE, h: int = RETILE, overlaps: bool | None = None) -> DataFrame:
    """Mosaic, then number the tiles row by row; edge tiles are smaller."""
    if is_tiles(r):
        return T.retile(r, w, h)
    g = grid_of(r)
    across = -(-g.width // w)
    rid = F.floor(F.col("row") / h) * across + F.floor(F.col("col") / w)
    return _like(mosaic(r, overlaps).withColumn("rid", rid), g)


def untiled_bytes(grid: Grid, bands: int, bytes_per_value: int = 8) -> int:
    return grid.width * grid.height * bands * bytes_per_value


def must_tile(grid: Grid, bands: int, bytes_per_value: int = 8) -> bool:
    """The size rule: a raster of 100 MiB or more is always tiled."""
    return untiled_bytes(grid, bands, bytes_per_value) >= MAX_UNTILED_BYTES


def to_tiles(r: DataFrame) -> DataFrame:
    """Tile form for storage: one row per tile with its place in the world; pixels that a tile's rectangle lacks are NULL in their place."""
    t = T.whole_tiles(r) if is_tiles(r) else T.from_pixels(r, grid_of(r))
    g = T.grid_of(t)
    x, y = g.to_world(F.col("tx"), F.col("ty"))
    return T.stamp(t.select("rid", "tx", "ty", x.alias("ulx"), y.alias("uly"), F.lit(g.sx).alias("sx"), F.lit(g.sy).alias("sy"), "width", "height", F.lit(g.srid).cast("int").alias("srid"), "bands"), g, T.is_flat(t))


def from_tiles(t: DataFrame, grid: Grid | None = None) -> DataFrame:
    return _like(T.to_pixels(t), grid or T.grid_of(t))


def _band(r: DataFrame, band: int, overlaps: bool | None) -> DataFrame:
    """(value) of the pixels of one band that hold data."""
    if is_tiles(r):
        return T.band_values(mosaic(r, overlaps), band)
    return mosaic(r.where(F.col("band") == band), overlaps).where(F.col("value").isNotNull())


def _pixels(r: DataFrame, band: int, overlaps: bool | None) -> DataFrame:
    """One band in pixel form."""
    if is_tiles(r):
        return from_tiles(mosaic(r, overlaps)).where(F.col("band") == band)
    return mosaic(r.where(F.col("band") == band), overlaps)


# ---------------------------------------------------------------- statistics

def raster_summary(r: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """count, sum, mean, population stddev, min, max and range of one band without nodata."""
    v = F.col("value")
    return _band(r, band, overlaps).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))


def value_count(r: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    return _band(r, band, overlaps).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def histogram(r: DataFrame, band: int = 1, bins: int = 10, lo: float = 0.0, hi: float = 1.0, overlaps: bool | None = None) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the top edge belongs to the last bin."""
    b = F.when(F.col("value") == hi, F.lit(bins)).otherwise(F.width_bucket("value", F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)))
    return _band(r, band, overlaps).where(F.col("value").between(lo, hi)).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(r: DataFrame, band: int = 1, qs: tuple = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int | None = None, overlaps: bool | None = None) -> DataFrame:
    """Quantiles of a band: exact by selection of ranks, or sketched with an ``accuracy``."""
    v = _band(r, band, overlaps).select("value")
    if not accuracy:
        return exact_quantiles(v, [], "value", qs)
    every = F.array(*[F.lit(float(q)) for q in qs])
    p = F.percentile_approx("value", every, F.lit(accuracy))
    return v.agg(p.alias("p")).select(F.posexplode(F.arrays_zip(every.alias("q"), F.col("p").alias("v"))).alias("i", "z")).select(F.col("z.q").alias("quantile"), F.col("z.v").alias("value"))


def pixel_centers(r: DataFrame) -> DataFrame:
    """Point layer of the pixel centres."""
    g = grid_of(r)
    r = from_tiles(r) if is_tiles(r) else r
    x, y = g.to_world(F.col("col") + 0.5, F.col("row") + 0.5)
    return set_srid(r.withColumn("geom", make_point(x, y)).withColumn("bbox", make_bbox(x, y, x, y)), g.srid)


def pixel_polygons(r: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """Box layer of the pixels of one band that hold data."""
    g = grid_of(r)
    x0, y0 = g.to_world(F.col("col"), F.col("row"))
    x1, y1 = g.to_world(F.col("col") + 1, F.col("row") + 1)
    c = (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    px = _pixels(r, band, overlaps).where(F.col("value").isNotNull())
    return set_srid(px.withColumn("geom", make_box(*c)).withColumn("bbox", make_bbox(*c)), g.srid)


def values_at(r: DataFrame, points: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """Value of the pixel under each point (NULL outside; the highest ``rid`` with data wins); an equi-join on the pixel."""
    g = grid_of(r)
    p = ensure_bbox(points)
    c, w = g.to_pixel(F.col("bbox.xmin"), F.col("bbox.ymin"))
    p = p.withColumn("col", F.floor(c).cast("int")).withColumn("row", F.floor(w).cast("int"))
    px = _pixels(r, band, overlaps).select("col", "row", "value")
    return p.join(px.hint("merge"), ["col", "row"], "left")


def _nearest(t: DataFrame, places: DataFrame, band: int) -> DataFrame:
    """(col, row, nearest) of every distinct place: the value of the nearest pixel with data (NULL in a raster without any); distances count in pixels, ties go
    to the upper, then the left pixel.

    Most places have data near by and find it in their cell's window. For the others, from a pixel with data one step along an axis leads nearer to any other
    place, so the nearest one has a side neighbour without data: only the rims of what holds data are searched, and strips along tile borders are all that the
    rims need."""
    from .aggregate import save_step
    from .joins import knn_join
    found = save_step(T.nearest(t, places.select("col", "row").distinct(), band), "nearest")
    bare, done = found.where("NOT sure"), found.where("sure").select("col", "row", "nearest")
    if bare.isEmpty():
        return done
    key = F.col("row").cast("long") * (1 << 31) + F.col("col")
    spot = make_point(F.col("col").cast("double"), F.col("row").cast("double"))
    b = T.to_pixels(T.rim(t, band)).where(F.col("value").isNotNull() & ~F.isnan("value")).select(key.alias("pixel"), "value", spot.alias("geom"))
    a = bare.select("col", "row", key.alias("place"), spot.alias("geom"))
    # the search looks at both sides several times, and rims are costly to find
    a, b = save_step(with_bbox(a), "places"), save_step(with_bbox(b), "rims")
    j = knn_join(a, b, 1, "place", "pixel").select(F.col("a_col").alias("col"), F.col("a_row").alias("row"), F.col("b_value").alias("nearest"))
    # places and neighbours may be many, whatever the size of their files says
    return done.unionByName(bare.select("col", "row").join(j.hint("merge"), ["col", "row"], "left"))


def nearest_values(r: DataFrame, points: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """``values_at``, with the value of the nearest pixel with data where the point's own pixel has none or lies outside (NULL for points without a
    place and in a raster without data)."""
    t = as_tiles(r, overlaps)
    own = values_at(t, points, band, False)
    bare = own.where(F.col("value").isNull() & F.col("col").isNotNull() & F.col("row").isNotNull())
    return own.join(_nearest(t, bare, band).hint("merge"), ["col", "row"], "left").withColumn("value", F.coalesce("value", "nearest")).drop("nearest")


def fill_nearest(r: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """(col, row, value) of every pixel of one band, gaps filled by the nearest pixel with data."""
    t = as_tiles(r, overlaps)
    px = T.to_pixels(t).where(F.col("band") == band).select("col", "row", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    gaps = px.where("value IS NULL").select("col", "row")
    return px.where("value IS NOT NULL").unionByName(_nearest(t, gaps, band).withColumnRenamed("nearest", "value"))


def pixels_of_value(r: DataFrame, values: list[float], band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """(value, col, row) of the pixels that hold one of the values."""
    return _pixels(r, band, overlaps).where(F.col("value").isin([float(v) for v in values])).select("value", "col", "row")


def dump_values(r: DataFrame, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """A band as rows of values: (row, col, values) per tile row, from its leftmost pixel."""
    t = as_tiles(r, overlaps)
    flat, w = F.get("bands", F.lit(band - 1)), F.col("width")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.struct((F.col("ty") + i).alias("row"), F.col("tx").alias("col"), F.slice(flat, i * w + 1, w).alias("values")))
    return t.where("width > 0 AND height > 0").select(F.explode(lines).alias("l")).select("l.*")


def zonal_stats(r: DataFrame, zones: DataFrame, zone_id: str, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """Statistics of the pixels whose centre lies in each zone (border included); zones meet tiles, not pixels."""
    return T.zonal_stats(as_tiles(r, overlaps), zones, zone_id, band)


def raster_profile(r: DataFrame) -> DataFrame:
    """Facts of a raster table in one pass."""
    g = grid_of(r)
    if is_tiles(r):
        gaps = F.aggregate(F.transform("bands", lambda b: F.size(F.filter(b, lambda v: v.isNull()))), F.lit(0), lambda x, y: x + y)
        size = F.col("width").cast("long") * F.col("height")
        out = r.agg(F.countDistinct("rid").alias("tiles"), F.max(F.size("bands")).cast("long").alias("bands"), F.sum(size * F.size("bands")).alias("pixels"), F.sum(gaps.cast("long")).alias("nodata"),
                    F.min("tx").alias("col_min"), F.max(F.col("tx") + F.col("width") - 1).alias("col_max"), F.min("ty").alias("row_min"), F.max(F.col("ty") + F.col("height") - 1).alias("row_max"))
    else:
        v = F.col("value")
        out = r.agg(F.countDistinct("rid").alias("tiles"), F.countDistinct("band").alias("bands"), F.count(F.lit(1)).alias("pixels"),
                    F.count_if(v.isNull()).alias("nodata"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.min("row").alias("row_min"), F.max("row").alias("row_max"))
    return out.select("*", F.lit(g.ulx).alias("ulx"), F.lit(g.uly).alias("uly"), F.lit(g.sx).alias("scale_x"), F.lit(g.sy).alias("scale_y"), F.lit(g.srid).cast("int").alias("srid"))


# The names of the constraints on a raster table.
CONSTRAINTS = ("srid", "scale_x", "scale_y", "blocksize_x", "blocksize_y", "same_alignment", "regular_blocking", "num_bands", "pixel_types", "nodata_values", "out_db", "extent")


def check_constraints(r: DataFrame, w: int, h: int, bands: int, srid: int | None = None, scale: tuple[float, float] | None = None, nodata: bool = True) -> DataFrame:
    """Whether each constraint holds. Tiles are at most w x h and start on multiples of that; regular blocking also asks that no two tiles share a place.

    ``scale`` is the wanted pixel size, ``nodata`` whether nodata may occur; without a wanted SRID or scale these hold."""
    g = grid_of(r)
    if is_tiles(r):
        tiles = tile_boxes(r).join(r.select(F.col("rid").alias("_rid"), F.size("bands").alias("nb"), F.exists("bands", lambda b: F.exists(b, lambda v: v.isNull())).alias("gap")), F.col("rid") == F.col("_rid"))
    else:
        tiles = r.groupBy("rid").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.countDistinct("band").alias("nb"), F.bool_or(F.col("value").isNull()).alias("gap"))
    on = (F.col("c0") % w == 0) & (F.col("r0") % h == 0)
    ok = tiles.agg(F.bool_and(F.col("c1") - F.col("c0") < w).alias("blocksize_x"), F.bool_and(F.col("r1") - F.col("r0") < h).alias("blocksize_y"), F.bool_and(on).alias("same_alignment"),
                   (F.bool_and(on) & (F.count_distinct("c0", "r0") == F.count(F.lit(1)))).alias("regular_blocking"), F.bool_and(F.col("nb") == bands).alias("num_bands"), (F.lit(nodata) | ~F.bool_or("gap")).alias("nodata_values"),
                   ((F.min("c0") >= 0) & (F.min("r0") >= 0) & (F.max("c1") < g.width) & (F.max("r1") < g.height)).alias("extent"))
    known = {"srid": srid is None or srid == g.srid, "scale_x": scale is None or scale[0] == g.sx, "scale_y": scale is None or scale[1] == g.sy, "pixel_types": True, "out_db": True}   # values are doubles, kept in the table
    ok = ok.withColumns({k: F.lit(v) for k, v in known.items()})
    return ok.select(F.expr(f"stack({len(CONSTRAINTS)}, " + ", ".join(f"'{c}', {c}" for c in CONSTRAINTS) + ") AS (rule, passed)"))


# ---------------------------------------------------------------- resampling

ALGORITHMS = ("NearestNeighbor", *T.KERNELS)


def _scaled(g: Grid, sx: float, sy: float) -> Grid:
    rx, ry = sx / abs(g.sx), sy / abs(g.sy)
    return replace(g, sx=math.copysign(sx, g.sx), sy=math.copysign(sy, g.sy), width=max(1, math.ceil(g.width / rx - 1e-9)), height=max(1, math.ceil(g.height / ry - 1e-9)))


def resample(r: DataFrame, scale: float = 100.0, algorithm: str = "NearestNeighbor", max_error: float = 0.125,
             overlaps: bool | None = None, tile: int | None = None) -> DataFrame:
    """Raster with square pixels of size ``scale``, without seams at tile edges.

    Weights are normalised over pixels with data; when shrinking, the kernel widens with the ratio.  Each source tile sends its weighted sums to the
    target tiles it reaches, all bands at once.  Coordinates are exact here, so ``max_error`` (0 .. 100) is accepted and never used up."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; choose from {ALGORITHMS}")
    if scale <= 0 or not 0 <= max_error <= 100:
        raise ValueError("scale must be positive and max_error between 0 and 100")
    out = _scaled(grid_of(r), scale, scale)
    t = T.resampled(as_tiles(r, overlaps), {0: out}, algorithm, tile or TILE).drop("level")
    return _back(r, T.stamp(t, out, True))


def overviews(r: DataFrame, levels: tuple[int, ...] = OVERVIEW_LEVELS, algorithm: str = "Lanczos", overlaps: bool | None = None) -> DataFrame:
    """Pyramid: one reduced raster per level asked for (a pixel at least), told apart by ``level`` (store it partitioned by level).

    All levels come from one pass over the tiles.  The grid in the metadata is that of the full raster; a level's pixel size is ``level`` times as large."""
    if not levels:
        raise ValueError("no level is asked for")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; choose from {ALGORITHMS}")
    g = grid_of(r)
    t = T.resampled(as_tiles(r, overlaps), {int(l): level_grid(g, l) for l in levels}, algorithm, TILE)
    return _back(r, T.stamp(t, g), g, ("level",))


def level_grid(g: Grid, level: int) -> Grid:
    return _scaled(g, abs(g.sx) * level, abs(g.sy) * level)


def overview_name(table: str, level: int) -> str:
    return f"o_{level}_{table}"


def reproject_raster(r: DataFrame, srid: int, overlaps: bool | None = None) -> DataFrame:
    """Nearest-neighbour warp: every target pixel reads the source pixel under its centre (``rid`` kept)."""
    g = grid_of(r)
    if g.srid is None:
        raise ValueError("the raster has no SRID; set it first")
    if g.srid == srid:
        return r
    spark = r.sparkSession
    # the extent of the target is that of the border, seen at every pixel's corner, and of a lattice inside; half a pixel more for what bends between
    border = spark.range(2 * (g.width + 1) + 2 * (g.height + 1)).select(F.col("id").alias("i"))
    across, i = g.width + 1, F.col("i")
    down = F.floor((i - 2 * across) / 2)
    border = border.select(F.when(i < 2 * across, F.floor(i / 2)).otherwise((i % 2) * g.width).cast("double").alias("c"), F.when(i < 2 * across, (i % 2) * g.height).otherwise(down).cast("double").alias("w"))
    lattice = border.unionByName(spark.range(441).select((F.col("id") % 21 / 20 * g.width).alias("c"), (F.floor(F.col("id") / 21) / 20 * g.height).alias("w")))
    x, y = transform_xy(*g.to_world(F.col("c"), F.col("w")), g.srid, srid)
    e = lattice.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    size = math.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]) / math.hypot(g.width, g.height)
    out_grid = Grid(e["x0"], e["y1"], size, -size, max(1, math.ceil((e["x1"] - e["x0"]) / size - 1e-9)), max(1, math.ceil((e["y1"] - e["y0"]) / size - 1e-9)), srid)
    n = out_grid.width * out_grid.height
    target = spark.range(n).select((F.col("id") % out_grid.width).alias("tc"), F.floor(F.col("id") / out_grid.width).alias("tr"))
    sx, sy = transform_xy(*out_grid.to_world(F.col("tc") + 0.5, F.col("tr") + 0.5), srid, g.srid)
    c, w = g.to_pixel(sx, sy)
    target = target.select("tc", "tr", F.floor(c).cast("int").alias("col"), F.floor(w).cast("int").alias("row"))
    target = target.where(F.col("col").between(0, g.width - 1) & F.col("row").between(0, g.height - 1))
    px = mosaic(r, overlaps)
    px = from_tiles(px) if is_tiles(px) else px
    out = _like(target.join(px, ["col", "row"]).select("rid", "band", F.col("tc").alias("col"), F.col("tr").alias("row"), "value"), out_grid)
    return T.from_pixels(out, out_grid) if is_tiles(r) else out


# ---------------------------------------------------------------- clip and burn

def extent_layer(r: DataFrame) -> DataFrame:
    """The raster's extent as a one-row box layer (as a clip mask)."""
    g = grid_of(r)
    x0, y0, x1, y1 = (F.lit(float(v)) for v in g.extent)
    one = r.sparkSession.range(1).select(make_box(x0, y0, x1, y1).alias("geom"), make_bbox(x0, y0, x1, y1).alias("bbox"))
    return set_srid(one, g.srid)


def raster_clip(r: DataFrame, mask: DataFrame, overlaps: bool | None = None) -> DataFrame:
    """The tiles that share area with the mask, with nodata where a pixel's centre is outside; ``rid`` stays.

    The mask is united per tile (cut to the tile first, in rounds), so each tile is tested against one geometry."""
    from .joins import intersection
    t = as_tiles(r, overlaps)
    g = T.grid_of(t)
    if g.srid is not None and srid_of(mask) not in (None, g.srid):
        mask = reproject(mask, g.srid)
    boxes = T.with_box(t).select("rid", "geom", "bbox")
    cut = intersection(set_srid(boxes, g.srid), mask.where(N.is_polygonal(F.col("geom"))), ["rid"]).where(N.is_polygonal(F.col("geom")))
    return _back(r, T.clip(t, merge_by_key(cut, ["rid"], "geom", union_many, union_one)))


def burn(layer: DataFrame, grid: Grid, value: str, order: str, band: int = 1, tiles: bool = False) -> DataFrame:
    """Raster from polygons: pixels whose centre is inside take ``value``; the highest ``order``, a number, wins. In pixel form only burned pixels have a row."""
    df = ensure_bbox(layer).where(N.is_polygonal(F.col("geom")))
    t = T.burn(df, grid, value, order, TILE)
    return t if tiles else _like(T.to_pixels(t).where(F.col("value").isNotNull()).withColumn("band", F.lit(band)), grid)


# ---------------------------------------------------------------- algebra

def map_algebra(r: DataFrame, expression: str, bands: tuple[int, ...]) -> DataFrame:
    """New one-band raster from an SQL expression over b1, b2, ..."""
    if is_tiles(r):
        return T.algebra(r, expression, bands)
    wide = r.where(F.col("band").isin(*bands)).groupBy("rid", "col", "row").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands])
    return _like(wide.withColumn("value", F.expr(expression)).withColumn("band", F.lit(1)), grid_of(r))


def reclass(r: DataFrame, ranges: list[tuple[float, float, float]], band: int = 1) -> DataFrame:
    """Map half-open value ranges [lo, hi) of one band to new values; the rest becomes nodata."""
    def new(v: Column) -> Column:
        out = F.lit(None).cast("double")
        for lo, hi, to in reversed(ranges):
            out = F.when((v >= lo) & (v < hi), F.lit(float(to))).otherwise(out)
        return out

    if is_tiles(r):
        return T.map_band(r, band, new)
    v = F.col("value")
    return _like(r.withColumn("value", F.when(F.col("band") == band, new(v)).otherwise(v)), grid_of(r))


def grayscale(r: DataFrame, red: int = 1, green: int = 2, blue: int = 3) -> DataFrame:
    """Luma of three bands."""
    # fixed values: ITU-R BT.601 luma weights
    return map_algebra(r, f"0.2989D * b{red} + 0.5870D * b{green} + 0.1140D * b{blue}", (red, green, blue))


def add_band(r: DataFrame, other: DataFrame, band: int) -> DataFrame:
    """Append a one-band raster on the same grid (tiles: in the same tiles) as band ``band``, the next one in tile form."""
    if is_tiles(r):
        more = other.select(F.col("rid").alias("_rid"), F.get("bands", F.lit(0)).alias("_b"))
        both = r.join(more, F.col("rid") == F.col("_rid"), "left").withColumn("bands", F.concat(F.slice("bands", 1, band - 1), F.array(F.coalesce("_b", F.transform(F.get("bands", F.lit(0)), lambda v: F.lit(None).cast("double"))))))
        return T.stamp(both.drop("_rid", "_b"), grid_of(r), T.is_flat(r))
    return _like(r.unionByName(other.withColumn("band", F.lit(band))), grid_of(r))


def drop_band(r: DataFrame, band: int) -> DataFrame:
    if is_tiles(r):
        return T.drop_band(r, band)
    rest = r.where(F.col("band") != band)
    return _like(rest.withColumn("band", F.when(F.col("band") > band, F.col("band") - 1).otherwise(F.col("band"))), grid_of(r))


# ---------------------------------------------------------------- neighbourhoods

FOCAL = ("count", "sum", "mean", "stddev", "min", "max", "range", "distinct", "invdist")


def focal(r: DataFrame, kind: str, radius: int = 1, band: int = 1, overlaps: bool | None = None) -> DataFrame:
    """Statistic over the (2 radius + 1) square window around each pixel; only strips along tile borders are shuffled."""
    if kind not in FOCAL:
        raise ValueError(f"unknown neighbourhood statistic {kind!r}")
    return _back(r, T.focal(as_tiles(r, overlaps), kind, radius, band))


TERRAIN = ("slope", "aspect", "hillshade", "roughness", "tpi", "tri")


def terrain(r: DataFrame, kind: str, band: int = 1, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0,
            overlaps: bool | None = None) -> DataFrame:
    """3 x 3 terrain measures (Horn weights); NULL where the pixel or a neighbour is missing.

    slope and aspect in degrees (aspect clockwise from north, NULL on flat ground), hillshade 0 .. 255."""
    if kind not in TERRAIN:
        raise ValueError(f"unknown terrain measure {kind!r}")
    return _back(r, T.terrain(as_tiles(r, overlaps), kind, band, azimuth, altitude, z_factor))


# ---------------------------------------------------------------- georeference

def georeference(r: DataFrame) -> DataFrame:
    """World position of the corner and centre of every pixel, with scale and skew."""
    g = grid_of(r)
    r = from_tiles(r) if is_tiles(r) else r
    x, y = g.to_world(F.col("col"), F.col("row"))
    cx, cy = g.to_world(F.col("col") + 0.5, F.col("row") + 0.5)
    return r.select("rid", "band", "col", "row", "value", x.alias("ulx"), y.alias("uly"), cx.alias("cx"), cy.alias("cy"),
                    F.lit(g.sx).alias("scale_x"), F.lit(g.sy).alias("scale_y"), F.lit(0.0).alias("skew_x"), F.lit(0.0).alias("skew_y"))


def set_georeference(r: DataFrame, ulx: float | None = None, uly: float | None = None, scale: float | None = None, srid: int | None = None) -> DataFrame:
    g = grid_of(r)
    new = replace(g, ulx=g.ulx if ulx is None else float(ulx), uly=g.uly if uly is None else float(uly), srid=g.srid if srid is None else srid)
    if scale is not None:
        new = replace(new, sx=math.copysign(scale, g.sx), sy=math.copysign(scale, g.sy))
    return T.stamp(r, new, T.is_flat(r)) if is_tiles(r) else stamp_grid(r, new)
