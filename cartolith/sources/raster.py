"""Reading and writing rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import tiles as T
from ..operators.raster import TILE, Grid, _like, as_tiles, from_tiles, grid_of, level_grid, must_tile, overviews, retile, stamp_grid, to_tiles


def read_raster(spark: SparkSession, path: str, srid: int | None = None, tiles: bool = False) -> DataFrame:
    """Raster stored as pixels or as tiles in Parquet, in pixel form unless ``tiles``; the SRID is taken from the file or given."""
    df = spark.read.parquet(path)
    stored = T.is_tiles(df)
    g = grid_of(df)
    if g.srid is None and srid is None:
        raise ValueError("the raster has no SRID; pass srid=")
    g = g if srid is None else Grid(g.ulx, g.uly, g.sx, g.sy, g.width, g.height, srid)
    df = T.stamp(df, g, T.is_flat(df)) if stored else stamp_grid(df, g)
    if tiles:
        return df if stored else T.from_pixels(df, g)
    return from_tiles(df) if stored else df


def read_ascii_grid(spark: SparkSession, path: str, srid: int | None = None) -> DataFrame:
    """ESRI ASCII grid (one text file, one band): six header lines, then rows of values."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("i", F.monotonically_increasing_id())
    words = F.split(F.trim("value"), r"\s+")
    is_head = F.trim("value").rlike("^[A-Za-z]")
    head = {r["k"]: float(r["v"]) for r in lines.where(is_head).select(F.lower(words[0]).alias("k"), words[1].alias("v")).limit(10).collect()}
    w, h, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    x0 = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    y0 = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    # ids rise within a partition by one and between partitions in file order, so rows get their numbers by rank of the partition
    body = lines.where(~is_head).select("i", words.alias("w"))
    part, local = F.shiftright("i", 33), F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    per = body.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(local).alias("first"))
    from pyspark.sql import Window
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per input partition
    rows = body.withColumn("p", part).withColumn("l", local).join(F.broadcast(per), "p")
    rows = rows.select((F.col("before") + F.col("l") - F.col("first")).alias("row"), "w")
    px = rows.select("row", F.posexplode("w").alias("col", "t")).withColumn("v", F.col("t").cast("double"))
    nodata = head.get("nodata_value")
    value = F.col("v") if nodata is None else F.when(F.col("v") != nodata, F.col("v"))
    grid = Grid(x0, y0 + h * size, size, -size, w, h, srid)
    return _like(px.select(F.lit(1).alias("rid"), F.lit(1).alias("band"), "col", "row", value.alias("value")), grid)


def import_raster(r: DataFrame, path: str, tiled: bool = True, w: int = TILE, h: int = TILE, levels: tuple[int, ...] = (), overwrite: bool = False) -> None:
    """Store a raster as tiles, with overview levels beside it, one folder per level (0 = full).

    ``tiled=False`` asks for one tile; from 100 MiB on a raster is tiled all the same."""
    g = grid_of(r)
    t = as_tiles(r)
    bands = t.agg(F.max(F.size("bands")).alias("n")).first()["n"]
    tiled = tiled or must_tile(g, bands)
    mode = "overwrite" if overwrite else "errorifexists"
    to_tiles(retile(t, w, h) if tiled else retile(t, g.width, g.height)).write.mode(mode).parquet(f"{path}/level=0")
    for level in levels:
        one = T.stamp(overviews(t, (level,), overlaps=False).drop("level"), level_grid(g, level), True)
        to_tiles(retile(one, w, h)).write.mode(mode).parquet(f"{path}/level={level}")
