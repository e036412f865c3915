"""Row transforms of layers: buffer, repair, reproject, edit, dump, measure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact as X, native as N
from ..layer import PARTS, SridError, attribute_columns, bbox_of, ensure_bbox, geometry, make_bbox, set_srid, srid_of, with_bbox


def _replace(df: DataFrame, geom: Column, srid: int | None = None) -> DataFrame:
    """Swap the geometry, refresh the box and keep (or set) the SRID."""
    known = srid_of(df) if srid is None else srid
    return set_srid(with_bbox(df.withColumn("geom", geom)), known)


def where_selected(df: DataFrame, where: str | Column | None) -> DataFrame:
    """Subset filter of a layer; ``None`` keeps everything."""
    return df if where is None else df.where(where)


def buffer(df: DataFrame, distance: float = 10.0, cols: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """Round buffer in layer units (8 segments per quarter circle)."""
    df = ensure_bbox(where_selected(df, where))
    keep = attribute_columns(df) if cols is None else list(cols)
    box, d = F.col("bbox"), float(distance)
    grown = F.when(box.isNotNull(), make_bbox(box["xmin"] - d, box["ymin"] - d, box["xmax"] + d, box["ymax"] + d))
    out = df.select(*keep, X.buffer(F.col("geom"), d, box).alias("geom"), grown.alias("bbox"))
    if d <= 0:
        out = with_bbox(out)
    return set_srid(out, srid_of(df))


def make_valid(df: DataFrame, method: str = "ST_Buffer") -> DataFrame:
    """Repair polygons: ``ST_Buffer`` grows by 0.001 and shrinks back, ``ST_MakeValid`` keeps
    areas that are covered an odd number of times.  Rows and attributes stay."""
    if method not in ("ST_Buffer", "ST_MakeValid"):
        raise ValueError(f"unknown repair method {method!r}")
    polygons = N.is_polygonal(F.col("geom"))
    target = F.when(polygons, F.col("geom"))
    fixed = X.grow_and_shrink(target) if method == "ST_Buffer" else X.make_valid(target)
    return _replace(df, F.when(polygons, fixed).otherwise(F.col("geom")))


def with_validity(df: DataFrame) -> DataFrame:
    reason = X.valid_reason(F.col("geom"))
    return df.withColumn("valid_reason", reason).withColumn("is_valid", F.col("valid_reason") == "Valid Geometry")


# ---------------------------------------------------------------- single / multi

def force_single(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per part.  Empty geometries vanish unless ``keep_empty``."""
    parts = F.explode_outer if keep_empty else F.explode
    cols = df.columns
    g = F.col("geom")
    out = df.withColumn("_part", parts(g["parts"]))
    one = geometry(N.single_type(g), F.when(F.col("_part").isNotNull(), F.array("_part")).otherwise(F.array().cast(PARTS)))
    return set_srid(with_bbox(out.withColumn("geom", one).drop("_part")).select(*cols), srid_of(df))


def force_multi(df: DataFrame) -> DataFrame:
    return set_srid(df.withColumn("geom", N.to_multi(F.col("geom"))).select(*df.columns), srid_of(df))


# ---------------------------------------------------------------- reprojection

EARTH_A = 6378137.0                  # fixed values: WGS 84 semi-major axis and flattening
EARTH_F = 1 / 298.257223563


def _mercator(x, y):
    # column form of the spherical Mercator formulas
    return F.radians(x) * EARTH_A, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * EARTH_A


def _unmercator(x, y):
    return F.degrees(x / EARTH_A), F.degrees(2 * F.atan(F.exp(y / EARTH_A)) - math.pi / 2)


def _utm_zone(srid: int) -> tuple[int, bool] | None:
    if 32601 <= srid <= 32660:
        return srid - 32600, True
    if 32701 <= srid <= 32760:
        return srid - 32700, False
    return None


# Transverse Mercator by the Krueger series in the third flattening n (order 4).
_N = EARTH_F / (2 - EARTH_F)
_RECT = EARTH_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N ** 2 + 5 / 16 * _N ** 3 + 41 / 180 * _N ** 4,
          13 / 48 * _N ** 2 - 3 / 5 * _N ** 3 + 557 / 1440 * _N ** 4,
          61 / 240 * _N ** 3 - 103 / 140 * _N ** 4, 49561 / 161280 * _N ** 4)
_BETA = (_N / 2 - 2 / 3 * _N ** 2 + 37 / 96 * _N ** 3 - 1 / 360 * _N ** 4,
         1 / 48 * _N ** 2 + 1 / 15 * _N ** 3 - 437 / 1440 * _N ** 4,
         17 / 480 * _N ** 3 - 37 / 840 * _N ** 4, 4397 / 161280 * _N ** 4)
_DELTA = (2 * _N - 2 / 3 * _N ** 2 - 2 * _N ** 3 + 116 / 45 * _N ** 4,
          7 / 3 * _N ** 2 - 8 / 5 * _N ** 3 - 227 / 45 * _N ** 4,
          56 / 15 * _N ** 3 - 136 / 35 * _N ** 4, 4279 / 630 * _N ** 4)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0


def _to_utm(zone, north):
    lon0, ecc = math.radians(6 * zone - 183), 2 * math.sqrt(_N) / (1 + _N)

    def fn(x, y):
        lat, lon = F.radians(y), F.radians(x) - lon0
        s = F.sin(lat)
        t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
        xi0, eta0 = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
        xi, eta = xi0, eta0
        for j, a in enumerate(_ALPHA, 1):
            xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        return UTM_EAST + UTM_SCALE * _RECT * eta, (0.0 if north else UTM_SOUTH) + UTM_SCALE * _RECT * xi

    return fn


def _from_utm(zone, north):
    lon0 = 6 * zone - 183

    def fn(x, y):
        xi0 = (y - (0.0 if north else UTM_SOUTH)) / (UTM_SCALE * _RECT)
        eta0 = (x - UTM_EAST) / (UTM_SCALE * _RECT)
        xi, eta = xi0, eta0
        for j, b in enumerate(_BETA, 1):
            xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)

    return fn


def _step(srid: int, forward: bool):
    """Coordinate function to (forward) or from longitude / latitude."""
    if srid == 4326:
        return lambda x, y: (x, y)
    if srid == 3857:
        return _mercator if forward else _unmercator
    zone = _utm_zone(srid)
    if zone:
        return (_to_utm if forward else _from_utm)(*zone)
    raise SridError(f"SRID {srid} is not supported (4326, 3857 and UTM zones 326xx / 327xx are)")


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    if source == target:
        return x, y
    return _step(target, True)(*_step(source, False)(x, y))


def reproject(df: DataFrame, srid: int, source: int | None = None) -> DataFrame:
    """Transform the coordinates of a layer."""
    source = srid_of(df) if source is None else source
    if source is None:
        raise SridError("the layer has no SRID; set it first")
    if source == srid:
        return df
    _step(source, False), _step(srid, True)
    # the lambdas of the steps are shared by both coordinates of a vertex
    return _replace(df, N.map_vertices(F.col("geom"), lambda x, y: transform_xy(x, y, source, srid)), srid)


# ---------------------------------------------------------------- measures

METRICS = {
    "area": N.area, "length": N.length, "perimeter": N.perimeter, "centroid": N.centroid, "envelope": N.envelope,
    "n_points": N.n_points, "n_parts": N.n_parts, "n_rings": N.n_rings, "n_interior_rings": N.n_interior_rings,
    "x": N.point_x, "y": N.point_y, "start_point": N.start_point, "end_point": N.end_point,
    "is_empty": N.is_empty, "is_closed": N.is_closed, "dimension": N.dimension, "gtype": N.geometry_type,
    "exterior_ring": N.exterior_ring, "wkt": N.as_wkt, "geojson": N.as_geojson,
    "xmin": lambda g: bbox_of(g)["xmin"], "ymin": lambda g: bbox_of(g)["ymin"],
    "xmax": lambda g: bbox_of(g)["xmax"], "ymax": lambda g: bbox_of(g)["ymax"],
    "valid_reason": X.valid_reason, "is_valid": X.is_valid, "surface_point": X.point_on_surface,
    "convex_hull": X.convex_hull, "wkb": X.as_wkb,
    "is_simple": lambda g: F.when(N.is_polygonal(g), F.lit(True)).otherwise(
        F.when(N.is_puntal(g), F.size(F.array_distinct(N.vertices(g))) == F.size(N.vertices(g))).otherwise(_simple_line(g))),
    "is_ring": lambda g: (g["gtype"] == "LINESTRING") & N.is_closed(g) & _simple_line(g),
    "azimuth": lambda g: N.azimuth(N.vertices(g)[0]["x"], N.vertices(g)[0]["y"],
                                   F.element_at(N.vertices(g), -1)["x"], F.element_at(N.vertices(g), -1)["y"]),
}


def _simple_line(g: Column) -> Column:
    """A line is simple when noding it adds no vertex visit: its dissolved form is one chain of equal length."""
    line = F.when(N.is_linear(g), g)
    merged = X.self_union(line)
    return F.when(N.is_linear(g), (F.size(merged["parts"]) == F.size(g["parts"])) & (F.abs(N.length(merged) - N.length(g)) <= 1e-9 * N.length(g)))


def with_metrics(df: DataFrame, *names: str, geom: str = "geom") -> DataFrame:
    """Add the named measures as columns in one pass."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown measures {unknown}; choose from {sorted(METRICS)}")
    return df.withColumns({n: METRICS[n](F.col(geom)) for n in names})


# ---------------------------------------------------------------- edits

EDITS = {"translate": N.translate, "scale": N.scale, "rotate": N.rotate, "affine": N.affine, "snap_to_grid": N.snap_to_grid,
         "reverse": N.reverse, "force_2d": N.force_2d, "segmentize": N.segmentize, "shift_longitude": N.shift_longitude,
         "add_point": N.add_point, "set_point": N.set_point, "remove_point": N.remove_point}


def edit(df: DataFrame, name: str, *args) -> DataFrame:
    """Apply one vertex edit to the geometry of every row."""
    return _replace(df, EDITS[name](F.col("geom"), *args))


def simplify(df: DataFrame, tolerance: float, preserve: bool = False) -> DataFrame:
    return _replace(df, X.simplify(F.col("geom"), tolerance, preserve))


# ---------------------------------------------------------------- dump

DUMPS = {"parts": N.dump_parts, "rings": N.dump_rings, "points": N.dump_points, "segments": N.dump_segments}


def dump(df: DataFrame, what: str = "parts") -> DataFrame:
    """One row per part, ring, vertex or segment, numbered from 1 in ``path``."""
    cols = attribute_columns(df)
    out = df.select(*cols, F.posexplode(DUMPS[what](F.col("geom"))).alias("path", "geom")).withColumn("path", F.col("path") + 1)
    return set_srid(with_bbox(out), srid_of(df))
