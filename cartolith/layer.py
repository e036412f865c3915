"""The layer data model.

A vector layer is a DataFrame with a ``geom`` struct, a ``bbox`` struct and any
attributes.  Every geometry type shares one nesting (parts -> rings ->
vertices), so most geometry work is a higher-order column expression.
The SRID travels in the metadata of the geometry column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

VERTEX = "struct<x:double,y:double>"
RING = f"array<{VERTEX}>"
PARTS = f"array<array<{RING}>>"
GEOM = f"struct<gtype:string,parts:{PARTS}>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

POLYGONAL = ("POLYGON", "MULTIPOLYGON")
LINEAR = ("LINESTRING", "MULTILINESTRING")
PUNTAL = ("POINT", "MULTIPOINT")


class SridError(ValueError):
    """Two layers carry different SRIDs, or an SRID is not supported."""


def is_geometry(field: T.StructField) -> bool:
    t = field.dataType
    return isinstance(t, T.StructType) and t.fieldNames() == ["gtype", "parts"]


def is_bbox(field: T.StructField) -> bool:
    t = field.dataType
    return isinstance(t, T.StructType) and t.fieldNames() == ["xmin", "ymin", "xmax", "ymax"]


def geometry_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_geometry(f)]


def attribute_columns(df: DataFrame) -> list[str]:
    """All columns that are neither a geometry nor a bounding box, in order."""
    return [f.name for f in df.schema.fields if not is_geometry(f) and not is_bbox(f)]


def srid_of(df: DataFrame, geom: str = "geom") -> int | None:
    return df.schema[geom].metadata.get("srid")


def set_srid(df: DataFrame, srid: int | None, geom: str = "geom") -> DataFrame:
    """Stamp the SRID; coordinates do not change and ``None`` is a no-op."""
    if srid is None:
        return df
    return df.withMetadata(geom, {**df.schema[geom].metadata, "srid": int(srid)})


def check_srids(*layers: DataFrame) -> int | None:
    """The common SRID of the layers; raises when two known SRIDs differ."""
    known = {s for s in (srid_of(d) for d in layers) if s is not None}
    if len(known) > 1:
        raise SridError(f"layers have different SRIDs: {sorted(known)}")
    return known.pop() if known else None


def vertex(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"),
                    F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def geometry(gtype, parts: Column) -> Column:
    g = F.lit(gtype) if isinstance(gtype, str) else gtype
    return F.struct(g.alias("gtype"), parts.alias("parts"))


def empty(gtype="POLYGON") -> Column:
    return geometry(gtype, F.array().cast(PARTS))


def make_point(x, y) -> Column:
    return geometry("POINT", F.array(F.array(F.array(vertex(x, y)))))


def make_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Counter-clockwise axis-aligned rectangle."""
    ring = F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin))
    return geometry("POLYGON", F.array(F.array(ring)))


def make_line(vertices: Column) -> Column:
    """Line from an array of vertices that is already in order."""
    return geometry("LINESTRING", F.array(F.array(vertices)))


def make_polygon(ring: Column) -> Column:
    """Polygon from a ring; the ring is closed when its ends differ."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = F.when(first == last, ring).otherwise(F.concat(ring, F.array(first)))
    return geometry("POLYGON", F.array(F.array(closed)))


def make_bbox(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.cast("double").alias("xmin"), ymin.cast("double").alias("ymin"),
                    xmax.cast("double").alias("xmax"), ymax.cast("double").alias("ymax"))


def bbox_of(geom: Column) -> Column:
    """Bounding box of a geometry; NULL for NULL and for empty geometries."""
    v = F.flatten(F.flatten(geom["parts"]))
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    box = make_bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(geom["parts"]) > 0, box)


def with_bbox(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Recompute the ``bbox`` column from the geometry."""
    return df.withColumn("bbox", bbox_of(F.col(geom)))


def ensure_bbox(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df if "bbox" in df.columns else with_bbox(df, geom)


def as_layer(df: DataFrame, geom: Column, srid: int | None = None, bbox: Column | None = None) -> DataFrame:
    """Add ``geom`` and ``bbox`` to a table and stamp the SRID."""
    df = df.withColumn("geom", geom)
    df = df.withColumn("bbox", bbox if bbox is not None else bbox_of(F.col("geom")))
    return set_srid(df, srid)


def add_geometry_column(df: DataFrame, name: str, gtype: str, srid: int, x: str | None = None, y: str | None = None,
                        dim: int = 2) -> DataFrame:
    """Add a geometry column; filled from ``x``/``y`` for points, NULL otherwise."""
    if dim != 2:
        raise ValueError("only two-dimensional geometry is supported")
    g = make_point(x, y) if x and y and gtype.upper() == "POINT" else F.lit(None).cast(GEOM)
    return set_srid(df.withColumn(name, g), srid, name)
