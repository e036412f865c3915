"""Reading and writing vector layers as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact as X, native as N
from ..layer import add_geometry_column, attribute_columns, is_geometry, make_point, set_srid, srid_of, with_bbox
from ..operators.transform import force_multi, force_single, reproject
from .tables import clean_name, save_table

UNSUPPORTED = ("shp", "gpkg", "dbf", "xml", "gml", "kml")
CURVES = ("CIRCULARSTRING", "COMPOUNDCURVE", "CURVEPOLYGON", "MULTICURVE", "MULTISURFACE")


def rename_id(df: DataFrame) -> DataFrame:
    """A column called id (any case) becomes old_ + its name, so that a new key can be added."""
    return df.withColumnsRenamed({c: "old_" + c for c in df.columns if c.lower() == "id"})


def read_layer(spark: SparkSession, path: str, format: str = "parquet", geom: str | None = None, encoding_of_geom: str = "wkt",
               x: str | None = None, y: str | None = None, srid: int | None = None, **options) -> DataFrame:
    """Layer from Parquet, ORC, CSV, JSON or GeoJSON files.

    ``geom`` names a column with WKT, WKB or GeoJSON text (``encoding_of_geom``);
    ``x`` and ``y`` name point coordinates.  A stored layer keeps its geometry and
    SRID.  format 'geojson' reads feature collections, 'geojsonl' one feature per
    line (which splits over tasks)."""
    if format in UNSUPPORTED:
        raise ValueError(f"format {format!r} needs an external reader; convert it to Parquet, CSV or GeoJSON first")
    if format in ("geojson", "geojsonl"):
        return set_srid(_read_geojson(spark, path, format == "geojsonl", options), srid or 4326)
    reader = spark.read.options(**options)
    df = reader.format(format).load(path)
    return decode_geometry(df, geom, encoding_of_geom, x, y, srid)


def decode_geometry(df: DataFrame, geom: str | None, encoding: str = "wkt", x: str | None = None, y: str | None = None, srid: int | None = None) -> DataFrame:
    if geom:
        col = F.col(geom)
        g = {"wkt": N.from_wkt, "geojson": N.from_geojson, "wkb": X.from_wkb}[encoding](col)
        df = df.withColumn("geom", g) if geom == "geom" else df.withColumn("geom", g).drop(geom)
    elif x and y:
        df = df.withColumn("geom", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), make_point(x, y)))
    if "geom" in df.columns and any(f.name == "geom" and is_geometry(f) for f in df.schema.fields):
        if "bbox" not in df.columns:
            df = with_bbox(df)
        df = set_srid(df, srid)
    return df


def _read_geojson(spark, path, lines, options):
    feature = "struct<type:string,geometry:string,properties:map<string,string>>"
    if lines:
        df = spark.read.options(**options).schema("type string, geometry string, properties map<string,string>").json(path)
    else:
        df = (spark.read.options(multiLine=True, **options).schema(f"type string, features array<{feature}>").json(path)
              .select(F.explode("features").alias("f")).select("f.geometry", "f.properties"))
    return with_bbox(df.select("properties", N.from_geojson(F.col("geometry")).alias("geom")))


def spread_properties(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """GeoJSON properties as typed columns (``fields`` maps name to Spark type)."""
    cols = [F.try_element_at("properties", F.lit(n)).cast(t).alias(n) for n, t in fields.items()]
    return set_srid(df.select(*cols, "geom", "bbox"), srid_of(df))


def normalize_layer(df: DataFrame, geom: str = "geom", lowercase: bool = True, drop_length: bool = True, force_singlepart: bool = False,
                    pk: str | None = "id") -> DataFrame:
    """Import options: lower-case names, geometry called geom, no length limits, single parts, a fresh key."""
    srid = srid_of(df, geom)
    if geom != "geom":
        df = df.withColumnRenamed(geom, "geom")
    if pk and pk.lower() == "id":
        df = rename_id(df)
    if lowercase:
        df = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    if drop_length:
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() in ("char", "varchar", "string") else F.col(f"`{f.name}`")
                         for f in df.schema.fields])
    df = set_srid(with_bbox(df), srid)
    if force_singlepart:
        df = force_single(df)
    if pk:
        df = df.withColumn(pk, F.monotonically_increasing_id() + 1).select(pk, *[c for c in df.columns if c != pk])
    return set_srid(df, srid)


def import_layer(df: DataFrame, table: str, database: str = "default", pk: str | None = "id", geom: str = "geom", source_srid: int | None = None,
                 target_srid: int | None = None, where: str | None = None, singlepart: bool = False, overwrite: bool = False,
                 comment: str | None = None) -> str:
    """Write a layer to a table with the import options; returns the table name."""
    if where:
        df = df.where(where)
    df = set_srid(df, source_srid, geom)
    df = normalize_layer(df, geom, force_singlepart=singlepart, pk=pk)
    if target_srid is not None and srid_of(df) is not None:
        df = reproject(df, target_srid)
    name = save_table(df, table, database, overwrite)
    if comment:
        df.sparkSession.sql(f"COMMENT ON TABLE {name} IS '{comment.replace(chr(39), chr(39) * 2)}'")
    return name


def export_layer(df: DataFrame, path: str, format: str = "parquet", source_srid: int | None = None, target_srid: int | None = None,
                 overwrite: bool = False, encoding: str = "UTF-8", encode_geom: str | None = None, **options) -> None:
    """Write a layer to files, optionally in another SRID.

    Parquet and ORC keep the geometry struct (or WKB with encode_geom='wkb'); CSV
    writes WKT, JSON writes WKT or GeoJSON, geojsonl writes one feature per line."""
    df = set_srid(df, source_srid)
    if target_srid is not None and srid_of(df) != target_srid:
        df = reproject(df, target_srid)
    mode = "overwrite" if overwrite else "errorifexists"
    attrs, g = attribute_columns(df), F.col("geom")
    if format == "geojsonl":
        props = F.to_json(F.struct(*attrs)) if attrs else F.lit("{}")
        line = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(N.as_geojson(g), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))
        df.select(line.alias("value")).write.mode(mode).options(encoding=encoding, **options).text(path)
        return
    encode_geom = encode_geom or {"csv": "wkt", "json": "wkt"}.get(format)
    if encode_geom:
        text = {"wkt": N.as_wkt, "wkb": X.as_wkb, "geojson": N.as_geojson}[encode_geom](g)
        df = df.select(*attrs, text.alias("geom"))
    if format in ("csv", "json"):
        options = {"encoding": encoding, **options}
    if format == "csv":
        options = {"header": True, **options}
    df.write.mode(mode).format(format).options(**options).save(path)


__all__ = ["read_layer", "decode_geometry", "normalize_layer", "rename_id", "import_layer", "export_layer", "spread_properties",
           "add_geometry_column", "clean_name", "force_multi"]
