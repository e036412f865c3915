"""Inventories and profiles of tables and layers."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import native as N
from ..layer import attribute_columns, ensure_bbox, geometry_columns, is_bbox, is_geometry, srid_of
from .aggregate import bad_estimate

def kind_of(schema) -> str:
    names = schema.fieldNames()
    if any(is_geometry(f) for f in schema.fields):
        return "vector"
    return "raster" if {"rid", "bands"} <= set(names) or {"rid", "band", "col", "row", "value"} <= set(names) else "table"


def catalog(spark: SparkSession, database: str | None = None, rows: bool = False, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Tables and views (without the hidden names) with kind, geometry column, SRID and view flag, by name."""
    out = []
    for t in spark.catalog.listTables(database):
        db = t.namespace[0] if t.namespace else None
        if t.name in hidden:
            continue
        df = spark.table(f"`{db}`.`{t.name}`" if db else f"`{t.name}`")
        geoms = geometry_columns(df)
        g = geoms[0] if geoms else None
        out.append((db, t.name, kind_of(df.schema), g, srid_of(df, g) if g else None, 2 if g else None,
                    t.tableType in ("VIEW", "TEMPORARY"), len(df.columns), df.count() if rows else None))
    schema = "database string, name string, kind string, geometry_column string, srid int, dimension int, is_view boolean, n_columns int, n_rows long"
    return spark.createDataFrame(out, schema).orderBy("name")


def describe_columns(df: DataFrame) -> DataFrame:
    """Per attribute: position, type, NULL and distinct counts, extremes as text - one pass over the data."""
    cols = attribute_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = [c for c in cols if types[c].typeName() not in ("array", "map", "struct", "binary", "variant")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"c{i}")]
        aggs += [F.approx_count_distinct(q).alias(f"d{i}"), F.min(q).cast("string").alias(f"a{i}"), F.max(q).cast("string").alias(f"b{i}")] if c in plain else []
    one = df.agg(*aggs)
    null = F.lit(None)
    rows = [F.struct(F.lit(i + 1).alias("num"), F.lit(c).alias("name"), F.lit(types[c].simpleString()).alias("type"),
                     (F.col("n") - F.col(f"c{i}")).alias("nulls"),
                     (F.col(f"d{i}") if c in plain else null.cast("long")).alias("approx_distinct"),
                     (F.col(f"a{i}") if c in plain else null.cast("string")).alias("min"), (F.col(f"b{i}") if c in plain else null.cast("string")).alias("max"))
            for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe_layer(df: DataFrame, key: str | None = None, estimated_rows: int | None = None) -> DataFrame:
    """One row: counts, geometry types, SRID, extent and warnings."""
    geoms = geometry_columns(df)
    out = [F.count(F.lit(1)).alias("n_rows")]
    if geoms:
        df = ensure_bbox(df, geoms[0])
        g = F.col(geoms[0])
        b = F.col("bbox")
        out += [F.count(g).alias("n_geometries"), F.count_if(N.is_empty(g)).alias("n_empty"),
                F.array_join(F.sort_array(F.collect_set(g["gtype"])), ",").alias("types"),
                F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax")]
    if key:
        out += [F.count(key).alias("_k"), F.count_distinct(key).alias("_kd")]
    res = df.agg(*out)
    warn = []
    if key is None:
        warn.append(F.lit("no key column"))
    else:
        warn += [F.when(F.col("_k") < F.col("n_rows"), "the key has NULLs"), F.when(F.col("_kd") < F.col("_k"), "the key repeats")]
    if not geoms:
        warn.append(F.lit("no geometry column"))
    else:
        warn.append(F.lit("no SRID") if srid_of(df, geoms[0]) is None else F.lit(None).cast("string"))
        warn.append(F.when(F.col("n_geometries") < F.col("n_rows"), "some geometries are NULL"))
    if estimated_rows is not None:
        warn.append(F.when(bad_estimate(F.col("n_rows"), F.lit(estimated_rows)), "the row estimate is off"))
    res = res.withColumn("srid", F.lit(srid_of(df, geoms[0]) if geoms else None).cast("int")).withColumn("warnings", F.concat_ws("; ", *warn))
    return res.drop("_k", "_kd")


def unique_columns(df: DataFrame) -> DataFrame:
    """Attributes that could serve as a key: no NULLs and no repeats.

    A sketch rules most columns out in one pass; only the rest is checked exactly."""
    cols = [f.name for f in df.schema.fields if not is_geometry(f) and not is_bbox(f) and f.dataType.typeName() not in ("map", "variant")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)],
                 *[F.approx_count_distinct(f"`{c}`", 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    n = row["n"]
    maybe = [c for i, c in enumerate(cols) if n and row[f"c{i}"] == n and row[f"d{i}"] >= 0.9 * n]
    out = df.sparkSession.createDataFrame([], "name string, n long")
    for c in maybe:
        per = df.groupBy(F.col(f"`{c}`")).agg(F.count(F.lit(1)).alias("k"))
        out = out.unionByName(per.agg(F.max("k").alias("m"), F.sum("k").alias("n")).where("m = 1").select(F.lit(c).alias("name"), "n"))
    return out


# ---------------------------------------------------------------- query log, saved queries

LOG_KEEP = 20  # fixed value: entries shown of the query log


def run_logged(spark: SparkSession, sql: str, log_table: str) -> DataFrame:
    """Run a query to the end, append text, rows and seconds to the log, return the query."""
    df = spark.sql(sql)
    start = time.time()
    n = df.count()
    entry = [(datetime.now(timezone.utc).replace(tzinfo=None), sql, n, time.time() - start)]
    spark.createDataFrame(entry, "at timestamp, query string, n_rows long, seconds double").write.mode("append").saveAsTable(log_table)
    return df


def query_log(spark: SparkSession, log_table: str, keep: int = LOG_KEEP) -> DataFrame:
    return spark.table(log_table).orderBy(F.desc("at")).limit(keep)


def save_query(spark: SparkSession, table: str, name: str, sql: str) -> None:
    """Store a named query; the latest entry of a name counts."""
    spark.createDataFrame([(name, sql, False, time.time())], "name string, query string, deleted boolean, at double").write.mode("append").saveAsTable(table)


def delete_query(spark: SparkSession, table: str, name: str) -> None:
    spark.createDataFrame([(name, None, True, time.time())], "name string, query string, deleted boolean, at double").write.mode("append").saveAsTable(table)


def saved_queries(spark: SparkSession, table: str) -> DataFrame:
    last = spark.table(table).groupBy("name").agg(F.max_by(F.struct("query", "deleted"), "at").alias("v"))
    return last.where(~F.col("v.deleted")).select("name", "v.query")


def load_query(spark: SparkSession, table: str, name: str) -> DataFrame:
    row = saved_queries(spark, table).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return spark.sql(row["query"])
