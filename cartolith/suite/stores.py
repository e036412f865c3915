"""Queries through tables, views and files: what is saved, changed, listed and run again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import table as t
from ..layer import set_srid
from ..operators import profile as PR, tables as T
from ..operators.aggregate import checkpoint_dir
from ..sources import stored as SI, tables as ST, vector as SV
from .registry import query

DATABASE = "cartolith_suite"


def _own(spark, name: str) -> str:
    """A table name that no other run has."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    return f"{name}_{uuid.uuid4().hex}"


@query("saved_table", """SELECT step, c_mktsegment, count(*) AS n, 'Sitesof2024' AS name FROM customer, (SELECT unnest(['first', 'kept', 'replaced']) AS step)
    WHERE CASE WHEN step = 'replaced' THEN c_acctbal >= 1000 ELSE c_acctbal < 1000 END GROUP BY 1, 2""")
def saved_table(spark, sf):
    """Saved, left alone without overwrite, replaced with it; the name loses what a table name can't have."""
    c = t(spark, sf, "customer")
    name, out = _own(spark, "Sites of 2024: é!"), None
    for step, rows, overwrite in (("first", c.where("c_acctbal < 1000"), False), ("kept", c.where("c_acctbal >= 1000"), False), ("replaced", c.where("c_acctbal >= 1000"), True)):
        full = ST.save_table(rows.select("c_mktsegment"), name, DATABASE, overwrite)
        copy = ST.save_table(spark.table(full), name + step, DATABASE)
        one = spark.table(copy).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "c_mktsegment", "n", F.lit(ST.clean_name("Sites of 2024: é!")).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


@query("imported_layer", "SELECT site_id, round(x * 180 / (pi() * 6378137), 12) AS lon FROM sites WHERE c_mktsegment = 'BUILDING'", "sites")
def imported_layer(spark, sf):
    """Import with a condition and another reference system."""
    s = fx.sites(spark, sf).select("site_id", "c_mktsegment", "geom")
    name = SV.import_layer(s, _own(spark, "imported"), DATABASE, source_srid=fx.SRID, target_srid=4326, where="c_mktsegment = 'BUILDING'")
    from ..functions import native as N
    return spark.table(name).select("site_id", F.round(N.point_x(F.col("geom")), 12).alias("lon"))


@query("table_and_view_from_query", "SELECT kind, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, (SELECT unnest(['table', 'view', 'lasting view']) AS kind) GROUP BY 1, 2")
def table_and_view_from_query(spark, sf):
    base = ST.save_table(t(spark, sf, "customer"), _own(spark, "customer"), DATABASE)
    sql = f"SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {base} GROUP BY c_nationkey"
    made = {"table": ST.table_from_query(spark, sql, _own(spark, "by_nation"), DATABASE), "view": _own(spark, "v"), "lasting view": f"{DATABASE}.{_own(spark, 'v')}"}
    ST.view_from_query(spark, sql, made["view"])
    ST.view_from_query(spark, sql, made["lasting view"], temporary=False)
    out = None
    for kind, name in made.items():
        one = spark.table(name).select(F.lit(kind).alias("kind"), "c_nationkey", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("refreshed_result", """SELECT 'before' AS at, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'stale', c_mktsegment, count(*) FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2
    UNION ALL SELECT 'refreshed', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def refreshed_result(spark, sf):
    """A saved result keeps its rows until it is refreshed."""
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    base = ST.save_table(c.where("c_custkey % 2 = 0"), _own(spark, "base"), DATABASE)
    name = ST.create_materialized(spark, f"SELECT c_mktsegment, count(*) AS n, 'it''s' AS note FROM {base} GROUP BY c_mktsegment", _own(spark, "result"), DATABASE)
    keep = lambda at: spark.table(ST.save_table(spark.table(name), _own(spark, at), DATABASE)).select(F.lit(at).alias("at"), "c_mktsegment", "n")
    before = keep("before")
    c.where("c_custkey % 2 = 1").write.mode("append").saveAsTable(base)
    stale = keep("stale")
    ST.refresh_materialized(spark, name)
    return before.unionByName(stale).unionByName(keep("refreshed"))


@query("changed_table", "SELECT 'moved' AS step, c_custkey::VARCHAR AS key, c_acctbal AS balance, 7 AS seven FROM customer UNION ALL SELECT 'truncated', NULL, NULL, count(*) FILTER (WHERE c_custkey < 0)::INT FROM customer")
def changed_table(spark, sf):
    """Columns added, retyped, renamed and dropped; the table renamed, moved and, as a copy, truncated."""
    c = t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name")
    c = ST.rename_column(ST.retype_column(ST.add_column(ST.drop_column(c, "c_name"), "seven", "int", 7), "c_custkey", "string"), "c_acctbal", "balance")
    name, new = ST.save_table(c, _own(spark, "old"), DATABASE), _own(spark, "new")
    ST.rename_table(spark, name, f"{DATABASE}.{new}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}_2")
    moved = ST.move_table(spark, f"`{DATABASE}`.`{new}`", DATABASE + "_2")
    copy = ST.save_table(spark.table(moved), _own(spark, "copy"), DATABASE)
    ST.truncate(spark, copy)
    gone = spark.table(copy).agg(F.count(F.lit(1)).cast("int").alias("seven")).select(F.lit("truncated").alias("step"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("balance"), "seven")
    return spark.table(moved).select(F.lit("moved").alias("step"), F.col("c_custkey").alias("key"), "balance", "seven").unionByName(gone)


@query("text_in_another_encoding", "SELECT c_custkey, c_mktsegment || ' é ß ñ ' || c_name AS text FROM customer")
def text_in_another_encoding(spark, sf):
    path = f"{checkpoint_dir(spark)}/latin-{uuid.uuid4().hex}"
    c = t(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" é ß ñ "), "c_name").alias("text"))
    c.write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return ST.read_text(spark, path, "csv", "ISO-8859-1", header=True, schema=None).select(F.col("c_custkey").cast("long").alias("c_custkey"), "text")


@query("typed_statement", "SELECT c_mktsegment AS \"a -- b\", 'it''s -- no comment; ' || count(*) AS text FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def typed_statement(spark, sf):
    """A statement with comments, line breaks, quoted dashes and semicolons."""
    t(spark, sf, "customer").createOrReplaceTempView("typed_customer")
    text = """
    -- customers; by segment
    SELECT c_mktsegment AS `a -- b`,   -- the name isn't a comment
           'it''s -- no comment; ' || count(*) AS text
    FROM typed_customer --;
    WHERE c_acctbal > 0 -- 'open quote
    GROUP BY 1 ;;
    """.replace("it''s", "it\\'s")
    one = T.clean_sql(text)
    if "\n" in one or "by segment" in one or one.endswith(";"):
        raise ValueError(one)
    return spark.sql(one)


@query("guessed_columns", "SELECT 'sites' AS layer, 'geom' AS geometry, 'site_id' AS id, count(*) AS n FROM customer UNION ALL SELECT 'zones', 'the_geom', 'zone_id', count(*) FROM nation UNION ALL SELECT 'parts', 'shape', 'part_id', count(*) FROM part UNION ALL SELECT 'suppliers', NULL, NULL, count(*) FROM supplier")
def guessed_columns(spark, sf):
    layers = {"sites": fx.sites(spark, sf), "zones": fx.zones(spark, sf).withColumnRenamed("geom", "the_geom"), "parts": fx.parcels(spark, sf).withColumnsRenamed({"geom": "shape", "parcel_id": "part_id"}),
              "suppliers": t(spark, sf, "supplier")}
    out = None
    for name, df in layers.items():
        geom, key = T.guess_columns(df)
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), F.lit(geom).cast("string").alias("geometry"), F.lit(key).cast("string").alias("id"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("catalog_of_tables", "SELECT 'sites' AS name, 'vector' AS kind, 'geom' AS geometry_column, 3857 AS srid, false AS is_view, 3 AS n_columns, count(*) AS n_rows FROM customer UNION ALL SELECT 'heat', 'raster', NULL, NULL, false, 6, ceil(count(*) / 625)::BIGINT FROM events UNION ALL SELECT 'rich', 'table', NULL, NULL, true, 1, count(*) FROM customer WHERE c_acctbal > 5000")
def catalog_of_tables(spark, sf):
    """A database with a layer, a raster, a view and a hidden table."""
    db = f"{DATABASE}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    sites = ST.save_table(set_srid(fx.sites(spark, sf).select("site_id", "c_acctbal", "geom"), fx.SRID), "sites", db)
    ST.save_table(fx.heat_tiles(spark, sf), "heat", db)
    ST.save_table(t(spark, sf, "nation"), "internal", db)
    ST.view_from_query(spark, f"SELECT site_id FROM {sites} WHERE c_acctbal > 5000", f"{db}.rich", temporary=False)
    c = PR.catalog(spark, db, rows=True, hidden=("internal",)).where(F.col("database") == db)
    return c.select("name", "kind", "geometry_column", "srid", "is_view", "n_columns", "n_rows")


@query("logged_queries", "SELECT 'SELECT * FROM logged_parts WHERE p_size > ' || size AS query, count(*) AS n_rows FROM part, (SELECT unnest([10, 20, 30]) AS size) WHERE p_size > size GROUP BY size")
def logged_queries(spark, sf):
    """The latest three of four statements, with the rows that each gave."""
    t(spark, sf, "part").createOrReplaceTempView("logged_parts")
    log = f"{DATABASE}.{_own(spark, 'log')}"
    for size in (5, 10, 20, 30):
        PR.run_logged(spark, f"SELECT * FROM logged_parts WHERE p_size > {size}", log)
    return PR.query_log(spark, log, keep=3).select("query", "n_rows")


@query("stored_queries", "SELECT 'large' AS name, count(*) AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'small', count(*) FROM part WHERE p_size < 5")
def stored_queries(spark, sf):
    """Saved, replaced, deleted and run again."""
    t(spark, sf, "part").createOrReplaceTempView("stored_parts")
    store = f"{DATABASE}.{_own(spark, 'queries')}"
    for name, sql in (("large", "p_size > 45"), ("small", "p_size < 5"), ("odd", "p_size % 2 = 1"), ("large", "p_size > 40")):
        PR.save_query(spark, store, name, f"SELECT count(*) AS n FROM stored_parts WHERE {sql}")
    PR.delete_query(spark, store, "odd")
    out = None
    for row in PR.saved_queries(spark, store).select("name").collect():   # three at most
        one = PR.load_query(spark, store, row["name"]).select(F.lit(row["name"]).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("indexed_box_search", "SELECT parcel_id, p_brand, true AS few_files, true AS all_listed FROM parcels WHERE xmin <= 38 AND xmax >= 31 AND ymin <= 55.5 AND ymax >= 48", "parcels")
def indexed_box_search(spark, sf):
    """Parcels that meet a box, from a layer in some 64 files of which at most a quarter is opened."""
    path = f"{checkpoint_dir(spark)}/indexed-{uuid.uuid4().hex}"
    p = fx.parcels(spark, sf)
    n = p.count()
    SI.write_indexed(p.select("parcel_id", "p_brand", "geom", "bbox"), path, -(-n // 64))
    files = spark.read.parquet(path + "/files")
    opened, total, listed = SI.files_meeting(spark, path, 31, 48, 38, 55.5).count(), files.count(), files.agg(F.sum("n")).first()[0]
    return SI.read_indexed(spark, path, 31, 48, 38, 55.5).select("parcel_id", "p_brand", F.lit(opened <= total / 4).alias("few_files"), F.lit(listed == n).alias("all_listed"))
