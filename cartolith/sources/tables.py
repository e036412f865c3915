"""Saving results as tables and views, and changing tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F


def clean_name(text: str) -> str:
    """Output name without spaces, punctuation and accented letters."""
    plain = [ch for ch in text if ch == "_" or (ch.isascii() and ch.isalnum())
             or (not ch.isascii() and ch.isalpha() and unicodedata.normalize("NFD", ch) == ch and "LATIN" not in unicodedata.name(ch, ""))]
    return "".join(plain)


def quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def save_table(df: DataFrame, table: str, database: str = "default", overwrite: bool = False, partition_by: list[str] = ()) -> str:
    """Drop and create, or leave an existing table alone when ``overwrite`` is off."""
    name = quoted(f"{database}.{clean_name(table)}")
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return name


def table_from_query(spark: SparkSession, sql: str, table: str, database: str = "default", overwrite: bool = False) -> str:
    return save_table(spark.sql(sql), table, database, overwrite)


def view_from_query(spark: SparkSession, sql: str, view: str, temporary: bool = True) -> None:
    if temporary:
        spark.sql(sql).createOrReplaceTempView(view)
    else:
        spark.sql(f"CREATE OR REPLACE VIEW {quoted(view)} AS {sql}")


def create_materialized(spark: SparkSession, sql: str, table: str, database: str = "default") -> str:
    """Saved result that remembers its query."""
    name = save_table(spark.sql(sql), table, database, True)
    escaped = sql.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('source_query' = '{escaped}')")
    return name


def refresh_materialized(spark: SparkSession, name: str) -> str:
    """Run the stored query again and replace the rows."""
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    sql = props.get("source_query")
    if not sql:
        raise ValueError(f"{name} has no stored query")
    database, table = [p.strip("`") for p in re.findall(r"`[^`]+`|[^.]+", name)]
    return create_materialized(spark, sql, table, database)


# ---------------------------------------------------------------- table changes

def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def rename_table(spark: SparkSession, name: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {name} RENAME TO {quoted(new)}")


def move_table(spark: SparkSession, name: str, database: str) -> str:
    """Move to another schema: copy, then drop the old table."""
    table = re.findall(r"`[^`]+`|[^.]+", name)[-1].strip("`")
    new = quoted(f"{database}.{table}")
    spark.table(name).write.mode("errorifexists").saveAsTable(new)
    spark.sql(f"DROP TABLE {name}")
    return new


def add_column(df: DataFrame, name: str, type: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(type))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def retype_column(df: DataFrame, name: str, type: str) -> DataFrame:
    return df.withColumn(name, F.col(f"`{name}`").cast(type))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def read_server_table(spark: SparkSession, url: str, table: str, geom: str = "geom", key: str | None = None, bounds: tuple[int, int] | None = None,
                      partitions: int = 32, **options) -> DataFrame:
    """Layer from a database with spatial types over JDBC: the geometry arrives as WKB.

    With ``key`` and its ``bounds`` the read is split into partitions.  Needs the
    driver's jar on the class path, so it is not exercised offline."""
    from .vector import decode_geometry
    query = f"(SELECT t.*, ST_AsBinary(t.{geom}) AS _wkb FROM {table} t) q"
    reader = spark.read.format("jdbc").options(url=url, dbtable=query, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return decode_geometry(reader.load().drop(geom), "_wkb", "wkb")


def read_text(spark: SparkSession, path: str, format: str = "csv", encoding: str = "UTF-8", **options) -> DataFrame:
    """Text files in a given encoding; Spark decodes while it reads."""
    return spark.read.options(encoding=encoding, **options).format(format).load(path)
