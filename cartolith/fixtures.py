"""Layers derived from the given tables by plain arithmetic, so that DuckDB can derive the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .layer import make_bbox, make_box, make_point, set_srid, vertex, make_line

SRID = 3857


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has, however few pieces their file has; for costly work row by row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _points(df: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return set_srid(df.withColumn("geom", make_point(x, y)).withColumn("bbox", make_bbox(x, y, x, y)), SRID)


def _boxes(df: DataFrame) -> DataFrame:
    c = [F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")]
    return set_srid(df.withColumn("geom", make_box(*c)).withColumn("bbox", make_bbox(*c)).drop("xmin", "ymin", "xmax", "ymax"), SRID)


def zones(spark, sf_dir) -> DataFrame:
    """25 boxes that tile the plane."""
    t = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("zone_id"), "n_name", "n_regionkey",
        (20.0 * F.pmod("n_nationkey", F.lit(5))).alias("xmin"), (20.0 * F.expr("n_nationkey div 5")).alias("ymin"))
    return _boxes(t.withColumn("xmax", F.col("xmin") + 20).withColumn("ymax", F.col("ymin") + 20))


def sites(spark, sf_dir) -> DataFrame:
    """One point per customer."""
    return _points(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("site_id"), "c_mktsegment", "c_acctbal",
        F.expr("((c_custkey * 7919L) % 10007L) / 100.07D").alias("x"), F.expr("((c_custkey * 104729L) % 10009L) / 100.09D").alias("y")))


def depots(spark, sf_dir) -> DataFrame:
    """One point per supplier."""
    return _points(table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("depot_id"),
        F.expr("((s_suppkey * 7919L) % 10007L) / 100.07D").alias("x"), F.expr("((s_suppkey * 15485863L) % 10009L) / 100.09D").alias("y")))


def parcels(spark, sf_dir) -> DataFrame:
    """One box per part."""
    t = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("parcel_id"), "p_brand", "p_type", "p_size",
        F.expr("((p_partkey * 6151L) % 9973L) / 99.73D").alias("xmin"), F.expr("((p_partkey * 3571L) % 9967L) / 99.67D").alias("ymin"))
    t = t.withColumn("xmax", F.expr("xmin + p_size / 10D")).withColumn("ymax", F.expr("ymin + (1 + parcel_id % 7) / 2D"))
    return _boxes(t.drop("p_size"))


def routes(spark, sf_dir, spread: bool = False) -> DataFrame:
    """Two-vertex lines: from the site of an order to the depot of each of its items; ``spread`` over the tasks as keys, before there are geometries to move."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("o_custkey").alias("site_id"), F.col("l_suppkey").alias("depot_id"))
    if spread:
        t = over_tasks(t, "order_id", "line_no")
    # end points follow from the keys, so no lookup of the two point layers is needed
    t = t.select(
        "*", F.expr("((site_id * 7919L) % 10007L) / 100.07D").alias("x1"), F.expr("((site_id * 104729L) % 10009L) / 100.09D").alias("y1"),
        F.expr("((depot_id * 7919L) % 10007L) / 100.07D").alias("x2"), F.expr("((depot_id * 15485863L) % 10009L) / 100.09D").alias("y2"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    t = t.withColumn("geom", make_line(F.array(vertex(x1, y1), vertex(x2, y2))))
    return set_srid(t.withColumn("bbox", make_bbox(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))).drop("x1", "y1", "x2", "y2"), SRID)


def track_points(spark, sf_dir) -> DataFrame:
    """One point per event, for tracks by user."""
    return _points(table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.expr("CAST((event_id * 37L) % 101L AS DOUBLE)").alias("x"), F.expr("CAST((event_id * 53L) % 103L AS DOUBLE)").alias("y")))


def changes(spark, sf_dir) -> DataFrame:
    """Change log: first order of a customer inserts, a last order with status F deletes, the rest update."""
    from pyspark.sql import Window
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nth, left = F.row_number().over(w), F.lead("o_orderkey").over(w)
    op = F.when(nth == 1, "I").when(left.isNull() & (F.col("o_orderstatus") == "F"), "D").otherwise("U")
    return o.select(F.col("o_custkey").alias("key"), op.alias("op"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
                    F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))


def heat(spark, sf_dir) -> DataFrame:
    """Raster in pixel form from the dense event grid: 100 columns, band 1 and band 2."""
    from .operators.raster import Grid, stamp_grid
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id").alias("m")).first()["m"] // 100 + 1   # one number: the height of the raster
    px = e.select(F.expr("CAST(event_id % 100 AS INT)").alias("col"), F.expr("CAST(event_id div 100 AS INT)").alias("row"),
                  F.when(F.col("event_type") != "error", F.col("value")).alias("b1"), F.col("user_id").cast("double").alias("b2"))
    rid = F.expr("CAST((row div 25) * 4 + col div 25 AS BIGINT)")
    long = px.select(rid.alias("rid"), F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("b1").alias("value")),
                                                         F.struct(F.lit(2).alias("band"), F.col("b2").alias("value")))).alias("b"), "col", "row")
    return stamp_grid(long.select("rid", "b.band", "col", "row", "b.value"), Grid(0.0, float(n), 1.0, -1.0, 100, int(n), SRID))


def heat_tiles(spark, sf_dir) -> DataFrame:
    """The same raster in tile form: both bands, 25 x 25 pixels a tile."""
    from .operators.raster import Grid
    from .operators.tiles import stamp
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id").alias("m")).first()["m"] // 100 + 1   # one number: the height of the raster
    px = e.select(F.expr("CAST((event_id div 100 div 25) * 4 + (event_id % 100) div 25 AS BIGINT)").alias("rid"),
                  F.struct("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("b1"), F.col("user_id").cast("double").alias("b2")).alias("p"))
    t = px.groupBy("rid").agg(F.array_sort(F.collect_list("p")).alias("p"))   # 625 pixels at most
    at = F.element_at("p", 1)["event_id"]
    t = t.select("rid", (at % 100).cast("int").alias("tx"), F.floor(at / 100).cast("int").alias("ty"), F.lit(25).alias("width"), F.ceil(F.size("p") / 25).cast("int").alias("height"),
                 F.array(F.transform("p", lambda v: v["b1"]), F.transform("p", lambda v: v["b2"])).alias("bands"))
    return stamp(t, Grid(0.0, float(n), 1.0, -1.0, 100, int(n), SRID), True)
