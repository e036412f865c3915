"""Layers stored for box searches: files along a Hilbert curve, and a list of the files with their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..layer import attribute_columns, ensure_bbox, set_srid, srid_of
from ..operators.joins import bbox_filter

BITS = 26   # levels of the curve: far finer than any file, so only the rows' number decides where files part


def hilbert(cx: Column, cy: Column, bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve through 2^bits x 2^bits cells; cells next to each other on the curve are neighbours."""
    def step(s, side):
        rx, ry = (s["x"].bitwiseAND(side) > 0), (s["y"].bitwiseAND(side) > 0)
        quarter = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
        top = F.lit((1 << bits) - 1).cast("long")
        x, y = F.when(rx & ~ry, top - s["x"]).otherwise(s["x"]), F.when(rx & ~ry, top - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry, x).otherwise(y).alias("x"), F.when(ry, y).otherwise(x).alias("y"), (s["d"] * 4 + quarter).alias("d"))

    start = F.struct(cx.cast("long").alias("x"), cy.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(bits))]), start, step, lambda s: s["d"])


def write_indexed(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write a layer in files of about ``rows_per_file`` neighbouring rows, then the list of files with rows and boxes.

    Ranges of the curve hold equal numbers of rows, so files are small where rows are dense; rows of one place are told apart by their content, so a place that
    holds very many is cut as well.  Rows without a place come first.  The list is written last: without it there is no layer."""
    d = ensure_bbox(df)
    b = F.col("bbox")
    e = d.agg(F.count(F.lit(1)).alias("n"), *[f(f"bbox.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).first()
    if e["xmin"] is not None:
        unit = max(e["xmax"] - e["xmin"], e["ymax"] - e["ymin"], 1e-300) / ((1 << BITS) - 1)
        at = lambda lo, hi, least: F.floor(((b[lo] + b[hi]) / 2 - least) / unit)
        tell = F.xxhash64(*[F.col(f"`{c}`") for c in attribute_columns(d)]) if attribute_columns(d) else F.lit(0)
        keyed = d.withColumns({"_h": hilbert(at("xmin", "xmax", e["xmin"]), at("ymin", "ymax", e["ymin"])), "_c": tell})
        d = keyed.repartitionByRange(max(1, -(-e["n"] // rows_per_file)), "_h", "_c").sortWithinPartitions("_h").drop("_h", "_c")
    set_srid(d, srid_of(df)).write.parquet(path + "/data")
    back = df.sparkSession.read.parquet(path + "/data")
    files = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *[f(f"bbox.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])
    files.write.parquet(path + "/files")


def files_meeting(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The listed files whose box meets a rectangle."""
    return spark.read.parquet(path + "/files").where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def read_indexed(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose box meets a rectangle; only files whose box does are opened (their names are what the driver gets)."""
    names = [r[0] for r in files_meeting(spark, path, xmin, ymin, xmax, ymax).select("file").collect()]
    rows = spark.read.parquet(*names) if names else spark.read.parquet(path + "/data").where(F.lit(False))
    return bbox_filter(rows, xmin, ymin, xmax, ymax)
