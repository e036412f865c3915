"""Layers stored along a Hilbert curve: the curve, the files, and what a search opens."""

from pyspark.sql import functions as F

from cartolith.layer import make_point, set_srid, srid_of, with_bbox
from cartolith.sources import stored as S


def test_hilbert_steps_to_neighbours(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.expr("id div 16").alias("y"))
    way = [(r["x"], r["y"]) for r in cells.withColumn("d", S.hilbert(F.col("x"), F.col("y"), 4)).orderBy("d").collect()]
    assert len(set(way)) == 256 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(way, way[1:]))


def test_files_follow_the_rows(spark, tmp_path):
    """Half of the rows at one place, some without a place: every file stays small and every search is whole."""
    i = F.col("id")
    d = spark.range(4000).withColumn("x", F.when(i % 2 == 0, 50.0).otherwise((i * 37 % 1009) / 10.0)).withColumn("y", F.when(i % 2 == 0, 50.0).otherwise((i * 91 % 997) / 10.0))
    d = set_srid(with_bbox(d.withColumn("geom", F.when(i % 100 != 7, make_point("x", "y")))), 3857).drop("x", "y")
    path = str(tmp_path / "layer")
    S.write_indexed(d, path, 200)
    files = spark.read.parquet(path + "/files").collect()
    assert sum(f["n"] for f in files) == 4000 and len(files) >= 15 and max(f["n"] for f in files) <= 600
    for box in ((0, 0, 20, 20), (50, 50, 50, 50), (-5, -5, -1, -1), (-1e9, -1e9, 1e9, 1e9)):
        got = S.read_indexed(spark, path, *box)
        want = d.where((F.col("bbox.xmin") <= box[2]) & (F.col("bbox.xmax") >= box[0]) & (F.col("bbox.ymin") <= box[3]) & (F.col("bbox.ymax") >= box[1]))
        assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in want.select("id").collect())
        assert srid_of(got) == 3857
    assert S.files_meeting(spark, path, 0, 0, 20, 20).count() <= len(files) / 3
    S.write_indexed(d.where("false"), str(tmp_path / "none"))
    assert S.read_indexed(spark, str(tmp_path / "none"), 0, 0, 1, 1).count() == 0
