"""Ordered work in blocks gives what plain windows give, and blocks grow with the rows of the largest key."""

import pytest
from pyspark.sql import Window, functions as F

from cartolith.operators import history as H
from cartolith.plans import scan


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 997).alias("x"),
                                    F.when(F.col("id") % 11 == 0, F.col("id")).alias("v")).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.fixture(params=[100, 1_000_000], ids=["blocks", "plain"])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_BLOCK", request.param)
    return request.param


def test_number_of_blocks_follows_the_largest_key(rows, monkeypatch):
    found = []
    for size in (10_000, 500, 100, 20):
        monkeypatch.setattr(scan, "ROWS_PER_BLOCK", size)
        found.append(scan.blocks_needed(rows, ["k"]))
    largest = max(r["count"] for r in rows.groupBy("k").count().collect())
    assert found == [1, -(-largest // 500), -(-largest // 100), -(-largest // 20)]
    block = scan.block_column(rows, ["k"], ["x", "id"])
    assert rows.select(block.alias("b")).distinct().count() > 50


def test_ranked(rows, block_rows):
    names = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist"]
    w = Window.partitionBy("k").orderBy("x")
    got = scan.ranked(rows, ["k"], ["x"], *names[1:])
    want = rows.select("*", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    same(got, want)
    down = Window.partitionBy("k").orderBy(F.desc("x"), F.desc("id"))
    same(scan.ranked(rows, ["k"], ["-x", "-id"], "row_number"), rows.select("*", F.row_number().over(down).alias("row_number")))


def test_running_and_moving(rows, block_rows):
    w = Window.partitionBy("k").orderBy("x", "id")
    same(scan.running(rows, ["k"], ["x", "id"], {"t": "x"}), rows.withColumn("t", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    for before in (3, 400):   # a frame longer than a chunk makes the chunk longer
        got = scan.windowed(rows, ["k"], ["x", "id"], {"m": lambda z: F.sum("x").over(z.rowsBetween(-before, 0))}, before=before, chunk=100)
        same(got, rows.withColumn("m", F.sum("x").over(w.rowsBetween(-before, 0))))
    same(scan.last_before(rows, ["k"], ["x", "id"], F.col("v"), "l"), rows.withColumn("l", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))


def test_untouched_rows_pass_through(spark):
    """Only keys with changes are sorted; the rest of the table is as it was."""
    h = H.init_history(spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("total")), "key")
    changes = spark.createDataFrame([(3, "U", "2024-01-01", 1), (3, "D", "2024-01-02", 1), (4, "U", "2024-01-03", 9), (70, "I", "2024-01-04", 5), (71, "U", "2024-01-04", 5)], "key long, op string, ts string, total long")
    out = H.apply_changes(h, changes, "key")
    assert out.count() == 50 + 2 + 1 and H.current(out).count() == 50
    assert {r.key for r in out.where("valid_to IS NOT NULL").collect()} == {3, 4}
    assert H.current(out).where("key IN (3, 71)").count() == 0
