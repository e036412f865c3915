"""A history table in buckets: batches, repeats, crashes, and what is written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartolith.operators import history as H
from cartolith.sources.history_store import HistoryStore

LOG = "key long, v string, op string, ts timestamp, seq long"


def log(spark, rows):
    return spark.createDataFrame([(k, v, op, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), i) for i, (k, v, op, h) in enumerate(rows)], LOG)


@pytest.fixture
def store(spark, tmp_path):
    empty = H.init_history(spark.createDataFrame([], "key long, v string"), "key")
    return HistoryStore(spark, str(tmp_path / "table"), empty, "key", ["seq"], "me", buckets=4)


BATCHES = [[(1, "a", "I", 0), (2, "b", "I", 0), (None, "n", "I", 1), (3, "c", "I", 1), (3, "cc", "U", 2)],
           [(1, "aa", "U", 10)],
           [(2, None, "D", 20), (None, "nn", "U", 21), (9, "x", "U", 21), (9, None, "D", 22)],
           []]


def rows(df):
    return sorted(map(str, df.select("key", "v", "valid_from", "valid_to", "changed_by", "version_id").collect()))


def folders(store, n):
    return store._matches(f"versions/batch={n}/state=open/bucket=*")


def test_batches_equal_the_whole_log(spark, store):
    assert store.read().count() == 0 and store.batches() == []
    whole = store.empty
    for i, b in enumerate(BATCHES):
        assert store.apply(log(spark, b), i)
        whole = H.apply_changes(whole, log(spark, b), "key", seq=["seq"], user="me")
        assert rows(store.read()) == rows(whole)
        assert rows(store.open_versions()) == rows(H.current(whole))
    assert not store.apply(log(spark, BATCHES[1]), 1)     # sent again
    assert rows(store.read()) == rows(whole)
    with pytest.raises(ValueError):
        HistoryStore(spark, store.path, store.empty, "key").apply(log(spark, BATCHES[1]), -1)
    assert len(folders(store, 1)) == 1                    # one key, one bucket
    assert store.vacuum() > 0 and store.batches() == [3]
    assert rows(store.read()) == rows(whole) and store.vacuum() == 0
    assert store.apply(log(spark, [(3, "z", "U", 40)]), 7)   # numbers may skip
    assert {r["v"] for r in store.open_versions().where("key = 3").collect()} == {"z"}


def test_a_batch_without_manifest_never_happened(spark, store):
    store.apply(log(spark, BATCHES[0]), 0)
    before = rows(store.read())
    store.apply(log(spark, [(1, "wrong", "U", 5), (4, "wrong", "I", 5), (4, "w", "U", 6)]), 1)
    store._delete(f"{store.path}/manifest/batch=1")       # as if the job had ended before its last write
    assert rows(store.read()) == before
    store.apply(log(spark, BATCHES[1]), 1)
    whole = H.apply_changes(H.apply_changes(store.empty, log(spark, BATCHES[0]), "key", seq=["seq"], user="me"), log(spark, BATCHES[1]), "key", seq=["seq"], user="me")
    assert rows(store.read()) == rows(whole)


def test_a_hot_key(spark, store):
    """One key with most of the log: every change is a version, in order."""
    d = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").cast("string").alias("v"),
                                 F.lit("I").alias("op"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"))
    store.apply(d.where("seq < 2000"), 0)
    store.apply(d.where("seq >= 2000"), 1)
    hot = store.read().where("key = 1")
    assert hot.count() == d.where("key = 1").count()
    assert hot.where("valid_to IS NULL").count() == 1
