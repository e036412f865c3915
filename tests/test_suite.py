"""Registered queries against their SQL twins on the smallest scale (a fast part of them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

FAST = ["sites_per_zone", "join_contains", "join_left", "mbr_overlaps", "within_distance", "distance_band_boxes", "nearest_depots", "parcel_zone_intersection", "clip_parcels", "difference_parcels",
        "difference_zones", "dissolve_parcels", "dense_clusters", "buffer_boxes", "track_steps", "ranking", "moving_frames", "raster_summary", "raster_mosaic", "resample_lanczos", "raster_clip", "terrain_slope", "history_two_batches",
        "merged_layers", "events_on_routes", "stream_geofence", "stream_history"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, sf, name):
    res, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert res.startswith("ok"), res


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
