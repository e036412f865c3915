"""The queries of the edges against their SQL twins on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from cartolith.suite import edges  # noqa: F401
from cartolith.suite.registry import ORACLE
from check import TABLES, compare

NAMES = ["nearest_zones_of_parcels", "join_left_null_keys", "join_anti_null_keys", "raster_values_under_overlaps", "sparse_tiles_and_back", "focal_stddev_large_values", "polygonized_islands", "not_in_with_nulls", "regexp_places",
         "time_texts", "mbr_zones_touches", "common_parts_of_words", "wrapped_lines", "sql_edits", "sql_text_forms", "sql_spatial_join"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    result, _ = compare(spark, con, name, entry.queries()[name], ORACLE[name], sf)
    assert result.startswith("ok") and result != "ok 0", result


def test_spatial_predicate_has_no_nested_loop(spark, sf):
    plan = entry.queries()["sql_spatial_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
