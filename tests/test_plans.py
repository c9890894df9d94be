"""Filters reach the scan, scans read what is asked for, and no plan multiplies tables or falls to one task without need."""

import pytest

from tracewright import catalogue, registry

catalogue.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, pushed", [("range_scan_price", "GreaterThanOrEqual(o_totalprice"), ("equality_filter", "EqualTo(o_orderpriority"), ("prefix_search", "StringStartsWith(p_name"), ("point_lookup_one", "EqualTo(o_custkey")])
def test_filters_are_pushed_down(spark, sf_dir, name, pushed):
    assert pushed in plan(registry.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name, absent", [("trace_profile", "props"), ("quantile_summary", "l_shipdate"), ("workload_summaries", "o_totalprice"), ("bitmap_cardinality", "value")])
def test_unused_columns_are_not_read(spark, sf_dir, name, absent):
    schemas = [line for line in plan(registry.QUERIES[name](spark, sf_dir)).splitlines() if "ReadSchema" in line]
    assert schemas and not any(absent in line.split("ReadSchema")[1] for line in schemas)


@pytest.mark.parametrize("name", ["trace_profile", "point_lookup_latest", "bitmap_intersect", "mutation_replay", "rank_correlation", "ledger_verify"])
def test_python_stays_out(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text
