"""Physical plans: no cross products, filters and columns at the scan, few exchanges."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# these run streams or write tables before they return a frame
EAGER = {n for n in QUERIES if re.match(r"s0[1-9]|s1[0-3]|r0", n)}


def plan(spark, small_dir, name):
    return QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_products(spark, small_dir, name):
    text = plan(spark, small_dir, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window \[.*\], \[\], ", text), "window without partition"


def test_date_range_reaches_the_scan(spark, small_dir):
    text = plan(spark, small_dir, "p01_date_range")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    assert re.search(r"FileScan parquet \[[^\]]*l_shipdate", text)
    assert "l_returnflag" not in text


@pytest.mark.parametrize(
    "name, exchanges",
    [
        ("a01_weekly_mean", 1),
        ("clean_weekly_series", 2),
        ("w05_interpolate_linear", 2),
        ("p07_trim_valid", 2),
        ("w01_stratified_sample", 1),
        ("d08_mask_random", 1),
        ("d13_structured_mask", 1),
        ("d15_token_table", 1),
        ("a17_contrastive_loss", 2),
        ("a18_eam_loss", 2),
        ("p01_date_range", 0),
        ("j02_assign_cell", 0),
        ("d09_mask_modality", 1),
    ],
)
def test_exchanges(spark, small_dir, name, exchanges):
    assert plan(spark, small_dir, name).count("Exchange hashpartitioning") == exchanges


def test_random_split_moves_nothing(spark, small_dir):
    assert "Exchange" not in plan(spark, small_dir, "d02_split_random")


def test_weekly_rows_combine_before_the_exchange(spark, small_dir):
    text = plan(spark, small_dir, "a01_weekly_mean")
    assert "partial_avg" in text


def test_top_k_keeps_k_rows(spark, small_dir):
    assert "TakeOrderedAndProject" in plan(spark, small_dir, "t01_top_zones")


def test_one_sort_serves_all_interpolation_windows(spark, small_dir):
    text = plan(spark, small_dir, "w05_interpolate_linear")
    after = text[: text.index("Generate explode")]
    assert after.count("Sort [") == 1


def test_histograms_read_the_table_twice(spark, small_dir):
    """Once for the bounds of all variables, once for their bins."""
    df = QUERIES["a07_histograms"](spark, small_dir)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")]
    bodies = {m for m in re.findall(r"FileScan parquet \[[^\]]*\]", final)}
    assert bodies and "ReusedSubquery" in final
    assert final.count("FileScan") - final.count("ReusedSubquery") <= 2


def test_large_strata_exchange_only_the_boundary(spark):
    text = plan(spark, "/root/testdata/sf0.01", "w01_stratified_lines")
    assert "Union" in text and "SortMergeJoin" not in text
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 1


@pytest.mark.parametrize("name", ["a06_dataset_stats", "a11_null_audit"])
def test_reports_read_the_series_once(spark, small_dir, name):
    assert len(re.findall(r"FileScan parquet [^\n]*l_suppkey", plan(spark, small_dir, name))) == 1
