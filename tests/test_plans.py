"""Physical plans of the registered queries."""

from __future__ import annotations


import pytest

from citescope.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
NARROW = [
    "page_text", "meta_scalars", "page_links", "page_images", "dom_diff", "json_ld",
    "ld_normalized", "content_stats", "llm_embedded", "page_llm_candidates", "content_metrics",
    "schema_markup", "structural_issues",
]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairs(spark, name):
    text = plan(spark, name)
    for operator in [
        "EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"
    ]:
        assert operator not in text


@pytest.mark.parametrize("name", NARROW)
def test_page_queries_shuffle_nothing(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["structure_analysis", "llm_embedded", "page_links"])
def test_page_is_tokenised_once(spark, name):
    assert plan(spark, name).count("(?is)<!--.*?-->|<script(?=") == 1


def test_source_does_not_reach_the_joins(spark):
    text = plan(spark, "structure_analysis")
    for line in text.splitlines():
        if "Sort [" in line or "ENSURE_REQUIREMENTS" in line:
            assert "html" not in line


def test_source_does_not_reach_the_joins_of_a_record(spark):
    from citescope.operators import pages
    from citescope.plans import fixtures as fx

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        record = pages.crawl_record(
            fx.geo_pages(spark, SF), fx.http_info(spark, SF), fx.geo_site_files(spark, SF), keep_source=False
        )
        text = record._jdf.queryExecution().executedPlan().toString()
        audit = plan(spark, "structure_analysis")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in (text + audit).splitlines():
        if "Exchange" in line and "ENSURE_REQUIREMENTS" in line:
            assert "html" not in line
    assert "SortMergeJoin" in text


def test_scan_reads_needed_columns(spark):
    assert "ReadSchema: struct<url:string>" in plan(spark, "llm_candidates")


def test_domain_counts_combine_before_the_shuffle(spark):
    text = plan(spark, "domain_totals")
    assert "partial_sum" in text and "partial_count" in text
