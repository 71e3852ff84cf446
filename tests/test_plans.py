"""Plans: filters and columns reach the scan, partial aggregation before shuffles, no Python where none is needed."""

import pytest

import __spark_entry__ as entry
from folioscope.plans import queries as core
from folioscope.session import spread


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "rel_point")
    assert "EqualTo(doc_id,5)" in p and "full_text" not in p.rpartition("ReadSchema")[2].splitlines()[0]
    assert "PushedFilters: [In(doc_id, " in plan(spark, sf, "rel_in_list")
    p = plan(spark, sf, "rel_counts")
    assert "ReadSchema: struct<doc_type:string,confidence:double,line_count:int>" in p


@pytest.mark.parametrize("name", ["scn_classify", "cls_types", "url_extract", "sim_pairs", "can_merge", "fts_word", "api_stats", "nws_fields"])
def test_stays_in_the_jvm(spark, sf, name):
    p = plan(spark, sf, name)
    assert "MapInPandas" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name", ["api_entities", "rel_join_mentions", "fts_terms", "scn_types"])
def test_aggregates_before_the_shuffle(spark, sf, name):
    assert "partial_" in plan(spark, sf, name)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_no_cross_joins_but_of_one_row(spark, sf, name):
    p = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p


def test_spread(spark):
    d = spark.range(100).coalesce(1)
    assert spread(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


@pytest.mark.parametrize("name", ["fts_word", "fts_boolean", "fts_phrase", "fts_prefix"])
def test_search_scans_once(spark, sf, name):
    """Counts are written by one scan of the documents; ranks read only them, without a join of terms."""
    p = plan(spark, sf, name)
    assert p.count("FileScan parquet") == 0 and "SortMergeJoin" not in p and "Generate" not in p


def test_index_query_reads_its_terms(spark, sf):
    p = plan(spark, sf, "fts_indexed")
    assert "FileScan parquet" in p  # of the lengths alone: the postings were read and counted once
    assert p.count("positions") == 0
