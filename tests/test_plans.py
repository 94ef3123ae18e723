"""What the physical plans must and must not have."""

import os
import re

import pytest
from pyspark.sql import functions as F
from strandline.operators import transitions, windows
from strandline.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_strings(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["typed_filter"](spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert "EqualTo(l_linenumber,2)" in pushed and "l_quantity" in pushed
    assert "l_extendedprice" not in re.search(r"ReadSchema: (\S+)", text)[1]


def test_first_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["dedup_first"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["remaining_slots"](spark, SF))


def test_last_values_are_combined_before_the_shuffle(spark):
    text = plan(QUERIES["dedup_last"](spark, SF))
    assert "partial_max_by" in text and "Window" not in text


def test_phases_meet_in_one_shuffle(spark):
    df = spark.createDataFrame([], "test string, phase string, pos long, status string")
    text = plan(transitions.join_phases(df, ["test"], "pos"))
    assert text.count("Exchange") <= 1 and "Join" not in text


def test_numbering_has_no_single_task_for_rows(spark):
    df = spark.range(1000)
    text = plan(windows.number_rows(df, [F.col("id")]))
    for line in text.splitlines():
        if "SinglePartition" in line:
            assert "plan_id" in line
    assert not re.search(r"Window.*\bid#", text)


@pytest.mark.parametrize("name", ["left_default_topk", "typed_filter", "console_parse", "suite_parse", "patch_repair", "prompt_assembly", "strict_reader_reject", "category_histogram"])
def test_no_python_where_built_ins_do(spark, name):
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["symmetric_anti", "suffix_allow_deny", "longest_prefix_module", "exact_or_suffix", "as_of_purchase", "comments_before_commit"])
def test_no_pairs_of_all_rows(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))
