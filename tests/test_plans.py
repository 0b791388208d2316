"""What the physical plans must and must not contain."""

import re

import pytest

from lendlake.plans import catalog
from tests.conftest import DATA

# Names whose run writes files or trains models before it returns a frame.
EAGER = {"export_table", "export_all_tables", "export_query_csv", "register_customers",
         "disburse_loans", "stream_apply_payments", "stream_monthly_collections",
         "stream_settled_instalments", "assess_applications", "model_store"}
EAGER |= {n for n in catalog.COLUMNS if n.startswith(("train_", "predict_"))}
LAZY = sorted(n for n in catalog.COLUMNS if n not in EAGER)


def plan(spark, name: str) -> str:
    return catalog.run(name, spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join_and_no_python(spark, name):
    text = plan(spark, name)
    for forbidden in ("CartesianProduct", "NestedLoopJoin", "ArrowEvalPython", "BatchEvalPython",
                      "MapInPandas", "FlatMapGroups"):
        assert forbidden not in text


# Single-task windows run over months, distinct counts, the top level of a rank, or the counts of
# the ranges that new keys are numbered in.
SMALL_WINDOWS = {"monthly_repayments_rolling": "_month", "penalty_rank_by_name": "_high",
                 "penalty_leaderboard": "_high|default_count"}


@pytest.mark.parametrize("name", LAZY)
def test_unpartitioned_windows_are_over_small_frames_only(spark, name):
    for window in re.findall(r"Window \[.*", plan(spark, name)):
        spec = re.search(r"windowspecdefinition\((.*?)(ASC|DESC)", window)
        if spec and "," not in spec.group(1):
            assert re.search(SMALL_WINDOWS.get(name, "_range"), spec.group(1)), window


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "monthly_repayments")
    assert "EqualTo(l_returnflag,A)" in text
    columns = re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    assert "l_shipdate" in columns and "l_discount" not in columns


def test_instalments_are_combined_before_they_meet_loans(spark):
    text = plan(spark, "emi_status_summary")
    join = text.index("loan_id#", text.index("Join"))
    assert "partial_count" in text[join:]


def test_newest_score_is_cut_down_before_the_shuffle(spark):
    text = plan(spark, "latest_score")
    assert "WindowGroupLimit [customer_id" in text and "Partial" in text


@pytest.mark.parametrize("name", [n for n in catalog.COLUMNS if n.endswith("_one")])
def test_look_ups_filter_at_the_scan(spark, name):
    text = plan(spark, name)
    key = {"customer_profile_one": "c_custkey", "customer_loans_one": "o_custkey",
           "emi_ledger_one": "l_orderkey"}.get(name, "user_id")
    assert re.search(rf"PushedFilters: \[[^]]*EqualTo\({key},", text)


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_cascade_reads_each_child_by_its_reference(spark, star):
    from lendlake.operators import maintenance
    doomed = star.loan.where("current_status = 'Defaulted'").select("loan_id")
    after = maintenance.cascade_delete(star, "loan", doomed)
    assert scans(after.emi_schedule) <= 3


def test_a_stored_sweep_reads_the_schedule_twice(spark, star):
    """Once to find defaults, once to write the schedule; the other tables come from what was found."""
    from lendlake.operators import lifecycle
    after = lifecycle.default_sweep(star, "2000-01-01")
    for name in ("penalty", "default_record", "loan", "loan_status_history"):
        assert "l_shipdate" not in after[name]._jdf.queryExecution().optimizedPlan().toString()


def test_order_is_optional(spark, star):
    from lendlake.operators.portfolio import emi_status_summary

    def sorts(**arguments):
        return emi_status_summary(star, **arguments)._jdf.queryExecution().executedPlan()\
            .toString().count("rangepartitioning")
    assert sorts() == 1 and sorts(ordered=False) == 0


def test_many_changes_to_one_key_are_cut_down_before_the_shuffle(spark):
    text = plan(spark, "apply_changes")
    assert "WindowGroupLimit [customer_id" in text and "Partial" in text
