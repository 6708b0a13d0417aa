"""Physical-plan checks: the plans we want, not just the right answers."""

import pytest

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    qs = E.queries()
    return {name: _plan(qs[name](spark, sf_small)) for name in sorted(E.oracle_sql())}


def test_no_cartesian_or_nested_loop_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_pruned(spark, sf_small):
    from gradus.sources.incidents import incident_view
    plan = _plan(incident_view(spark, sf_small))  # before it is written and read back
    assert "c_custkey" in plan and "c_name" not in plan and "n_name" not in plan


def test_bayes_table_is_one_aggregation(plans):
    plan = plans["bayes_table"]
    assert plan.count("HashAggregate") == 2       # partial + final, one pass for all conditions
    assert "Union" not in plan


def test_confusion_and_report_do_not_rescan(plans):
    for name in ("confusion_matrix", "class_report"):
        assert "SortMergeJoin" not in plans[name], name


def test_chi_square_reads_input_once(plans):
    # the unpivot + cell counts are materialised once; the marginals and the
    # grid read that small table, never the incident tables again
    plan = plans["chi_square"]
    assert plan.count("Expand") <= 1
    assert plan.count("orders.parquet") <= 1
