"""Every query of the competition operators: against its SQL, or at least its rows where it has none."""

import pytest

from tallyfield.plans import cup, joins, league, pages, people, report_pages, words  # noqa: F401  (each registers its queries)
from tallyfield.plans.registry import ORACLES, QUERIES
from tests.duck import compared, views


@pytest.fixture(scope="module")
def con():
    return views("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, small, con, name):
    mine, other = compared(QUERIES[name](spark, small), con, ORACLES[name])
    assert mine == other


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_gives_the_same_rows_again(spark, small, name):
    first, again = (sorted(map(str, QUERIES[name](spark, small).collect())) for _ in range(2))
    assert first and first == again


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert "position" in __spark_entry__.entry(spark).columns


def test_plans_push_down_and_prune(spark, small):
    """The league table reads no column it does not use and needs no Python."""
    plan = QUERIES["league_table"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "Python" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_report_pages_are_parsed_once_and_only_as_far_as_asked(spark, small):
    """Events are worked out once, not again for filters on their number, and not at all for line-ups; one shuffle builds the pages."""
    plans = {name: QUERIES[name](spark, small)._jdf.queryExecution() for name in ("report_events", "lineup_pages")}
    goals = {name: plan.optimizedPlan().toString().count("img\\s+lgol") for name, plan in plans.items()}
    assert goals == {"report_events": 1, "lineup_pages": 0}
    assert all(plan.executedPlan().toString().count("Exchange ") == 1 for plan in plans.values())


@pytest.mark.parametrize("name", ["reconciled_reports", "quarantined_reports"])
def test_fixtures_of_reports_are_joined_once(spark, small, name):
    """Names, reports and candidates read the fixtures that were written, not the tables again."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan
