"""Every registered query against its SQL twin on the smallest data set."""

import pytest
from conftest import SMALL
from oracle import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    problem, _ = compare(spark, duck, SMALL, entry.queries()[name], ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "case_id"


def test_no_python_workers_and_no_cartesian_products(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name in ("risk_score", "registry_outcome", "cross_document", "label_value_pairs", "conflicts"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().explainString(mode)
        for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_outcomes_make_no_compared_values(spark):
    """Values inside an array of structs are never pruned, so the outcome must not ask for them."""
    from attestry.operators import registry
    from attestry.plans.fixtures import table

    rows = registry.registry_outcomes(*[table(spark, "/root/testdata/sf0.001", n) for n in ("submissions", "registry", "watchlist")])
    assert rows.schema["field_results"].dataType.elementType.names == ["field", "is_critical", "comparison_method", "status"]


def test_forms_of_compared_fields_are_made_once(spark):
    from attestry.operators import registry
    from attestry.plans.fixtures import table

    inputs = [table(spark, "/root/testdata/sf0.001", n) for n in ("submissions", "registry", "watchlist")]
    plan = registry.field_comparison(*inputs, secret="s")._jdf.queryExecution().optimizedPlan().toString()
    # each of five dates is recognised and checked once
    assert plan.count("19\\d\\d|20\\d\\d|2100") == 10
    # no filter repeats the candidate keys
    assert "size(filter(" not in plan
