"""Every query of the engine's own registry against its SQL, on the smallest tables."""

import pytest

from almanack.plans import registry

from .oracle import connect, python_rows

SF = "/root/testdata/sf0.001"
#: The smallest tables have ten suppliers, no two of one nation that could be merged.
EMPTY = {"g8_merge_chains_with_undo"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, name):
    mine, theirs = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLE[name])
    names = [x[0] for x in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    rows = mine.collect()
    assert python_rows(mine.columns, rows) == python_rows(names, theirs.fetchall())
    assert rows or name in EMPTY


@pytest.mark.parametrize("name", ["u4_k3_change_set", "q14_q5_freshness", "k7_u7_backup_diff", "j13_q2_index_consistency", "j9_o9_related_entries"])
def test_rows_are_dealt_out_before_they_are_sorted(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, plan
    if name != "j9_o9_related_entries":  # no groups are made in the tasks that read
        lines = plan.splitlines()
        assert not any("Exchange hashpartitioning" in a and ("Aggregate" in b or "Sort" in b) for a, b in zip(lines, lines[1:], strict=False)), plan


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_cases(spark, con, name):
    mine, theirs = registry.CASES[name](spark, SF), con.execute(registry.CASE_SQL[name])
    names = [x[0] for x in theirs.description]
    assert python_rows(mine.columns, mine.collect()) == python_rows(names, theirs.fetchall())


def test_cases_are_no_queries():
    assert registry.CASES and not registry.CASES.keys() & registry.QUERIES.keys()


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
