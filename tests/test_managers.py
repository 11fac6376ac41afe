"""Manager groups and scopes."""

import pytest
from pyspark.sql import functions as F

from adtally.operators import managers


@pytest.fixture(scope="module")
def staff(spark):
    groups = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 3), (9, None)], "group_id int, parent_id int")
    people = spark.createDataFrame([(10, 0), (11, 1), (13, 3), (14, 4), (15, 4)], "id long, group_id int")
    return people, groups


def ids(df):
    return sorted(row[0] for row in df.collect())


def scope(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "manager_id long")


def test_group_with_subgroups(spark, staff):
    people, groups = staff
    assert ids(managers.group_with_subgroups(groups, 1)) == [1, 3, 4]
    assert ids(managers.managers_of_group(people, groups, 1)) == [11, 13, 14, 15]
    assert ids(managers.managers_of_group(people, groups, 9)) == []


def test_empty_choice_keeps_the_previous_scope(spark, staff):
    people, groups = staff
    previous = scope(spark, 7, 8)
    assert ids(managers.scope_or_previous(managers.managers_of_group(people, groups, 9), previous)) == [7, 8]
    assert ids(managers.scope_or_previous(managers.managers_of_group(people, groups, 3), previous)) == [13, 14, 15]


def test_narrowing_to_one_manager(spark, staff):
    people, groups = staff
    previous, allowed = scope(spark, 7), managers.managers_of_group(people, groups, 3)
    assert ids(managers.narrow_to_manager(0, previous)) == [7]
    assert ids(managers.narrow_to_manager(42, previous)) == [42]
    assert ids(managers.narrow_to_manager(14, previous, allowed)) == [14]
    assert ids(managers.narrow_to_manager(10, previous, allowed)) == [7]


def test_no_scope_and_an_empty_one_are_no_restriction(spark, staff):
    people, groups = staff
    accounts = spark.range(100).select("id", (F.col("id") % 10).alias("manager_id"))
    assert managers.of_managers(accounts, scope(spark, 3, 3, 4, None)).count() == 20
    assert managers.of_managers(accounts, None).count() == 100
    assert managers.of_managers(accounts, scope(spark).limit(0)).count() == 100
    empty = managers.managers_of_group(people, groups, 9)
    assert managers.of_managers(accounts, managers.scope_or_previous(empty, None)).count() == 100
    assert managers.of_managers(accounts, managers.scope_or_previous(empty, scope(spark, 5))).count() == 10
    assert managers.narrow_to_manager(0, None) is None
    assert ids(managers.narrow_to_manager(14, None, managers.managers_of_group(people, groups, 3))) == [14]


def test_cycles_and_long_chains_of_groups_end(spark):
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4)], "group_id int, parent_id int")
    assert ids(managers.group_with_subgroups(cycle, 1)) == [1, 2, 3]
    assert ids(managers.group_with_subgroups(cycle, 4)) == [4]
    chain = spark.createDataFrame([(i + 1, i) for i in range(130)], "group_id int, parent_id int")
    assert len(ids(managers.group_with_subgroups(chain, 1))) == 130


def test_deep_trees_cycles_and_diamonds(spark, monkeypatch):
    rounds = []
    stored = managers.checkpointed
    monkeypatch.setattr(managers, "checkpointed", lambda df: rounds.append(df) or stored(df))
    chain = spark.range(5000).selectExpr("CAST(id + 1 AS INT) AS group_id", "CAST(id AS INT) AS parent_id")
    assert managers.deep_group_with_subgroups(chain, 1).count() == 5000
    assert len(rounds) <= 2 + 2 * 13
    short = chain.where("group_id <= 12")
    assert ids(managers.deep_group_with_subgroups(short, 5)) == list(range(5, 13))
    assert ids(managers.deep_group_with_subgroups(short, 99)) == []
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4), (5, 4), (6, 3)], "group_id int, parent_id int")
    assert ids(managers.deep_group_with_subgroups(cycle, 1)) == [1, 2, 3, 6]
    assert ids(managers.deep_group_with_subgroups(cycle, 4)) == [4, 5]
    diamond = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (4, 2), (None, 1)], "group_id int, parent_id int")
    assert ids(managers.deep_group_with_subgroups(diamond, 1)) == [1, 2, 3, 4, 5]
    assert ids(managers.deep_group_with_subgroups(diamond, 3)) == [3, 4, 5]
    assert ids(managers.deep_group_with_subgroups(diamond.limit(0), 1)) == []


def test_deep_groups_are_those_of_the_lazy_form(spark, staff):
    people, groups = staff
    for group in (0, 3, 9):
        assert ids(managers.managers_of_group(people, groups, group, deep=True)) == ids(managers.managers_of_group(people, groups, group))
