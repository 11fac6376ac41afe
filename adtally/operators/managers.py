"""Manager groups and the manager scope of a report or search.

A scope is a one-column frame of manager ids. ``None``, and also a frame without rows, is no
restriction. Nothing is computed while a scope is put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.session import checkpointed

MAX_DEPTH = 1000


def group_with_subgroups(manager_groups: DataFrame, group_id: int) -> DataFrame:
    """``group_id`` of the group itself and of every group below it.

    Groups that are below themselves end the way down. More than ``MAX_DEPTH`` levels are an error;
    ``deep_group_with_subgroups`` has no such limit.
    """
    return manager_groups.sparkSession.sql(
        f"""
        WITH RECURSIVE below(group_id, way) MAX RECURSION LEVEL {MAX_DEPTH} AS (
            SELECT group_id, array(group_id) FROM {{groups}} WHERE group_id = :root
            UNION ALL
            SELECT child.group_id, array_append(below.way, child.group_id) FROM below JOIN {{groups}} AS child
                ON child.parent_id = below.group_id AND NOT array_contains(below.way, child.group_id)
        )
        SELECT DISTINCT group_id FROM below
        """,
        args={"root": group_id},
        groups=manager_groups,
    )


def deep_group_with_subgroups(manager_groups: DataFrame, group_id: int) -> DataFrame:
    """The rows of ``group_with_subgroups`` for a tree of any depth, by path doubling.

    Each round doubles the ways up: those of n steps, put after each other, are those of 2n steps, and groups whose way leads
    to one that was found are found. The rounds grow with the logarithm of the depth, or of the number of groups
    where groups are below themselves. A round has a row for each group and each different group that is so many steps above it,
    which is one row a group in a tree. Unlike the lazy form it runs jobs, whose rows are stored in the checkpoint folder.
    """
    named = manager_groups.select("group_id", "parent_id").where("group_id IS NOT NULL")
    up = checkpointed(named.where("parent_id IS NOT NULL").select("group_id", F.col("parent_id").alias("above")).distinct())
    found = checkpointed(named.where(F.col("group_id") == group_id).select("group_id").distinct())
    groups, steps = up.select("group_id").distinct().count(), 1
    while steps <= groups and not up.isEmpty():
        reached = up.join(found.withColumnRenamed("group_id", "above"), "above", "left_semi").select("group_id")
        found = checkpointed(found.unionByName(reached).distinct())
        further = up.select(F.col("group_id").alias("above"), F.col("above").alias("top"))
        up = checkpointed(up.join(further, "above").select("group_id", F.col("top").alias("above")).distinct())
        steps *= 2
    return found


def managers_of_group(managers: DataFrame, manager_groups: DataFrame, group_id: int, deep: bool = False) -> DataFrame:
    """``manager_id`` of the managers in a group and its subgroups; ``deep`` is for trees of any depth and runs jobs."""
    groups = (deep_group_with_subgroups if deep else group_with_subgroups)(manager_groups, group_id)
    return managers.join(groups, "group_id", "left_semi").select(F.col("id").alias("manager_id"))


def listed(scope: DataFrame) -> DataFrame:
    """The different managers of a scope."""
    return scope.toDF("manager_id").where("manager_id IS NOT NULL").distinct()


def of_managers(df: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows of ``df`` whose ``manager_id`` is in the scope."""
    return df if scope is None else kept_by(df, "manager_id", listed(scope), listed(scope))


def kept_by(df: DataFrame, key: str, keys: DataFrame, unless_empty: DataFrame) -> DataFrame:
    """Rows of ``df`` with a key in the one-column frame ``keys``, or all if ``unless_empty`` has no rows."""
    return df.sparkSession.sql(
        f"""
        SELECT * FROM {{df}}
        WHERE {key} IN (SELECT * FROM {{keys}}) OR NOT EXISTS (SELECT 1 FROM {{scope}})
        """,
        df=df,
        keys=keys,
        scope=unless_empty,
    )


def scope_or_previous(chosen: DataFrame, previous: DataFrame | None) -> DataFrame:
    """The chosen managers, or the previous scope when none was chosen.

    Both are gathered in one aggregate, as lists of different managers, so the group tree is walked once.
    """
    if previous is None:
        return chosen.toDF("manager_id")
    both = chosen.toDF("manager_id").withColumn("is_chosen", F.lit(True))
    both = both.unionByName(previous.toDF("manager_id").withColumn("is_chosen", F.lit(False)))
    lists = both.agg(
        F.collect_set(F.when(F.col("is_chosen"), F.col("manager_id"))).alias("chosen"),
        F.collect_set(F.when(~F.col("is_chosen"), F.col("manager_id"))).alias("previous"),
    )
    kept = F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.col("previous"))
    return lists.select(F.explode(kept).alias("manager_id"))


def narrow_to_manager(
    manager_id: int, previous: DataFrame | None, allowed: DataFrame | None = None
) -> DataFrame | None:
    """Scope after one manager was picked.

    ``allowed`` are the managers the person may pick from; ``None`` means any manager. Id 0
    and ids outside ``allowed`` leave the previous scope as it is.
    """
    if manager_id == 0:
        return previous
    picked = F.lit(manager_id).cast("long").alias("manager_id")
    if allowed is None:
        return SparkSession.active().range(1).select(picked)
    chosen = allowed.toDF("manager_id").where(F.col("manager_id") == manager_id)
    return scope_or_previous(chosen, previous)
