"""References to records that do not exist.

Method: fixpoint cascade.  The direct orphans of every foreign key come from one
join with its target's keys; then the children of orphaned rows are
taken as indirectly orphaned by semi-joins down the foreign-key graph, level by
level, until no level adds a row.  Each level is written to the shared folder, so
plans stay short and a lost executor repeats single tasks.

Scale.  A target is reduced to one row per key before the join.  Whether its
side is broadcast is left to Spark's measured sizes.  A hot key's rows are split
by adaptive execution, and only (row key, time) of referring rows travel.

Defined cases.  A null value refers to nothing.  A row whose time is null is never
``deleted`` or ``late`` and has a null period.  Doubled rows count once.  With
several targets for one key the reference holds if any of them holds at the
time; else it is ``deleted`` if any was deleted by then, else ``late``.  Cycles
end, as a row is taken once.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime as R


@dataclass(frozen=True)
class Reference:
    """A foreign key.  ``rows``: row_key, value, time.  ``targets``: value, created, deleted (either may be null)."""

    table: str
    field: str
    rows: DataFrame
    targets: DataFrame


@dataclass(frozen=True)
class Child:
    """An edge for the cascade.  ``rows``: row_key, parent_key, time of ``table``, whose parents are rows of ``parent``."""

    table: str
    field: str
    parent: str
    rows: DataFrame


def direct(ref: Reference) -> DataFrame:
    """Orphan references: ref_table, ref_field, row_key, state, time."""
    life = F.struct("created", "deleted")
    targets = ref.targets.where("value is not null").groupBy(F.col("value").alias("_v")).agg(F.collect_set(life).alias("lives"))
    rows = ref.rows.where("value is not null").select("row_key", "value", "time").distinct()
    t = rows.join(targets, F.col("value") == F.col("_v"), "left")
    t = t.withColumn("gone", F.expr("exists(lives, x -> coalesce(x.deleted <= time, false))"))
    t = t.withColumn("holds", F.expr("exists(lives, x -> not coalesce(x.deleted <= time, false) and not coalesce(x.created > time, false))"))
    state = F.when(F.col("_v").isNull(), "missing").when(F.col("holds"), None).when(F.col("gone"), "deleted").otherwise("late")
    t = t.withColumn("state", state).where("state is not null")
    return t.select(F.lit(ref.table).alias("ref_table"), F.lit(ref.field).alias("ref_field"), "row_key", "state", "time")


def cascade(references: list[Reference], children: list[Child] = ()) -> DataFrame:
    """Direct and inherited orphans: ref_table, ref_field, row_key, state, time, level.

    Level 0 is direct; a row of level n was reached over a parent of level n - 1.
    An inherited row has the state ``inherited``.
    """
    found = None
    for r in references:
        d = direct(r)
        found = d if found is None else found.unionByName(d)
    found = R.written(found.withColumn("level", F.lit(0)), "orphans")
    level, edge = 0, found
    while children:
        level += 1
        new = None
        for c in children:
            parents = edge.where(F.col("ref_table") == c.parent).select(F.col("row_key").alias("parent_key")).distinct()
            known = found.where(F.col("ref_table") == c.table).select("row_key").distinct()
            rows = c.rows.select("row_key", "parent_key", "time").where("parent_key is not null").join(parents, "parent_key", "left_semi").join(known, "row_key", "left_anti")
            rows = rows.select(F.lit(c.table).alias("ref_table"), F.lit(c.field).alias("ref_field"), "row_key", F.lit("inherited").alias("state"), "time", F.lit(level).alias("level")).distinct()
            new = rows if new is None else new.unionByName(rows)
        edge = R.written(new, f"orphans-{level}")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)
    return found


def by_period(orphans: DataFrame, pattern: str = "yyyy-MM") -> DataFrame:
    """Report per table, field, state and period: rows, direct and inherited."""
    t = orphans.withColumn("period", F.date_format("time", pattern))
    return t.groupBy("ref_table", "ref_field", "state", "period").agg(
        F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("n_direct"),
        F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).alias("n_inherited"),
    )
