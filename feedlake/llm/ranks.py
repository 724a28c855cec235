"""Positions of rows in a global order, without a window over a whole group.

The rows are dealt by ranges of the order, sorted inside each partition and stored; a row's place in its partition is then
part of the table. Only one row for each pair of group and partition is needed to turn places into positions, so a group
that holds most rows spreads over as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch

PLACE, PART, GROUP, POSITION, MEMBERS = "_place", "_part", "_group", "_position", "_members"


def ranked(df: DataFrame, group: str | None, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``_group`` (a number that ascends with the order of the groups), ``_position`` (from 0 inside the group)
    and ``_members`` (rows of the group).

    ``order`` must start with the group. Rows that are equal in all of it stand next to each other, in a sequence that is
    fixed once they are stored. Without ``group`` all rows are one group. The columns must not have these names.
    """
    tie = F.monotonically_increasing_id()
    first = scratch.store(df.withColumn("_tie", tie), f"{name}-rows")
    keys = [*order, F.col("_tie").asc()]
    dealt = first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn(PLACE, F.monotonically_increasing_id())
    rows = scratch.store(dealt.withColumn(PART, F.shiftright(PLACE, 33)), f"{name}-sorted")
    scratch.drop(f"{name}-rows")
    own = F.col(group) if group else F.lit(0)
    cells = rows.groupBy(own.alias("_own"), PART).agg(F.min(PLACE).alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_own")
    earlier = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "_own", F.col(PART).alias("_cell"), F.min("_from").over(whole).alias(GROUP), F.sum("_n").over(whole).alias(MEMBERS),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"))
    cells = scratch.store(cells, f"{name}-cells")
    same = own.eqNullSafe(F.col("_own")) & (F.col(PART) == F.col("_cell"))
    return rows.join(cells, same).withColumn(POSITION, F.col(PLACE) + F.col("_shift")).drop("_own", "_cell", "_shift", PLACE, PART)
