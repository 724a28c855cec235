"""Ordered computations that stay distributed when one key holds a large share of the rows.

A plain window puts a whole key into one task. Here every key is cut into chunks of its order (by position, or by a
coarse date), the window runs per (key, chunk), and only one summary row per chunk goes through a per-key window. The
chunk expression must not decrease along the order; equal order values must share a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def position_chunk(position: Column) -> Column:
    return F.floor(position / F.lit(CHUNK_ROWS))


def _columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_running_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str, chunk: Column) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows up to and including this one. ``order`` must be total."""
    cut = df.withColumn("_ord_chunk", chunk).withColumn("_ord_value", value)
    local = Window.partitionBy(*keys, "_ord_chunk").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_ord_chunk").agg(F.sum("_ord_value").alias("_ord_total"))
    earlier = Window.partitionBy(*keys).orderBy("_ord_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_ord_chunk", F.coalesce(F.sum("_ord_total").over(earlier), F.lit(0)).alias("_ord_before"))
    return (
        cut.withColumn("_ord_local", F.sum("_ord_value").over(local))
        .join(offsets, [*keys, "_ord_chunk"])
        .withColumn(out, F.col("_ord_local") + F.col("_ord_before"))
        .drop("_ord_chunk", "_ord_value", "_ord_local", "_ord_before")
    )


def with_row_number(df: DataFrame, keys: list[str], order: list, out: str, chunk: Column) -> DataFrame:
    return with_running_sum(df, keys, order, F.lit(1).cast("long"), out, chunk)


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: Column) -> DataFrame:
    """Add ``values`` (new name -> column) as seen on the previous row of the key; null on its first row."""
    cut = df.withColumn("_ord_chunk", chunk)
    local = Window.partitionBy(*keys, "_ord_chunk").orderBy(*order)
    row = F.struct(*[F.col(v).alias(k) for k, v in values.items()])
    lasts = cut.groupBy(*keys, "_ord_chunk").agg(F.max_by(row, F.struct(*order)).alias("_ord_last"))
    seen = lasts.select(*keys, "_ord_chunk", F.lag("_ord_last").over(Window.partitionBy(*keys).orderBy("_ord_chunk")).alias("_ord_carry"))
    stepped = cut.withColumn("_ord_row", F.lag(row).over(local)).join(seen, [*keys, "_ord_chunk"])
    prev = F.coalesce("_ord_row", "_ord_carry")
    return stepped.withColumns({k: prev[k] for k in values}).drop("_ord_chunk", "_ord_row", "_ord_carry")


def with_last_known(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: Column,
                    before: bool = False) -> DataFrame:
    """Add ``values`` (new name -> column) carried forward over nulls; ``before`` leaves the current row out."""
    cut = df.withColumn("_ord_chunk", chunk)
    local = Window.partitionBy(*keys, "_ord_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ends = cut.groupBy(*keys, "_ord_chunk").agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_end_{k}") for k, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_ord_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_ord_chunk", *[F.last(f"_end_{k}", ignorenulls=True).over(earlier).alias(f"_carry_{k}") for k in values])
    joined = cut.withColumns({f"_here_{k}": F.last(v, ignorenulls=True).over(local) for k, v in values.items()})
    joined = joined.join(carried, [*keys, "_ord_chunk"])
    filled = joined.withColumns({k: F.coalesce(f"_here_{k}", f"_carry_{k}") for k in values})
    return filled.drop("_ord_chunk", *[f"_here_{k}" for k in values], *[f"_carry_{k}" for k in values])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, first in ``order``. The rank limit prunes each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order)))
    return df.withColumn("_ord_rank", rank).where("_ord_rank = 1").drop("_ord_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order)))
    return df.withColumn(out, rank).where(F.col(out) <= k)


def with_max_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunk: Column) -> DataFrame:
    """``out`` = largest ``value`` on the earlier rows of the key; null on its first row."""
    cut = df.withColumn("_ord_chunk", chunk)
    local = Window.partitionBy(*keys, "_ord_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "_ord_chunk").agg(F.max(value).alias("_ord_top"))
    earlier = Window.partitionBy(*keys).orderBy("_ord_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_ord_chunk", F.max("_ord_top").over(earlier).alias("_ord_carry"))
    joined = cut.withColumn("_ord_here", F.max(value).over(local)).join(carried, [*keys, "_ord_chunk"])
    return joined.withColumn(out, F.greatest("_ord_here", "_ord_carry")).drop("_ord_chunk", "_ord_here", "_ord_carry")
