"""As-of joins without a quadratic inequality join: one shuffle on the equality keys and one sort by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """LEFT, backward, inclusive as-of join: each left row gets ``columns`` of the latest right row with equal keys and ``right_time <= left_time``.

    Both sides go into one relation, right rows before left rows of the same time, and the last right row seen so far is
    carried forward as one struct, so its columns come from the same row and its nulls stay nulls. Right rows of one time are ordered by ``tie``. Null keys
    match nothing. Only a key's rows share a partition, so a dominant key should be made finer (here matches are).
    """
    found = F.struct(*columns)
    tied = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    lefts = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    rights = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), found.alias("__right"), tied.alias("__tie"))
    keys = [f"__k{i}" for i in range(len(on))]
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    carried = both.withColumn("__got", F.last(F.when(usable, F.col("__right")), ignorenulls=True).over(order)).where("__side = 1")
    return carried.select("__left.*", *[F.when(usable, F.col("__got")[c]).alias(c) for c in columns])


def asof_join_sides(left: DataFrame, right: DataFrame, on: Sequence[str], side: str, sides: Sequence[int], left_time: str, right_time: str, columns: Sequence[str], pick: dict[str, Column]) -> DataFrame:
    """Several as-of joins against the same right side in one pass: the latest right row of *each* value of ``side`` is carried along.

    ``pick``: prefix -> expression over the left row that gives the side wanted. Adds ``<prefix><column>`` for each.
    """
    lefts = left.select(*on, F.col(left_time).alias("__t"), F.lit(1).alias("__rank"), F.struct(*left.columns).alias("__left"), *[v.alias(f"__pick_{p}") for p, v in pick.items()])
    rights = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__rank"), F.col(side).alias("__side"), F.struct(*columns).alias("__right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy("__t", "__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in sides:
        both = both.withColumn(f"__last_{s}", F.last(F.when(F.col("__side") == s, F.col("__right")), ignorenulls=True).over(order))
    kept = both.where("__rank = 1")

    def chosen(prefix: str, column: str) -> Column:
        value = F.lit(None)
        for s in sides:
            value = F.when(F.col(f"__pick_{prefix}") == s, F.col(f"__last_{s}")[column]).otherwise(value)
        return value.alias(f"{prefix}{column}")

    return kept.select("__left.*", *[chosen(p, c) for p in pick for c in columns])


def last_observed(times: str, values: str, at: Column) -> Column:
    """Last observation carried forward within one row's parallel, time-sorted arrays: struct (time, value), null before the first."""
    seen = F.filter(F.arrays_zip(F.col(times).alias("time"), F.col(values).alias("value")), lambda x: x["time"] <= at)
    return F.try_element_at(seen, F.lit(-1))


def latest_by_time(times: str, values: str, at: Column) -> Column:
    """As :func:`last_observed` for arrays in any order: the value with the largest time not after ``at``."""
    return F.array_max(F.filter(F.arrays_zip(F.col(times).alias("time"), F.col(values).alias("value")), lambda x: x["time"] <= at))
