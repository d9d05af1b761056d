"""Ranking, rank correlation and agreement of orderings, one row a group out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1 000 by default) Spark filters by rank before its shuffle, so a group's size doesn't matter."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def average_rank(group: Sequence[str], value: str) -> Column:
    """Rank with ties at the average of their places."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, spearman): Pearson's correlation of average ranks over rows where both are known.

    Groups below ``least`` rows are left out; a constant side gives null. Nine decimals, so that an engine's order of summation doesn't show.
    """
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, average_rank(group, x).alias("rx"), average_rank(group, y).alias("ry"))
    varied = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    sums = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), varied.alias("varied"),
        F.sum(F.col("rx") * F.col("ry")).alias("xy"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("ry") * F.col("ry")).alias("yy"),
    )
    n = F.col("n")
    top = n * F.col("xy") - F.col("sx") * F.col("sy")
    spread = (n * F.col("xx") - F.col("sx") * F.col("sx")) * (n * F.col("yy") - F.col("sy") * F.col("sy"))
    return sums.where(n >= least).select(*group, "n", F.when(F.col("varied"), F.round(top / F.sqrt(spread), 9) + 0.0).alias("spearman"))


def top_k_jaccard(df: DataFrame, group: Sequence[str], x: str, y: str, identity: str, k: int = 10) -> DataFrame:
    """(group, jaccard): shared part of the ``k`` largest by ``x`` and by ``y``; ties to the smaller ``identity``."""
    w = Window.partitionBy(*group)
    first = F.row_number().over(w.orderBy(F.desc_nulls_last(x), identity)) <= k
    second = F.row_number().over(w.orderBy(F.desc_nulls_last(y), identity)) <= k
    marked = df.select(*group, first.alias("a"), second.alias("b"))
    return marked.groupBy(*group).agg((F.count_if(F.col("a") & F.col("b")) / F.count_if(F.col("a") | F.col("b"))).alias("jaccard"))


def percentile_by_tier(df: DataFrame, tier: Sequence[str], order: Sequence[Column], name: str = "percentile") -> DataFrame:
    """Place in the order as a share of the last place: 0 to 1, ties broken by the order's later keys, 0 for a row alone."""
    w = Window.partitionBy(*tier)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn(name, place / F.greatest(F.lit(1), F.count("*").over(w) - 1))


def comparators(df: DataFrame, group: Sequence[str], identity: str, weight: str, columns: Sequence[str]) -> DataFrame:
    """Adds to each row ``other_<column>`` of the group's weightiest *other* row (ties to the smaller ``identity``); null for a row alone.

    That is the group's first row, or its second for the first itself, so two rows a group are enough for all.
    """
    w = Window.partitionBy(*group)
    order = w.orderBy(F.desc(weight), identity)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*columns)
    ranked = df.withColumns({"__first": F.first(row).over(whole), "__second": F.nth_value(row, 2).over(whole), "__place": F.row_number().over(order)})
    other = F.when(F.col("__place") == 1, F.col("__second")).otherwise(F.col("__first"))
    return ranked.select(*df.columns, *[other[c].alias(f"other_{c}") for c in columns])


def side_by_side(df: DataFrame, key: Sequence[str], label: str, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys that have a row under each of two ``values`` of ``label``, with ``columns`` of the first and, as ``<column>_test``, of the second.

    One aggregation instead of a self-join, so what stands below is worked out once.
    """
    row = F.struct(*columns)
    sides = [F.first(F.when(F.col(label) == v, row), ignorenulls=True).alias(f"__{k}") for k, v in enumerate(values)]
    both = df.where(F.col(label).isin(*values)).groupBy(*key).agg(*sides).where("__0 IS NOT NULL AND __1 IS NOT NULL")
    return both.select(*key, *[F.col("__0")[c].alias(c) for c in columns], *[F.col("__1")[c].alias(f"{c}_test") for c in columns])
