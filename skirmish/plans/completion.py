"""Completion of a core from what its holders own besides it: all supported additions, their joint counts, and the choice near an economy target."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.models import FOLDS
from skirmish.operators import itemsets, ranking

#: The items that an inventory holds, the width of the economy band and the largest range of shares over the folds.
SLOTS, BAND, SHARE_RANGE = 9, 0.10, 0.10
#: How many of the most frequent additions are looked at; None: all of them.
POOL: int | None = None


def completions(holders: DataFrame, cost: dict[int, int], legal: Callable[[Sequence[int]], bool], target: float | None, maximum: float, support: int = 20) -> DataFrame:
    """(hero_id, additions, joint_matches, <fold>_matches, total_cost, target_distance, within_band, admitted, failed_gates, selected).

    ``holders``: hero_id, fold, core and items (which hold the core) of players. All sets of a hero's other items (of the ``POOL`` most frequent, if that is set) that fill up to ``SLOTS`` places are counted, by
    bitmaps and level by level, and those with ``support`` in every fold are rows, as is the core alone. An admitted one is also legal, costs ``maximum`` at most, and has
    shares over the folds that differ by ``SHARE_RANGE`` at most. ``selected``: of those within ``BAND`` of the target cost (if there is none: of the closest ones) the
    one with most joint support, then by the smallest and the mean support of its items, then the smaller items.
    """
    other = F.array_distinct(F.array_except("items", "core"))
    rows = holders.select("hero_id", "fold", "core", other.alias("items")).persist()
    single = rows.select("hero_id", F.explode("items").alias("item")).groupBy("hero_id", "item").agg(F.count("*").alias("n"))
    pool = single if POOL is None else ranking.top_k(single, ["hero_id"], [F.desc("n"), F.col("item")], POOL)
    pools = pool.groupBy("hero_id").agg(F.collect_set("item").alias("pool"), F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("supports"))
    counts = rows.groupBy("hero_id", "core").agg(F.count("*").alias("support"), *[F.count_if(F.col("fold") == f).alias(f"{f}_support") for f in FOLDS]).persist()
    heroes = counts.join(F.broadcast(pools), "hero_id", "left")  # a row a hero, with the catalogue's items at most
    room = counts.agg(F.max(SLOTS - F.size("core"))).first()[0] or 0
    kept = rows if POOL is None else rows.join(F.broadcast(pools), "hero_id").select("hero_id", "fold", F.array_intersect("items", "pool").alias("items"))
    joint = itemsets.frequent_itemsets(kept, "hero_id", "items", room, 3 * support, "fold", FOLDS)  # less in all is less in some fold
    fields = ["support", *(f"{f}_support" for f in FOLDS)]
    alone = counts.select("hero_id", F.expr("CAST(array() AS array<bigint>)").alias("itemset"), *fields)
    found = joint.select("hero_id", F.col("itemset").cast("array<bigint>").alias("itemset"), *fields).unionByName(alone)
    totals = heroes.select("hero_id", "core", F.col("support").alias("backbone_matches"), "supports", *[F.col(f"{f}_support").alias(f"{f}_total") for f in FOLDS])
    sets = found.join(F.broadcast(totals), "hero_id").where((F.size("core") + F.size("itemset") <= SLOTS) & (F.least(*[F.col(f"{f}_support") for f in FOLDS]) >= support))

    @F.pandas_udf("boolean")
    def can_be_bought(items: pd.Series) -> pd.Series:
        return pd.Series([bool(legal(list(map(int, x)))) for x in items], dtype=bool)

    price = F.create_map(*[F.lit(x) for item in sorted(cost.items()) for x in item]) if cost else F.expr("map(0, 0)")
    whole = F.concat("core", "itemset")
    paid = F.aggregate(whole, F.lit(0).cast("double"), lambda n, x: n + F.coalesce(F.get(F.array(price[x.cast("int")]), F.lit(0)).cast("double"), F.lit(maximum + 1.0)))
    shares = [F.col(f"{f}_support") / F.nullif(F.col(f"{f}_total"), F.lit(0)) for f in FOLDS]
    least = F.aggregate("itemset", F.lit(None).cast("long"), lambda m, x: F.least(m, F.col("supports")[x]))
    mean = F.aggregate("itemset", F.lit(0).cast("long"), lambda n, x: n + F.col("supports")[x]) / F.nullif(F.size("itemset"), F.lit(0))
    priced = sets.withColumns({"total_cost": paid, "least": F.coalesce(least, "backbone_matches"), "mean": F.coalesce(mean, "backbone_matches"), "legal": can_be_bought(whole)})
    failed = F.array_compact(F.array(
        F.when(~F.col("legal"), F.lit("mechanically_legal")), F.when(F.col("total_cost") > maximum, F.lit("within_cohort_wealth")), F.when(F.greatest(*shares) - F.least(*shares) > SHARE_RANGE, F.lit("joint_temporal_stability")),
    ))
    distance = F.abs(F.col("total_cost") - F.lit(target)) if target is not None else F.lit(0.0)
    gated = priced.withColumns({"failed": failed, "target_distance": distance}).withColumns({"admitted": F.size("failed") == 0, "within_band": F.col("target_distance") <= F.lit((target or 0.0) * BAND)})
    # A hero's rows are sets of catalogue items.
    group = Window.partitionBy("hero_id", "admitted")
    eligible = F.col("admitted") & F.when(F.max("within_band").over(group), F.col("within_band")).otherwise(F.col("target_distance") == F.min("target_distance").over(group))
    order = Window.partitionBy("hero_id", "eligible").orderBy(F.desc("support"), F.desc("least"), F.desc("mean"), F.desc(F.transform("itemset", lambda x: -x)))
    chosen = gated.withColumn("eligible", eligible).withColumn("selected", F.col("eligible") & (F.row_number().over(order) == 1))
    return chosen.select(
        "hero_id", F.array_join("itemset", ",").alias("additions"), F.col("support").alias("joint_matches"), *[F.col(f"{f}_support").alias(f"{f}_matches") for f in FOLDS],
        F.col("total_cost").cast("long").alias("total_cost"), "target_distance", "within_band", "admitted", F.array_join("failed", ",").alias("failed_gates"), "selected",
    )
