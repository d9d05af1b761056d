"""Support of item combinations, and pairwise precedence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def frequent_only(inventories: DataFrame, by: Sequence[str], items: str, support: int) -> DataFrame:
    """Inventories without the items that fewer than ``support`` of their group hold: no combination with such an item can reach it, so dropping them is exact."""
    held = inventories.select(*by, F.explode(F.array_distinct(items)).alias("item"))
    frequent = held.groupBy(*by, "item").agg(F.count("*").alias("n")).where(F.col("n") >= support).groupBy(*by).agg(F.collect_set("item").alias("__frequent"))
    # A row a group with at most as many items as there are: the catalogue bounds it.
    return inventories.join(frequent, list(by)).withColumn(items, F.array_sort(F.array_intersect(items, "__frequent"))).drop("__frequent")


def itemset_support(inventories: DataFrame, by: Sequence[str], items: str, size: int, support: int = 20, fold: str | None = None) -> DataFrame:
    """(by, itemset, support[, <fold>_support]): how many inventories hold each combination of ``size`` distinct items.

    Combinations are made in Arrow batches, one inventory at a time, and counted by Spark with partial aggregation.
    """
    kept = frequent_only(inventories.select(*by, *([fold] if fold else []), items), by, items, support).where(F.size(items) >= size)
    carried = [*by, *([fold] if fold else [])]
    schema = kept.select(*carried, F.col(items).alias("itemset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, sets = [], []
            for row, held in enumerate(batch.column(items).to_pylist()):
                for found in combinations(held, size):
                    which.append(row)
                    sets.append(found)
                if len(sets) > 1 << 16:
                    yield _made(batch, which, sets)
                    which, sets = [], []
            if sets:
                yield _made(batch, which, sets)

    def _made(batch: pa.RecordBatch, which: list[int], sets: list[tuple]) -> pa.RecordBatch:
        at = pa.array(which)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in carried], pa.array(sets, batch.column(items).type)], [*carried, "itemset"])

    made = kept.mapInArrow(run, schema)
    folds = [F.count_if(F.col(fold) == f).alias(f"{f}_support") for f in ("train", "validation", "test")] if fold else []
    return made.groupBy(*by, "itemset").agg(F.count("*").alias("support"), *folds).where(F.col("support") >= support)


def _candidates(frequent: set[tuple]) -> list[tuple]:
    """Sets of one item more whose subsets are all frequent: two that share all but their last item are joined, and then pruned."""
    by_prefix: dict[tuple, list] = {}
    for found in sorted(frequent):
        by_prefix.setdefault(found[:-1], []).append(found[-1])
    joined = ((*prefix, x, y) for prefix, last in by_prefix.items() for x, y in combinations(last, 2))
    return [c for c in joined if all(c[:i] + c[i + 1 :] in frequent for i in range(len(c) - 2))]


def frequent_itemsets(inventories: DataFrame, by: str, items: str, largest: int, support: int = 20, fold: str | None = None, folds: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """(by, size, itemset, support[, <fold>_support]): the sets of up to ``largest`` items that at least ``support`` inventories of a group hold, each with its exact count.

    Level by level: the frequent sets of a size are joined to candidates of the next. A pass counts all candidates of a level: each Arrow batch of inventories is turned into a bitmap
    for each item, and a candidate's count is the number of bits that its items' bitmaps share, so no inventory is ever exploded into its combinations. Candidates and counts are as
    many as frequent sets, which catalogue and floor bound; these pass the driver, inventories don't. A null or empty inventory counts nowhere, repeated items count once.
    """
    spark, kind = inventories.sparkSession, inventories.schema[by].dataType
    rows = inventories.select(by, *([fold] if fold else []), F.array_distinct(items).alias(items)).where(F.size(items) > 0).persist()
    counts = 1 + (len(folds) if fold else 0)
    out: list[tuple] = []

    def counted(level: dict[object, list[tuple]]) -> dict[tuple, np.ndarray]:
        known = {g: (sorted({i for c in sets for i in c}), sets) for g, sets in level.items() if sets}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {g: np.zeros((len(sets), counts), np.int64) for g, (_, sets) in known.items()}
            places = {g: np.searchsorted(universe, np.array(sets)) for g, (universe, sets) in known.items()}
            for batch in batches:
                group, flat = np.array(batch.column(by).to_pylist(), object), batch.column(items).flatten().to_numpy()
                at = batch.column(items).offsets.to_numpy() - batch.column(items).offsets[0].as_py()
                row = np.repeat(np.arange(len(group)), np.diff(at))
                which = np.array(batch.column(fold).to_pylist(), object) if fold else None
                for g, (universe, _) in known.items():
                    own = np.flatnonzero(group == g)
                    mine = np.isin(row, own)
                    item = np.minimum(np.searchsorted(universe, flat[mine]), len(universe) - 1)
                    hit = np.array(universe)[item] == flat[mine]
                    held = np.zeros((len(universe), len(own)), bool)
                    held[item[hit], np.searchsorted(own, row[mine][hit])] = True
                    bits = np.packbits(held, axis=1)
                    masks = [np.packbits(which[own] == f) for f in folds] if fold else []
                    for a in range(0, len(places[g]), 4096):
                        both = np.bitwise_and.reduce(bits[places[g][a : a + 4096]], axis=1)
                        for k, part in enumerate([both, *(both & m for m in masks)]):
                            total[g][a : a + 4096, k] += np.bitwise_count(part).sum(axis=1, dtype=np.int64)
            for g, n in total.items():
                some = np.flatnonzero(n[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), group_type), pa.array(some), *(pa.array(n[some, k]) for k in range(counts))], [by, "candidate", *(f"n{k}" for k in range(counts))])

        schema = f"{by} {kind.simpleString()}, candidate long, " + ", ".join(f"n{k} long" for k in range(counts))
        sums = rows.mapInArrow(run, schema).groupBy(by, "candidate").agg(*[F.sum(f"n{k}") for k in range(counts)]).collect()
        return {(r[0], known[r[0]][1][r[1]]): np.array(r[2:]) for r in sums}

    try:
        group_type = to_arrow_type(kind)
        single = rows.select(by, F.explode(items).alias("item")).groupBy(by, "item").agg(F.count("*").alias("n")).where(F.col("n") >= support).collect()
        level: dict[object, list[tuple]] = {}
        for r in sorted(single, key=lambda r: r["item"]):
            level.setdefault(r[by], []).append((r["item"],))
        for size in range(1, largest + 1):
            found: dict[object, set[tuple]] = {}
            for (g, chosen), n in (counted(level) if any(level.values()) else {}).items():
                if n[0] >= support:
                    found.setdefault(g, set()).add(chosen)
                    out.append((g, size, list(chosen), *map(int, n)))
            level = {g: _candidates(sets) for g, sets in found.items()}
    finally:
        rows.unpersist()
    names = ["support", *(f"{f}_support" for f in folds if fold)]
    return spark.createDataFrame(out, f"{by} {kind.simpleString()}, size int, itemset {inventories.schema[items].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def containing(inventories: DataFrame, items: str, required: Sequence[int]) -> DataFrame:
    """Inventories that hold all of ``required``."""
    return inventories.where(F.size(F.array_except(F.array(*map(F.lit, required)), F.col(items))) == 0)


def pair_precedence(purchases: DataFrame, by: Sequence[str], owner: Sequence[str], item: str, time: str) -> DataFrame:
    """(by, first_item, second_item, first_earlier, second_earlier): of owners of both items, how many bought which strictly earlier.

    One array an owner (bounded by the catalogue) and a fold of it into pairs, instead of a self-join.
    """
    bought = purchases.groupBy(*by, *owner).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(time).alias("t")))).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x: F.transform(F.filter("b", lambda y: y["i"] > x["i"]), lambda y: F.struct(x["i"].alias("first_item"), y["i"].alias("second_item"), F.signum(y["t"] - x["t"]).alias("s")))))
    return bought.select(*by, F.inline(pairs)).groupBy(*by, "first_item", "second_item").agg(F.count_if(F.col("s") > 0).alias("first_earlier"), F.count_if(F.col("s") < 0).alias("second_earlier"))
