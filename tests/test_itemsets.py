"""Level-wise item sets against counting all combinations."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from skirmish.operators.itemsets import frequent_itemsets

SCHEMA = "hero int, fold string, items array<bigint>"


def brute(rows, largest, support):
    counts, folds = Counter(), Counter()
    for hero, fold, items in rows:
        for size in range(1, largest + 1):
            for chosen in combinations(sorted(set(items or ())), size):
                counts[hero, chosen] += 1
                folds[hero, chosen, fold] += 1
    return {(h, c): (n, *(folds[h, c, f] for f in ("train", "validation", "test"))) for (h, c), n in counts.items() if n >= support}


def inventories(n, items, held, seed):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, items + 1)
    rows = []
    for _ in range(n):
        chosen = rng.choice(np.arange(100, 100 + items), min(held, items), replace=False, p=weight / weight.sum()).tolist()
        rows.append((int(rng.integers(1, 4)) if rng.random() < 0.6 else 1, str(rng.choice(["train", "validation", "test"])), [int(x) for x in chosen]))
    return rows


@pytest.mark.parametrize(("largest", "support"), [(8, 30), (3, 1), (1, 5)])
def test_equal_to_all_combinations(spark, largest, support):
    rows = inventories(700, 14, 9, largest) + [(1, "train", None), (1, "test", []), (2, "train", [100, 100, 101]), (None, "train", [5, 6]), (None, "test", [5, 6])]
    found = frequent_itemsets(spark.createDataFrame(rows, SCHEMA).repartition(3), "hero", "items", largest, support, "fold").collect()
    got = {(r["hero"], tuple(r["itemset"])): tuple(r)[3:] for r in found}
    assert len(got) == len(found) and got == brute(rows, largest, support)
    assert all(r["size"] == len(r["itemset"]) for r in found)
    assert largest < 8 or max(r["size"] for r in found) >= 6


def test_without_folds_and_without_rows(spark):
    rows = inventories(90, 6, 4, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["hero"], tuple(r["itemset"])): r["support"] for r in frequent_itemsets(df, "hero", "items", 4, 3).collect()}
    assert found == {k: v[0] for k, v in brute(rows, 4, 3).items()}
    assert frequent_itemsets(df.where("false"), "hero", "items", 4, 3).count() == 0
