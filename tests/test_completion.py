"""Completions of a core against trying every set of additions."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from skirmish.plans import completion, policies

FOLDS = ("train", "validation", "test")
CORE = {1: [10, 11], 2: [12]}


def players(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        hero = int(rng.integers(1, 3))
        more = rng.choice(np.arange(20, 30), 5, replace=False, p=np.array([8, 8, 6, 6, 4, 4, 2, 2, 1, 1]) / 42)
        rows.append((hero, str(rng.choice(FOLDS, p=[0.5, 0.25, 0.25])), CORE[hero], [*CORE[hero], *map(int, more)]))
    return rows


def brute(rows, cost, legal, target, maximum, support, pool):
    out = {}
    for hero, core in CORE.items():
        own = [(f, set(items) - set(core)) for h, f, _, items in rows if h == hero]
        n = Counter(i for _, items in own for i in items)
        totals = Counter(f for f, _ in own)
        shortlist = sorted(n, key=lambda i: (-n[i], i))[:pool]
        found = []
        for size in range(completion.SLOTS - len(core) + 1):
            for chosen in combinations(sorted(shortlist), size):
                by_fold = [sum(f == fold and set(chosen) <= items for f, items in own) for fold in FOLDS]
                if min(by_fold) < support:
                    continue
                paid = sum(cost[i] for i in (*core, *chosen))
                shares = [x / totals[f] for x, f in zip(by_fold, FOLDS, strict=True)]
                failed = [name for name, bad in (("mechanically_legal", not legal([*core, *chosen])), ("within_cohort_wealth", paid > maximum), ("joint_temporal_stability", max(shares) - min(shares) > 0.10)) if bad]
                supports = [n[i] for i in chosen] or [len(own)]
                found.append([chosen, by_fold, paid, abs(paid - target), failed, (sum(by_fold), min(supports), sum(supports) / len(supports), tuple(-i for i in chosen))])
        good = [x for x in found if not x[4]]
        near = [x for x in good if x[3] <= target * 0.10] or [x for x in good if x[3] == min(y[3] for y in good)]
        best = max(near, key=lambda x: x[5]) if near else None
        for x in found:
            out[hero, ",".join(map(str, x[0]))] = (sum(x[1]), *x[1], x[2], x[3], not x[4], ",".join(x[4]), x is best)
    return out


@pytest.mark.parametrize(("target", "maximum", "pool"), [(4000, 6000, 20), (100, 6000, 6), (2500, 2600, 20)])
def test_equal_to_all_sets(spark, monkeypatch, target, maximum, pool):
    monkeypatch.setattr(completion, "POOL", pool)
    rows, cost = players(400, target), {i: 300 + 37 * i for i in range(10, 30)}

    def legal(items):
        return not {20, 23} <= set(items)

    df = spark.createDataFrame(rows, "hero_id int, fold string, core array<bigint>, items array<bigint>")
    found = completion.completions(df, cost, legal, target, maximum, 8).collect()
    got = {(r["hero_id"], r["additions"]): tuple(r[c] for c in ("joint_matches", "train_matches", "validation_matches", "test_matches", "total_cost", "target_distance", "admitted", "failed_gates", "selected")) for r in found}
    assert len(got) == len(found) and got == brute(rows, cost, legal, target, maximum, 8, pool)
    assert max(r["additions"].count(",") for r in found) >= 1


def test_no_holders(spark):
    df = spark.createDataFrame([], "hero_id int, fold string, core array<bigint>, items array<bigint>")
    assert completion.completions(df, {10: 5}, lambda _: True, 100, 1000).count() == 0


def test_additions_beyond_the_twentieth_count(spark):
    """a rare item's sets are found as well, however many items are more frequent."""
    rng = np.random.default_rng(3)
    rows = [(1, FOLDS[k % 3], CORE[1], [*CORE[1], *map(int, 20 + rng.choice(22, 4, replace=False))]) for k in range(900)] + [(1, FOLDS[k % 3], CORE[1], [*CORE[1], 90, 91]) for k in range(36)]
    cost = {i: 300 for i in range(100)}
    df = spark.createDataFrame(rows, "hero_id int, fold string, core array<bigint>, items array<bigint>")
    found = {r["additions"]: r["joint_matches"] for r in completion.completions(df, cost, lambda _: True, 1200, 6000, 8).collect()}
    assert found["90,91"] == 36
    held = Counter((f, ",".join(map(str, c))) for _, f, core, items in rows for n in range(5) for c in combinations(sorted(set(items) - set(core)), n))
    assert found == {x: sum(held[f, x] for f in FOLDS) for _, x in held if min(held[f, x] for f in FOLDS) >= 8}


def test_bundles_beyond_the_256th_count(spark, monkeypatch):
    """of 276 pairs only the least frequent one is in all folds, and it is the backbone that is completed."""
    pairs = list(combinations(range(1, 25), 2))
    rows = [(1, "train", list(p)) for p in pairs[:-1] for _ in range(40)] + [(1, f, list(pairs[-1])) for f in FOLDS for _ in range(12)]
    rows += [(1, f, [1]) for f in ("validation", "test") for _ in range(2000)]
    monkeypatch.setattr(policies, "inventories", lambda t: spark.createDataFrame(rows, "hero_id int, fold string, items array<bigint>"))
    monkeypatch.setattr(policies, "catalogue", lambda t: ({}, dict.fromkeys(range(1, 25), 500), set()))
    assert [tuple(r) for r in policies.backbones(None, (2,), fold_support=3).collect()] == [(1, "23,24", 2, 36, 12)]
