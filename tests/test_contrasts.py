"""Models and contrasts as grouped sums over all rows, against the numpy versions over whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.functions import models, newton
from skirmish.operators import quantiles
from skirmish.operators.quantiles import exact_quantiles
from skirmish.plans import contrasts

FEATURES = ["a", "b", "c"]


def decisions(sizes, seed=3):
    """Rows (hero_id, match_id, fold, item_id, y, a, b, c) of heroes with these many decisions each between two items."""
    rng = np.random.default_rng(seed)
    rows = []
    for hero, n in sizes.items():
        x = rng.standard_normal((n, 3)) * [1, 50, 1e4] + [0, 10, 2e5]
        took = rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))
        won = rng.random(n) < 0.5 + 0.2 * took - 0.1 * (x[:, 0] > 0)
        fold = np.array(models.FOLDS)[rng.integers(0, 3, n)]
        match = 1000 * hero + rng.integers(0, max(2, n // 3), n)
        for k in range(n):
            values = [None if rng.random() < 0.1 and j else float(v) for j, v in enumerate(x[k])]
            rows.append((hero, int(match[k]), str(fold[k]), 7 if took[k] else 8, int(won[k]), *values))
    return rows


SCHEMA = "hero_id int, match_id long, fold string, item_id long, y int, a double, b double, c double"


def matrix(rows):
    return np.array([[np.nan if v is None else v for v in r[5:]] for r in rows], float)


def test_models_equal_those_of_whole_groups(spark):
    rows = decisions({1: 4000, 2: 60, 3: 25})  # one group has almost all rows
    rows += [(4, k, "train", 7, 1, float(k), None, 0.0) for k in range(5)]  # one outcome only
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = newton.fit(df, ["hero_id"], FEATURES, "y")
    assert set(fitted) == {(1,), (2,), (3,), (4,)}
    for (hero,), m in fitted.items():
        own = [r for r in rows if r[0] == hero]
        x, y = matrix(own), np.array([r[4] for r in own], float)
        scored = df.where(F.col("hero_id") == hero).join(newton.model_table(df, {(hero,): m}, ["hero_id"], 3), "hero_id")
        got = sorted(r["p"] for r in scored.select(newton.probability(FEATURES).alias("p")).collect())
        assert np.allclose(got, np.sort(models.probabilities(x, y, x)), atol=1e-6)


def test_contrast_equals_the_one_of_a_whole_group(spark):
    rows = decisions({1: 1500, 2: 200})
    rows += [(3, k, "train", 7 + k % 2, k % 2, 0.0, 1.0, 2.0) for k in range(9)]  # no rows to test on
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(h, h, 7, 8) for h in (1, 2, 3, 4)], "pair_id int, hero_id int, treatment_item_id long, comparator_item_id long")
    found = {r["pair_id"]: r.asDict() for r in contrasts.contrasts(df, pairs, FEATURES).collect()}
    part = {r["m"]: r["p"] for r in df.select(F.col("match_id").alias("m"), contrasts.part_of(F.col("match_id")).alias("p")).distinct().collect()}
    for hero in (1, 2):
        own = [r for r in rows if r[0] == hero]
        match = np.array([r[1] for r in own])
        want = models.dr_contrast(matrix(own), np.array([r[3] == 7 for r in own], int), np.array([r[4] for r in own]), match, np.array([r[2] for r in own]), part=np.array([part[m] for m in match]))
        for name in contrasts.RESULT:
            assert found[hero][name] == (pytest.approx(want[name], abs=1e-5) if isinstance(want[name], float) else want[name]), name
    for hero in (3, 4):
        assert found[hero]["failed_gates"] == "estimability" and found[hero]["estimate"] is None and not found[hero]["admitted"]


def test_no_row_is_left_out_of_a_large_group(spark):
    rows = decisions({1: 6000, 2: 90}, seed=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    pairs = spark.createDataFrame([(h, h, 7, 8) for h in (1, 2)], "pair_id int, hero_id int, treatment_item_id long, comparator_item_id long")
    for r in contrasts.contrasts(df, pairs, FEATURES).collect():
        assert r["support"] + r["comparison_support"] == sum(x[0] == r["pair_id"] for x in rows)


@pytest.mark.parametrize(("few", "ranges"), [(4096, 4096), (3, 4)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = np.random.default_rng(1)
    groups = {"many": rng.standard_normal(700) * 1e6, "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 50), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), None: rng.integers(0, 9, 40).astype(float)}
    rows = [(g, float(v), int(v) if g != "one" else None) for g, x in groups.items() for v in x] + [("many", None, None), ("many", float("nan"), None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = exact_quantiles(df, ["g"], ["v", "i"], shares)
    assert ("none",) not in found and ("i", 0.5) not in found[("one",)]
    for g, x in groups.items():
        for p in shares:
            assert found[(g,)]["v", p] == pytest.approx(np.quantile(x, p), rel=1e-12)
            if g != "one":
                assert found[(g,)]["i", p] == pytest.approx(np.quantile(x.astype(int), p), rel=1e-12)
    assert exact_quantiles(df, [], ["v"], (0.5,))[()]["v", 0.5] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert exact_quantiles(df.where("false"), [], ["v"], (0.5,)) == {}
