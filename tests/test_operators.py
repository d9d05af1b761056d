from itertools import permutations
"""Operators and kernels on small inputs with known results."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish.functions import models, stats
from skirmish.operators import itemsets, paths, ranking, replay
from skirmish.operators.asof import asof_join, last_observed, latest_by_time
from skirmish.plans import kernels, policies
from skirmish.plans.analytics import same_opportunity_comparators, with_residual
from skirmish.plans.cohort import Cohort, admitted, phase_of
from skirmish.sources import io


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# -- cohort -----------------------------------------------------------------------------------------------------------------


def match(k, players=12, eligible=True, duration=1800):
    return [(k, s + 1, "Team0" if s < players / 2 else "Team1", "Win" if s < players / 2 else "Loss", eligible or s > 0, "Ranked", "Normal", "2026-08-16 10:00:00", duration, 90) for s in range(players)]


def test_only_whole_eligible_matches_that_ended_in_time_are_admitted(spark):
    data = match(1) + match(2, 6) + match(3, 10) + match(4, eligible=False) + match(5, duration=200_000)
    df = spark.createDataFrame(data, "match_id int, player_slot int, team string, player_match_outcome string, rewards_eligible boolean, match_mode string, game_mode string, start_time string, duration_s int, average_badge int")
    cohort = Cohort(since="2026-08-16 00:00:00", as_of="2026-08-17 00:00:00")
    got = admitted(df.withColumn("start_time", F.col("start_time").cast("timestamp")), cohort)
    assert [r["match_id"] for r in got.collect()] == [1]


@pytest.mark.parametrize(("seconds", "phase"), [(0, 0), (539, 0), (540, 1), (1199, 1), (1200, 2), (1799, 2), (1800, 3)])
def test_phases(spark, seconds, phase):
    assert one(spark, phase_of(F.lit(seconds)).alias("p"))["p"] == phase


# -- as-of ------------------------------------------------------------------------------------------------------------------


def test_asof_is_backward_inclusive_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 100, "a"), (1, 30, "b"), (2, 60, "c"), (None, 60, "d"), (1, None, "e")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 60, 1000, 1), (1, 120, 2000, 1), (2, 60, None, 1), (2, 60, 7, 2), (None, 10, 5, 1)], "k int, s int, w int, n int")
    got = {r["v"]: r["w"] for r in asof_join(left, right, ["k"], "t", "s", ["w"], tie=["n"]).collect()}
    assert got == {"a": 1000, "b": None, "c": 7, "d": None, "e": None}


def test_asof_carries_one_row_not_one_value(spark):
    left = spark.createDataFrame([(1, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, 5, 6), (1, 2, None, 8)], "k int, s int, x int, y int")
    assert asof_join(left, right, ["k"], "t", "s", ["x", "y"]).first()[2:] == (None, 8)


def test_last_observed(spark):
    df = spark.createDataFrame([([60, 120], [1000, 2000])], "t array<int>, v array<int>")
    row = df.select(last_observed("t", "v", F.lit(100))["value"].alias("a"), last_observed("t", "v", F.lit(30)).alias("b"), latest_by_time("t", "v", F.lit(120))["value"].alias("c")).first()
    assert row["a"] == 1000 and row["b"] is None and row["c"] == 2000


# -- statistics -------------------------------------------------------------------------------------------------------------


def test_wilson(spark):
    low, high = stats.wilson(F.lit(55), F.lit(100))
    none = stats.wilson(F.lit(0), F.lit(0))
    r = one(spark, low.alias("a"), high.alias("b"), none[0].alias("c"), none[1].alias("d"))
    assert r["a"] == pytest.approx(0.452, abs=1e-3) and r["b"] == pytest.approx(0.644, abs=1e-3) and (r["c"], r["d"]) == (0, 0)


@pytest.mark.parametrize(("ends", "want"), [((0.0, 4.0, 2.0, 6.0), 2 / 6), ((0.0, 1.0, 2.0, 3.0), 0.0), ((1.0, 1.0, 1.0, 1.0), 1.0), ((None, 1.0, 0.0, 1.0), None)])
def test_interval_overlap(spark, ends, want):
    got = one(spark, stats.interval_overlap(*[F.lit(x).cast("double") for x in ends]).alias("x"))["x"]
    assert got == (pytest.approx(want) if want is not None else None)


def test_poisson_binomial(spark):
    p = F.array(F.lit(0.5), F.lit(0.5))
    r = one(spark, stats.poisson_binomial_tail(p, F.lit(1)).alias("a"), stats.poisson_binomial_tail(p, F.lit(2)).alias("b"))
    assert (r["a"], r["b"]) == (0.75, 0.25)


def test_beta_prior_and_posterior():
    cells = [(45, 100), (52, 100), (48, 100), (55, 100)]
    prior = models.fit_beta_prior(*zip(*cells, strict=True))
    assert 0 < prior.alpha <= 500 and 0 < prior.beta <= 500 and 5 <= prior.strength <= 500 and prior.mean == pytest.approx(0.5)
    assert models.fit_beta_prior([1], [2]).source == "pooled-fallback"
    spread = models.fit_beta_prior([5, 90, 30, 60, 10, 80], [100] * 6)
    assert spread.strength == pytest.approx(5.0, abs=1.0)
    mean, low, high = models.beta_posterior(55, 100, prior)
    assert low < mean < high and 0.5 < mean < 0.55


def test_beta_quantiles():
    assert models.beta_ppf(0.5, 1, 1) == pytest.approx(0.5)
    assert models.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-4)
    for a, b in ((0.5, 0.5), (30, 70), (400, 200)):
        for p in (0.025, 0.5, 0.975):
            assert models.beta_cdf(models.beta_ppf(p, a, b), a, b) == pytest.approx(p, abs=1e-9)


def test_logistic_fit_is_a_stationary_point():
    rng = np.random.default_rng(0)
    x, c = rng.standard_normal((300, 4)), 0.5
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1, -1, 0.5, 0]))).astype(float)
    w = models.logistic_fit(x, y, c)
    p = models.logistic_predict(w, x)
    assert abs(w[:-1] + c * x.T @ (p - y)).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_scaler_imputes_medians_and_flags():
    x = np.array([[1.0, np.nan], [3.0, 4.0], [100.0, 6.0]])
    s = models.Scaler(x, indicators=True)
    out = s(x)
    assert out.shape == (3, 3) and np.allclose(out.mean(axis=0), 0) and np.allclose(out.std(axis=0), 1)


def test_doubly_robust_contrast_of_no_effect():
    n = 800
    rng = np.random.default_rng(1)
    fold = np.repeat(models.FOLDS, n)
    treated = np.tile([0, 1], 3 * n // 2)
    y = np.tile([0.0, 0.0, 1.0, 1.0], 3 * n // 4)
    got = models.dr_contrast(rng.standard_normal((3 * n, 3)), treated, y, np.arange(3 * n), fold)
    assert got["overlap"] == 1 and got["effective_support"] > 2000 and abs(got["estimate"]) < 0.03 and got["support"] == 1200
    assert got["maximum_smd"] < 0.1 and got["low"] < 0 < got["high"]
    assert models.dr_contrast(np.zeros((3, 1)), np.array([1, 0, 1]), np.zeros(3), np.arange(3), np.array(["train"] * 3)) is None


def test_longest_common_subsequence():
    assert models.longest_common_subsequence([1, 2, 3, 4], [2, 1, 3, 5, 4]) == 3


def test_two_means_find_two_groups():
    x = np.vstack([np.zeros((20, 3)), np.ones((30, 3))])
    labels, centres = models.two_means(x)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1] and sorted(centres.sum(axis=1)) == [0, 3]


# -- rankings ---------------------------------------------------------------------------------------------------------------


def test_spearman_with_ties_and_constants(spark):
    data = [("a", k, float(k // 2), float(k)) for k in range(6)] + [("b", k, 1.0, float(k)) for k in range(4)] + [("c", 0, 1.0, 2.0)]
    got = {r["g"]: r["spearman"] for r in ranking.spearman(spark.createDataFrame(data, "g string, i int, x double, y double"), ["g"], "x", "y").collect()}
    rx, ry = np.array([1.5, 1.5, 3.5, 3.5, 5.5, 5.5]), np.arange(1, 7)
    assert got["a"] == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and got["b"] is None and "c" not in got


def test_comparator_is_the_most_observed_other(spark):
    cells = spark.createDataFrame(
        [("s", 1, 2, 0, 1, 10, 400, 0.6, 0.10), ("s", 1, 2, 0, 1, 11, 300, 0.4, -0.05), ("s", 1, 3, 0, 1, 10, 50, 0.5, 0.0)],
        "scope string, hero_id int, enemy_hero_id int, phase int, tier int, item_id int, observations long, outcome_rate double, shrunk_item_residual_delta double",
    )
    got = {(r["enemy_hero_id"], r["item_id"]): r for r in same_opportunity_comparators(cells).collect()}
    assert got[2, 10]["comparator_item_id"] == 11 and got[2, 10]["comparison_support"] == 300 and got[2, 10]["comparative_interval_low"] > 0
    assert got[2, 11]["comparator_item_id"] == 10 and not got[3, 10]["same_opportunity"] and got[3, 10]["comparison_support"] == 0


def test_residuals(spark):
    left = spark.createDataFrame([("s", 1, 0.05), ("s", 2, -0.05)], "scope string, k int, d double")
    right = spark.createDataFrame([("s", 1, 0.02)], "scope string, k int, m double")
    got = {r["k"]: r["r"] for r in with_residual(left, right, ["scope", "k"], "d", "m", "r").collect()}
    assert got[1] == pytest.approx(0.03) and got[2] is None


def test_percentiles_of_one_row(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (2, 11, 0.1), (2, 12, 0.9)], "tier int, item int, s double")
    got = {r["item"]: r["percentile"] for r in ranking.percentile_by_tier(df, ["tier"], [F.col("s"), F.col("item")]).collect()}
    assert got == {10: 0.0, 11: 0.0, 12: 1.0}


# -- replay -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("events", "components", "want"),
    [
        ([(1, 10, 0), (2, 20, 0), (3, 30, 0), (4, 30, 0)], {3: (1, 2)}, (3, 4)),
        ([(1, 10, 20)], {}, ()),
        ([(1, 10, 10)], {}, ()),
        ([(2, 10, 0), (1, 10, 0)], {2: (1,)}, (2,)),
        ([(1, 5, 0), (1, 6, 0), (2, 7, 0)], {2: (1,)}, (1, 2)),
        ([(9, 5, 4)], {}, (9,)),
    ],
)
def test_final_inventory(events, components, want):
    assert replay.final_inventory(events, components) == want


def test_final_inventories_of_many(spark):
    df = spark.createDataFrame([(1, 1, 1, 10, 0), (1, 1, 2, 20, 0), (1, 2, 1, 5, 8)], "match_id long, player_slot int, item_id long, buy_time int, sold_time int")
    got = {r["player_slot"]: r["items"] for r in replay.final_inventories(df, ["match_id", "player_slot"], {2: (1,)}).collect()}
    assert got == {1: [2], 2: []}


def test_classified_events():
    cost = {1: 500, 2: 1250}
    got = replay.classify_events([(10, 0, "buy", 1), (20, 0, "buy", 2), (20, 1, "sell", 1)], {2: (1,)}, cost)
    assert got == [(10, "purchase", 1, 500), (20, "upgrade_purchase", 2, 750), (20, "upgrade_consumption", 1, 0)]
    with pytest.raises(ValueError, match="isn't held"):
        replay.classify_events([(5, 0, "sell", 1)], {}, cost)


def test_schedules():
    components, cost = {3: (1, 2)}, {1: 500, 2: 500, 3: 1500, 4: 800}
    assert replay.schedule([3, 4], components, cost) == [4, 1, 2, 3]
    assert replay.schedule([3, 4], components, cost, slots=2) == [1, 2, 3, 4]
    assert replay.schedule([3, 4], components, cost, slots=1) is None
    assert replay.incremental_cost(3, [1, 4], components, cost) == 1000
    # An item and an upgrade of it: the item would have to be bought twice.
    assert replay.schedule([1, 2], {2: (1,)}, {1: 500, 2: 1250}) is None
    assert replay.schedule([5, 6], {5: (1, 2), 6: (2, 3)}, dict.fromkeys(range(1, 7), 500)) is None
    # Only with three slots does the order matter.
    made = {10: (1, 2, 3)}
    assert replay.schedule([10, 20], made, {1: 500, 2: 500, 3: 500, 10: 3000, 20: 100}, slots=3) == [1, 2, 3, 10, 20]


def legal_order(order, targets, components, active, slots, actives):
    held = []
    for item in order:
        for c in components.get(item, ()):
            if c not in held:
                return False
            held.remove(c)
        held.append(item)
        if len(held) > slots or len(set(held) & active) > actives:
            return False
    return sorted(held) == sorted(targets)


def test_schedules_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(150):
        components = {k: tuple(rng.choice(np.arange(k), rng.integers(1, 3), replace=False).tolist()) for k in range(2, 8) if rng.random() < 0.6}
        targets = rng.choice(8, rng.integers(1, 4), replace=False).tolist()
        cost, active, slots = {k: int(rng.integers(1, 9)) for k in range(8)}, {0, 3, 5}, int(rng.integers(1, 4))
        closure = set(targets)
        while more := {c for i in closure for c in components.get(i, ())} - closure:
            closure |= more
        if len(closure) > 6:
            continue
        want = any(legal_order(p, targets, components, active, slots, 1) for p in permutations(sorted(closure)))
        got = replay.schedule(targets, components, cost, active, slots, 1)
        assert (got is not None) == want and (got is None or legal_order(got, targets, components, active, slots, 1))


# -- itemsets ----------------------------------------------------------------------------------------------------------------


def test_itemset_support(spark):
    data = [(1, "train", [1, 2, 3])] * 30 + [(1, "test", [1, 2, 2])] * 20 + [(1, "train", [4, 5])] * 19
    df = spark.createDataFrame(data, "hero_id int, fold string, items array<bigint>")
    got = {tuple(r["itemset"]): (r["support"], r["train_support"], r["test_support"]) for r in itemsets.itemset_support(df, ["hero_id"], "items", 2, 20, "fold").collect()}
    assert got == {(1, 2): (50, 30, 20), (1, 3): (30, 30, 0), (2, 3): (30, 30, 0)}
    assert itemsets.containing(df, "items", [2, 3]).count() == 30


def test_agreement_orders():
    pairs = [(1, 2, 30, 5), (1, 3, 30, 5), (2, 3, 4, 30)]
    best = policies.agreement_orders(pairs, [1, 2, 3])
    assert best[0] == (90, (1, 3, 2)) and best[1][0] == 65 and len(best) == 2


def test_greedy_path_keeps_its_limits():
    rng = np.random.default_rng(3)
    rows = [{"item_id": k, "tier": k % 4 + 1, "adopter_matches": 100, "adoption_rate": float(rng.random()), "score": float(rng.random()), "median_buy_time_s": float(k * 60)} for k in range(24)]
    cost = {r["item_id"]: 800 * 2 ** (r["tier"] - 1) for r in rows}
    got = policies.walk(rows, "score", {}, cost, {0, 4, 8, 12, 16})
    assert got["cost"] <= 30_000 and len(got["held"]) <= 9 and len({0, 4, 8, 12, 16} & set(got["held"])) <= 4


def test_supported_paths(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], 60), (1, [2, 1, 4], 50), (1, [5], 999)], "g int, path array<bigint>, w long")
    rows = paths.state_counts(df, ["g"], "path", "w").collect()
    counts = {(tuple(r["state"]), r["next"]): r["n"] for r in rows}
    assert counts[(1, 2), 3] == 60 and counts[(1, 2), 4] == 50 and counts[(), 5] == 999
    # The best first step leads nowhere, so the next one is taken.
    assert paths.supported_path(counts, lambda s: len(s) == 3) == [(1, 60), (2, 60), (3, 60)]
    assert paths.supported_path(counts, lambda s: len(s) == 4) is None


def test_widening():
    base = {"minimum_badge": 90, "maximum_badge": 100, "since": 10, "support": 5, "mode": "ranked", "epoch": 1}
    wider, widest = base | {"minimum_badge": 80, "support": 50}, base | {"minimum_badge": 70, "support": 500}
    assert paths.widened([base, wider, widest], 40) == [base, wider]
    assert paths.widened([base, wider | {"epoch": 2}], 40) == [base]
    with pytest.raises(ValueError, match="widen"):
        paths.widened([wider, base], 100)


# -- estimators --------------------------------------------------------------------------------------------------------------


def test_cumulative_incidence(spark):
    df = spark.createDataFrame([(1, 10, True), (1, 10, False), (1, 20, True), (1, 20, False)], "g int, t int, e boolean")
    got = sorted((r["time_s"], r["at_risk"], r["cumulative_incidence"]) for r in kernels.cumulative_incidence(df, ["g"], "t", F.col("e")).collect())
    assert [x[:2] for x in got] == [(10, 4), (20, 2)] and [x[2] for x in got] == [pytest.approx(0.25), pytest.approx(0.5)]


def test_landmarks(spark):
    df = spark.createDataFrame([(1, 1600, 1), (1, 2600, 1), (1, 900, 0)], "g int, d int, w int")
    got = {r["landmark_s"]: (r["at_risk"], r["wins"]) for r in kernels.landmark_estimates(df, ["g"], "d", F.col("w"), (1500, 2500)).collect()}
    assert got == {1500: (2, 2), 2500: (1, 1)}


def test_prefixes(spark):
    df = spark.createDataFrame([(1, [10, 20], 60), (1, [10, 30], 40)], "g int, path array<bigint>, w long")
    got = {(r["prefix"], r["next"]): r["probability"] for r in kernels.prefix_decisions(df, ["g"], "path", "w").collect()}
    assert got == {("", 10): 1.0, ("10", 20): 0.6, ("10", 30): 0.4}


def test_off_policy_recovers_the_mean_and_abstains(spark):
    data = [("g", "a" if k % 2 else "b", 0.5, float(k % 4 < 2), {"a": 0.5, "b": 0.5}, {"a": 0.5, "b": 0.5}) for k in range(100)] + [("h", "a", 0.5, 1.0, {"a": 0.5, "z": 0.5}, {"a": 0.5, "z": 0.5})]
    df = spark.createDataFrame(data, "g string, action string, propensity double, outcome double, target map<string,double>, predicted map<string,double>")
    got = {r["g"]: r for r in kernels.off_policy(df, ["g"]).collect()}
    assert [got["g"][c] for c in ("ips", "snips", "dr", "effective_sample_size")] == [0.5, 0.5, 0.5, 100]
    assert not got["h"]["supported"] and got["h"]["ips"] is None and got["h"]["overlap"] == 0.5


def test_calibration_and_abstention(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.4, 0)], "p double, y int")
    r = next(x for x in kernels.calibration_slices(df, {}, 0.7).collect() if x["slice"] == "overall")
    assert r["brier"] == pytest.approx(0.07) and r["coverage"] == pytest.approx(2 / 3) and r["selective_risk"] == 0
    best = kernels.abstention_threshold(df, 0.1).first()
    assert best["threshold"] == 0.5 and best["coverage"] == 1


def test_duration_shapes(spark):
    late = [(1, b, 50 if b < 5 else 60, 100) for b in range(7)]
    peak = [(2, b, 55 if 2 <= b < 5 else 50, 100) for b in range(7)]
    lacking = [(3, b, 50, 100) for b in range(6)]
    df = spark.createDataFrame(late + peak + lacking, "g int, bucket int, wins int, matches int")
    got = {r["g"]: r["shape"] for r in kernels.duration_profile(df, ["g"]).collect()}
    assert got == {1: "LATE_SCALING", 2: "MIDGAME_PEAK"}


def test_purchase_windows_ignore_outcomes(spark):
    rows = [(1, 1000 * k, n, w) for k, (n, w) in enumerate([(50, 0), (100, 90), (200, 0), (100, 100), (50, 50)])]
    shape = "g int, bucket int, matches long, wins long"
    a = kernels.purchase_windows(spark.createDataFrame(rows, shape), ["g"]).first()
    b = kernels.purchase_windows(spark.createDataFrame([(g, k, n, 0) for g, k, n, _ in rows], shape), ["g"]).first()
    assert (a["increment"], a["bucket_start"], a["bucket_end"]) == (1000, 1000, 4000) == (b["increment"], b["bucket_start"], b["bucket_end"])


def test_monitoring_takes_the_strongest_rule(spark):
    base = {"mechanics_match": True, "calibration_error": 0.0, "schema_decode_ok": True, "preservation_unchanged": True, "restore_failures": 0, "snapshot_age_s": 0, "path_rejections": 0, "render_rejections": 0, "install_failures": 0, "invalid_state_rate": 0.0, "unhandled_branches": 0, "exposures": 0, "recommendation_concentration": 0.0}
    rows = [base | {"k": 0}, base | {"k": 1, "invalid_state_rate": 0.5}, base | {"k": 2, "snapshot_age_s": 90_000, "invalid_state_rate": 0.5}, base | {"k": 3, "mechanics_match": False}]
    got = {r["k"]: (r["action"], r["reasons"]) for r in kernels.monitoring_decision(spark.createDataFrame(rows), ["k"]).collect()}
    assert [got[k][0] for k in range(4)] == ["healthy", "alert", "refuse", "rollback"] and "no last compatible" in got[3][1]


def test_net_worth_rules(spark):
    rows = [(200, 50.0, 900.0, None, None), (100, 900.0, 900.0, 5.0, 90), (100, 80.0, 900.0, 5.0, 50), (100, 80.0, 900.0, 5.0, 30)]
    df = spark.createDataFrame(rows, "buy_time int, net_worth double, final_net_worth double, preceding_net_worth double, preceding_time_s int")
    assert [(r["valid_net_worth"], r["net_worth_status"]) for r in kernels.validated_net_worth(df).collect()] == [(50.0, "reported"), (None, "corrupt"), (5.0, "preceding"), (None, "unknown")]


def test_text_functions(spark):
    r = one(
        spark, kernels.clean_text(F.lit("<b>Deals</b> {dmg}  10 &amp; more")).alias("t"), kernels.tagged(F.lit("Heals and SLOWS")).alias("g"),
        kernels.affinity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), {"b": 3, "c": 9}).alias("f"), kernels.effective_property(F.lit(" -1 ")).alias("e"), kernels.nearest_thousand(F.lit(1500)).alias("n"),
    )
    assert r["t"] == "Deals 10 & more" and r["g"] == ["healing", "control"] and r["f"] == 3 and not r["e"] and r["n"] == 2000


# -- sources and sinks --------------------------------------------------------------------------------------------------------


def test_catalogue_defaults(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"id": 4000000000, "class_name": "x", "item_slot_type": "Weapon"}, {"id": 7, "class_name": "y", "name": "Y", "item_tier": 2, "cost": 1250, "is_active_item": true, "component_items": ["x"]}]')
    got = {r["item_id"]: r for r in io.item_catalogue(spark, str(tmp_path / "items.json")).collect()}
    assert (got[4000000000]["item_name"], got[4000000000]["cost"], got[4000000000]["slot"], got[4000000000]["unique_item"]) == ("x", 0, "weapon", True)
    assert got[7]["slot"] == "unknown" and got[7]["component_items_json"] == '["x"]'


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "k int, s string, x double")
    io.write_parquet(df, str(tmp_path / "p"))
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect()) == sorted(io.read_csv(spark, str(tmp_path / "c"), df.schema).collect())


def test_keys_from_file_names(spark, tmp_path):
    for key in ("a", "b"):
        (tmp_path / f"hero-duration-{key}.json").write_text(f'[{{"hero_id": 1, "wins": 3, "matches": {20 if key == "a" else 19}}}]')
    got = io.duration_profiles(spark, str(tmp_path)).collect()
    assert [(r["duration_bucket"], r["ending_outcome_rate"]) for r in got] == [("a", pytest.approx(0.15))]


def test_retries_only_transient_errors():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 503: not yet published")
        return "done"

    assert io.retried(flaky, ("503",), wait=lambda s: None) == "done" and len(calls) == 3
    with pytest.raises(ValueError, match="other"):
        io.retried(lambda: (_ for _ in ()).throw(ValueError("other")), ("503",), wait=lambda s: None)


def test_canonical_hash():
    assert io.sha256_json({"b": 1, "a": [1.5]}) == io.sha256_json({"a": [1.5], "b": 1}) and len(io.sha256_json({})) == 64


def test_content_hashes_do_not_depend_on_the_mirror(spark):
    rows = [("http://m.a.example/x", '<a href="//www.b.example/">'), ("http://a.example/x", '<a href="//b.example/">'), ("http://a.example/y", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string, html string").select(kernels.content_hash(F.col("url"), F.col("html"))).collect()]
    assert got[0] == got[1] != got[2] and len(got[2]) == 64


def test_unmapped_values_are_an_error(spark):
    with pytest.raises(Exception):  # noqa: B017  Spark's own, raised in a task
        spark.createDataFrame([("O",), ("?",)], "s string").select(kernels.replace_strict(F.col("s"), {"O": "open"})).collect()


def test_ridge_holdout_learns_from_all_rows(spark, monkeypatch):
    """a group of more than 50 000 training rows gets the model of all of them, and groups with and without missing values theirs."""
    rng = np.random.default_rng(11)
    n = 66_000
    x = rng.standard_normal((n, len(policies.FEATURES))) * np.arange(1, 8) + 3
    hero, item = np.where(np.arange(n) < 62_000, 1, 2), rng.integers(1, 5, n)
    x[(hero == 1) & (rng.random(n) < 0.1), 2] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-0.2 * np.nan_to_num(x[:, 0]) - 0.3 * (item == 2) + 0.05 * np.nan_to_num(x[:, 2])))).astype(int)
    fold = np.where(np.arange(n) % 15 == 7, "test", "train")
    frame = pd.DataFrame({"match_id": np.arange(n), "player_slot": 1, "fold": fold, "hero_id": hero.astype(np.int32), "tier": np.int32(1), "item_id": item, "y": y} | {f: x[:, k] for k, f in enumerate(policies.FEATURES)})
    rows = spark.createDataFrame(frame).replace(float("nan"), None)
    monkeypatch.setattr(policies, "_decisions", lambda t: rows)
    found = {(r["hero_id"], r["model"]): r for r in policies.ridge_holdout(None).collect()}
    assert len(found) == 4
    for h in (1, 2):
        train, test = (hero == h) & (fold == "train"), (hero == h) & (fold == "test")
        scale = models.Scaler(x[train], indicators=True)
        for name, known in (("state", np.zeros(0)), ("state_and_item", np.arange(1, 5))):
            design = [np.hstack([(item[at][:, None] == known).astype(float), scale(x[at])]) for at in (train, test)]
            p = models.logistic_predict(models.logistic_fit(design[0], y[train], 0.5), design[1])
            assert found[h, name]["train_rows"] == train.sum() and found[h, name]["test_rows"] == test.sum()
            assert abs(found[h, name]["brier"] - ((p - y[test]) ** 2).mean()) < 1e-9
