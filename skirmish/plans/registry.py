"""Names, Spark plans and oracle SQL of the library's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators import paths
from skirmish.plans import analytics as a
from skirmish.plans import estimates as e
from skirmish.plans import estimates_sql, kernels, oracle
from skirmish.plans import policies as p
from skirmish.plans.cohort import Tables
from skirmish.sources.adapter import read

Plan = Callable[[Tables], DataFrame]


def _backbones(t: Tables) -> DataFrame:
    # Inventories of the driver's tables are short: sizes from 2 on, and a floor of 3 a fold.
    return t.once("backbones", lambda: p.backbones(t, (2, 3, 4), fold_support=3))


def _completions(t: Tables) -> DataFrame:
    return t.once("completions", lambda: p.completions(t, _backbones(t)))


#: Queries over the derived tables.
PLANS: dict[str, Plan] = {
    "match_admission": lambda t: t.eligible_matches,
    "player_matches": lambda t: t.player_matches.withColumn("started", F.unix_seconds("start_time")).drop("start_time"),
    "hero_account_counts": lambda t: t.hero_account_counts,
    "match_folds": lambda t: t.match_folds,
    "compositions": lambda t: t.compositions.withColumn("hero_ids", F.array_join("hero_ids", ",")),
    "team_snapshots": lambda t: t.team_snapshots,
    "purchases": lambda t: t.purchases.select("match_id", "player_slot", "item_id", "buy_time", "sold_time", "imbued_ability_id", "own_net_worth_at_buy", "state_observed_at_s", "event_order", "same_second_purchase_count", "item_purchase_ordinal"),
    "first_purchases": lambda t: t.first_purchases.select(
        "match_id", "player_slot", "item_id", "fold", "phase", "own_team_net_worth", "own_team_observed_players", "enemy_team_net_worth", "enemy_team_observed_players", "team_net_worth_lead", "state_age_s", "prior_catalog_spend", "prior_purchase_count"
    ),
    "decision_opportunities": lambda t: t.decision_opportunities.select("match_id", "player_slot", "item_id", "phase", "tier", "candidate_slate_json", "realized_action", "save_action_observed"),
    "row_counts": a.row_counts,
    "item_adoption": a.item_adoption,
    "item_adoption_by_fold": lambda t: a.item_aggregates(t, folds=True),
    "rank_percentile": a.rank_percentiles,
    "top10_rankings": a.top_rankings,
    "rank_stability": a.rank_stability,
    "timing_stability": a.timing_stability,
    "confounding_correlations": a.confounding_correlations,
    "baseline_evaluation": a.baseline_evaluation,
    "state_cells": a.state_cells,
    "state_references": a.state_references,
    "state_overlap": a.state_overlap,
    "state_coverage": a.state_coverage,
    "matchup_whole_team": lambda t: a.matchup_cells(t, "whole_enemy_team"),
    # The driver's tables leave no lane cell 100 observations at small scale, so these take a floor of 20.
    "matchup_same_lane": lambda t: a.matchup_cells(t, "same_lane", support=20),
    "same_opportunity_comparator": lambda t: a.matchups(t, lane_support=20),
    "matchup_temporal_cells": lambda t: a.matchup_cells(t, "whole_enemy_team", ["fold"], 20),
    "matchup_temporal_stability": lambda t: a.matchup_stability(t, 20),
    "component_edges": a.component_edges,
    "item_transitions": a.item_transitions,
    "sequence_model_evaluation": a.sequence_model_evaluation,
    "sequence_summary": a.sequence_summary,
    "inflation_bounds": a.inflation_bounds,
    "matchup_summary": a.matchup_summary,
    "sequence_backoff": a.sequence_backoff,
    "calibration_audit": a.calibration_audit,
    "daily_rank": a.daily_rank,
    "badge_counts": a.badge_counts,
    "adoption_by_calibration": lambda t: a.adoption_by(t, F.col("calibration"), "calibration"),
    "adoption_by_rank_family": lambda t: a.adoption_by(t, a.rank_family(), "rank_family"),
    "cohort_stability_calibration": lambda t: a.adoption_stability(t, F.col("calibration"), "stratum"),
    "cohort_stability_rank": lambda t: a.adoption_stability(t, a.rank_family(), "stratum"),
    "raw_purchase_events": a.raw_purchase_events,
    "raw_flow": a.raw_flow,
    "account_breadth": a.account_breadth,
    "path_label": a.path_label,
    "late_game_cohort": e.late_game_cohort,
    "late_game_items": e.late_game_items,
    "late_capstones": e.late_capstones,
    "core_economy_reference": e.core_economy_reference,
    "path_item_metrics": e.path_item_metrics,
    "early_inventories": e.early_inventories,
    "itemset_support_2": e.itemset_support,
    # Inventories of the driver's tables rarely share three items.
    "itemset_support_3": lambda t: e.itemset_support(t, 3, 5),
    "itemset_levels": e.itemset_levels,
    "item_rollups": e.item_rollups,
    "decision_rollups": e.decision_rollups,
    "pair_precedence": e.pair_precedence,
    "path_coherence": e.path_coherence,
    "path_coherence_by_fold": lambda t: e.path_coherence(t, folds=True),
    "hazard_incidence": e.hazard_incidence,
    "landmarks": e.landmarks,
    "purchase_prefixes": e.purchase_prefixes,
    "duration_profile": e.duration_profile,
    "purchase_windows": e.purchase_windows,
    "tier_horizons": e.tier_horizons,
    "calibration_report": e.calibration_report,
    "abstention_threshold": e.abstention_threshold,
    "off_policy": e.off_policy,
    "group_leakage": e.group_leakage,
    "select_then_estimate": e.select_then_estimate,
    "monitoring_decision": e.monitoring,
    "net_worth_validity": e.net_worth_validity,
    "affinity_scores": e.affinities,
    "category_bonuses": e.category_bonuses,
    # Algorithms that SQL can't express; tested against brute force or by their invariants.
    "item_eb": p.item_eb,
    "state_adjusted_eb": p.state_adjusted,
    "bootstrap_intervals": p.bootstrap,
    "ridge_holdout": p.ridge_holdout,
    "dr_contrasts": p.dr_contrasts,
    "final_inventories": lambda t: p.inventories(t).withColumn("items", F.array_join("items", ",")),
    # Inventories of the driver's tables are short: smaller sets, and a floor of 3 a fold.
    "top_cores": lambda t: p.top_cores(t, 2, 20),
    "backbones": _backbones,
    "core_completions": _completions,
    "complete_cores": lambda t: p.complete_cores(t, _backbones(t), 2),
    "core_orders": lambda t: p.core_orders(t, _backbones(t), _completions(t)),
    "core_alternatives": lambda t: p.core_alternatives(t, _backbones(t), _completions(t)),
    "greedy_paths": p.greedy_paths,
    "core_path_stability": p.core_path_stability,
    "build_paths": p.build_paths,
    "tier_menus": lambda t: p.tier_menus(t, _backbones(t)),
    "situational_policy": p.situational,
    "supported_openings": p.supported_openings,
}

#: Queries over the driver's tables as they are.
PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "asof_events": lambda spark, d: kernels.latest_event(read(spark, d, "events"), "purchase", "view").drop("ts"),
    "clean_text": lambda spark, d: read(spark, d, "pages").select("page_id", kernels.clean_text(F.col("html")).alias("text")),
    "threat_tags": lambda spark, d: read(spark, d, "part").select(
        "p_partkey", F.array_join(kernels.tagged(F.col("p_name")), ",").alias("threats"), (kernels.effective_property(F.col("p_type")) & (F.lower("p_type") != "small")).alias("effective")
    ),
}


def _outcome_eligibility(spark: SparkSession, d: str) -> DataFrame:
    flags = {"scored": "o_orderstatus <> 'P'", "penalized": "o_custkey % 11 = 0", "party_penalized": "o_custkey % 13 = 0", "abandoned": "o_orderkey % 17 = 0", "rewarded": "o_custkey % 97 <> 0", "low_priority": "o_orderpriority = '5-LOW'", "new_player": "o_custkey % 19 = 0"}
    rows = read(spark, d, "orders").select("o_orderpriority", *[F.expr(x).alias(name) for name, x in flags.items()])
    lenient = kernels.outcome_eligible(["scored", "abandoned"])
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(kernels.outcome_eligible()).alias("eligible"), F.count_if(lenient).alias("eligible_leniently"))


def _feature_leakage(spark: SparkSession, d: str) -> DataFrame:
    # The driver's tables have no log of features: a line's shipping day stands for the time of the observation, its order's key for that of the decision.
    observed = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    source = F.when(F.col("l_linenumber") == 7, "final_net_worth").otherwise("stats")
    reason = kernels.leakage(source, observed, F.when(F.col("l_linenumber") == 6, -1).otherwise(400), F.col("l_orderkey") % 2500)
    return read(spark, d, "lineitem").select("l_returnflag", F.coalesce(reason, F.lit("usable")).alias("reason")).groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"))


def _order_states(spark: SparkSession, d: str) -> DataFrame:
    state = kernels.replace_strict(F.col("o_orderstatus"), {"O": "open", "F": "finished", "P": "partial"})
    return read(spark, d, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _window_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return orders.select("o_orderkey", kernels.nearest_thousand(F.col("o_totalprice").cast("double")).alias("souls"), kernels.clock(F.col("o_orderkey") % 5400).alias("clock"))


def _completable_paths(spark: SparkSession, d: str) -> DataFrame:
    # The four kinds of events but errors stand for abilities, a user's first 16 for what was learned, in five groups of users.
    kinds = ["click", "view", "signup", "purchase"]
    events = read(spark, d, "events").where(F.col("event_type").isin(*kinds)).select((F.col("user_id") % 5).cast("int").alias("hero_id"), "user_id", F.struct("ts", "event_id", F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).alias("kind")).alias("e"))
    taken = events.groupBy("hero_id", "user_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["kind"]), 1, 16).alias("path"))
    return paths.completable_paths(taken.groupBy("hero_id", "path").agg(F.count("*").alias("w")), "hero_id", "path", "w", 8, 2)


PLAIN |= {
    "completable_paths": _completable_paths,
    "outcome_eligibility": _outcome_eligibility,
    "feature_leakage": _feature_leakage,
    "order_states": _order_states,
    "window_labels": _window_labels,
    "content_hashes": lambda spark, d: read(spark, d, "pages").select("page_id", kernels.content_hash(F.col("url"), F.col("html")).alias("content_sha256")),
    "item_functions": lambda spark, d: read(spark, d, "pages").select("page_id", kernels.item_function(F.col("html")).alias("function")),
}


def _over_tables(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables.of(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_tables(plan) for name, plan in PLANS.items()} | PLAIN


def oracle_sql() -> dict[str, str]:
    return {name: oracle.PRELUDE + body for name, body in (oracle.STATEMENTS | estimates_sql.STATEMENTS).items()} | estimates_sql.PLAIN
