"""Descriptive analyses over the derived tables. Each function takes :class:`Tables` and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import stats
from skirmish.operators import ranking
from skirmish.plans.cohort import APPEARANCE, Tables, banded

ITEM_SUPPORT, MATCHUP_SUPPORT = 20, 100
CELL = ["hero_id", "phase", "tier"]
ITEM = ["hero_id", "tier", "item_id"]
STATE = ["phase", "own_nw_band", "lead_band"]


def won() -> Column:
    return F.col("won").cast("int")


def quantile(column: str, p: float) -> Column:
    """Exact, interpolated, over known values."""
    return F.percentile(column, F.lit(p))


# -- items -------------------------------------------------------------------------------------------------------------------


def item_aggregates(t: Tables, folds: bool = False, members: DataFrame | None = None, support: int = ITEM_SUPPORT) -> DataFrame:
    """Adoption, timing, outcome and inflation of each hero's items; with ``folds``, in each fold apart; with ``members`` (match_id, player_slot), of these players only.

    Appearances, not buyers, are adoption's denominator. Both event counts come from one scan of purchases: a first
    ownership is the purchase with ordinal 1.
    """
    key = ["fold", "hero_id"] if folds else ["hero_id"]
    players, bought = t.player_matches, t.purchases
    if members is not None:
        players, bought = (x.join(members, APPEARANCE, "left_semi") for x in (players, bought))
    if folds:
        players, bought = (x.join(t.match_folds, "match_id") for x in (players, bought))
    totals = players.groupBy(*key).agg(F.count("*").alias("hero_player_matches"))

    def firsts(x: Column | str) -> Column:
        return F.when(F.col("item_purchase_ordinal") == 1, F.col(x) if isinstance(x, str) else x)

    owners = F.count_if(F.col("item_purchase_ordinal") == 1)
    views = bought.select(
        *key, "item_id", "item_name", "tier", "cost", "slot", "active", "item_purchase_ordinal",
        firsts(won()).alias("win"), firsts("buy_time").alias("time"), firsts("own_net_worth_at_buy").alias("worth"), firsts("sold_time").alias("sold"),
    )
    items = views.groupBy(*key, "item_id", "item_name", "tier", "cost", "slot", "active").agg(
        owners.alias("adopter_matches"),
        F.sum("win").alias("wins"),
        F.avg("win").alias("raw_outcome_rate"),
        F.median("time").alias("median_buy_time_s"),
        quantile("time", 0.25).alias("buy_time_q25_s"),
        quantile("time", 0.75).alias("buy_time_q75_s"),
        F.median("worth").alias("median_valid_buy_net_worth"),
        quantile("worth", 0.25).alias("buy_nw_q25"),
        quantile("worth", 0.75).alias("buy_nw_q75"),
        (F.count("worth") / owners).alias("valid_buy_nw_share"),
        F.avg((F.col("sold") > 0).cast("int")).alias("sell_event_share"),
        F.median(F.when(F.col("sold") > 0, F.col("sold"))).alias("median_sell_time_s"),
        F.count("*").alias("purchase_events"),
    )
    return items.where(F.col("adopter_matches") >= support).join(totals, key).withColumns(
        {"adoption_rate": F.col("adopter_matches") / F.col("hero_player_matches"), "event_inflation": F.col("purchase_events") / F.col("adopter_matches")}
    )


def item_outcomes(t: Tables, folds: bool = False) -> DataFrame:
    """The columns of :func:`item_aggregates` that need no ordinals: adopters, wins, both rates and the median time of the first purchase. Its few rows are kept.

    A first ownership is a player's earliest purchase of an item, and medians are taken over seconds with their counts: sums by hashed keys
    over narrow rows, without a sort of purchases or a kept table of them.
    """
    return t.once("item_outcomes_by_fold" if folds else "item_outcomes", lambda: _item_outcomes(t, folds))


def _item_outcomes(t: Tables, folds: bool) -> DataFrame:
    key = ["fold", "hero_id"] if folds else ["hero_id"]
    players, owned = t._admitted_players, t.bought.groupBy(*APPEARANCE, "hero_id", "item_id").agg(F.min("buy_time").alias("time"), F.max(won()).alias("win"))
    if folds:
        players, owned = (x.join(t.match_folds.hint("shuffle_hash"), "match_id") for x in (players, owned))
    totals = players.groupBy(*key).agg(F.count("*").alias("hero_player_matches"))
    seconds = owned.groupBy(*key, "item_id", "time").agg(F.count("*").alias("owners"), F.count("win").alias("known"), F.sum("win").alias("won"))
    items = seconds.groupBy(*key, "item_id").agg(
        F.sum("owners").alias("adopter_matches"), F.sum("won").alias("wins"), F.try_divide(F.sum("won"), F.sum("known")).alias("raw_outcome_rate"), F.percentile("time", F.lit(0.5), F.col("owners")).alias("median_buy_time_s")
    )
    tiers = F.broadcast(t.item_assets.select("item_id", "tier"))  # the catalogue
    return items.where(F.col("adopter_matches") >= ITEM_SUPPORT).join(tiers, "item_id").join(totals, key).withColumn("adoption_rate", F.col("adopter_matches") / F.col("hero_player_matches"))


def item_adoption(t: Tables) -> DataFrame:
    """Item aggregates with Wilson intervals: the flagship query."""
    low, high = stats.wilson(F.col("wins"), F.col("adopter_matches"))
    return item_aggregates(t).withColumns({"wilson_lower": low, "wilson_upper": high})


def rank_percentiles(t: Tables) -> DataFrame:
    """Place of each item within hero and tier by adoption, worst first."""
    ranked = ranking.percentile_by_tier(item_outcomes(t), ["hero_id", "tier"], [F.col("adoption_rate"), F.col("adopter_matches"), F.desc("item_id")])
    return ranked.select(*ITEM, "percentile")


METHODS = ("adoption_rate", "raw_outcome_rate", "wilson_lower", "purchase_events")


def top_rankings(t: Tables, k: int = 10) -> DataFrame:
    """The first ``k`` items of each hero and tier by each method: methods become rows, then one window ranks them all."""
    long = item_adoption(t).select(*ITEM, "adopter_matches", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in METHODS])).alias("m"))
    known = long.select(*ITEM, "adopter_matches", "m.method", "m.score").where("score IS NOT NULL")
    order = [F.desc("score"), F.desc("adopter_matches"), F.col("item_id")]
    return ranking.top_k(known, ["method", "hero_id", "tier"], order, k).select("method", *ITEM, "score", F.col("rank").cast("long").alias("rank"))


def fold_pairs(t: Tables, columns: Sequence[str]) -> DataFrame:
    """Items that training and test have in common, with ``columns`` of both (those of the test as ``<column>_test``)."""
    low, _ = stats.wilson(F.col("wins"), F.col("adopter_matches"))
    both = item_aggregates(t, folds=True).withColumn("wilson_lower", low)
    return ranking.side_by_side(both, ITEM, "fold", ("train", "test"), columns)


def rank_stability(t: Tables, methods: Sequence[str] = ("adoption_rate", "wilson_lower")) -> DataFrame:
    """Spearman correlation and top-10 Jaccard between training and test, by hero, tier and method."""
    pairs = fold_pairs(t, methods)
    long = pairs.select(*ITEM, F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("a"), F.col(f"{m}_test").alias("b")) for m in methods])))
    key = ["hero_id", "tier", "method"]
    found = ranking.spearman(long, key, "a", "b").join(ranking.top_k_jaccard(long, key, "a", "b", "item_id"), key)
    return found.select(*key, F.col("n").alias("shared_items"), "spearman", F.col("jaccard").alias("top10_jaccard"))


def timing_stability(t: Tables, k: int = 10) -> DataFrame:
    """Shift and overlap of purchase windows from training to test, for each tier's most adopted items."""
    chosen = ranking.top_k(item_aggregates(t), ["hero_id", "tier"], [F.desc("adoption_rate"), F.col("item_id")], k).select(*ITEM, "adoption_rate")
    measures = ["median_buy_time_s", "buy_time_q25_s", "buy_time_q75_s", "median_valid_buy_net_worth", "buy_nw_q25", "buy_nw_q75"]
    both = chosen.join(fold_pairs(t, measures), ITEM)

    def overlap(low: str, high: str) -> Column:
        return stats.interval_overlap(F.col(low), F.col(high), F.col(f"{low}_test"), F.col(f"{high}_test"))

    return both.select(
        *ITEM, "adoption_rate",
        F.abs(F.col("median_buy_time_s") - F.col("median_buy_time_s_test")).alias("absolute_median_time_shift_s"),
        overlap("buy_time_q25_s", "buy_time_q75_s").alias("time_iqr_overlap"),
        F.abs(F.col("median_valid_buy_net_worth") - F.col("median_valid_buy_net_worth_test")).alias("absolute_median_net_worth_shift"),
        overlap("buy_nw_q25", "buy_nw_q75").alias("net_worth_iqr_overlap"),
    )


def confounding_correlations(t: Tables) -> DataFrame:
    """Rank correlation of four item features with the outcome rate, within hero and within hero and tier (tier 0: all)."""
    features = ("median_buy_time_s", "median_valid_buy_net_worth", "adoption_rate", "cost")
    base = item_aggregates(t)
    long = base.select("hero_id", "tier", "raw_outcome_rate", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    scoped = long.select("hero_id", "feature", "value", "raw_outcome_rate", F.inline(F.array(F.struct(F.lit("within_hero").alias("scope"), F.lit(0).alias("tier_scope")), F.struct(F.lit("within_hero_tier").alias("scope"), F.col("tier").alias("tier_scope")))))
    key = ["scope", "hero_id", "tier_scope", "feature"]
    varied = scoped.where("value IS NOT NULL").groupBy(*key).agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a < b").select(*key)
    return ranking.spearman(scoped, key, "value", "raw_outcome_rate").join(varied, key).select(*key, "spearman")


def baseline_evaluation(t: Tables) -> DataFrame:
    """Brier score and log loss on test decisions of rates learned in training."""
    low, _ = stats.wilson(F.col("wins"), F.col("adopter_matches"))
    learned = item_aggregates(t, folds=True).where("fold = 'train'").select(*ITEM, "raw_outcome_rate", low.alias("wilson_lower"))
    tested = t.decision_opportunities.where("fold = 'test'").select(*ITEM, won().alias("y")).join(learned, ITEM)
    long = tested.select("y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("raw_outcome_rate", "wilson_lower")])))
    p = stats.clipped(F.col("p"), 1e-6)
    return long.groupBy("model").agg(F.count("*").alias("observations"), stats.brier(p, F.col("y")).alias("brier"), stats.log_loss(p, F.col("y")).alias("log_loss"))


# -- states ------------------------------------------------------------------------------------------------------------------


def state_cells(t: Tables) -> DataFrame:
    return banded(t.decision_opportunities).groupBy(*ITEM, *STATE).agg(F.count("*").alias("observations"), F.sum(won()).alias("wins"))


def state_references(t: Tables) -> DataFrame:
    return banded(t.decision_opportunities).groupBy("hero_id", "tier", *STATE).agg(F.count("*").alias("reference_n"))


def state_overlap(t: Tables) -> DataFrame:
    """How much of a hero's states in a tier an item covers, and what weighting to them costs in support.

    The item's cells are the only aggregation of decisions: windows over them give the states' and the tier's totals.
    """
    tier, item = Window.partitionBy("hero_id", "tier"), Window.partitionBy(*ITEM)
    cells = state_cells(t).select(*ITEM, *STATE, "observations").withColumn("reference", F.sum("observations").over(Window.partitionBy("hero_id", "tier", *STATE)))
    weighed = cells.withColumns({"total": F.sum("observations").over(tier), "covered": F.sum("reference").over(item)})
    share = F.col("reference") / F.col("covered")
    out = weighed.groupBy(*ITEM).agg(
        F.sum("observations").alias("item_observations"),
        (F.first("covered") / F.first("total")).alias("state_coverage"),
        (1 / F.sum(share * share / F.col("observations"))).alias("effective_support"),
        F.max(share / F.col("observations")).alias("maximum_individual_weight"),
    )
    return out.withColumn("effective_support_share", F.col("effective_support") / F.col("item_observations"))


def state_coverage(t: Tables) -> DataFrame:
    """How often a purchase's state was known, by phase."""
    complete = F.count_if((F.col("own_team_observed_players") == 6) & (F.col("enemy_team_observed_players") == 6))
    n, lead = F.count("*"), F.count("team_net_worth_lead")
    return t.first_purchases.groupBy("phase").agg(
        n.alias("purchases"), (F.count("own_net_worth_at_buy") / n).alias("own_net_worth_share"), (lead / n).alias("team_lead_share"),
        (complete / n).alias("complete_team_snapshot_share"), (complete / F.nullif(lead, F.lit(0))).alias("complete_share_when_lead_present"),
    )


# -- matchups ----------------------------------------------------------------------------------------------------------------


def faced(t: Tables, scope: str) -> DataFrame:
    """Decisions by the enemy heroes faced: all of the other team, or those of the same lane."""
    decisions = t.decision_opportunities.select("match_id", "team_id", "assigned_lane", "fold", *CELL, "item_id", won().alias("win"))
    enemies = t.player_matches.where("hero_id IS NOT NULL").select("match_id", "team_id", "assigned_lane", F.col("hero_id").alias("enemy_hero_id"))
    # Keyed by match alone, as decisions are dealt already; side and lane are conditions over the match's twelve players.
    faced_by = (F.col("d.match_id") == F.col("e.match_id")) & (F.col("d.team_id") + F.col("e.team_id") == 1)
    if scope != "whole_enemy_team":
        faced_by &= F.col("d.assigned_lane") - F.col("e.assigned_lane") == 0
    return decisions.alias("d").join(enemies.alias("e"), faced_by).select("d.fold", *[f"d.{c}" for c in CELL], "d.item_id", "d.win", "e.enemy_hero_id")


def matchup_cells(t: Tables, scope: str, by: Sequence[str] = (), support: int = MATCHUP_SUPPORT) -> DataFrame:
    """Shrunk outcome deltas of items against enemy heroes, less the hero's own delta against that enemy.

    Item cells are counted once and summed to the hero's cells; baselines come from the decisions. ``by``: further keys, such as ``fold``.
    """
    pairs = faced(t, scope)
    decisions = t.decision_opportunities
    if by:
        pairs, decisions = (x.where(F.col("fold").isin("train", "test")) for x in (pairs, decisions))
    hero, enemy = [*by, *CELL], [*by, *CELL, "enemy_hero_id"]
    counted = pairs.groupBy(*enemy, "item_id").agg(F.count("*").alias("observations"), F.sum("win").alias("wins"))
    items = decisions.groupBy(*hero, "item_id").agg(F.avg(won()).alias("item_outcome_rate"))
    heroes = decisions.groupBy(*hero).agg(F.avg(won()).alias("hero_outcome_rate"))
    mains = counted.groupBy(*enemy).agg(F.sum("observations").alias("n"), F.sum("wins").alias("w")).join(heroes, hero)
    mains = mains.select(*enemy, stats.shrunk_delta(F.col("w"), F.col("n"), F.col("hero_outcome_rate")).alias("shrunk_matchup_main_delta"))
    cells = counted.where(F.col("observations") >= support).join(items, [*hero, "item_id"])
    deltas = cells.withColumns(
        {"scope": F.lit(scope), "outcome_rate": F.col("wins") / F.col("observations"), "shrunk_interaction_delta": stats.shrunk_delta(F.col("wins"), F.col("observations"), F.col("item_outcome_rate"))}
    )
    return with_residual(deltas, mains, enemy, "shrunk_interaction_delta", "shrunk_matchup_main_delta", "shrunk_item_residual_delta")


def with_residual(cells: DataFrame, effects: DataFrame, keys: Sequence[str], delta: str, main: str, name: str) -> DataFrame:
    """What an item adds to the hero's main effect; null where that isn't known."""
    return cells.join(effects.select(*keys, main), list(keys), "left").withColumn(name, F.col(delta) - F.col(main))


def same_opportunity_comparators(cells: DataFrame) -> DataFrame:
    """Each item against the most observed other item of the same hero, enemy, phase and tier, with a 95 % interval of the difference."""
    group = ["scope", "hero_id", "enemy_hero_id", "phase", "tier"]
    both = ranking.comparators(cells, group, "item_id", "observations", ["item_id", "observations", "outcome_rate", "shrunk_item_residual_delta"])
    estimate = F.col("shrunk_item_residual_delta") - F.col("other_shrunk_item_residual_delta")
    margin = stats.comparative_margin(F.col("outcome_rate"), F.col("observations"), F.col("other_outcome_rate"), F.col("other_observations"))
    return both.select(
        *cells.columns,
        F.col("other_item_id").isNotNull().alias("same_opportunity"),
        F.col("other_item_id").alias("comparator_item_id"),
        F.coalesce("other_observations", F.lit(0).cast("long")).alias("comparison_support"),
        (estimate - margin).alias("comparative_interval_low"),
        (estimate + margin).alias("comparative_interval_high"),
    )


def matchups(t: Tables, support: int = MATCHUP_SUPPORT, lane_support: int = MATCHUP_SUPPORT) -> DataFrame:
    whole, lane = matchup_cells(t, "whole_enemy_team", support=support), matchup_cells(t, "same_lane", support=lane_support)
    return same_opportunity_comparators(whole.unionByName(lane))


def matchup_stability(t: Tables, support: int = MATCHUP_SUPPORT) -> DataFrame:
    """Agreement of residual deltas between training and test, by scope and hero."""
    key = ["scope", *CELL, "item_id", "enemy_hero_id"]
    cells = matchup_cells(t, "whole_enemy_team", ["fold"], support).unionByName(matchup_cells(t, "same_lane", ["fold"], support))
    both = ranking.side_by_side(cells.withColumn("a", F.col("shrunk_item_residual_delta")), key, "fold", ("train", "test"), ["a"]).withColumnRenamed("a_test", "b")
    group = ["scope", "hero_id"]
    shifts = both.groupBy(*group).agg(F.avg((F.signum("a") == F.signum("b")).cast("int")).alias("sign_agreement"), F.median(F.abs(F.col("a") - F.col("b"))).alias("median_absolute_change"))
    return ranking.spearman(both, group, "a", "b").join(shifts, group).select(*group, F.col("n").alias("shared_interactions"), "spearman", "sign_agreement", "median_absolute_change")


# -- sequences ---------------------------------------------------------------------------------------------------------------


def component_edges(t: Tables) -> DataFrame:
    """(from_item_id, to_item_id): direct components of items."""
    needs = t.item_assets.select(F.col("item_id").alias("to_item_id"), F.explode(F.from_json("component_items_json", "array<string>")).alias("class_name"))
    return needs.join(t.item_assets.select("class_name", F.col("item_id").alias("from_item_id")), "class_name").select("from_item_id", "to_item_id")


def transitions(t: Tables) -> DataFrame:
    """Consecutive first ownerships of a player, with what a prediction at the source may know."""
    player = Window.partitionBy(*APPEARANCE).orderBy("buy_time", "item_id")
    return t.first_purchases.select(
        "hero_id", "fold", "won", F.col("phase").alias("from_phase"), F.col("prior_purchase_count").alias("from_position"), F.col("item_id").alias("from_item_id"),
        F.first("item_id").over(player.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first_item_id"), F.lead("item_id").over(player).alias("to_item_id"),
    ).where("to_item_id IS NOT NULL")


def item_transitions(t: Tables, support: int = 20) -> DataFrame:
    counted = transitions(t).groupBy("hero_id", "from_item_id", "to_item_id").agg(F.count("*").alias("observations"), F.sum(won()).alias("wins"), F.avg(won()).alias("outcome_rate"))
    return counted.where(F.col("observations") >= support)


#: Next-item models by what they condition on; the first two break ties by the hero's popularity of the target.
SEQUENCE_MODELS = {
    "first_order_transition": ["from_item_id"],
    "first_item_conditioned_transition": ["first_item_id", "from_item_id"],
    "hero_next_item_popularity": [],
    "hero_phase_next_item_popularity": ["from_phase"],
    "hero_position_next_item_popularity": ["from_position"],
}


def sequence_model_evaluation(t: Tables) -> DataFrame:
    """Coverage, top-k accuracy and mean reciprocal rank of five next-item models on test transitions, by hero.

    All models are one relation keyed by model and context: transitions are counted once for all contexts, each count is
    fanned out to the models, and one window ranks the targets of all of them. The subset ``non_component`` leaves out upgrades.
    """
    upgrade = component_edges(t).withColumn("is_upgrade", F.lit(1))
    counts = transitions(t).where(F.col("fold").isin("train", "test")).groupBy("fold", "hero_id", "from_phase", "from_position", "first_item_id", "from_item_id", "to_item_id").agg(F.count("*").alias("n"))

    def context(columns: Sequence[str]) -> Column:
        return F.concat_ws("/", F.lit(""), *[F.col(c).cast("string") for c in columns])

    views = F.array(*[F.struct(F.lit(m).alias("model"), context(c).alias("context")) for m, c in SEQUENCE_MODELS.items()])
    seen = counts.select("fold", "hero_id", "from_item_id", "to_item_id", "n", F.inline(views))
    learned = seen.where("fold = 'train'").groupBy("model", "hero_id", "context", "to_item_id").agg(F.sum("n").alias("n"))
    popular = learned.where("model = 'hero_next_item_popularity'").select("hero_id", "to_item_id", F.row_number().over(Window.partitionBy("hero_id").orderBy(F.desc("n"), "to_item_id")).alias("popularity"))
    tie = F.when(F.col("model").endswith("transition"), F.col("popularity")).otherwise(0)
    order = Window.partitionBy("model", "hero_id", "context").orderBy(F.desc("n"), tie, "to_item_id")
    ranks = learned.join(popular, ["hero_id", "to_item_id"]).select("model", "hero_id", "context", "to_item_id", F.row_number().over(order).alias("item_rank"))
    known = ranks.select("model", "hero_id", "context").distinct().withColumn("known", F.lit(1))
    tested = seen.where("fold = 'test'").groupBy("model", "hero_id", "context", "from_item_id", "to_item_id").agg(F.sum("n").alias("n"))
    joined = tested.join(ranks, ["model", "hero_id", "context", "to_item_id"], "left").join(known, ["model", "hero_id", "context"], "left").join(F.broadcast(upgrade), ["from_item_id", "to_item_id"], "left")  # an edge an item's component
    subsets = F.when(F.col("is_upgrade").isNull(), F.array(F.lit("all"), F.lit("non_component"))).otherwise(F.array(F.lit("all")))
    long = joined.withColumn("evaluation_subset", F.explode(subsets))
    total = F.sum("n")

    def share(within: Column) -> Column:
        return F.sum(F.when(within, F.col("n"))) / total

    seen_share = F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / total
    return long.groupBy("hero_id", "evaluation_subset", "model").agg(
        total.alias("test_transitions"),
        F.when(F.col("model").endswith("transition"), seen_share).otherwise(1.0).alias("context_coverage"),
        share(F.col("item_rank").isNotNull()).alias("target_coverage"),
        *[share(F.col("item_rank") <= k).alias(f"top{k}_accuracy") for k in (1, 3, 5)],
        (F.sum(F.col("n") / F.col("item_rank")) / total).alias("mean_reciprocal_rank"),
    )


def sequence_summary(t: Tables) -> DataFrame:
    """The models over all heroes, each hero weighted by its test transitions, with the spread of top-1 accuracy between heroes."""
    n = F.col("test_transitions")
    metrics = ("context_coverage", "target_coverage", "top1_accuracy", "top3_accuracy", "top5_accuracy", "mean_reciprocal_rank")
    means = [(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * n) / F.sum(n)).alias(m) for m in metrics]
    spread = [F.min("top1_accuracy").alias("least_top1"), F.median("top1_accuracy").alias("median_top1"), F.max("top1_accuracy").alias("most_top1")]
    return sequence_model_evaluation(t).groupBy("model", "evaluation_subset").agg(F.count("*").alias("heroes"), F.sum(n).alias("test_transitions"), *means, *spread)


def inflation_bounds(t: Tables) -> DataFrame:
    """Spread of purchase events per owner over a tier's items."""
    return item_aggregates(t).groupBy("tier").agg(F.count("*").alias("items"), F.min("event_inflation").alias("least"), F.median("event_inflation").alias("median"), quantile("event_inflation", 0.9).alias("q90"), F.max("event_inflation").alias("most"))


def matchup_summary(t: Tables, support: int = 20) -> DataFrame:
    """How far item deltas shrink once the hero's own matchup is taken out, by scope."""
    cells = matchup_cells(t, "whole_enemy_team", support=support).unionByName(matchup_cells(t, "same_lane", support=support))
    raw, left = F.abs("shrunk_interaction_delta"), F.abs("shrunk_item_residual_delta")
    return cells.groupBy("scope").agg(F.count("*").alias("cells"), F.sum("observations").alias("observations"), F.median(raw).alias("median_delta"), F.median(left).alias("median_residual"), F.max(left).alias("largest_residual"))


def sequence_backoff(t: Tables, support: int = 20) -> DataFrame:
    """Next-item support in four nested contexts, from (first item, previous item, position) down to nothing.

    Training rows whose second holds one first purchase only. A level's wildcards are 0. ``context_support`` counts the context.
    """
    alone = F.count("*").over(Window.partitionBy(*APPEARANCE, "buy_time"))
    player = Window.partitionBy(*APPEARANCE).orderBy("buy_time")
    rows = t.first_purchases.where("fold = 'train'").withColumn("alone", alone).where("alone = 1").select(
        "hero_id", "item_id",
        F.when(F.row_number().over(player) == 1, F.lit(0)).otherwise(F.first("item_id").over(player.rowsBetween(Window.unboundedPreceding, Window.currentRow))).cast("long").alias("first_item"),
        F.lag("item_id", 1, 0).over(player).alias("previous_item"), (F.row_number().over(player) - 1).cast("long").alias("position"),
    )
    counts = rows.groupBy("hero_id", "first_item", "previous_item", "position", "item_id").agg(F.count("*").alias("n"))
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    levels = F.array(*[
        F.struct(F.lit(level).alias("level"), *[(F.col(c) if keep else (none if c == "position" else zero)).alias(f"ctx_{c}") for c, keep in zip(("first_item", "previous_item", "position"), kept, strict=True)])
        for level, kept in ((3, (1, 1, 1)), (2, (0, 1, 1)), (1, (0, 0, 1)), (0, (0, 0, 0)))
    ])
    context = ["hero_id", "level", "ctx_first_item", "ctx_previous_item", "ctx_position"]
    summed = counts.select("hero_id", "item_id", "n", F.inline(levels)).groupBy(*context, "item_id").agg(F.sum("n").alias("support"))
    return summed.withColumn("context_support", F.sum("support").over(Window.partitionBy(*context))).where(F.col("support") >= support)


# -- audits ------------------------------------------------------------------------------------------------------------------


def calibration_audit(t: Tables) -> DataFrame:
    return t.player_matches.groupBy("hero_id", "calibration").agg(F.count("*").alias("player_matches"), F.sum(won()).alias("wins"), F.avg(won()).alias("outcome_rate"), F.avg("final_net_worth").alias("avg_final_net_worth"))


def rank_family() -> Column:
    return F.floor(F.col("average_badge") / 10).cast("int")


def daily_rank(t: Tables) -> DataFrame:
    return t.player_matches.groupBy(F.to_date("start_time").cast("string").alias("match_date"), rank_family().alias("rank_tier")).agg(F.count("*").alias("player_matches"), F.count_distinct("match_id").alias("matches"), F.avg(won()).alias("outcome_rate"))


def badge_counts(t: Tables) -> DataFrame:
    return t.player_matches.groupBy("average_badge").agg(F.count("*").alias("player_matches"), F.count_distinct("match_id").alias("matches"))


def adoption_by(t: Tables, stratum: Column, name: str, support: int = 20) -> DataFrame:
    """Adoption of items within each stratum of appearances."""
    totals = t.player_matches.groupBy("hero_id", stratum.alias(name)).agg(F.count("*").alias("hero_matches"))
    items = t.first_purchases.groupBy(*ITEM, stratum.alias(name)).agg(F.count("*").alias("adopter_matches")).where(F.col("adopter_matches") >= support)
    return items.join(totals, ["hero_id", name]).select(*ITEM, name, "adopter_matches", (F.col("adopter_matches") / F.col("hero_matches")).alias("adoption_rate"))


def adoption_stability(t: Tables, stratum: Column, name: str) -> DataFrame:
    """Agreement of adoption orders between every two strata, in one self-join."""
    rates = adoption_by(t, stratum, name).select(*ITEM, F.col(name).cast("string").alias("s"), "adoption_rate")
    other = rates.select(*ITEM, F.col("s").alias("stratum_b"), F.col("adoption_rate").alias("b"))
    pairs = rates.withColumnsRenamed({"s": "stratum_a", "adoption_rate": "a"}).join(other, ITEM).where("stratum_a < stratum_b")
    key = ["hero_id", "tier", "stratum_a", "stratum_b"]
    return ranking.spearman(pairs, key, "a", "b").join(ranking.top_k_jaccard(pairs, key, "a", "b", "item_id"), key).select(*key, F.col("n").alias("shared_items"), "spearman", F.col("jaccard").alias("top10_jaccard"))


def row_counts(t: Tables) -> DataFrame:
    """Rows of the derived tables, one row a name."""
    counts = {
        "player_matches": (t.player_matches, F.count("*")), "match_folds": (t.match_folds, F.count("*")), "purchases": (t.purchases, F.count("*")),
        "first_purchases": (t.first_purchases, F.count("*")), "decision_opportunities": (t.decision_opportunities, F.count("*")),
        "heroes": (t.player_matches, F.count_distinct("hero_id")), "hero_account_rows": (t.hero_account_counts, F.count("*")),
        "valid_purchase_net_worth": (t.first_purchases, F.count("own_net_worth_at_buy")), "valid_team_lead": (t.first_purchases, F.count("team_net_worth_lead")),
    }
    parts = [df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, n) in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def raw_flow(t: Tables) -> DataFrame:
    """Purchase flow of hero items by phase: rows, matches, outcome and timing."""
    return t.first_purchases.groupBy("hero_id", "item_id", "phase").agg(F.count("*").alias("matches"), F.avg(won()).alias("outcome_rate"), F.median("buy_time").alias("median_buy_time_s"), F.avg("buy_time").alias("avg_buy_time_s"))


def raw_purchase_events(t: Tables) -> DataFrame:
    return t.purchases.groupBy("hero_id", "item_id").agg(F.count("*").alias("events"), F.count_if(F.col("item_purchase_ordinal") == 1).alias("unique_purchases"))


def account_breadth(t: Tables) -> DataFrame:
    """Unique accounts and appearances of each hero."""
    return t.player_matches.groupBy("hero_id").agg(F.count("*").alias("player_matches")).join(t.hero_account_counts, "hero_id").withColumn("matches_per_account", F.col("player_matches") / F.col("unique_accounts"))


def path_label(t: Tables) -> DataFrame:
    """The most imbued ability of each hero, with its share of appearances; ties to the smaller ability."""
    votes = t.purchases.where("imbued_ability_id > 0").groupBy("hero_id", "imbued_ability_id").agg(F.count_distinct("match_id", "player_slot").alias("n"))
    totals = t.player_matches.groupBy("hero_id").agg(F.count("*").alias("players"))
    best = votes.groupBy("hero_id").agg(F.max_by(F.struct("imbued_ability_id", "n"), F.struct("n", -F.col("imbued_ability_id"))).alias("b"))
    return best.join(totals, "hero_id").select("hero_id", F.col("b.imbued_ability_id").cast("long").alias("imbued_ability_id"), F.col("b.n").alias("voters"), (F.col("b.n") / F.col("players")).alias("share"))
