"""The kernels of :mod:`skirmish.plans.kernels` and the itemset operators over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import stats
from skirmish.operators import itemsets, ranking
from skirmish.operators.quantiles import exact_quantiles
from skirmish.plans import analytics as a
from skirmish.plans import kernels as k
from skirmish.plans.cohort import APPEARANCE, Tables

RICH, EARLY, LATE = 250_000, 12_000, 20_000
PATH_ITEMS = 8


def late_game_cohort(t: Tables, minimum: int = RICH) -> DataFrame:
    rich = t.player_matches.where(F.col("final_net_worth") >= minimum)
    return rich.groupBy("hero_id").agg(
        F.count("*").alias("player_matches"), F.avg(a.won()).alias("outcome_rate"), F.median("duration_s").alias("median_duration_s"),
        a.quantile("duration_s", 0.25).alias("duration_q25_s"), a.quantile("duration_s", 0.75).alias("duration_q75_s"), F.median("final_net_worth").alias("median_final_net_worth"),
    )


def late_game_items(t: Tables, minimum: int = RICH) -> DataFrame:
    """Items of the players who ended rich: timing, worth at purchase and outcome."""
    rich = t.first_purchases.where(F.col("final_net_worth") >= minimum)
    return rich.groupBy("hero_id", "item_id").agg(
        F.count("*").alias("buyer_matches"), F.avg(a.won()).alias("outcome_rate"), F.median("buy_time").alias("median_buy_time_s"), a.quantile("buy_time", 0.25).alias("buy_time_q25_s"),
        a.quantile("buy_time", 0.75).alias("buy_time_q75_s"), F.median("own_net_worth_at_buy").alias("median_buy_net_worth"), (F.count("own_net_worth_at_buy") / F.count("*")).alias("valid_buy_nw_share"),
    )


def late_capstones(t: Tables, minimum: int = LATE) -> DataFrame:
    """Purchases made when already rich, with the share of such buyers that chose the item."""
    late = t.first_purchases.where(F.col("own_net_worth_at_buy") >= minimum)
    buyers = late.groupBy("hero_id").agg(F.count_distinct(*APPEARANCE).alias("late_purchasers"))
    items = late.groupBy("hero_id", "item_id").agg(F.count_distinct(*APPEARANCE).alias("buyer_matches"), F.avg(a.won()).alias("observed_outcome_rate"), F.median("buy_time").alias("median_buy_time_s"))
    return items.join(buyers, "hero_id").withColumn("buyer_share", F.col("buyer_matches") / F.col("late_purchasers"))


def core_economy_reference(t: Tables, minimum_badge: int = 81, reserved: int = 3) -> DataFrame:
    """Median unsold items and their cost over strong players, those without items included, and the cost that a core should have."""
    held = t.purchases.where("sold_time = 0").groupBy(*APPEARANCE).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    players = t.player_matches.where(F.col("average_badge") >= minimum_badge).join(held, APPEARANCE, "left")
    n, cost = F.coalesce("n", F.lit(0)), F.coalesce("cost", F.lit(0))
    counted = players.select("match_id", "duration_s", n.alias("items"), cost.alias("cost")).persist()
    middle = exact_quantiles(counted, [], ["duration_s", "items", "cost"], (0.5,)).get((), {})
    duration, items, spent = (F.lit(middle.get((c, 0.5))) for c in ("duration_s", "items", "cost"))
    out = counted.agg(
        F.count_distinct("match_id").alias("matches"), F.count("*").alias("player_matches"), F.avg("duration_s").alias("mean_duration_s"), F.first(duration).alias("median_duration_s"),
        F.first(items).cast("int").alias("median_items"), F.first(spent).cast("int").alias("median_cost"),
    )
    spared = F.least(F.lit(reserved), F.col("median_items") - 1)
    return out.withColumn("target_core_cost", F.bround(F.col("median_cost") * (F.col("median_items") - spared) / F.nullif(F.col("median_items"), F.lit(0)), 0))


def members(t: Tables, least: int = 4) -> DataFrame:
    """A player subset for member-restricted statistics: those with at least ``least`` different items."""
    return t.first_purchases.groupBy(*APPEARANCE).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*APPEARANCE)


def path_item_metrics(t: Tables) -> DataFrame:
    return a.item_aggregates(t, members=members(t)).select(*a.ITEM, "adopter_matches", "wins", "purchase_events", "hero_player_matches", "adoption_rate", "median_buy_time_s")


def early_inventories(t: Tables, maximum: int = EARLY) -> DataFrame:
    """Items that a player first owned at a known net worth of at most ``maximum``, in order of purchase."""
    early = t.first_purchases.where(F.col("own_net_worth_at_buy") <= maximum)
    return early.groupBy(*APPEARANCE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("buy_time", "item_id"))), lambda x: x["item_id"]), ",").alias("items"))


def unsold_inventories(t: Tables) -> DataFrame:
    held = t.first_purchases.where("sold_time = 0")
    return held.groupBy("hero_id", *APPEARANCE, "fold").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def itemset_support(t: Tables, size: int = 2, support: int = 20) -> DataFrame:
    found = itemsets.itemset_support(unsold_inventories(t), ["hero_id"], "items", size, support, "fold")
    return found.withColumn("itemset", F.array_join("itemset", ","))


def item_rollups(t: Tables) -> DataFrame:
    """The item aggregates by hero and tier, by hero, by tier and over all, as one relation in one pass; ``level`` tells which of both a row sums over (bits, hero first)."""
    n = F.col("adopter_matches")
    rolled = a.item_aggregates(t).groupingSets([["hero_id", "tier"], ["hero_id"], ["tier"], []], "hero_id", "tier")
    return rolled.agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("items"), F.sum(n).alias("adopters"), F.sum("purchase_events").alias("purchases"), (F.sum("wins") / F.sum(n)).alias("outcome_rate"),
        (F.sum(F.col("adoption_rate") * n) / F.sum(n)).alias("mean_adoption"), (F.sum("purchase_events") / F.sum(n)).alias("inflation"), F.min("raw_outcome_rate").alias("least_rate"), F.max("raw_outcome_rate").alias("most_rate"),
        F.max_by("item_id", F.struct("adopter_matches", -F.col("item_id"))).alias("most_adopted"),
    )


def decision_rollups(t: Tables) -> DataFrame:
    """Decisions by hero, tier and phase in all combinations of one and two of them, and over all, with the share whose state was known."""
    sets = [["hero_id", "tier"], ["hero_id", "phase"], ["tier", "phase"], ["hero_id"], ["tier"], ["phase"], []]
    rolled = t.decision_opportunities.groupingSets(sets, "hero_id", "tier", "phase")
    return rolled.agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("decisions"), F.count_distinct("match_id").alias("matches"), F.avg(a.won()).alias("outcome_rate"),
        (F.count("own_net_worth_at_buy") / F.count("*")).alias("known_share"), F.avg("buy_time").alias("mean_buy_time_s"), F.count_distinct("item_id").alias("items"),
    )


def itemset_levels(t: Tables, largest: int = 4, support: int = 5) -> DataFrame:
    """All sets of up to ``largest`` unsold items with their supports, level by level."""
    found = itemsets.frequent_itemsets(unsold_inventories(t), "hero_id", "items", largest, support, "fold")
    return found.withColumn("itemset", F.array_join("itemset", ","))


def pair_precedence(t: Tables) -> DataFrame:
    return itemsets.pair_precedence(t.first_purchases, ["hero_id"], APPEARANCE, "item_id", "buy_time")


def path_items(t: Tables, n: int = PATH_ITEMS) -> DataFrame:
    """Each hero's ``n`` most adopted items."""
    return ranking.top_k(a.item_aggregates(t), ["hero_id"], [F.desc("adoption_rate"), F.col("item_id")], n).select("hero_id", "item_id", "adoption_rate", "cost")


def _path_coverage(t: Tables, items: DataFrame) -> DataFrame:
    bought = t.first_purchases.join(F.broadcast(items.select("hero_id", "item_id")), ["hero_id", "item_id"], "left_semi")  # n rows a hero
    counted = bought.groupBy(*APPEARANCE).agg(F.count("*").alias("bought"))
    return t.player_matches.join(counted, APPEARANCE, "left").withColumn("bought", F.coalesce("bought", F.lit(0).cast("long"))).select(*APPEARANCE, "hero_id", "duration_s", "final_net_worth", "bought")


def path_coherence(t: Tables, folds: bool = False) -> DataFrame:
    """How much of its hero's path a player buys, against what independent adoption would give (a Poisson-binomial tail)."""
    items = path_items(t)
    path = items.groupBy("hero_id").agg(F.array_sort(F.collect_list("adoption_rate")).alias("p"), F.sum("cost").alias("path_cost"), F.count("*").alias("path_actions"))
    path = path.select("hero_id", "path_cost", "path_actions", *[stats.poisson_binomial_tail(F.col("p"), F.lit(m)).alias(f"independent_share_with_{m}") for m in (2, 4)])
    rows = _path_coverage(t, items).join(F.broadcast(path), "hero_id")  # a row a hero
    key = ["hero_id"]
    if folds:
        rows, key = rows.join(t.match_folds, "match_id"), ["hero_id", "fold"]

    def share(test: Column, within: Column | None = None) -> Column:
        return F.avg(F.when(within, test.cast("int")) if within is not None else test.cast("int"))

    b = F.col("bought")
    out = [F.count("*").alias("player_matches"), F.avg(b / F.col("path_actions")).alias("mean_path_coverage"), *[share(b >= m).alias(f"share_with_{m}") for m in (2, 4)], share(b == F.col("path_actions")).alias("share_complete")]
    if not folds:
        long, rich = F.col("duration_s") >= 2100, F.col("final_net_worth") >= F.col("path_cost")
        out += [
            F.median(b).alias("median_path_items"), a.quantile("bought", 0.75).alias("path_items_q75"), F.first("independent_share_with_4").alias("independent_share_with_4"),
            (share(b >= 4) / F.first("independent_share_with_4")).alias("coherence_lift"), F.count_if(long).alias("long_matches"), share(b >= 2, long).alias("long_match_share"), F.count_if(rich).alias("affordable_matches"), share(b >= 2, rich).alias("affordable_share"),
        ]
    return rows.groupBy(*key).agg(*out)


def hazard_incidence(t: Tables, tier: int = 4) -> DataFrame:
    """Incidence of the first item of a tier, with the end of the match as the competing event."""
    first = t.first_purchases.where(F.col("tier") == tier).groupBy(*APPEARANCE).agg(F.min("buy_time").alias("bought"))
    rows = t.player_matches.join(first, APPEARANCE, "left").select("hero_id", F.coalesce("bought", "duration_s").alias("time_s"), F.col("bought").isNotNull().alias("event"))
    return k.cumulative_incidence(rows, ["hero_id"], "time_s", F.col("event"))


def landmarks(t: Tables) -> DataFrame:
    return k.landmark_estimates(t.player_matches, ["hero_id"], "duration_s", a.won(), (1500, 1800, 2400, 3000, 3600))


def purchase_prefixes(t: Tables) -> DataFrame:
    """Prefix decisions over each player's first ownerships, in order; equal paths are summed before they are fanned out."""
    paths = t.first_purchases.groupBy("hero_id", *APPEARANCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("buy_time", "item_id"))), lambda x: x["item_id"]).alias("path"))
    counted = paths.groupBy("hero_id", F.slice("path", 1, 3).alias("path")).agg(F.count("*").alias("w"))
    return k.prefix_decisions(counted, ["hero_id"], "path", "w", 3)


def duration_profile(t: Tables) -> DataFrame:
    """The driver's matches last 1 500 s at least; 200 s less give the first bucket some."""
    buckets = t.player_matches.groupBy("hero_id", k.duration_bucket(F.col("duration_s") - 200).alias("bucket")).agg(F.sum(a.won()).alias("wins"), F.count("*").alias("matches"))
    return k.duration_profile(buckets, ["hero_id"])


def _buckets(t: Tables) -> DataFrame:
    worth = F.floor(F.col("own_net_worth_at_buy") / 1000) * 1000
    return t.first_purchases.groupBy(*a.ITEM, worth.alias("bucket")).agg(F.count("*").alias("matches"), F.sum(a.won()).alias("wins"))


def purchase_windows(t: Tables) -> DataFrame:
    return k.purchase_windows(_buckets(t), a.ITEM)


def tier_horizons(t: Tables) -> DataFrame:
    """Twice the tier's weighted median net worth, to the next thousand."""
    medians = k.weighted_median(_buckets(t).where("bucket IS NOT NULL"), ["hero_id", "tier"], "bucket", "matches", "bucket")
    return medians.select("hero_id", "tier", (F.ceil((F.col("bucket") + 500) * 2 / 1000) * 1000).cast("long").alias("horizon"))


def predictions(t: Tables) -> DataFrame:
    """Training rates of items as predictions for later decisions."""
    rates = t.decision_opportunities.where("fold = 'train'").groupBy(*a.ITEM, "phase").agg(F.avg(a.won()).alias("p"))
    later = t.decision_opportunities.where("fold <> 'train'").select(*a.ITEM, "phase", "fold", "average_badge", F.year("start_time").alias("patch"), a.won().alias("y"))
    return later.join(rates, [*a.ITEM, "phase"])


def calibration_report(t: Tables) -> DataFrame:
    labels = {"hero": F.col("hero_id"), "rank": a.rank_family(), "patch": F.col("patch"), "tier": F.col("tier")}
    return k.calibration_slices(predictions(t).where("fold = 'test'"), labels, 0.52)


def abstention_threshold(t: Tables) -> DataFrame:
    return k.abstention_threshold(predictions(t).where("fold = 'validation'"), 0.6, (0.5, 0.51, 0.52, 0.55, 0.6))


def off_policy(t: Tables) -> DataFrame:
    """Value of choosing uniformly among a stratum's items, from logged decisions with their empirical propensities."""
    stratum = ["hero_id", "phase", "tier"]
    cells = t.decision_opportunities.groupBy(*stratum, "item_id").agg(F.count("*").alias("n"), F.avg(a.won()).alias("rate"))
    cells = cells.withColumns({"propensity": F.col("n") / F.sum("n").over(Window.partitionBy(*stratum)), "width": F.count("*").over(Window.partitionBy(*stratum))})
    maps = cells.groupBy(*stratum).agg(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), 1 / F.col("width")))).alias("target"), F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), "rate"))).alias("predicted"))
    logged = t.decision_opportunities.select(*stratum, "item_id", a.won().alias("outcome")).join(cells.select(*stratum, "item_id", "propensity"), [*stratum, "item_id"]).join(maps, stratum)
    return k.off_policy(logged.withColumn("action", F.col("item_id").cast("string")), ["hero_id"]).select("hero_id", "support", "supported", "overlap", "ips", "snips", "dr", "ips_clip_5", "dr_clip_5", "effective_sample_size", "maximum_weight")


def group_leakage(t: Tables) -> DataFrame:
    rows = t._admitted_players.join(t.match_folds, "match_id").select("fold", F.col("match_id").alias("match_group"), F.col("account_id").alias("player_group"))
    return k.group_leakage(rows, "fold", ["match_group", "player_group"])


def select_then_estimate(t: Tables) -> DataFrame:
    effects = t.decision_opportunities.groupBy("fold", "hero_id", "tier", "item_id").agg(F.count("*").alias("observations"), F.avg(a.won()).alias("estimate"))
    return k.select_then_estimate(effects, ["hero_id", "tier"], "item_id", "train", "test", 20)


def monitoring(t: Tables) -> DataFrame:
    """Daily snapshots of the cohort's own health, put through the monitoring rules."""
    daily = t.player_matches.groupBy(F.to_date("start_time").cast("string").alias("day")).agg(
        F.count("*").alias("exposures"), F.count_if(F.col("calibration")).alias("unhandled_branches"), F.avg((F.col("final_net_worth") < 20000).cast("int")).alias("invalid_state_rate"),
        F.abs(F.avg(a.won()) - 0.5).alias("calibration_error"), (F.max("hero_id") / 5).alias("recommendation_concentration"), (F.count_if(F.col("duration_s") > 3890) > 0).alias("long"),
    )
    none = F.lit(0)
    snapshots = daily.withColumns(
        {"mechanics_match": F.lit(True), "schema_decode_ok": F.lit(True), "preservation_unchanged": F.col("exposures") < 36, "restore_failures": none, "snapshot_age_s": F.when(F.col("long"), 90000).otherwise(100), "path_rejections": none, "render_rejections": none, "install_failures": none}
    )
    return k.monitoring_decision(snapshots, ["day"])


def net_worth_validity(t: Tables) -> DataFrame:
    """How purchase-time net worth would be judged if the opening minutes reported the final value, as a broken source does."""
    early = F.col("buy_time") < 180
    raw = t.bought.withColumns(
        {
            "net_worth": F.when(early & (F.col("item_id") % 3 == 0), F.col("final_net_worth")).otherwise(F.coalesce("own_net_worth_at_buy", F.lit(0)).cast("double")),
            "preceding_net_worth": F.when(early, F.col("buy_time") * 10.0), "preceding_time_s": F.when(early, F.col("buy_time") - F.col("item_id").cast("int") * 4),
        }
    )
    judged = k.validated_net_worth(raw)
    return judged.groupBy("net_worth_status").agg(F.count("*").alias("n"), F.count("valid_net_worth").alias("known"), F.sum("valid_net_worth").cast("decimal(38,2)").cast("double").alias("total"))


def affinities(t: Tables) -> DataFrame:
    """Weighted tags that an item shares with a hero; tags follow from ids here."""
    tags = ("weapon", "vitality", "spirit", "active")
    item = t.item_assets.select("item_id", F.array_compact(F.array(F.col("slot"), F.when(F.col("active"), F.lit("active")))).alias("item_tags"))
    hero = t.player_matches.select("hero_id").distinct().withColumn("hero_tags", F.filter(F.array(*map(F.lit, tags)), lambda x: (F.length(x) + F.col("hero_id")) % 2 == 0))
    pairs = item.crossJoin(F.broadcast(hero))  # heroes and items: two catalogues
    return pairs.select("hero_id", "item_id", k.affinity(F.col("hero_tags"), F.col("item_tags"), {"weapon": 3, "vitality": 2, "spirit": 2, "active": 1}).alias("affinity"))


#: Spend at which a category's bonuses start, in the driver's catalogue (costs from 800 to 6400).
BONUSES = (800, 1600, 4800, 9600)


def category_bonuses(t: Tables) -> DataFrame:
    """How often each hero's purchases reach a category's bonus, and when."""
    crossed = k.crossings(t.purchases, ["match_id", "player_slot", "slot"], ["event_order"], "cost", BONUSES)
    return crossed.groupBy("hero_id", "slot", "threshold").agg(F.count("*").alias("n"), F.avg("buy_time").alias("mean_buy_time_s"))
