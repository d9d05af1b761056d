"""Model-based analyses: shrinkage, adjusted models, contrasts, item bundles and build paths.

Each needs an algorithm that SQL can't express. Spark prepares, groups and bounds the rows; a numpy kernel of :mod:`skirmish.functions.models` handles one small group
at a time. Groups of catalogue items are bounded by the catalogue. Contrasts (:mod:`skirmish.plans.contrasts`), ridge models and item sets work on all rows, as sums that tasks hand on. A hero's players are
bounded by ``ROWS`` in ``build_paths`` alone: of more a share of the matches is taken by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions import models, newton
from skirmish.operators import itemsets, ranking
from skirmish.operators.paths import state_counts, supported_path
from skirmish.operators.replay import final_inventories, incremental_cost, schedule
from skirmish.plans import analytics as a
from skirmish.plans import completion, contrasts, estimates
from skirmish.plans.cohort import APPEARANCE, Tables

ROWS = 50_000
FEATURES = ["buy_time", "own_net_worth_at_buy", "team_net_worth_lead", "state_age_s", "prior_catalog_spend", "prior_purchase_count", "average_badge"]
GROUP = ["hero_id", "tier"]


def bounded(df: DataFrame, by: Sequence[str], rows: int = ROWS) -> DataFrame:
    """About ``rows`` rows of each group at most, whole matches together: those whose match has a hash below the group's share. A filter, without a sort of a group."""
    share = df.groupBy(*by).agg((rows / F.count("*")).alias("__share"))
    place = F.shiftrightunsigned(F.xxhash64("match_id"), 11) / F.lit(2.0**53)
    return df.join(F.broadcast(share), list(by)).where(place < F.col("__share")).drop("__share")  # a row a hero or a hero and tier


def catalogue(t: Tables) -> tuple[dict[int, tuple[int, ...]], dict[int, int], set[int]]:
    """(components, cost, active items) of the item catalogue, whose size doesn't depend on the matches."""
    components: dict[int, tuple[int, ...]] = {}
    for r in a.component_edges(t).orderBy("to_item_id", "from_item_id").collect():
        components[r["to_item_id"]] = (*components.get(r["to_item_id"], ()), r["from_item_id"])
    rows = t.item_assets.select("item_id", "cost", "active").collect()
    return components, {r["item_id"]: r["cost"] for r in rows}, {r["item_id"] for r in rows if r["active"]}


def _with(df: DataFrame, *doubles: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in doubles]])


# -- shrinkage ---------------------------------------------------------------------------------------------------------------


def item_eb(t: Tables, folds: bool = False) -> DataFrame:
    """Item aggregates with empirical-Bayes means and 95 % intervals under a prior fitted to each hero and tier."""
    base = a.item_outcomes(t, folds=folds)
    key = [*(["fold"] if folds else []), *GROUP]
    pooled = base.agg((F.sum("wins") / F.greatest(F.sum("adopter_matches"), F.lit(1))).alias("pooled_mean"))
    rows = base.select(*key, "item_id", "adopter_matches", "wins", "adoption_rate", "raw_outcome_rate", "median_buy_time_s").crossJoin(F.broadcast(pooled))  # one row
    schema = _with(rows.drop("pooled_mean"), "eb_mean", "eb_lower", "eb_upper", "eb_prior_strength").add("prior_source", "string")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        prior = models.fit_beta_prior(group["wins"], group["adopter_matches"], float(group["pooled_mean"].iloc[0]))
        posterior = [models.beta_posterior(w, n, prior) for w, n in zip(group["wins"], group["adopter_matches"], strict=True)]
        out = group.drop(columns="pooled_mean")
        out[["eb_mean", "eb_lower", "eb_upper"]] = posterior
        return out.assign(eb_prior_strength=prior.strength, prior_source=prior.source)

    return rows.groupBy(*key).applyInPandas(fit, schema)


def state_adjusted(t: Tables) -> DataFrame:
    """Rates standardised to the hero's states in the tier: posterior means of an item's cells, weighted by how often the states occur at all."""
    cells = a.state_cells(t)
    overall = cells.groupBy(*a.ITEM).agg(F.sum("wins").alias("w"), F.sum("observations").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        prior = models.fit_beta_prior(group["w"], group["n"])
        return group[GROUP].head(1).assign(alpha=prior.alpha, beta=prior.beta)

    priors = overall.select(*GROUP, "w", "n").groupBy(*GROUP).applyInPandas(fit, "hero_id int, tier int, alpha double, beta double")
    states = cells.withColumns({"reference": F.sum("observations").over(Window.partitionBy(*GROUP, *a.STATE)), "total": F.sum("observations").over(Window.partitionBy(*GROUP))})
    posterior = (F.col("wins") + F.col("alpha")) / (F.col("observations") + F.col("alpha") + F.col("beta"))
    return states.join(F.broadcast(priors), GROUP).groupBy(*a.ITEM).agg(  # a row a hero and tier
        (F.sum(F.col("reference") * posterior) / F.sum("reference")).alias("state_adjusted_eb"), (F.sum("reference") / F.first("total")).alias("state_coverage")
    )


def bootstrap(t: Tables, repetitions: int = 500, seed: int = 7) -> DataFrame:
    """Binomial bootstrap intervals of the outcome rates of each tier's ten most adopted items, seeded by hero and item."""
    top = ranking.top_k(a.item_outcomes(t), GROUP, [F.desc("adoption_rate"), F.col("item_id")], 10).select(*a.ITEM, "adopter_matches", "wins")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        ends = []
        for r in group.itertuples():
            rng = np.random.default_rng([seed, r.hero_id, r.item_id])
            ends.append(np.quantile(rng.binomial(r.adopter_matches, r.wins / r.adopter_matches, repetitions) / r.adopter_matches, (0.025, 0.5, 0.975)))
        return group.assign(**dict(zip(("low", "middle", "high"), np.array(ends).T, strict=True)))

    return top.groupBy(*GROUP).applyInPandas(draw, _with(top, "low", "middle", "high"))


# -- adjusted models ---------------------------------------------------------------------------------------------------------


def _decisions(t: Tables) -> DataFrame:
    return t.decision_opportunities.select(*APPEARANCE, "fold", *a.ITEM, a.won().alias("y"), *[F.coalesce(F.col(f), F.lit(0)).cast("double").alias(f) if f == "prior_catalog_spend" else F.col(f).cast("double").alias(f) for f in FEATURES])


def ridge_holdout(t: Tables) -> DataFrame:
    """Brier score and log loss on test decisions of a ridge logistic model of state alone and one with items, by hero and tier.

    Only groups of at least 200 decisions, both outcomes, two items, 100 training and 20 test rows are modelled, on all their training rows (:func:`newton.fit_with_items`); all test rows are scored.
    """
    rows = _decisions(t)
    train = F.col("fold") == "train"
    counts = rows.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.count_distinct("y").alias("outcomes"), F.count_distinct("item_id").alias("items"),
        F.count_if(train).alias("train_rows"), F.count_if(F.col("fold") == "test").alias("test_rows"), F.count_distinct(F.when(train, F.col("y"))).alias("train_outcomes"),
    )
    usable = counts.where("n >= 200 AND outcomes = 2 AND items >= 2 AND train_rows >= 100 AND test_rows >= 20 AND train_outcomes = 2").select(*GROUP, "train_rows", "test_rows")
    groups = usable.persist()  # a row a hero and tier, as all that is broadcast here
    learned = newton.fit_with_items(rows.where(train).join(F.broadcast(groups.select(*GROUP)), GROUP), GROUP, "item_id", FEATURES, "y", 0.5)
    fields = [rows.schema[c] for c in GROUP]
    arrays = {"items": T.LongType(), "weights": T.DoubleType(), "fill": T.DoubleType(), "flagged": T.LongType(), "centre": T.DoubleType(), "spread": T.DoubleType()}
    schema = T.StructType([*fields, T.StructField("model", T.StringType()), *[T.StructField(n, T.ArrayType(x)) for n, x in arrays.items()]])
    both = [(k, m, name, items, weights) for k, m in learned.items() for name, items, weights in (("state", [], m.state), ("state_and_item", m.items, m.state_and_item))]
    fitted = rows.sparkSession.createDataFrame([(*k, name, items, *(v.tolist() for v in (weights, m.fill, m.flagged, m.centre, m.spread))) for k, m, name, items, weights in both], schema)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby([*GROUP, "model"]):
                r = part.iloc[0]
                state = models.Scaler.of(r["fill"], r["flagged"], r["centre"], r["spread"])(part[FEATURES].to_numpy(float))
                hot = (part["item_id"].to_numpy()[:, None] == np.asarray(r["items"], np.int64)).astype(float)
                p = np.clip(models.logistic_predict(np.asarray(r["weights"]), np.hstack([hot, state])), 1e-6, 1 - 1e-6)
                y = part["y"].to_numpy(float)
                yield part[[*GROUP, "model"]].assign(square=(p - y) ** 2, loss=-(y * np.log(p) + (1 - y) * np.log(1 - p)))

    tested = rows.where("fold = 'test'").join(F.broadcast(fitted), GROUP)
    scored = tested.mapInPandas(predict, "hero_id int, tier int, model string, square double, loss double")
    return scored.groupBy(*GROUP, "model").agg(F.avg("square").alias("brier"), F.avg("loss").alias("log_loss")).join(F.broadcast(groups), GROUP).select(*GROUP, "model", "train_rows", "test_rows", "brier", "log_loss")


def dr_contrasts(t: Tables) -> DataFrame:
    """Cross-fitted doubly robust contrast of each hero's most chosen item of a tier with the second, and its gates."""
    return contrasts.dr_contrasts(t, _decisions(t), FEATURES)


def core_alternatives(t: Tables, core: DataFrame, additions: DataFrame) -> DataFrame:
    """Alternatives to the items that complete each hero's backbone. ``core`` and ``additions`` as :func:`backbones` and :func:`completions` return them."""

    def ids(column: str) -> F.Column:
        return F.transform(F.split(column, ","), lambda x: x.cast("long"))

    first = additions.where("rank = 1").select("hero_id", ids("additions").alias("more"))
    whole = core.join(F.broadcast(first), "hero_id").select("hero_id", F.concat(ids("items"), "more").alias("items"), ids("items").alias("fixed"))  # a row a hero
    return contrasts.core_alternatives(t, whole, _decisions(t), FEATURES, catalogue(t))


# -- inventories and bundles -------------------------------------------------------------------------------------------------


def inventories(t: Tables) -> DataFrame:
    """Every player's items at the end of the match, replayed."""

    def replayed() -> DataFrame:
        components, _, _ = catalogue(t)
        held = final_inventories(t.purchases, APPEARANCE, components)
        return held.join(t.player_matches.select(*APPEARANCE, "hero_id"), APPEARANCE).join(t.match_folds, "match_id")

    return t.once("inventories", replayed)


#: The limits of the backbone gates.
RETENTION, SHARE_RANGE = 0.5, 0.10


def backbones(t: Tables, sizes: Sequence[int] = (4, 5, 6), support: int = 20, fold_support: int | None = None, affinity: dict[int, int] | None = None) -> DataFrame:
    """The longest stable bundle of items of each hero.

    All bundles of each size are counted, level by level; those that are schedulable, supported in every fold and stable in share over the
    folds qualify. The best of the smallest size has the largest ``(1 + log(1 + affinity)) * log(1 + support)``; from it, a superset follows as long as it keeps ``RETENTION`` of
    the support, the most supported one, then that with most affinity. ``affinity``: points by item.
    """
    floor, points = support if fold_support is None else fold_support, affinity or {}
    components, cost, active = catalogue(t)
    held = inventories(t).select("hero_id", "fold", F.array_distinct("items").alias("items"))
    totals = held.groupBy("hero_id").agg(*[F.count_if(F.col("fold") == f).alias(f"{f}_total") for f in models.FOLDS])
    counted = itemsets.frequent_itemsets(held, "hero_id", "items", max(sizes), support, "fold", models.FOLDS).where(F.col("size").isin(*sizes))

    def liking(items: tuple) -> int:
        return sum(points.get(i, 0) for i in items)

    def score(x: tuple) -> tuple:
        return -(1 + math.log1p(liking(x[1]))) * math.log1p(x[2]), -x[2], x[1]

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        ok = []
        for r in group.to_dict("records"):
            n = [r[f"{f}_support"] for f in models.FOLDS]
            shares = [x / r[f"{f}_total"] for x, f in zip(n, models.FOLDS, strict=True) if r[f"{f}_total"]]
            if min(n) >= floor and max(shares) - min(shares) <= SHARE_RANGE and schedule(list(r["itemset"]), components, cost, active) is not None:
                ok.append((r["size"], tuple(r["itemset"]), r["support"], min(n)))
        chosen = None
        for size in sizes:
            fits = [x for x in ok if x[0] == size and (chosen is None or (set(chosen[1]) < set(x[1]) and x[2] / chosen[2] >= RETENTION))]
            if not fits:
                break
            chosen = min(fits, key=score if chosen is None else lambda x: (-x[2], -liking(x[1]), x[1]))
        rows = [] if chosen is None else [(group["hero_id"].iloc[0], ",".join(map(str, chosen[1])), chosen[0], chosen[2], chosen[3])]
        return pd.DataFrame(rows, columns=["hero_id", "items", "size", "support", "least_fold_support"])

    return counted.join(F.broadcast(totals), "hero_id").groupBy("hero_id").applyInPandas(choose, "hero_id int, items string, size int, support long, least_fold_support long")  # a row a hero


def completions(t: Tables, core: DataFrame, support: int = 5, pool: int = 12, most: int = 2) -> DataFrame:
    """Additions to each hero's backbone (``core``, as :func:`backbones` returns it): supported together by players who hold it, best joint support first."""
    core = core.select("hero_id", F.transform(F.split("items", ","), lambda x: x.cast("long")).alias("core"))
    holders = inventories(t).join(F.broadcast(core), "hero_id").where(F.size(F.array_except("core", "items")) == 0)  # a row a hero
    extra = holders.select("hero_id", "core", "fold", F.array_sort(F.array_except("items", "core")).alias("items"))
    parts = [itemsets.itemset_support(extra, ["hero_id"], "items", size, support, "fold") for size in range(1, most + 1)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = ranking.top_k(found, ["hero_id"], [F.desc("support"), F.desc(F.size("itemset")), F.col("itemset")], pool)
    return ranked.select("hero_id", F.array_join("itemset", ",").alias("additions"), "support", F.col("rank").cast("long").alias("rank"))


def complete_cores(t: Tables, core: DataFrame, support: int = 20) -> DataFrame:
    """Every supported completion of each hero's backbone (``core``, as :func:`backbones` returns it) with its gates, and the one near the economy target."""
    components, cost, active = catalogue(t)
    core = core.select("hero_id", F.transform(F.split("items", ","), lambda x: x.cast("long")).alias("core"))
    holders = inventories(t).join(F.broadcast(core), "hero_id").where(F.size(F.array_except("core", "items")) == 0)  # a row a hero
    reference = estimates.core_economy_reference(t).first()

    def legal(items: Sequence[int]) -> bool:
        return schedule(list(items), components, cost, active) is not None

    return completion.completions(holders.select("hero_id", "fold", "core", "items"), cost, legal, reference["target_core_cost"], BUDGET, support)


# -- paths -------------------------------------------------------------------------------------------------------------------

#: The limits of a path.
BUDGET, SLOTS, ACTIVES, ACTIONS, PER_TIER = 30_000, 9, 4, (8, 10, 12), 4


def walk(rows: Sequence[dict], score: str, components: dict, cost: dict, active: set[int]) -> dict:
    """Greedy path under budget and slots: four candidates a tier by score, bought in order of usual time; a tenth item sells the weakest, a fifth active is skipped."""
    place: dict[int, float] = {}
    for tier in {r["tier"] for r in rows}:
        order = sorted((r for r in rows if r["tier"] == tier), key=lambda r: (-np.inf if r[score] is None else r[score], r["adopter_matches"], -r["item_id"]))
        place |= {r["item_id"]: k / max(1, len(order) - 1) for k, r in enumerate(order)}
    tier_of = {r["item_id"]: r["tier"] for r in rows}
    usable = sorted((r for r in rows if r[score] is not None), key=lambda r: (-place[r["item_id"]], -r["adoption_rate"], r["item_id"]))
    short = [r for k, r in enumerate(usable) if sum(x["tier"] == r["tier"] for x in usable[:k]) < PER_TIER]
    held: list[int] = []
    path: list[int] = []
    paid = 0
    for r in sorted(short, key=lambda r: (r["median_buy_time_s"] or 99_999, -place[r["item_id"]], r["item_id"])):
        item = r["item_id"]
        price = incremental_cost(item, held, components, cost)
        rest = [i for i in held if i not in components.get(item, ())]
        if len(path) >= ACTIONS[1] or paid + price > BUDGET or (item in active and len(active & set(rest)) >= ACTIVES):
            continue
        if len(rest) >= SLOTS:
            rest.remove(min(rest, key=lambda i: (tier_of[i], place[i], cost[i])))
        held, paid = [*rest, item], paid + price
        path.append(item)
    return {"path": path, "cost": paid, "held": held, "legal": ACTIONS[0] <= len(path) <= ACTIONS[2] and len(held) <= SLOTS}


PATH_METHODS = ("adoption_rate", "raw_outcome_rate", "eb_mean", "eb_lower")


def _paths(metrics: DataFrame, by: Sequence[str], graph: tuple) -> DataFrame:
    kinds = dict(metrics.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", method string, legal boolean, actions int, cost long, path array<bigint>, held array<bigint>"

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        out = []
        for method in PATH_METHODS:
            got = walk(rows, method, *graph)
            out.append((*[group[k].iloc[0] for k in by], method, got["legal"], len(got["path"]), got["cost"], got["path"], got["held"]))
        return pd.DataFrame(out, columns=[*by, "method", "legal", "actions", "cost", "path", "held"])

    return metrics.groupBy(*by).applyInPandas(build, schema)


def greedy_paths(t: Tables) -> DataFrame:
    return _paths(item_eb(t), ["hero_id"], catalogue(t)).withColumns({"path": F.array_join("path", ","), "held": F.array_join("held", ",")})


def core_path_stability(t: Tables) -> DataFrame:
    """Training against test paths: shared items, longest common subsequence and shared positions, as shares."""
    paths = _paths(item_eb(t, folds=True), ["fold", "hero_id"], catalogue(t))
    both = ranking.side_by_side(paths, ["hero_id", "method"], "fold", ("train", "test"), ["path"])

    @F.pandas_udf("long")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([models.longest_common_subsequence(list(x), list(y)) for x, y in zip(left, right, strict=True)])

    longest = F.greatest(F.size("path"), F.size("path_test"), F.lit(1))
    same = F.size(F.filter(F.arrays_zip(F.col("path").alias("x"), F.col("path_test").alias("y")), lambda s: s["x"] == s["y"]))
    return both.select("hero_id", "method", (F.size(F.array_intersect("path", "path_test")) / F.greatest(F.size(F.array_union("path", "path_test")), F.lit(1))).alias("set_jaccard"), (common("path", "path_test") / longest).alias("ordered_share"), (same / longest).alias("same_position_share"))


def build_paths(t: Tables, support: int = 20, gain: float = 0.10, confidence: float = 0.70, lift: float = 0.20, deepest: int = 3) -> DataFrame:
    """Purchase paths of each hero: players' items are split in two as long as a split generalises.

    A split is learned on training inventories (two means, then a logistic assignment), and stands if both sides have ``support`` members of confidence ``confidence`` in every
    fold, two items tell them apart by ``lift``, and validation distortion falls by ``gain``. Outcomes are never used.
    """
    rows = bounded(inventories(t), ["hero_id"]).select("hero_id", *APPEARANCE, "fold", F.array_sort(F.array_distinct("items")).alias("items"))

    def split(x: np.ndarray, fold: np.ndarray, member: np.ndarray, depth: int) -> list[np.ndarray]:
        parts = {f: member[fold[member] == f] for f in models.FOLDS}
        if depth == 0 or min(map(len, parts.values())) < 2 * support or len(np.unique(x[parts["train"]], axis=0)) < 2:
            return [member]
        labels, centres = models.two_means(x[parts["train"]])
        if len(np.unique(labels)) < 2 or (abs(centres[0] - centres[1]) >= lift).sum() < 2:
            return [member]
        p = models.logistic_predict(models.logistic_fit(x[parts["train"]], labels.astype(float), 1.0, penalise_intercept=True), x[member])
        sides = [member[(p if k else 1 - p) >= confidence] for k in (0, 1)]
        if any((fold[s] == f).sum() < support for s in sides for f in models.FOLDS):
            return [member]
        checked = x[parts["validation"]]
        alone = ((checked - x[parts["train"]].mean(axis=0)) ** 2).sum()
        paired = ((checked[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        if alone <= 0 or 1 - paired / alone < gain:
            return [member]
        return [leaf for s in sides for leaf in split(x, fold, s, depth - 1)]

    def discover(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(APPEARANCE)
        held = [set(i) for i in group["items"]]
        universe = sorted(i for i in set().union(*held) if sum(i in h for h in held) >= support)
        x = np.array([[i in h for i in universe] for h in held], float).reshape(len(held), -1)
        leaves = split(x, group["fold"].to_numpy(), np.arange(len(held)), deepest) if universe else [np.arange(len(held))]
        out = []
        for k, leaf in enumerate(leaves):
            above = x[leaf].mean(axis=0) - x.mean(axis=0) if universe else np.zeros(0)
            order = np.argsort(-above, kind="stable")[:3]
            signature = sorted(universe[i] for i in order if above[i] >= lift)
            out.append((group["hero_id"].iloc[0], k, len(leaf), ",".join(map(str, signature))))
        return pd.DataFrame(out, columns=["hero_id", "path", "members", "signature"])

    return rows.groupBy("hero_id").applyInPandas(discover, "hero_id int, path int, members long, signature string")


def tier_menus(t: Tables, core: DataFrame, longest: int = 10, support: int = 20) -> DataFrame:
    """What to offer besides the core, by tier: most adopted first, at most ``longest``, shown in order of net worth at purchase."""
    core = core.select("hero_id", F.explode(F.transform(F.split("items", ","), lambda x: x.cast("long"))).alias("item_id"))
    offered = a.item_aggregates(t, support=support).join(F.broadcast(core), ["hero_id", "item_id"], "left_anti")  # the core's few items
    chosen = ranking.top_k(offered, GROUP, [F.desc("adoption_rate"), F.desc("adopter_matches"), F.col("item_id")], longest)
    shown = Window.partitionBy(*GROUP).orderBy(F.asc_nulls_last("median_valid_buy_net_worth"), "median_buy_time_s", "item_id")
    return chosen.select(*a.ITEM, "adoption_rate", F.row_number().over(shown).cast("long").alias("position"))


def situational(t: Tables, support: int = 100, most: int = 7, overlap: float = 0.5, effective: float = 20.0, width: float = 0.10, stable: float = 0.3, agreeing: float = 0.6) -> DataFrame:
    """Items worth a branch against an enemy: gates on comparison, overlap and stability as columns, then at most ``most`` a hero, each item and enemy once."""
    shown = a.matchups(t, support, support).where("same_opportunity")
    wide = F.col("comparative_interval_high") - F.col("comparative_interval_low")
    steady = a.matchup_stability(t, 20).select("scope", "hero_id", "spearman", "sign_agreement")
    states = a.state_overlap(t).select(*a.ITEM, "effective_support", "state_coverage")
    gated = shown.join(F.broadcast(states), a.ITEM, "left").join(F.broadcast(steady), ["scope", "hero_id"], "left").select(  # rows by item, and by hero
        "scope", "hero_id", "enemy_hero_id", "phase", "item_id", "observations", "shrunk_item_residual_delta", "comparative_interval_low",
        F.array_compact(F.array(
            F.when(F.col("comparative_interval_low") <= 0, F.lit("interval")), F.when(wide > width, F.lit("width")), F.when(F.coalesce("state_coverage", F.lit(0.0)) < overlap, F.lit("overlap")),
            F.when(F.coalesce("effective_support", F.lit(0.0)) < effective, F.lit("effective_support")), F.when(F.coalesce("spearman", F.lit(-1.0)) < stable, F.lit("stability")), F.when(F.coalesce("sign_agreement", F.lit(0.0)) < agreeing, F.lit("sign")),
        )).alias("failed"),
    )
    # A hero's rows are combinations of items, enemies, phases and scopes, which catalogues bound.
    order = [F.size("failed"), F.desc("comparative_interval_low"), F.col("item_id"), F.col("enemy_hero_id"), F.col("phase"), F.col("scope")]
    best = gated.withColumn("rank", F.row_number().over(Window.partitionBy("hero_id").orderBy(*order)))

    def admit(group: pd.DataFrame) -> pd.DataFrame:
        items, enemies, out = set(), set(), []
        for r in group.sort_values("rank").to_dict("records"):
            ok = not len(r["failed"]) and r["item_id"] not in items and r["enemy_hero_id"] not in enemies and len(items) < most
            if ok:
                items.add(r["item_id"])
                enemies.add(r["enemy_hero_id"])
            out.append((r["hero_id"], r["scope"], r["enemy_hero_id"], r["phase"], r["item_id"], ok, ",".join(r["failed"])))
        return pd.DataFrame(out, columns=["hero_id", "scope", "enemy_hero_id", "phase", "item_id", "admitted", "failed_gates"])

    return best.groupBy("hero_id").applyInPandas(admit, "hero_id int, scope string, enemy_hero_id int, phase int, item_id long, admitted boolean, failed_gates string")


def top_cores(t: Tables, size: int = 8, support: int = 20, most: int = 64) -> DataFrame:
    """Schedulable item sets by support, up to ``most`` a hero after the legality check."""
    components, cost, active = catalogue(t)
    held = inventories(t).select("hero_id", F.array_distinct("items").alias("items"))
    counted = itemsets.frequent_itemsets(held, "hero_id", "items", size, support).where(F.col("size") == size).drop("size")

    @F.pandas_udf("boolean")
    def legal(sets: pd.Series) -> pd.Series:
        return pd.Series([schedule(list(map(int, s)), components, cost, active) is not None and sum(cost[i] for i in s) <= BUDGET for s in sets], dtype=bool)

    return ranking.top_k(counted.where(legal("itemset")), ["hero_id"], [F.desc("support"), F.col("itemset")], most).select("hero_id", F.array_join("itemset", ",").alias("items"), "support", F.col("rank").cast("long").alias("rank"))


def agreement_orders(precedence: Sequence[tuple[int, int, int, int]], items: Sequence[int], keep: int = 2, windows: dict[int, tuple[float, float]] | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """The ``keep`` orders of ``items`` that agree with most observed precedences: (score, order), ties to the lexicographically smaller.

    Dynamic programming over subsets that keeps the best few prefixes of each, instead of all permutations. ``windows``: the release and due point of an item; an order is feasible if points that never
    fall can be chosen in all windows. The point that a prefix has come to is its latest release, whatever its order, so whether an item may follow depends on the subset alone.
    """
    ahead: dict[tuple[int, int], int] = {}
    for x, y, first, second in precedence:
        ahead[x, y], ahead[y, x] = first, second
    always = (-math.inf, math.inf)
    release, due = ({i: (windows or {}).get(i, always)[k] for i in items} for k in (0, 1))
    best: dict[frozenset[int], list[tuple[int, tuple[int, ...]]]] = {frozenset(): [(0, ())]}
    for n in range(1, len(items) + 1):
        for chosen in combinations(sorted(items), n):
            whole, reached = frozenset(chosen), max(release[i] for i in chosen)
            grown = [(score - sum(ahead.get((p, last), 0) for p in order), (*order, last)) for last in chosen if reached <= due[last] for score, order in best[whole - {last}]]
            best[whole] = sorted(grown)[:keep]
    return [(-score, order) for score, order in best[frozenset(items)]]


def core_orders(t: Tables, core: DataFrame, additions: DataFrame) -> DataFrame:
    """The order in which each hero's core is best bought, and the runner-up: agreement with what its holders did first, within the quartiles of net worth at purchase of each item.

    ``checkpoints``: the smallest net worth at which each item of the order can be bought. ``near_variant``: the runner-up has 90 % of the agreement and differs early, within the first six
    places. A core without a feasible order has a null order. Precedences are counted by Spark; a core's nine items or fewer are ordered in one task.
    """

    def ids(column: str) -> F.Column:
        return F.transform(F.split(column, ","), lambda x: x.cast("long"))

    first = additions.where("rank = 1").select("hero_id", ids("additions").alias("more"))
    whole = core.join(F.broadcast(first), "hero_id", "left").select("hero_id", F.concat(ids("items"), F.coalesce("more", F.expr("CAST(array() AS array<bigint>)"))).alias("core"))  # a row a hero
    players = inventories(t).join(F.broadcast(whole), "hero_id").where(F.size(F.array_except("core", "items")) == 0).select(*APPEARANCE, "core")
    bought = t.first_purchases.select("hero_id", *APPEARANCE, "item_id", "buy_time").join(players, APPEARANCE).where(F.array_contains("core", F.col("item_id")))
    pairs = itemsets.pair_precedence(bought, ["hero_id"], APPEARANCE, "item_id", "buy_time")
    observed = pairs.groupBy("hero_id").agg(F.collect_list(F.struct("first_item", "second_item", "first_earlier", "second_earlier")).alias("pairs"))
    known = a.item_aggregates(t).select("hero_id", F.struct("item_id", F.col("buy_nw_q25").cast("double").alias("low"), F.col("buy_nw_q75").cast("double").alias("high")).alias("window"))
    windows = known.groupBy("hero_id").agg(F.collect_list("window").alias("windows"))
    heroes = whole.join(observed, "hero_id", "left").join(windows, "hero_id", "left")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        items = [int(i) for i in r["core"]]
        bounds = {int(w["item_id"]): (w["low"], w["high"]) for w in (r["windows"] if r["windows"] is not None else ()) if w["low"] is not None}
        pairs = [(p["first_item"], p["second_item"], p["first_earlier"], p["second_earlier"]) for p in (r["pairs"] if r["pairs"] is not None else ())]
        found = agreement_orders(pairs, items, 2, bounds)
        if not found:
            return pd.DataFrame([(r["hero_id"], None, None, None, None, None, False)], columns=CORE_ORDER)
        (score, order), (second_score, second) = found[0], found[-1]
        same = next((k for k, (x, y) in enumerate(zip(order, second, strict=True)) if x != y), len(order))
        points = np.maximum.accumulate([max(0.0, bounds.get(i, (0.0, 0.0))[0]) for i in order])
        row = (r["hero_id"], ",".join(map(str, order)), score, ",".join(map(str, second)), second_score, ",".join(f"{x:g}" for x in points), score > 0 and second_score >= 0.9 * score and same <= 5)
        return pd.DataFrame([row], columns=CORE_ORDER)

    return heroes.groupBy("hero_id").applyInPandas(choose, "hero_id int, target_order string, agreement_support long, runner_up_order string, runner_up_support long, checkpoints string, near_variant boolean")


CORE_ORDER = ["hero_id", "target_order", "agreement_support", "runner_up_order", "runner_up_support", "checkpoints", "near_variant"]


def supported_openings(t: Tables, length: int = 3) -> DataFrame:
    """Each hero's most supported opening of ``length`` different items, step by step from what players had reached.

    Only the first ``length`` purchases are counted, so the states of a hero are combinations of catalogue items.
    """
    first = t.first_purchases.groupBy("hero_id", *APPEARANCE).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("buy_time", "item_id"))), lambda x: x["item_id"]), 1, length).alias("path"))
    counts = state_counts(first.groupBy("hero_id", "path").agg(F.count("*").alias("w")), ["hero_id"], "path", "w")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        found = supported_path({(tuple(r.state), r.next): r.n for r in group.itertuples()}, lambda state: len(state) == length) or []
        rows = [(group["hero_id"].iloc[0], k + 1, step, n) for k, (step, n) in enumerate(found)]
        return pd.DataFrame(rows, columns=["hero_id", "position", "item_id", "support"])

    return counts.groupBy("hero_id").applyInPandas(choose, "hero_id int, position int, item_id long, support long")
