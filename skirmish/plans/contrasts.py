"""Doubly robust contrasts of two items over all rows, and alternatives to a core's items.

For every pair of items, chronological fold and share of the matches that is left out, a propensity and two outcome models are fitted (:mod:`skirmish.functions.newton`): all of
them in the same few passes over the decisions, as sums by group. Predictions, weights, balance and the clusters of matches are aggregations too, so
no hero's rows meet in one task and none are left out. Pairs are few: two items a hero and tier, or two for each item of a core.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import models, newton
from skirmish.operators import ranking
from skirmish.operators.replay import schedule
from skirmish.plans import analytics as a
from skirmish.plans.cohort import Tables

PARTS = 5
PAIR = ["pair_id"]
RESULT = ["support", "comparison_support", "effective_support", "overlap", "maximum_weight", "maximum_smd", "estimate", "low", "high", "fold_range", *(f"clip_{c:g}" for c in models.CLIPS), "admitted", "failed_gates"]


def part_of(match: Column, parts: int = PARTS) -> Column:
    """The share of the matches that a match belongs to, for cross-fitting."""
    return F.pmod(F.xxhash64(match), F.lit(parts)).cast("int")


def contrasts(decisions: DataFrame, pairs: DataFrame, features: list[str], parts: int = PARTS) -> DataFrame:
    """(pair_id, ...): the contrast of each pair's ``treatment_item_id`` with its ``comparator_item_id`` among the decisions of its ``hero_id``, and its gates.

    ``decisions``: hero_id, match_id, fold, item_id, y and ``features``. ``pairs`` (pair_id, hero_id and both items) is bounded by the catalogue. A pair that can't be estimated (under two
    rows of either item; in a fold, under four rows, one item only, or one match) fails the gate ``estimability`` and has no numbers.
    """
    sides = pairs.select("pair_id", "hero_id", F.inline(F.array(*[F.struct(F.col(c).alias("item_id"), F.lit(v).alias("treated")) for c, v in (("treatment_item_id", 1), ("comparator_item_id", 0))])))
    rows = decisions.join(F.broadcast(sides), ["hero_id", "item_id"]).select("pair_id", "match_id", "fold", "treated", "y", *features, part_of(F.col("match_id"), parts).alias("part")).persist()
    try:
        return _contrasts(rows, pairs, features, parts)
    finally:
        rows.unpersist()


def _contrasts(rows: DataFrame, pairs: DataFrame, features: list[str], parts: int) -> DataFrame:
    spark = rows.sparkSession
    by_fold = rows.groupBy("pair_id", "fold").agg(F.count("*").alias("n"), F.sum("treated").alias("t"), (F.min("match_id") != F.max("match_id")).alias("matches"))
    good = F.count_if((F.col("n") >= 4) & F.col("t").between(1, F.col("n") - 1) & F.col("matches")) == len(models.FOLDS)
    counted = by_fold.where(F.col("fold").isin(*models.FOLDS)).groupBy("pair_id").agg(good.alias("good"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    usable = [r["pair_id"] for r in counted.where("good AND t >= 2 AND n - t >= 2").select("pair_id").collect()]  # of a catalogue's pairs
    used = rows.where(F.col("fold").isin(*models.FOLDS)).join(F.broadcast(spark.createDataFrame([(x,) for x in usable], pairs.select("pair_id").schema)), "pair_id")
    # A row trains the models of all parts but its own: one of the choice, and one of the outcome of what was chosen.
    others = F.array(*map(F.lit, range(parts)))
    kinds = F.array(F.struct(F.lit("choice").alias("kind"), F.col("treated").alias("target")), F.struct(F.when(F.col("treated") == 1, "treated").otherwise("control").alias("kind"), F.col("y").cast("int").alias("target")))
    training = used.select("*", F.explode(F.filter(others, lambda k: k != F.col("part"))).alias("left_out")).select("pair_id", "fold", "left_out", *features, "y", F.inline(kinds))
    key = ["pair_id", "fold", "left_out", "kind"]
    fitted = newton.fit(training, key, features, "target")
    rates = training.where("kind = 'choice'").groupBy(*key[:-1]).agg(F.avg("y").alias("rate")).collect()
    for r in rates:  # without a row of an action to learn from, its outcome is the rate of all
        for kind in ("treated", "control"):
            fitted.setdefault((r["pair_id"], r["fold"], r["left_out"], kind), newton.Fitted(*[[0.0] * len(features), [0.0] * len(features), [1.0] * len(features), [0.0] * (len(features) + 1)], constant=float(r["rate"])))
    table = newton.model_table(training, fitted, key, len(features))

    predicted = used.withColumnRenamed("part", "left_out")
    for kind, name in (("choice", "p"), ("treated", "if_treated"), ("control", "if_control")):
        own = table.where(F.col("kind") == kind).drop("kind")
        predicted = predicted.join(F.broadcast(own), key[:-1]).withColumn(name, newton.probability(features)).drop(*[c for c in table.columns if c not in key])
    predicted = predicted.withColumn("p", F.greatest(F.lit(models.FLOOR), F.least(F.lit(1 - models.FLOOR), F.col("p")))).withColumn("t", F.col("treated").cast("double"))
    t, y, p, m1, m0 = (F.col(c) for c in ("t", "y", "p", "if_treated", "if_control"))

    def score(limit: float) -> Column:
        return m1 - m0 + t * F.least(1 / p, F.lit(limit)) * (y - m1) - (1 - t) * F.least(1 / (1 - p), F.lit(limit)) * (y - m0)

    scored = predicted.withColumns({"influence": score(math.inf), "weight": 1 / F.when(t == 1, p).otherwise(1 - p)})
    moments = {}
    for i, f in enumerate(features):
        x = F.nanvl(F.col(f), F.lit(None))
        for side in (0, 1):
            w = F.when((t == side) & x.isNotNull(), F.col("weight"))
            moments |= {f"w{i}_{side}": F.sum(w), f"x{i}_{side}": F.sum(w * x), f"q{i}_{side}": F.sum(w * x * x)}
    sums = scored.groupBy("pair_id").agg(
        F.sum("t").alias("support"), F.count("*").alias("n"), F.sum("weight").alias("weights"), F.sum(F.col("weight") ** 2).alias("squares"), F.avg(p.between(0.1, 0.9).cast("int")).alias("overlap"), F.max("weight").alias("maximum_weight"), F.avg("influence").alias("estimate"),
        *[F.avg(score(c)).alias(f"clip_{c:g}") for c in models.CLIPS], *[F.avg(F.when(F.col("fold") == f, F.col("influence"))).alias(f) for f in models.FOLDS], *[x.alias(n) for n, x in moments.items()],
    )
    clusters = scored.groupBy("pair_id", "match_id").agg(F.avg("influence").alias("mean")).groupBy("pair_id").agg(F.count("*").alias("clusters"), F.stddev_samp("mean").alias("deviation"))
    found = {r["pair_id"]: _gated(r.asDict(), len(features)) for r in sums.join(clusters, "pair_id").collect()}  # one row a pair
    kinds = {"support": "long", "comparison_support": "long", "admitted": "boolean", "failed_gates": "string"}
    schema = f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in RESULT)
    none = dict.fromkeys(RESULT) | {"admitted": False, "failed_gates": "estimability"}
    out = [(r["pair_id"], *[found.get(r["pair_id"], none)[c] for c in RESULT]) for r in pairs.select("pair_id").collect()]
    return spark.createDataFrame(out, schema)


def _gated(r: dict, d: int) -> dict:
    """A pair's sums as a result with its gates."""
    worst = 0.0
    for i in range(d):
        if r[f"w{i}_0"] and r[f"w{i}_1"]:
            mean = [r[f"x{i}_{s}"] / r[f"w{i}_{s}"] for s in (0, 1)]
            spread = math.sqrt(sum(max(0.0, r[f"q{i}_{s}"] / r[f"w{i}_{s}"] - mean[s] ** 2) for s in (0, 1)) / 2)
            if spread > 1e-9 * max(1.0, *map(abs, mean)):
                worst = max(worst, abs(mean[1] - mean[0]) / spread)
    half = 1.96 * r["deviation"] / math.sqrt(r["clusters"]) if r["clusters"] > 1 else 0.0
    by_fold = [r[f] for f in models.FOLDS]
    out = {
        "support": int(r["support"]), "comparison_support": int(r["n"] - r["support"]), "effective_support": r["weights"] ** 2 / r["squares"], "overlap": r["overlap"], "maximum_weight": r["maximum_weight"], "maximum_smd": worst,
        "estimate": r["estimate"], "low": r["estimate"] - half, "high": r["estimate"] + half, "fold_range": max(by_fold) - min(by_fold), **{f"clip_{c:g}": r[f"clip_{c:g}"] for c in models.CLIPS},
    }
    failed = models.failed_gates(out)
    return out | {"admitted": not failed, "failed_gates": ",".join(failed)}


def _pair_ids(pairs: DataFrame) -> DataFrame:
    """The pairs, which a catalogue bounds, with their ids, and without the plan that found them, which every pass would carry."""
    named = pairs.withColumn("pair_id", F.concat_ws(":", "hero_id", "treatment_item_id", "comparator_item_id"))
    return pairs.sparkSession.createDataFrame(named.collect(), named.schema)


def dr_contrasts(t: Tables, decisions: DataFrame, features: list[str]) -> DataFrame:
    """Contrast of each hero's most chosen item of a tier with the second, over all decisions."""
    counts = decisions.groupBy(*a.ITEM).agg(F.count("*").alias("n"))
    ranked = ranking.top_k(counts, ["hero_id", "tier"], [F.desc("n"), F.col("item_id")], 2)
    first, second = (F.max(F.when(F.col("rank") == k, F.col("item_id"))) for k in (1, 2))
    pairs = _pair_ids(ranked.groupBy("hero_id", "tier").agg(first.alias("treatment_item_id"), second.alias("comparator_item_id")).where("comparator_item_id IS NOT NULL"))
    found = contrasts(decisions, pairs, features)
    return pairs.join(F.broadcast(found), "pair_id").select("hero_id", "tier", "treatment_item_id", "comparator_item_id", *RESULT)


def core_alternatives(t: Tables, core: DataFrame, decisions: DataFrame, features: list[str], graph: tuple, support: int = 20, each: int = 2, most: int = 10) -> DataFrame:
    """What could stand in for an item of a hero's core: for each item, the ``each`` most adopted legal items of its tier outside the core, contrasted with it.

    ``core``: (hero_id, items array, fixed array), in order of purchase; fixed items aren't replaced. ``graph``: components, cost and active items. Of an item that is admitted at several
    places the one with most effective support counts (then the narrower interval, then the earlier place); at most ``most`` a hero are ``chosen``.
    """
    components, cost, active = graph
    metrics = a.item_aggregates(t).select(*a.ITEM, "adopter_matches").where(F.col("adopter_matches") >= support)
    placed = core.select("hero_id", "items", "fixed", F.posexplode("items").alias("at", "comparator_item_id")).where(~F.array_contains("fixed", F.col("comparator_item_id")))
    tiers = t.item_assets.select(F.col("item_id").alias("comparator_item_id"), F.col("tier").alias("comparator_tier"))
    offered = placed.join(F.broadcast(tiers), "comparator_item_id").join(metrics, "hero_id").where("tier = comparator_tier AND NOT array_contains(items, item_id)")

    @F.pandas_udf("boolean")
    def legal(items: pd.Series, at: pd.Series, item: pd.Series) -> pd.Series:
        sets = ([*map(int, x[:k]), int(i), *map(int, x[k + 1 :])] for x, k, i in zip(items, at, item, strict=True))
        return pd.Series([schedule(x, components, cost, active) is not None for x in sets], dtype=bool)

    candidates = ranking.top_k(offered.where(legal("items", "at", "item_id")), ["hero_id", "at"], [F.desc("adopter_matches"), F.col("item_id")], each)
    pairs = _pair_ids(candidates.select("hero_id", "tier", F.col("item_id").alias("treatment_item_id"), "comparator_item_id", (F.col("at") + 1).alias("stage")))
    found = pairs.join(F.broadcast(contrasts(decisions, pairs, features)), "pair_id")
    best = Window.partitionBy("hero_id", "treatment_item_id", "admitted").orderBy(F.desc("effective_support"), F.col("high") - F.col("low"), "stage")
    first = found.withColumn("first", F.col("admitted") & (F.row_number().over(best) == 1))
    place = F.row_number().over(Window.partitionBy("hero_id", "first").orderBy("stage", "treatment_item_id"))
    return first.withColumn("chosen", F.col("first") & (place <= most)).select("hero_id", "stage", "treatment_item_id", "comparator_item_id", *RESULT, "chosen")
