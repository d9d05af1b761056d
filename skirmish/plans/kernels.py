"""Estimators: incidence, landmarks, prefixes, timing windows, calibration, off-policy values, monitoring. All are DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import stats
from skirmish.operators import ranking
from skirmish.operators.asof import asof_join

# -- incidence and landmarks -----------------------------------------------------------------------------------------------


def cumulative_incidence(observations: DataFrame, by: Sequence[str], time: str, is_event: Column) -> DataFrame:
    """Cause-specific hazards and cumulative incidence with competing events; each appearance contributes one terminal event.

    Counts by time come first, so the window runs over distinct times and not over appearances. Survival before a time is the
    product of the earlier (1 - d / n), as a sum of logarithms; only the last time can end everyone, and no frame includes it.
    """
    counted = observations.groupBy(*by, F.col(time).alias("time_s")).agg(F.count("*").alias("ended"), F.count_if(is_event).alias("purchases"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("time_s").rowsBetween(Window.unboundedPreceding, -1)
    upto = whole.orderBy("time_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = F.sum("ended").over(whole) - F.coalesce(F.sum("ended").over(earlier), F.lit(0))
    base = counted.withColumn("at_risk", at_risk).withColumn("hazard", F.col("purchases") / F.col("at_risk"))
    survival = F.exp(F.coalesce(F.sum(F.ln(F.nullif(1 - F.col("ended") / F.col("at_risk"), F.lit(0.0)))).over(earlier), F.lit(0.0)))
    staged = base.withColumn("step", survival * F.col("hazard"))
    return staged.select(*by, "time_s", "at_risk", "purchases", (F.col("ended") - F.col("purchases")).alias("competing_events"), F.col("hazard").alias("cause_specific_hazard"), F.sum("step").over(upto).alias("cumulative_incidence"))


def landmark_estimates(appearances: DataFrame, by: Sequence[str], duration: str, won: Column, landmarks: Sequence[int]) -> DataFrame:
    """Outcome rates among matches still running at each landmark: each row goes to the landmarks that it reaches."""
    reached = F.filter(F.array(*map(F.lit, sorted(set(landmarks)))), lambda s: s <= F.col(duration))
    rows = appearances.select(*by, won.alias("y"), F.explode(reached).alias("landmark_s"))
    out = rows.groupBy(*by, "landmark_s").agg(F.count("*").alias("at_risk"), F.sum("y").alias("wins"), F.avg("y").alias("estimate"))
    low, high = stats.wilson(F.col("wins"), F.col("at_risk"))
    return out.withColumns({"interval_low": low, "interval_high": high})


# -- prefixes ----------------------------------------------------------------------------------------------------------------


def prefix_decisions(paths: DataFrame, by: Sequence[str], path: str, weight: str, longest: int = 16) -> DataFrame:
    """Reached counts and shares of the next step after every prefix of the paths (an array column), as one row a prefix and step."""
    places = F.sequence(F.lit(0), F.least(F.size(path), F.lit(longest)) - 1)
    steps = paths.where(F.size(path) > 0).select(*by, weight, path, F.explode(places).alias("at"))
    steps = steps.select(*by, weight, F.slice(path, F.lit(1), F.col("at")).alias("prefix"), F.get(path, F.col("at")).alias("next"))
    counts = steps.groupBy(*by, "prefix", "next").agg(F.sum(weight).alias("n"))
    reached = F.sum("n").over(Window.partitionBy(*by, "prefix"))
    return counts.select(*by, (F.size("prefix") + 1).cast("int").alias("position"), F.array_join("prefix", ",").alias("prefix"), F.col("next").cast("long").alias("next"), "n", reached.alias("reached")).withColumn("probability", F.col("n") / F.col("reached"))


# -- durations ---------------------------------------------------------------------------------------------------------------

#: Upper bounds of the ending-duration buckets, in seconds; the last bucket is open.
DURATION_BOUNDS = (1500, 1800, 2100, 2400, 2700, 3000)


def duration_bucket(seconds: Column) -> Column:
    value = F.lit(0)
    for k, bound in enumerate(DURATION_BOUNDS, 1):
        value = F.when(seconds >= bound, k).otherwise(value)
    return value


def duration_profile(buckets: DataFrame, by: Sequence[str], bucket: str = "bucket", least: int = 50) -> DataFrame:
    """Shape of outcome rates over early, middle and late endings.

    ``buckets`` has ``wins`` and ``matches`` by bucket (0 to 6). Groups that lack a bucket, or have under ``least`` matches in a phase, are left out.
    """
    b = F.col(bucket)
    phase = F.when(b < 2, "early").when(b < 5, "mid").otherwise("late")
    sums = [F.sum(F.when(phase == p, F.col(c))).alias(f"{p}_{c}") for p in ("early", "mid", "late") for c in ("wins", "matches")]
    wide = buckets.groupBy(*by).agg(F.count_distinct(bucket).alias("buckets"), *sums)
    wide = wide.where(f"buckets = 7 AND least(early_matches, mid_matches, late_matches) >= {least}")
    e, m, l = (F.col(f"{p}_wins") / F.col(f"{p}_matches") for p in ("early", "mid", "late"))  # noqa: E741
    shape = (
        F.when(F.greatest(e, m, l) - F.least(e, m, l) < 0.015, "STABLE")
        .when((m >= e + 0.01) & (m >= l + 0.01), "MIDGAME_PEAK")
        .when(l >= e + 0.02, "LATE_SCALING")
        .when(e >= l + 0.02, "EARLY_CLOSER")
        .otherwise("MIXED")
    )
    return wide.select(*by, *[f"{p}_matches" for p in ("early", "mid", "late")], shape.alias("shape"), F.round(100 * (l - e), 2).alias("early_to_late_delta"))


# -- purchase windows --------------------------------------------------------------------------------------------------------

#: Bucket widths, shares and floors of the purchase windows.
INCREMENTS = (1000, 2000, 3000, 5000, 7000, 10000)
LOW_VOLUME, SHARE, LOW_SHARE, WINDOW_MATCHES, WINDOW_SHARE = 200, 0.10, 0.15, 20, 0.05


def purchase_windows(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The central range of purchases by net worth, irrespective of outcomes.

    ``rows``: ``bucket`` (net worth, by the thousand), ``matches`` and ``wins``. The width is the first whose mean bucket holds the wanted share of
    matches, else the widest; all widths are grouped at once and one is kept. Within it, buckets below the floor go, and the window runs from where a quarter of the
    matches is reached to where three quarters are.
    """
    wide = rows.where("bucket IS NOT NULL AND matches > 0").withColumn("increment", F.explode(F.array(*map(F.lit, INCREMENTS))))
    grouped = wide.groupBy(*by, "increment", (F.floor(F.col("bucket") / F.col("increment")) * F.col("increment")).cast("long").alias("start")).agg(F.sum("matches").alias("matches"), F.sum("wins").alias("wins"))
    totals = grouped.groupBy(*by, "increment").agg(F.sum("matches").alias("total"), F.count("*").alias("buckets"))
    share = F.when(F.col("total") > LOW_VOLUME, SHARE).otherwise(LOW_SHARE)
    fits = 1 / F.col("buckets") >= share
    chosen = totals.groupBy(*by).agg(F.coalesce(F.min(F.when(fits, F.col("increment"))), F.lit(INCREMENTS[-1])).alias("increment"), F.first("total").alias("total"))
    floor = F.greatest(F.lit(WINDOW_MATCHES), F.ceil(F.col("total") * WINDOW_SHARE))
    kept = grouped.join(chosen, [*by, "increment"]).where(F.col("matches") >= floor)
    w = Window.partitionBy(*by)
    running = F.sum("matches").over(w.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = kept.withColumns({"running": running, "eligible": F.sum("matches").over(w)})
    before = F.col("running") - F.col("matches")
    inside = (F.col("running") >= 0.25 * F.col("eligible")) & (before < 0.75 * F.col("eligible"))
    out = placed.where(inside).groupBy(*by, "increment").agg(F.min("start").alias("bucket_start"), (F.max("start") + F.col("increment")).alias("bucket_end"), F.sum("matches").alias("matches"), F.sum("wins").alias("wins"))
    low, _ = stats.wilson(F.col("wins"), F.col("matches"))
    return out.withColumns({"observed_outcome_rate": F.col("wins") / F.col("matches"), "wilson_lower": low})


def weighted_median(rows: DataFrame, by: Sequence[str], value: str, weight: str, name: str = "median") -> DataFrame:
    """The smallest value at which half of the weight is reached."""
    counted = rows.groupBy(*by, value).agg(F.sum(weight).alias("w")).where("w > 0")
    w = Window.partitionBy(*by)
    placed = counted.withColumns({"r": F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "t": F.sum("w").over(w)})
    return placed.where("r >= t / 2").groupBy(*by).agg(F.min(value).alias(name))


# -- predictions -------------------------------------------------------------------------------------------------------------


def calibration_slices(predictions: DataFrame, labels: Mapping[str, Column], threshold: float, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Brier score, log loss, expected calibration error, coverage and selective risk overall and by each label.

    Each prediction is fanned out to its slices, summed by slice and bin, and the slices sum their bins: two small aggregations, whatever the slices' size.
    """
    names = F.array(F.lit("overall"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in labels.items()])
    q, o = F.col(p), F.col(y)
    confident = F.greatest(q, 1 - q) >= threshold
    wrong = confident & ((q >= 0.5) != (o == 1))
    loss = -(o * F.ln(F.greatest(q, F.lit(1e-15))) + (1 - o) * F.ln(F.greatest(1 - q, F.lit(1e-15))))
    rows = predictions.select(F.explode(names).alias("slice"), F.least(F.floor(q * bins), F.lit(bins - 1)).alias("bin"), q.alias("q"), o.alias("o"), F.pow(q - o, F.lit(2)).alias("se"), loss.alias("loss"), confident.alias("confident"), wrong.alias("wrong"))
    binned = rows.groupBy("slice", "bin").agg(
        F.count("*").alias("n"), F.sum("q").alias("sq"), F.sum("o").alias("so"), F.sum("se").alias("se"), F.sum("loss").alias("loss"), F.count_if("confident").alias("confident"), F.count_if("wrong").alias("wrong")
    )
    n = F.sum("n")
    return binned.groupBy("slice").agg(
        n.alias("support"), (F.sum("se") / n).alias("brier"), (F.sum("loss") / n).alias("log_loss"), (F.sum(F.abs(F.col("sq") - F.col("so"))) / n).alias("expected_calibration_error"),
        (F.sum("confident") / n).alias("coverage"), (F.sum("wrong") / F.nullif(F.sum("confident"), F.lit(0))).alias("selective_risk"),
    )


def abstention_threshold(validation: DataFrame, maximum_risk: float, candidates: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9), p: str = "p", y: str = "y") -> DataFrame:
    """The safe threshold with the most coverage, and of equal ones the lowest; no row if none is safe."""
    q = F.col(p)
    confidence = F.greatest(q, 1 - q)
    rows = validation.select(F.explode(F.filter(F.array(*map(F.lit, candidates)), lambda c: confidence >= c)).alias("threshold"), ((q >= 0.5) != (F.col(y) == 1)).cast("int").alias("wrong"))
    total = validation.agg(F.count("*").alias("total"))
    swept = rows.groupBy("threshold").agg(F.count("*").alias("n"), F.avg("wrong").alias("risk")).crossJoin(F.broadcast(total))  # one row
    safe = swept.where(F.col("risk") <= maximum_risk)
    return safe.orderBy(F.desc("n"), "threshold").limit(1).select("threshold", (F.col("n") / F.col("total")).alias("coverage"), F.col("risk").alias("selective_risk"))


def off_policy(decisions: DataFrame, by: Sequence[str], clips: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """IPS, self-normalised IPS and doubly robust values of a target policy, with clipped variants.

    ``decisions``: ``action``, ``propensity`` (of the logging policy), ``outcome``, and maps ``target`` and ``predicted`` over actions. A group whose target
    gives mass to actions that were never logged has ``supported`` false and null estimates.
    """
    acts = F.map_keys(F.map_filter("target", lambda _, p: p > 0))
    weight = F.element_at("target", F.col("action")) / F.col("propensity")
    model = F.aggregate(F.map_entries("target"), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at("predicted", e["key"]))
    rows = decisions.select(*by, "action", "outcome", weight.alias("w"), model.alias("m"), F.element_at("predicted", F.col("action")).alias("own"), acts.alias("acts"))
    logged = F.collect_set("action")
    aimed = F.array_distinct(F.flatten(F.collect_set("acts")))

    def estimates(w: Column, suffix: str) -> list[Column]:
        return [
            F.avg(w * F.col("outcome")).alias(f"ips{suffix}"),
            F.coalesce(F.sum(w * F.col("outcome")) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias(f"snips{suffix}"),
            F.avg(F.col("m") + w * (F.col("outcome") - F.col("own"))).alias(f"dr{suffix}"),
        ]

    clipped = [c for k in clips for c in estimates(F.least(F.col("w"), F.lit(k)), f"_clip_{k:g}")]
    out = rows.groupBy(*by).agg(F.count("*").alias("support"), logged.alias("logged"), aimed.alias("aimed"), *estimates(F.col("w"), ""), *clipped, stats.effective_support(F.col("w")).alias("effective_sample_size"), F.max("w").alias("maximum_weight"))
    inside = F.size(F.array_except("aimed", "logged")) == 0
    values = [c for c in out.columns if c.startswith(("ips", "snips", "dr", "effective", "maximum"))]
    return out.select(*by, "support", inside.alias("supported"), (F.size(F.array_intersect("aimed", "logged")) / F.size("aimed")).alias("overlap"), *[F.when(inside, F.col(c)).alias(c) for c in values])


def group_leakage(rows: DataFrame, fold: str, groups: Sequence[str]) -> DataFrame:
    """For each kind of group, how many of its members occur in more than one fold."""
    long = rows.select(F.col(fold).alias("fold"), F.explode(F.array(*[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("member")) for g in groups])).alias("g"))
    members = long.groupBy("g.kind", "g.member").agg(F.count_distinct("fold").alias("folds"))
    return members.groupBy("kind").agg(F.count("*").alias("members"), F.count_if(F.col("folds") > 1).alias("leaking"))


def select_then_estimate(effects: DataFrame, by: Sequence[str], key: str, selection: str, estimation: str, support: int) -> DataFrame:
    """Choose a key on one fold (largest estimate, then support, then the smallest key) and report another fold's estimate of it, if supported there too."""
    known = effects.where(F.col("observations") >= support)
    best = ranking.top_k(known.where(F.col("fold") == selection), by, [F.desc("estimate"), F.desc("observations"), F.col(key)], 1).select(*by, key)
    return known.where(F.col("fold") == estimation).join(best, [*by, key]).select(*by, key, "observations", "estimate")


# -- monitoring --------------------------------------------------------------------------------------------------------------

#: The limits of the monitoring rules.
LIMITS = {"age_s": 86400, "invalid": 0.01, "calibration": 0.1, "concentration": 0.8, "unhandled": 0.01}


def monitoring_decision(snapshots: DataFrame, keep: Sequence[str], has_fallback: Column | None = None) -> DataFrame:
    """``action`` (rollback, refuse, alert or healthy) and its ``reasons`` for each snapshot: the strongest rule set with any reason decides."""
    c = F.col
    rules = {
        "rollback": [
            (~c("mechanics_match"), "mechanics fingerprint mismatch"),
            (c("calibration_error") > LIMITS["calibration"], "material calibration failure"),
            (~c("schema_decode_ok"), "schema decode failure"),
            (~c("preservation_unchanged"), "user-data preservation changed"),
            (c("restore_failures") > 0, "restore failure"),
        ],
        "refuse": [
            (c("snapshot_age_s") > LIMITS["age_s"], "snapshot freshness exceeded"),
            ((c("path_rejections") > 0) | (c("render_rejections") > 0), "path or render rejection observed"),
            (c("install_failures") > 0, "install failure observed"),
        ],
        "alert": [
            (c("invalid_state_rate") > LIMITS["invalid"], "invalid-state rate exceeded"),
            (F.coalesce(c("unhandled_branches") / F.nullif(c("exposures"), F.lit(0)), F.lit(0.0)) > LIMITS["unhandled"], "unhandled-branch rate exceeded"),
            (c("recommendation_concentration") > LIMITS["concentration"], "recommendation concentration exceeded"),
        ],
    }
    found = {name: F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in tests])) for name, tests in rules.items()}
    rolled = F.when(F.coalesce(has_fallback, F.lit(False)), found["rollback"]) if has_fallback is not None else F.lit(None)
    found["rollback"] = F.when(F.size(found["rollback"]) > 0, F.coalesce(rolled, F.concat(found["rollback"], F.array(F.lit("no last compatible policy is available"))))).otherwise(found["rollback"])
    action, reasons = F.lit("healthy"), F.array().cast("array<string>")
    for name in ("alert", "refuse", "rollback"):
        hit = F.size(found[name]) > 0
        action, reasons = F.when(hit, name).otherwise(action), F.when(hit, found[name]).otherwise(reasons)
    return snapshots.select(*keep, action.alias("action"), F.array_join(reasons, "; ").alias("reasons"))


# -- telemetry ---------------------------------------------------------------------------------------------------------------


def validated_net_worth(purchases: DataFrame, time: str = "buy_time", reported: str = "net_worth", final: str = "final_net_worth", earlier: str = "preceding_net_worth", earlier_time: str = "preceding_time_s") -> DataFrame:
    """Adds ``valid_net_worth`` and ``net_worth_status``: from 180 s on the reported value counts; before, one that equals the final value is corrupt, and
    otherwise a preceding value of at most 60 s of age counts."""
    c = {k: F.col(v) for k, v in (("t", time), ("r", reported), ("f", final), ("e", earlier), ("et", earlier_time))}
    late, corrupt = c["t"] >= 180, c["r"].isNotNull() & c["f"].isNotNull() & (c["r"] == c["f"])
    recent = c["e"].isNotNull() & c["et"].between(0, c["t"]) & (c["t"] - c["et"] <= 60)
    value = F.when(late, c["r"]).when(~corrupt & recent, c["e"])
    status = F.when(late, "reported").when(corrupt, "corrupt").when(recent, "preceding").otherwise("unknown")
    return purchases.withColumns({"valid_net_worth": value, "net_worth_status": status})


#: What may exclude an appearance from outcome evidence (a flag and the value that excludes), and sources that a decision can't know.
EXCLUSIONS = {"scored": False, "penalized": True, "party_penalized": True, "abandoned": True, "rewarded": False, "low_priority": True, "new_player": True}
LATE_SOURCES = ("final_net_worth", "final_duration", "future_item", "eventual_buyer", "normalized_duration")


def outcome_eligible(policy: Sequence[str] = tuple(EXCLUSIONS)) -> Column:
    """Whether no exclusion of the policy applies to a row's flags; it never looks at the outcome. A null flag excludes nothing."""
    out = F.lit(True)
    for flag in policy:
        out = out & ~F.coalesce(F.col(flag) == EXCLUSIONS[flag], F.lit(False))
    return out


def leakage(source: Column, available_at: Column, stale_after: Column, decided_at: Column) -> Column:
    """Why a feature may not be used at a decision (the first rule that applies), or null if it may."""
    return (
        F.when(source.isin(*LATE_SOURCES), "leaks")
        .when(available_at > decided_at, "not yet available")
        .when(stale_after < 0, "invalid staleness")
        .when(decided_at - available_at > stale_after, "stale")
    )


def replace_strict(value: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value; one without a mapping ends the job with an error. Null stays null."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, value), F.raise_error(F.concat(F.lit("no mapping for "), value)).cast("string")))


def crossings(spend: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, thresholds: Sequence[int]) -> DataFrame:
    """Each row's thresholds that the running sum of ``cost`` reaches with it: above the sum before, at or below the sum after. Costs mustn't be negative."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = spend.withColumn("spend", running)
    crossed = F.filter(F.array(*map(F.lit, thresholds)), lambda x: (x > F.col("spend") - F.col(cost)) & (x <= F.col("spend")))
    return after.withColumn("threshold", F.explode(crossed))


def latest_event(events: DataFrame, of: str, before: str) -> DataFrame:
    """For each event of one type, the same user's latest earlier event of another: a general as-of join."""
    left = events.where(F.col("event_type") == of).select("event_id", "user_id", "ts", "value")
    right = events.where(F.col("event_type") == before).select("user_id", F.col("ts").alias("seen_ts"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return asof_join(left, right, ["user_id"], "ts", "seen_ts", ["seen_id", "seen_value"], tie=["seen_id"])


# -- text --------------------------------------------------------------------------------------------------------------------

#: HTML entities that are undone, and the controlled vocabulary of threats.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
THREATS = {"healing": ("heal", "lifesteal"), "control": ("stun", "slow", "silence"), "mobility": ("dash", "sprint"), "burst": ("burst", "critical")}


def clean_text(text: Column) -> Column:
    """Entities undone, tags and ``{tokens}`` stripped, white space collapsed."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\{[^{}]*\}", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def tagged(text: Column, vocabulary: Mapping[str, Sequence[str]] = THREATS) -> Column:
    """Names of the vocabulary that have a phrase in the text, in the vocabulary's order."""
    low = F.lower(text)

    def any_of(phrases: Sequence[str]) -> Column:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | low.contains(phrase)
        return hit

    return F.array_compact(F.array(*[F.when(any_of(p), F.lit(name)) for name, p in vocabulary.items()]))


def affinity(left: Column, right: Column, weights: Mapping[str, int]) -> Column:
    """Summed weights of the tags that two arrays share."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(F.array_intersect(left, right), F.lit(0), lambda s, tag: s + F.coalesce(F.try_element_at(table, tag), F.lit(0)))


INACTIVE = ("", "0", "-1", "-2", "false")


def effective_property(value: Column) -> Column:
    """Whether a property's text means something: sentinels don't."""
    return value.isNotNull() & ~F.lower(F.trim(value)).isin(*INACTIVE)


#: An item's function is that of the first entry with a term in its text, and damage without any.
FUNCTIONS = {
    "debuff": ("healing reduction", "heal amp receive penalty", "anti-heal"),
    "headshots": ("headshot", "head shot"),
    "melee": ("melee", "heavy punch"),
    "crowd_control": ("stun", "immobil", "silence", "disarm", "knockdown", "slowpercent"),
    "mobility": ("move speed", "dash", "teleport", "leap", "sprint"),
    "healing": ("healing", "heal", "lifesteal", "health regen"),
    "utility": ("ally", "shield", "barrier", "cooldown", "active"),
}


def item_function(text: Column) -> Column:
    return F.coalesce(F.try_element_at(tagged(text, FUNCTIONS), F.lit(1)), F.lit("damage"))


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.pmod(seconds, F.lit(60)).cast("long"))


def nearest_thousand(value: Column) -> Column:
    return (F.floor(value / 1000 + 0.5) * 1000).cast("long")


#: The mirrors of a host whose names don't change what they serve.
MIRRORS = ("m", "www", "blog")


def content_hash(*texts: Column, mirrors: Sequence[str] = MIRRORS) -> Column:
    """SHA-256 of texts joined by newlines, wherever they were served from: mirrors' names are taken out of all hosts of addresses in them. A null text counts as empty."""
    host = f"(?<=//)(?:{'|'.join(mirrors)})[.]"
    return F.sha2(F.concat_ws("\n", *[F.regexp_replace(F.coalesce(x, F.lit("")), host, "") for x in texts]).cast("binary"), 256)
