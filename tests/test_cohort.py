"""The derived tables on matches made for the purpose."""

import pytest
from pyspark.sql import functions as F

from skirmish.plans import analytics, estimates, policies
from skirmish.plans.cohort import Tables
from skirmish.sources import adapter


@pytest.fixture(scope="module")
def tied(spark, sf_dir):
    """Players of complete matches, each with forty purchases of which many are equal in all columns."""
    events = F.array(*[F.struct(F.lit(1 + k % 3).cast("long").alias("item"), F.lit(200 + k % 2).alias("t")) for k in range(40)])
    rows = spark.range(24).select(
        F.floor(F.col("id") / 12).alias("match_id"), (F.col("id") % 12 + 1).cast("int").alias("player_slot"), F.when(F.col("id") % 12 < 6, "Team0").otherwise("Team1").alias("team"),
        F.lit(1).alias("hero_id"), "id", F.lit(1).alias("assigned_lane"), F.lit("Ranked").alias("match_mode"), F.lit("Normal").alias("game_mode"), F.lit("2000-01-01").cast("timestamp").alias("start_time"),
        F.lit(1500).alias("duration_s"), F.lit(80).alias("average_badge"), (F.col("id") % 12 < 6).alias("won"), F.when(F.col("id") % 12 < 6, "Win").otherwise("Loss").alias("player_match_outcome"),
        F.lit(True).alias("rewards_eligible"), F.lit(1.0).alias("net_worth"), F.lit(0).alias("calibration_games"), events["item"].alias("item_ids"), events["t"].alias("item_times"),
        F.transform(events, lambda e: F.lit(0)).alias("item_sold_times"), F.transform(events, lambda e: F.lit(1)).alias("item_imbued"), F.array(F.lit(180)).alias("stat_times"), F.array(F.lit(100)).alias("stat_net_worths"),
    ).withColumnRenamed("id", "account_id")
    return Tables(rows, adapter.item_assets(spark, sf_dir))


def test_ordinals_of_equal_purchases_follow_the_order_of_events(tied):
    """of purchases equal in all that orders them, the earlier event has the smaller ordinal."""
    rows = tied.purchases.select("match_id", "player_slot", "item_id", "event_order", "item_purchase_ordinal").collect()
    assert len(rows) == 24 * 40
    found = {}
    for r in sorted(rows, key=lambda r: r["event_order"]):
        found.setdefault((r["match_id"], r["player_slot"], r["item_id"]), []).append(r["item_purchase_ordinal"])
    assert all(x == list(range(1, len(x) + 1)) for x in found.values())


def test_nested_and_flat_sources_give_the_same_tables(spark, sf_dir):
    flat, nested = Tables.of(spark, sf_dir), Tables(adapter.match_player(spark, sf_dir), adapter.item_assets(spark, sf_dir))
    for name in ("purchases", "first_purchases"):
        x, y = getattr(flat, name), getattr(nested, name)
        assert x.count() > 0
        assert x.select(*y.columns).exceptAll(y).isEmpty()
        assert y.exceptAll(x.select(*y.columns)).isEmpty()


def _shuffled(df):
    """Names of the keys by which the plan of ``df`` deals rows, without those of kept tables."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_purchases_are_dealt_by_match_alone(spark, sf_dir):
    """Shared step of F3 to F18: the catalogue's few items were keys of a shuffle of all purchases, and purchases were shuffled again for each join."""
    plan = "\n".join(_shuffled(Tables.of(spark, sf_dir).first_purchases))
    assert "item_id#" not in plan
    assert "player_slot#" not in plan


def test_shared_tables_sort_and_keep_narrow_rows(spark, sf_dir):
    """F8, F12, F16: names of items went through every sort and kept table, snapshots were aggregated by sorts, and purchases were sorted once more for what was spent before."""
    tables = Tables.of(spark, sf_dir)
    plan = tables.first_purchases._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("SortAggregate" in line for line in plan)
    assert not any("item_name" in line for line in plan if "InMemoryRelation" in line and "buy_time" in line)
    sums = [line for line in plan if "Window [" in line and "windowspecdefinition(match_id" in line and "buy_time" in line]
    assert sums and not any("hero_id" in line.split("], [")[0] for line in sums)
    assert {"item_name", "tier", "cost", "slot", "active"} <= set(tables.purchases.columns) & set(tables.first_purchases.columns) & set(tables.decision_opportunities.columns)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _reads_purchases_as_they_come(plan):
    """No window over purchases, no kept table of them, no sort of them, and none of their columns that the query doesn't name."""
    assert "Window [row_number" not in plan
    assert "sold_time#" not in plan
    assert not any("buy_time#" in line for line in plan.split("\n") if "InMemoryRelation" in line or "Sort [" in line)


def test_net_worth_validity_needs_no_windows(spark, sf_dir):
    """it waited for ordinals, the order of events and what was spent before, and for a kept table of all purchases, of which it reads none."""
    _reads_purchases_as_they_come(_plan(estimates.net_worth_validity(Tables(adapter.players(spark, sf_dir), adapter.item_assets(spark, sf_dir), events=adapter.purchase_events(spark, sf_dir)))))


def test_players_arrays_are_in_no_shuffle(spark, sf_dir):
    """arrays are made after players are dealt, also where no window by match comes first."""
    players = adapter.players(spark, sf_dir).select("match_id", "stat_net_worths").groupBy("match_id").agg(F.max("stat_net_worths").alias("most"))
    lines = _plan(players).split("\n")
    assert sum("Exchange" in line for line in lines) == 1
    assert not any("transform(" in line for line in lines[next(i for i, line in enumerate(lines) if "Exchange" in line) :])


def test_bought_is_purchases_without_what_windows_add(spark, sf_dir):
    tables = Tables.of(spark, sf_dir)
    columns = tables.bought.columns
    assert not {"event_order", "item_purchase_ordinal", "same_second_purchase_count"} & set(columns)
    got, want = tables.bought, tables.purchases.select(*columns)
    assert got.count() > 0
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).isEmpty()


def test_bought_of_equal_purchases(tied):
    assert tied.bought.count() == 24 * 40


@pytest.mark.parametrize("folds", [False, True])
def test_item_outcomes_need_no_windows(spark, sf_dir, folds):
    """item_eb reads five of the columns of the item aggregates, for which all purchases were sorted, kept and joined with all that is known of a player."""
    tables = Tables(adapter.players(spark, sf_dir), adapter.item_assets(spark, sf_dir), events=adapter.purchase_events(spark, sf_dir))
    _reads_purchases_as_they_come(_plan(policies.item_eb(tables, folds)))


@pytest.mark.parametrize("folds", [False, True])
def test_item_outcomes_are_columns_of_the_item_aggregates(spark, sf_dir, folds):
    tables = Tables.of(spark, sf_dir)
    got = analytics.item_outcomes(tables, folds)
    columns = [*(["fold"] if folds else []), *analytics.ITEM, "adopter_matches", "wins", "raw_outcome_rate", "median_buy_time_s", "adoption_rate"]
    got, want = got.select(*columns), analytics.item_aggregates(tables, folds).select(*columns)
    assert got.count() > 0
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).isEmpty()


def test_item_outcomes_of_repeated_purchases(tied):
    """A player's forty purchases of three items are one ownership an item, at its earliest second."""
    rows = analytics.item_outcomes(tied).collect()
    assert sorted((r["item_id"], r["adopter_matches"], r["wins"], r["median_buy_time_s"], r["adoption_rate"]) for r in rows) == [(i, 24, 12, 200.0, 1.0) for i in (1, 2, 3)]
