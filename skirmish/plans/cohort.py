"""Cohort admission and the derived tables that every analysis reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.operators.quantiles import exact_quantiles
from skirmish.sources import adapter

PHASE_STARTS = (0, 540, 1200, 1800)
APPEARANCE = ["match_id", "player_slot"]


@dataclass(frozen=True)
class Cohort:
    """Which matches count. ``as_of`` bounds the *end* of a match, not its start."""

    since: str = "1990-01-01 00:00:00"
    as_of: str = "2030-01-01 00:00:00"
    match_mode: str = "Ranked"
    game_mode: str = "Normal"
    minimum_badge: int = 71
    maximum_badge: int = 115

    def predicate(self) -> Column:
        end = F.col("start_time") + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
        return (
            (F.col("match_mode") == self.match_mode)
            & (F.col("game_mode") == self.game_mode)
            & (F.col("start_time") >= F.lit(self.since).cast("timestamp"))
            & (end <= F.lit(self.as_of).cast("timestamp"))
            & F.col("average_badge").between(self.minimum_badge, self.maximum_badge)
        )


def phase_of(seconds: Column) -> Column:
    """Half-open phases of a match, numbered from 0."""
    value = F.lit(0)
    for number, start in enumerate(PHASE_STARTS[1:], 1):
        value = F.when(seconds >= start, number).otherwise(value)
    return value


def admitted(players: DataFrame, cohort: Cohort) -> DataFrame:
    """match_id of the complete matches of a cohort: twelve eligible players in distinct slots, six a team, six winners and six losers."""
    counted = players.where(cohort.predicate()).groupBy("match_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("player_slot").alias("slots"),
        F.count_if(F.col("team") == "Team0").alias("team0"),
        F.count_if(F.col("team") == "Team1").alias("team1"),
        F.bool_and("rewards_eligible").alias("eligible"),
        F.count_if(F.col("player_match_outcome") == "Win").alias("wins"),
        F.count_if(F.col("player_match_outcome") == "Loss").alias("losses"),
    )
    return counted.where("rows = 12 AND slots = 12 AND team0 = 6 AND team1 = 6 AND eligible AND wins = 6 AND losses = 6").select("match_id")


class Tables:
    """The derived tables of one input folder. Those that several analyses read are persisted, spilling to disk, for the life of the session."""

    _known: ClassVar[dict[tuple[str, str], Tables]] = {}

    def __init__(self, source: DataFrame, item_assets: DataFrame, cohort: Cohort | None = None, events: DataFrame | None = None) -> None:
        """``source``: players with their purchases as parallel arrays, or without these if ``events`` has a row a purchase."""
        self.source, self.cohort, self._events = source, cohort or Cohort(), events
        self._assets = item_assets
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(adapter.players(spark, sf_dir), adapter.item_assets(spark, sf_dir), events=adapter.purchase_events(spark, sf_dir))
        return cls._known[key]

    @staticmethod
    def _kept(df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, kept under ``name`` for other analyses of the session."""
        if name not in self._made:
            self._made[name] = self._kept(make())
        return self._made[name]

    @cached_property
    def item_assets(self) -> DataFrame:
        return self._kept(self._assets)

    @cached_property
    def eligible_matches(self) -> DataFrame:
        return self._kept(admitted(self.source, self.cohort))

    @cached_property
    def _admitted_players(self) -> DataFrame:
        """Source rows of admitted matches, dealt by match once; the windows and joins below keep to that partitioning."""
        return self.source.join(self.eligible_matches.hint("shuffle_hash"), "match_id").withColumn("team_id", F.when(F.col("team") == "Team0", 0).otherwise(1))

    @cached_property
    def player_matches(self) -> DataFrame:
        return self._kept(
            self._admitted_players.select(
                "match_id", "player_slot", "team_id", "hero_id", "assigned_lane", "average_badge", "won", "start_time", "duration_s",
                F.col("net_worth").alias("final_net_worth"), (F.coalesce("calibration_games", F.lit(0)) > 0).alias("calibration"),
            )
        )

    @cached_property
    def hero_account_counts(self) -> DataFrame:
        """Only the counts leave the source; account ids are in no derived table."""
        return self._admitted_players.groupBy("hero_id").agg(F.count_distinct("account_id").alias("unique_accounts"))

    @cached_property
    def match_folds(self) -> DataFrame:
        """Chronological folds: matches up to the 60 % quantile of start times train, up to the 80 % quantile validate, later ones test."""
        epoch = (F.unix_micros("start_time") / 1e6).alias("started")
        matches = self._kept(self.player_matches.groupBy("match_id").agg(F.min("start_time").alias("start_time")).select("match_id", epoch))
        ends = exact_quantiles(matches, [], ["started"], (0.6, 0.8)).get((), {})
        train, validation = (F.lit(ends.get(("started", p))) for p in (0.6, 0.8))
        fold = F.when(F.col("started") <= train, "train").when(F.col("started") <= validation, "validation").otherwise("test")
        return self._kept(matches.select("match_id", fold.alias("fold")))

    @cached_property
    def compositions(self) -> DataFrame:
        return self.player_matches.groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list("hero_id")).alias("hero_ids"))

    @cached_property
    def team_snapshots(self) -> DataFrame:
        zipped = F.arrays_zip(F.col("stat_times").alias("stat_time"), F.col("stat_net_worths").alias("worth"))
        seen = self._admitted_players.select("match_id", "team_id", F.inline(zipped))
        return self._kept(seen.groupBy("match_id", "team_id", "stat_time").agg(F.sum("worth").cast("long").alias("team_net_worth"), F.count("*").alias("observed_players")))

    def _described(self, bought: DataFrame) -> DataFrame:
        """Purchases with the catalogue's columns. These aren't kept with the rows, so no sort, shuffle or persisted table carries them."""
        return bought.join(F.broadcast(self.item_assets), "item_id")  # the catalogue

    @cached_property
    def _events_by_match(self) -> DataFrame:
        """Purchases of the catalogue's items, dealt by match alone, so they are shuffled this once; a player counts wholly or not at all."""
        if self._events is None:
            zipped = F.arrays_zip(F.col("item_ids").alias("item_id"), F.col("item_times").alias("buy_time"), F.col("item_sold_times").alias("sold_time"), F.col("item_imbued").alias("imbued_ability_id"))
            events = self._admitted_players.select(*APPEARANCE, F.inline(zipped))
        else:
            events = self._events.select(*APPEARANCE, "item_id", "buy_time", "sold_time", "imbued_ability_id")
        return events.where("buy_time > 0").join(F.broadcast(self.item_assets.select("item_id", "cost")), "item_id").repartition("match_id")  # the catalogue

    def _observed(self, events: DataFrame, hint: str | None = None) -> DataFrame:
        """``events``, dealt by match, with their players' columns and last known net worth; ``hint``: how to join the players."""
        shown = [c for c in self.player_matches.columns if c not in ("final_net_worth", "calibration")]
        held = [*shown, F.col("net_worth").alias("final_net_worth"), (F.coalesce("calibration_games", F.lit(0)) > 0).alias("calibration"), F.col("seen.time").alias("stat_times"), F.col("seen.value").alias("stat_net_worths")]
        observed = self._admitted_players.withColumn("seen", F.filter(F.arrays_zip(F.col("stat_times").alias("time"), F.col("stat_net_worths").alias("value")), lambda x: x["time"].isNotNull()))
        players = observed.select(*held).withColumnRenamed("player_slot", "slot")
        right = players.hint(hint) if hint else players
        # By match too, a player's slot being a condition and not a key.
        same = F.col("e.match_id") == F.col("p.match_id"), F.col("e.player_slot").between(F.col("p.slot"), F.col("p.slot"))
        met = events.alias("e").join(right.alias("p"), same[0] & same[1]).select("e.*", *[f"p.{c}" for c in players.columns if c not in ("match_id", "slot")])
        last = F.size(F.filter("stat_times", lambda x: x <= F.col("buy_time"))) - 1  # the times are sorted and known
        known = met.withColumn("last", last).select("*", F.get("stat_net_worths", "last").alias("own_net_worth_at_buy"), F.get("stat_times", "last").alias("state_observed_at_s"))
        return known.drop("last", "stat_times", "stat_net_worths")

    @cached_property
    def bought(self) -> DataFrame:
        """:attr:`purchases` without the catalogue's columns and what windows add (ordinals, the order of events, ties). Nothing of it is sorted or kept, so a reader that can do without those shuffles only the columns it names."""
        return self._observed(self._events_by_match.drop("cost"), "shuffle_hash")

    @cached_property
    def _purchases(self) -> DataFrame:
        """:attr:`purchases` without the catalogue's columns, with what the player had spent and bought for the first time before that second.

        All windows are by player, over two sorts of rows: one by item, for the ordinals, and one by time, for all the rest.
        They come before the players' columns, which would make the sorted rows three times as wide.
        """
        player = Window.partitionBy(*APPEARANCE)
        same_item = Window.partitionBy(*APPEARANCE, "item_id").orderBy("buy_time", "sold_time", "imbued_ability_id")
        numbered = self._events_by_match.withColumn("item_purchase_ordinal", F.row_number().over(same_item).cast("long"))
        ordered = numbered.withColumn("event_order", F.row_number().over(player.orderBy("buy_time", "item_id", "sold_time", "imbued_ability_id", "item_purchase_ordinal")).cast("long"))
        earlier, first = player.orderBy("buy_time").rangeBetween(Window.unboundedPreceding, -1), F.col("item_purchase_ordinal") == 1
        counted = ordered.select(
            "*",
            F.count("*").over(Window.partitionBy(*APPEARANCE, "buy_time")).alias("same_second_purchase_count"),
            F.sum(F.when(first, F.col("cost"))).over(earlier).alias("prior_catalog_spend"),
            F.count_if(first).over(earlier).alias("prior_purchase_count"),
        ).drop("cost")
        return self._kept(self._observed(counted))

    @cached_property
    def purchases(self) -> DataFrame:
        """One row a purchase. Event ties of one second are ordered by item, then sale and imbued ability; rows equal in all of these have no order of their own, so an item's ordinals and the order of events go together."""
        return self._described(self._purchases.drop("prior_catalog_spend", "prior_purchase_count"))

    @cached_property
    def _first_purchases(self) -> DataFrame:
        """:attr:`first_purchases` without the catalogue's columns."""
        firsts = self._purchases.where("item_purchase_ordinal = 1").join(self.match_folds.hint("shuffle_hash"), "match_id").withColumn("phase", phase_of(F.col("buy_time")))
        # Both teams' last known states between one snapshot of the match and the next. A match has as many as its telemetry, so purchases are joined by match where they are, with the time as a condition;
        # snapshots are the smaller side, which is hashed, so purchases aren't sorted for it. Numbers are aggregated one by one: a maximum of structs would need sorts.
        time, order, fields = F.col("stat_time"), Window.partitionBy("match_id").orderBy("stat_time"), ("team_net_worth", "observed_players")
        dealt = self.team_snapshots.where(time.isNotNull()).repartition("match_id")
        spans = dealt.groupBy("match_id", "stat_time").agg(*[F.max(F.when(F.col("team_id") == k, F.col(c))).alias(f"{c}_{k}") for k in (0, 1) for c in fields])
        now = [F.when(F.col(f"observed_players_{k}").isNotNull(), F.struct(*[F.col(f"{c}_{k}").alias(c) for c in fields])) for k in (0, 1)]
        spans = spans.select("match_id", time.alias("since"), F.lead("stat_time").over(order).alias("until"), *[F.last(x, ignorenulls=True).over(order).alias(f"state_{k}") for k, x in enumerate(now)])
        at = (F.col("buy_time") >= F.col("since")) & (F.col("until").isNull() | (F.col("buy_time") < F.col("until")))
        met = firsts.alias("f").join(spans.hint("shuffle_hash").alias("s"), (F.col("f.match_id") == F.col("s.match_id")) & at, "left")

        def side(first: int, column: str) -> Column:
            return F.when(F.col("f.team_id") == 0, F.col(f"s.state_{first}.{column}")).otherwise(F.col(f"s.state_{1 - first}.{column}"))

        both = met.select("f.*", *[side(k, c).alias(f"{name}_{alias}") for k, name in ((0, "own"), (1, "enemy")) for c, alias in (("team_net_worth", "team_net_worth"), ("observed_players", "team_observed_players"))])
        return self._kept(both.select("*", (F.col("own_team_net_worth") - F.col("enemy_team_net_worth")).alias("team_net_worth_lead"), (F.col("buy_time") - F.col("state_observed_at_s")).alias("state_age_s")))

    @cached_property
    def first_purchases(self) -> DataFrame:
        """First ownerships with their fold, phase, both teams' last known state, and what the player had spent before that second."""
        return self._described(self._first_purchases)

    @cached_property
    def decision_opportunities(self) -> DataFrame:
        """The first purchase of each player, phase and tier that shares its second with no other, with the choices it had."""
        order = Window.partitionBy(*APPEARANCE, "phase", "tier").orderBy("buy_time", "item_id")
        tiers = F.broadcast(self.item_assets.select("item_id", "tier"))  # the catalogue
        realized = self._first_purchases.where("same_second_purchase_count = 1").join(tiers, "item_id").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        slates = self.item_assets.groupBy("tier").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
        slates = slates.select("tier", F.to_json(F.struct("item_ids", F.lit(True).alias("includes_save"))).alias("candidate_slate_json"))
        kept = self._kept(realized)
        return self._described(kept.drop("tier")).join(F.broadcast(slates), "tier").withColumns({"realized_action": F.col("item_id").cast("string"), "save_action_observed": F.lit(False)})  # a row a tier


def banded(decisions: DataFrame) -> DataFrame:
    """Net worth and lead in bands of 5 000; unknown ones have bands of their own."""
    own, lead = F.col("own_net_worth_at_buy"), F.col("team_net_worth_lead")
    return decisions.withColumns(
        {
            "own_nw_band": F.when(own.isNull(), -1).otherwise(F.least(F.lit(12), F.floor(own / 5000))).cast("int"),
            "lead_band": F.when(lead.isNull(), -99).otherwise(F.greatest(F.lit(-8), F.least(F.lit(8), F.floor(lead / 5000)))).cast("int"),
        }
    )
