"""Most supported complete paths through reached states, and the widening of sparse cohorts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple[int, ...]


def state_counts(paths: DataFrame, by: Sequence[str], path: str, weight: str) -> DataFrame:
    """(by, state, next, n): support of each next step from each state, which is the multiset of the steps before it."""
    places = F.explode(F.sequence(F.lit(0), F.size(path) - 1)).alias("at")
    steps = paths.where(F.size(path) > 0).select(*by, path, weight, places)
    reached = steps.select(*by, F.array_sort(F.slice(path, F.lit(1), F.col("at"))).alias("state"), F.get(path, F.col("at")).alias("next"), weight)
    return reached.groupBy(*by, "state", "next").agg(F.sum(weight).alias("n"))


def supported_path(counts: Mapping[tuple[State, int], int], done: Callable[[State], bool]) -> list[tuple[int, int]] | None:
    """From the empty state on, the most supported next step that can still be completed: (step, support) pairs, or None. Ties go to the smaller step.

    States that lead nowhere are remembered, so each is tried once.
    """
    ahead: dict[State, list[tuple[int, int]]] = {}
    for (state, step), n in counts.items():
        ahead.setdefault(state, []).append((-n, step))
    dead: set[State] = set()

    def walk(state: State) -> list[tuple[int, int]] | None:
        if done(state):
            return []
        for n, step in sorted(ahead.get(state, ())):
            after = tuple(sorted((*state, step)))
            rest = None if after in dead else walk(after)
            if rest is not None:
                return [(step, -n), *rest]
        dead.add(state)
        return None

    return walk(())


def completable_paths(paths: DataFrame, by: str, path: str, weight: str, length: int, copies: int) -> DataFrame:
    """(by, position, step, support): of each group the complete path through reached states that takes the most supported step from each state, of the steps that can still be completed.

    A state is the multiset of the steps so far. A path is complete with ``length`` steps, ``copies`` of each. Backward from the complete states a join a level keeps the steps whose next
    state can be completed; forward from the empty state the best of these is taken, ties to the smaller step. States are shared by all observations that reached them, and no group is gathered.
    Paths in which a step comes more than ``copies`` times count up to there. Groups without a completable path have no rows; ``by`` is bounded by a catalogue.
    """
    spark = paths.sparkSession
    legal = F.filter(F.transform(path, lambda x, i: F.when(F.size(F.filter(F.slice(path, F.lit(1), i + 1), lambda y: y == x)) > copies, i)), lambda i: i.isNotNull())
    cut = F.least(F.lit(length), F.coalesce(F.array_min(legal), F.size(path)))
    steps = state_counts(paths.select(by, F.slice(path, F.lit(1), cut).alias(path), weight), [by], path, weight)
    after = F.array_sort(F.concat("state", F.array("next")))
    edges = steps.select(by, F.size("state").alias("at"), "state", "next", "n", after.alias("after")).persist()
    full = F.array_sort(F.flatten(F.array_repeat(F.array_distinct("after"), copies)))
    open_states = edges.where((F.col("at") == length - 1) & (F.col("after") == full)).select(by, F.col("after").alias("after")).distinct()
    levels = []
    for at in range(length - 1, -1, -1):
        kept = edges.where(F.col("at") == at).join(open_states, [by, "after"], "left_semi").persist()
        levels.append(kept)
        open_states = kept.select(by, F.col("state").alias("after")).distinct()
    out: list[tuple] = []
    kind = paths.schema[path].dataType.simpleString()
    at_now = [(r[by], []) for r in open_states.select(by).distinct().collect()]
    for kept in reversed(levels):
        if not at_now:
            break
        here = spark.createDataFrame(at_now, f"{by} {paths.schema[by].dataType.simpleString()}, state {kind}")  # one state a group
        best = kept.join(F.broadcast(here), [by, "state"]).groupBy(by).agg(F.max(F.struct("n", (-F.col("next")).alias("m"), "after")).alias("best")).collect()
        out += [(r[by], len(r["best"]["after"]), -r["best"]["m"], r["best"]["n"]) for r in best]
        at_now = [(r[by], r["best"]["after"]) for r in best]
    for df in (edges, *levels):
        df.unpersist()
    return spark.createDataFrame(out, f"{by} {paths.schema[by].dataType.simpleString()}, position int, step {kind[6:-1]}, support long")


def widened(windows: Sequence[dict], support: int) -> list[dict]:
    """The shortest prefix of nested cohort windows with enough ``support``; it stops before the ``mode`` or ``epoch`` changes.

    Each window must hold the one before: bounds only widen and support never falls.
    """
    chosen: list[dict] = []
    for w in windows:
        if chosen:
            last = chosen[-1]
            if w["minimum_badge"] > last["minimum_badge"] or w["maximum_badge"] < last["maximum_badge"] or w["since"] > last["since"] or w["support"] < last["support"]:
                raise ValueError("cohort windows must widen")
            if (w["mode"], w["epoch"]) != (last["mode"], last["epoch"]):
                break
        chosen.append(w)
        if w["support"] >= support:
            break
    return chosen
