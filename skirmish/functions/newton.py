"""Many small logistic models fitted at once, over all rows, by Newton steps whose sums Spark works out.

A row belongs to the model that its key columns name; each pass is one aggregation for all models: loss, gradient and Hessian as sums by model, in each task first, so no model's rows are ever gathered
in one place, however many they are. The steps themselves, on a few numbers a model, are taken by the driver. The number of models must be bounded by a catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.operators.quantiles import exact_quantiles

#: Of log odds, as in :func:`skirmish.functions.models.logistic_predict`.
LIMIT = 40.0


@dataclass
class Fitted:
    """A model: medians for missing values, centres and spreads of the features, weights with the intercept last; or a probability that is the same for all."""

    fill: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def model_table(df: DataFrame, models: dict[tuple, Fitted], key: Sequence[str], d: int) -> DataFrame:
    """The models as rows (key, constant, m0.., c0.., s0.., w0..), to be joined to ``df``'s rows."""
    names = [*(f"m{i}" for i in range(d)), *(f"c{i}" for i in range(d)), *(f"s{i}" for i in range(d)), *(f"w{i}" for i in range(d + 1))]
    schema = T.StructType([*[df.schema[c] for c in key], T.StructField("constant", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    rows = [(*k, m.constant, *map(float, (*m.fill, *m.centre, *m.spread, *m.weights))) for k, m in models.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def _scaled(features: Sequence[str]) -> list[Column]:
    return [(F.coalesce(F.nanvl(F.col(f), F.lit(None)), F.col(f"m{i}")) - F.col(f"c{i}")) / F.col(f"s{i}") for i, f in enumerate(features)]


def _odds(scaled: Sequence[Column]) -> Column:
    z = F.col(f"w{len(scaled)}")
    for i, x in enumerate(scaled):
        z = z + x * F.col(f"w{i}")
    return z


def probability(features: Sequence[str]) -> Column:
    """What a row's joined model (:func:`model_table`) predicts for it."""
    z = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), _odds(_scaled(features))))
    return F.coalesce(F.col("constant"), 1 / (1 + F.exp(-z)))


def _sums(data: DataFrame, features: Sequence[str], width: int, each: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """{model: sums} of what ``each`` (models, features, targets) gives for each row, ``width`` numbers. A task adds its rows up by model, so it hands on a row a model at most."""
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            model = batch.column("model").to_numpy()
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
            values = each(model, x, batch.column("target").to_numpy().astype(float))
            order = np.argsort(model, kind="stable")
            found, begin = np.unique(model[order], return_index=True)
            for k, v in zip(found.tolist(), np.add.reduceat(values[order], begin, axis=0) if len(found) else (), strict=True):
                total[k] = total[k] + v if k in total else v
        if total:
            columns = np.array(list(total.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *map(pa.array, columns)], ["model", *names])

    partial = data.mapInArrow(run, "model int, " + ", ".join(f"{n} double" for n in names))
    return {r[0]: np.array(r[1:], float) for r in partial.groupBy("model").agg(*[F.sum(n).alias(n) for n in names]).collect()}


def fit(rows: DataFrame, key: Sequence[str], features: Sequence[str], target: str, c: float = 0.5, steps: int = 50) -> dict[tuple, Fitted]:
    """{key: model} of every group of ``rows``: minimises ``|w|^2 / 2 + c * sum of log losses``, the intercept unpenalised, on features scaled to variance 1.

    Missing values take the group's exact median. A group with one outcome only has its smoothed rate.
    """
    d, key = len(features), list(key)
    names = [tuple(r) for r in rows.select(*key).distinct().collect()]  # a catalogue's number of models
    if not names:
        return {}
    numbers = rows.sparkSession.createDataFrame([(*n, k) for k, n in enumerate(names)], T.StructType([*[rows.schema[x] for x in key], T.StructField("model", T.IntegerType())]))
    known = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features]
    data = rows.join(F.broadcast(numbers), key).select("model", F.col(target).cast("double").alias("target"), *known).persist()
    try:
        fitted = _fit(data, features, d, c, steps)
    finally:
        data.unpersist()
    return {names[k]: m for k, m in fitted.items()}


def _fit(data: DataFrame, features: Sequence[str], d: int, c: float, steps: int) -> dict[int, Fitted]:
    sums = _sums(data, features, 2 + 2 * d, lambda k, x, y: np.column_stack([np.ones(len(y)), y, ~np.isnan(x), np.nan_to_num(x)]))
    missing = [f for i, f in enumerate(features) if any(v[2 + i] < v[0] for v in sums.values())]
    medians = exact_quantiles(data, ["model"], missing, (0.5,)) if missing else {}
    models, todo = {}, {}
    for k, v in sums.items():
        fill = np.array([medians.get((k,), {}).get((f, 0.5), 0.0) for f in features])
        centre = (v[2 + d :] + (v[0] - v[2 : 2 + d]) * fill) / v[0]
        models[k] = Fitted(fill, centre, np.ones(d), np.zeros(d + 1))
        if v[1] in (0, v[0]):
            models[k].constant = float((v[1] + 1) / (v[0] + 2))
        else:
            todo[k] = models[k]

    def scaled(of: tuple[np.ndarray, ...], k: np.ndarray, x: np.ndarray) -> np.ndarray:
        fill, centre, spread = (table[k] for table in of)
        return (np.where(np.isnan(x), fill, x) - centre) / spread

    def tables() -> tuple[np.ndarray, ...]:
        """What all models share out to the tasks: a row each, those that are done at zero."""
        out = [np.zeros((max(models) + 1, d)), np.zeros((max(models) + 1, d)), np.ones((max(models) + 1, d)), np.zeros((max(models) + 1, d + 1))]
        for k, m in models.items():
            for table, values in zip(out, (m.fill, m.centre, m.spread, m.weights), strict=True):
                table[k] = values
        return tuple(out)

    of = tables()[:3]
    for k, v in _sums(data, features, d, lambda k, x, y: scaled(of, k, x) ** 2).items():
        spread = np.sqrt(v / sums[k][0])
        models[k].spread = np.where(spread > 0, spread, 1.0)
    upper = np.triu_indices(d + 1)

    def passed(weights: dict[int, np.ndarray], todo: set[int]) -> dict[int, np.ndarray]:
        for k, w in weights.items():
            models[k].weights = w
        *of, table = tables()

        def each(k: np.ndarray, x: np.ndarray, y: np.ndarray, of=tuple(of), weights=table) -> np.ndarray:
            design = np.column_stack([scaled(of, k, x), np.ones(len(y))])
            z = (design * weights[k]).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))
            return np.column_stack([np.logaddexp(0, z) - y * z, (p - y)[:, None] * design, (p * (1 - p))[:, None] * design[:, upper[0]] * design[:, upper[1]]])

        # Models that are done need no more sums.
        return _sums(data.where(F.col("model").isin(*todo)) if len(todo) < len(models) / 4 else data, features, 1 + (d + 1) + len(upper[0]), each)

    for k, w in descend({k: m.weights for k, m in todo.items()}, np.append(np.ones(d), 0.0), c, steps, passed).items():
        models[k].weights = w
    return models


def descend(weights: dict, ridge: np.ndarray, c: float, steps: int, sums: Callable[[dict, set], dict]) -> dict:
    """The weights of each model by damped Newton steps, all models in one pass. ``sums`` (weights, models that go on) gives loss, gradient and the Hessian's upper triangle over a model's rows."""
    weights, todo, upper = dict(weights), set(weights), np.triu_indices(len(ridge))
    start: dict = {}  # the last accepted weights, their loss, the step from them and its scale
    for _ in range(steps if todo else 0):
        for k, v in sums(weights, todo).items():
            if k not in todo:
                continue
            now = float(0.5 * (ridge * weights[k] ** 2).sum() + c * v[0])
            if k in start:
                at, before, move, scale = start[k]
                if now > before and scale > 1e-6:
                    start[k] = (at, before, move, scale / 2)
                    weights[k] = at - scale / 2 * move
                    continue
                if abs(before - now) < 1e-10 * (1 + abs(now)):
                    todo.discard(k)
                    continue
            h = np.zeros((len(ridge), len(ridge)))
            h[upper] = v[len(ridge) + 1 :]
            h = h + h.T - np.diag(np.diag(h))
            gradient = ridge * weights[k] + c * v[1 : len(ridge) + 1]
            move = np.linalg.solve(np.diag(ridge + 1e-10) + c * h, gradient)
            start[k] = (weights[k], now, move, 1.0)
            weights[k] = weights[k] - move
            if gradient @ move < 1e-10 * (1 + abs(now)):  # twice what the step can gain
                todo.discard(k)
        if not todo:
            break
    return weights


@dataclass
class WithItems:
    """Two models of a group, of its state alone and with its items, weights as :class:`skirmish.functions.models.Scaler` lays features out: items, state, indicators of ``flagged``, intercept."""

    items: list
    fill: np.ndarray
    flagged: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    state: np.ndarray
    state_and_item: np.ndarray


def fit_with_items(rows: DataFrame, key: Sequence[str], item: str, features: Sequence[str], target: str, c: float = 0.5, steps: int = 50) -> dict[tuple, WithItems]:
    """{key: models} of every group of ``rows``, over all its rows: features with exact medians for missing values and indicators of these, scaled to variance 1; items as unscaled indicators.

    Groups and items are bounded by a catalogue. A task adds up a matrix for each model; rows don't leave it.
    """
    spark, d, key = rows.sparkSession, len(features), list(key)
    owned: dict[tuple, list] = {}
    for r in sorted(rows.select(*key, item).distinct().collect()):  # the catalogue's items by group
        owned.setdefault(tuple(r)[:-1], []).append(r[-1])
    if not owned:
        return {}
    numbers = T.StructType([*[rows.schema[x] for x in (*key, item)], T.StructField("model", T.IntegerType()), T.StructField("place", T.IntegerType())])
    places = spark.createDataFrame([(*k, i, g, n) for g, (k, items) in enumerate(owned.items()) for n, i in enumerate(items)], numbers)
    known = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features]
    data = rows.join(F.broadcast(places), [*key, item]).select("model", "place", F.col(target).cast("double").alias("target"), *known).persist()
    try:
        found = _fit_with_items(data, len(owned), max(map(len, owned.values())), features, c, steps)
    finally:
        data.unpersist()
    out = {}
    for g, (k, items) in enumerate(owned.items()):
        fill, flagged, centre, spread, alone, whole = found[g]
        shown = [*range(d), *(d + flagged)]
        state = len(alone) - 2 * d - 1 + np.array([*shown, 2 * d])
        out[k] = WithItems(items, fill, flagged, centre[shown], spread[shown], alone[state], whole[[*range(len(items)), *state]])
    return out


def _fit_with_items(data: DataFrame, groups: int, places: int, features: Sequence[str], c: float, steps: int) -> list[tuple[np.ndarray, ...]]:
    """(fill, flagged, centre, spread, weights of the state alone and with items) of each group. All groups have as many columns: those of items and indicators that a group lacks are zero, and so are their weights."""
    d = len(features)
    counts = {r["model"]: np.array(r[1:], float) for r in data.groupBy("model").agg(F.count("*"), *[F.count(f) for f in features]).collect()}
    missing = [f for i, f in enumerate(features) if any(v[1 + i] < v[0] for v in counts.values())]
    medians = exact_quantiles(data, ["model"], missing, (0.5,)) if missing else {}
    fill = np.array([[medians.get((g,), {}).get((f, 0.5), 0.0) for f in features] for g in range(groups)])
    fills = data.sparkSession.createDataFrame([(g, *map(float, fill[g])) for g in range(groups)], "model int, " + ", ".join(f"m{i} double" for i in range(d)))
    filled = [F.coalesce(F.col(f), F.col(f"m{i}")) for i, f in enumerate(features)]
    centre, spread = np.zeros((groups, 2 * d)), np.zeros((groups, 2 * d))
    for r in data.join(F.broadcast(fills), "model").groupBy("model").agg(*map(F.avg, filled), *map(F.stddev_pop, filled)).collect():
        centre[r["model"], :d], spread[r["model"], :d] = r[1 : 1 + d], r[1 + d :]
    share = np.array([1 - counts[g][1:] / counts[g][0] for g in range(groups)])
    centre[:, d:], spread[:, d:] = share, np.sqrt(share * (1 - share))
    spread[spread == 0] = 1.0
    width = places + 2 * d + 1
    upper = np.triu_indices(width)

    def sums(weights: dict[int, np.ndarray], todo: set[int]) -> dict[int, np.ndarray]:
        """Model 2 g is a group's state alone, 2 g + 1 the one with items."""
        going = sorted({k // 2 for k in todo})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                group, place, target = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("model", "place", "target"))
                values = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
                for g in np.unique(group).tolist():
                    at = np.flatnonzero(group == g)
                    x, y, unknown = values[at], target[at], np.isnan(values[at])
                    state = (np.column_stack([np.where(unknown, fill[g], x), unknown]) - centre[g]) / spread[g]
                    hot = (place[at][:, None] == np.arange(places)).astype(float)
                    for k, own in ((2 * g, np.zeros_like(hot)), (2 * g + 1, hot)):
                        if k in todo:
                            design = np.column_stack([own, state, np.ones(len(y))])
                            z = design @ weights[k]
                            p = 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))
                            v = np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], design.T @ (p - y), ((design.T * (p * (1 - p))) @ design)[upper]])
                            total[k] = total[k] + v if k in total else v
            if total:
                size = 1 + width + len(upper[0])
                numbers = np.repeat(np.array(list(total), np.int32), size), np.tile(np.arange(size, dtype=np.int32), len(total)), np.concatenate(list(total.values()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers)], ["model", "number", "value"])

        partial = data.where(F.col("model").isin(*going)).mapInArrow(run, "model int, number int, value double")
        out: dict[int, np.ndarray] = {}
        for r in partial.groupBy("model", "number").agg(F.sum("value")).collect():
            out.setdefault(r[0], np.zeros(1 + width + len(upper[0])))[r[1]] = r[2]
        return out

    ridge = np.append(np.ones(width - 1), 0.0)
    weights = descend({k: np.zeros(width) for k in range(2 * groups)}, ridge, c, steps, sums)
    return [(fill[g], np.flatnonzero(share[g] > 0), centre[g], spread[g], weights[2 * g], weights[2 * g + 1]) for g in range(groups)]
