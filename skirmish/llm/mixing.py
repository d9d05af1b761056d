"""Mixing sources to target weights (operator 4) by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import fresh

#: A rate above ``ONE_DRAW`` is drawn as a sum of independent parts of at most ``PART`` each: exp(-rate) must stay a normal double.
ONE_DRAW, PART = 600.0, 500.0
#: A rate above this is refused, as a document's copies are listed in one array. The default rate is at most the square root of all characters, so it
#: stays below this up to 2 ** 48 of them, however small a source is.
MAX_RATE = 2.0**24


def _uniform(*parts: F.Column) -> F.Column:
    """In (0, 1), from the first 52 bits of an MD5 digest; the same in any engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0) -> DataFrame:
    """Mean repetitions of each source: its share of the output over its share of the input.

    ``weights``: target weights by source (sources that it leaves out get none). Without it, the target weight is the
    source's characters to the given ``power``, which draws small sources up and a
    dominant one down. ``budget``: characters of output for each of input. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        target = F.pow(F.col("size"), F.lit(power))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        target = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    weighed = sizes.select("source", "size", target.alias("weight"))
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(budget) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    # A source without characters has no share to scale: its documents stay as they are in number, on average.
    return weighed.crossJoin(F.broadcast(total)).select("source", "size", "weight", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.lit(1.0)).alias("rate"))


def _thresholds(rate: F.Column) -> F.Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to where a 52-bit uniform number can't reach."""
    top = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: F.Column, k: F.Column) -> F.Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["sums"])


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0, seed: int = 17, copy: str = "copy", key: str = "shuffle_key") -> DataFrame:
    """Repeat each document a Poisson number of times, with its source's rate as the mean, and shuffle globally.

    Adds the columns ``copy`` (from 0) and ``key``, by which the result is globally ordered. The number is found by inversion:
    how many cumulative probabilities lie below a uniform number that ``seed``, ``doc_id`` and the text's digest fix.
    So a run can be repeated, the counts of two documents are independent, and rows that repeat
    both id and text get the same count. Of a rate above ``ONE_DRAW``, as a source of a few characters beside large ones has, equal parts are drawn
    by a uniform number each and summed, which is Poisson again. Documents whose number is 0 don't appear; that is what the method does
    with a rate below 1, on average as often as the target asks.

    A null text has length 0; a null ``doc_id`` is written as ``null`` in the hash. An empty table gives an empty result.
    Columns that have these two names are replaced. Sources are joined by value, null included; Spark
    splits a dominant source, and no step gathers one.
    """
    kept = [c for c in docs.columns if c.lower() not in (copy.lower(), key.lower())]
    by, n_parts, cdf_of, identity_of, u, n_copies = (fresh(docs, c) for c in ("rate_source", "parts", "cdf", "identity", "u", "n_copies"))
    rates = source_rates(docs, weights, power, budget)
    rate = F.when(F.col("rate") > MAX_RATE, F.raise_error(F.lit("a repetition rate is above the limit")).cast("double")).otherwise(F.col("rate"))
    parts = F.when(rate > ONE_DRAW, F.ceil(rate / PART)).otherwise(1).cast("int")
    cdf = rates.select(F.col("source").alias(by), rate.alias("rate"), parts.alias(n_parts)).select(by, n_parts, _thresholds(F.col("rate") / F.col(n_parts)).alias(cdf_of))
    identity = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    # The hash is taken below the join, so that it is worked out once a document and not in each comparison.
    hashed = docs.select(*kept, F.concat_ws("|", *identity).alias(identity_of)).withColumn(u, _uniform(F.col(identity_of)))
    drawn = hashed.join(cdf, F.col("source").eqNullSafe(F.col(by)))

    def below(drawn: F.Column) -> F.Column:
        return F.size(F.filter(cdf_of, lambda c: c < drawn))

    further = F.transform(F.sequence(F.lit(1), F.col(n_parts) - 1), lambda k: _uniform(F.col(identity_of), F.lit("part"), k.cast("string")))
    rest = F.when(F.col(n_parts) > 1, F.aggregate(further, F.lit(0), lambda n, more: n + below(more))).otherwise(0)
    counted = drawn.withColumn(n_copies, below(F.col(u)) + rest).where(F.col(n_copies) > 0)
    copies = counted.select(*kept, identity_of, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)).alias(copy))
    keyed = copies.withColumn(key, F.md5(F.concat_ws("|", identity_of, F.col(copy).cast("string")).cast("binary")))
    return keyed.select(*kept, copy, key).orderBy(key, copy)
