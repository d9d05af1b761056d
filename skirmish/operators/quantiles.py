"""Exact quantiles by distributed selection.

``percentile`` gathers the distinct values of a group in one buffer. Here a pass counts values by equal ranges between a group's bounds and keeps the one range with the
wanted rank, until that holds few rows or one value alone; only these rows are sorted. Each pass moves counts, ``RANGES`` for each wanted rank at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 4096
#: Values of a range that are sorted in the end.
FEW = 4096


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> dict[tuple, dict[tuple[str, float], float]]:
    """{group: {(column, share): quantile}}, interpolated between neighbouring ranks, nulls left out; a column without values in a group has no entry.

    For groups that a catalogue bounds: the wanted ranks, a few numbers a group, pass the driver. ``df`` is read a few times, so it should be kept or written.
    """
    spark, number = df.sparkSession, {c: k for k, c in enumerate(columns)}
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("__column"), F.col(c).cast("double").alias("__value")) for c, k in number.items()]))).where("__value IS NOT NULL AND NOT isnan(__value)")
    key = [*by, "__column"]
    found: dict[tuple, float] = {}
    want: list[tuple] = []  # (group, column, rank, its place in the range, smallest, largest)
    sizes: dict[tuple, int] = {}
    wide: dict[tuple, int] = {}

    def ranks(n: int) -> list[int]:
        return sorted({r for p in shares for r in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})

    def settle(target: tuple, place: int, n: int, least: float, most: float) -> None:
        if least == most or n == 1:
            found[target] = least
        else:
            want.append((*target, place, least, most))
            wide[target] = n

    for r in long.groupBy(*key).agg(F.count("*").alias("n"), F.min("__value").alias("a"), F.max("__value").alias("b")).collect():
        group = tuple(r[c] for c in key)
        sizes[group] = r["n"]
        for rank in ranks(r["n"]):
            settle((*group, rank), rank, r["n"], r["a"], r["b"])
    kinds = [long.schema[c] for c in key]
    schema = T.StructType([*kinds, T.StructField("__rank", T.LongType()), T.StructField("__place", T.LongType()), T.StructField("__least", T.DoubleType()), T.StructField("__most", T.DoubleType())])
    while want:
        # Ranks are few, as groups are.
        targets = F.broadcast(spark.createDataFrame(want, schema))
        same = F.lit(True)
        for c in key:
            same &= long[c].eqNullSafe(targets[c])
        inside = long.join(targets, same & F.col("__value").between(F.col("__least"), F.col("__most"))).select(*[targets[c] for c in key], "__rank", "__place", "__least", "__most", "__value")
        small = all(wide[w[:-3]] <= FEW for w in want)
        want = []
        if small:
            for r in inside.groupBy(*key, "__rank", "__place").agg(F.sort_array(F.collect_list("__value")).alias("values")).select(*key, "__rank", F.get("values", F.col("__place").cast("int")).alias("value")).collect():
                found[(*[r[c] for c in key], r["__rank"])] = r["value"]
            break
        at = F.least(F.lit(RANGES - 1), F.floor((F.col("__value") - F.col("__least")) / (F.col("__most") - F.col("__least")) * RANGES)).alias("__range")
        counted = inside.groupBy(*key, "__rank", "__place", at).agg(F.count("*").alias("n"), F.min("__value").alias("a"), F.max("__value").alias("b"))
        before = F.sum("n").over(Window.partitionBy(*key, "__rank").orderBy("__range")) - F.col("n")
        hit = counted.withColumn("before", before).where("before <= __place AND __place < before + n")
        for r in hit.collect():
            settle((*[r[c] for c in key], r["__rank"]), r["__place"] - r["before"], r["n"], r["a"], r["b"])
    out: dict[tuple, dict[tuple[str, float], float]] = {}
    for group, n in sizes.items():
        for p in shares:
            at = (n - 1) * p
            low = found[(*group, int(at))]
            high = found[(*group, min(n - 1, int(at) + 1))]
            out.setdefault(group[:-1], {})[columns[group[-1]], p] = low + (high - low) * (at - int(at))
    return out
