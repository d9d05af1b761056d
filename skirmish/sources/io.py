"""Sources and sinks: Parquet, CSV and JSON, catalogues, and retries round a scan."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = TypeVar("R")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Zstandard-compressed Parquet, committed as a whole by Spark's protocol."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With the schema that it was written with, so that ids beyond 31 bits and empty columns keep their types."""
    return spark.read.schema(schema).csv(path, header=True)


def retried(action: Callable[[], R], transient: Sequence[str], attempts: int = 4, wait: Callable[[float], Any] = time.sleep) -> R:
    """Run an action again after 1, 2, 4 ... seconds, if its error's text has one of the ``transient`` markers."""
    for k in range(attempts):
        try:
            return action()
        except Exception as error:
            if k + 1 == attempts or not any(m in str(error) for m in transient):
                raise
            wait(2.0**k)
    raise AssertionError("unreachable")


_ITEM = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("item_tier", T.IntegerType()), T.StructField("cost", T.IntegerType()),
        T.StructField("item_slot_type", T.StringType()), T.StructField("is_active_item", T.BooleanType()), T.StructField("is_unique", T.BooleanType()), T.StructField("component_items", T.ArrayType(T.StringType())),
    ]
)


def item_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array, with defaults: the class name for a name, cost 0, slot ``unknown`` (in lower case), unique."""
    raw = spark.read.schema(_ITEM).json(path, multiLine=True)
    return raw.select(
        F.col("id").alias("item_id"), F.coalesce("name", "class_name").alias("item_name"), "class_name", F.coalesce("item_tier", F.lit(0)).alias("tier"), F.coalesce("cost", F.lit(0)).alias("cost"),
        F.lower(F.coalesce("item_slot_type", F.lit("unknown"))).alias("slot"), F.coalesce("is_active_item", F.lit(False)).alias("active"), F.coalesce("is_unique", F.lit(True)).alias("unique_item"),
        F.to_json(F.coalesce("component_items", F.array().cast("array<string>"))).alias("component_items_json"),
    )


def shopable(items: DataFrame) -> DataFrame:
    """Items of tiers 1 to 4, by id."""
    return items.where(F.col("tier").between(1, 4)).orderBy("item_id")


def keyed_json(spark: SparkSession, pattern: str, schema: str, prefix: str, name: str) -> DataFrame:
    """Many JSON files as one relation, with the part of the file name between ``prefix`` and ``.json`` as the column ``name``."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), rf"{prefix}(.*)\.json$", 1))


def duration_profiles(spark: SparkSession, folder: str, least: int = 20) -> DataFrame:
    """Outcome rates by hero and duration bucket from captured files, for cells of at least ``least`` matches."""
    raw = keyed_json(spark, f"{folder}/hero-duration-*.json", "hero_id int, wins long, matches long", "hero-duration-", "duration_bucket")
    kept = raw.where((F.col("matches") >= least) & F.col("hero_id").isNotNull())
    return kept.withColumn("ending_outcome_rate", F.coalesce("wins", F.lit(0)) / F.col("matches"))


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256_json(value: Any) -> str:
    """Identity of a document: the digest of its canonical form."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def publish_json(value: Any, path: str) -> None:
    """Write a small document whole or not at all."""
    target = Path(path)
    draft = target.with_suffix(target.suffix + ".draft")
    draft.write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    draft.replace(target)
