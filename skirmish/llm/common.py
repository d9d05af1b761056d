"""Helpers shared by the text operators: tables, durable intermediates and Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in a local session where it is unset (tests), a temporary one; elsewhere that is an error, as executors don't share it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skirmish-"))
        found = context.getCheckpointDir()
    return found


_written: list[str] = []


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: losing an executor later costs no recomputation of what stands before, and
    what is read twice is the same both times. Results read these tables as long as they are used, so they stay until the driver ends, or until :func:`release`.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(release, spark, 0, 0, os.getpid())
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`durable` has written so far; a mark for :func:`release`."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0, process: int | None = None) -> None:
    """Delete the tables that :func:`durable` wrote from the mark ``since`` on, but for the ``keep`` last. Nothing that is still to be evaluated may read them."""
    if process not in (None, os.getpid()):
        return
    paths = _written[since : len(_written) - keep]
    try:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    except Exception:
        if process is None:
            raise
        return  # at the driver's end the session may be gone
    _written[since : len(_written) - keep] = []


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


#: Rows that one task may take in any case.
ONE_TASK = 1 << 14


def join_spread(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", n: str | None = None) -> DataFrame:
    """An equi-join that no single key can hold up. ``right`` has at most one row a key; ``how`` is inner, left or left_semi.

    Keys of which ``left`` has more than its share for one of the shuffle's partitions are at most as many as these partitions, whatever the data, so their rows
    of ``right`` are broadcast and the left rows stay where they are. All other keys are joined by a shuffle. ``left`` is read three times: write it out before.
    ``n``: the column of ``right`` that has the number of its left rows, if that is known already; ``right`` is then read twice as well.
    """
    total = left.count()
    if total <= ONE_TASK:
        return left.join(right, on, how)
    most = max(ONE_TASK // 8, total // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n:
        hot = right.where(F.col(n) > most).withColumn("__found", F.lit(True))
    else:
        counted = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*on)
        hot = counted.join(right.withColumn("__found", F.lit(True)), on, "left")
    few = durable(hot, "hot-keys")
    if few.isEmpty():
        return left.join(right, on, how)
    rest = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right, on, how)
    held = left.join(F.broadcast(few), on)
    if how != "left":
        held = held.where("__found")
    return held.select(*rest.columns).unionByName(rest)


#: What may be broadcast, by a check of its size.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, size: F.Column) -> DataFrame:
    """``df``, a written table, with the hint to broadcast it if its rows, of ``size`` bytes each, are few enough in all."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def map_arrow(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes; ``make`` is called once a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null reads as empty."""
    column = batch.column(name).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def decoded(text: bytes) -> str:
    """The text of a string column's bytes. Spark's strings may hold bytes that aren't UTF-8: each such place reads as U+FFFD."""
    return text.decode("utf-8", "replace")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column's decimal text, modulo n; null for a null value."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")
