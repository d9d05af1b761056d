"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

The stages hold for nulls, empty and repeated rows and extra columns as their operators define: null and empty texts have no features
and so stay at the quality classifier's 1/2, which keeps them; line dedup leaves them alone; as texts without words they are near duplicates of
one another, and one of them stays; their source's rate repeats them; and they pack as an end token alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import lines, mixing, neardup, packing, quality, simhash
from skirmish.llm.common import durable, fresh, release, table, written

#: The stages use MD5, XXH64 fingerprints, a trained model and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: learn from the labelled documents, score every document, keep those at 1/2 and above."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    predicted = fresh(docs, "predicted")
    scored = quality.score(docs, model, name=fresh(docs, "score"), predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later repeated runs of 50 words and more go; so do documents of which nothing but white space is left."""
    runs = fresh(docs, "runs")
    deduped = lines.dedup_lines(docs, name=runs)
    left = deduped.where(F.col(runs).isNull() | F.col("text").rlike(lines.WORD))
    changed = F.when(F.col(runs).isNotNull(), F.length("text").cast("long"))
    columns = [F.coalesce(changed, F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.select(*columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, then an exact pass: documents whose fingerprints link are connected, as are those whose five-word shingles reach a similarity of 0.8, which fingerprints lose on short texts. Of the documents that are connected, directly or over others, one stays."""
    mark = written()
    linked = durable(simhash.linked_texts(docs), "linked")
    release(spark, mark, keep=1)
    return neardup.keep_one(docs, neardup.similar_components(docs, words=5, similarity=0.8, linked=linked))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sources weighted by the square root of their size, as many characters out as in on average."""
    return mixing.mix_sources(docs, copy=fresh(docs, "copy"), key=fresh(docs, "key")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every piece's sequence and place."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's intermediate tables go as soon as its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        release(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
