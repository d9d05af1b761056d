"""Quality classifier (operator 3): supervised subword embeddings.

A document is the average of the learned vectors of its features, hashed into ``buckets``: its words, pairs of neighbouring
words, the pair of equal words as such, and character n-grams within words. A softmax layer over the classes follows. Vectors and layer are trained together by stochastic
gradient descent in numpy.

Training takes a bounded sample: of each class, the ``per_class`` labelled ids with the smallest hashes, with whole texts and all their
features, in one task: at most ``2 * per_class`` rows of at most ``buckets`` features of 8 bytes at any size of the corpus. The driver gets the scores of the buckets only.
An id that several rows have counts once, with the row whose features come first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm import grams
from skirmish.llm.common import decoded, map_arrow, texts_of

ORDERS = (2, 3, 4)
BUCKETS = 1 << 17
_SEPARATORS = grams.Separators(grams.WHITE)
#: The word pair "any word, the same word": junk repeats words that training never saw. Without it 42 of 195 held-out bad texts pass at sf0.1.
_TWICE = np.uint64(0x5EED)


@dataclass(frozen=True)
class QualityModel:
    """``scores``: of each bucket, its vector's share in the log-odds of class 1. ``prior``: the log-odds without any contrast to learn from."""

    scores: np.ndarray
    prior: float = 0.0


def features(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all features, in parts of bounded size."""
    last_text, last_word = -1, np.zeros(1, np.uint64)  # a pair may stand across two parts of a long text
    for codes, starts, owners in grams.pieces(texts, _SEPARATORS):

        def owner(at: np.ndarray, starts: np.ndarray = starts, owners: np.ndarray = owners) -> np.ndarray:
            return owners[np.searchsorted(starts, at, side="right") - 1]

        at, h = grams.words(codes)
        if len(at):
            mine = owner(at)
            yield mine, _bucket(h, buckets)
            all_texts, all_words = np.append(last_text, mine), np.append(last_word, h)
            same = all_texts[1:] == all_texts[:-1]
            yield mine[same], _bucket(grams.mix(all_words[1:] * np.uint64(31) + all_words[:-1])[same], buckets)
            twice = same & (all_words[1:] == all_words[:-1])
            yield mine[twice], _bucket(np.full(int(twice.sum()), _TWICE), buckets)
            last_text, last_word = mine[-1], h[-1:]
        for _, at, h in grams.grams(codes, ORDERS):
            yield owner(at), _bucket(h, buckets)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, label): of each class, the rows with the smallest hashes. Ids that are labelled with both classes are left out."""
    classes = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    chosen = classes.select("doc_id", "y", order.alias("o"))
    # A sort with a limit keeps per_class rows in each task, and none gathers a class.
    both = [chosen.where(F.col("y") == k).orderBy("o", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = both[0].unionByName(both[1]).select("doc_id", "y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def sample_features(sample: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, y, ids, shares): each sampled id's features (buckets) with their shares, as packed arrays; a row an id."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, shares = [], []
            for text in map(decoded, texts_of(batch)):
                found = [b for _, b in features([text], buckets)]
                keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                ids.append(keys.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "y", "ids", "shares"])

        return each

    rows = map_arrow(sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text"), make, "doc_id long, y int, ids binary, shares binary")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct("ids", "shares")).alias("f")).select("doc_id", "y", "f.*")


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 3) -> QualityModel:
    """SGD over (class, feature buckets, shares). Classes have equal weight in the loss, and there is no bias: a text of which nothing is known is at 1/2."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    n = np.bincount([y for y, _, _ in rows], minlength=2)
    if not n.all():
        # One class or none: no contrast to learn from.
        return QualityModel(np.zeros(buckets, np.float32), 0.0 if not n.any() else (4.0 if n[1] else -4.0))
    weight = n.sum() / (2.0 * n)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            hidden = share @ vectors[ids]
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            p *= weight[y]
            pull = layer @ p
            layer -= 0.1 * lr * np.outer(hidden, p)
            vectors[ids] -= lr * len(ids) ** 0.5 * share[:, None] * pull
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, buckets: int = BUCKETS) -> QualityModel:
    """Learn from ``text`` of ``docs`` and ``label`` of ``labels``, joined by ``doc_id``."""
    found = fitted(sample_features(training_sample(docs, labels, label, per_class), buckets), buckets).first()
    return train([], buckets) if found is None else QualityModel(np.frombuffer(found["scores"], np.float32), found["prior"])


def fitted(sample: DataFrame, buckets: int) -> DataFrame:
    """(scores, prior): the model of a sample's features, which are bounded, trained in one task in the order of ids; no row for no sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, ids, shares in zip(*[batch.column(c).to_pylist() for c in ("y", "ids", "shares")], strict=True):
                rows.append((y, np.frombuffer(ids, np.int32), np.frombuffer(shares, np.float32)))
        if rows:
            model = train(rows, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()]), pa.array([model.prior], pa.float64())], ["scores", "prior"])

    return sample.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(run, "scores binary, prior double")


def log_odds(model: QualityModel, texts: list[str]) -> np.ndarray:
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, bucket in features(texts, len(model.scores)):
        sums += np.bincount(owner, weights=model.scores[bucket], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return sums / np.maximum(n, 1) + model.prior


def score(docs: DataFrame, model: QualityModel, name: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` (1 if the score is at least 0.5, else 0).

    Every whole text is scored in one pass without a shuffle. A null or empty text has no features, so its
    score is 1/2. Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x 4 bytes
    kept = [c for c in docs.columns if c.lower() not in (name, predicted)]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def make():
        model = sent.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            p = 1 / (1 + np.exp(-np.clip(log_odds(model, list(map(decoded, texts_of(batch)))), -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, name, predicted])

        return each

    return map_arrow(docs.select(*kept), make, schema)
