"""Language identification (operator 1) with language-bitmask n-gram filters.

The filter is a Bloom filter in which every slot holds a bit for each language (bit-sliced), so one look-up of an n-gram's
``hashes`` slots, joined with AND, returns all the languages that contain it. For a text, the bits of all its n-grams are counted for each language.
A language whose slots are filled to a share ``f`` answers for a gram that it doesn't contain with probability ``p = f ** hashes``, so a
count ``c`` of ``n`` grams is corrected to ``(c - n p) / (1 - p)``; the largest corrected count decides.

A language contains a gram if the gram has at least a share ``min_share`` of the language's grams of the same order (and at least
``contrast`` times its largest share in any language; 0, the default, asks nothing of the kind). The counts behind it cover all training rows.
No language can have more than ``1 / min_share`` grams of an order, which bounds what reaches the driver and the executors:
languages x orders / min_share grams, and slots of a bit a language. Any number of languages works; each 64 take a further word in a slot.

Grams are characters, lower-cased, within words and the spaces beside them; any character but an ASCII one that isn't a letter can be in a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import grams
from skirmish.llm.common import decoded, durable, map_arrow, texts_of

ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_SEPARATORS = grams.Separators(grams.NO_LETTER)
_SPACED = bytes(grams.SPACE if chr(b) in grams.NO_LETTER else b for b in range(256))
_FLUSH = 200_000


@dataclass(frozen=True)
class LanguageFilter:
    """``slots``: for each order, (slots x words of 64 bits), a bit a language; ``false_rate``: for each order and language, the chance of a wrong yes."""

    languages: list[str]
    shares: np.ndarray
    slots: dict[int, np.ndarray]
    false_rate: dict[int, np.ndarray]
    hashes: int

    def look_up(self, order: int, hashed: np.ndarray) -> np.ndarray:
        """(grams x words): the languages' bits of each gram."""
        table = self.slots[order]
        found = table[_slot(hashed, 0, len(table))]
        for k in range(1, self.hashes):
            found &= table[_slot(hashed, k, len(table))]
        return found


def _slot(hashed: np.ndarray, k: int, n: int) -> np.ndarray:
    return ((hashed >> np.uint64(20 * k)) & np.uint64(n - 1)).astype(np.int64)


def bit(masks: np.ndarray, language: int) -> np.ndarray:
    """0 or 1 for each row of masks."""
    return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram_order, gram, n) over all rows with a language. Words are counted first, so a gram is hashed once for each distinct word of a task."""

    def make():
        def hashed(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
            for name, words in counts.items():
                listed, weights = [w.decode() for w in words], np.fromiter(words.values(), np.int64, len(words))
                found: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
                for codes, starts, owners in grams.pieces(listed, _SEPARATORS):
                    for order, at, h in grams.grams(codes, ORDERS):
                        owner = owners[np.searchsorted(starts, at, side="right") - 1]
                        found[order].append(np.stack([h, weights[owner].astype(np.uint64)]))
                for order, parts in found.items():
                    if parts:
                        h, w = np.concatenate(parts, axis=1)
                        keys, place = np.unique(h, return_inverse=True)
                        n = np.bincount(place, weights=w.astype(np.float64)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram_order", "gram", "n"])

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts: dict[str, Counter] = {}
            for raw, name in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(decoded(raw).lower().encode().translate(_SPACED).split(b" "))
                if len(counts[name]) > _FLUSH:
                    yield from hashed({name: counts.pop(name)})
            yield from hashed(counts)

        return each

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return map_arrow(rows, make, "lang string, gram_order int, gram long, n long").groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, min_share: float = 2e-5, contrast: float = 0.0, hashes: int = 3, fill: float = 0.2) -> LanguageFilter:
    """Learn from ``text`` and ``lang`` of all rows whose language isn't null. The counts are written out, so the texts are read once."""
    counts = durable(gram_counts(docs), "grams")
    sums = counts.groupBy("lang", "gram_order").agg(F.sum("n").alias("total"))
    seen = sums.collect()
    languages = sorted({r["lang"] for r in seen})
    if not languages:
        return LanguageFilter([], np.zeros(0), {}, {}, hashes)
    number = {name: i for i, name in enumerate(languages)}
    # Languages x orders rows, as the driver has just held them.
    totals = docs.sparkSession.createDataFrame([(r["lang"], r["gram_order"], number[r["lang"]], r["total"]) for r in seen], "lang string, gram_order int, number int, total long")
    shares = counts.where(F.col("n") > 0).join(F.broadcast(totals), ["lang", "gram_order"]).select("gram_order", "gram", "number", (F.col("n") / F.col("total")).alias("share"))
    if contrast > 0:
        most = shares.groupBy("gram_order", "gram").agg(F.max("share").alias("most"))
        shares = shares.join(most, ["gram_order", "gram"]).where(F.col("share") >= contrast * F.col("most"))
    learned = shares.where(F.col("share") >= min_share).select("gram_order", "gram", "number").toPandas()
    slots, rates = {}, {}
    for order in ORDERS:
        rows = learned[learned["gram_order"] == order]
        hashed, language = rows["gram"].to_numpy().view(np.uint64), rows["number"].to_numpy()
        # A language's bits are its own, so the language with the most grams sets the size.
        most = int(np.bincount(language, minlength=1).max())
        n = 1 << min(20, max(10, int(np.ceil(np.log2(max(1, most) * hashes / fill)))))
        slots[order] = np.zeros((n, -(-len(languages) // 64)), np.uint64)
        for k in range(hashes):
            np.bitwise_or.at(slots[order], (_slot(hashed, k, n), language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        filled = np.array([bit(slots[order], i).mean() for i in range(len(languages))])
        rates[order] = np.minimum(filled**hashes, 0.99)
    per = np.zeros(len(languages))
    for r in seen:
        per[number[r["lang"]]] += r["total"]
    return LanguageFilter(languages, per / per.sum(), slots, rates, hashes)


SCHEMA = "doc_id long, lang_pred string, score double, n_grams long"


def corrected_counts(model: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) corrected counts over all orders, and the number of grams of each text."""
    out = np.zeros((len(texts), len(model.languages)))
    totals = np.zeros(len(texts))
    for codes, starts, owners in grams.pieces(texts, _SEPARATORS):
        for order, at, hashed in grams.grams(codes, tuple(model.slots)):
            masks = model.look_up(order, hashed)
            edges = np.searchsorted(at, starts)
            n = np.diff(np.append(edges, len(at)))
            totals += np.bincount(owners, weights=n, minlength=len(texts))
            for i in range(len(model.languages)):
                has = np.concatenate(([0], np.cumsum(bit(masks, i), dtype=np.int64)))
                count = has[np.append(edges[1:], len(at))] - has[edges]
                p = model.false_rate[order][i]
                out[:, i] += np.bincount(owners, weights=(count - n * p) / (1 - p), minlength=len(texts))
    return np.maximum(out, 0.0), totals


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``lang_pred`` and ``score``, the predicted language's part of all corrected counts, for every whole text.

    ``und`` and 0 if the text is null or has no letter, or if nothing was learned. Equal counts: the language with more training text,
    then the first by name. A text of which no gram is known gets that language too, with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see the module

    def make():
        model = sent.value
        rank = np.argsort(np.argsort(-model.shares, kind="stable"), kind="stable") if model.languages else None

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [decoded(x).lower() for x in texts_of(batch)]
            names, scores, n = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if model.languages:
                counts, n = corrected_counts(model, texts)
                best = np.lexsort((np.broadcast_to(rank, counts.shape), -counts), axis=1)[:, 0]
                total = counts.sum(axis=1)
                for k, text in enumerate(texts):
                    if any(map(str.isalpha, text)):
                        names[k] = model.languages[best[k]]
                        scores[k] = counts[k, best[k]] / total[k] if total[k] > 0 else 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(np.clip(scores, 0, 1)), pa.array(n.astype(np.int64))], ["doc_id", "lang_pred", "score", "n_grams"])

        return each

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)
