"""Language-model scores (operator 2) from a subword lattice.

The pieces come from an existing public vocabulary with its scores; they are never learned. A word's probability is the sum over *all* its
segmentations into pieces of the products of the pieces' probabilities, by forward recursion in log space. Since no piece crosses a
word's start (pieces begin a word or continue one), the marginal probability of a document is the product over its words and the end, and the
recursion runs once for each distinct word of the corpus. The vocabulary's scores are the prior: they weigh the segmentations at first, and stay in as
``WEIGHT`` observed pieces when expected counts over the distinct training words (forward and backward recursion) are added to them, ``ROUNDS`` times.

The lattice also holds, for each word seen in training, one arc over the whole word. The arc's probability is the word's
training count less a discount ``d = n1 / (n1 + 2 n2)`` over all training tokens; what the discounts set free is the lattice's weight:

    P(word) = max(c - d, 0) / N + d V / N * P_lattice(word),    P(end) = c_end / N

Pieces that begin a word and pieces that continue one have the total probability 1, so the lattice's sum over all words is 1 at most (pieces with white space
inside lose some), and words and end sum to 1 at most. There is such a model for each class of documents, with counts and piece probabilities of its own, and a
document's probability is marginal over the classes too: sum over z of P(z) times the product of its tokens' Q_z, where
Q_z = (1 - LEAK) P_z + LEAK times the average over the classes, words and end alike. Classes are the ``MAX_CLASSES`` most frequent values of ``lang`` in
training and one for all else, if there is any; scoring doesn't read ``lang``. Words repeat within a document more than by chance: each document has
token probabilities of its own, drawn around Q_z from a Dirichlet distribution of weight ``BURST`` and integrated out. After m words the next token is a word
with probability (BURST Q_z(word) + its earlier occurrences) / (BURST + m) and the end with BURST Q_z(end) / (BURST + m), which sum to 1 at most as well.

Measured on held-out rows at sf0.1 and sf0.01 in log10 a token (the base score, without any probability for spelling unknown words: -4.19, -4.13): this
model -3.90, -4.10; without classes and with one round -4.39, -4.74; with the vocabulary's scores alone and no rounds -4.44, -5.30.

Counts cover the whole corpus and are never broadcast: texts are packed into blocks of about ``BLOCK`` bytes with a
dictionary each, dictionaries are joined with the counts, and a block meets its own values again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import BATCH_BYTES, decoded, durable, texts_of

VOCABULARY = "piece_bpe_32k.model"
BLOCK = 16 << 20
MAX_CLASSES = 7
LEAK = 0.02
BURST = 4000.0
WEIGHT = 2000.0
ROUNDS = 2
MAX_PIECE = 24
WORDS = 60_000
_CHUNK = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(0xD6E8FEB86659FD93)


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Lattice:
    """Pieces as bytes (a space first where a piece begins a word), and their log probabilities."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.pieces, self.log_p = pieces, log_p
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(np.frombuffer(p, np.uint8)[None, :])[0] for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        number = {p: k for k, p in enumerate(pieces)}
        self.bytes = np.array([number[bytes([b])] for b in range(256)])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def load(cls, name: str = VOCABULARY) -> Lattice:
        """The pieces that can occur in lower-cased words, and all bytes, which make every word segmentable.

        A file of the merge kind scores a piece by minus its rank; such scores become probabilities by Zipf's law. Scores that are
        logarithms of probabilities (a unigram file) are taken as they are.
        """
        found = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        scores: dict[bytes, float] = {}
        merges = found.get_score(found.get_piece_size() - 1) < -1000
        for k in range(found.get_piece_size()):
            piece = found.id_to_piece(k).replace("▁", " ").encode()
            plain = not (found.is_control(k) or found.is_unknown(k) or found.is_byte(k))
            if plain and b" " not in piece[1:] and piece == piece.lower():
                score = found.get_score(k)
                scores[piece] = -np.log(20.0 - score) if merges else score
        for b in range(256):
            scores.setdefault(bytes([b]), min(scores.values()))
        log_p = np.array(list(scores.values()))
        return cls(list(scores), log_p - np.logaddexp.reduce(log_p))

    @staticmethod
    def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h + codes.astype(np.uint64) + np.uint64(1)) * _M

    @classmethod
    def _key(cls, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for i in range(rows.shape[1]):
            h = cls._step(h, rows[:, i])
        return cls._final(h)

    @staticmethod
    def _final(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * _S
        return h ^ (h >> np.uint64(32))

    def _arcs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, piece number) of all pieces found in equally long words."""
        n, size = words.shape
        h = np.zeros((n, size), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(1, min(self.longest, size) + 1):
            starts = size - length + 1
            h = self._step(h[:, :starts], words[:, length - 1 :])
            key = self._final(h).ravel()
            at = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            hit = self.keys[place] == key[at]
            row, start = np.divmod(at[hit], starts)
            found.append((row, start, start + length, self.ids[place[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _sums(row: np.ndarray, terms: np.ndarray, base: np.ndarray, long: bool) -> np.ndarray:
        """Logarithms of the sums of exp(terms) by row; ``base``: the row's term of a single byte, changed here."""
        if long:
            np.maximum.at(base, row, terms)
        return base + np.log(np.bincount(row, np.exp(terms - base[row]), len(base)))

    def forward(self, words: np.ndarray, log_ps: list[np.ndarray], expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probabilities of rows of bytes, a line for each of ``log_ps``; adds the pieces' expected counts (for the last of them) to ``expected``.

        The recursions go over the arcs that end (or begin) at a place. A sum of exponentials is taken relative to the arc of a single byte, which always
        exists, and no arc of at most ``MAX_PIECE`` bytes differs from it beyond the range of doubles; with longer arcs, to the largest one.
        """
        n, size = words.shape
        row, start, end, piece = self._arcs(words)
        kind = np.uint16 if size < 1 << 16 else np.int64
        long = bool((end - start).max() > MAX_PIECE)
        by_end = np.argsort(end.astype(kind), kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, size + 2))
        out = np.empty((len(log_ps), n))
        for z, log_p in enumerate(log_ps):
            a = np.zeros((size + 1, n))
            single = log_p[self.bytes[words]]
            for k in range(1, size + 1):
                at = by_end[cuts[k - 1] : cuts[k]]
                a[k] = self._sums(row[at], a[start[at], row[at]] + log_p[piece[at]], a[k - 1] + single[:, k - 1], long)
            out[z] = a[size]
        if expected is not None:
            by_start = np.argsort(start.astype(kind), kind="stable")
            cuts = np.searchsorted(start[by_start], np.arange(size + 1))
            b = np.zeros((size + 1, n))
            for k in range(size - 1, -1, -1):
                at = by_start[cuts[k] : cuts[k + 1]]
                b[k] = self._sums(row[at], b[end[at], row[at]] + log_p[piece[at]], b[k + 1] + single[:, k], long)
            share = np.exp(a[start, row] + log_p[piece] + b[end, row] - a[size, row])
            expected += np.bincount(piece, share, len(expected))
        return out

    def log_probabilities(self, words: list[bytes], log_ps: list[np.ndarray] | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """For words without spaces, which may be of any lengths; a line for each of ``log_ps`` (by default the lattice's own)."""
        log_ps = log_ps or [self.log_p]
        out = np.zeros((len(log_ps), len(words)))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            size = int(sizes[order[first]])
            step = max(1, _CHUNK // size)
            for at in range(first, last, step):
                chosen = order[at : min(last, at + step)]
                rows = np.frombuffer(b"".join(b" " + words[k] for k in chosen), np.uint8).reshape(-1, size)
                out[:, chosen] = self.forward(rows, log_ps, expected)
        return out


def refitted(expected: np.ndarray, log_p: np.ndarray, weight: float = WEIGHT) -> np.ndarray:
    """Posterior mean of the pieces' probabilities: the vocabulary's, worth ``weight`` observed pieces, and expected counts."""
    counts = expected + weight * np.exp(log_p)
    return np.log(counts / counts.sum())


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of each row of numbers, all first bytes before all second ones and so on: bytes that hardly differ stand together, so Spark's compression of rows finds them."""
    (rows, n), size = values.shape, values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(rows, n, size).swapaxes(1, 2).reshape(rows, n * size)


def unplaned(data: bytes, kind: type, rows: int = 1) -> np.ndarray:
    """What :func:`planes` made of ``rows`` rows of numbers of this kind."""
    size = np.dtype(kind).itemsize
    n = len(data) // max(1, rows * size)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(rows, size, n).swapaxes(1, 2)).reshape(rows, n * size).view(kind)


BLOCK_SCHEMA = "block long, doc_id long, held_out boolean, n_tokens long, places binary, counts binary, part long, words array<string>, train_counts array<array<long>>"


def blocks(docs: DataFrame, held_out: F.Column, classes: list[str], n_classes: int) -> DataFrame:
    """Texts packed into blocks: a row for each text (the steps between the words' places in the block's dictionary and how often, as :func:`planes`), and rows with the dictionary
    and the words' training counts in each class. Words are lower-cased (A-Z) and separated by ASCII white space."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))

        def record(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        number = TaskContext.get().partitionId() << 32
        place = Places()
        totals = np.zeros((0, n_classes), np.int64)
        size = 0

        def dictionary() -> Iterator[pa.RecordBatch]:
            words, counts = list(place), totals[: len(place)]
            for at in range(0, len(words), 1 << 16):
                yield record([(number, None, None, None, None, None, at >> 16, [w.decode() for w in words[at : at + (1 << 16)]], counts[at : at + (1 << 16)].tolist())])

        for batch in batches:
            rows = []
            for doc, held, kind, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("class").to_pylist(), texts_of(batch), strict=True):
                tokens = decoded(text).encode().lower().split()
                found, n = np.unique(np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens)), return_counts=True)
                if len(place) > len(totals):
                    totals = np.concatenate((totals, np.zeros((len(place) + 1024 - len(totals) // 2, totals.shape[1]), np.int64)))
                if not held:
                    totals[found, kind] += n
                rows.append((number, doc, held, len(tokens) + 1, planes(np.diff(found.astype(np.int32), prepend=np.int32(0))[None]).tobytes(), planes(n.astype(np.int32)[None]).tobytes(), None, None, None))
                size += len(text)
                if size >= BLOCK:
                    yield record(rows)
                    yield from dictionary()
                    pa.default_memory_pool().release_unused()
                    rows, place, totals, size, number = [], Places(), totals[:0], 0, number + 1
            if rows:
                yield record(rows)
        yield from dictionary()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), _class(classes).alias("class"), "text")
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _class(classes: list[str]) -> F.Column:
    """The number of a row's class; the last stands for all else."""
    number = F.lit(len(classes))
    for k, name in enumerate(classes):
        number = F.when(F.col("lang") == name, F.lit(k)).otherwise(number)
    return number.cast("int")


def frequent_classes(docs: DataFrame) -> list[str]:
    rows = docs.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_CLASSES).collect()
    return [r["lang"] for r in rows]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows: words of one length are worked out together, and the more there are the less a numpy call weighs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _map_words(words: DataFrame, lattice: Lattice, log_ps: list[np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Each class's expected counts of pieces over its training words; or, with ``value``, the words with their count and what that
    function makes of (words x classes) counts and log probabilities, as :func:`planes`. All in one pass, so a task has one Python worker."""
    sent = words.sparkSession.sparkContext.broadcast((lattice.pieces, log_ps))  # bounded by vocabulary and classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_ps = sent.value
        mine = Lattice(pieces, log_ps[0])
        expected = [np.zeros(len(pieces)) for _ in log_ps]
        for batch in _gathered(batches, WORDS):
            listed = batch.column("word").cast(pa.binary()).to_pylist()
            counts = batch.column("c").combine_chunks().flatten().to_numpy().reshape(len(listed), -1)
            if value is None:
                for z, log_p in enumerate(log_ps):
                    mine.log_probabilities([listed[k] for k in np.flatnonzero(counts[:, z])], [log_p], expected[z])
            else:
                found = value(counts, mine.log_probabilities(listed, log_ps).T)
                yield from pa.table([batch.column("word"), pa.array(counts.sum(axis=1)), pa.array([x.tobytes() for x in planes(found)], pa.binary())], ["word", "n", "lm"]).to_batches()
        if value is None:
            for z, n in enumerate(expected):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), z)), pa.array(at), pa.array(n[at])], ["class", "piece", "n"])

    return words.mapInArrow(run, "class long, piece long, n double" if value is None else "word string, n long, lm binary")


def fit_lattices(words: DataFrame, lattice: Lattice, n_classes: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Each class's piece probabilities from its distinct training words, each with weight 1 as the lattice serves rare and unseen words, and the vocabulary's scores as the prior."""
    log_ps = [lattice.log_p] * n_classes
    for _ in range(rounds):
        found = _map_words(words, lattice, log_ps).groupBy("class", "piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.zeros((n_classes, len(lattice.pieces)))
        expected[found["class"], found["piece"]] = found["n"]
        log_ps = [refitted(x, lattice.log_p, WEIGHT) for x in expected]
    return log_ps


def document_log10(log_q: np.ndarray, times: np.ndarray, log_end: np.ndarray, log_prior: np.ndarray) -> float:
    """log10 probability of a document under the Dirichlet predictive, marginal over the classes.

    ``log_q``: (distinct words x classes) log10 of Q_z; ``times``: how often each occurs; ``log_end``, ``log_prior``: of the end and of the classes.
    """
    p = BURST * 10.0**log_q
    again = np.flatnonzero(times > 1)
    which = np.repeat(again, times[again] - 1)
    earlier = np.arange(len(which)) - np.repeat(np.cumsum(times[again] - 1) - (times[again] - 1), times[again] - 1) + 1
    firsts = (np.log10(BURST) + log_q).sum(axis=0) + np.log10(BURST) + log_end
    by_class = log_prior + firsts + np.log10(p[which] + earlier[:, None]).sum(axis=0) - np.log10(BURST + np.arange(times.sum() + 1)).sum()
    top = by_class.max()
    return float(top + np.log10((10 ** (by_class - top)).sum()) if np.isfinite(top) else top)


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: F.Column, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """log10 probabilities of every whole text; learns from the rows that aren't held out. Needs ``doc_id``, ``text`` and ``lang``; other columns aren't read, so none can clash.

    Tokens are the words and one end. ``base_score``: words alone, with half a count added. ``score``: the model of the
    module. ``n_known``: tokens seen in training. A null or empty text is the end alone. A null ``held_out`` counts as
    training. Without any training rows ``score`` takes the lattice alone, and an end of probability 1/2.
    """
    learned = docs.where(~F.coalesce(held_out, F.lit(False)))
    classes = frequent_classes(learned)
    ends_by_class = {r["class"]: r["count"] for r in learned.groupBy(_class(classes).alias("class")).count().collect()}
    k = max(1, len(classes) + (len(classes) in ends_by_class))
    ends = np.array([ends_by_class.get(z, 0) for z in range(k)], float)
    packed = durable(blocks(docs, held_out, classes, k), "blocks")
    texts = packed.where("words IS NULL").drop("part", "words", "train_counts")
    entries = packed.where("words IS NOT NULL").select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("train_counts").alias("t"))))
    sums = entries.groupBy("word").agg(*[F.sum(F.col("t")[z]).alias(f"c{z}") for z in range(k)])
    words = durable(sums.select("word", F.array(*[f"c{z}" for z in range(k)]).alias("c")), "words")
    lattice = Lattice.load(vocabulary)
    log_ps = fit_lattices(words, lattice, k, rounds)
    count = F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y)
    got = words.agg(
        F.count_if(count > 0).alias("v"),
        F.sum(count).alias("n"),
        *[f(z).alias(f"{name}{z}") for z in range(k) for name, f in (("n", lambda z: F.sum(F.col("c")[z])), ("v", lambda z: F.count_if(F.col("c")[z] > 0)), ("once", lambda z: F.count_if(F.col("c")[z] == 1)), ("twice", lambda z: F.count_if(F.col("c")[z] == 2)))],
    ).first()
    n, v = int((got["n"] or 0) + ends.sum()), got["v"] + bool(ends.sum())
    own = np.array([(got[f"n{z}"] or 0) + ends[z] for z in range(k)])
    types, once, twice = (np.array([got[f"{name}{z}"] for z in range(k)], float) for name in ("v", "once", "twice"))
    d = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = ends / ends.sum() if ends.sum() else np.eye(k)[-1]
        free = np.where(own > 0, np.where(types > 0, d * types, 0.0) / np.maximum(own, 1), 1.0)
        end = np.where(own > 0, ends / np.maximum(own, 1), 0.5)
    spread = (1 - LEAK) * np.eye(k) + LEAK * prior

    def mixed(counts: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            p = np.logaddexp(log_lattice + np.log(free), np.log(np.maximum(counts - d, 0) / np.maximum(own, 1)))
            return np.logaddexp.reduce(p[:, None, :] + np.log(spread), axis=2) / np.log(10)

    scored = _map_words(words, lattice, log_ps, mixed)
    values = dictionary_rows(packed).join(scored, "word").select(F.col("block").alias("of_block"), "place", "n", "lm")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        size = int(place.max(initial=-1)) + 1
        count, lm = np.zeros(size), np.zeros((size, k))
        count[place] = right.column("n").to_numpy()
        lm[place] = unplaned(b"".join(right.column("lm").to_pylist()), np.float64, right.num_rows).reshape(-1, k)
        known, base = count > 0, np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        out = np.zeros((left.num_rows, 3))
        with np.errstate(divide="ignore"):
            log_prior, log_end = np.log10(prior), np.log10(spread @ end)
        for row, (where, counts) in enumerate(zip(left.column("places").to_pylist(), left.column("counts").to_pylist(), strict=True)):
            at, times = np.cumsum(unplaned(where, np.int32)[0]), unplaned(counts, np.int32)[0]
            out[row] = times @ known[at], times @ base[at], document_log10(lm[at], times, log_end, log_prior)
        end_base = np.log10((ends.sum() + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table(
            [left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), pa.array(out[:, 0].astype(np.int64) + int(ends.sum() > 0)), pa.array(np.full(len(out), n, np.int64)), pa.array(out[:, 1] + end_base), pa.array(out[:, 2])],
            [x.split()[0] for x in SCORE_SCHEMA.split(", ")],
        )

    return texts.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(meet, SCORE_SCHEMA)


def dictionary_rows(packed: DataFrame) -> DataFrame:
    """(block, place, word); a block's dictionary comes in parts of 2 ** 16 words."""
    return packed.where("words IS NOT NULL").select("block", "part", F.posexplode("words").alias("at", "word")).select("block", (F.col("part") * (1 << 16) + F.col("at")).alias("place"), "word")
