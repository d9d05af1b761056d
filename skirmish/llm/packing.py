"""Best-fit packing (operator 8) by a grouping genetic algorithm on islands.

Documents become token ids and an end id. Longer ones are cut into pieces of ``capacity`` tokens, of which the first may be shorter. Full pieces
are sequences by themselves. The rest is dealt by hash into shards of about ``SHARD`` pieces, each a bin packing problem of bounded size:

* a solution's genes are its bins; the fewer bins the fitter, and of as many bins, the larger the mean squared fill;
* crossover puts whole bins of one parent, best filled ones, into the other, drops the other's bins that hold a piece twice by now, and
  places what these held besides by best fit, longest first;
* mutation empties the worst filled bins and some others, and places their pieces so too;
* each shard has ``ISLANDS`` populations that evolve in tasks of their own; after each epoch every island's best solution moves to the next one
  in a ring (a join) and replaces the worst there. An island stops once it reaches the lower bound of its shard.

Badly filled bins of all shards are pooled and packed once more, so a shard's last bin isn't lost space. Everything is
seeded by shard and island, so a run can be repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import BATCH_BYTES, decoded, durable, texts_of
from skirmish.llm.tokens import VOCABULARY, Encoder

CAPACITY, END = 1024, 2
SHARD, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, OFFSPRING = 4, 8

PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece. ``row`` differs for all rows of ``docs``, so rows that repeat a document stay apart, and ``row + piece`` for all pieces; ``ids`` is null unless asked for.

    A null or empty text is the end id alone. The numbering holds within one evaluation: write the result before reading it twice.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        row = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        kinds = (*[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int32()))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.append(encoder.ids(decoded(text)), end).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                at = k = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    cut = ids[at:stop]
                    out.append((row, doc, k, at, len(cut), zlib.crc32(cut.tobytes()), cut.astype(np.int32).tolist() if with_ids else None))
                    at = stop
                row += k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


class Bins:
    """Bins under construction: a bit mask of the room left finds the best fit."""

    def __init__(self, capacity: int, bins: list[list[int]], lengths: list[int]) -> None:
        self.lengths, self.bins = lengths, bins
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.capacity = capacity
        for k, held in enumerate(bins):
            self._offer(k, capacity - sum(lengths[i] for i in held))

    def _offer(self, k: int, room: int) -> None:
        if room:
            self.room[room].append(k)
            self.mask |= 1 << room

    def place(self, items: list[int]) -> list[list[int]]:
        """Best fit, longest first; ties in the order given."""
        lengths, room = self.lengths, self.room
        for i in sorted(items, key=lambda i: -lengths[i]):
            fits = self.mask >> lengths[i]
            if fits:
                left = lengths[i] + (fits & -fits).bit_length() - 1
                k = room[left].pop()
                if not room[left]:
                    self.mask ^= 1 << left
                self.bins[k].append(i)
                self._offer(k, left - lengths[i])
            else:
                self.bins.append([i])
                self._offer(len(self.bins) - 1, self.capacity - lengths[i])
        return self.bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: the total, and the pieces of which no two fit together."""
    return max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole bins of ``b``, a random part of its best filled ones, go into ``a``."""
    ranked = sorted(b, key=lambda held: -sum(lengths[i] for i in held))
    best = ranked[: max(1, len(ranked) // 2)]
    injected = [best[k] for k in np.flatnonzero(rng.random(len(best)) < rng.uniform(0.1, 0.6))] or best[:1]
    taken = {i for held in injected for i in held}
    kept = [held for held in a if taken.isdisjoint(held)]
    displaced = [i for held in a if not taken.isdisjoint(held) for i in held if i not in taken]
    return Bins(capacity, [list(held) for held in (*injected, *kept)], lengths).place(displaced)


def mutate(a: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    order = np.argsort([sum(lengths[i] for i in held) for held in a], kind="stable")
    n = max(1, len(a) // 50)
    gone = {*order[:n].tolist(), *rng.integers(0, len(a), n).tolist()}
    kept = [list(held) for k, held in enumerate(a) if k not in gone]
    return Bins(capacity, kept, lengths).place([i for k in sorted(gone) for i in a[k]])


def first_population(lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """Best fit, longest first; and, for variety, best fit after some random pieces have bins of their own."""
    items = list(range(len(lengths)))
    out = [Bins(capacity, [], lengths).place(items)]
    while len(out) < POPULATION:
        early = set(rng.choice(len(items), max(1, len(items) // 8), replace=False).tolist())
        out.append(Bins(capacity, Bins(capacity, [], lengths).place(sorted(early)), lengths).place([i for i in items if i not in early]))
    return out


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, rng: np.random.Generator, offspring: int = OFFSPRING) -> list[list[list[int]]]:
    """An epoch: each offspring of two parents replaces the worst of the population if it is better. The best comes first."""
    least = lower_bound(lengths, capacity)
    ranked = sorted(((fitness(s, lengths, capacity), k, s) for k, s in enumerate(population)), reverse=True)
    for k in range(offspring):
        if -ranked[0][0][0] <= least:
            break
        x, y = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        child = mutate(crossover(ranked[x][2], ranked[y][2], lengths, capacity, rng), lengths, capacity, rng)
        value = fitness(child, lengths, capacity)
        if value > ranked[-1][0]:
            ranked[-1] = (value, len(population) + k, child)
            ranked.sort(reverse=True)
    return [s for _, _, s in ranked]


STATE = "shard long, island int, items array<long>, lengths array<int>, solutions array<array<int>>, n_bins int, spread double"


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, held in enumerate(bins):
        for i in held:
            out[i] = k
    return out


def _bins(labels: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return out


def _epoch(state: DataFrame, capacity: int, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rng = np.random.default_rng([x["shard"], x["island"], number])
                lengths = x["lengths"]
                population = [_bins(s) for s in x["solutions"]] if x["solutions"] else first_population(lengths, capacity, rng)
                population = evolve(population, lengths, capacity, rng)
                value = fitness(population[0], lengths, capacity)
                x |= {"solutions": [_labels(s, len(lengths)) for s in population], "n_bins": -value[0], "spread": value[1]}
                yield pa.RecordBatch.from_pylist([x], batch.schema)

    return state.mapInArrow(run, STATE)


def _packed_shards(items: DataFrame, n_items: int, capacity: int) -> DataFrame:
    """(item, shard, bin, length) of the best solution of each shard."""
    spark = items.sparkSession
    shards = max(1, -(-n_items // SHARD))
    held = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards))).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("both"))
    state = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("both.item").alias("items"), F.col("both.length").alias("lengths"), F.lit(None).cast("array<array<int>>").alias("solutions"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("spread"))
    spread = max(1, min(shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism))
    for number in range(EPOCHS):
        state = durable(_epoch(state.repartition(spread, "shard", "island"), capacity, number), "islands")
        if number + 1 < EPOCHS:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("solutions", F.lit(0)).alias("elite"))
            moved = state.join(elite, ["shard", "island"])
            state = moved.select("shard", "island", "items", "lengths", F.concat(F.slice("solutions", 1, POPULATION - 1), F.array("elite")).alias("solutions"), "n_bins", "spread")
    order = F.struct(-F.col("n_bins"), F.col("spread"), -F.col("island"))
    best = state.groupBy("shard").agg(F.max_by(F.struct("items", "lengths", F.get("solutions", F.lit(0)).alias("bins")), order).alias("s"))
    return best.select("shard", F.inline(F.arrays_zip(F.col("s.items").alias("item"), F.col("s.lengths").alias("length"), F.col("s.bins").alias("bin"))))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence, offset): pieces (``item``, distinct, and ``length`` from 1 to ``capacity``) in as few sequences as the algorithm finds."""
    n = items.count()
    packed = durable(_packed_shards(items, n, capacity), "packed")
    fills = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    poor = packed.join(fills.where(F.col("fill") < 0.97 * capacity), ["shard", "bin"], "left_semi").select("item", "length")
    m = poor.count()
    good = packed
    if 0 < m < n:
        again = durable(_packed_shards(poor, m, capacity), "packed")
        # Numbers of the second packing stay apart from those of the first.
        good = packed.join(poor, "item", "left_anti").unionByName(again.withColumn("shard", F.col("shard") + (1 << 24)))
    sequence = F.col("shard") * (1 << 20) + F.col("bin")
    numbered = good.select("item", "length", sequence.alias("sequence"))
    whole = numbered.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("held"))
    before = F.transform("held", lambda x, i: F.struct(x["item"].alias("item"), F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda n, y: n + y["length"]).alias("offset")))
    return whole.select("sequence", F.inline(before))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece of every document (needs ``doc_id`` and ``text``) with its sequence and its place there.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, row`` and, if asked for, ``ids``. Repeated rows are documents of their
    own, told apart by ``row``; an empty table gives an empty result.
    """
    cut = durable(pieces(docs, capacity, vocabulary, end, with_ids), "pieces")
    # Only the first piece of a document can be short, so its row's number names it.
    short = cut.where(F.col("length") < capacity).select(F.col("row").alias("item"), F.col("length").cast("int").alias("length"))
    placed = pack(short, capacity)
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - (F.col("row") + F.col("piece")), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity).join(placed, cut["row"] == placed["item"]).withColumn("sequence_id", F.col("sequence"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row", *(["ids"] if with_ids else [])]
    return full.select(*names).unionByName(rest.select(*names))
