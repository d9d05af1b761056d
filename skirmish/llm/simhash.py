"""SimHash near-duplicates (operator 6) by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``k`` bits share at least ``8 - k`` of their 8 positional bytes. With the
guaranteed minimum of four (``k = 4``), every pair shares all three bytes of at least one of the 20 position
triples of :func:`covering_triples`, so the index has a posting list for each value of each triple and not for each single byte; a list
for one byte would hold 1/256 of all fingerprints. Within a posting list the bytes that a pair shares are tallied, pairs below the
minimum are dropped and the rest is verified by its differing bits.

A list gives the edges of a spanning forest of its links, not all its links, so a group of n near copies costs n - 1 edges
a list. Lists longer than ``BLOCK`` are dealt into blocks, and every pair of blocks is a task's work of its own. Equal
fingerprints are one vertex throughout. Components are found by minimum labels with pointer jumping, on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import durable, join_spread, map_arrow, texts_of

WORDS, MAX_BITS, SEED = 4, 4, 42
BLOCK = 1024
_STEP = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the bits of the shingles' XXH64; a text without words has 0."""
    tokens = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _STEP], last[at : at + _STEP], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): a row for each row of ``docs``; a null text counts as empty."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = np.array([fingerprint(x, words) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], ["doc_id", "text_hash", "fp"])

        return each

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(rows, make, "doc_id long, text_hash long, fp long")


def covering_triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples such that any four of the positions contain one: of three groups, those within a group and those with two in a group and one in the next."""
    group = [p * 3 // positions for p in range(positions)]

    def taken(triple: tuple[int, ...]) -> bool:
        g = sorted(group[p] for p in triple)
        return g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2])

    return [t for t in combinations(range(positions), 3) if taken(t)]


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): a key is a triple's number and its three bytes."""

    def byte(p: int) -> F.Column:
        return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(255)

    keys = [F.lit(n).cast("long") * (1 << 24) + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c) for n, (a, b, c) in enumerate(covering_triples())]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def linked(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which pairs of an array are links: the positional bytes that a pair shares are tallied, pairs below the minimum drop out, and the rest is verified."""
    split = fps.view(np.uint8).reshape(-1, 8)
    shared = np.zeros((len(fps), len(fps)), np.uint8)
    for p in range(8):
        shared += split[:, None, p] == split[None, :, p]
    i, j = np.nonzero(np.triu(shared >= 8 - max_bits, 1))
    near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    links = np.eye(len(fps), dtype=bool)
    links[i[near], j[near]] = links[j[near], i[near]] = True
    return links


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Edges (member, smallest member) of the components within one posting list."""
    fps = np.unique(fps)
    links = linked(fps, max_bits)
    root = np.full(len(fps), -1)
    for k in range(len(fps)):
        if root[k] < 0:
            found = new = links[k] & (root < 0)
            while new.any():
                new = links[new].any(axis=0) & (root < 0) & ~found
                found = found | new
            root[found] = k
    at = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([fps[at], fps[root[at]]])


def edges(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): distinct edges that connect what the links connect. ``fps``: distinct fingerprints, column ``fp``, in a written table."""
    if max_bits > 4:
        raise ValueError("the index guarantees links of at most 4 bits")
    listed = durable(postings(fps), "postings")
    large = listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = join_spread(listed, large, ["key"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    lists = dealt.groupBy("key", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("fp").alias("fps"))
    whole = lists.where((F.col("blocks") == 1) & (F.size("fps") > 1)).select("fps")
    # A block goes to each pair of blocks that it is part of, and the pairs are dealt over all tasks, also those of one list.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    parts = lists.where("blocks > 1").select("key", "block", "fps", other)
    pairs = parts.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.flatten(F.collect_list("fps")).alias("fps")).select("fps")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column = batch.column("fps")
            values, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            found = np.concatenate([forest(values[a:b], max_bits) for a, b in zip(at[:-1], at[1:], strict=True)], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        return each

    return map_arrow(whole.unionByName(pairs), make, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node of each node's component, for every node that has an edge (``a``, ``b``)."""
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), name)
    while True:
        # A component's smallest node is the end of many edges and the label of many nodes.
        seen = join_spread(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        above = join_spread(labels, labels.select(F.col("node").alias("label"), F.col("label").alias("over")), ["label"])
        least = F.least("label", "least", "over")
        moved = durable(above.join(seen, "node").select("node", least.alias("label"), (least < F.col("label")).alias("moved")), name)
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): ``labels``, which has all nodes, after more ``links`` (a, b). Both are written tables.

    Only the labels that the links connect are searched, so a search is over what the ones before left apart.
    """
    own = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"}
    half = durable(join_spread(links, own["a"], ["a"]).select("label_a", "b"), "half")
    whole = join_spread(half, own["b"], ["b"]).where("label_a != label_b")
    found = durable(whole.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "found")
    if found.isEmpty():
        return labels
    over = components(found).select(F.col("node").alias("label"), F.col("label").alias("over"))
    return durable(join_spread(labels, over, ["label"], "left").select("node", F.coalesce("over", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (needs ``doc_id`` and ``text``).

    ``component_id`` is the smallest ``doc_id`` that links reach from the row; null if all ids there are null. Other columns aren't read, so none can clash.
    Repeated rows and texts without words have equal fingerprints and so are linked.
    """
    rows, rooted = _rooted(docs, words, max_bits)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = durable(join_spread(rooted, least, ["root"]).select("fp", "component_id"), "components")
    return join_spread(rows, ids, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of all rows and (fp, id, root) of the distinct fingerprints, ``root`` being one fingerprint of each component, as written tables."""
    rows = durable(fingerprints(docs, words), "fingerprints")
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    labels = components(edges(fps, max_bits))
    return rows, durable(fps.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("root")), "rooted")


def linked_texts(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(text_hash, root): each distinct text with its component, as :func:`near_duplicates` links them."""
    rows, rooted = _rooted(docs, words, max_bits)
    texts = durable(rows.groupBy("text_hash").agg(F.first("fp").alias("fp")), "texts")  # equal texts, equal fingerprints
    return join_spread(texts, rooted.select("fp", "root"), ["fp"]).select("text_hash", "root")
