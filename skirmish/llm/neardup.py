"""Near duplicates by the Jaccard similarity of word shingles, exactly (the near-duplicate stage of the pipeline).

Fingerprints lose links between short texts, so the inverted index here is over the shingles themselves. A node is a distinct set of shingles. All sets are read in
one global order, frequent shingles last. A pair whose similarity reaches ``s`` shares one of the first ``n - ceil(s n) + 1`` shingles of both sets, so only these
are indexed, each with its position. From the first shingle that a pair shares on, the positions bound what it can share in all; a pair that can't reach the guaranteed
minimum, ``s / (1 + s)`` of both sizes, isn't taken from that list. Of the pairs that are left a sketch counts what they can have in common at most: shingles are tallied by
``CELLS`` cells of their hashes, and two sets share no more than the smaller of both tallies in each. The sets themselves decide at last. No pair is lost, at any length.

The order is the hash's but for at most ``FREQUENT`` shingles that turn up ``OFTEN`` times and more within a batch of texts; these come last, by their sums. It doesn't matter to the
result which they are, but keeps passages that many texts share out of the index of texts that have anything else.

Lists are joined in steps. First each list's nodes meet its smallest one; of a node's such pairs the one with most lists in common is verified, which joins groups of copies at
a pair a node; the other such pairs follow where their components still differ. Then all pairs within a list whose components differ are compared: first one for each node and component, then the rest. Lists are dealt into parts of
``PART``, and every pair of parts, but those within the list's largest component, is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import broadcast_if_small, durable, fresh, join_spread, map_arrow, texts_of
from skirmish.llm.simhash import components, merged

SEED = 42
FREQUENT, OFTEN = 1 << 17, 3
PART = 1024
CELLS = 256


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of a text's shingles, as sorted distinct XXH64; empty for a text without words."""
    tokens = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def node_of(h: np.ndarray) -> int:
    """A set's number, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """A set's tallies by cell, as bytes; a tally that doesn't fit counts as 255, which :func:`alike_at_most` reads as any number."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def brief(sketches: np.ndarray) -> np.ndarray:
    """Sketches of a quarter of the cells, for the lists, of those in the rows."""
    return np.minimum(sketches.reshape(len(sketches), -1, 4).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


def alike_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the sets of two arrays of sketches (a row each) have in common at most."""
    least = np.minimum(x, y)
    return np.where((least == 255).any(axis=1), np.inf, least.sum(axis=1, dtype=np.int64))


def prefix(h: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the global order, as many as a similar set must share one of. ``frequent``: sorted; ``ranks``: their places among themselves."""
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = frequent[at] == h
        h = np.concatenate([h[~often], h[often][np.argsort(ranks[at[often]])]])
    return h[:n]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, node, n, sketch, shingle, times): a row for each document, without the last two, and rows of shingles that are frequent within a batch, with the last two alone."""
    names = ["doc_id", "text_hash", "node", "n", "sketch", "shingle", "times"]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [shingles(x, words) for x in texts_of(batch)]
            nodes = [node_of(h) for h in sets]
            found, times = np.unique(np.concatenate(list(dict(zip(nodes, sets, strict=True)).values())), return_counts=True)
            found, times = found[times >= OFTEN].view(np.int64), times[times >= OFTEN]
            empty = [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(len(found), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([sketch(h) for h in sets], pa.binary()), empty[0], empty[0]], names)
            yield pa.RecordBatch.from_arrays([*[empty[1]] * 4, pa.nulls(len(found), pa.binary()), pa.array(found), pa.array(times)], names)

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(rows, make, ", ".join(f"{n} {'binary' if n == 'sketch' else 'long'}" for n in names))


def postings(docs: DataFrame, words: int, similarity: float, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(key, node, n, pos): the index; ``frequent`` and ``ranks`` as of :func:`prefix`."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, ranks))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seen, keys, nodes, sizes, places = set(), [], [], [], []
            for text in texts_of(batch):
                h = shingles(text, words)
                node = node_of(h)
                if node not in seen:
                    seen.add(node)
                    first = prefix(h, *shared.value, similarity)
                    keys.append(first)
                    nodes.append(np.full(len(first), node))
                    sizes.append(np.full(len(first), len(h), np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], nodes, sizes, places)], ["key", "node", "n", "pos"])

        return each

    return map_arrow(docs.select("text"), make, "key long, node long, n int, pos int")


def lists(posted: DataFrame) -> DataFrame:
    """(key, node, n, pos, head): the entries of lists of two nodes and more, ``head`` being the smallest node. ``posted``: a written table."""
    heads = posted.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head")
    # Copies of a set in several batches are one entry.
    return join_spread(posted, durable(heads, "heads"), ["key"]).dropDuplicates(["key", "node"])


def can_be(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sizes and sketches (``nodes``: node, n, sketch) let them be similar. Both are written tables."""
    own = {c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"}
    with_a, names = durable(join_spread(pairs, own["a"], ["a"]), "sketched"), pairs.columns

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{c}").to_pylist()), np.uint8).reshape(-1, CELLS) for c in "ab")
            n, m = (batch.column(f"n_{c}").to_numpy() for c in "ab")
            least = similarity / (1 + similarity) * (n + m) - 1e-9
            passed = pa.array((np.minimum(n, m) >= least) & (alike_at_most(x, y) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(passed) for c in names], names)

        return each

    return map_arrow(join_spread(with_a, own["b"], ["b"]), make, pairs.schema)


def differing(listed: DataFrame, labels: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, label_a, label_b): all pairs of nodes within a list that can be similar and have different labels, each once. All are written tables."""

    def make_brief():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            short = brief(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, CELLS))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in short], pa.binary())], ["node", "brief"])

        return each

    briefs = map_arrow(nodes.select("node", "sketch"), make_brief, "node long, brief binary")
    known = durable(labels.join(briefs, "node"), "briefs")
    named = durable(join_spread(listed.select("key", "node", "n", "pos"), known, ["node"]), "named")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"))
    largest = F.struct("size", "label")
    mains = sizes.groupBy("key").agg(F.max(largest).alias("main"), F.sum("size").alias("size")).where(F.col("size") > F.col("main.size"))
    parts = {"n0": F.col("main.size"), "n1": F.col("size") - F.col("main.size")}
    mains = durable(mains.select("key", F.col("main.label").alias("main"), "size", *[F.ceil(n / PART).cast("int").alias(c) for c, n in parts.items()]), "mains")
    dealt = join_spread(named, mains, ["key"], n="size").withColumn("first", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    part, mine, others = F.col("part"), F.sequence(F.lit(0), F.col("n0") - 1), F.sequence(F.lit(0), F.col("n1") - 1)
    # A part of the largest component meets all parts of the others; these meet all of that one's, and one another.
    across = F.when(F.col("first"), F.transform(others, lambda y: F.struct(F.lit(True).alias("across"), part.alias("x"), y.alias("y")))).otherwise(F.transform(mine, lambda x: F.struct(F.lit(True).alias("across"), x.alias("x"), part.alias("y"))))
    within = F.when(F.col("first"), F.array().cast("array<struct<across:boolean,x:int,y:int>>")).otherwise(F.transform(others, lambda o: F.struct(F.lit(False).alias("across"), F.least(part, o).alias("x"), F.greatest(part, o).alias("y"))))
    going = dealt.select("key", F.struct("node", "label", "n", "pos", "first", "part", "brief").alias("member"), F.inline(F.concat(across, within)))
    met = going.groupBy("key", "across", "x", "y").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1).select("across", "x", "y", "members")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            whole, at = batch.column("members").flatten(), batch.column("members").offsets.to_numpy() - batch.column("members").offsets[0].as_py()
            node, label, n, pos, first, part = (whole.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "pos", "first", "part"))
            short = np.frombuffer(b"".join(whole.field("brief").to_pylist()), np.uint8).reshape(len(node), -1)
            out = [np.zeros((4, 0), np.int64)]
            for row, (across, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("across", "x", "y")), strict=True)):
                span = np.arange(at[row], at[row + 1])
                one, two = (span[first[span]], span[~first[span]]) if across else (span[part[span] == x], span[part[span] == y])
                for some in np.array_split(one, max(1, len(one) // 256)):
                    most = np.minimum((n[some] - pos[some])[:, None], (n[two] - pos[two])[None, :])
                    good = (label[some][:, None] != label[two][None, :]) & (most >= similarity / (1 + similarity) * (n[some][:, None] + n[two][None, :]) - 1e-9)
                    i, j = np.nonzero(good)
                    a, b = some[i], two[j]
                    common = np.concatenate([np.zeros(0), *(alike_at_most(short[a[k : k + 16384]], short[b[k : k + 16384]]) for k in range(0, len(a), 16384))])
                    near = common >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9
                    a, b = a[near], b[near]
                    swap = node[a] > node[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    out.append(np.stack([node[a], node[b], label[a], label[b]]))
            pairs = np.concatenate(out, axis=1)
            pairs = pairs[:, np.lexsort(pairs[:2])]
            new = np.append(True, (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0))[: pairs.shape[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in pairs], ["a", "b", "label_a", "label_b"])

        return each

    return map_arrow(met, make, "a long, b long, label_a long, label_b long").dropDuplicates(["a", "b"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (``sets``: node, hashes) have at least this Jaccard similarity. Both are written tables."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            passed = []
            for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(passed, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        return each

    with_a = durable(join_spread(pairs.select("a", "b"), sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), ["a"]), "half-pairs")
    with_b = join_spread(with_a, sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), ["b"])
    return map_arrow(with_b, make, "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the sets of the nodes in ``pairs``, from the text of one document each, as a written table."""
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "key.*"), "wanted")
    few = broadcast_if_small(wanted, F.lit(48))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(x, words).tobytes() for x in texts_of(batch)], pa.binary())], ["node", "hashes"])

        return each

    texts = docs.select(_key(F.xxhash64("text")).alias("key"), "text").select("key.*", "text").join(few, ["no_id", "id", "text_hash"])
    return durable(map_arrow(texts.select("node", "text").dropDuplicates(["node"]), make, "node long, hashes binary"), "hashes")


def _apart(pairs: DataFrame, done: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in ``done`` and have different labels, as a written table."""
    own = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"now_{c}")) for c in "ab"}
    half = durable(join_spread(pairs.select("a", "b"), own["a"], ["a"]), "half")
    rest = durable(join_spread(half, own["b"], ["b"]).where("now_a != now_b").select("a", "b"), "half")
    return durable(rest.join(done, ["a", "b"], "left_anti"), "rest")


def _key(text_hash: F.Column) -> F.Column:
    """What tells rows apart, in the order in which they are kept: no id, id, text hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash.alias("text_hash"))


def _seeded(nodes: DataFrame, rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, label): the components of the nodes by what ``linked`` (text_hash, root) links, as a written table."""
    texts = durable(rows.groupBy("text_hash").agg(F.first("node").alias("node")).join(linked, "text_hash").select("node", "root").distinct(), "rooted-nodes")
    heads = texts.groupBy("root").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("root", "head")
    links = join_spread(texts, durable(heads, "heads"), ["root"]).where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = components(durable(links, "links"))
    return durable(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, root): rows whose word shingles have this Jaccard similarity, directly or over others, have one ``root``; all others have their own.

    Words are what ASCII white space separates, A-Z lower-cased; a text of fewer than ``words`` words is one shingle, and texts without any, null included, have one root.
    ``doc_id`` and ``text`` are read, so no other column can clash. Equal to comparing all pairs; see the module for the method. ``linked`` (text_hash, root), a written table: texts
    with one ``root`` are linked from the start, and pairs that this connects aren't compared again.
    """
    found = durable(_sets(docs, words), "sets")
    rows = found.where("node IS NOT NULL").select("doc_id", "text_hash", "node", "n", "sketch")
    often = found.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT).collect()
    frequent, times = np.array([r["shingle"] for r in often], np.int64).view(np.uint64), np.array([r["times"] for r in often], np.int64)
    order = np.argsort(frequent)
    listed = durable(lists(durable(postings(docs, words, similarity, frequent[order], times[order]), "postings")), "lists")
    nodes = durable(rows.groupBy("node").agg(F.min(_key(F.col("text_hash"))).alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    star = listed.where("node > head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    stars = durable(can_be(durable(star, "stars"), nodes, similarity), "possible-stars")
    best = durable(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "best")
    sets = _sets_of(docs, nodes, stars, words)
    if linked is None:
        found = components(durable(similar(best, sets, similarity), "links"))
        labels = durable(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    else:
        seeded = _seeded(nodes, rows, linked)
        labels = merged(seeded, durable(similar(_apart(best, best.limit(0), seeded), sets, similarity), "links"))
    labels = merged(labels, durable(similar(_apart(stars, best, labels), sets, similarity), "links"))
    pairs = durable(can_be(durable(differing(listed, labels, nodes, similarity), "differing"), nodes, similarity), "pairs")
    sets = _sets_of(docs, nodes, pairs, words)
    one = durable(pairs.groupBy("b", "label_a").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    labels = merged(labels, durable(similar(one, sets, similarity), "links"))
    labels = merged(labels, durable(similar(_apart(pairs, one, labels), sets, similarity), "links"))
    narrow = durable(rows.select("doc_id", "text_hash", "node"), "rows")
    return join_spread(narrow, labels, ["node"]).select("doc_id", "text_hash", F.col("label").alias("root"))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of all rows with one ``root`` in ``rows`` (doc_id, text_hash, root) that with the smallest ``doc_id`` stays.

    Equal ids: the smaller text hash; rows equal in id and text: one of them. Null ids come after all others. No column of ``docs`` is touched, whatever its name.
    """
    key = fresh(docs, "key")
    kept = rows.groupBy("root").agg(F.min(_key(F.col("text_hash"))).alias(key)).select(key).distinct()
    keyed = docs.withColumn(key, _key(F.xxhash64("text")))
    return keyed.join(kept, key).dropDuplicates([key]).select(*docs.columns)
