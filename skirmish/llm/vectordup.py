"""Embedding near-dedup (operator 13) by a subspace pigeonhole join.

Unit vectors have a cosine of at least ``s`` exactly if their squared distance is at most ``2 - 2 s``. The vectors are turned by an orthonormal matrix (signs and
Hadamard steps, which add and subtract in a fixed order and so give every task the same numbers) and split into blocks of ``BLOCK_DIMS`` components. The squared
distance is the sum of the blocks' squared distances, so a pair within the budget is within its share of the budget, proportional to the components, in one block at least.

Each block is range-joined under its own share: a grid over the first ``GRID`` components of the block has cells of ``CELL`` times the block's reach. A vector is in
its own cell, and also in those below it whose upper border is within reach, so a pair within reach meets in the cell of the smaller of both coordinates, once.
A pair that is within the share in several blocks counts in the first of them. The cosine of each such pair is then worked out from the original vectors in double precision.

Vectors don't travel to the cells: what does is a code of a byte for each component of the block and of the one after it. Codes that are apart by more than a pair within reach may be
rule the pair out, whatever rounding did; who is left with no partner in a cell has no link there. Only for the rest, the candidates, vectors are sent, a row for each cell with a partner.
Shuffled bytes so grow with the vectors, however many of them share a cell.

Equal vectors of one label are one class with a multiplicity. The codes of a cell are dealt into parts of ``CODES`` and its candidates into parts of ``PART``, and each pair of parts is a row of
its own, so that a group of near copies is spread over tasks however large it is; of its links only sums and the edges of a spanning forest leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import durable, join_spread, map_arrow
from skirmish.llm.simhash import components

SIMILARITY = 0.98
BLOCK_DIMS, GRID, CELL = 8, 3, 4.0
PART, CODES = 4096, 1 << 15
#: Steps of a code in a block's reach.
FINE = 20
#: Rows of vectors that meet at a time, and elements of a table of codes' distances.
_SIDE, _TABLE = 1024, 1 << 21
#: Pairs whose vectors a task holds at a time.
_STEP = 1 << 14
#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-9


def turned(unit: np.ndarray, seed: int = 13) -> np.ndarray:
    """Rows turned by an orthonormal matrix of the next power of two dimensions; an element's value doesn't depend on the other rows."""
    dim = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), dim))
    x[:, : unit.shape[1]] = unit
    for signs in np.random.default_rng(seed).choice([-1.0, 1.0], (2, dim)):
        x = x * signs
        half = dim // 2
        while half:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), dim)
            half //= 2
        x = x / np.sqrt(dim)
    return x


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 1/2 or above, which is exact: squares are finite and not zero then."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def blocks(dim: int) -> list[slice]:
    """The blocks of a turned vector."""
    return [slice(a, min(a + BLOCK_DIMS, dim)) for a in range(0, dim, BLOCK_DIMS)]


def shares(dim: int, similarity: float) -> list[float]:
    """Each block's share of the squared distance."""
    return [(2 - 2 * similarity + SLACK) * (b.stop - b.start) / dim for b in blocks(dim)]


def cells(x: np.ndarray, block: slice, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell, below): the grid coordinates of turned rows in a block, and in which of them the border below is within reach."""
    reach = np.sqrt(share)
    at = x[:, block][:, :GRID] / (CELL * reach)
    cell = np.floor(at)
    return cell.astype(np.int32), (at - cell) * CELL <= 1 + SLACK


def classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows with their class's key, and (node, label, dim, h, g, n, least, vector) of every class of equal usable vectors."""
    values = F.col(embedding).cast("array<double>")
    usable = F.col(label).isNotNull() & F.col(embedding).isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    # 0.0 and -0.0 are the same number.
    vector = F.transform(values, lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, F.struct(F.col(label).alias("label"), F.size(embedding).alias("dim"), F.xxhash64(vector).alias("h"), F.xxhash64(vector, F.lit(1)).alias("g"))).alias("key"), F.when(usable, F.col(embedding)).alias("vector"))
    grouped = rows.where("key IS NOT NULL").select("vec_id", "key.*", "vector").groupBy("label", "dim", "h", "g").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    # A number for each class of the table as it is written; it doesn't change later.
    return durable(rows.drop("vector"), "vectors"), durable(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def _in_cells(x: np.ndarray, number: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, moved) of turned rows in a block: each row in its own cell and those below; ``moved`` has a bit for each axis along which the cell is below the row's own."""
    cell, below = cells(x, blocks(x.shape[1])[number], shares(x.shape[1], similarity)[number])
    at, where, moved = np.arange(len(x)), cell, np.zeros(len(x), np.uint8)
    for axis in range(cell.shape[1]):
        more = np.flatnonzero(below[at, axis])
        lower = where[more].copy()
        lower[:, axis] -= 1
        at, where, moved = np.concatenate([at, at[more]]), np.concatenate([where, lower]), np.concatenate([moved, moved[more] | np.uint8(1 << axis)])
    return at, where, moved


def codes(x: np.ndarray, similarity: float) -> np.ndarray:
    """Turned rows in steps of ``1 / FINE`` of a block's reach. What lies outside a byte's range is brought to its border, which takes no two values further apart."""
    reach = np.sqrt(np.repeat(shares(x.shape[1], similarity), [b.stop - b.start for b in blocks(x.shape[1])]))
    return np.clip(np.rint(x / reach * FINE), -127, 127).astype(np.int8)


def placed(found: DataFrame, similarity: float, parts: dict[tuple, int] | None = None) -> DataFrame:
    """(label, dim, block, cell, size, low, high, part, nodes, codes): the classes of a batch that are in a cell, as one row, in every block; ``codes`` has for each the axes along which it was moved,
    and its codes in the block and the next. A cell of ``parts`` has a row for each of its parts and each part that this meets. With ``parts`` null only sizes are filled in."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                names = rows.column("label").dictionary_encode()
                x = turned(unit(scaled(rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, dim))))
                label, node, code, split = names.indices.to_numpy(), rows.column("node").to_numpy(), codes(x, similarity), blocks(x.shape[1])
                values = names.dictionary.to_pylist()
                for number, block in enumerate(split):
                    at, where, moved = _in_cells(x, number, similarity)
                    order = np.lexsort((*where.T, label[at]))
                    at, where, moved = at[order], where[order], moved[order]
                    known = np.column_stack([label[at], where])
                    begin = np.flatnonzero(np.append(True, (known[1:] != known[:-1]).any(axis=1)))
                    whole = np.column_stack([moved, code[at][:, block].view(np.uint8), code[at][:, split[(number + 1) % len(split)]].view(np.uint8)])
                    out = []
                    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
                        key = int(label[at[a]]), tuple(where[a].tolist())
                        if parts is None:
                            out.append((*key, b - a, None, None, None, None, None))
                            continue
                        n = parts.get((values[key[0]], dim, number, *key[1]), 1)
                        part = node[at[a:b]] % n
                        for k in range(n):
                            own = a + np.flatnonzero(part == k)
                            if len(own):
                                packed = node[at[own]].tobytes(), whole[own].tobytes()
                                out += [(*key, len(own), min(k, o), max(k, o), k, *packed) for o in range(n)]
                    which, cell, *rest = zip(*out, strict=True)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * where.shape[1] + 1, where.shape[1]), pa.int32()), pa.array(np.array(cell, np.int32).ravel()))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [names.dictionary.take(pa.array(which)), pa.array(np.full(len(out), dim, np.int32)), pa.array(np.full(len(out), number, np.int32)), flat, *(pa.array(v, t) for v, t in zip(rest, kinds, strict=True))],
                        ["label", "dim", "block", "cell", "size", "low", "high", "part", "nodes", "codes"],
                    )

        return each

    kind = found.schema["label"].dataType.simpleString()
    return map_arrow(found.select("label", "dim", "node", "vector"), make, f"label {kind}, dim int, block int, cell array<int>, size long, low int, high int, part int, nodes binary, codes binary")


def partners(one: np.ndarray, two: np.ndarray, dim: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of codes (moved axes, block, next block) have a partner among the others (``two`` is ``one``, if ``same``): a superset of those with a link that the cell is to find.

    Rounding moves a difference by a step at most in each component, so codes of a pair within reach are apart by the reach's steps and the root of the components' number at most.
    """
    width = (one.shape[1] - 1) // 2
    own, both = ((FINE * np.sqrt(share) * (1 + 1e-6) + np.sqrt(width)) ** 2 for share in (1, dim / width))
    found = np.zeros(len(one), bool), np.zeros(len(one if same else two), bool)

    def table(a: np.ndarray, b: np.ndarray, part: int) -> np.ndarray:
        """Squared distances, exact in single precision: whole numbers below 2^24."""
        a, b = (v[:, 1 + part * width : 1 + (part + 1) * width].view(np.int8).astype(np.float32) for v in (a, b))
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T

    side = max(1, _TABLE // max(1, len(two)))
    for at in range(0, len(one), side):
        x, first = one[at : at + side], at if same else 0
        y = two[first:]
        near = table(x, y, 0) <= own
        if same:
            near[np.arange(len(x)), np.arange(len(x))] = False
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(i):
            ok = near[np.ix_(i, j)] & (table(x[i], y[j], 1) <= both) & (x[i, 0][:, None] & y[j, 0][None, :] == 0)
            found[0][at + i] |= ok.any(axis=1)
            found[1][first + j] |= ok.any(axis=0)
    return (found[0] | found[1],) * 2 if same else found


def candidates(found: DataFrame, similarity: float) -> DataFrame:
    """(label, dim, block, cell, node): the classes that may have a link in a cell, by their codes."""
    key = ["label", "dim", "block", "cell"]
    large = placed(found, similarity).groupBy(*key).agg(F.sum("size").alias("size")).where(F.col("size") > CODES).withColumn("parts", F.ceil(F.col("size") / CODES).cast("int"))
    # Cells of more than CODES classes, so there are as many as classes in cells over CODES at most.
    parts = {(r["label"], r["dim"], r["block"], *r["cell"]): r["parts"] for r in large.collect()}
    meeting = placed(found, similarity, parts).groupBy(*key, "low", "high").agg(F.collect_list(F.struct("part", "nodes", "codes")).alias("members"), F.sum("size").alias("size")).where("size > 1")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                dim, low, high = (batch.column(c)[row].as_py() for c in ("dim", "low", "high"))
                members = batch.column("members")[row].as_py()
                width = 1 + 2 * min(BLOCK_DIMS, 1 << max(0, (dim - 1).bit_length()))
                sides = [[m for m in members if m["part"] == k] for k in dict.fromkeys((low, high))]
                node, code = [np.frombuffer(b"".join(m["nodes"] for m in side), np.int64) for side in sides], [np.frombuffer(b"".join(m["codes"] for m in side), np.uint8).reshape(-1, width) for side in sides]
                some = partners(code[0], code[-1], 1 << max(0, (dim - 1).bit_length()), low == high)
                left = np.concatenate([n[s] for n, s in zip(node, some, strict=False)])
                if len(left):
                    same = pa.array(np.full(len(left), row))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in key), pa.array(left)], [*key, "node"])

        return each

    kind = found.schema["label"].dataType.simpleString()
    return map_arrow(meeting, make, f"label {kind}, dim int, block int, cell array<int>, node long").distinct()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes with links ``i``-``j``, each node's smallest node in its component."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def distance(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, block: slice) -> np.ndarray:
    """Squared distances of rows in a block, added up in one order, so that all tasks that meet a pair agree on it."""
    total = np.zeros(len(i))
    for k in range(block.start, block.stop):
        apart = x[i, k] - y[j, k]
        total += apart * apart
    return total


def linked(x: np.ndarray, y: np.ndarray, cell: np.ndarray, block: int, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links of (:func:`scaled`) rows of ``x`` with rows of ``y`` (the same rows, if ``same``) that ``cell`` of a block is to find: pairs that meet there, within the block's share and
    in no earlier block within that one's, whose cosine is large enough."""
    tx, ty = turned(unit(x)), turned(unit(y))
    parts, budget = blocks(tx.shape[1]), shares(tx.shape[1], similarity)
    bx, by = tx[:, parts[block]], ty[:, parts[block]]
    near = (bx * bx).sum(axis=1)[:, None] + (by * by).sum(axis=1)[None, :] - 2 * bx @ by.T <= budget[block] + SLACK
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    own_x, own_y = cells(tx, parts[block], budget[block])[0], cells(ty, parts[block], budget[block])[0]
    here = (np.minimum(own_x[i], own_y[j]) == cell[None, :]).all(axis=1)
    i, j = i[here], j[here]
    found = []
    for at in range(0, len(i), _STEP):
        a, b = i[at : at + _STEP], j[at : at + _STEP]
        within = [distance(tx, ty, a, b, p) <= share for p, share in zip(parts[: block + 1], budget, strict=False)]
        first = within[-1] & ~np.any(within[:-1], axis=0) if block else within[-1]
        a, b = a[first], b[first]
        cosine = (x[a] * y[b]).sum(axis=1) / np.sqrt((x[a] * x[a]).sum(axis=1)) / np.sqrt((y[b] * y[b]).sum(axis=1))
        found.append(np.stack([a, b])[:, cosine >= similarity])
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    return i, j


def links(found: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n): with a null ``b``, that ``a`` has links with ``n`` vectors of other classes, in parts that are to be summed; else an edge of a forest over the links."""
    if not 0 < similarity < 1:
        raise ValueError("similarity must be between 0 and 1")
    key = ["label", "dim", "block", "cell"]
    spread = durable(candidates(found, similarity), "candidates")
    counted = spread.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    dealt = join_spread(spread, durable(counted, "sizes"), key, n="size").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A part goes to each pair of parts that it belongs to.
    meeting = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(found.select("node", "n", "vector"), "node")
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    member = F.struct("node", "n", "part", "vector")
    pairs = meeting.groupBy(*key, low, high).agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            whole, at = batch.column("members").flatten(), batch.column("members").offsets.to_numpy() - batch.column("members").offsets[0].as_py()
            node, n, part = (whole.field(c).to_numpy() for c in ("node", "n", "part"))
            values = whole.field("vector")
            flat, begin = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy() - values.offsets[0].as_py()
            out = []
            for row, (block, cell, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "low", "high")), strict=True)):
                span = slice(at[row], at[row + 1])
                nodes, counts, sides = node[span], n[span], part[span]
                vectors = scaled(flat[begin[at[row]] : begin[at[row + 1]]].astype(float).reshape(len(nodes), -1))
                one, two = np.flatnonzero(sides == low), np.flatnonzero(sides == high)
                met = []
                for a in range(0, len(one), _SIDE):
                    for b in range(a if low == high else 0, len(two), _SIDE):
                        x, y = one[a : a + _SIDE], two[b : b + _SIDE]
                        i, j = linked(vectors[x], vectors[y], np.array(cell, np.int32), block, similarity, low == high and a == b)
                        met.append(np.stack([x[i], y[j]]))
                i, j = np.concatenate(met, axis=1) if met else np.zeros((2, 0), int)
                total = np.bincount(i, counts[j], len(nodes)) + np.bincount(j, counts[i], len(nodes))
                some, root = np.flatnonzero(total), forest(len(nodes), i, j)
                more = np.flatnonzero(root != np.arange(len(nodes)))
                out.append((nodes[some], np.full(len(some), -1), total[some].astype(np.int64)))
                out.append((nodes[more], nodes[root[more]], np.zeros(len(more), np.int64)))
            a, b, count = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(count)], ["a", "b", "n"])

        return each

    return map_arrow(pairs, make, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors``; other columns aren't read, so none can clash.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least ``similarity``. ``n_links`` counts the other rows linked with a row, repeated
    rows and copies included; ``component_id`` is the smallest id that links reach, the row's own included; ``kept`` says if that is its own.
    A vector that is null, empty, zero, or holds null or non-finite components links with nothing and is its own component, and so does one of a null label; vectors of
    different lengths don't link. A null id is passed over for ``component_id`` where another can be reached; where none can it is null, and the row is kept.
    """
    rows, found = classes(vectors, vec_id, embedding, label)
    all_links = durable(links(found, similarity), "links")
    sums = all_links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    labels = components(all_links.where("b IS NOT NULL").select("a", "b").distinct()).withColumnRenamed("label", "root")
    rooted = found.join(labels, "node", "left").join(sums, "node", "left")
    rooted = durable(rooted.select("label", "dim", "h", "g", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "rooted")
    smallest = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    of_class = durable(join_spread(rooted, smallest, ["root"]).select("label", "dim", "h", "g", "n_links", "component_id"), "components")
    flat = durable(rows.where("key IS NOT NULL").select("vec_id", "key.*"), "flat")
    joined = join_spread(flat, of_class, ["label", "dim", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
