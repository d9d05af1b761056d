"""Nearest neighbours by inner product (operator 5) over randomly rotated one-bit codes.

A vector is scaled to length 1, turned into ``BITS`` dimensions by a random matrix with orthonormal columns, and kept as the signs of its components (packed
bits) with two correction scalars: its length, and how well the signs stand for it (their inner product with the turned vector). The inner product of a turned
query with the signs, divided by the second scalar, estimates the query's with the vector, with an error bound of ``EPSILON`` deviations.

Nothing is fitted: the matrix depends on the dimension and a seed, so every row is indexed alike. Codes and scalars travel, vectors don't: queries and codes are
dealt into blocks of bounded size by hash, and every query block meets every code block in a task of its own, twice. First each meeting returns a query's
``FIRST * k`` largest estimates; the best of all meetings are worked out with the original vectors in double precision, and the k-th largest of these is
the query's reach. Then each meeting returns the vectors whose upper bound gets there, and these are worked out too. Vectors join by id, only for these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import durable, map_arrow

BITS = 512
EPSILON = 3.0
FIRST = 4
#: Largest blocks of queries and codes; blocks of codes are smaller, down to ``SMALL_BLOCK``, as long as there is no task for each core.
QUERY_BLOCK, CODE_BLOCK, SMALL_BLOCK = 4096, 65_536, 4096
#: Codes that are unpacked at a time in a task.
SLICE = 4096


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """(bits x dim) with orthonormal columns; bits is ``BITS``, or for longer vectors the next multiple of 64."""
    bits = max(BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, fidelities) of the rows."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / lengths[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), lengths, np.abs(turned).sum(axis=1) / np.sqrt(len(turn))


def estimates(queries: np.ndarray, turn: np.ndarray, codes: np.ndarray, lengths: np.ndarray, fidelity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes x queries): inner products of the queries with coded vectors, and the bounds of their errors."""
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    norms = np.sqrt((queries * queries).sum(axis=1))
    turned = ((queries @ turn.T) / np.sqrt(len(turn))).astype(np.float32)
    scale = (lengths / fidelity)[:, None]
    spread = EPSILON * np.sqrt(np.maximum(1 - fidelity**2, 0) / max(1, len(turn) - 1))[:, None]
    return (signs @ turned.T) * scale, scale * spread * norms[None, :]


VECTOR_SCHEMA = "vec_id long, row long, code binary, length double, fidelity double, vector array<double>"


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Codes and scalars of every vector; ``row`` tells different vectors of one id apart. Rows equal in id and vector count once. Vectors that are null, zero,
    or hold nulls or non-finite components take no part, nor do rows without an id, or vectors of another length than the most frequent one (ties: the smaller)."""
    values = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector")).where(usable).withColumn("row", F.xxhash64("vector")).dropDuplicates(["vec_id", "row"])
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1

    def make():
        turn = rotation(dim)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
            codes, lengths, fidelity = encode(x, turn)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lengths), pa.array(fidelity), batch.column("vector")], ["vec_id", "row", "code", "length", "fidelity", "vector"])

        return each

    return map_arrow(rows.where(F.size("vector") == dim), make, VECTOR_SCHEMA)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _meetings(indexed: DataFrame, queries: DataFrame, n: int, n_queries: int, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, row, estimate): what each meeting of a block of queries with one of codes returns.

    ``queries`` (query_id, query_row, wanted, reach): with a null reach a meeting returns the ``FIRST * k`` largest estimates, else all whose upper bound reaches it.
    """
    cores = indexed.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    blocks = max(1, -(-n // CODE_BLOCK), min(cores, -(-n // SMALL_BLOCK)))
    # Queries have columns of their own names: a cogroup of two sides with columns in common would mix them up.
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", "query_row"), F.lit(query_blocks))).withColumn("qcb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    codes = indexed.select("vec_id", "row", "code", "length", "fidelity", F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(blocks)).cast("int").alias("cb"))
    offered = codes.withColumn("cqb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            wanted = _matrix(left, "wanted")
            own, own_row, reach = left.column("query_id").to_numpy(), left.column("query_row").to_numpy(), left.column("reach").to_numpy()
            ids, rows = right.column("vec_id").to_numpy(), right.column("row").to_numpy()
            packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            lengths, fidelity = right.column("length").to_numpy(), right.column("fidelity").to_numpy()
            turn, first = rotation(wanted.shape[1]), np.isnan(reach)
            for q in range(0, len(own), 256):
                asked = slice(q, q + 256)
                held: list[list[np.ndarray]] = []
                for c in range(0, len(ids), SLICE):
                    some = slice(c, c + SLICE)
                    estimate, bound = estimates(wanted[asked], turn, packed[some], lengths[some], fidelity[some])
                    estimate[ids[some][:, None] == own[None, asked]] = -np.inf
                    good = estimate + bound >= np.where(first[asked], -np.inf, reach[asked])[None, :]
                    if first[asked].any() and len(estimate) > FIRST * k:
                        least = np.partition(estimate, len(estimate) - FIRST * k, axis=0)[len(estimate) - FIRST * k]
                        good &= ~first[asked][None, :] | (estimate >= least[None, :])
                    at, which = np.nonzero(good & np.isfinite(estimate))
                    held.append([which + q, at + c, estimate[at, which].astype(float)])
                which, at, estimate = (np.concatenate(x) for x in zip(*held, strict=True))
                place = np.lexsort((ids[at], -estimate, which))
                which, at, estimate = which[place], at[place], estimate[place]
                rank = np.arange(len(which)) - np.searchsorted(which, which)
                keep = ~first[which] | (rank < FIRST * k)
                which, at, estimate = which[keep], at[keep], estimate[keep]
                out.append([own[which], own_row[which], ids[at], rows[at], estimate])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "query_row", "vec_id", "row", "estimate"])

    met = asked.groupBy("qb", "qcb").cogroup(offered.groupBy("cqb", "cb"))
    return met.applyInArrow(meet, "query_id long, query_row long, vec_id long, row long, estimate double")


def _exact(pairs: DataFrame, indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` with ``score``: the inner product of the original vectors, added up in double precision from the first component to the last."""
    vectors = indexed.select("vec_id", "row", "vector")
    both = pairs.join(vectors, ["vec_id", "row"]).join(queries.select("query_id", "query_row", "wanted"), ["query_id", "query_row"])

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("vector", "wanted"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAIR), pa.array((x * y).sum(axis=1))], [*PAIR, "score"])

        return each

    return map_arrow(both.select(*PAIR, "vector", "wanted"), make, "query_id long, query_row long, vec_id long, row long, score double")


PAIR = ["query_id", "query_row", "vec_id", "row"]


def search(indexed: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, n_reranked): of each indexed query the ``k`` nearest others, nearest first, ties to the smaller id.

    ``indexed``: a written table of :func:`index`. ``is_query``: which of its rows are queries. Rows with the query's own id aren't its candidates; different vectors
    of another id are candidates each. Different vectors of a query's id are queries each, and each has its own ``k`` rows. Fewer than ``k``
    candidates: all of them. ``n_reranked``: how many candidates were worked out with their vectors.
    """
    n, n_queries = indexed.agg(F.count("*"), F.count_if(is_query)).first()
    queries = indexed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("vector").alias("wanted"))
    by_query = Window.partitionBy("query_id", "query_row")
    largest = _meetings(indexed, queries.withColumn("reach", F.lit(None).cast("double")), n, n_queries, k)
    place = F.row_number().over(by_query.orderBy(F.desc("estimate"), "vec_id", "row"))
    first = durable(_exact(largest.withColumn("place", place).where(F.col("place") <= FIRST * k).select(*PAIR), indexed, queries), "first")
    kth = first.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", "query_row", F.col("score").alias("reach"))
    # A query without k candidates has all of them already.
    reaching = _meetings(indexed, queries.join(kth, ["query_id", "query_row"]), n, n_queries, k).select(*PAIR).join(first, PAIR, "left_anti")
    scored = first.unionByName(_exact(reaching, indexed, queries))
    ranked = scored.withColumns({"rank": F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id", "row")), "n_reranked": F.count("*").over(by_query)})
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_reranked")


def search_table(vectors: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    return search(durable(index(vectors), "codes"), is_query, k)
