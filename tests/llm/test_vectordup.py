"""Operator 13 against brute force."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import types as T

from skirmish.llm import vectordup
from skirmish.llm.common import durable

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, similarity):
    """Links, smallest ids and all, by comparing every pair of rows."""
    vectors = [None if e is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e, float) for _, e, _ in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and rows[i][2] is not None:
                if (x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum()) >= similarity:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, new = {i}, [i]
        while new:
            new = [k for x in new for k in links[x] if k not in seen and not seen.add(k)]
        component = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(links[i]), component, vec_id == component))
    return sorted(out, key=str)


def run(spark, rows, similarity=0.98):
    return sorted(map(tuple, vectordup.near_duplicates(spark.createDataFrame(rows, SCHEMA), similarity).collect()), key=str)


def planted(rng, dim, groups, size, noise, labels):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        rows += [(len(rows) + k, (base + noise * rng.standard_normal(dim)).astype(np.float32).tolist(), int(g % labels)) for k in range(size)]
    return rows


@pytest.mark.parametrize(("dim", "similarity"), [(64, 0.98), (5, 0.98), (1, 0.98), (20, 0.9)])
def test_equal_to_brute_force(spark, dim, similarity):
    # Noise that puts the cosines of a group on both sides of the similarity.
    rows = planted(np.random.default_rng(dim), dim, 24, 9, np.sqrt(1 / similarity - 1), 3)
    expected = brute(rows, similarity)
    assert run(spark, rows, similarity) == expected
    assert len({r[1] for r in expected}) > 1


def test_small_parts_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "PART", 7)
    rows = planted(np.random.default_rng(4), 16, 3, 60, 0.09, 2)
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)]
    assert run(spark, rows) == brute(rows, 0.98)


def test_small_parts_of_codes_and_small_sides_find_the_same(spark, monkeypatch):
    for name, value in (("CODES", 5), ("PART", 16), ("_SIDE", 3), ("_TABLE", 40)):
        monkeypatch.setattr(vectordup, name, value)
    rows = planted(np.random.default_rng(6), 16, 3, 40, 0.09, 2)
    assert run(spark, rows) == brute(rows, 0.98)


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [1.0, -0.0], 1), (11, [3.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1),
        (14, [1e-38, 0.0], 1), (15, [3e38, 1e37], 1), (9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, [5.0, 5.0], 2),
    ]
    assert run(spark, rows) == brute(rows, 0.98)
    assert run(spark, []) == []


def test_other_columns_and_names_are_left_alone(spark):
    rows = planted(np.random.default_rng(1), 8, 2, 3, 0.01, 1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "'x' AS key", "'x' AS n", "'x' AS cell", "'x' AS vector", "'x' AS h")
    assert sorted(map(tuple, vectordup.near_duplicates(df).collect())) == brute(rows, 0.98)


def test_turning_keeps_distances_and_rows_apart():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 11))
    y = vectordup.turned(x)
    assert np.allclose(((y[:, None] - y[None]) ** 2).sum(-1), ((x[:, None] - x[None]) ** 2).sum(-1))
    assert (vectordup.turned(x[7:9]) == y[7:9]).all()


def test_similarity_must_be_sensible(spark):
    with pytest.raises(ValueError, match="between"):
        run(spark, [(1, [1.0], 0)], 1.0)


def test_vectors_without_a_partner_are_not_sent_to_cells(spark, monkeypatch):
    """what is written on the way stays near the vectors' own size, however many of them share a cell; with vectors in every cell it was a dozen times that."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(64).astype(np.float32).tolist(), 0) for k in range(4000)] + [(4000 + k, v, 0) for k, (_, v, _) in enumerate(planted(rng, 64, 1, 20, 0.1, 1))]
    written = []
    monkeypatch.setattr(vectordup, "durable", lambda df, name: written.append(durable(df, name)) or written[-1])
    found = vectordup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert found.where("n_links > 0").count() > 1
    size = sum(os.path.getsize(urlparse(f).path) for df in written for f in df.inputFiles())
    assert size < 3 * 64 * 4 * len(rows)


def test_codes_rule_out_no_link():
    """Whoever has a link has a partner by codes in the cell that is to find it."""
    rng = np.random.default_rng(5)
    for dim in (1, 5, 64):
        vectors = vectordup.scaled(np.array([v for _, v, _ in planted(rng, dim, 12, 12, 0.14, 1)], float))
        x = vectordup.turned(vectordup.unit(vectors))
        code, split = vectordup.codes(x, 0.98), vectordup.blocks(x.shape[1])
        for number, block in enumerate(split):
            at, where, moved = vectordup._in_cells(x, number, 0.98)
            for cell in np.unique(where, axis=0):
                here = np.flatnonzero((where == cell).all(axis=1))
                own = at[here]
                members = np.column_stack([moved[here], code[own][:, block].view(np.uint8), code[own][:, split[(number + 1) % len(split)]].view(np.uint8)])
                some = vectordup.partners(members, members, x.shape[1], True)[0]
                i, j = vectordup.linked(vectors[own], vectors[own], cell, number, 0.98, True)
                assert some[i].all() and some[j].all()
