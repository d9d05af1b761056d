
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skirmish.llm import ann, queries
from skirmish.llm import common
from skirmish.llm.common import durable
from tests.llm.conftest import ODD, frame


def brute(vectors, ids, queries, k):
    out = {}
    for q in queries:
        v = vectors[ids.tolist().index(q)]
        s = (vectors * v).sum(axis=1)
        at = np.flatnonzero(ids != q)
        out[q] = [int(x) for x in ids[at][ann.best(ids[at], s[at], k)]]
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.search_table(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    data = table.toPandas()
    vectors, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    want = brute(vectors, ids, list(got), 20)
    assert len(got) == (ids % 20 == 0).sum()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.97


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((8, 64))
    turn = ann.rotation(64)
    assert turn.shape == (ann.BITS, 64) and np.allclose(turn.T @ turn, np.eye(64))
    estimate, bound = ann.estimates(q, turn, *ann.encode(x, turn))
    assert np.mean(abs(estimate - x @ q.T) <= bound) > 0.99
    assert np.corrcoef(estimate.ravel(), (x @ q.T).ravel())[0, 1] > 0.95
    assert len(ann.rotation(600)) == 640


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 20_000)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    n, dim = 100_000, 24
    x = np.random.default_rng(9).standard_normal((n, dim))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))}))
    got = {}
    for r in ann.search_table(table, F.col("vec_id") % 2500 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(x, np.arange(n), list(got), 20)
    assert len(got) == 40 and np.mean([len(got[q] & set(want[q])) / 20 for q in got]) >= 0.95


def test_repeated_rows_and_ids(spark):
    data = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0])] + [(k, [k / 10, 0.5]) for k in range(1, 9)] * 2
    got = ann.search_table(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    assert sorted((r["score"], r["vec_id"]) for r in got) == sorted([(0.8, 8), (0.7, 7), (0.6, 6), (0.5, 1), (0.5, 2), (0.5, 3)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0])]
    got = ann.search_table(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 2, 0.5)]
    assert ann.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_give_the_same_result(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = ann.search_table(table, F.col("vec_id") % 20 == 0, 5).select("query_id", "rank", "vec_id").collect()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ann, "CODE_BLOCK", 120)
    parts = ann.search_table(table, F.col("vec_id") % 20 == 0, 5).select("query_id", "rank", "vec_id").collect()
    assert len(set(whole) & set(parts)) >= 0.98 * len(whole)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("counted", [False, True])
def test_spread_joins_equal_plain_ones(spark, monkeypatch, how, counted):
    monkeypatch.setattr(common, "ONE_TASK", 8)
    left = durable(spark.createDataFrame([(k % 7 if k % 2 else 3, k) for k in range(400)] + [(None, 1000)] * 90 + [(99, 7)] * 80, "x long, y long"), "left")
    right = durable(left.where("x < 6 AND x <> 1").groupBy("x").agg(F.count("*").alias("n"), F.max("y").alias("z")), "right")
    got = common.join_spread(left, right, ["x"], how, n="n" if counted else None)
    want = left.join(right, ["x"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_shared_folder_and_release(spark):
    mark = common.written()
    first = durable(spark.range(5), "one")
    second = durable(spark.range(7), "two")
    common.release(spark, mark, keep=1)
    assert common.written() == mark + 1 and second.count() == 7
    with pytest.raises(Exception):
        first.collect()


# -- pipeline ------------------------------------------------------------------------------------------------------------------


def test_stages_and_run(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() > 0 and 0 < docs.count() < 2 * n


def test_planted_cases(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").collect()
    long = [r for r in source if len(r["text"].split()) > 120 and "\n" not in r["text"][:50]][:5]
    copies = [(1000 + k, r["text"], r["lang"], r["source"], len(r["text"])) for k, r in enumerate(long)]
    words = [r["text"].split(" ") for r in long]
    for w in words:
        w[20] = "changed"
    near = [(2000 + k, " ".join(w), r["lang"], r["source"], r["n_chars"]) for k, (w, r) in enumerate(zip(words, long, strict=True))]
    docs = frame(spark, [tuple(r) for r in long] + copies + near)
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect()}
    assert kept == {r["doc_id"] for r in long}


@pytest.mark.parametrize("index", range(5))
def test_stages_bear_odd_rows(spark, sf_dir, index):
    name, stage = corpus_pipeline.STAGES[index]
    odd = frame(spark, ODD, extra=True)
    got = stage(spark, odd, sf_dir)
    if index < 4:
        assert got.columns == odd.columns
    assert got.count() >= 0
    assert stage(spark, frame(spark, []), sf_dir).count() == 0


@pytest.mark.parametrize("index", range(4))
def test_stages_touch_no_other_column(spark, sf_dir, index):
    taken = ["__lines", "__id", "__no_id", "__text_hash", "__runs", "__score", "__predicted", "__copy", "__key", "__cdf", "__u", "runs", "score", "Predicted", "copy", "key", "parts", "found", "cdf", "u"]
    docs = frame(spark, [*ODD, *((100 + k, "a passage of some words\n" * 30, "en", "a", 0) for k in range(3))]).selectExpr("*", *[f"concat('mine', doc_id) AS {c}" for c in taken])
    got = corpus_pipeline.STAGES[index][1](spark, docs, sf_dir)
    assert got.columns == docs.columns
    for r in got.collect():
        assert all(r[c] == (None if r["doc_id"] is None else f"mine{r['doc_id']}") for c in taken)


def test_line_stage_recounts_characters(spark, sf_dir):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = frame(spark, [(1, passage, "en", "a", len(passage)), (2, passage, "en", "a", len(passage)), (3, "x\n" + passage, "en", "a", 2 + len(passage)), (4, "", "en", "a", 0)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()}
    assert got == {1: (passage, len(passage)), 3: ("x", 1), 4: ("", 0)}


def test_documents_without_an_id_are_not_held_out(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_language_id", "op3_quality_classifier"):
        found = queries.queries()[name](spark, str(tmp_path)).collect()
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False] * 3
        assert {r["held_out"] for r in found} == {False, True}
