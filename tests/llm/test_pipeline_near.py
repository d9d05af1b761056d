"""The pipeline's near-duplicate stage links what operator 6 links, and what the exact pass adds."""

import corpus_pipeline
from skirmish.llm import neardup, simhash
from skirmish.llm.common import durable


def test_stage_keeps_one_of_what_fingerprints_link(spark, sf_dir):
    """F2: each variant has one word in forty changed, so its five-word shingles stay below a similarity of 0.8 to the first text; what the fingerprints link is connected all the same."""
    rows = [(k, " ".join(f"w{i}" if i % 40 != 7 * k % 40 or k == 0 else f"c{k}x{i}" for i in range(2000))) for k in range(4)]
    rows += [(10, "other words that nothing else has here at all"), (11, rows[0][1]), (12, None), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    roots = {r["doc_id"]: r["root"] for r in neardup.similar_components(docs, linked=durable(simhash.linked_texts(docs), "linked")).collect()}
    assert all(len({roots[d] for d in g}) == 1 for g in groups.values())
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect()}
    assert kept == {min(d for d, x in roots.items() if x == root) for root in set(roots.values())}


def test_stage_goes_through_operator_6(spark, sf_dir, monkeypatch):
    """a link that the operator gives alone counts, and its neighbours by the exact pass come along."""
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "changed"]
    rows = [(1, " ".join(f"q{i}" for i in range(60))), (2, " ".join(base)), (3, " ".join(near)), (4, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    real = simhash.linked_texts

    def as_linked(docs):
        one = docs.where("doc_id <= 2").select(F.xxhash64("text").alias("text_hash"), F.lit(-1).cast("long").alias("root"))
        return one.unionByName(real(docs.where("doc_id > 2")))

    monkeypatch.setattr(simhash, "linked_texts", as_linked)
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect()} == {1, 4}
