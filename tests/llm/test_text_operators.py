import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skirmish.llm import grams, langid, latticelm, lines, media, mixing, neardup, packing, quality, simhash, tokens
from skirmish.llm.common import crc_mod
from tests.llm.conftest import ODD, frame


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- 1: language ------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 5) == 0)
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.97


def test_filter_has_no_false_negatives_and_few_false_positives(docs):
    model = langid.fit(docs, min_share=1e-4)
    learned = langid.gram_counts(docs).where("gram_order = 3").groupBy("lang").agg(F.max_by("gram", "n").alias("g")).collect()
    for r in learned:
        masks = model.look_up(3, np.array([r["g"]], np.int64).view(np.uint64))
        assert langid.bit(masks, model.languages.index(r["lang"]))[0] == 1
    noise = model.look_up(3, np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    for i in range(len(model.languages)):
        assert abs(np.mean(langid.bit(noise, i)) - model.false_rate[3][i]) < 0.02


def test_language_of_odd_rows(odd, empty, docs):
    model = langid.fit(docs)
    got = rows(langid.predict(odd, model))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8, 9)} == {"und"}
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in rows(langid.predict(odd, nothing))} == {"und"}


def test_any_names_and_numbers_of_languages(spark):
    names = ["gram", "a`b", "lang", *[f"l{k}" for k in range(67)]]
    data = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}z" for x in "abcdefgh" for _ in range(5)), name, "a", 0) for k, name in enumerate(names)]
    docs = frame(spark, data)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {r[0]: r[2] for r in data}


def test_letters_decide_what_has_a_language(spark, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark, [(k, t, None, "a", 0) for k, t in enumerate(("½", "²", "①2", "_", "é", "日"))]), model).collect()}
    assert {k for k, v in got.items() if v == "und"} == {0, 1, 2, 3}


def test_bytes_that_are_not_utf8(spark):
    docs = frame(spark, [(k, "some words here", "en", "a", 0) for k in range(5)]).withColumn("text", F.expr("CAST(unhex('61FF6220' || hex(text)) AS STRING)"))
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"en"}
    assert latticelm.score_documents(docs, F.col("doc_id") == 1).where("n_tokens = 5").count() == 5
    assert tokens.section_token_counts(docs).count() == 5 and packing.pack_documents(docs).count() == 5
    assert quality.score(docs, quality.train([])).count() == 5


def test_grams_by_brute_force():
    text = "ab  cde f"
    separators = grams.Separators(grams.WHITE)
    for codes, _, owners in grams.pieces([text, "", "gh\tßi"], separators):
        joined = "".join(map(chr, codes))
        assert list(owners) == [0, 2] and joined == " ab  cde f gh ßi "
        want = {n: [joined[i : i + n] for i in range(len(joined) - n + 1) if " " not in joined[i + 1 : i + n - 1] and joined[i : i + n].strip() and (n > 1 or joined[i] != " ")] for n in (1, 2, 3)}
        for n, at, h in grams.grams(codes, (1, 2, 3)):
            seen = [joined[i : i + n] for i in at]
            assert seen == want[n]
            assert len(set(h.tolist())) == len(set(seen))
        at, h = grams.words(codes)
        assert [joined[i:].split()[0] for i in at] == ["ab", "cde", "f", "gh", "ßi"] and len(set(h.tolist())) == 5


def test_long_texts_give_the_same_grams_in_pieces(monkeypatch):
    separators = grams.Separators(grams.WHITE)
    text = ("abc defgh\n" * 2000 + "x" * 700).strip()

    def counted():
        return Counter(h for codes, _, _ in grams.pieces([text], separators) for _, _, hs in grams.grams(codes, (2, 4)) for h in hs.tolist())

    whole = counted()
    monkeypatch.setattr(grams, "PIECE", 300)
    assert counted() == whole


def test_two_megabytes_of_lines_have_the_features_of_their_words():
    words = [f"w{k % 977}" for k in range(420_000)]
    text = "\n".join(words)
    assert len(text) > 2_000_000
    got = Counter()
    for owner, bucket in quality.features([text], 1 << 30):
        assert not owner.any()
        got.update(bucket.tolist())
    one = {w: quality._bucket(grams.words(grams.Separators(grams.WHITE).codes(f" {w} "))[1], 1 << 30)[0] for w in set(words)}
    assert all(got[one[w]] >= n for w, n in Counter(words).items())
    pairs = 420_000 - 1
    within = sum(len(w) + 1 + len(w) + len(w) - 1 for w in words)  # windows of 2, 3 and 4 in a word and the spaces beside it
    assert sum(got.values()) == len(words) + pairs + within


# -- 2: language model ------------------------------------------------------------------------------------------------------


def brute_lattice(lattice, word):
    """Sum over all segmentations, by recursion."""
    log_p = dict(zip(lattice.pieces, lattice.log_p, strict=True))

    def total(rest):
        if not rest:
            return 1.0
        return sum(math.exp(log_p[rest[:k]]) * total(rest[k:]) for k in range(1, min(len(rest), lattice.longest) + 1) if rest[:k] in log_p)

    return total(b" " + word)


def test_forward_recursion_sums_all_segmentations():
    lattice = latticelm.Lattice.load()
    words = [b"the", b"tion", b"a", "größe".encode(), b"x9-z", b"inthe"]
    got = lattice.log_probabilities(words)[0]
    for w, p in zip(words, got, strict=True):
        assert math.isclose(p, math.log(brute_lattice(lattice, w)), rel_tol=1e-9)


def test_expected_counts_sum_to_bytes_and_raise_likelihood():
    lattice = latticelm.Lattice.load()
    words = [b"the", b"then", b"thing", b"nothing"] * 3
    expected = np.zeros(len(lattice.pieces))
    before = lattice.log_probabilities(words, None, expected)[0].sum()
    assert math.isclose(sum(n * len(p) for n, p in zip(expected, lattice.pieces, strict=True)), sum(len(w) + 1 for w in words), rel_tol=1e-9)
    assert latticelm.Lattice(lattice.pieces, latticelm.refitted(expected, lattice.log_p)).log_probabilities(words)[0].sum() > before


def test_words_and_end_have_a_mass_of_one_after_any_prefix():
    rng = np.random.default_rng(8)
    q = np.vstack([0.7 * rng.dirichlet(np.ones(3), 2).T, [0.3, 0.3]])  # three words and the end, two classes
    prior = np.array([0.3, 0.7])

    def p(counts):
        at = np.flatnonzero(counts)
        return 10 ** latticelm.document_log10(np.log10(q[at]), np.array(counts)[at], np.log10(q[3]), np.log10(prior))

    total, longest = 0.0, 60
    for a in range(longest):
        for b in range(longest - a):
            for c in range(longest - a - b):
                total += math.factorial(a + b + c) / (math.factorial(a) * math.factorial(b) * math.factorial(c)) * p([a, b, c])
    assert 0.999 < total <= 1 + 1e-9


def test_lattice_has_a_mass_of_at_most_one():
    lattice = latticelm.Lattice.load()
    begin, go_on = (sum(math.exp(x) for p, x in zip(lattice.pieces, lattice.log_p, strict=True) if (p[:1] == b" ") == first) for first in (True, False))
    assert begin / (1 - go_on) <= 1 + 1e-9  # begin, and any number of further pieces


def test_scores_by_brute_force(spark):
    train = ["a bc a", "bc the then", "the a a", "then nothing"]
    test = ["a a thing", "", "the other bc bc bc", "nothing then a"]
    data = [(k, t, None, "a", 0) for k, t in enumerate(train)] + [(100 + k, t, None, "a", 0) for k, t in enumerate(test)]
    got = {r["doc_id"]: r["score"] for r in latticelm.score_documents(frame(spark, data), F.col("doc_id") >= 100, rounds=0).collect()}
    lattice = latticelm.Lattice.load()
    counts = Counter(w for t in train for w in t.split())
    n = sum(counts.values()) + len(train)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.05), 0.95)
    for k, t in enumerate(test):
        seen, p, words = Counter(), 1.0, t.split()
        for m, w in enumerate(words):
            q = max(counts[w] - d, 0) / n + d * len(counts) / n * brute_lattice(lattice, w.encode())
            p *= (latticelm.BURST * q + seen[w]) / (latticelm.BURST + m)
            seen[w] += 1
        p *= latticelm.BURST * len(train) / n / (latticelm.BURST + len(words))
        assert math.isclose(got[100 + k], math.log10(p), rel_tol=1e-9)


def test_base_scores_by_brute_force_and_better_model(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in rows(latticelm.score_documents(docs, crc_mod("doc_id", 5) == 1))}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.select("doc_id", "text").collect()}
    counts = Counter(t for k, ts in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for k, ts in texts.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(t in counts for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(odd, empty):
    got = rows(latticelm.score_documents(odd, F.col("doc_id") == 4))
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {1}
    assert latticelm.score_documents(empty, F.lit(False)).count() == 0
    alone = rows(latticelm.score_documents(odd, F.lit(True)))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in alone)


def test_long_unseen_words_keep_their_lattice_probability(spark):
    lattice = latticelm.Lattice.load()
    assert lattice.longest > 24  # pieces of any length
    data = [(k, "some words to learn from", "en", "a", 0) for k in range(20)] + [(100 + n, "q7" * n, "en", "a", 0) for n in (100, 200, 400)]
    got = {r["doc_id"]: r["score"] for r in latticelm.score_documents(frame(spark, data), F.col("doc_id") >= 100).collect()}
    one, two, four = got[200], got[300], got[500]
    assert one < -310 and two - one < -100 and abs((four - two) / (two - one) - 2) < 0.1


def test_planes_give_the_numbers_back_in_fewer_bytes():
    rng = np.random.default_rng(1)
    places, times = np.sort(rng.choice(500_000, 300, replace=False)).astype(np.int32), rng.poisson(0.2, 300).astype(np.int32) + 1
    steps = latticelm.planes(np.diff(places, prepend=np.int32(0))[None]).tobytes()
    assert (np.cumsum(latticelm.unplaned(steps, np.int32)[0]) == places).all()
    assert len(zlib.compress(steps, 1)) < 0.8 * len(zlib.compress(places.tobytes(), 1))
    assert len(zlib.compress(latticelm.planes(times[None]).tobytes(), 1)) < len(zlib.compress(times.tobytes(), 1))
    for shape in ((3, 8), (1, 1), (0, 0), (2, 0)):
        values = rng.normal(size=shape)
        assert (latticelm.unplaned(latticelm.planes(values).tobytes(), np.float64, shape[0]) == values).all()


def test_texts_are_stored_as_planes(spark):
    words = [f"w{k}" for k in range(3000)]
    docs = frame(spark, [(1, " ".join(words), "en", "a", 0), (2, " ".join(words[::7] + words[:2]), "en", "a", 0)]).coalesce(1)
    got = {r["doc_id"]: r for r in latticelm.blocks(docs, F.lit(False), ["en"], 1).where("words IS NULL").collect()}
    assert (latticelm.unplaned(got[1]["places"], np.int32)[0] == [0] + [1] * 2999).all()
    assert latticelm.unplaned(got[2]["counts"], np.int32).sum() == len(words[::7]) + 2


# -- 3: quality ------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    got = quality.score(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", 3) == 1)
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 80 and right >= 0.93


def test_quality_of_odd_rows(odd_extra, empty, spark, docs):
    labels = spark.createDataFrame([(4, 0), (4, 1), (6, 1), (7, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd_extra, labels)
    got = rows(quality.score(odd_extra, model, "__s", "__p"))
    assert len(got) == len(ODD) and {r["score"] for r in got} == {"kept"}
    assert {r["__s"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {0.5}
    assert quality.score(empty, model).count() == 0
    one_class = quality.fit(odd_extra, labels.where("quality = 1"))
    assert all(r["predicted"] == 1 for r in rows(quality.score(odd_extra.drop("Predicted"), one_class)))


def test_quality_is_trained_in_a_task(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = quality.sample_features(quality.training_sample(docs, labels, "quality", 20), 1 << 10).collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"]))
    want = quality.train([(r["y"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got], 1 << 10)
    assert len(got) > 10
    plain = quality.train

    def in_a_task(*args):
        assert TaskContext.get() is not None
        return plain(*args)

    monkeypatch.setattr(quality, "train", in_a_task)
    model = quality.fit(docs, labels, per_class=20, buckets=1 << 10)
    assert (model.scores == want.scores).all() and model.prior == want.prior


def test_a_labelled_id_on_many_rows_counts_once(spark):
    docs = frame(spark, [(1, f"good words {k}", "en", "a", 0) for k in range(500)] + [(2, "bad bad bad", "en", "a", 0)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.sample_features(quality.training_sample(docs, labels, "quality", 10), 1 << 10).count() == 2


# -- 4: mixing --------------------------------------------------------------------------------------------------------------


def test_replication_is_poisson_with_the_target_mean(spark):
    data = [(k, f"t{k}" + "y" * 8, "en", "big" if k % 4 else "small", 10) for k in range(8000)]
    df = frame(spark, data)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df).collect()}
    assert rates["small"] > 1 > rates["big"] > 0
    counts = Counter(r["doc_id"] for r in mixing.mix_sources(df).select("doc_id").collect())
    for source, rate in rates.items():
        n = np.array([counts[k] for k, _, _, s, _ in data if s == source])
        assert abs(n.mean() - rate) < 5 * math.sqrt(rate / len(n)) and abs(n.var() - rate) < 0.15 * rate + 0.02
    again = Counter(r["doc_id"] for r in mixing.mix_sources(df).select("doc_id").collect())
    assert again == counts
    chosen = mixing.mix_sources(df, weights={"small": 1.0})
    assert {r["source"] for r in chosen.select("source").distinct().collect()} == {"small"}


def test_mixing_is_globally_ordered(docs):
    keys = [r["shuffle_key"] for r in mixing.mix_sources(docs).collect()]
    assert keys == sorted(keys) and len(keys) > 0


def test_mixing_of_odd_rows(odd_extra, empty):
    got = rows(mixing.mix_sources(odd_extra, power=1.0, budget=3.0, copy="__c", key="__k"))
    assert {r["copy"] for r in got} == {"kept"}
    twins = Counter(r["doc_id"] for r in got if r["text"] == "hello hello world\nhello again")
    assert twins[4] % 2 == 0
    assert mixing.mix_sources(empty).count() == 0
    with pytest.raises(Exception, match="limit"):
        mixing.mix_sources(odd_extra, budget=1e6).collect()


def test_a_tiny_source_beside_large_ones_is_drawn_exactly(spark):
    data = [(k, "y" * 200_000, "en", f"big{k % 20}", 0) for k in range(100)]
    data += [(1000 + k, "z" if k == 0 else None, "en", None, 0) for k in range(400)]
    df = frame(spark, data)
    rate = {r["source"]: r["rate"] for r in mixing.source_rates(df).collect()}[None]
    assert rate > 900
    counts = Counter(r["doc_id"] for r in mixing.mix_sources(df).where("source IS NULL").select("doc_id").collect())
    n = np.array([counts[1000 + k] for k in range(400)])
    assert abs(n.mean() - rate) < 5 * math.sqrt(rate / 400) and 0.7 * rate < n.var() < 1.35 * rate


# -- 6: SimHash -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, words=4):
    import xxhash

    ts = text.encode().lower().split()
    if not ts:
        return 0
    shingles = [b" ".join(ts[i : i + words]) for i in range(max(1, len(ts) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = dict(zip(fps, fps, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in fps}


def test_fingerprints_and_components_by_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    roots = brute_components(sorted(set(fps.values())))
    least = defaultdict(lambda: 1 << 62)
    for k, f in fps.items():
        least[roots[f]] = min(least[roots[f]], k)
    for r in rows(simhash.near_duplicates(docs)):
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == least[roots[fps[r["doc_id"]]]]


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in simhash.covering_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def _planted(seed, centres=40, near=12):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        out.add(c)
        for _ in range(near):
            c ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False))
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 5])
def test_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = _planted(3)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.edges(df)).collect()}
    assert {f: labels.get(f, f) for f in fps} == brute_components(fps)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_simhash_of_odd_rows(odd, odd_extra, empty):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = rows(neardup.keep_one(odd_extra, neardup.similar_components(odd_extra)))
    assert len(kept) == len(ODD) - 4 and {r["id"] for r in kept} == {"kept"}
    assert neardup.keep_one(empty, neardup.similar_components(empty)).count() == 0


def test_similar_texts_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    data, pairs = [], []
    for k in range(60):
        text = rng.choice(words, 300).tolist()
        data.append((10 * k, " ".join(text), "en", "a", 0))
        for j, edits in ((1, 3), (2, 40)):
            copy = list(text)
            for at in np.linspace(5, 290, edits).astype(int):
                copy[at] = "edited"
            data.append((10 * k + j, " ".join(copy), "en", "a", 0))
        pairs.append(10 * k)
    roots = {r["doc_id"]: r["root"] for r in rows(neardup.similar_components(frame(spark, data)))}
    assert all(roots[k] == roots[k + 1] for k in pairs)  # similarity 0.9
    assert sum(roots[k] == roots[k + 2] for k in pairs) == 0  # similarity below 0.3


def test_a_rejected_first_node_hides_no_similar_pair(spark):
    """Many texts share most of a passage (similarity 0.72), pairs of them are at 0.84: brute force over exact shingle sets."""
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(252)]
    data = []
    for k in range(150):
        own = [f"o{k}.{j}" for j in range(23)]
        for copy in (2 * k, 2 * k + 1):
            data.append((copy, " ".join(passage + own + [f"e{copy}.{j}" for j in range(25)]), "en", "a", 0))
    rng.shuffle(data)
    data = [(int(d), str(t), "en", "a", 0) for d, t, *_ in data]
    sets = {d: {tuple(w[at : at + 5]) for at in range(len(w) - 4)} for d, t, *_ in data for w in [t.split()]}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert similar == {(2 * k, 2 * k + 1) for k in range(150)}
    roots = {r["doc_id"]: r["root"] for r in rows(neardup.similar_components(frame(spark, data)))}
    joined = {(a, b) for a in roots for b in roots if a < b and roots[a] == roots[b]}
    assert joined == similar


def jaccard_components(data, words=5, similarity=0.8):
    """Smallest document of each component, by comparing all pairs of sets."""
    sets = {}
    for d, t, *_ in data:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[at : at + words]) for at in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def partition(roots):
    groups = defaultdict(set)
    for d, r in roots.items():
        groups[r].add(d)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("size", [1, 4, 5, 8, 49, 200])
def test_pairs_at_the_limit_are_all_found(spark, size):
    """A text and the same with words added, at a similarity of just 0.8: with 8 words one more leaves 4 of 5 shingles."""
    rng = np.random.default_rng(size)
    data = []
    for k in range(100):
        text = [f"w{x}" for x in rng.integers(0, 10**9, size)]
        more = max(size - 4, 1) // 4
        data += [(2 * k, " ".join(text), "en", "a", 0), (2 * k + 1, " ".join(text + [f"m{k}.{j}" for j in range(more)]), "en", "a", 0)]
    roots = {r["doc_id"]: r["root"] for r in rows(neardup.similar_components(frame(spark, data)))}
    assert partition(roots) == partition(jaccard_components(data))
    assert size < 8 or all(roots[2 * k] == roots[2 * k + 1] for k in range(100))


@pytest.mark.parametrize("part", [1024, 4])
def test_components_equal_brute_force(spark, monkeypatch, part):
    """Families on both sides of 0.8, of all lengths, with passages that many texts share, copies and texts without words."""
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(part)
    passage, data = [f"p{k}" for k in range(30)], []
    for family in range(25):
        text = [f"f{family}.{k}" for k in range(int(rng.integers(1, 90)))] + passage * int(rng.integers(0, 2))
        for _ in range(12):
            copy = list(text)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[at] = f"e{rng.integers(0, 10**9)}"
            data.append((len(data), " ".join(copy), "en", "a", 0))
    data += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, " \n", "en", "a", 0), (1003, data[0][1].upper(), "en", "a", 0)]
    roots = {r["doc_id"]: r["root"] for r in rows(neardup.similar_components(frame(spark, data)))}
    assert partition(roots) == partition(jaccard_components(data))


def test_one_large_group_of_near_copies(spark):
    """Pairs of the group that aren't in one component yet are compared in parts that are spread over tasks."""
    rng = np.random.default_rng(2)
    text = [f"w{k}" for k in range(120)]
    data = []
    for k in range(1500):
        copy = list(text)
        copy[int(rng.integers(5, 115))] = f"e{k}"
        data.append((k, " ".join(copy), "en", "a", 0))
    data += [(5000 + k, " ".join(text[:60] + [f"o{k}.{j}" for j in range(60)]), "en", "a", 0) for k in range(40)]
    roots = {r["doc_id"]: r["root"] for r in rows(neardup.similar_components(frame(spark, data)))}
    assert len({roots[k] for k in range(1500)}) == 1 and len({roots[5000 + k] for k in range(40)} | {roots[0]}) == 41


def test_near_dedup_touches_no_column(spark):
    taken = ["__lines", "__id", "__no_id", "__text_hash", "key", "key_", "root", "node", "hashes", "text_hash"]
    docs = frame(spark, ODD).selectExpr("*", *[f"concat('mine', doc_id) AS {c}" for c in taken])
    kept = rows(neardup.keep_one(docs, neardup.similar_components(docs)))
    assert len(kept) == len(ODD) - 4
    assert all(r[c] == (None if r["doc_id"] is None else f"mine{r['doc_id']}") for r in kept for c in taken)


# -- 7: token counts ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    return tokens.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_those_of_the_vocabulary_file(encoders, text):
    assert encoders[0].ids(text).tolist() == encoders[1].encode(text, add_special_tokens=False).ids


def test_ids_of_the_documents(encoders, docs):
    for r in docs.select("text").collect():
        assert encoders[0].ids(r["text"]).tolist() == encoders[1].encode(r["text"], add_special_tokens=False).ids


def brute_owner(start, end, sections):
    shares = [max(0, min(end, b) - max(start, a)) for a, b in sections]
    return max(range(len(sections)), key=lambda k: (shares[k], -k))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.lists(st.integers(1, 9), min_size=1, max_size=12))
def test_attribution_by_brute_force(token_lengths, section_lengths):
    size = max(sum(token_lengths), sum(section_lengths))
    token_ends, section_ends = (np.cumsum([*x, *([size - sum(x)] if size > sum(x) else [])]) for x in (token_lengths, section_lengths))
    token_starts, section_starts = (np.append(0, e[:-1]) for e in (token_ends, section_ends))
    owner, touched, crossed = tokens.attribute(token_starts, token_ends, section_starts, section_ends)
    sections = list(zip(section_starts, section_ends, strict=True))
    assert owner.tolist() == [brute_owner(a, b, sections) for a, b in zip(token_starts, token_ends, strict=True)]
    for k, (a, b) in enumerate(sections):
        inside = [(s, e) for s, e in zip(token_starts, token_ends, strict=True) if s < b and e > a]
        assert touched[k] == len(inside) and crossed[k] == sum(s < a or e > b for s, e in inside)


def test_section_counts_of_odd_rows(odd, empty):
    got = rows(tokens.section_token_counts(odd))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert sum(r["n_tokens"] for r in by[8]) == by[8][0]["doc_tokens"] and len(by[8]) == 5000
    assert [(r["end_byte"], r["n_tokens"]) for r in by[1] + by[2]] == [(0, 0), (0, 0)]
    assert len(by[4]) == 5 and tokens.section_token_counts(empty).count() == 0


# -- 8: packing --------------------------------------------------------------------------------------------------------------


def test_pieces_and_sequences(docs, encoders):
    got = rows(packing.pack_documents(docs, with_ids=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for r in docs.select("doc_id", "text").collect():
        ids = [*encoders[1].encode(r["text"], add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        assert [i for p in parts for i in p["ids"]] == ids and all(p["length"] == 1024 for p in parts[1:])
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        total += len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda x: x["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * total / 1024 + 2


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 300).tolist()
    population = packing.first_population(lengths, 1024, rng)
    least, first = packing.lower_bound(lengths, 1024), len(population[0])
    for _ in range(3):
        population = packing.evolve(population, lengths, 1024, rng)
        for s in population:
            assert sorted(i for b in s for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 1024 for b in s)
    assert least <= len(population[0]) <= first


def test_many_shards_and_islands(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = np.random.default_rng(2)
    items = [(k, int(x)) for k, x in enumerate(rng.integers(1, 101, 500))]
    got = rows(packing.pack(spark.createDataFrame(items, "item long, length int"), 100))
    assert sorted(r["item"] for r in got) == list(range(500))
    fill = Counter()
    for r in got:
        fill[r["sequence"]] += items[r["item"]][1]
    assert max(fill.values()) <= 100 and len(fill) <= 1.08 * packing.lower_bound([x for _, x in items], 100) + 1


def test_packing_of_odd_rows(odd, empty):
    got = rows(packing.pack_documents(odd))
    assert len({r["row"] for r in got}) == len(ODD) and {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack_documents(empty).count() == 0


# -- 9: lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    """Deleted line numbers by document key, from all windows that are minimal forwards or backwards."""
    keys = sorted({(k is None, k or 0, t) for k, t in docs if t is not None})
    found = []
    for key in keys:
        lines_ = [(i, s, len(re.findall(r"[^ \t-\r]+", s))) for i, s in enumerate(key[2].split("\n"))]
        e = [x for x in lines_ if x[2]]
        for i in range(len(e)):
            for step, stop in ((1, len(e)), (-1, -1)):
                total = 0
                for j in range(i, stop, step):
                    total += e[j][2]
                    if total >= least:
                        part = e[min(i, j) : max(i, j) + 1]
                        found.append((key, part[0][0], part[-1][0], tuple(x[1] for x in part)))
                        break
    first = {}
    for key, a, _, content in found:
        first[content] = min(first.get(content, (key, a)), (key, a))
    out = defaultdict(set)
    for key, a, b, content in found:
        if (key, a) > first[content]:
            out[key] |= set(range(a, b + 1))
    return out


lines_text = st.lists(st.sampled_from(["a b c", "d e", "f g h i", "x", "", "k l m n o"]), min_size=0, max_size=9).map("\n".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(lines_text, min_size=1, max_size=8))
def test_line_dedup_by_brute_force(spark, texts):
    data = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    want = brute_lines([(k, t) for k, t, *_ in data], 5)
    for r in rows(lines.dedup_lines(frame(spark, data), 5)):
        gone = want[False, r["doc_id"], texts[r["doc_id"]]]
        assert r["text"] == "\n".join(s for i, s in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone)


def test_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    data = [(1, f"one\n{passage}\nmenu", "en", "a", 0), (2, f"menu\ntwo\n{passage}", "en", "a", 0), (3, "menu\nthree", "en", "a", 0)]
    got = {r["doc_id"]: r["text"] for r in rows(lines.dedup_lines(frame(spark, data)))}
    assert got == {1: data[0][1], 2: "menu\ntwo", 3: "menu\nthree"}


def test_line_dedup_stays_in_the_jvm(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_odd_rows(odd_extra, empty):
    got = rows(lines.dedup_lines(odd_extra, 3, "__runs"))
    assert len(got) == len(ODD) and {r["lines"] for r in got} == {"kept"}
    assert next(r for r in got if r["doc_id"] == 1)["text"] is None
    twins = [r["text"] for r in got if r["doc_id"] == 4 and r["text"].startswith("hello")]
    assert twins == ["hello hello world\nhello again"] * 2
    assert lines.dedup_lines(empty).count() == 0


# -- 10: media ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.randoms(use_true_random=False))
def test_png_round_trip_with_every_filter(width, height, random):
    samples = np.array([[random.randrange(256) for _ in range(width)] for _ in range(height)], np.uint8)
    filters = np.array([random.randrange(5) for _ in range(height)])
    assert (media.read_png(media.write_png(samples, filters)) == samples).all()


def test_damage_is_noticed():
    png = media.write_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for at in (0, 20, 45, len(png) - 2):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises((media.PngError, zlib.error)):
            media.read_png(bytes(broken))
    with pytest.raises(media.PngError):
        media.read_png(png[:-6])


def test_dct_hash_of_small_changes_and_other_images():
    rng = np.random.default_rng(0)
    smooth = np.add.outer(np.linspace(0, 200, 80), 40 * np.sin(np.arange(64) / 9)).astype(np.uint8)
    near = smooth.copy()
    near[10, 10] += 3
    bits = lambda x: int.from_bytes(media.dct_hash(x), "big")
    assert (bits(smooth) ^ bits(near)).bit_count() <= 4 < (bits(smooth) ^ bits(rng.integers(0, 256, (80, 64), dtype=np.uint8))).bit_count()


def plain_unfilter(kinds, raw):
    """By the format's definition, a sample at a time."""
    out = [[0] * raw.shape[1] for _ in kinds]
    for i, kind in enumerate(kinds):
        for j in range(raw.shape[1]):
            a, b, c = out[i][j - 1] if j else 0, out[i - 1][j] if i else 0, out[i - 1][j - 1] if i and j else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[i][j] = (int(raw[i, j]) + (0, a, b, (a + b) // 2, near)[kind]) % 256
    return np.array(out, np.uint8).reshape(raw.shape)


@pytest.mark.parametrize("kinds", [(0, 1, 2), (2,), (0, 1, 2, 3, 4), (3,), (4,)])
def test_unfiltering_by_its_definition(kinds):
    rng = np.random.default_rng(6)
    for rows_, width in ((1, 1), (1, 9), (13, 7), (40, 64)):
        raw, chosen = rng.integers(0, 256, (rows_, width), dtype=np.uint8), rng.choice(kinds, rows_).astype(np.uint8)
        assert (media.unfilter(chosen, raw) == plain_unfilter(chosen, raw)).all()


def test_text_payloads_are_written_with_filters_that_reading_undoes(docs):
    samples = np.frombuffer((docs.first()["text"].encode() + b" " * 64)[:6400], np.uint8)
    samples = samples[: len(samples) // 64 * 64].reshape(-1, 64)
    assert media.chosen_filters(samples).any()
    assert (media.read_png(media.write_png(samples)) == samples).all()
    # The cosine transform by its definition.
    square = np.random.default_rng(3).integers(0, 256, (32, 32)).astype(np.uint8)
    x = np.arange(32)
    direct = np.array([[sum(square[y, z] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * z + 1) * v / 64) for y in x for z in x) for v in range(8)] for u in range(8)]).ravel()
    assert media.dct_hash(square) == np.packbits(direct > np.median(direct[1:])).tobytes()


def test_media_columns_of_odd_rows(odd, empty):
    got = rows(media.digest(media.media_columns(odd)))
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])), sorted(ODD, key=lambda o: (o[0] is None, o[0] or 0, len((o[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert len(r["feature"]) == 16 and len(r["media_sha256"]) == 64
    assert media.media_columns(empty).count() == 0
