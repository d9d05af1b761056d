"""Operator 12 against its definition, worked out term by term with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from skirmish.llm import divergence

from .conftest import ODD, frame

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source, terms = lang or "", source or "", LETTERS.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        total = Counter()
        for other in groups:
            if other[0] == lang:
                total.update(counts[other])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        own, whole = shares(counts[lang, source]), shares(total)
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            q = shares(counts[lang, other])
            pairs.append((sum(gap(own[t], q[t]) for t in kept), other))
        terms = [(gap(own[t], whole[t]), t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def run(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Éa", "ÉA", "straße", "日本", "x1y", "don't", "a_b", "z", *(f"w{c}" for c in "abcdefgh")]
    return [(k, " ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice("abcde"), 0) for k in range(n)]


def test_equal_to_the_definition(spark):
    rows = corpus(150)
    assert run(frame(spark, rows)) == brute(rows)
    assert run(frame(spark, rows), min_docs=2, top=3) == brute(rows, 2, 3)


def test_odd_rows(spark, odd, odd_extra, empty):
    assert run(odd, min_docs=1) == brute(ODD, 1)
    assert run(odd) == brute(ODD)
    assert run(odd_extra, min_docs=1) == brute(ODD, 1)
    assert run(empty) == []


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = [(k, "same words here", "en", "a", 0) for k in range(10)] + [(20, None, "en", "b", 0), (21, "... 123", "en", "c", 0), (22, "rare", "xx", "a", 0), (23, "", "xx", "b", 0)]
    found = run(frame(spark, rows))
    assert found == brute(rows)
    assert [r for r in found if r[0] == "xx"] == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_columns_with_the_names_it_uses(spark):
    rows = corpus(60, seed=6)
    df = frame(spark, rows).selectExpr("*", "'x' AS term", "'x' AS n", "'x' AS docs", "'x' AS total", "'x' AS kept", "'x' AS a", "'x' AS b", "'x' AS item", "'x' AS value", "'x' AS rank")
    assert run(df, min_docs=2) == brute(rows, 2)


def test_large_counts_do_not_overflow(spark):
    df = spark.sql("SELECT 4000000000000L AS n, 9000000000000L AS total, 10L AS kept")
    (row,) = df.select(divergence.share("n", "total").alias("p")).collect()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 20)


def test_tallies_of_a_batch_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = np.random.default_rng(2)
    rows = [[{"source": f"s{k}", "n": int(rng.integers(1, 4))} for k in sorted(rng.choice(9, rng.integers(0, 9), replace=False))] for _ in range(80)]
    langs = np.array(["en", "de"], object)[rng.integers(0, 2, 80)]
    cells = pa.array(rows, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    found, expected = Counter(), Counter()
    for x in divergence._tallied(langs, cells):
        for r in x.itertuples(index=False):
            found[r.lang, r.source_a, r.source_b, r.a, r.b] += r.n
    for lang, row in zip(langs, rows, strict=True):
        expected.update((lang, x["source"], y["source"], x["n"], y["n"]) for i, x in enumerate(row) for y in row[i + 1 :])
    assert found == expected
