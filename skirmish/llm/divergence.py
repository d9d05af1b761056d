"""Source divergence audit (operator 12): how far the term shares of a language's sources lie apart, by joint histograms of counts.

A term is a run of letters of any script; of the ASCII characters only A-Z and a-z belong to one, and A-Z are lower-cased. A language keeps the ``V`` terms that
are in at least ``min_docs`` of its documents. A group, a language's source or the language as a whole, gives a kept term of which it has ``count``
occurrences the share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``, ``N`` being its occurrences of kept terms. Two shares differ by
``f = floor((p - q)^2 / (p + q))``. All of this is integer arithmetic.

The divergence of two sources is the sum of ``f`` over all kept terms, also those that one or both don't have. ``f`` depends on the two counts
alone, so for each pair of sources the distinct combinations (count, count) are tallied, and ``f`` is worked out once for each of them, times its multiplicity:

* :func:`vectors` has a row for each kept term with the sources that have it, and their counts; its rows are as long as there are sources, at most.
* :func:`joint_counts` tallies what both sources have, in tasks over terms of like frequency, so that a task's terms fall into few combinations; only tallies leave a task.
* :func:`zero_cells` adds the combinations with a zero. A source's own histogram, less what the pair shares, is what it has alone; the terms that neither has are the rest of ``V``.

The result has a row for each ordered pair of a language's sources, so the number of its groups is the square root of the size of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import BATCH_BYTES, decoded, durable, texts_of

SCALE, MIN_DOCS, TOP = 1_000_000_000, 10, 10
#: Bytes from 0x80 on are parts of longer characters, so the class of characters is this class of bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries and cells that a task holds before it hands on what it has counted.
HELD = 1 << 18
TALLY = pa.schema([(c, pa.string()) for c in ("lang", "source_a", "source_b")] + [(c, pa.int64()) for c in ("a", "b", "n")])


def _groups(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with '' for nulls; other columns aren't read, so none can clash."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and in how many of its documents it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.string()) for x in ([lang] * len(terms), [source] * len(terms), map(decoded, terms))), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            groups = zip(*(map(decoded, texts_of(batch, c)) for c in ("lang", "source")), texts_of(batch), strict=True)
            for lang, source, text in groups:
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.lower())  # bytes: only A-Z change
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flushed()
        yield from flushed()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    counted = _groups(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vectors(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, cells): the kept terms; ``cells`` are the sources that have the term with its count there, in order of the source."""
    cells = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), cells).where(F.col("docs") >= min_docs).select("lang", "term", "total", "cells")


def _tallied(lang: np.ndarray, cells: pa.ListArray) -> Iterator[pd.DataFrame]:
    """Tallies of the pairs of cells within each row, about ``HELD`` pairs at a time."""
    flat = cells.flatten()
    at = cells.offsets.to_numpy() - cells.offsets[0].as_py()
    source, n = flat.field("source").to_numpy(zero_copy_only=False), flat.field("n").to_numpy()
    code, names = pd.factorize(source)
    lang_code, langs = pd.factorize(lang)
    sizes = np.diff(at)
    held: list[np.ndarray] = []

    def tally() -> pd.DataFrame:
        x = pd.DataFrame(np.concatenate(held, axis=1).T, columns=["lang", "source_a", "source_b", "a", "b"])
        held.clear()
        x = x.groupby(list(x.columns), sort=False).size().reset_index(name="n")
        return x.assign(lang=langs[x["lang"]], source_a=names[x["source_a"]], source_b=names[x["source_b"]])

    for size in np.unique(sizes[sizes > 1]):
        rows = np.flatnonzero(sizes == size)
        for some in np.array_split(rows, -(-len(rows) * int(size) // HELD)):
            for i in range(size - 1):
                first = np.repeat(at[some] + i, size - 1 - i)
                second = (at[some][:, None] + np.arange(i + 1, size)[None, :]).ravel()
                held.append(np.stack([np.repeat(lang_code[some], size - 1 - i), code[first], code[second], n[first], n[second]]))
                if sum(x.shape[1] for x in held) > HELD:
                    yield tally()
    if held:
        yield tally()


def joint_counts(kept: DataFrame) -> DataFrame:
    """(lang, source_a, source_b, a, b, n): on how many kept terms two sources (``source_a`` < ``source_b``) have the counts ``a`` and ``b``, both above 0."""
    columns = ["lang", "source_a", "source_b", "a", "b"]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for x in _tallied(batch.column("lang").to_numpy(zero_copy_only=False), batch.column("cells")) if batch.num_rows else ():
                held.append(x)
                if sum(map(len, held)) > HELD:
                    held = [pd.concat(held).groupby(columns, sort=False)["n"].sum().reset_index()]
                    if len(held[0]) > HELD // 2:
                        yield pa.RecordBatch.from_pandas(held.pop(), TALLY, preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held).groupby(columns, sort=False)["n"].sum().reset_index(), TALLY, preserve_index=False)

    # The terms of a frequency are in neighbouring partitions, and a frequency that many terms have is in several.
    dealt = kept.repartitionByRange("lang", "total", "term").select("lang", "cells")
    tallied = dealt.mapInArrow(tally, "lang string, source_a string, source_b string, a long, b long, n long")
    return tallied.groupBy(*columns).agg(F.sum("n").alias("n"))


def zero_cells(joint: DataFrame, own: DataFrame, sizes: DataFrame) -> DataFrame:
    """The tallies of ``joint`` with the combinations that have a zero.

    ``own`` (lang, source, n, terms): each source's histogram of counts above 0. ``sizes`` (lang, source, kept, total): of every group.
    """
    columns = ["lang", "source_a", "source_b", "a", "b"]
    zero = F.lit(0).cast("long")
    # By inclusion and exclusion: what both have is in each of their own histograms too.
    signed = [F.struct((F.col("a") if x else zero).alias("a"), (F.col("b") if y else zero).alias("b"), (F.col("n") * sign).alias("n")) for x, y, sign in ((1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1))]
    both = joint.select("lang", "source_a", "source_b", F.inline(F.array(*signed)))
    sides = {c: sizes.select("lang", F.col("source").alias(f"source_{c}")) for c in "ab"}
    apart = F.col("source_a") < F.col("source_b")
    rows_a = own.select("lang", F.col("source").alias("source_a"), F.col("n").alias("a"), zero.alias("b"), F.col("terms").alias("n")).join(sides["b"], "lang").where(apart)
    rows_b = own.select("lang", F.col("source").alias("source_b"), zero.alias("a"), F.col("n").alias("b"), F.col("terms").alias("n")).join(sides["a"], "lang").where(apart)
    none = rows_a.unionByName(rows_b).select("lang", "source_a", "source_b", zero.alias("a"), zero.alias("b"), (-F.col("n")).alias("n"))
    all_terms = sizes.select("lang", F.col("source").alias("source_a"), "kept").join(sides["b"], "lang").where(apart).select("lang", "source_a", "source_b", zero.alias("a"), zero.alias("b"), F.col("kept").alias("n"))
    cells = both.unionByName(rows_a).unionByName(rows_b).unionByName(none).unionByName(all_terms)
    return cells.groupBy(*columns).agg(F.sum("n").alias("n")).where("n > 0")


def share(count: str, total: str, kept: str = "kept") -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))`` of three columns; the product is a decimal, so no count is too large for it."""
    return F.expr(f"CAST(({count} + 2) AS DECIMAL(20,0)) * {SCALE} div CAST(({total} + 2 * {kept}) AS DECIMAL(20,0)) + 1")


def gap(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two columns of shares; the square stays below 2^63."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language with its divergence, part ``term`` the ``top`` terms that the source has and uses more than its language does.

    ``docs`` needs ``lang``, ``source`` and ``text``; nulls are ''. Ranks start at 1 for a group and part, largest value first, ties by the item's bytes. A repeated row is a document of its own.
    A group without terms has shares from zero counts; without kept terms in its language (``V = 0``) its divergences are 0. No rows: no result. Bytes that aren't UTF-8 read as U+FFFD once counted.
    """
    counts = durable(term_counts(docs), "term-counts")
    kept = durable(vectors(counts, min_docs), "vectors")
    cells = kept.select("lang", "term", "total", F.inline("cells"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _groups(docs).select("lang", "source").distinct().join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
    sizes = durable(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "lang_total", "total")]), "groups")
    own = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))

    tallies = zero_cells(joint_counts(kept), own, sizes)
    side = {c: sizes.select("lang", F.col("source").alias(f"source_{c}"), F.col("total").alias(f"total_{c}"), *["kept"] * (c == "a")) for c in "ab"}
    sized = tallies.join(side["a"], ["lang", "source_a"]).join(side["b"], ["lang", "source_b"])
    sized = sized.select("lang", "source_a", "source_b", "n", share("a", "total_a").alias("p"), share("b", "total_b").alias("q"))
    apart = sized.groupBy("lang", "source_a", "source_b").agg(F.sum(gap("p", "q") * F.col("n")).alias("value"))
    # A pair without kept terms has no cells.
    pairs = sizes.select("lang", F.col("source").alias("source_a")).join(sizes.select("lang", F.col("source").alias("source_b")), "lang").where("source_a < source_b")
    pairs = pairs.join(apart, ["lang", "source_a", "source_b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    both = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("source_a", "source_b"), ("source_b", "source_a"))]))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = pairs.select("lang", both, "value").withColumn("rank", F.row_number().over(order))

    scored = cells.select("lang", "source", F.col("term").alias("item"), "n", F.col("total").alias("in_lang")).join(sizes, ["lang", "source"])
    scored = scored.select("lang", "source", "item", share("n", "total").alias("p"), share("in_lang", "lang_total").alias("q")).where("p > q").select("lang", "source", "item", gap("p", "q").alias("value"))
    term_rows = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_rows.withColumn("part", F.lit("pair")).select(*columns).unionByName(term_rows.withColumn("part", F.lit("term")).select(*columns))
