"""Line dedup (operator 9) by winnowing over line hashes, with DataFrame functions only.

A run is a sequence of lines (lines without words don't count in it) that occurs elsewhere, earlier in the order of ``doc_id`` (nulls
last), text hash and line number. Runs of at least ``min_words`` words are found without exception; the later occurrence goes.

* Windows: from every line on, the fewest lines that have ``min_words`` words; and up to every line, the same backwards.
* Winnowing: the line with a window's smallest hash (the first of equal ones) is its fingerprint. Equal windows have it at the same place, so a repeated
  run of ``min_words`` words shares one for certain. Fingerprints at only one position in the whole table drop out with their windows.
* Joined positions: a position matches the first one in the table with the same fingerprint from which the match extends as far as its window goes.
* Extension: the lines before and after the fingerprint are compared by their hashes, up to both ends of the window, and all lines once more by
  second hashes, so a match rests on 128 bits of each line. The windows that overlap in a longer match extend it line by line, forward windows to
  its last full one and backward windows to its last line, and merge into the whole run.

Rows equal in ``doc_id`` and text are one document and get the same result. A repetition within a document counts
too, and overlapping occurrences do: of ``n`` equal lines in a row the first stays. A document without a repeated run is unchanged; null
texts stay null; documents of which nothing is left have an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import broadcast_if_small, durable, fresh, join_spread

MIN_WORDS = 50
KEY = ["no_id", "id", "text_hash"]
#: As documents: words are runs of anything but ASCII white space.
WORD = "[^ \\t-\\r]+"


def _key_columns() -> tuple[Column, ...]:
    return F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(dict(zip(KEY, _key_columns(), strict=True)))


def line_table(docs: DataFrame) -> DataFrame:
    """(key, e): for each document its lines that have words, as structs of position, two hashes and number of words."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    found = _keyed(docs.select("doc_id", "text")).where("text IS NOT NULL").select(*KEY, F.filter(lines, lambda s: s["w"] > 0).alias("e")).where(F.size("e") > 0)
    return found.dropDuplicates(KEY)  # rows equal in id and text are one document


def _taken(part: Column, min_words: int) -> Column:
    """How many elements of ``part`` reach ``min_words``, their words, and the words of the last of them."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x["w"]).alias("words"), x["w"].alias("last"))
        return F.when(acc["words"] >= min_words, acc).otherwise(more)

    return F.aggregate(part, start, step)


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, first, last, at, least, before, after, again): every window's line positions, its fingerprint's position and hash, the hashes of the lines
    before and after it, and the second hash of all lines.

    A line with words has at least one, so a window never has more than ``min_words`` lines.
    """
    e, reach = F.col("e"), F.lit(min_words)
    places = F.sequence(F.lit(0), F.size(e) - 1)

    def window(first: Column, n: Column) -> Column:
        part = F.slice(e, first + 1, n)
        hashes = F.transform(part, lambda x: x["h"])
        ends = F.struct(F.get(e, first)["pos"].alias("first"), F.get(e, first + n - 1)["pos"].alias("last"), hashes.alias("h"), F.array_min(hashes).alias("least"), F.xxhash64(F.transform(part, lambda x: x["g"])).alias("again"))
        return F.struct(ends.alias("w"), F.array_position(hashes, ends["least"]).cast("int").alias("p"), first.alias("i"))

    def matched(s: Column) -> Column:
        w, p = s["w"], s["p"]
        before, after = F.slice(w["h"], F.lit(1), p - 1), F.slice(w["h"], p + 1, F.size(w["h"]))
        return F.struct(w["first"].alias("first"), w["last"].alias("last"), F.get(e, s["i"] + p - 1)["pos"].alias("at"), w["least"].alias("least"), F.xxhash64(before).alias("before"), F.xxhash64(after).alias("after"), w["again"].alias("again"))

    forward = F.transform(places, lambda i: F.struct(i.alias("i"), _taken(F.slice(e, i + 1, reach), min_words).alias("t")))
    forward = F.transform(F.filter(forward, lambda s: s["t"]["words"] >= min_words), lambda s: window(s["i"], s["t"]["n"]))
    backward = F.transform(places, lambda i: F.struct(i.alias("i"), _taken(F.reverse(F.slice(e, F.greatest(i + 2 - reach, F.lit(1)), F.least(i + 1, reach))), min_words).alias("t")))
    # Those that are minimal from their first line on as well are forward windows already: without its last line such a window falls short.
    backward = F.filter(backward, lambda s: (s["t"]["words"] >= min_words) & (s["t"]["words"] - F.get(e, s["i"])["w"] >= min_words))
    backward = F.transform(backward, lambda s: window(s["i"] - s["t"]["n"] + 1, s["t"]["n"]))
    return lines.select(*KEY, F.inline(F.transform(F.concat(forward, backward), matched)))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, runs): for each document that has any, the later repeated runs as sorted, separate structs (first, last) of line numbers from 0."""
    found = durable(windows(durable(line_table(docs), "lines"), min_words), "windows")
    position, place = F.struct(*KEY, "at"), F.struct(*KEY, "first")
    prints = found.groupBy("least").agg(F.min(position).alias("a"), F.max(position).alias("b"), F.count("*").alias("n")).where("a < b")
    shared = durable(prints.select("least", "n"), "fingerprints")
    anchored = durable(join_spread(found, shared, ["least"], "left_semi", n="n"), "anchored")
    content = ["least", "before", "after", "again"]
    firsts = anchored.groupBy(*content).agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    matches = join_spread(anchored, durable(firsts, "matches"), content, n="n")
    later = matches.where(place > F.col("earliest")).select(*KEY, "first", "last")
    order = Window.partitionBy(*KEY).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.select(*KEY, "first", "last", F.when(F.col("first") <= reached + 1, 0).otherwise(1).alias("new"))
    numbered = begun.select(*KEY, "first", "last", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = numbered.groupBy(*KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, name: str = "runs") -> DataFrame:
    """The rows of ``docs`` with ``text`` without its later repeated runs, and ``name``, those taken out (null if none). A column of that name is replaced, no other one is touched."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    key, found, parts = (fresh(docs, c) for c in ("key", "found", "parts"))
    runs = repeated_runs(docs, min_words).select(F.struct(*KEY).alias(key), F.col("runs").alias(found))
    own = F.struct(*[c.alias(k) for k, c in zip(KEY, _key_columns(), strict=True)])
    runs, keyed = durable(runs, "runs"), docs.select(*kept).withColumn(key, own)
    few = broadcast_if_small(runs, 48 + 8 * F.size(found))
    joined = keyed.join(few, key, "left") if few is not runs else join_spread(keyed, runs, [key], "left")
    # Both uses of the split below keep it a column of its own, worked out once a row.
    split = joined.withColumn(parts, F.when(F.col(found).isNotNull(), F.split("text", "\n")))
    starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(found, lambda r: r["first"]), F.array(F.size(parts)))
    left = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(F.col(parts), s["a"] + 1, s["b"] - s["a"]))
    text = F.when(F.col(found).isNotNull(), F.array_join(F.flatten(left), "\n")).otherwise(F.col("text"))
    return split.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], F.col(found).alias(name))


def digest(deduped: DataFrame) -> DataFrame:
    """The columns of query ``op9_line_dedup``."""
    spans = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return deduped.select("doc_id", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(spans, F.lit("")).alias("removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
