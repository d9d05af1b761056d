"""Tokenizing whole texts with a public byte-level vocabulary, and offset-mapped token counts (operator 7)."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import decoded, map_arrow, texts_of

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of ``byte_bpe_50k.json`` without added special tokens.

    The same vocabulary as ranks (``byte_bpe_50k.tiktoken``) gives the same ids about four times as
    fast; texts that hold the special token's string, which the first format reads as one id, go through
    the first format itself.
    """

    def __init__(self, name: str = VOCABULARY) -> None:
        self.whole = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(self.whole.get_vocab_size(), np.int64)
        for piece, rank in ranks.items():
            self.n_bytes[rank] = len(piece)
        self.n_bytes[self.whole.token_to_id(SPECIAL)] = len(SPECIAL)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the sections of a text: its lines, each with the line feed that ends it."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    ends = feeds if len(feeds) and feeds[-1] == len(text) else np.append(feeds, len(text))
    return np.append(0, ends[:-1]).astype(np.int64), ends.astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of sorted token spans with sorted, gapless sections.

    A token belongs to the section that holds most of its bytes; of equal shares, to the earlier one.
    Returns the section of each token, and for each section the tokens that it has whole or in
    part and those of them that cross one of its boundaries.
    """
    n = len(section_starts)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    owner, most = first.copy(), np.minimum(section_ends[first], ends) - starts
    crossing = np.flatnonzero(last > first)
    touched = np.bincount(first, minlength=n)
    crossed = np.bincount(first[crossing], minlength=n)
    for step in range(1, int((last - first).max(initial=0)) + 1):
        at = crossing[first[crossing] + step <= last[crossing]]
        section = first[at] + step
        share = np.minimum(section_ends[section], ends[at]) - section_starts[section]
        better = share > most[at]
        owner[at[better]], most[at[better]] = section[better], share[better]
        touched += np.bincount(section, minlength=n)
        crossed += np.bincount(section, minlength=n)
    return owner, touched, crossed


COUNT_SCHEMA = "doc_id long, section long, start_byte long, end_byte long, n_tokens long, n_touching long, n_crossing long, doc_tokens long"

Sections = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def section_token_counts(docs: DataFrame, sections: Sections = line_spans, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each section of each text, from one encoding of the whole text.

    Needs ``doc_id`` and ``text``. Each row has a section's byte span, ``n_tokens`` that the rule of
    :func:`attribute` allots to it (they sum to ``doc_tokens``), ``n_touching`` (at least a byte in it) and
    ``n_crossing`` (reaching over a boundary). One pass, no shuffle.

    A null or empty text is one section without tokens. Repeated rows give repeated results.
    """

    def make():
        encoder = Encoder(vocabulary)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts: list[list[np.ndarray]] = []
            rows: list[int] = []
            for text in texts_of(batch):
                valid = decoded(text)
                ids, text = encoder.ids(valid), valid.encode()
                ends = np.cumsum(encoder.n_bytes[ids])
                section_starts, section_ends = sections(text)
                owner, touched, crossed = attribute(np.append(0, ends[:-1])[: len(ids)], ends, section_starts, section_ends)
                n = len(section_starts)
                parts.append([np.arange(n), section_starts, section_ends, np.bincount(owner, minlength=n), touched, crossed, np.full(n, len(ids))])
                rows.append(n)
            which = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), *columns], [x.split()[0] for x in COUNT_SCHEMA.split(", ")])

        return each

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, COUNT_SCHEMA)
