"""Media columns (operator 10): payloads stored as 8-bit grey PNG images, read back and hashed.

A payload of ``n`` bytes (a multiple of ``width``) is an image of ``width`` columns and
``n / width`` rows. :func:`write_png` and :func:`read_png` are a complete round trip for this kind
of image: signature, IHDR, IDAT and IEND chunks, each with its checksum, zlib data, and all five row
filters on reading. :func:`dct_hash` is a perceptual hash: the image is averaged to 32 x 32, the lowest
8 x 8 frequencies of its two-dimensional cosine transform are compared with their median (the constant term is left
out of the median) and give 64 bits.

Defined results: a null text counts as empty; an empty text has one row of zero samples; equal payloads have
equal images and features; rows with a null id are kept; columns that the operator doesn't read never clash, because it
selects what it needs first.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import map_arrow, texts_of

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = 0
SIDE, LOW = 32, 8


class PngError(ValueError):
    """The bytes aren't a PNG of the kind that this module writes, or are damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _neighbours(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The samples to the left, above, and above to the left; 0 outside."""
    left, up, corner = (np.zeros_like(samples) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = samples[:, :-1], samples[:-1], samples[:-1, :-1]
    return left, up, corner


def write_png(samples: np.ndarray, filters: np.ndarray | None = None, level: int = 1) -> bytes:
    """A PNG of a two-dimensional uint8 array. ``filters``: the filter of each row, by default those of :func:`chosen_filters`."""
    rows, width = samples.shape
    kinds = chosen_filters(samples) if filters is None else np.asarray(filters, np.uint8)
    out = np.empty((rows, width + 1), np.uint8)
    out[:, 0], out[:, 1:] = kinds, samples
    around = _neighbours(samples)
    for kind in set(kinds.tolist()) - {0}:
        at = kinds == kind
        out[at, 1:] -= _predicted(kind, *(x[at] for x in around))
    head = struct.pack(">IIBBBBB", width, rows, 8, GREY, 0, 0, 0)
    return b"".join((SIGNATURE, _chunk(b"IHDR", head), _chunk(b"IDAT", zlib.compress(out.tobytes(), level)), _chunk(b"IEND", b"")))


def chosen_filters(samples: np.ndarray, kinds: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """For each row the filter that leaves the smallest sum of absolute differences, the usual rule of PNG writers; the first of equal ones.

    The three default filters are undone without a step from sample to sample.
    """
    around = _neighbours(samples)
    costs = [np.abs((samples - _predicted(k, *around) if k else samples).view(np.int8).astype(np.int16)).sum(axis=1) for k in kinds]
    return np.array(kinds, np.uint8)[np.argmin(costs, axis=0)]


def _predicted(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The filters' predictions from the sample to the left, the one above and the one between."""
    if kind == 1:
        return a
    if kind == 2:
        return b
    x, y, z = (v.astype(np.int16) for v in (a, b, c))
    if kind == 3:
        return ((x + y) >> 1).astype(np.uint8)
    if kind != 4:
        raise PngError(f"unknown filter {kind}")
    p = x + y - z
    dx, dy, dz = abs(p - x), abs(p - y), abs(p - z)
    return np.where((dx <= dy) & (dx <= dz), x, np.where(dy <= dz, y, z)).astype(np.uint8)


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; fails on a wrong signature, a cut file or a wrong checksum."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise PngError("cut chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise PngError("cut chunk")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise PngError(f"wrong checksum in {kind!r}")
        yield kind, body
        at += 12 + n


def unfilter(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Samples from filtered rows.

    Rows of filter 1 are sums along themselves, all at once. Runs of filter 2 are sums down the columns from the row before them. With filters 3 or 4 a sample
    needs those to its left and above, so the image is worked out by diagonals, on each of which all samples are independent.
    """
    if kinds.max(initial=0) > 2:
        return _by_diagonals(kinds, raw)
    out = raw.copy()
    sideways = kinds == 1
    out[sideways] = np.add.accumulate(raw[sideways], axis=1, dtype=np.uint8)
    down = np.flatnonzero(np.diff((kinds == 2).astype(np.int8), prepend=0, append=0))
    for a, b in zip(down[::2], down[1::2], strict=True):
        np.add.accumulate(out[max(a - 1, 0) : b], axis=0, out=out[max(a - 1, 0) : b])
    return out


def _by_diagonals(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    rows, width = raw.shape
    out = np.zeros((rows + 1, width + 1), np.uint8)
    for d in range(rows + width - 1):
        i = np.arange(max(0, d - width + 1), min(rows, d + 1))
        j = d - i
        around, here, predicted = (out[i + 1, j], out[i, j + 1], out[i, j]), kinds[i], np.zeros(len(i), np.uint8)
        for kind in set(here.tolist()) - {0}:
            at = here == kind
            predicted[at] = _predicted(kind, *(x[at] for x in around))
        out[i + 1, j + 1] = raw[i, j] + predicted
    return out[1:, 1:]


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlacing."""
    found = list(chunks(data))
    if not found or found[0][0] != b"IHDR" or found[-1][0] != b"IEND":
        raise PngError("IHDR or IEND is missing")
    width, rows, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", found[0][1])
    if (depth, colour, lace) != (8, GREY, 0):
        raise PngError("not an 8-bit grey image")
    plain = np.frombuffer(zlib.decompress(b"".join(body for kind, body in found if kind == b"IDAT")), np.uint8)
    if plain.size != rows * (width + 1):
        raise PngError("the image data has a wrong length")
    plain = plain.reshape(rows, width + 1)
    return unfilter(plain[:, 0], plain[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


COSINES = _cosines(SIDE, LOW)


def _averaged(samples: np.ndarray, side: int, axis: int) -> np.ndarray:
    """``side`` averages along an axis: of equal runs if there are enough samples, else each sample stands for several."""
    n = samples.shape[axis]
    edges = np.arange(side + 1) * n // side
    if n < side:
        return np.take(samples, edges[:-1], axis=axis).astype(np.float64)
    sums = np.add.reduceat(samples, edges[:-1], axis=axis, dtype=np.int64)
    shape = [1, 1]
    shape[axis] = side
    return sums / np.diff(edges).reshape(shape)


def dct_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients exceed the median of all but the constant one."""
    small = _averaged(_averaged(samples, SIDE, 1), SIDE, 0)
    low = (COSINES @ small @ COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


SCHEMA = "doc_id long, n_bytes long, png binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dct_hash binary"


def media_columns(docs: DataFrame, width: int = 64) -> DataFrame:
    """Store every text as a PNG and describe what is read back from it.

    Needs ``doc_id`` and ``text``. Returns ``png`` and ``dct_hash`` as binary columns with digests of the payload read
    back (``payload_*``, ``tail_crc32`` of its last ``width`` bytes) and of the stored form (``media_*``).
    One pass over the rows, without a shuffle; a task holds one batch and one document's image.
    """

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = {name: [] for name in ("n", "png", "size", "sha", "tail", "media", "media_sha", "hash")}
            for text in texts_of(batch):
                padded = text + bytes(-len(text) % width if text else width)
                png = write_png(np.frombuffer(padded, np.uint8).reshape(-1, width))
                samples = read_png(png)
                back = samples.tobytes()
                for name, value in zip(rows, (len(text), png, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-width:]), len(png), hashlib.sha256(png).hexdigest(), dct_hash(samples)), strict=True):
                    rows[name].append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names)

        return each

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)


def digest(media: DataFrame) -> DataFrame:
    """The columns of query ``op10_media_columns``."""
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("dct_hash")).alias("feature"))
