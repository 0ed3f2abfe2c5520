"""Words of a text, as columns and as hashed numpy arrays.

A word is a run of bytes other than blank and 0x09..0x0D.  The numpy side
hashes all words of a batch of texts at once: every byte is weighted by a
fixed 64-bit constant of its place in the word (a multilinear hash), summed
per word and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PLACES = np.zeros(0, dtype=_U)


def n_words(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) \
        .cast("long")


def word_array(text: Column) -> Column:
    """The words of a text as an array; null text: empty."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _places(n: int) -> np.ndarray:
    global _PLACES
    if len(_PLACES) < n:
        k = np.arange(1, max(n, 256) + 1, dtype=_U)
        _PLACES = mix64(k * _U(0x9E3779B97F4A7C15)) | _U(1)
    return _PLACES


def chunks(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` (bytes) holding about ``limit`` bytes; a
    longer text is a range of its own, whole.  Hashing takes some 50 times a
    range's bytes, which a worker does not all give back."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20
           ) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, so
    that what is made of a run at once is bounded whatever the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    part = np.cumsum(size.to_numpy(zero_copy_only=False),
                     dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(),
            batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def sliced(batches: Iterator[pa.RecordBatch], column: int
           ) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in such slices."""
    for batch in batches:
        yield from slices(batch, column)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text plus the total)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    inside = ~_SPACE[buf]
    step = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = step[0::2], step[1::2]
    ends = ends[: len(starts)]
    lens = ends - starts
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, _U), first
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    weight = _places(int(lens.max()))
    h = np.add.reduceat((buf[inside].astype(_U) + _U(1)) * weight[place], at)
    return mix64(h ^ (lens.astype(_U) * _U(0xD6E8FEB86659FD93))), first


def span_hash(buf: np.ndarray, begin: np.ndarray,
              end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span, none of them empty."""
    if not len(begin):
        return np.zeros(0, np.int64)
    lens = end - begin
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    weight = _places(int(lens.max()))
    h = np.add.reduceat((buf[place + np.repeat(begin, lens)].astype(_U)
                         + _U(1)) * weight[place], at)
    return mix64(h ^ (lens.astype(_U) * _U(0xD6E8FEB86659FD93))) \
        .view(np.int64)


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, dtype=_U)
    for j in range(k):
        out *= _U(0x9FB21C651E98DF25)
        out += h[j:j + n]
    return mix64(out)
