"""Packing along a space-filling curve.

A text's hashed word vector is projected to a few dimensions; its place on a
Hilbert curve through them orders the documents, so neighbours in a sequence
are alike.  The documents' ids, each closed by the end id, form one stream in
that order, which is cut every ``length`` ids: every sequence but the last is
full.

Each text is tokenised once.  The ids are written compressed; only (curve
key, row, number of ids) is range-sorted to find the offsets - a running sum
within a partition plus the totals of the partitions before, of which the
driver holds one number each.

Defined cases: null text is empty and has the end id only; a null key is kept
and sorts first; rows with equal keys, or equal rows, are packed one after
the other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.bpe import encoder
from paysift.llm.stash import pin, stash
from paysift.llm.words import chunks, hashed_words, sliced
from paysift.session import bound_batches


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates
    (rows of ``axes``).

    From the highest bit down, the octant's Gray code is the next digit and
    the lower bits are reflected and turned into the octant's own frame.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_places(texts: list[bytes], dims: int, bits: int) -> np.ndarray:
    """The Hilbert key of each text's projected word vector."""
    out = []
    for lo, hi in chunks(texts):
        h, first = hashed_words([t.lower() for t in texts[lo:hi]])
        n = np.maximum(np.diff(first), 1)
        point = []
        for d in range(dims):
            # a word's coordinate: one byte of its hash, centred
            value = ((h >> np.uint64(8 * d)) & np.uint64(255)) \
                .astype(np.float64) - 127.5
            sums = np.concatenate(([0.0], np.cumsum(value)))
            point.append((sums[first[1:]] - sums[first[:-1]]) / n)
        unit = np.tanh(np.stack(point, axis=1) / 24.0)
        top = (1 << bits) - 1
        out.append(hilbert_key(np.rint((unit + 1) / 2 * top), bits))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tokenised(docs: DataFrame, key: str, text: str, tokenizer: str,
              end: int, dims: int, bits: int) -> DataFrame:
    """row, key, curve, n, ids (compressed) of every document."""
    def rows(batches):
        enc = encoder(tokenizer, end, True)
        pack = zstandard.ZstdCompressor(level=1)
        base, seen = TaskContext.get().partitionId() << 33, 0
        for batch in sliced(batches, 1):
            texts = ["" if t is None else t
                     for t in batch.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            curve = curve_places(raw, dims, bits)
            n, packed = [], []
            for lo, hi in chunks(raw):
                for ids in enc.encode(texts[lo:hi]):
                    n.append(len(ids) // 4)
                    ids = np.frombuffer(ids, "<u4")
                    small = ids.astype("<u2") if ids.max() < 65536 else ids
                    packed.append(bytes([small.itemsize]) + pack.compress(
                        small.tobytes()))
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(base + seen, base + seen + m)),
                 batch.column(0), pa.array(curve, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                names=["row", "key", "curve", "n", "ids"])
            seen += m
    return docs.select(F.col(key).cast("long").alias("key"),
                       F.col(text).cast("string").alias("text")) \
        .mapInArrow(rows, "row long, key long, curve long, n long, "
                          "ids binary")


def stream_offsets(rows: DataFrame, order: list[str], row: str,
                   n: str) -> DataFrame:
    """row, before: the sum of ``n`` over all rows earlier in ``order``."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def running(batches):
        pid, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            sums = total + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(sizes), pa.int32()), batch.column(0),
                 pa.array(sums - sizes, pa.int64()),
                 pa.array(sums, pa.int64())],
                names=["part", "row", "local", "upto"])
            total = int(sums[-1]) if len(sums) else total
    local = pin(rows.repartitionByRange(parts, *order)
                .sortWithinPartitions(*order).select(row, n)
                .mapInArrow(running,
                            "part int, row long, local long, upto long"))
    base, shift = [], 0
    for part, upto in sorted(
            (r[0], r[1]) for r in local.groupBy("part")
            .agg(F.max("upto")).collect()):  # one number a partition
        base.append((part, shift))
        shift += upto
    # an Arrow table: a list of rows would go through Python workers
    base = spark.createDataFrame(pa.table(
        {"part": pa.array([p for p, _ in base], pa.int32()),
         "shift": pa.array([s for _, s in base], pa.int64())}))
    return local.join(base, "part").select(
        "row", (F.col("local") + F.col("shift")).alias("before"))


def pack_along_curve(docs: DataFrame, tokenizer: str, key: str = "doc_id",
                     text: str = "text", length: int = 2048, end: int = 1,
                     dims: int = 4, bits: int = 8,
                     with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; ``with_ids`` adds the piece's ids (little-endian
    unsigned 32-bit)."""
    bound_batches(docs.sparkSession)
    held = stash(tokenised(docs, key, text, tokenizer, end, dims, bits),
                 "tokens")
    before = stream_offsets(held, ["curve", "key", "row"], "row", "n")
    shape = "key long, start long, length long, ids_crc32 long, " \
        "doc_tokens long, sequence_id long, offset long, ids binary"
    names = [x.split()[0] for x in shape.split(", ")]

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in names]
            for k, n, ids, at in zip(*(batch.column(i).to_pylist()
                                       for i in range(4))):
                ids = np.frombuffer(unpack.decompress(ids[1:]),
                                    f"<u{ids[0]}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    m = min(n - start, length - offset)
                    piece = ids[4 * start:4 * (start + m)]
                    for column, x in zip(out, (
                            k, start, m, zlib.crc32(piece), n, seq, offset,
                            piece if with_ids else None)):
                        column.append(x)
                    start += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:-1]] +
                [pa.array(out[-1], pa.binary())], names=names)
    pieces = held.join(before, "row").select("key", "n", "ids", "before") \
        .mapInArrow(cut, shape).withColumnRenamed("key", key)
    return pieces if with_ids else pieces.drop("ids")
