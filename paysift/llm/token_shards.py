"""Token files: a wavelet matrix per shard.

Documents are range-sorted by key and tokenised; a shard holds the ids of
consecutive documents, about ``shard_tokens`` of them, as a wavelet matrix:
succinct bit-planes with rank and select, compressed into one block with the
documents' keys and lengths.  From that block alone a reader gets any token
(access), the number of occurrences of an id (rank), and where they are
(select).

A task writes its shards one after the other and holds one at a time.  Shards
are rows of a Parquet folder, so they go to any store Spark can write.

Defined cases: null text is empty and has the end id only; a null key comes
first; rows with equal keys follow each other in any order; a document longer
than a shard makes one longer shard; an empty table gives no shards; extra
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paysift.llm.bpe import encoder
from paysift.llm.wavelet import WaveletMatrix
from paysift.llm.words import chunks

_NO_KEY = -(1 << 63)
_MAGIC = b"WMS1"


def shard_bytes(keys: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard: magic, number of documents, size of the directory, the
    directory (keys, lengths), the wavelet matrix."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    small = ids.astype(np.uint16) if bits <= 16 else ids
    keys = [_NO_KEY if k is None else k for k in keys]
    listed = zstandard.ZstdCompressor(level=3).compress(
        np.array(keys, "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    return _MAGIC + struct.pack("<QQ", len(keys), len(listed)) + listed + \
        WaveletMatrix.of(small, bits).to_bytes()


class Shard:
    """Reads one shard."""

    def __init__(self, data: bytes):
        data = bytes(data)
        if data[:4] != _MAGIC:
            raise ValueError("not a shard")
        n, size = struct.unpack_from("<QQ", data, 4)
        listed = np.frombuffer(zstandard.ZstdDecompressor().decompress(
            data[20:20 + size]), "<i8")
        self.keys, self.lengths = listed[:n], listed[n:]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.matrix = WaveletMatrix.from_bytes(data[20 + size:])

    def tokens(self, doc: int) -> np.ndarray:
        """The ids of the ``doc``-th document, by access."""
        return self.matrix.access(
            np.arange(self.lengths[doc]) + self.starts[doc])

    def count(self, token: int) -> int:
        """How often an id occurs in the shard."""
        if token >> self.matrix.bits:
            return 0
        return int(self.matrix.rank([token], [self.matrix.n])[0])

    def places(self, token: int) -> np.ndarray:
        """Where an id occurs, by select."""
        n = self.count(token)
        return self.matrix.select(np.full(n, token), np.arange(n))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 2,
                 key: str = "doc_id", text: str = "text",
                 shard_tokens: int = 1 << 21) -> None:
    """Write the ids of all documents, ascending by key, to ``path``."""
    def rows(batches):
        enc = encoder(tokenizer, end, False)
        pid, made = TaskContext.get().partitionId(), 0
        keys, lengths, held = [], [], []

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([made], pa.int32()),
                 pa.array([len(ids)], pa.int64()),
                 pa.array([shard_bytes(keys, lengths, ids)], pa.binary())],
                names=["part", "shard", "n_tokens", "data"])
        total = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = ["" if t is None else t
                     for t in batch.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            at = 0
            for lo, hi in chunks(raw, 1 << 20):
                for ids in enc.encode(texts[lo:hi]):
                    keys.append(own[at])
                    lengths.append(len(ids) // 4)
                    held.append(ids)
                    total += lengths[-1]
                    at += 1
                    if total >= shard_tokens:
                        yield shard()
                        made, total = made + 1, 0
                        keys, lengths, held = [], [], []
        if keys:
            yield shard()
    parts = max(1, int(docs.sparkSession.conf.get(
        "spark.sql.shuffle.partitions")))
    docs.select(F.col(key).cast("long").alias("key"),
                F.col(text).cast("string").alias("text")) \
        .repartitionByRange(parts, "key").sortWithinPartitions("key") \
        .mapInArrow(rows, "part int, shard int, n_tokens long, data binary") \
        .write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str,
                key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.schema(
        "part int, shard int, n_tokens long, data binary").parquet(path)

    def rows(batches):
        for batch in batches:
            for part, shard, data in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    batch.column(2)):
                s = Shard(data.as_py())
                ids = s.matrix.decode(
                    np.uint16 if s.matrix.bits <= 16 else np.uint32)
                ids = ids.astype("<u4").tobytes()
                m = len(s.keys)
                crc = [zlib.crc32(ids[4 * a:4 * (a + n)]) for a, n in
                       zip(s.starts.tolist(), s.lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * m, pa.int32()),
                     pa.array([shard] * m, pa.int32()),
                     pa.array(s.keys, mask=s.keys == _NO_KEY),
                     pa.array(s.starts, pa.int64()),
                     pa.array(s.lengths, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=["part", "shard", "key", "local", "n_tokens",
                           "ids_crc32"])
    # one row a shard: the ids before it
    order = Window.orderBy("part", "shard") \
        .rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("part", "shard", F.coalesce(
        F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    docs = files.select("part", "shard", "data").mapInArrow(
        rows, "part int, shard int, key long, local long, n_tokens long, "
              "ids_crc32 long")
    return docs.join(before, ["part", "shard"]).select(
        F.col("key").alias(key),
        (F.col("before") + F.col("local")).alias("start"), "n_tokens",
        "ids_crc32")
