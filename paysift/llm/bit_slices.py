"""Exact top-k inner products from a bit-sliced index.

Vectors are quantised to integers, floor(scale * x).  Rows are dealt to blocks
of about ``block`` rows, in order of their ids; an index row holds, for every
attribute of a block, the smallest value and the bit slices of the values above
it (slice i has a bit a row: bit i of its value).

A query's scores are added up in bitmap arithmetic.  Its components are
recoded to signed powers of two; each digit adds an attribute's slices, moved
by the digit's place, or their complements for a negative digit (minus a
constant).  Carry-save adders reduce the slices of every place to one, which
leaves the score's slices.  From the most significant slice downward, rows with
a set bit are taken while they are not too many, else the others are left out.
What is undecided after the last slice are rows of equal score at the boundary;
they are resolved exactly, in order of their ids.  The winners' scores are read
back from the slices, and the blocks' winners of a query are ranked.

Every query meets every block, so work is queries x rows / 64 words; blocks
are dealt to tasks, and if they are few, several lanes share a block's queries.

Defined cases: vectors that are null, hold null or non-finite components, or
components so large that a sum could leave a long (length x component ** 2 over
2 ** 58) take no part; vectors are compared with those of their length
only; null ids are no queries and come before all ids among ties; rows that
repeat an id are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.runs import grouped
from paysift.llm.stash import stash

_U = np.uint64


def quantised(rows: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """row (a number of its own), key, dim, v (array of long)."""
    x = F.transform(F.col(vec), lambda c: c.cast("double") * float(scale))
    rows = rows.select(F.col(key).cast("long").alias("key"), x.alias("x"))
    whole = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)
                                & (F.abs(c) < F.lit(float("inf")))),
                       F.lit(False))
    most = F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)) + 1
    rows = rows.filter(whole).filter(
        F.size("x") * most * most <= float(2 ** 58))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "key",
        F.size("x").alias("dim"),
        F.transform("x", lambda c: F.floor(c)).alias("v"))


def sliced(values: np.ndarray) -> np.ndarray:
    """Bit slices (slice, word) of non-negative values, lowest first."""
    n, top = len(values), int(values.max(initial=0))
    words = -(-n // 64)
    bits = np.zeros(words * 64, np.uint64)
    bits[:n] = values
    return np.stack([np.packbits((bits >> _U(i)).astype(np.uint8) & 1,
                                 bitorder="little").view(_U)
                     for i in range(top.bit_length())]) \
        if top else np.zeros((0, words), _U)


class SlicedBlock:
    """Rows of one block: per attribute the smallest value and the slices of
    what lies above it."""

    def __init__(self, n: int, low: np.ndarray, width: np.ndarray,
                 planes: np.ndarray):
        self.n, self.low, self.width = n, low, width
        self.words = -(-n // 64)
        # slices, and their complements behind them
        self.planes = np.concatenate((planes, ~planes))
        self.first = np.cumsum(width) - width
        self.valid = sliced(np.ones(n, np.int64))[0]

    @classmethod
    def of(cls, v: np.ndarray) -> SlicedBlock:
        low = v.min(axis=0)
        planes = [sliced(v[:, j] - low[j]) for j in range(v.shape[1])]
        width = np.array([len(p) for p in planes], np.int64)
        return cls(len(v), low, width, np.concatenate(
            [np.zeros((0, -(-len(v) // 64)), _U), *planes]))

    def _addends(self, q: np.ndarray) -> tuple[list[list[int]], int]:
        """Numbers of the slices to add at every place, and the constant
        that the sum lacks."""
        half = len(self.planes) // 2
        places: list[list[int]] = []
        rest = sum(int(x) * int(y) for x, y in zip(q, self.low))
        for j, x in enumerate(q.tolist()):
            at, first, width = 0, int(self.first[j]), int(self.width[j])
            while x and width:
                if x & 1:
                    sign = 2 - (x & 3)  # digits 1 and -1, never adjacent
                    x -= sign
                    while len(places) < at + width:
                        places.append([])
                    skip = first if sign > 0 else half + first
                    for i in range(width):
                        places[at + i].append(skip + i)
                    if sign < 0:  # the complement is 2**width - 1 - value
                        rest -= ((1 << width) - 1) << at
                x >>= 1
                at += 1
        return places, rest

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the scores less a constant, and the constant."""
        places, rest = self._addends(q)
        out, carried = [], np.zeros((0, self.words), _U)
        at = 0
        while at < len(places) or len(carried):
            held = carried
            if at < len(places) and places[at]:
                held = np.concatenate((self.planes[places[at]], carried))
            carries = []
            while len(held) > 2:  # three slices into a sum and a carry
                k = len(held) // 3
                a, b, c = held[:k], held[k:2 * k], held[2 * k:3 * k]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                held = np.concatenate((odd ^ c, held[3 * k:]))
            if len(held) == 2:
                carries.append((held[0] & held[1])[None])
                held = (held[0] ^ held[1])[None]
            out.append(held[0] if len(held) else
                       np.zeros(self.words, _U))
            carried = np.concatenate(carries) if carries else \
                np.zeros((0, self.words), _U)
            at += 1
        return np.array(out, _U).reshape(len(out), self.words), rest

    def top(self, q: np.ndarray, k: int, but: int = -1
            ) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` highest rows, without ``but``;
        earlier places first among equal scores."""
        slices, rest = self.scores(q)
        taken = np.zeros(self.words, _U)
        level = self.valid.copy()
        if but >= 0:
            level[but >> 6] &= ~(_U(1) << _U(but & 63))
        missing = k
        for s in slices[::-1]:
            ones = level & s
            n = int(np.bitwise_count(ones).sum())
            if n > missing:
                level = ones
            else:
                taken |= ones
                level &= ~s
                missing -= n
                if not missing:
                    break
        at = places_of(taken)
        if missing:  # equal scores at the boundary
            at = np.concatenate((at, places_of(level)[:missing]))
        bit = (slices[:, at >> 6] >> (at & 63).astype(_U)) & _U(1)
        value = np.zeros(len(at), np.int64)
        for i, b in enumerate(bit):
            value += b.astype(np.int64) << i
        return at, value + rest


def places_of(bitmap: np.ndarray) -> np.ndarray:
    """Places of the set bits."""
    some = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[some].view(np.uint8), bitorder="little")
    at = np.flatnonzero(bits)
    return some[at >> 6] * 64 + (at & 63)


_INDEX = "dim int, block int, n int, low array<long>, width array<long>, " \
         "planes binary, keys array<long>, rows array<long>"


def build_index(rows: DataFrame, block: int) -> DataFrame:
    """One row a block: its bit slices, ids and rows; from ``quantised``."""
    size = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(size, "dim").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def work(batches):
        for t in grouped(batches, [0, 1]):
            dim = t.column(0)[0].as_py()
            v = _vectors(t.column(4), dim)
            b = SlicedBlock.of(v)
            half = len(b.planes) // 2
            yield pa.RecordBatch.from_pylist([{
                "dim": dim, "block": t.column(1)[0].as_py(), "n": b.n,
                "low": b.low.tolist(), "width": b.width.tolist(),
                "planes": b.planes[:half].tobytes(),
                "keys": t.column(2).to_pylist(),
                "rows": t.column(3).to_pylist()}], schema=_schema())
    by = ["dim", "block"]
    return dealt.select(*by, "key", "row", "v").repartition(*by) \
        .sortWithinPartitions(*by, F.asc_nulls_first("key"), "row") \
        .mapInArrow(work, _INDEX)


def _schema() -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema([("dim", pa.int32()), ("block", pa.int32()),
                      ("n", pa.int32()), ("low", many), ("width", many),
                      ("planes", pa.binary()), ("keys", many),
                      ("rows", many)])


def _vectors(column, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(
        column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), dim)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q_row, q_key, key, score: each block's ``k`` best rows of every query
    (row, key, dim, v), without the query's own row."""
    spark = index.sparkSession
    size = index.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"),
                                    F.max("block").alias("last"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = size.withColumn(
        "lanes", F.ceil(F.lit(parts) / F.col("blocks")).cast("int"))
    by = ["dim", "block", "lane"]
    blocks = index.join(size, "dim").withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))) \
        .select(*by, F.lit(-1).cast("long").alias("row"), "n", "low",
                "width", "planes", "keys", "rows")
    asked = queries.join(size, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("last")))
        .alias("block"),
        F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int").alias("lane"),
        "row", F.lit(0).alias("n"), F.col("v").alias("low"),
        F.array("key").alias("keys"))

    def work(batches):
        for t in _met(batches):
            block, keys, place = None, None, {}
            for part in t:
                if block is None:
                    if part.column(3)[0].as_py() != -1:
                        break  # no row was dealt to this block
                    block, keys, rows = _read_block(part)
                    place = {r: i for i, r in enumerate(rows)}
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                dim = part.column(0)[0].as_py()
                asked = part.column(3).to_pylist()
                q_key = part.column(8).to_pylist()
                out = [[], [], [], []]
                for row, key, q in zip(asked, q_key,
                                       _vectors(part.column(5), dim)):
                    at, score = block.top(q, k, place.get(row, -1))
                    out[0] += [row] * len(at)
                    out[1] += key * len(at)
                    out[2] += [keys[i] for i in at.tolist()]
                    out[3] += score.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out],
                    names=["q_row", "q_key", "key", "score"])
    return blocks.unionByName(asked, allowMissingColumns=True) \
        .repartition(*by).sortWithinPartitions(*by, "row") \
        .mapInArrow(work, "q_row long, q_key long, key long, score long")


def _read_block(part: pa.RecordBatch) -> tuple:
    n, low, width, planes, keys, rows = (
        part.column(i)[0].as_py() for i in range(4, 10))
    words = -(-n // 64)
    block = SlicedBlock(n, np.array(low, np.int64),
                        np.array(width, np.int64),
                        np.frombuffer(planes, _U).reshape(-1, words))
    return block, keys, rows


def _met(batches):
    """For every (dim, block, lane) its stream of batches: the block's row
    first, then queries."""
    held = [None, None]  # the present key, a batch not yet read

    def cuts():
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield tuple(keys[:, lo].tolist()), batch.slice(lo, hi - lo)
    stream = cuts()

    def one():
        while held[1] is not None and held[1][0] == held[0]:
            yield held[1][1]
            held[1] = next(stream, None)
    held[1] = next(stream, None)
    while held[1] is not None:
        held[0] = held[1][0]
        group = one()
        yield group
        for _ in group:  # what the caller left
            pass


def top_inner_products(rows: DataFrame, key: str = "vec_id",
                       vec: str = "embedding", every: int = 100,
                       k: int = 10, scale: int = 1024,
                       block: int = 1 << 15) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose key ``every``
    divides the ``k`` other rows of the highest scores, smaller keys first
    among equal ones."""
    whole = stash(quantised(rows, key, vec, scale), "quantised")
    index = stash(build_index(whole, block), "slices")
    found = search(index, whole.filter(F.col("key") % every == 0), k)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(
        F.desc("score"), F.asc_nulls_first("key")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("q_key").alias("query_id"), "rank",
        F.col("key").alias(key), "score")
