"""Repeated word sequences by FM-indexes, one per shard.

A window is ``window`` consecutive words of one document; it repeats if the
same word sequence starts earlier (smaller key, or same key and earlier
start).  Words covered by a repeating window are removed.

A document is a key and a text: rows are told apart by the key and a 64-bit
hash of key and text, so rows that share a key, or have none, keep their own
starts.  Among documents of one key the hash is the order.

Every window has an anchor, the smallest hash of its ``gram``-word runs (the
last place of it), so equal windows have equal anchors.  Consecutive windows
whose anchor is the same place form a segment.  Segments whose anchor occurs
once in the corpus cannot repeat and drop out by counting (aggregated
map-side, joined back).  Equal segments fall into one, with the earliest
occurrence; those are dealt to shards by anchor.
A shard builds an FM-index of its segments - a BWT in a wavelet matrix over
the shard's own alphabet - and streams the segments through backward search:
matching statistics up to ``window`` words, whose suffix range holds all
occurrences of a window and thus the earliest.  Segments learn the earliest
occurrence of each of their windows, and every occurrence that is not the
earliest is reported.

An anchor in very many different contexts would make one shard large.
Segments of anchors with over ``hot`` different segments are dealt in single
windows instead, by the hash of the window, after equal windows are merged.

Words are compared as 64-bit hashes.

Defined cases: null or empty text has no words; a null key counts as the
smallest; rows that repeat a key with different texts are documents of their
own; rows that repeat key and text are one document (each loses the same
words; equal starts do not repeat each other); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paysift.llm.stash import pin, stash
from paysift.llm.wavelet import FMIndex
from paysift.llm.words import (chunks, hashed_words, mix64, run_hash,
                               sliced)
from paysift.session import bound_batches

_U = np.uint64
_LOW = -(1 << 63)
_BASE = 0xC6BC279692B5CC83
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0..n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for x in (_BASE, _BACK):
            p = np.full(size, x, dtype=_U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the minimum (the last one) of every ``w`` consecutive
    values, by doubling."""
    def later(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(h[q] <= h[p], q, p)
    at, span = np.arange(len(h)), 1
    while span * 2 <= w:
        at = later(at[:-span], at[span:])
        span *= 2
    return later(at[: len(at) - (w - span)], at[w - span:]) \
        if w > span else at


def _segments(h: np.ndarray, first: np.ndarray, window: int,
              gram: int) -> tuple:
    """Of a chunk's word hashes: text, start in the text, windows, anchor
    and hash of every segment."""
    n = len(h) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, _U), np.zeros(0, _U)
    grams = run_hash(h, gram)
    spot = sliding_min(grams, window - gram + 1)
    anchor = grams[spot]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[:n] == text[window - 1:]
    new = np.ones(n, dtype=bool)
    new[1:] = (spot[1:] != spot[:-1]) | (text[1:n] != text[:n - 1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(valid.astype(np.int64), at)
    at, count = at[count > 0], count[count > 0]
    up, back = _powers(len(h))
    sums = np.concatenate((np.zeros(1, _U),
                           np.cumsum(h * up[: len(h)], dtype=_U)))
    end = at + count + window - 1
    seg = mix64((sums[end] - sums[at]) * back[at] ^ count.astype(_U))
    return text[at], at - first[text[at]], count, anchor[at], seg


_SEGMENT = "anchor long, seg long, doc long, who long, at int, n int"


def _doc(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(_LOW))


def _who(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("long"), F.coalesce(text.cast("string"),
                                                   F.lit("")))


def _docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        _doc(F.col(key)).alias("doc"),
        _who(F.col(key), F.col(text)).alias("who"),
        F.col(text).cast("binary").alias("text"))


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.to_pylist()]


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Every segment of every text (doc, who, text)."""
    def rows(batches):
        for batch in sliced(batches, 2):
            keys = batch.column(0).to_numpy()
            who = batch.column(1).to_numpy()
            texts = _texts(batch.column(2))
            for lo, hi in chunks(texts):
                h, first = hashed_words(texts[lo:hi])
                t, at, n, anchor, seg = _segments(h, first, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)),
                     pa.array(seg.view(np.int64)), pa.array(keys[lo:hi][t]),
                     pa.array(who[lo:hi][t]),
                     pa.array(at.astype(np.int32)),
                     pa.array(n.astype(np.int32))],
                    names=["anchor", "seg", "doc", "who", "at", "n"])
    return docs.mapInArrow(rows, _SEGMENT)


def with_words(docs: DataFrame, wanted: DataFrame,
               window: int) -> DataFrame:
    """The segments (as in ``wanted``) with their words' hashes; those of hot
    anchors as single windows (route: anchor, or hash of the window)."""
    lists = wanted.groupBy("doc", "who").agg(F.collect_list(
        F.struct("anchor", "seg", "at", "n", "hot")).alias("segs"))

    def rows(batches):
        for batch in sliced(batches, 2):
            keys = batch.column(0).to_pylist()
            who = batch.column(1).to_pylist()
            texts = _texts(batch.column(2))
            wants = batch.column(3)
            for lo, hi in chunks(texts):
                h, first = hashed_words(texts[lo:hi])
                out = [[] for _ in range(8)]

                def put(*row):
                    for column, x in zip(out, row):
                        column.append(x)
                for i in range(lo, hi):
                    own = h[first[i - lo]:first[i - lo + 1]]
                    for x in wants[i].as_py():
                        at, n = x["at"], x["n"]
                        w = own[at:at + n + window - 1]
                        if not x["hot"]:
                            put(x["anchor"], x["anchor"], x["seg"], keys[i],
                                who[i], at, n, w.tobytes())
                            continue
                        for o in range(n):
                            one = w[o:o + window]
                            r = int(run_hash(one, window).view(np.int64)[0])
                            put(r, x["anchor"], x["seg"], keys[i], who[i],
                                at + o, -1 - o, one.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (
                        pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                        pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["route", "anchor", "seg", "doc", "who", "at", "n",
                           "words"])
    # rows that repeat key and text give their words once
    return docs.dropDuplicates(["doc", "who"]).join(lists, ["doc", "who"]) \
        .select("doc", "who", "text", "segs").mapInArrow(
            rows, "route long, anchor long, seg long, doc long, who long, "
                  "at int, n int, words binary")


def _shard_rows(window: int):
    """Index a shard's segments and search all their windows in it."""
    def rows(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held)
        words = [np.frombuffer(w, _U) for w in
                 shard.column("words").to_pylist()]
        lens = np.array([len(w) for w in words])
        doc = shard.column("doc").to_numpy()
        row = shard.column("who").to_numpy()
        at = shard.column("at").to_numpy()
        _, code = np.unique(np.concatenate(words), return_inverse=True)
        # one text of all segments, each behind a separator 0
        begin = np.cumsum(lens + 1) - lens
        total = int((lens + 1).sum()) + 1
        codes = np.zeros(total, dtype=np.int64)
        inner = np.arange(int(lens.sum())) + \
            np.repeat(np.arange(1, len(lens) + 1), lens)
        codes[inner] = code + 1
        index = FMIndex(codes, window)
        # order of all places by (doc, who, start)
        who = np.repeat(np.arange(len(lens)), lens)
        start = at[who] + (inner - begin[who])
        order = np.lexsort((start, row[who], doc[who]))
        age = np.full(total, total, dtype=np.int64)
        age[inner[order]] = np.arange(len(order))
        n = lens - window + 1
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = begin[owner] + offset
        # equal windows are searched once
        runs = run_hash(mix64(codes.astype(_U)), window)[place]
        _, one, same = np.unique(runs, return_index=True,
                                 return_inverse=True)
        where = place[one]
        length, lo, hi = index.matching(codes, where + window, window,
                                        lone=True)
        # a search that ended early has found the window itself only; equal
        # windows share a range of suffixes, different ones do not
        oldest = age[where]
        full = np.flatnonzero((length == window) & (hi - lo > 1))
        full = full[np.argsort(lo[full])]
        if len(full):
            cut = np.column_stack((lo[full], hi[full])).ravel()
            ages = np.append(age[index.places], total)
            oldest[full] = np.minimum.reduceat(ages, cut)[::2]
        oldest = order[oldest[same]]
        bounds = np.concatenate(([0], np.cumsum(n)))
        e_who, e_at = row[who[oldest]], start[oldest]
        yield pa.RecordBatch.from_arrays(
            [shard.column(c).combine_chunks() for c in
             ("route", "anchor", "seg", "n")] +
            [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                      pa.array(e_who, pa.int64())),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                      pa.array(e_at, pa.int32()))],
            names=["route", "anchor", "seg", "n", "e_who", "e_at"])
    return rows


def search_shards(content: DataFrame, window: int,
                  shard_words: int) -> DataFrame:
    """anchor, seg, off (of a single window; else null), e_who, e_at: the
    earliest occurrence of each window of the segments."""
    shape = "route long, anchor long, seg long, n int, " \
            "e_who array<long>, e_at array<int>"
    total = content.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-total // (8 * shard_words)))
    whole = content.filter("n > 0").repartition(shards, "route") \
        .mapInArrow(_shard_rows(window), shape)
    single = content.filter("n < 0")
    merged = single.groupBy("route").agg(
        F.min(F.struct("doc", "who", "at")).alias("m"), F.first("words")
        .alias("words")) \
        .select("route", F.lit(0).cast("long").alias("anchor"),
                F.lit(0).cast("long").alias("seg"), "m.doc", "m.who",
                "m.at", F.lit(1).alias("n"), "words")
    found = merged.repartition(shards, "route") \
        .mapInArrow(_shard_rows(window), shape) \
        .select("route", "e_who", "e_at")
    single = single.select("route", "anchor", "seg",
                           (-1 - F.col("n")).alias("off")) \
        .join(found, "route").select("anchor", "seg", "off", "e_who", "e_at")
    return whole.select("anchor", "seg", F.lit(None).cast("int")
                        .alias("off"), "e_who", "e_at").union(single)


def _survivors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    found = segments(docs, window, gram)
    # pinned, so that both sides of the join are plain shuffles, of which
    # Spark splits the partition of an anchor with very many segments
    again = pin(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
                .filter("c > 1").select("anchor"))
    return stash(found.join(again, "anchor")
                 .select("anchor", "seg", "doc", "who", "at", "n"),
                 "segments")


def _earliest(docs: DataFrame, kept: DataFrame, window: int,
              hot: int, shard_words: int) -> DataFrame:
    """The earliest occurrences of the windows of all kept segments."""
    once = kept.groupBy("anchor", "seg").agg(
        F.min(F.struct("doc", "who", "at", "n")).alias("m")) \
        .select("anchor", "seg", "m.doc", "m.who", "m.at", "m.n")
    many = once.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")) \
        .filter(F.col("c") > hot).select("anchor", F.lit(True).alias("hot"))
    once = once.join(many, "anchor", "left") \
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
    content = stash(with_words(docs, once, window), "content")
    # written, so that the shards' shuffles are gone before the join begins
    return stash(search_shards(content, window, shard_words), "earliest")


def repeated_starts(docs: DataFrame, key: str = "doc_id",
                    text: str = "text", window: int = 20, gram: int = 5,
                    hot: int = 20_000,
                    shard_words: int = 1 << 18) -> DataFrame:
    """doc, who, starts: where windows that occurred earlier start, for the
    documents that have any (a null key is the smallest long)."""
    bound_batches(docs.sparkSession)
    docs = _docs(docs, key, text)
    kept = _survivors(docs, window, gram)
    early = _earliest(docs, kept, window, hot, shard_words)
    at = F.col("at") + F.coalesce("off", F.lit(0))
    repeats = F.filter(
        F.transform(F.col("e_who"), lambda d, i: F.when(
            (d != F.col("who")) | (F.get("e_at", i) != at + i), at + i)),
        lambda x: x.isNotNull())
    return stash(
        kept.join(early, ["anchor", "seg"])
        .select("doc", "who", repeats.alias("s")).filter(F.size("s") > 0)
        .groupBy("doc", "who").agg(
            F.flatten(F.collect_set("s")).alias("starts")), "starts")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at ``starts``."""
    delta = np.zeros(n + 1, dtype=np.int32)
    starts = np.unique(starts[starts <= n - window])
    delta[starts] += 1
    delta[np.minimum(starts + window, n)] -= 1
    return np.cumsum(delta[:n]) > 0


def strip_repeats(docs: DataFrame, starts: DataFrame, key: str = "doc_id",
                  text: str = "text", window: int = 20,
                  digest: bool = False) -> DataFrame:
    """All rows of ``docs`` with n_words and n_removed, and the text without
    the covered words (kept words joined by one blank; texts that lose none
    stay as they are).  With ``digest``, instead key, n_words, n_removed and
    kept_sha256 of the kept words."""
    schema = docs.schema
    if digest:
        docs = docs.select(key, text)
    else:
        docs = docs.drop("n_words", "n_removed")
        schema = docs.schema
    own, said = F.col(f"d.{key}"), F.col(f"d.{text}")
    rows = docs.alias("d").join(
        starts.alias("s"), (_doc(own) == F.col("s.doc"))
        & (_who(own, said) == F.col("s.who")), "left") \
        .select("d.*", "s.starts")
    names = docs.columns
    place = names.index(text)

    def cut(batches):
        for batch in sliced(batches, place):
            removed, n_words, texts, sha = [], [], [], []
            for t, s in zip(batch.column(place).to_pylist(),
                            batch.column(batch.num_columns - 1)):
                words = (t or "").encode().split()
                n, gone = len(words), 0
                if s.is_valid:
                    out = covered(n, s.values.to_numpy(), window)
                    gone = int(out.sum())
                    words = [w for w, x in zip(words, out) if not x]
                n_words.append(n)
                removed.append(gone)
                if digest:
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    texts.append(b" ".join(words).decode() if gone else t)
            counts = [pa.array(n_words, pa.int64()),
                      pa.array(removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *counts, pa.array(sha, pa.string())],
                    names=[key, "n_words", "n_removed", "kept_sha256"])
                continue
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                columns + counts, names=names + ["n_words", "n_removed"])
    if digest:
        kind = docs.schema[key].dataType.simpleString()
        return rows.mapInArrow(cut, f"`{key}` {kind}, n_words long, "
                                    "n_removed long, kept_sha256 string")
    return rows.mapInArrow(cut, StructType(
        schema.fields + [StructField("n_words", LongType()),
                         StructField("n_removed", LongType())]))
