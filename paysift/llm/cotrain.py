"""Quality classifier by co-training.

Two views of a page: its text (words present, shares of character classes,
repeated lines) and its metadata (source, language, length).  Each view has a
logistic regression.  Starting from labelled rows, in every round each view
labels the unlabelled rows it is most sure of for the other one, and both are
fitted again.  Each view is calibrated on labelled rows it was not fitted on
(Platt scaling); the log-odds of both, less the prior's, add up to the score
of every document.

Fitting uses a bounded sample: ``sample_rows`` labelled rows and as many
others, picked by hash; the driver holds their features.  Scoring reads every
whole text in one pass without a shuffle.  A text's words enter as presence
of the words that tell good from bad rows by a z-score of ``least_z``.

A row is good if its label says quality 1 and not toxic.  Defined cases: null
or empty text has no words and zero shares; null or missing metadata is a
value of its own; rows with null labels or null key teach nothing; a row
labelled twice is bad if one label says so; without labels of both kinds
every row is kept with score 1; repeated rows score alike; an empty table
gives an empty result; extra columns are kept apart (only the key and the
scores are returned).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, StructField,
                               StructType)

from paysift.llm.bpe import forget
from paysift.llm.words import chunks, hashed_words, sliced
from paysift.session import bound_batches

_U = np.uint64
#: Letters and digits stay, other ASCII separates words.
_ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32
               for b in range(256))
#: Character classes: lower, upper, digit, white space, symbol, other
#: punctuation, other bytes.
_CLASS = np.full(256, 5, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = 6
    elif _c.islower():
        _CLASS[_b] = 0
    elif _c.isupper():
        _CLASS[_b] = 1
    elif _c.isdigit():
        _CLASS[_b] = 2
    elif _c in " \t\n\r\x0b\x0c":
        _CLASS[_b] = 3
    elif _c in "#*$%&|<>":
        _CLASS[_b] = 4
N_SHAPE = 10


def text_view(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct word hashes and the shape of each text."""
    words, shape = [], np.zeros((len(texts), N_SHAPE))
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        h, first = hashed_words([t.lower().translate(_ALNUM) for t in part])
        kind = _CLASS[np.frombuffer(b"".join(part), np.uint8)]
        at = np.concatenate(([0], np.cumsum([len(t) for t in part])))
        for i, t in enumerate(part):
            own = h[first[i]:first[i + 1]]
            words.append(np.unique(own))
            n = max(1, len(t))
            share = np.bincount(kind[at[i]:at[i + 1]], minlength=7) / n
            lines = [x for x in t.split(b"\n") if x]
            shape[lo + i] = [*share, len(own) / n * 5,
                             1 - len(set(lines)) / len(lines) if lines
                             else 0.0,
                             len(words[-1]) / max(1, len(own))]
    return words, shape


def meta_view(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Hashed one-hot places of metadata: numbers by their power of two."""
    out = np.zeros((batch.num_rows, len(names)), dtype=np.int64)
    for j, name in enumerate(names):
        column = batch.column(batch.schema.names.index(name))
        for i, x in enumerate(column.to_pylist()):
            if isinstance(x, (int, float)) and x == x:
                x = int(np.log2(1 + abs(x)) * 2) if abs(x) < 1e300 else -1
            out[i, j] = zlib.crc32(f"{name}={x}".encode()) & 4095
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray,
                 ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps for ridge logistic regression; the last column of ``x``
    is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        s = weight * p * (1 - p)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), g)
        w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds."""
    one = np.column_stack((z, np.ones(len(z))))
    a, b = fit_logistic(one, y, np.ones(len(y)), ridge=1e-2)
    return max(0.0, float(a)), float(b)


def telling_words(words: list[np.ndarray], y: np.ndarray, least_z: float,
                  most: int) -> np.ndarray:
    """Words whose share among good and bad rows differs by ``least_z``
    standard errors, at most ``most`` (the strongest)."""
    every = np.concatenate(words) if words else np.zeros(0, _U)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    uniq, back = np.unique(every, return_inverse=True)
    good = np.bincount(back, weights=y[row], minlength=len(uniq))
    n = np.bincount(back, minlength=len(uniq))
    n1, n0 = y.sum(), len(y) - y.sum()
    p = (n + 1) / (len(y) + 2)
    z = (good / n1 - (n - good) / n0) / np.sqrt(
        p * (1 - p) * (1 / n1 + 1 / n0))
    strong = np.flatnonzero((np.abs(z) >= least_z) & (n >= 5))
    strong = strong[np.argsort(-np.abs(z[strong]), kind="stable")][:most]
    return np.sort(uniq[strong])


def presence(words: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(chosen)))
    for i, w in enumerate(words):
        if len(chosen) and len(w):
            at = np.minimum(np.searchsorted(chosen, w), len(chosen) - 1)
            out[i, at[chosen[at] == w]] = 1
    return out


class Model:
    """The two fitted and calibrated views."""

    def __init__(self, chosen, centre, scale, places, weights, scaling,
                 prior):
        self.chosen, self.centre, self.scale = chosen, centre, scale
        self.places, self.weights = places, weights
        self.scaling, self.prior = scaling, prior

    def text_x(self, words, shape) -> np.ndarray:
        return np.column_stack((
            presence(words, self.chosen),
            np.clip((shape - self.centre) / self.scale, -8, 8),
            np.ones(len(words))))

    def meta_x(self, meta) -> np.ndarray:
        out = np.zeros((len(meta), len(self.places) + 1))
        out[:, -1] = 1
        if len(self.places):
            at = np.minimum(np.searchsorted(self.places, meta),
                            len(self.places) - 1)
            ok = self.places[at] == meta
            row = np.broadcast_to(np.arange(len(meta))[:, None], at.shape)
            out[row[ok], at[ok]] = 1
        return out

    def odds(self, x, view: int) -> np.ndarray:
        """Calibrated log-odds of a view."""
        a, b = self.scaling[view]
        return a * (x @ self.weights[view]) + b

    def score(self, words, shape, meta) -> tuple:
        t = self.odds(self.text_x(words, shape), 0)
        m = self.odds(self.meta_x(meta), 1)
        def sig(z): return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sig(t), sig(m), sig(t + m - self.prior)


def cotrain(words, shape, meta, y, pool_words, pool_shape, pool_meta,
            rounds: int = 3, sure: float = 0.97, least_z: float = 5.0,
            most_words: int = 400) -> Model:
    """Fit both views on labelled rows (``y``) and an unlabelled pool."""
    fold = np.arange(len(y)) % 4 == 3  # for calibration
    fit = ~fold
    if len(set(y[fit])) < 2 or len(set(y[fold])) < 2:
        fit = fold = np.ones(len(y), dtype=bool)
    chosen = telling_words([w for w, f in zip(words, fit) if f], y[fit],
                           least_z, most_words)
    centre, scale = shape[fit].mean(axis=0), shape[fit].std(axis=0) + 1e-3
    prior = float(np.log(y.mean() / (1 - y.mean())))
    model = Model(chosen, centre, scale, np.unique(meta), [None, None],
                  [(1.0, 0.0), (1.0, 0.0)], prior)
    x = [model.text_x(words, shape), model.meta_x(meta)]
    pool = [model.text_x(pool_words, pool_shape), model.meta_x(pool_meta)]
    given = [np.zeros(len(pool[0]), dtype=bool) for _ in x]  # to each view
    label = [np.zeros(len(pool[0])) for _ in x]
    for turn in range(rounds + 1):
        for v in (0, 1):
            model.weights[v] = fit_logistic(
                np.concatenate((x[v][fit], pool[v][given[v]])),
                np.concatenate((y[fit], label[v][given[v]])),
                np.concatenate((np.ones(int(fit.sum())),
                                np.full(int(given[v].sum()), 0.5))))
            model.scaling[v] = platt(x[v][fold] @ model.weights[v],
                                     y[fold])
        if turn == rounds or not len(pool[0]):
            break
        for v in (0, 1):  # view v teaches the other one
            z = model.odds(pool[v], v)
            limit = np.log(sure / (1 - sure))
            confident = np.abs(z) >= limit
            given[1 - v] = confident
            label[1 - v] = (z > 0).astype(float)
    return model


def sample_features(docs: DataFrame, ids: DataFrame, key: str, text: str,
                    meta: list[str]) -> list:
    """Features of the rows named by the bounded table ``ids`` (id, y)."""
    def rows(batches):
        for batch in sliced(batches, 1):
            words, shape = text_view(
                [(t or "").encode() for t in batch.column(1).to_pylist()])
            places = meta_view(batch, meta)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2),
                 pa.array([w.tobytes() for w in words], pa.binary()),
                 pa.array(list(shape), pa.list_(pa.float64())),
                 pa.array(list(places), pa.list_(pa.int64()))],
                names=["key", "y", "words", "shape", "meta"])
    found = docs.join(F.broadcast(ids), docs[key] == ids["__id"]) \
        .select(F.col(key), F.col(text).cast("string"),
                F.col("__y").cast("double"), *meta) \
        .mapInArrow(rows, "key string, y double, words binary, "
                          "shape array<double>, meta array<long>")
    return sorted(found.collect(), key=lambda r: (r["key"], r["words"]))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str, text: str,
                meta: list[str], sample_rows: int) -> Model | None:
    first = F.xxhash64(F.lit("co"), F.col("__id"))
    known = labels.filter(F.col(key).isNotNull()
                          & F.col("quality").isNotNull()) \
        .groupBy(F.col(key).alias("__id")).agg(
            F.min(((F.col("quality") == 1)
                   & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
                  .cast("int")).alias("__y"))
    some = known.orderBy(first, "__id").limit(sample_rows)
    others = docs.select(F.col(key).alias("__id")).filter(
        F.col("__id").isNotNull()).distinct() \
        .join(known, "__id", "left_anti") \
        .orderBy(first, "__id").limit(sample_rows) \
        .withColumn("__y", F.lit(None).cast("int"))

    def table(rows):
        return ([np.frombuffer(r["words"], _U) for r in rows],
                np.array([r["shape"] for r in rows]).reshape(-1, N_SHAPE),
                np.array([r["meta"] for r in rows], dtype=np.int64)
                .reshape(len(rows), len(meta)))
    known_rows = sample_features(docs, some, key, text, meta)
    # a fixed shuffle, so that folds do not follow the keys
    order = np.random.default_rng(0).permutation(len(known_rows))
    known_rows = [known_rows[i] for i in order]
    y = np.array([r["y"] for r in known_rows])
    if len(set(y.tolist())) < 2:
        return None
    pool = sample_features(docs, others, key, text, meta)
    return cotrain(*table(known_rows), y, *table(pool))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id",
                   text: str = "text",
                   meta: tuple[str, ...] = ("source", "lang", "n_chars"),
                   sample_rows: int = 6000, threshold: float = 0.5,
                   carry: bool = False) -> DataFrame:
    """key, p_text, p_meta, score, kept for every row; with ``carry`` all
    columns of ``docs`` and these four (replacing equal names)."""
    bound_batches(docs.sparkSession)
    added = ["p_text", "p_meta", "score", "kept"]
    docs = docs.drop(*added)
    meta = [m for m in meta if m in docs.columns]
    model = fit_quality(docs, labels, key, text, meta, sample_rows)
    rows = docs if carry else docs.select(
        *dict.fromkeys([key, text, *meta]))
    names = rows.columns
    out = names if carry else [key]

    def score(batches):
        forget()
        for batch in sliced(batches, names.index(text)):
            n = batch.num_rows
            if model is None:
                p = [np.ones(n)] * 3
            else:
                words, shape = text_view([
                    (t or "").encode() for t in
                    batch.column(names.index(text)).to_pylist()])
                p = model.score(words, shape, meta_view(batch, meta))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in out] +
                [pa.array(x) for x in p] + [pa.array(p[2] >= threshold)],
                names=out + added)
    return rows.mapInArrow(score, StructType(
        [rows.schema[c] for c in out] +
        [StructField(c, DoubleType()) for c in added[:3]] +
        [StructField("kept", BooleanType())]))
