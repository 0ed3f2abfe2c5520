"""Language identification with a bidirectional gated recurrent network.

The network reads the bytes of a letter run (a word) forwards and backwards
and gives language probabilities at every position.  A document's
probabilities are the mean over all positions of all its words.  Because
every position depends on its own word only, a worker runs the network once
per different word and keeps the sum; texts are read whole.

It is trained in numpy by backpropagation through time with Adam, on words of
a bounded sample: about ``rows_per_lang`` labelled documents of each language
and ``words_per_row`` words of each, both picked by hash.

Defined cases: null text and text without a letter give ``und`` with score 0;
rows with null text, null language or null key teach nothing; a null key is
not held out; ties go to the language first in code-point order; without
anything to learn from every row is ``und``; repeated rows are predicted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes that separate words: ASCII other than letters.
_SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32
               for b in range(256))
_PIECE = 24


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None
                           or any(map(str.isalpha, text)))


def letter_runs(text: str) -> list[bytes]:
    """The words of a text, lower-cased, cut into pieces of 24 bytes."""
    words = text.lower().encode().translate(_SPLIT).split()
    if any(len(w) > _PIECE for w in words):
        words = [w[i:i + _PIECE] for w in words
                 for i in range(0, len(w), _PIECE)]
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class BiGru:
    """``params``: for each direction g (byte to gate inputs, 256 x 3h) and u
    (state to gates, h x 3h); w, c of the output layer."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        def make(*s): return rng.standard_normal(s).astype(np.float32)
        self.h = hidden
        self.params = {}
        for d in "fb":
            self.params[f"g{d}"] = make(256, 3 * hidden) * 0.3
            self.params[f"u{d}"] = make(hidden, 3 * hidden) / hidden ** 0.5
        self.params["w"] = make(2 * hidden, classes) * 0.1
        self.params["c"] = np.zeros(classes, dtype=np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple:
        """States after each byte of ``x`` (words x length)."""
        g, u, h = self.params[f"g{d}"], self.params[f"u{d}"], self.h
        state = np.zeros((len(x), h), dtype=g.dtype)
        states, cache = [], []
        for t in range(x.shape[1]):
            inp, rec = g[x[:, t]], state @ u
            z = _sigmoid(inp[:, :h] + rec[:, :h])
            r = _sigmoid(inp[:, h:2 * h] + rec[:, h:2 * h])
            n = np.tanh(inp[:, 2 * h:] + r * rec[:, 2 * h:])
            if keep:
                cache.append((state, z, r, n, rec[:, 2 * h:]))
            state = n + z * (state - n)
            states.append(state)
        return states, cache

    def _both(self, x: np.ndarray, keep: bool = False) -> tuple:
        f, cf = self._run(x, "f", keep)
        b, cb = self._run(x[:, ::-1], "b", keep)
        both = np.concatenate((np.stack(f, 1), np.stack(b[::-1], 1)), 2)
        logits = both @ self.params["w"] + self.params["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, both, cf, cb

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """words x length x classes."""
        return self._both(x)[0]

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple:
        """Mean cross-entropy over all positions and its gradients."""
        p, both, cf, cb = self._both(x, keep=True)
        rows, length = x.shape
        at = p[np.arange(rows), :, y]
        loss = float(-np.log(at + 1e-12).mean())
        d = p.copy()
        d[np.arange(rows), :, y] -= 1
        d /= rows * length
        h = self.h
        grads = {"w": both.reshape(-1, 2 * h).T
                 @ d.reshape(-1, d.shape[2]), "c": d.sum(axis=(0, 1))}
        back = d @ self.params["w"].T
        for k, cache, order, out in (
                ("f", cf, x, back[:, :, :h]),
                ("b", cb, x[:, ::-1], back[:, ::-1, h:])):
            u = self.params[f"u{k}"]
            gu = np.zeros_like(u)
            pre = np.zeros((length, rows, 3 * h), dtype=u.dtype)
            carry = np.zeros((rows, h), dtype=u.dtype)
            for t in range(length - 1, -1, -1):
                state, z, r, n, rec = cache[t]
                dh = out[:, t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                drec = np.concatenate((dz, dr, dn * r), axis=1)
                gu += state.T @ drec
                carry = dh * z + drec @ u.T
                pre[t] = np.concatenate((dz, dr, dn), axis=1)
            gg = np.zeros_like(self.params[f"g{k}"])
            np.add.at(gg, order.T.ravel(), pre.reshape(-1, 3 * h))
            grads[f"g{k}"], grads[f"u{k}"] = gg, gu
        return loss, grads


def train(words: list[bytes], labels: list[int], classes: int,
          steps: int = 900, batch: int = 256, rate: float = 0.012,
          hidden: int = 16, seed: int = 3) -> BiGru:
    """Adam on batches of words of one length, lengths drawn by frequency."""
    model = BiGru(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    lens = np.array([len(w) for w in words])
    y = np.array(labels)
    by_len = {n: np.flatnonzero(lens == n) for n in np.unique(lens).tolist()}
    bytes_of = {n: np.frombuffer(b"".join(words[i] for i in at), np.uint8)
                .reshape(-1, n) for n, at in by_len.items()}
    sizes = sorted(by_len)
    share = np.array([len(by_len[n]) for n in sizes]) / len(words)
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v = {k: np.zeros_like(p) for k, p in model.params.items()}
    for step in range(1, steps + 1):
        n = int(rng.choice(sizes, p=share))
        pick = rng.integers(0, len(by_len[n]), batch)
        _, grads = model.loss_and_grads(bytes_of[n][pick],
                                        y[by_len[n][pick]])
        now = rate * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.params[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)) \
                .astype(np.float32)
    return model


class Reader:
    """Pools a text's probabilities; keeps the sums of words seen."""

    def __init__(self, model: BiGru, classes: int, cached: int = 1 << 20):
        self.model, self.classes, self.cached = model, classes, cached
        self._reset()

    def _reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((1 << 12, self.classes + 1), dtype=np.float32)

    def _learn(self, words: list[bytes]) -> None:
        base = len(self.row)
        while base + len(words) > len(self.sums):
            self.sums = np.concatenate((self.sums,
                                        np.zeros_like(self.sums)))
        words.sort(key=len)
        lens = np.array([len(w) for w in words])
        lo = 0
        while lo < len(words):
            hi = min(lo + 4096, int(np.searchsorted(lens, lens[lo],
                                                    "right")))
            x = np.frombuffer(b"".join(words[lo:hi]), np.uint8) \
                .reshape(hi - lo, -1)
            self.sums[base + lo:base + hi, :-1] = \
                self.model.probabilities(x).sum(axis=1)
            self.sums[base + lo:base + hi, -1] = lens[lo]
            lo = hi
        self.row.update(zip(words, range(base, base + len(words))))

    def pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        """The mean probabilities of texts given as words (no words: 0)."""
        new = {w for t in texts for w in t}.difference(self.row)
        if len(self.row) + len(new) > self.cached:
            self._reset()
            new = {w for t in texts for w in t}
        self._learn(sorted(new))
        out = np.zeros((len(texts), self.classes))
        get = self.row.__getitem__
        for i, t in enumerate(texts):
            if t:
                at = np.fromiter(map(get, t), np.int64, len(t))
                total = self.sums[at].sum(axis=0, dtype=np.float64)
                out[i] = total[:-1] / total[-1]
        return out


def held_out(key: str):
    """crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3
                      == 1, F.lit(False))


def training_words(docs: DataFrame, key: str, text: str, lang: str,
                   rows_per_lang: int, words_per_row: int) -> list[tuple]:
    """(lang, word) of the bounded sample, in a fixed order."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()
                        & F.col(key).isNotNull() & ~held_out(key))
    counts = [(r[0], min(1.0, rows_per_lang / r[1])) for r in
              known.groupBy(lang).count().collect()]  # a row a language
    if not counts:
        return []
    share = docs.sparkSession.createDataFrame(
        counts, "__lang string, __share double")
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)),
                   F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(F.broadcast(share), F.col(lang) == F.col("__lang")) \
        .filter(place < F.col("__share")) \
        .select(F.col(key).cast("string"), F.col(text), "__lang")

    def words(batches):
        from paysift.llm.words import mix64
        for batch in batches:
            langs, out = [], []
            for t, code in zip(batch.column(1).to_pylist(),
                               batch.column(2).to_pylist()):
                own = letter_runs(t)
                # every word's place decides, not the text's beginning
                order = np.argsort(mix64(np.arange(
                    len(own), dtype=np.uint64) + np.uint64(len(t))))
                for i in order[:words_per_row].tolist():
                    langs.append(code)
                    out.append(own[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(out, pa.binary())],
                names=["lang", "word"])
    rows = picked.mapInArrow(words, "lang string, word binary").collect()
    return sorted((r[0], bytes(r[1])) for r in rows)


def identify_languages(docs: DataFrame, key: str = "doc_id",
                       text: str = "text", lang: str = "lang",
                       rows_per_lang: int = 400, words_per_row: int = 100,
                       steps: int = 900) -> DataFrame:
    """key, held_out, lang_pred, score for every row."""
    sample = training_words(docs, key, text, lang, rows_per_lang,
                            words_per_row)
    langs = sorted({x[0] for x in sample})
    model = None
    if sample:
        code = {x: i for i, x in enumerate(langs)}
        model = train([w for _, w in sample], [code[x] for x, _ in sample],
                      len(langs), steps)

    def rows(batches):
        reader = Reader(model, len(langs)) if model else None
        for batch in batches:
            pred, score = [], []
            texts = batch.column(2).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo:lo + 256]
                words = [letter_runs(t) if reader and has_letter(t)
                         else [] for t in part]
                if reader is None:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                p = reader.pooled(words)
                best = p.argmax(axis=1)
                for i, w in enumerate(words):
                    pred.append(langs[best[i]] if w else "und")
                    score.append(min(1.0, float(p[i, best[i]]))
                                 if w else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred),
                 pa.array(score, pa.float64())],
                names=[key, "held_out", "lang_pred", "score"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), held_out(key).alias("held_out"),
                       F.col(text).cast("string").alias("text")) \
        .mapInArrow(rows, f"`{key}` {kind}, held_out boolean, "
                          "lang_pred string, score double")
