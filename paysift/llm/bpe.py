"""Token ids of whole texts with the ``tokenizers`` library.

Texts are cut where the tokenizer's own pre-tokenizer cuts them anyway: at
white space, and inside plain words between letters, digits and other signs.
The parts of words of ASCII signs without an apostrophe are found and hashed
with numpy, a batch of texts at once, lower-cased where the tokenizer does so;
other words are hashed whole and cut when they are new.  The ids of what was met
before are gathered from one buffer by hash.  Every different part is encoded
once per worker: parts not seen before are encoded in one call, joined so that
the ids tell where one ends.  A text that holds a special token, or white space
on which libraries differ, is encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from paysift.llm.words import span_hash

#: White space beyond ASCII, and signs that some libraries count as such.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029"
                  "\u202f\u205f\u3000\ufeff]")
#: Plain words: ASCII signs and letters, and the letters of Latin-1.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
#: The pre-tokenizers' patterns, for plain words.
_CUT_KEEP = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[%s]+| ?[0-9]+|"
                       " ?[^ 0-9%s]+" % (_LETTERS, _LETTERS))
_CUT_DROP = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[0-9]|[^0-9%s]+"
                       % (_LETTERS, _LETTERS))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, 10]] = True
#: Signs by the part they belong to: 0 others, 1 letters, 2 digits, 3 blank;
#: words with signs of kind 4 are not cut with numpy (an apostrophe may begin a
#: part of its own).
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[0x21:0x7F] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x20] = 3
_KIND[0x27] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of True."""
    step = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0,
                                  append=0))
    return step[0::2], step[1::2]


def kept_pieces(buf: np.ndarray, bounds: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces of texts that keep white space, in order:
    a word takes one blank before it; of other white space the last sign stands
    alone where a word follows.  ``bounds``: begin of each text in ``buf``,
    which has one byte after each text."""
    begin, end = _spans(~_SPACE[buf])
    text = np.searchsorted(bounds, begin, "right") - 1
    before = bounds[text]
    same = np.flatnonzero(text[1:] == text[:-1]) + 1
    before[same] = end[same - 1]
    gap = begin - before
    blank = (gap > 0) & (buf[begin - 1] == 0x20)
    rest = np.flatnonzero(gap > 1)
    alone = np.flatnonzero((gap > 0) & ~blank)
    # what follows the last word of a text
    stop = np.append(bounds[1:], len(buf)) - 1
    last = bounds.copy()
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) \
        if len(text) else text
    last[text[ends]] = end[ends]
    tail = np.flatnonzero(stop > last)
    begins = np.concatenate((begin - blank, before[rest], begin[alone] - 1,
                             last[tail]))
    finish = np.concatenate((end, begin[rest] - 1, begin[alone],
                             stop[tail]))
    if len(begins) > len(begin):
        order = np.argsort(begins, kind="stable")
        begins, finish = begins[order], finish[order]
    return begins, finish


class Codes:
    """Numbers of 64-bit hashes in order of their coming, looked up many at
    once."""

    def __init__(self, room: int = 1 << 12):
        self.hash = np.zeros(room, np.int64)  # 0: free
        self.code = np.zeros(room, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of every hash; -1: not known."""
        h = np.where(h == 0, 1, h)
        out = np.full(len(h), -1, np.int64)
        live, last = np.arange(len(h)), len(self.hash) - 1
        slot = h & last
        while len(live):
            held = self.hash[slot]
            hit = held == h
            out[live[hit]] = self.code[slot[hit]]
            on = ~hit & (held != 0)
            live, h, slot = live[on], h[on], (slot[on] + 1) & last
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new, different hashes."""
        codes = np.arange(self.n, self.n + len(h))
        if 2 * (self.n + len(h)) > len(self.hash):
            at = np.flatnonzero(self.hash)
            h = np.concatenate((self.hash[at], h))
            codes = np.concatenate((self.code[at], codes))
            self.__init__(1 << (4 * len(h)).bit_length())
            self.n = 0
        self.n += len(h)
        h = np.where(h == 0, 1, h)
        last = len(self.hash) - 1
        slot = h & last
        while len(h):
            free = np.flatnonzero(self.hash[slot] == 0)
            self.hash[slot[free]] = h[free]  # the last of one slot stays
            on = self.hash[slot] != h
            self.code[slot[~on]] = codes[~on]
            h, codes, slot = h[on], codes[on], (slot[on] + 1) & last


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned
    32-bit bytes, without special tokens added, closed by the end id.

    ``keep_space``: the tokenizer is byte-level and keeps white space; else
    it lower-cases and drops it."""

    def __init__(self, path: str, end: int, keep_space: bool,
                 cached: int = 1 << 20):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.special = sorted(
            t.content for t in self.whole.get_added_tokens_decoder()
            .values())
        self.joint = self.special[0]
        self.joint_id = self.whole.token_to_id(self.joint)
        self.keep_space, self.cached = keep_space, cached
        self.end = np.array([end], "<u4").tobytes()
        self.line_id = self.whole.encode(
            "\n", add_special_tokens=False).ids[0] if keep_space else None
        # ids whose token ends a word, or begins with a blank
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.closes[[i for t, i in vocabulary.items()
                     if t.endswith("</w>")]] = True
        self.opens = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.opens[[i for t, i in vocabulary.items()
                    if t.startswith("\u0120")]] = True
        self.parts: dict[str, bytes] = {}  # ids of parts
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()  # of pieces, by their hash
        self.first = np.zeros(1 << 12, np.int64)  # their ids in ``flat``
        self.count = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, "<u4")
        self.used = 0

    def _cut(self, piece: str) -> list[str]:
        if not _PLAIN.fullmatch(piece):
            return [piece]
        if self.keep_space:
            return _CUT_KEEP.findall(piece)
        return _CUT_DROP.findall(piece.lower())

    def _call(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast(
            [text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _plain_kind(self, part: str) -> str:
        if not self.keep_space:
            return "drop"
        return "blank" if part[0] == " " else "line"

    def _encode(self, kind: str, parts: list[str]
                ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single parts of one kind, one after the other, and how
        many each has; many are encoded in one call.  Plain ones are divided by
        the ids that end a word where white space is dropped, else by those
        that begin with a part's blank, or by a line end's own id; others are
        joined by a special token."""
        glue = {"odd": self.joint, "drop": " ", "blank": "", "line": "\n"}
        found, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for lo in range(0, len(parts), 2048):
            part = parts[lo:lo + 2048]
            ids = self._call(glue[kind].join(part))
            if kind == "drop":
                end = np.flatnonzero(self.closes[ids]) + 1
                count = np.diff(end, prepend=0)
            elif kind == "blank":
                count = np.diff(np.flatnonzero(self.opens[ids]),
                                append=len(ids))
            else:
                cut = ids == (self.joint_id if kind == "odd"
                              else self.line_id)
                count = np.diff(np.flatnonzero(cut), prepend=-1,
                                append=len(ids)) - 1
                ids = ids[~cut]
            if len(count) != len(part) or count.sum() != len(ids):
                raise ValueError("the tokenizer joins parts")
            found.append(ids)
            counts.append(count)
        return np.concatenate(found), np.concatenate(counts)

    def _cut_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are cut by pattern."""
        if len(self.parts) > self.cached // 4:
            self.parts.clear()
        cuts = [self._cut(p) for p in pieces]
        groups: dict[str, list[str]] = {}
        for p in set(chain.from_iterable(cuts)).difference(self.parts):
            groups.setdefault(self._plain_kind(p) if _PLAIN.fullmatch(p)
                              else "odd", []).append(p)
        for kind, group in groups.items():
            ids, count = self._encode(kind, group)
            raw, end = ids.tobytes(), (4 * np.cumsum(count)).tolist()
            self.parts.update((p, raw[i:j]) for p, i, j in
                              zip(group, [0, *end], end))
        return [b"".join(map(self.parts.__getitem__, c)) for c in cuts]

    def _learn(self, hashes: np.ndarray, pieces: list[str],
               whole: np.ndarray) -> None:
        """Give new pieces their codes and ids; ``whole``: a piece is one
        plain part."""
        groups: dict[str, list[int]] = {}
        for i, (p, w) in enumerate(zip(pieces, whole.tolist())):
            groups.setdefault(self._plain_kind(p) if w else "cut",
                              []).append(i)
        for kind, at in groups.items():
            group = [pieces[i] for i in at]
            if kind == "cut":
                known = self._cut_ids(group)
                ids = np.frombuffer(b"".join(known), "<u4")
                sizes = np.fromiter(map(len, known), np.int64,
                                    len(known)) // 4
            else:
                ids, sizes = self._encode(kind, group)
            code, n = self.codes.n, len(group)
            while code + n > len(self.first):
                self.first = np.concatenate((self.first, self.first))
                self.count = np.concatenate((self.count, self.count))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, self.flat))
            self.first[code:code + n] = self.used + np.cumsum(sizes) - sizes
            self.count[code:code + n] = sizes
            self.flat[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.codes.add(hashes[at])

    def _plain_parts(self, buf: np.ndarray, begin: np.ndarray,
                     end: np.ndarray) -> tuple:
        """``buf`` with plain pieces lower-cased if the tokenizer does so;
        begin and end of the parts of plain pieces, and of the other pieces
        whole, in order; whether each is a plain part."""
        kind = _KIND[buf]
        odd = np.flatnonzero(kind == 4)
        at = np.searchsorted(begin, odd, "right") - 1
        plain = buf[end - 1] != 0x20
        plain[at[(at >= 0) & (odd < end[at])]] = False
        step = np.zeros(len(buf) + 1, np.int8)
        step[begin[plain]] = 1
        step[end[plain]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        new = np.zeros(len(buf), dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        if self.keep_space:
            new[1:] &= kind[:-1] != 3  # a blank goes with what follows
        else:
            new |= kind == 2
            buf = np.where(inside, _LOWER[buf], buf)
        new &= inside
        new[begin] = True
        begins = np.flatnonzero(new)
        first = np.searchsorted(begins, begin)
        after = np.append(first[1:], len(begins))
        ends = np.append(begins[1:], 0)
        ends[after - 1] = end
        return buf, begins, ends, np.repeat(plain, after - first)

    def _by_pieces(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts, by their pieces."""
        joined = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
        bounds = np.cumsum(sizes) - sizes
        begin, end = kept_pieces(buf, bounds) if self.keep_space \
            else _spans(~_BREAK[buf])
        if not len(begin):
            return [b""] * len(raw)
        buf, begin, end, plain = self._plain_parts(buf, begin, end)
        if self.codes.n > self.cached:
            self._forget()
        hashes = span_hash(buf, begin, end)
        code = self.codes.find(hashes)
        new = np.flatnonzero(code < 0)
        if len(new):
            one, at = np.unique(hashes[new], return_index=True)
            at, text = new[at], buf.tobytes()
            self._learn(one, [text[i:j].decode() for i, j in zip(
                begin[at].tolist(), end[at].tolist())], plain[at])
            code[new] = self.codes.find(hashes[new])
        count = self.count[code]
        total = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[code] - total + count, count)
                        + np.arange(int(total[-1]))]
        ids = ids.tobytes()
        # ids before each text
        cut = np.append(0, total)[np.append(
            np.searchsorted(begin, bounds), len(begin))] * 4
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(),
                                         cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(s in t for s in self.special)
                 and not (self.keep_space and _ODD.search(t))
                 for t in texts]
        found = iter(self._by_pieces(
            [t.encode() for t, p in zip(texts, plain) if p])
            if any(plain) else [])
        return [(next(found) if p else np.array(self.whole.encode(
            t, add_special_tokens=False).ids, "<u4").tobytes()) + self.end
            for t, p in zip(texts, plain)]


_MADE: dict[str, Encoder] = {}


def encoder(path: str, end: int, keep_space: bool) -> Encoder:
    """One encoder per worker process, made at first use."""
    if path not in _MADE:
        _MADE[path] = Encoder(path, end, keep_space)
    return _MADE[path]


def forget() -> None:
    """Give back the caches: a worker that serves another operator next does
    not need them."""
    _MADE.clear()
