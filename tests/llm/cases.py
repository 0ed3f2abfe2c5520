"""Small tables with awkward rows, and brute-force answers."""

from __future__ import annotations

import re
import zlib
from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = ["kept", "n_words", "size", "copies", "shard", "slot", "score",
         "key", "id", "row", "component_id", "target", "n_removed", "label"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark, clash: bool = True):
    passage = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"t{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", None, None, None), (4, "one", "fr", "b", 3),
        (5, passage, "en", None, len(passage)),
        (6, "Intro words " + passage + " tail", "en", "a", 1),
        (7, passage, "en", "a", len(passage)),
        (7, passage, "en", "a", len(passage)),  # a repeated row
        (8, long, "de", "b", len(long)), (9, long + " end", "de", "b", 1),
        (10, "été ñandú 中文 <|endoftext|> $$$ %%%", "es", "c", 5),
        (11, "same line\nsame line\nsame line\n\nother", "en", "c", 7),
        (12, "12345 !!! ---", "en", "c", 7),
        (13, "x " * 50, "en", "a", 100), (None, "no key here", "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, DOC)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int) -> set:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c
                      for c in text or ""))
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(docs: dict, k: int, pct: int = 80) -> dict:
    sets = {d: shingles(t, k) for d, t in docs.items()}
    ids = [d for d in sets if sets[d]]
    index: dict = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    links = []
    for d in ids:
        both = Counter(e for s in sets[d] for e in index[s] if e > d)
        links += [(d, e) for e, n in both.items() if 100 * n >= pct * (
            len(sets[d]) + len(sets[e]) - n)]
    return components(sets, links)


def repeats(docs: list[tuple], window: int = 20) -> dict:
    """doc -> covered flags of its words."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        flag = [False] * len(w)
        for i in range(len(w) - window + 1):
            s = tuple(w[i:i + window])
            if s in seen:
                flag[i:i + window] = [True] * window
            seen.add(s)
        out[d] = flag
    return out


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
