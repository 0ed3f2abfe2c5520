"""Adaptive radix tree over byte strings.

Inner nodes change their layout with the number of children: 4 or 16 sorted
edges, 48 slots behind a 256-byte index, or 256 slots.  A node holds the whole
run of bytes that leads to it (path compression), the number of keys below,
their smallest value, and the values of the keys that end there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to ``room`` (4 or 16) edges in byte order."""
    __slots__ = ("room", "edges", "kids")

    def __init__(self, room: int = 4):
        self.room, self.edges, self.kids = room, bytearray(), []

    def get(self, b: int):
        at = self.edges.find(b)
        return None if at < 0 else self.kids[at]

    def swap(self, b: int, kid) -> None:
        self.kids[self.edges.index(b)] = kid

    def put(self, b: int, kid):
        """Add an edge; the layout to go on with."""
        if len(self.edges) == self.room:
            larger = Sorted(16) if self.room == 4 else Indexed()
            for e, k in self.items():
                larger.put(e, k)
            return larger.put(b, kid)
        at = bisect_left(self.edges, b)
        self.edges.insert(at, b)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple]:
        return zip(self.edges, self.kids)


class Indexed:
    """Up to 48 edges: a byte's slot stands in an index of 256 bytes."""
    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(b"\xff" * 256), []

    def get(self, b: int):
        at = self.index[b]
        return None if at == 255 else self.kids[at]

    def swap(self, b: int, kid) -> None:
        self.kids[self.index[b]] = kid

    def put(self, b: int, kid):
        if len(self.kids) == 48:
            larger = Full()
            for e, k in self.items():
                larger.put(e, k)
            return larger.put(b, kid)
        self.index[b] = len(self.kids)
        self.kids.append(kid)
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, self.kids[at]) for b, at in enumerate(self.index)
                if at != 255)


class Full:
    """A slot for every byte."""
    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, b: int):
        return self.kids[b]

    def swap(self, b: int, kid) -> None:
        self.kids[b] = kid

    def put(self, b: int, kid):
        self.kids[b] = kid
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    __slots__ = ("path", "edges", "n", "least", "ends")

    def __init__(self, path: bytes, n: int, least):
        self.path, self.n, self.least = path, n, least
        self.edges, self.ends = Sorted(), []


def _shared(path: bytes, key: bytes, at: int) -> int:
    """Length of the common beginning of ``path`` and ``key[at:]``."""
    if key.startswith(path, at):
        return len(path)
    part = key[at:at + len(path)]
    x = int.from_bytes(path[:len(part)]) ^ int.from_bytes(part)
    return len(part) - (x.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root = Node(b"", 0, None)

    def insert(self, key: bytes, value: int) -> None:
        node, at = self.root, 0
        while True:
            node.n += 1
            if node.least is None or value < node.least:
                node.least = value
            if at == len(key):
                node.ends.append(value)
                return
            kid = node.edges.get(key[at])
            if kid is None:
                kid = Node(key[at:], 1, value)
                kid.ends.append(value)
                node.edges = node.edges.put(key[at], kid)
                return
            m = _shared(kid.path, key, at)
            if m < len(kid.path):  # part the compressed path
                fork = Node(kid.path[:m], kid.n, kid.least)
                kid.path = kid.path[m:]
                fork.edges = fork.edges.put(kid.path[0], kid)
                node.edges.swap(key[at], fork)
                kid = fork
            node, at = kid, at + m

    def aligned(self, width: int) -> Iterator[tuple]:
        """(key, n, least, ends) of every depth that ``width`` divides,
        parents first; the root's key is empty."""
        held = [(self.root, b"")]
        yield b"", self.root.n, self.root.least, self.root.ends
        while held:
            node, above = held.pop()
            key = above + node.path
            first = len(above) // width * width + width
            for d in range(first, len(key) + 1, width):
                yield key[:d], node.n, node.least, \
                    node.ends if d == len(key) else []
            held.extend((kid, key) for _, kid in node.edges.items())
