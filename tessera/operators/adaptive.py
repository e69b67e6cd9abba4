"""Adaptive Huffman coding over LZ77, as in LHA's method 1."""

from __future__ import annotations

from tessera.operators.codecs import Bits, Decoded, bounded, copy_back, tree_of

#: Bytes, and lengths from 3 to 60.
SYMBOLS = 314
#: The root's count at which all counts are halved.
MOST = 0x8000


class AdaptiveTree:
    """A code tree whose nodes lie in the order of their counts; each use of a symbol counts it and moves what has become more frequent forwards.

    Nodes 0 to root; child[i] is the first of a node's two neighbouring children, or size + symbol for a leaf.
    """

    def __init__(self, symbols: int = SYMBOLS):
        self.symbols, self.size = symbols, 2 * symbols - 1
        self.root = self.size - 1
        self.count = [1] * symbols + [0] * (symbols - 1)
        self.child = [self.size + i for i in range(symbols)] + [0] * (symbols - 1)
        self.parent = [0] * (self.size + symbols)
        for leaf in range(symbols):
            self.parent[self.size + leaf] = leaf
        for node, first in zip(range(symbols, self.size), range(0, self.size, 2), strict=False):
            self._join(node, first)
        self.parent[self.root] = 0

    def _join(self, node: int, first: int) -> None:
        self.count[node] = self.count[first] + self.count[first + 1]
        self.child[node] = first
        self.parent[first] = self.parent[first + 1] = node

    def _adopt(self, node: int) -> None:
        """Tells the children of a node where it is."""
        child = self.child[node]
        self.parent[child] = node
        if child < self.size:
            self.parent[child + 1] = node

    def halve(self) -> None:
        leaves = [((self.count[i] + 1) // 2, self.child[i]) for i in range(self.size) if self.child[i] >= self.size]
        nodes: list[tuple[int, int]] = list(leaves)
        first = 0
        while len(nodes) < self.size:
            total = nodes[first][0] + nodes[first + 1][0]
            place = len(nodes)
            while place > 0 and nodes[place - 1][0] > total:
                place -= 1
            nodes.insert(place, (total, first))
            first += 2
        self.count, self.child = [n for n, _ in nodes], [c for _, c in nodes]
        for node in range(self.size):
            self._adopt(node)
        self.parent[self.root] = 0

    def use(self, symbol: int) -> None:
        if self.count[self.root] == MOST:
            self.halve()
        count, child, parent, size, root = self.count, self.child, self.parent, self.size, self.root
        node = parent[size + symbol]
        while True:
            n = count[node] + 1
            if node != root and count[node + 1] < n:
                last = node + 1
                while last < root and count[last + 1] < n:
                    last += 1
                count[node], count[last] = count[last], n
                one, other = child[last], child[node]
                child[node], child[last] = one, other
                parent[one] = node
                if one < size:
                    parent[one + 1] = node
                parent[other] = last
                if other < size:
                    parent[other + 1] = last
                node = last
            else:
                count[node] = n
            if node == root:
                return
            node = parent[node]

    def read(self, bits: Bits) -> int:
        at = self.child[self.root]
        while at < self.size:
            at = self.child[at + bits.take(1)]
        self.use(at - self.size)
        return at - self.size

    def path(self, symbol: int) -> list[int]:
        """The bits of a symbol's present code."""
        return [int(bit) for bit in self.code(symbol)]

    def code(self, symbol: int) -> str:
        """These bits as digits."""
        out, parent, child, root = [], self.parent, self.child, self.root
        node = parent[self.size + symbol]
        while node != root:
            above = parent[node]
            out.append("1" if node > child[above] else "0")
            node = above
        return "".join(out[::-1])


#: Code lengths of the upper six bits of places.
PLACES = [3] + [4] * 3 + [5] * 8 + [6] * 12 + [7] * 24 + [8] * 16


@bounded
def lh1(data: bytes, limit: int) -> Decoded:
    """LHA's method 1: copies from 4 KiB back, which begin with spaces. Ends at limit bytes."""
    out, tree, places = bytearray(b" " * 4096), AdaptiveTree(), tree_of(tuple(PLACES)).lookup(True, 0, 8)
    at, held, have, end, most = 0, 0, 0, len(data), limit + 4096
    child, size, root, use, append = tree.child, tree.size, tree.root, tree.use, out.append
    while len(out) < most and (at <= end or at - have // 8 <= end):
        node = child[root]
        while node < size:
            if not have:
                held, at, have = int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big"), at + 4, 32
            have -= 1
            node = child[node + (held >> have & 1)]
        symbol = node - size
        use(symbol)
        child = tree.child  # halving makes it anew
        if symbol < 256:
            append(symbol)
            continue
        if have < 14:
            held, at, have = (held & (1 << have) - 1) << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big"), at + 4, have + 32
        n, place = places[held >> have - 8 & 255]
        have -= n + 6
        distance, length = (place << 6 | held >> have & 63) + 1, symbol - 253
        start = len(out) - distance
        if start >= 0 and length <= distance:
            out += out[start : start + length]
        else:
            copy_back(out, distance, length)
    place = at - have // 8
    return Decoded(bytes(out[4096:most]), min(place, end), "unexpected end" if place > end else None)
