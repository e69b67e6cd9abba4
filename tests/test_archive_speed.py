"""Work on each byte of codes in archives, and that codes come out as one by one."""

import random

from tests.test_speed import PROSE, turns

from tessera import fixtures
from tessera.operators import archives, codecs


def by_bits(data: bytes, size: int) -> bytes:
    """tree_decode by a walk from bit to bit."""
    bits = codecs.Bits(data)

    def grow():
        return bits.take(8) if bits.take(1) else (grow(), grow())

    root, out = grow(), bytearray()
    while len(out) < size and not bits.over:
        node = root
        while isinstance(node, tuple):
            node = node[bits.take(1)]
        out.append(node)
    return bytes(out)


def test_huffman_and_lzw_of_stuffit():
    assert turns(lambda: archives.tree_decode(fixtures.huffman_of(PROSE), len(PROSE))) < 12
    assert turns(lambda: codecs.lzw(fixtures.as_lzw(PROSE, most=14), len(PROSE), most=14)) < 18
    blob = fixtures.stuffit_of(PROSE)
    assert turns(lambda: list(archives.stuffit_members(blob))) < 18


def test_trees():
    random_ = random.Random(4)
    for k in range(200):
        if k % 2:
            body = bytes(random_.choices(range(2 + k), k=random_.randrange(2, 60) * 40))
            data, size = fixtures.huffman_of(body), len(body) + random_.randrange(30)
            if len(set(body)) == 1:
                continue
        else:  # a leaf at each depth
            depth = 1 + k % 30
            leaves = "".join(f"01{random_.randrange(256):08b}" for _ in range(depth)) + f"1{7:08b}"
            data, size = fixtures.joined([leaves, *random_.choices("01", k=3000)], True), random_.randrange(4000)
        assert archives.tree_decode(data, size) == by_bits(data, size)
    large = bytes(random_.choices(range(200), range(1, 201), k=90_000))  # over several strides
    coded = fixtures.huffman_of(large)
    assert archives.tree_decode(coded, len(large)) == large and archives.tree_decode(coded, 70_001) == large[:70_001]


def test_lha_in_arj():
    assert turns(lambda: fixtures.as_lh(PROSE, 15)) < 5
    assert turns(lambda: list(archives.arj_members(fixtures.arj_of(PROSE)))) < 10


def test_copies_of_any_length():
    """Lengths about the eleven bytes that are counted at once, and matches that run to the end."""
    random_ = random.Random(8)
    for n in (8, 9, 10, 11, 12, 15, 16, 17, 79, 80, 81, 300):
        piece = random_.randbytes(n)
        assert fixtures.copies(piece + b"\0" + piece, 4096, 3, 400) == [(n + 1, n + 1, n)]
        assert fixtures.copies(piece + b"\0" + piece, 4096, 3, 11) == [(n + 1 + k, n + 1, min(11, n - k)) for k in range(0, n - 2, 11)]
        assert fixtures.copies(piece + b"\0" + piece, 4096, 12, 400) == ([(n + 1, n + 1, n)] if n > 11 else [])
    assert fixtures.copies(bytes(1000), 4096, 3, 5000) == [(1, 1, 999)]


def test_blocks_of_lha():
    data = random.Random(6).randbytes(70_000) + PROSE
    assert codecs.lh6(fixtures.as_lh(data, 15), len(data)).data == data and fixtures.as_lh(b"") == b""
