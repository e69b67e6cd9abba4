"""Work on each byte of LZSS and of help files' LZ77, and that copies reach what precedes the data."""

import random

from tests.test_speed import PROSE, turns

from tessera import fixtures
from tessera.operators import codecs


def ring(data: bytes, start: int) -> bytes:
    """LZSS by a ring that is written byte by byte."""
    held, at, here, out = bytearray(b" " * 4096), 0, start, bytearray()
    while at < len(data):
        flags, at = data[at], at + 1
        for bit in range(8):
            if at >= len(data) or not flags >> bit & 1 and at + 1 >= len(data):
                return bytes(out)
            if flags >> bit & 1:
                piece, at = [data[at]], at + 1
            else:
                place, n = data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 0x0F) + 3
                piece, at = [None] * n, at + 2
            for k, byte in enumerate(piece):
                byte = held[(place + k) % 4096] if byte is None else byte
                held[here] = byte
                here = (here + 1) % 4096
                out.append(byte)
    return bytes(out)


def test_lzss():
    assert turns(lambda: codecs.lzss(fixtures.as_lzss(PROSE))) < 11
    random_ = random.Random(2)
    for _ in range(50):
        data = random_.randbytes(random_.randrange(6000))
        assert codecs.lzss(data).data == ring(data, 4078) and codecs.szdd(data).data == ring(data, 4080)


def test_help_files():
    assert turns(lambda: codecs.hlp_lz77(fixtures.as_hlp_lz77(PROSE))) < 8
