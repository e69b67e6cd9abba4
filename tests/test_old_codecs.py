"""The older codecs against the encoders of queries."""

import random

import pytest

from tessera import fixtures
from tessera.operators import adaptive, codecs, members, zip_codecs

WORDS = ["alpha", "beta", "gamma", "delta", "wide", "window", "of", "the", "old"]
PROSE = " ".join(random.Random(3).choice(WORDS) for _ in range(3_000)).encode()
TEXTS = [b"", b"a", b"abc" * 200, bytes(range(256)) * 3, bytes(1000), random.Random(1).randbytes(2000), PROSE, b"\x90" * 300 + b"ab\x90"]


@pytest.mark.parametrize("data", TEXTS)
@pytest.mark.parametrize(("encode", "decode"), [
    (fixtures.as_packbits, codecs.packbits), (fixtures.as_rle90, codecs.rle90), (fixtures.as_lzss, codecs.lzss), (fixtures.as_hlp_lz77, codecs.hlp_lz77), (fixtures.as_dcl, codecs.implode_dcl),
    (lambda d: fixtures.as_dcl(d, True, 4), codecs.implode_dcl), (fixtures.as_deflate64, zip_codecs.deflate64), (lambda d: fixtures.as_lzw(d, "zoo"), lambda c: codecs.lzw(c, None, "zoo", most=13)),
])
def test_round_trips(encode, decode, data):
    found = decode(encode(data))
    assert (found.data, found.error) == (data, None)


@pytest.mark.parametrize("data", [*TEXTS, random.Random(2).randbytes(30_000)])
def test_codecs_of_known_size(data):
    n = len(data)
    assert zip_codecs.shrink(fixtures.as_shrink(data), n).data == data
    for factor in (1, 2, 3, 4):
        assert zip_codecs.reduce(fixtures.as_reduced(data, factor), n, factor).data == data
    for wide in (False, True):
        for coded in (False, True):
            assert zip_codecs.implode(fixtures.as_imploded(data, wide, coded), n, wide, coded).data == data
    assert adaptive.lh1(fixtures.as_lh1(data), n).data == data
    for window, decode in ((13, codecs.lh5), (15, codecs.lh6), (16, codecs.lh7)):
        assert decode(fixtures.as_lh(data, window), n).data == data


def test_counts_are_halved():
    """Longer than the adaptive tree counts."""
    data = bytes(random.Random(5).choice(b"aab  cdefgh") for _ in range(70_000))
    tree = adaptive.AdaptiveTree()
    bits = fixtures.Writer(True)
    for b in data:
        for bit in tree.path(b):
            bits.put(bit, 1)
        tree.use(b)
    assert adaptive.lh1(bits.bytes(), len(data)).data == data and max(tree.count) <= adaptive.MOST


@pytest.mark.parametrize("decode", [zip_codecs.shrink, zip_codecs.reduce, zip_codecs.implode, zip_codecs.deflate64, adaptive.lh1, codecs.implode_dcl])
def test_damage(decode):
    r = random.Random(7)
    for n in (0, 1, 2, 5, 50, 400):
        assert len(decode(r.randbytes(n), 5_000).data) <= 5_000


def test_limits(monkeypatch):
    """What is cut without being asked for is an error."""
    monkeypatch.setattr(codecs, "LIMIT", 100)
    for encode, decode in ((fixtures.as_packbits, codecs.packbits), (fixtures.as_lzss, codecs.lzss), (fixtures.as_hlp_lz77, codecs.hlp_lz77), (lambda d: fixtures.as_lzw(d), codecs.lzw), (bytes, codecs.stored), (bytes, codecs.pcx_rle)):
        found = decode(encode(PROSE))
        assert len(found.data) == 100 and found.error
        assert decode(encode(PROSE), 50).error is None


def test_methods_of_zip():
    rows = list(members.zip_members(fixtures.old_zip(PROSE)))
    assert [m.method for m in rows] == ["stored", "shrink", "reduce1", "reduce2", "reduce3", "reduce4", "implode", "deflate64", "dcl_implode"]
    assert all(m.data == PROSE and m.crc_ok and m.err is None for m in rows)
