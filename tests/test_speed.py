"""Work on each byte stays within a bound that does not depend on the machine: it is told in turns of a plain loop over the bytes."""

import random
import time

import pytest

from tessera import fixtures
from tessera.operators import adaptive, codecs, fax, rasters, tiff_rasters, zip_codecs

WORDS = [bytes(random.Random(i).choices(b"abcdefghijklmnopqrstuvwxyz", k=2 + i % 9)) for i in range(400)]
PROSE = b" ".join(random.Random(5).choices(WORDS, k=20_000))


def seconds(work) -> float:
    """The least CPU time of three runs."""
    found = []
    for _ in range(3):
        began = time.process_time()
        work()
        found.append(time.process_time() - began)
    return min(found)


def turns(work) -> float:
    """How often a plain loop over PROSE fits into work."""

    def plain() -> int:
        total = 0
        for b in PROSE:
            total = total + b & 0xFFFF
        return total

    return seconds(work) / seconds(plain)


def both(encode, decode):
    coded = encode(PROSE)
    assert decode(coded, len(PROSE)).data == PROSE
    return turns(lambda: decode(encode(PROSE), len(PROSE)))


@pytest.mark.parametrize(("encode", "most"), [(fixtures.as_dcl, 19), (lambda d: fixtures.as_dcl(d, True, 4), 25)])
def test_dcl(encode, most):
    assert both(encode, codecs.implode_dcl) < most


def test_lha():
    assert both(fixtures.as_lh, codecs.lh5) < 22 and both(fixtures.as_lh1, adaptive.lh1) < 45


def test_old_zip():
    assert both(fixtures.as_reduced, zip_codecs.reduce) < 30
    assert both(lambda d: fixtures.as_imploded(d, True, True), lambda d, n: zip_codecs.implode(d, n, True, True)) < 19
    assert both(fixtures.as_deflate64, zip_codecs.deflate64) < 24


def test_fax():
    """A wide line by the line above: changes are found without a scan from its beginning; and texts as images."""
    row = [i // 2 % 2 for i in range(16_000)]
    coded = fixtures.as_fax([row] * 6, 4)
    assert turns(lambda: fax.decode_fax(coded, 16_000, 6, 4)) < 60
    assert (fax.decode_fax(coded, 16_000, 6, 4) == row).all()
    small = PROSE[:4_000]
    for scheme, most in ((2, 140), (3, 140), (4, 300), (5, 280)):
        blob = fixtures.as_fax_tiff(small, scheme)
        assert turns(lambda blob=blob, scheme=scheme: [fixtures.as_fax_tiff(small, scheme), next(tiff_rasters.tiff_images(blob))]) * len(PROSE) / len(small) < most


def test_bitmap_runs():
    blob = fixtures.as_bmp_runs(PROSE)
    assert turns(lambda: rasters.bmp(blob)) < 10


def test_copies_are_found_as_by_a_loop():
    for data in (PROSE[:3000], b"ab" * 500, bytes(700), b"abc", b"", b"abcdabcd" * 3 + bytes(range(256))):
        for window, least, most in ((256, 4, 300), (4000, 3, 18), (65_536, 3, 65_538)):
            places, at, found = {}, 0, []
            while at < len(data):
                key, length = data[at : at + 3], 1
                start = places.get(key, -1)
                if start >= 0 and at - start <= window and len(key) == 3:
                    n = 3
                    while n < most and at + n < len(data) and data[start + n] == data[at + n]:
                        n += 1
                    if n >= least:
                        found.append((at, at - start, n))
                        length = n
                for i in range(at, at + length):
                    places[data[i : i + 3]] = i
                at += length
            assert fixtures.copies(data, window, least, most) == found
