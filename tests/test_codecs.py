"""Decompressors against encoders written here, known vectors and damaged inputs."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import codecs

TEXTS = [b"", b"a", b"abcabcabcabcabcabc" * 20, bytes(range(256)) * 4, bytes(5000), random.Random(1).randbytes(3000)]


def lzw_encode(data, variant, root=8, most=None):
    """The matching encoder: greedy phrases, codes sized as each variant's decoder expects."""
    high, most = variant == "tiff", most or (16 if variant == "compress" else 12)
    clear = 1 << root
    first = clear + (1 if variant == "compress" else 2)
    bits, out, size, group = [], bytearray(), root + 1, 0
    table = {}

    def emit(code):
        nonlocal group
        bits.extend((code >> (size - 1 - i if high else i)) & 1 for i in range(size))
        group += 1

    if variant != "compress":
        emit(clear)
    phrase, decoded = b"", 0
    for i in range(len(data)):
        more = phrase + data[i : i + 1]
        if len(more) == 1 or more in table:
            phrase = more
            continue
        emit(phrase[0] if len(phrase) == 1 else table[phrase])
        decoded += 1
        if first + len(table) < 1 << most:
            table[more] = first + len(table)
        known = min(first + decoded - 1, 1 << most)  # what the decoder's next code will be
        if size < most and known + high >= 1 << size:
            if variant == "compress" and group % 8:
                bits.extend([0] * size * (8 - group % 8))
            group = 0
            size += 1
        phrase = data[i : i + 1]
    if phrase:
        emit(phrase[0] if len(phrase) == 1 else table[phrase])
        decoded += 1
        known = min(first + decoded - 1, 1 << most)
        if size < most and known + high >= 1 << size:
            if variant == "compress" and group % 8:
                bits.extend([0] * size * (8 - group % 8))
            size += 1
    if variant != "compress":
        emit(clear + 1)
    bits.extend([0] * (-len(bits) % 8))
    for i in range(0, len(bits), 8):
        byte = bits[i : i + 8]
        out.append(sum(b << (7 - j if high else j) for j, b in enumerate(byte)))
    return bytes(out)


@pytest.mark.parametrize("variant", ["gif", "tiff"])
@pytest.mark.parametrize("data", TEXTS)
def test_lzw(variant, data):
    assert codecs.lzw(lzw_encode(data, variant), 1 << 20, variant).data == data


@pytest.mark.parametrize("data", [t for t in TEXTS if t])
def test_lzw_compress(data):
    found = codecs.lzw(lzw_encode(data, "compress"), len(data), "compress").data
    assert found == data


@given(st.binary(max_size=600))
@settings(max_examples=50, deadline=None)
def test_packbits_and_rle90(data):
    packed = b"".join(bytes([len(p) - 1]) + p for p in (data[i : i + 128] for i in range(0, len(data), 128)))
    assert codecs.packbits(packed).data == data
    assert codecs.rle90(data.replace(b"\x90", b"\x90\x00")).data == data


def test_runs():
    assert codecs.packbits(b"\xfe\x41\x80\x01BC").data == b"AAABC"
    assert codecs.packbits(b"\xffAB\x00CD", unit=2).data == b"ABABCD"
    assert codecs.rle90(b"A\x90\x05B").data == b"AAAAAB"
    assert codecs.pcx_rle(b"\x41\xc3\x42").data == b"ABBB"


@pytest.mark.parametrize("data", TEXTS)
def test_deflate(data):
    coder = zlib.compressobj(9, zlib.DEFLATED, -15)
    coded = coder.compress(data) + coder.flush()
    found = codecs.inflate(coded + b"rest")
    assert (found.data, found.taken, found.error) == (data, len(coded), None)
    if data:
        cut = codecs.inflate(coded[:-1])
        assert cut.error and data.startswith(cut.data)


def lzss_encode(data, start, fill):
    ring, here, out, at = bytearray([fill]) * 4096, start, bytearray(), 0
    while at < len(data):
        flags, items = 0, bytearray()
        for bit in range(8):
            if at >= len(data):
                break
            best = next((n for n in range(min(18, len(data) - at), 2, -1) if (p := bytes(ring).find(data[at : at + n])) >= 0 and not p <= here < p + n), 0)
            if best:
                place = bytes(ring).find(data[at : at + best])
                items += bytes([place & 0xFF, (place >> 4 & 0xF0) | best - 3])
            else:
                best, flags = 1, flags | 1 << bit
                items += data[at : at + 1]
            for byte in data[at : at + best]:
                ring[here] = byte
                here = (here + 1) % 4096
            at += best
        out += bytes([flags]) + items
    return bytes(out)


@pytest.mark.parametrize("data", [TEXTS[0], TEXTS[2], TEXTS[3], b"    spaces    " * 9])
def test_lzss(data):
    assert codecs.lzss(lzss_encode(data, 4078, 0x20)).data == data
    assert codecs.szdd(lzss_encode(data, 4080, 0x20)).data == data


def test_copies():
    assert codecs.hlp_lz77(b"\x02A\x00\x10").data == b"AAAAA"
    # literal A, then a copy of 5 from 1 back, then the end
    assert codecs.lzs(int("0" + "01000001" + "1" + "1" + "0000001" + "1100" + "110000000" + "0", 2).to_bytes(4, "big")).data == b"AAAAAA"
    assert codecs.implode_dcl(bytes.fromhex("00048224258f807f")).data == b"AIAIAIAIAIAIA"


def test_squeeze():
    # one node: bit 0 is A, bit 1 the end
    tree = (1).to_bytes(2, "little") + (-ord("A") - 1).to_bytes(2, "little", signed=True) + (-257).to_bytes(2, "little", signed=True)
    assert codecs.squeeze(tree + bytes([0b1000])).data == b"AAA"


def lh5_encode(data):
    """Blocks of literals only, with codes of 8 bits for all bytes."""
    bits = ""
    for at in range(0, len(data), 30_000):
        part = data[at : at + 30_000]
        bits += f"{len(part):016b}" + f"{0:05b}" + f"{10:05b}"  # all code lengths are 10 - 2 = 8
        bits += f"{256:09b}" + f"{0:04b}" + f"{0:04b}"
        bits += "".join(f"{b:08b}" for b in part)
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("data", TEXTS[1:])
def test_lh5(data):
    assert codecs.lh5(lh5_encode(data), len(data)).data == data


@pytest.mark.parametrize("method", sorted(codecs.METHODS))
@given(data=st.binary(max_size=80))
@settings(max_examples=40, deadline=None)
def test_anything_decodes(method, data):
    assert len(codecs.METHODS[method](data, 5_000).data) <= 5_300
