"""Rasters against pixels that were put in, and damaged ones."""

import random
import struct
import zlib

import numpy as np
import pytest
from tests.test_blobs import blobs

from tessera import fixtures
from tessera.operators import fax, old_rasters, rasters, tiff_rasters


def drawing(seed, width=70, height=20):
    r = np.random.default_rng(seed)
    out = np.zeros((height, width), np.uint8)
    for _ in range(8):
        x, y = r.integers(0, width), r.integers(0, height)
        out[y : y + r.integers(1, 9), x : x + r.integers(1, 40)] ^= 1
    return out


def test_fax_codes_are_prefix_codes():
    for table in (*fax.RUNS, fax.MODES):
        codes = sorted(table)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))


@pytest.mark.parametrize("scheme", [2, 3, 4, 5])
def test_fax(scheme):
    for seed in range(20):
        image = drawing(seed, 70 if seed % 2 else 3000)
        data = fixtures.as_fax(image.tolist(), scheme)
        assert (fax.decode_fax(data, image.shape[1], image.shape[0], min(scheme, 4) if scheme < 5 else 3, int(scheme == 5)) == image).all()
    r = random.Random(1)
    for _ in range(50):
        assert fax.decode_fax(r.randbytes(100), 50, 30, 4).shape == (30, 50)


RGB = np.random.default_rng(1).integers(0, 256, (11, 13, 3)).astype(np.uint8)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("method", "pack"), [(1, bytes), (5, lambda d: fixtures.as_lzw(d, "tiff")), (8, zlib.compress), (32773, fixtures.as_packbits)])
def test_tiff(order, method, pack):
    strips = [pack(RGB[i : i + 4].tobytes()) for i in range(0, 11, 4)]
    places = [8 + sum(map(len, strips[:i])) for i in range(3)]
    base = [(256, 3, [13]), (257, 3, [11]), (258, 3, [8, 8, 8]), (259, 3, [method]), (262, 3, [2]), (273, 4, places), (277, 3, [3]), (278, 3, [4]), (279, 4, [len(s) for s in strips])]
    assert (next(tiff_rasters.tiff_images(fixtures.tiff_of(base, b"".join(strips), order))) == RGB).all()


def test_tiff_kinds():
    one = lambda body, *tags: next(tiff_rasters.tiff_images(fixtures.tiff_of([(273, 4, [8]), (279, 4, [len(body)]), *tags], body)))
    size = [(256, 3, [13]), (257, 3, [11])]
    steps = np.diff(RGB.astype(int), axis=1, prepend=0).astype(np.uint8)
    assert (one(steps.tobytes(), *size, (258, 3, [8]), (262, 3, [2]), (277, 3, [3]), (317, 3, [2])) == RGB).all()
    assert (one(RGB.transpose(2, 0, 1).tobytes(), *size, (258, 3, [8]), (262, 3, [2]), (277, 3, [3]), (284, 3, [2]), (278, 3, [11]))[:, :, 0] == RGB[:, :, 0]).all()
    index = (RGB[:, :, 0] % 16).astype(np.uint8)
    packed = np.packbits(np.unpackbits(index[:, :, None], axis=2)[:, :, 4:].reshape(11, -1), axis=1)
    table = [i * 257 for i in range(16)] + [0] * 16 + [65535 - i * 257 for i in range(16)]
    image = one(packed.tobytes(), *size, (258, 3, [4]), (262, 3, [3]), (320, 3, table))
    assert (image[:, :, 0] == index).all() and (image[:, :, 2] == 255 - index).all()
    picture = drawing(3)
    for scheme in (2, 3, 4):
        body = fixtures.as_fax(picture.tolist(), scheme)
        found = one(body, (256, 3, [70]), (257, 3, [20]), (259, 3, [scheme]), (262, 3, [0]))
        assert (found[:, :, 0] == 255 - 255 * picture).all()
    tiles = [np.pad(RGB, ((0, 5), (0, 3), (0, 0)))[y : y + 8, x : x + 8] for y in (0, 8) for x in (0, 8)]
    body = b"".join(t.tobytes() for t in tiles)
    tags = [*size, (258, 3, [8]), (262, 3, [2]), (277, 3, [3]), (322, 3, [8]), (323, 3, [8]), (324, 4, [8 + 192 * i for i in range(4)]), (325, 4, [192] * 4)]
    assert (next(tiff_rasters.tiff_images(fixtures.tiff_of(tags, body))) == RGB).all()


def test_old_images():
    gray = np.random.default_rng(2).integers(0, 256, (6, 8)).astype(np.uint8)
    table = bytes(range(256)) * 3
    palette = np.frombuffer(table, np.uint8).reshape(256, 3)
    read = old_rasters.ONE
    assert (read["bob"](struct.pack("<HH", 8, 6) + table + gray.tobytes()) == palette[gray]).all()
    assert (read["qdv"](struct.pack(">HHB", 8, 6, 255) + table + gray.tobytes()) == palette[gray]).all()
    assert (read["xpuzzle"](struct.pack(">IIB", 8, 6, 0) + table + gray.tobytes()) == palette[gray]).all()
    bits = drawing(4, 24, 5)
    rows = np.packbits(bits, axis=1).tobytes()
    white = 255 - 255 * bits
    assert (read["hpicn"](b"\1\0\1\0" + struct.pack("<HH", 24, 5) + rows)[:, :, 0] == white).all()
    assert (read["vbm"](b"BM\xcb\2" + struct.pack(">HH", 24, 5) + rows)[:, :, 0] == white).all()
    assert (read["bld"](struct.pack(">hh", 23, 4) + rows)[:, :, 0] == white).all()
    packed = b"".join(bytes([b, 0]) if b in (0, 255) else bytes([b]) for b in rows)
    assert (read["bld"](struct.pack(">hh", -23, 4) + packed)[:, :, 0] == white).all()
    assert (read["nol"](b"NOL".ljust(10, b"\0") + struct.pack("<HH", 24, 5) + bytes(6) + bytes(0x30 + b for b in bits.ravel().tolist()))[:, :, 0] == white).all()
    sixteen = np.arange(64, dtype=">u2").reshape(8, 8) * 1000
    found = read["godpaint"](b"G4" + struct.pack(">HH", 8, 8) + sixteen.astype(">u2").tobytes())
    assert found[1, 1].tolist() == [round(v * 255 / t) for v, t in ((9000 >> 11, 31), (9000 >> 5 & 63, 63), (9000 & 31, 31))]
    words = np.zeros((200, 20, 4, 2), np.uint8)
    words[0, 0] = [[0x80, 0], [0, 0], [0x80, 0], [0, 1]]
    found = read["degas"](b"\0\0" + struct.pack(">16H", *(0x111 * (i % 8) for i in range(16))) + words.tobytes())
    assert found[0, 0].tolist() == [round(5 * 255 / 7)] * 3 and found[0, 15].tolist() == [0, 0, 0] and found[0, 1].tolist() == [0, 0, 0]
    assert (read["sgiimage"](struct.pack(">HBBHHHH", 474, 0, 1, 3, 8, 6, 3).ljust(512, b"\0") + np.stack([gray] * 3)[:, ::-1].tobytes())[:, :, 1] == gray).all()
    runs = b"".join(bytes([0x86]) + r[:6].tobytes() + bytes([2, r[6], 0]) for r in gray[::-1])
    head = struct.pack(">HBBHHHH", 474, 1, 1, 2, 8, 6, 1).ljust(512, b"\0") + struct.pack(">6I", *(560 + 10 * i for i in range(6))) + struct.pack(">6I", *[10] * 6)
    assert (read["sgiimage"](head + runs)[:, :6, 0] == gray[:, :6]).all()
    icon = struct.pack("<HH", 7, 4) + bytes([0xFF, 0, 0, 0x0F] * 5) + bytes(2)
    (image,) = old_rasters.rip_icons(icon)
    assert image[0, 0].tolist() == old_rasters.pc16()[8].tolist() and image[0, 7].tolist() == old_rasters.pc16()[9].tolist()


def test_palettes():
    assert old_rasters.cga(1).tolist() == [[0, 0, 0], [0, 170, 170], [170, 0, 170], [170, 170, 170]]
    assert old_rasters.ega64()[[0, 20, 63]].tolist() == [[0, 0, 0], [170, 85, 0], [255, 255, 255]]
    vga = old_rasters.vga256()
    assert vga[32].tolist() == [0, 0, 255] and vga[36].tolist() == [255, 0, 255] and vga[40].tolist() == [255, 0, 0] and vga[44].tolist() == [255, 255, 0] and vga[247].any() and not vga[248:].any()


def test_damaged_images():
    for kind, read in rasters.readers().items():
        for seed in range(30):
            r = random.Random(seed)
            try:
                for _, image in zip(range(20), read(r.randbytes(r.choice([0, 3, 60, 900]))), strict=False):
                    assert image.ndim == 3 and image.dtype == np.uint8, kind
            except rasters.DAMAGE:
                pass


def test_pictures(spark):
    icon = struct.pack("<HH", 7, 4) + bytes(20) + bytes(2)
    rows = rasters.pictures(blobs(spark, icon * 3, b""), "ripicon").collect()
    assert [(r.path, r.file_id, r.width, r.height, r.err) for r in rows] == [("0", i, 8, 5, None) for i in range(3)]
    assert rasters.pictures(blobs(spark, b"x"), "tiff").first().err == "no TIFF header"
